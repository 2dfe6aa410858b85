"""Incremental work as Structured Streaming over a folder of files."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store, Whole


def stream_parquet(spark: SparkSession, path: str, at: str, pattern: str = "*") -> DataFrame:
    """A stream of a folder's Parquet files; the event time becomes a timestamp that watermarks accept."""
    schema = spark.read.parquet(f"{path}/{pattern}").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)
    return rows.withColumn(at, F.col(at).cast("timestamp"))


def first_of_each(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """New keys only; state is bounded by the delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def activity(stream: DataFrame, at: str, key: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts by window and key, with room for late rows."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def run_once(frame: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Everything that is there now, batch by batch."""
    if hasattr(each, "bind"):
        each.bind(checkpoint)
    query = frame.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class MergedSummary:
    """A summary that micro-batches merge into, each exactly once.

    A version is written beside the old one, with the query and the batch it holds; a batch that was applied before a
    restart is recognised and left out. A query is known by the id in its checkpoint. Another query, or the same with a new
    checkpoint, reads its source from the start, so its batches aren't merged into a summary that is there already, unless
    `adopt` says that its source has new rows only.
    """

    def __init__(self, spark: SparkSession, folder: str, merge: Callable[[DataFrame, DataFrame], DataFrame], delta: Callable[[DataFrame], DataFrame], adopt: bool = False):
        self.spark, self.merge, self.delta, self.adopt = spark, merge, delta, adopt
        self.store, self.checkpoint = Store(spark, folder, {}), None

    def bind(self, checkpoint: str) -> None:
        """The checkpoint of the query whose batches come."""
        self.checkpoint = checkpoint.rstrip("/")

    def _query(self) -> str:
        return "batches" if self.checkpoint is None else json.loads(self.spark.read.text(f"{self.checkpoint}/metadata").first()[0])["id"]

    def versions(self) -> list[int]:
        """The last batch of this query, if there is one."""
        last = self.store.applied(self._query())
        return [last] if last >= 0 else []

    def read(self) -> DataFrame | None:
        """The newest whole version."""
        now = self.store.snapshot()
        return now.read("summary") if "summary" in now else None

    def __call__(self, batch: DataFrame, number: int) -> None:
        now, query = self.store.snapshot(), self._query()
        applied = now.manifest["applied"]
        if applied and query not in applied and not self.adopt:
            raise ValueError("the summary belongs to another query or checkpoint: use a new folder, or adopt=True if only new rows come")
        if applied.get(query, -1) >= number:
            return
        delta = self.delta(batch)
        new = self.merge(now.read("summary"), delta) if "summary" in now else delta
        self.store.commit(query, number, {"summary": Whole(new)}, now)
        self.store.vacuum()  # the version before stays, for readers that are at it


def newest(log: DataFrame, n: int = 10, at: str = "created_at", key: str = "id") -> DataFrame:
    """Bounded retention."""
    return log.orderBy(F.col(at).desc(), F.col(key).desc()).limit(n)


def ensure_built(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored projection, built first if it isn't there or is empty."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    if not there or spark.read.parquet(path).isEmpty():
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def describe(query: StreamingQuery) -> dict:
    """Rows and batches of a finished query."""
    progress = [json.loads(p.json) if hasattr(p, "json") else dict(p) for p in query.recentProgress]
    return {"batches": len(progress), "rows": sum(p.get("numInputRows", 0) for p in progress)}
