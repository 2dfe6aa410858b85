"""Several tables that change together: versioned folders, and one manifest that is written last.

A commit writes what changes into new folders and then one small file, the manifest of the next version: where the parts
of each table lie, and the last batch of each job. Readers take all tables of one manifest, so they see a batch in
every table or in none; a job that dies between two writes leaves the old version, and its folders go with the next
`vacuum`. A batch that comes again is recognised by its job and number and changes nothing.

Tables with a key are cut into buckets by its hash. A commit reads and rewrites the buckets that its rows fall into and no
others; the manifest takes over the other buckets' paths. Rows that only come on top are written beside those of their buckets, until one
has PARTS parts; then the next commit brings each of its buckets together. So buckets times PARTS bounds what a manifest holds. A large
bucket is written by several tasks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.storage import delete, filesystem, listed

#: Tables of a commit that are written at the same time.
AT_ONCE = 4
#: Parts of a bucket beside each other, at most.
PARTS = 8
_BUCKET = "store_bucket"
_WHOLE = "all"


def on_top(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows and new ones, which may lack columns."""
    return old.unionByName(new, allowMissingColumns=True)


def nothing(spark: SparkSession, schema: StructType) -> DataFrame:
    """No rows, which the optimizer knows: they cost no tasks."""
    return spark.range(0).limit(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


@dataclass(frozen=True)
class Rows:
    """Rows that meet those of their buckets: merge(old, new) is what stays there. touch: keys whose buckets are meant, if not the rows' own.
    Where those take long to find out, as rows that are added up, touch can be any keys that have them all.
    dealt: the rows come by bucket already (Store.dealt), so that rows which are spelled out since then aren't shuffled."""

    new: DataFrame
    merge: Callable[[DataFrame, DataFrame], DataFrame] = on_top
    touch: DataFrame | None = None
    dealt: bool = False


@dataclass(frozen=True)
class Whole:
    """A table that takes the place of the old one."""

    table: DataFrame


class Conflict(RuntimeError):
    """Another job has committed since the version that this one read."""


class Snapshot:
    """All tables as one version has them."""

    def __init__(self, store: Store, manifest: dict):
        self.store, self.manifest = store, manifest

    @property
    def version(self) -> int:
        return self.manifest["version"]

    def __contains__(self, name: str) -> bool:
        return name in self.manifest["tables"]

    def schema(self, name: str) -> StructType:
        return StructType.fromJson(self.manifest["tables"][name]["schema"])

    def read(self, name: str, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        parts = self.manifest["tables"][name]["parts"]
        paths = [p for b, own in parts.items() if buckets is None or int(b) in buckets for p in own]
        if not paths:
            return nothing(self.store.spark, self.schema(name))
        return self.store.spark.read.schema(self.schema(name)).parquet(*[f"{self.store.folder}/{p}" for p in paths])

    def read_near(self, name: str, keys: DataFrame) -> DataFrame:
        """The buckets of these keys, with all rows there."""
        return self.read(name, self.store.buckets_of(name, keys, self.schema(name)))

    def read_keys(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of these keys; only their buckets are read."""
        keys = keys.select(*self.store.keys[name]).distinct()
        rows = self.read_near(name, keys)
        return rows.join(keys.hint("merge"), list(self.store.keys[name]), "left_semi")


class Store:
    """keys: the key columns of each table that has buckets; other tables are written whole."""

    def __init__(self, spark: SparkSession, folder: str, keys: Mapping[str, Sequence[str]], buckets: int = 64):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), {k: list(v) for k, v in keys.items()}, buckets

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in listed(self.spark, f"{self.folder}/versions") if n.endswith(".json"))

    def _manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.folder}/versions/{version:012d}.json").first()[0])

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or an older one that `vacuum` has left."""
        have = self.versions()
        if not have:
            return Snapshot(self, {"version": 0, "applied": {}, "tables": {}})
        return Snapshot(self, self._manifest(have[-1] if version is None else version))

    def read(self, name: str) -> DataFrame:
        return self.snapshot().read(name)

    def applied(self, job: str) -> int:
        """The last batch of a job; -1 if there is none."""
        return self.snapshot().manifest["applied"].get(job, -1)

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*self.keys[name]), F.lit(self.buckets)).cast("int")

    def buckets_of(self, name: str, rows: DataFrame, schema: StructType) -> list[int]:
        """The buckets that rows fall into, at most all there are."""
        typed = rows.select(*[F.col(k).cast(schema[k].dataType) for k in self.keys[name]])
        return [r[0] for r in typed.select(self.bucket(name)).distinct().collect()]

    def dealt(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows by their buckets, of which a large one takes several tasks."""
        return rows.withColumn(_BUCKET, self.bucket(name)).hint("rebalance", _BUCKET)

    def _write(self, name: str, rows: DataFrame, dealt: bool = False) -> dict[str, list[str]]:
        path = f"tables/{name}/{uuid.uuid4().hex}"
        if name not in self.keys:
            rows.write.option("compression", "zstd").parquet(f"{self.folder}/{path}")
            return {_WHOLE: [path]}
        rows = rows.withColumn(_BUCKET, self.bucket(name)) if dealt else self.dealt(name, rows)
        rows.write.partitionBy(_BUCKET).option("compression", "zstd").parquet(f"{self.folder}/{path}")
        names = listed(self.spark, f"{self.folder}/{path}")
        return {n.removeprefix(f"{_BUCKET}="): [f"{path}/{n}"] for n in names if n.startswith(_BUCKET)}

    def _changed(self, now: Snapshot, name: str, change: Rows | Whole) -> dict:
        if isinstance(change, Whole):
            return {"schema": change.table.schema.jsonValue(), "parts": self._write(name, change.table)}
        if name not in now:
            alone = change.merge is on_top
            rows = change.new if alone else change.merge(nothing(self.spark, change.new.schema), change.new)
            return {"schema": rows.schema.jsonValue(), "parts": self._write(name, rows, alone and change.dealt)}
        schema, stored = now.schema(name), now.manifest["tables"][name]["parts"]
        if change.merge is on_top and set(change.new.columns) <= set(schema.names) and all(len(p) < PARTS for p in stored.values()):
            have = [f for f in schema if f.name in change.new.columns]  # the others are null where a part lacks them
            added = self._write(name, change.new.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in have]), change.dealt)
            return {"schema": schema.jsonValue(), "parts": stored | {b: stored.get(b, []) + p for b, p in added.items()}}
        touched = self.buckets_of(name, change.touch or change.new, schema) if name in self.keys else None
        told = change.merge(now.read(name, touched), change.new)
        schema = StructType([*schema, *[f for f in told.schema if f.name not in schema.names]])  # what older parts lack is null there
        rows = told.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
        parts = {b: p for b, p in stored.items() if touched is not None and int(b) not in touched}
        return {"schema": schema.jsonValue(), "parts": parts | self._write(name, rows)}

    def commit(self, job: str, batch: int, changes: Mapping[str, Rows | Whole], now: Snapshot | None = None) -> bool:
        """Write all changes as the next version; False if the job's batch, or a later one, is there already.

        `now`: the version that the changes were made from.
        """
        now = now or self.snapshot()
        if now.manifest["applied"].get(job, -1) >= batch:
            return False
        with ThreadPoolExecutor(AT_ONCE) as pool:  # threads that wait for Spark's jobs
            written = {name: pool.submit(self._changed, now, name, change) for name, change in changes.items()}
        tables = now.manifest["tables"] | {name: done.result() for name, done in written.items()}
        self._publish({"version": now.version + 1, "applied": now.manifest["applied"] | {job: batch}, "tables": tables})
        return True

    def _publish(self, manifest: dict) -> None:
        """The manifest appears whole, under a name that isn't taken."""
        final, draft = f"{self.folder}/versions/{manifest['version']:012d}.json", f"{self.folder}/versions/.{uuid.uuid4().hex}"
        fs, there = filesystem(self.spark, final)
        _, p = filesystem(self.spark, draft)
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(there) or not fs.rename(p, there):
            fs.delete(p, False)
            raise Conflict(f"version {manifest['version']} has been written by another job")

    def vacuum(self, keep: int = 2) -> None:
        """Delete versions but the last ones, and folders that none of those has."""
        have = self.versions()
        live = set()
        for v in have[-keep:]:
            for table in self._manifest(v)["tables"].values():
                live |= {"/".join(p.split("/")[1:3]) for own in table["parts"].values() for p in own}
        for v in have[:-keep]:
            delete(self.spark, f"{self.folder}/versions/{v:012d}.json")
        for name in listed(self.spark, f"{self.folder}/tables"):
            for part in listed(self.spark, f"{self.folder}/tables/{name}"):
                if f"{name}/{part}" not in live:
                    delete(self.spark, f"{self.folder}/tables/{name}/{part}")
