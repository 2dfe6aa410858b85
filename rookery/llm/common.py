"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a regular expression class body.
SPACE = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Keys that count as heavy in a join, at most: each has more than 1 / HEAVY of the rows.
HEAVY = 1000

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_folders[app]


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage: write `df` as Parquet into the shared folder and read it back.

    Parquet keeps the cut compact and prunable, and a lost executor costs only the
    rereading of files, never the work before the cut. Zstandard, as these tables hold texts and
    are read about as often as they are written.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boxed(docs: DataFrame) -> DataFrame:
    """One column, row: a struct of all columns. Whatever is added beside it can't clash with a column of the user's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def field(name: str) -> Column:
    """A column of the boxed row."""
    return F.col("row").getField(name)


def unboxed(rows: DataFrame, names: Sequence[str], **changed: Column) -> DataFrame:
    """The user's columns again; `changed` ones take another value."""
    return rows.select(*[changed.get(c, field(c)).alias(c) for c in names])


def heavy_join(left: DataFrame, right: DataFrame, keys: Sequence[str], n: str, total: int, how: str = "inner", heavy: int = HEAVY) -> DataFrame:
    """A join with `right`, which has one row for each key, and in column `n` how many rows `left` has of it; `total`: their sum, or more.

    Keys with more than a `heavy`-th of the rows, fewer than `heavy` of them, meet their rows on the map
    side; in the shuffle of the others no key has more. Both frames should be written tables. Column `n` goes.
    """
    limit = max(64, total // heavy)
    top, rest = right.where(F.col(n) > limit).drop(n), right.where(F.coalesce(F.col(n), F.lit(0)) <= limit).drop(n)
    if top.isEmpty():
        return left.join(rest, list(keys), how)
    there = F.broadcast(top)
    return left.join(there, list(keys)).unionByName(left.where(~among(keys, top)).join(rest, list(keys), how))


def among(keys: Sequence[str], few: DataFrame) -> Column:
    """Whether a row has the keys of one of a few rows, fewer than HEAVY, which the filter holds; false where a key is null."""
    kind = few.schema
    given = [F.struct(*[F.lit(r[k]).cast(kind[k].dataType).alias(k) for k in keys]) for r in few.select(*keys).collect()]
    return F.struct(*[F.col(k).cast(kind[k].dataType).alias(k) for k in keys]).isin(*given)


def whole(column: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(column, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast path, which is the same function there."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words_of(text: Column) -> Column:
    """The runs of characters that aren't ASCII white space."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once. Within a lambda, a bare expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def held(value: Column) -> Column:
    """The same value, by way of the row number, which is never negative.

    It keeps filters on the value above the steps that lead to it. Pushed below them, a filter would
    hold every step spelled out many times over, and within lambdas once for each word.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def steps(rows: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows whose texts have some `size` bytes, besides one longer text."""
    ends = np.cumsum(pc.binary_length(rows.column(column)).to_numpy())
    cuts = np.flatnonzero(np.diff(ends // size, prepend=0)).tolist()
    for a, b in pairwise(sorted({0, *cuts, rows.num_rows})):
        yield rows.slice(a, b - a)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
