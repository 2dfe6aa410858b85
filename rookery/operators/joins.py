"""Joins of many rows with a table that has one row a key, where few keys hold much of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the rows from which a key is met on the map side, and keys that a sketch follows.
SUPPORT, TRACKED = 1e-3, 10_000
#: Estimated bytes of the rows from which keys are looked at first; below, the shuffle is small whatever the keys.
LARGE = 8 << 30
#: Rows of a table, counted, that every task may hold.
FEW = 100_000


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate, from file sizes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def frequent_keys(rows: DataFrame, key: str, support: float = SUPPORT) -> DataFrame:
    """The keys with about `support` of the rows or more, by a sketch that tasks merge: at most 2 / support rows, whatever the table."""
    most = min(TRACKED, int(2 / support))
    found = rows.where(F.col(f"`{key}`").isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {most}, {TRACKED})").alias("top"), F.count("*").alias("total"))
    return found.select(F.explode("top").alias("x"), "total").where(F.col("x.count") >= F.greatest(F.lit(2), F.col("total") * support)).select(F.col("x.item").alias(key))


def skew_join(rows: DataFrame, table: DataFrame, key: str, support: float = SUPPORT, large: int | None = None) -> DataFrame:
    """rows join table on key; `table` has one row a key.

    Rows of frequent keys meet their row of the table on the map side, as there are at most 2 / support such keys; all others meet in a
    shuffle, in which no key has much more than `support` of the rows. A key that the sketch misses goes the second way, so the
    result is the same. Rows below `large` estimated bytes are joined plainly.
    """
    if estimated_bytes(rows) < (LARGE if large is None else large):
        return rows.join(table, key)
    keys = F.broadcast(frequent_keys(rows, key, support))
    near = rows.join(F.broadcast(table.join(keys, key, "left_semi")), key)
    return near.unionByName(rows.join(keys, key, "left_anti").join(table, key))


def counted_join(rows: DataFrame, table: DataFrame, key: str, few: int = FEW) -> DataFrame:
    """rows join table on key; `table` has one row a key and is cheap to count.

    File sizes tell little of either side: compressed rows may look small enough to be broadcast, and a few keys may hold them all. A table
    of at most `few` rows is broadcast, so the rows stay where they are; of a larger one only the rows of frequent keys are.
    """
    if table.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(table), key)
    return skew_join(rows, table.hint("merge"), key, large=0)
