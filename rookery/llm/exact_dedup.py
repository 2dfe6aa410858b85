"""Operator 3: exact deduplication with a heavy-hitter split.

1. Every text becomes a SHA-256 digest of its normal form (A-Z lower-cased, null as empty);
   only row ids and digests are kept, in one written table.
2. Misra-Gries counters (the frequent-items sketch of `approx_top_k_accumulate`, `COUNTERS` of them)
   are gathered for each of `PARTS` groups of tasks and then merged, so that no task merges the counters of all.
   They name every digest that can hold more than `support` of the rows: the sketch errs by no more
   than 3.5 / `COUNTERS` of the rows.
3. The named digests are counted exactly; those that really are frequent are the winners,
   at most 1/support rows, which bounds their broadcast.
4. A copy of a winner that can't be the one to stay is decided (or removed) on the map side.
   All other rows meet by digest in one ordinary shuffle; no group there exceeds `support`
   of the rows.

Defined cases: null and empty texts are equal. The largest id stays; null ids sort below all
others; a row repeated with the same id and text stays once. A text of any length is digested whole. An empty
table gives no rows. Columns besides id and text don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, boxed, documents, field, saved, unboxed, whole

#: Share of the rows from which a digest is frequent; its inverse bounds what is broadcast.
SUPPORT = 1e-4
#: Counters of a sketch, groups of tasks, and digests that are named at most: those with half the support or more.
COUNTERS, PARTS = 131072, 64


def digest(text: Column) -> Column:
    return F.sha2(ascii_lower(whole(text)).cast("binary"), 256)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The written table of row ids and digests."""
    return saved(docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest")))


def named(rows: DataFrame, support: float) -> DataFrame:
    """The digests that can have more than `support` of the rows."""
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part")
    some = rows.groupBy(part).agg(F.expr(f"approx_top_k_accumulate(digest, {COUNTERS})").alias("s"))
    both = some.groupBy(F.lit(0).alias("part")).agg(F.expr(f"approx_top_k_combine(s, {COUNTERS})").alias("s"))
    most = min(COUNTERS, int(2 / support) + 1)
    return both.select(F.explode(F.expr(f"approx_top_k_estimate(s, {most})")).alias("x")).select(F.col("x.item").alias("digest"))


def winners(rows: DataFrame, support: float) -> DataFrame:
    """The digests with more than `support` of the rows: digest, top (largest id), n. At most 1/support rows."""
    least = max(2, int(rows.count() * support))
    exact = rows.join(F.broadcast(named(rows, support)), "digest", "left_semi").groupBy("digest")
    return exact.agg(F.max("id").alias("top"), F.count("*").alias("n")).where(F.col("n") >= least)


def _lost(row_id: Column) -> Column:
    """A copy of a winner whose id isn't the one that stays."""
    return F.col("n").isNotNull() & ~row_id.eqNullSafe(F.col("top"))


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row for each row of `docs`: id, keep_id, group_size, kept, text_sha256."""
    rows = keyed(docs, id_col, text_col)
    heavy = F.broadcast(saved(winners(rows, support)))
    told = rows.join(heavy, "digest", "left")
    names = [id_col, "keep_id", "group_size", "kept", "text_sha256"]
    sent = told.where(_lost(F.col("id"))).select(
        F.col("id").alias(id_col), F.col("top").alias("keep_id"), F.col("n").alias("group_size"), F.lit(False).alias("kept"), F.col("digest").alias("text_sha256")
    )
    group = Window.partitionBy("digest")
    met = (
        told.where(~_lost(F.col("id")))
        .withColumn("place", F.row_number().over(group.orderBy(F.col("id").desc_nulls_last())))
        .withColumn("most", F.max("id").over(group))
        .withColumn("here", F.count("*").over(group))
    )
    met = met.select(
        F.col("id").alias(id_col),
        F.col("most").alias("keep_id"),
        F.coalesce("n", "here").alias("group_size"),
        (F.col("place") == 1).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    return met.unionByName(sent).select(names)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of `docs` that stay, with their columns. Copies of winners never reach the shuffle."""
    heavy = F.broadcast(saved(winners(keyed(docs, id_col, text_col), support)))
    told = boxed(docs).withColumn("digest", digest(field(text_col))).join(heavy, "digest", "left").where(~_lost(field(id_col)))
    first = F.row_number().over(Window.partitionBy("digest").orderBy(F.col("id").desc_nulls_last()))
    return unboxed(told.withColumn("id", field(id_col)).withColumn("place", first).where("place = 1"), docs.columns)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_classes(documents(spark, sf_dir))


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents
), w AS (
  SELECT doc_id, h, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
         row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) AS place
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, h AS text_sha256 FROM w
"""
