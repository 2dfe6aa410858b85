"""Skewed joins against plain ones."""

import pytest
from pyspark.sql import functions as F

from rookery.operators import joins, positions


@pytest.fixture(scope="module")
def rows(spark):
    """Three tenths of the rows hold one key; some have none."""
    key = F.when(F.col("id") % 10 < 3, 7).when(F.col("id") % 10 == 9, F.lit(None)).otherwise(F.col("id"))
    return spark.range(20000).select(key.alias("k"), F.col("id").alias("x"))


def test_same_rows(spark, rows):
    table = spark.range(0, 20000, 2).unionByName(spark.range(7, 8)).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    got = joins.skew_join(rows, table, "k", large=0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(table, "k").collect()))


def test_only_frequent_keys_are_named(rows):
    assert [r.k for r in joins.frequent_keys(rows, "k", 0.01).collect()] == [7]
    assert joins.frequent_keys(rows.limit(0), "k").count() == 0


def test_no_task_gets_the_frequent_key(spark, rows):
    """With shuffles only, the largest task of the rest is near the median; the plain join has the key's rows in one."""
    table = rows.select("k").where("k IS NOT NULL").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        split = joins.skew_join(rows.repartition(8), table, "k", large=0)
        plain = rows.join(table, "k")
        sizes = [sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()) for df in (split, plain)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes[0]) == sum(sizes[1]) == 18000
    assert sizes[0][-1] < 3 * sizes[0][len(sizes[0]) // 2] and sizes[1][-1] > 3 * sizes[1][len(sizes[1]) // 2]


def test_openings_expand_different_games_only(spark):
    """A hundred games with the same moves are one row for the prefixes."""
    moves = spark.createDataFrame([(g, n, f"w{n}", "--" if g % 2 and n == 5 else "b") for g in range(100) for n in range(1, 8)], "link long, n_move int, white_move string, black_move string")
    game = spark.range(100).select(F.col("id").alias("link"), (F.col("id") * 1.0).alias("avg_elo"))
    got = {(r.n_moves, r.opening.split()[-2]): (r.n, r.elo_sum, r.rated) for r in positions.opening_counts(moves, game).collect()}
    assert got == {(n, f"w{n}"): ((100, 4950.0, 100) if n < 5 else (50, 2450.0, 50)) for n in range(3, 8)}
    assert positions.openings(moves).count() == 100 * 2 + 50 * 3
    gaps = spark.createDataFrame([(1, 1, "a", "b"), (1, 2, "a", "b"), (1, 4, "a", "b"), (2, 1, "a", None), (2, 2, "a", "b"), (2, 3, "a", "b")], moves.schema)
    assert positions.openings(gaps).count() == 0


@pytest.mark.parametrize("few", [100_000, 5])
def test_few_rows_come_to_the_others(spark, rows, tmp_path, few):
    """A small table is broadcast to rows that look as small in their files; a larger one only with its frequent keys."""
    rows.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    table = spark.range(0, 20000, 2).unionByName(spark.range(7, 8)).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    got = joins.counted_join(stored, table, "k", few)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and ("SortMergeJoin" in plan) == (few == 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stored.join(table, "k").collect()))


def test_moves_are_dealt_by_link_once(spark, sf):
    from rookery.plans.adapters import Tables

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert Tables(spark, sf).moves.groupBy("link").count()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
