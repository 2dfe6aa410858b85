from pyspark.sql import functions as F

from rookery.operators.positions import running_keys


def test_equal_prefixes_and_only_they_are_equal_states(spark):
    df = spark.createDataFrame([(k, i, t) for k, text in enumerate(["abcab", "abdab", "ba", "abcab", "aab", ""]) for i, t in enumerate(text)] + [(9, 0, None), (9, 1, "x"), (9, 1, "y")], "k long, i int, t string")
    got = {(r.k, r.step): r.state for r in running_keys(df, ["k"], ["i"], "t").collect()}
    tokens = {}
    for r in df.orderBy("k", "i", "t").collect():
        tokens.setdefault(r.k, []).append(r.t)
    prefixes = {(k, n): tuple(t or "" for t in x[:n]) for k, x in tokens.items() for n in range(1, len(x) + 1)}
    assert set(got) == set(prefixes)
    assert all((got[a] == got[b]) == (prefixes[a] == prefixes[b]) for a in got for b in got)


def test_a_long_sequence(spark):
    df = spark.range(200_000).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.col("id") % 7).cast("string").alias("t"))
    assert running_keys(df, ["k"], ["i"], "t").agg(F.count_distinct("state")).first()[0] == 200_000


def test_rows_are_sorted_once(spark):
    """A task holds its rows in one sort; rows that come by key already are not dealt again."""
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("i"), F.lit("t").alias("t"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = running_keys(df, ["k"], ["i"], "t")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1


def test_states_go_on_from_stored_ones(spark):
    df = spark.createDataFrame([(k, i, t) for k, text in enumerate(["abcab", "ab", "cabca"]) for i, t in enumerate(text)], "k long, i int, t string")
    whole, first = running_keys(df, ["k"], ["i"], "t"), running_keys(df.where("i < 2 AND k < 2"), ["k"], ["i"], "t")
    last = first.groupBy("k").agg(F.max_by(F.struct("step", "state"), "step").alias("s")).select("k", "s.*")
    rest = running_keys(df.where("i >= 2 OR k = 2"), ["k"], ["i"], "t", last)
    assert sorted(map(tuple, first.unionByName(rest).collect())) == sorted(map(tuple, whole.collect()))
