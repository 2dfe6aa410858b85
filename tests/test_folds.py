from pyspark.sql import functions as F

from rookery.operators.positions import fold_sequences
from rookery.streaming import folds, jobs


def rule():
    """A local function, which goes to the tasks by value."""

    def step(state, token):
        if token == "!":
            raise ValueError("bad token")
        return state + 1, f"{state}{token}"

    return step


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def streamed(spark, tmp_path, parts, first):
    """Parts of a table, each a run of the same query."""
    source, sink = str(tmp_path / "in"), folds.FoldedStates(spark, str(tmp_path / "out"), 4)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        frame = spark.readStream.schema(part.schema).parquet(source)
        with folds.lasting_state(spark):
            jobs.run_once(folds.fold_stream(frame, "k", "i", "t", rule(), 0, first=first), sink, str(tmp_path / "progress"), "append")
    return rows(sink.states().select("key", "step", "state", "token")), rows(sink.failures().select("key", "step", "token", "error"))


def test_growing_keys_agree_with_a_fold_of_all(spark, tmp_path):
    """Key 3 fails in its second batch, so its states go; key 4's tokens come in the wrong order; some come twice, some are null."""
    whole = [(k, i, "abc"[(k + i) % 3]) for k in (1, 2, 5) for i in range(1, 8)] + [(3, 1, "a"), (3, 2, "b"), (3, 3, "!"), (3, 4, "c")] + [(4, i, str(i)) for i in (1, 2, 3, 4)]
    df = spark.createDataFrame(whole, "k long, i int, t string")
    batch = {0: "i <= 2 AND k < 4 OR k = 4 AND i IN (1, 4)", 1: "i IN (2, 3) AND k < 4 OR k = 4 AND i = 3 OR k = 5 AND i < 3", 2: "i > 3 OR k = 4 OR k = 5"}
    odd = spark.createDataFrame([(None, 1, "x"), (1, None, "x"), (9, 1, None)], "k long, i int, t string")
    parts = [df.where(batch[0]), df.where(batch[1]).unionByName(odd), df.where(batch[2])]
    states, failed = fold_sequences(df, "k", ["i"], "t", rule(), 0)
    got = streamed(spark, tmp_path, parts, first=1)
    assert got == (rows(states.select("key", "step", "state", "token")), rows(failed.select("key", "step", "token", "error")))
    assert got[1] == [(3, 3, "!", "ValueError: bad token")]


def test_places_with_gaps(spark, tmp_path):
    df = spark.createDataFrame([(1, 10, "a"), (1, 30, "c"), (1, 20, "b"), (2, 5, "x")], "k long, i int, t string")
    states, failed = streamed(spark, tmp_path, [df.where("i < 25"), df.where("i >= 20").withColumn("t", F.col("t"))], first=None)
    assert states == [(1, 1, "0a", "a"), (1, 2, "1b", "b"), (1, 3, "2c", "c"), (2, 1, "0x", "x")] and failed == []


def test_many_keys_share_a_group(spark, tmp_path):
    """A call into Python for each group of keys, not for each key: 20,000 keys in two runs, and one group of several keys."""
    df = spark.range(40_000).selectExpr("id % 20000 AS k", "1 + id DIV 20000 AS i", "'x' AS t")
    states, failed = streamed(spark, tmp_path, [df.where("i = 1"), df.where("i = 2")], first=1)
    assert len(states) == 40_000 and failed == [] and set(s[1:] for s in states) == {(1, "0x", "x"), (2, "1x", "x")}
    frame = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    with folds.lasting_state(spark):
        sink = folds.FoldedStates(spark, str(tmp_path / "one"), 4)
        jobs.run_once(folds.fold_stream(frame.where("k < 50"), "k", "i", "t", rule(), 0, first=1, groups=1), sink, str(tmp_path / "p1"), "append")
    assert rows(sink.states().select("key", "step", "state", "token")) == [s for s in states if s[0] < 50]
