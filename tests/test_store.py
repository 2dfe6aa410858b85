"""Commits of several tables: all of them or none, once, and only the buckets they touch."""

import pytest
from pyspark.sql import functions as F

from rookery.operators.positions import read_evaluations
from rookery.sources import updates
from rookery.sources.store import Conflict, Rows, Store, Whole
from rookery.sources.upserts import upsert_add, upsert_replace

KEYS = {"a": ["id"]}


def add(old, new):
    return upsert_add(old, new, ["id"], ["n"])


def make(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, n long")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), KEYS, buckets=16)


def told(df):
    return sorted(map(tuple, df.collect()))


def test_commits_and_replays(spark, store):
    assert store.commit("j", 0, {"a": Rows(make(spark, (1, 1), (2, 1)), add), "b": Whole(spark.range(2))})
    assert store.commit("j", 1, {"a": Rows(make(spark, (2, 5), (3, 1)), add)})
    assert not store.commit("j", 1, {"a": Rows(make(spark, (2, 5)), add)}) and not store.commit("j", 0, {"a": Rows(make(spark, (2, 5)), add)})
    assert told(store.read("a")) == [(1, 1), (2, 6), (3, 1)] and store.read("b").count() == 2
    assert store.applied("j") == 1 and store.applied("other") == -1
    assert store.commit("other", 0, {"a": Rows(make(spark, (9, 9)), add)}) and store.snapshot(2).read("a").count() == 3


def test_a_job_that_dies_leaves_the_old_version(spark, store):
    store.commit("j", 0, {"a": Rows(make(spark, (1, 1)), add), "b": Whole(spark.range(2))})

    def broken(old, new):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.commit("j", 1, {"b": Whole(spark.range(5)), "a": Rows(make(spark, (1, 1)), broken)})
    assert store.snapshot().version == 1 and store.read("b").count() == 2 and told(store.read("a")) == [(1, 1)]
    assert store.commit("j", 1, {"b": Whole(spark.range(5)), "a": Rows(make(spark, (1, 1)), add)})
    assert store.read("b").count() == 5 and told(store.read("a")) == [(1, 2)]


def test_few_keys_rewrite_few_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), KEYS, buckets=50)
    store.commit("j", 0, {"a": Rows(spark.range(5000).select("id", F.lit(1).cast("long").alias("n")), add)})
    before = store.snapshot().manifest["tables"]["a"]["parts"]
    store.commit("j", 1, {"a": Rows(make(spark, *[(i, 10) for i in range(5)]), add)})
    after = store.snapshot().manifest["tables"]["a"]["parts"]
    assert set(before) == set(after) and 1 <= sum(before[b] != after[b] for b in before) <= 5
    assert store.read("a").agg(F.sum("n")).first()[0] == 5050 and store.read("a").count() == 5000
    touched = store.snapshot().read_keys("a", make(spark, (3, 0)).select("id"))
    assert told(touched) == [(3, 11)] and len(touched.inputFiles()) < len(store.read("a").inputFiles())


def test_two_writers(spark, store):
    store.commit("j", 0, {"a": Rows(make(spark, (1, 1)), add)})
    now = store.snapshot()
    store.commit("j", 1, {"a": Rows(make(spark, (2, 1)), add)}, now)
    with pytest.raises(Conflict):
        store.commit("k", 0, {"a": Rows(make(spark, (3, 1)), add)}, now)
    assert told(store.read("a")) == [(1, 1), (2, 1)]


def test_vacuum_keeps_what_is_read(spark, store):
    for i in range(4):
        store.commit("j", i, {"a": Rows(make(spark, (i, 1)), add), "b": Whole(spark.range(i + 1))})
    store.vacuum(keep=1)
    assert store.versions() == [4] and told(store.read("a")) == [(i, 1) for i in range(4)] and store.read("b").count() == 4


def test_keys_of_other_types_and_new_columns(spark, store):
    store.commit("j", 0, {"a": Rows(make(spark, (1, 1), (2, 2)), add)})
    new = spark.createDataFrame([(2, 9, "x")], "id int, n int, name string")
    store.commit("j", 1, {"a": Rows(new, lambda old, rows: upsert_replace(old.withColumn("name", F.lit(None).cast("string")), rows, ["id"]))})
    assert told(store.read("a").where("id = 2")) == [(2, 9, "x")] and store.read("a").where("id = 1").first().name is None


def test_empty_batches(spark, store):
    assert store.commit("j", 0, {"a": Rows(make(spark), add)}) and store.read("a").count() == 0
    assert store.commit("j", 1, {"a": Rows(make(spark, (1, 1)), add)}) and store.commit("j", 2, {"a": Rows(make(spark), add)})
    assert told(store.read("a")) == [(1, 1)]


def test_profiles_and_shell_rows(spark, tmp_path):
    store = updates.game_store(spark, str(tmp_path / "s"), 4)
    profiles = spark.createDataFrame([("ann", "Ann", 5)], "player_name string, name string, joined long")
    asked = spark.createDataFrame([("ann",), ("bob",)], "player_name string")
    updates.store_profiles(store, profiles, asked, "p", 0)
    assert told(store.read("player")) == [("ann", "Ann", 5), ("bob", None, 0)]
    updates.store_profiles(store, profiles.limit(0), asked, "p", 1)  # nothing is fetched: known rows stay
    assert told(store.read("player")) == [("ann", "Ann", 5), ("bob", None, 0)]


def test_evaluations_of_one_player(spark, tmp_path):
    store = updates.game_store(spark, str(tmp_path / "s"), 4)
    fen = spark.createDataFrame([("p1", 2, None), ("p2", 1, None)], "fen string, n_games long, score double").withColumns({c: F.lit(None).cast("string" if c == "next_moves" else "double") for c in ("next_moves", "wdl_win", "wdl_draw", "wdl_loss")})
    edges = spark.createDataFrame([(1, "p1", 1, "white"), (2, "p2", 1, "white"), (2, "p1", 1, "black")], "game_link long, fen_fen string, n_move int, move_color string")
    gp = spark.createDataFrame([(1, "ann"), (2, "bob")], "link long, player_name string")
    from rookery.operators.positions import game_analysis_summary

    gas = game_analysis_summary(edges, fen)
    store.commit("first", 0, {"fen": Rows(fen), "association": Rows(edges), "association_by_fen": Rows(edges), "game_player": Rows(gp), "game_analysis_summary": Rows(gas), "fen_totals": Whole(spark.sql("SELECT 2L AS positions, 0L AS scored, 2L AS unscored"))})
    text = '[{"score": 120, "pv": ["e4"], "wdl": [1, 0, 0]}]'
    answers = read_evaluations(spark.createDataFrame([("p1", True, text), ("p2", True, text)], "fen string, is_valid boolean, analysis string"))
    updates.store_evaluations(store, answers, "e", 0, player="ann")
    assert told(store.read("fen").select("fen", "score")) == [("p1", 120.0), ("p2", None)]
    assert told(store.read("game_analysis_summary").select("link", "analyzed_positions", "unscored_positions")) == [(1, 1, 0), (2, 1, 1)]
    assert told(store.read("fen_totals")) == [(2, 1, 1)] and store.read("scored_totals").first().white_positions == 1


def test_appends_leave_stored_files(spark, tmp_path):
    """Rows that come on top are written beside the others; a bucket of many parts is brought together; every version stays readable."""
    from rookery.sources.store import PARTS

    store = Store(spark, str(tmp_path / "s"), KEYS, buckets=2)
    for i in range(PARTS + 2):
        store.commit("j", i, {"a": Rows(spark.range(40 * i, 40 * i + 40).select("id", F.lit(i).cast("int").alias("n")))})
        parts = store.snapshot().manifest["tables"]["a"]["parts"]
        assert store.read("a").count() == 40 * (i + 1)
        assert {len(p) for p in parts.values()} == {i + 1 if i < PARTS else i - PARTS + 1}
    assert store.snapshot(2).read("a").count() == 80
    store.vacuum(keep=1)
    assert told(store.read("a")) == [(i, i // 40) for i in range(40 * (PARTS + 2))]


def test_batch_sized_keys_are_not_broadcast(spark, tmp_path):
    """Files of keys are small, but what is broadcast of them grows with the batch, in the driver's memory too."""
    keys, rows = str(tmp_path / "keys"), str(tmp_path / "rows")
    spark.range(200_000).write.parquet(keys)
    spark.range(400_000).withColumn("n", F.lit(1)).write.parquet(rows)
    k, r = spark.read.parquet(keys), spark.read.parquet(rows)
    store = Store(spark, str(tmp_path / "s"), KEYS, buckets=2)
    store.commit("j", 0, {"a": Rows(r)})
    from rookery.sources.upserts import new_only, replace_keys, update_by_key

    for frame in (new_only(r, k, ["id"]), upsert_replace(r, k.withColumn("n", F.lit(2)), ["id"]), replace_keys(r, r.limit(0), k, ["id"]), update_by_key(r, k.withColumn("n", F.lit(2)), "id", ["n"]), store.snapshot().read_keys("a", k)):
        assert "BroadcastHashJoin" not in frame._jdf.queryExecution().executedPlan().toString()


def test_nothing_to_do_writes_nothing(spark, tmp_path):
    """Positions of no games: the batch is known then, and every table keeps its files."""

    def step(state, token):
        return state + 1, f"{token} b - - {state} 1"

    store = updates.game_store(spark, str(tmp_path / "s"), 4)
    game = spark.range(6).select(F.col("id").alias("link"), F.lit(None).cast("boolean").alias("fens_done"))
    moves = spark.range(6).select(F.col("id").alias("link"), F.lit(1).alias("n_move"), F.lit("e4").alias("white_move"), F.concat(F.lit("d"), (F.col("id") % 2).cast("string")).alias("black_move"))
    store.commit("first", 0, {"game": Rows(game), "moves": Rows(moves)})
    assert updates.generate_positions(store, step, 0, "p", 0)
    assert told(store.read("game")) == [(i, True) for i in range(6)] and store.read("association").count() == 12
    assert told(store.read("fen").select("fen", "n_games")) == [("d0 b - -", 3), ("d1 b - -", 3), ("e4 b - -", 6)]
    before = store.snapshot()
    assert updates.generate_positions(store, step, 0, "p", 1) and store.applied("p") == 1
    assert store.snapshot().manifest["tables"] == before.manifest["tables"]


def test_new_games_meet_by_link_only(spark):
    """Whole rows are shuffled only where a link comes twice."""
    games = spark.range(100).select(F.col("id").alias("link"), F.lit("x").alias("mode"))
    alone = updates._new_games(games, games.limit(0))
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString() and alone.count() == 100
    assert updates._new_games(games.unionByName(games), games.where("link < 40")).count() == 60
