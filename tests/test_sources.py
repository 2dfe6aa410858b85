import json

from pyspark.sql import functions as F
from test_columns import PGN

from rookery.operators import positions, tables
from rookery.sources import archives, logs, upserts


def game(link, pgn=PGN, white=("Ann", "win"), black=("Bob", "resigned"), **more):
    return {"url": f"https://x/live/{link}", "pgn": pgn, "time_control": "180+2", "eco": "https://x/openings/C60", "white": {"username": white[0], "rating": 1500, "result": white[1]}, "black": {"username": black[0], "rating": 1600, "result": black[1]}} | more


def test_archives(spark, tmp_path):
    def put(player, month, text):
        d = tmp_path / f"player={player}/year=2024/month={month}"
        d.mkdir(parents=True)
        (d / "games.json").write_text(text)

    put("ann", 1, json.dumps({"games": [game(1), game(2, pgn=None), game(3, white=("Ann", "strange")), game(4, eco=None), game(1, white=("Zoe", "win"))]}))
    put("ann", 2, json.dumps({"games": None}))
    put("ann", 3, "{not json")
    put("bob", 1, json.dumps({"games": [game(5)]}).replace("Live", "Li\x01ve"))
    raw, broken = archives.read_archives(spark, str(tmp_path), repair=True)
    assert raw.count() == 6 and broken.count() == 1
    out = archives.ingest(raw)
    games = {r.link: r for r in out["game"].collect()}
    assert set(games) == {1, 4, 5}
    assert games[1].white == "zoe" and games[1].mode == "blitz" and games[1].avg_elo == 1550.0 and games[1].n_moves == 3
    assert games[4].eco == "no_eco" and games[1].eco == "C60"
    assert (games[1].white_result, games[1].black_result) == (1.0, 0.0)
    assert out["game_player"].count() == 6
    moves = {(r.link, r.n_move): r for r in out["moves"].collect()}
    assert moves[1, 3].black_move == "--" and moves[1, 1].white_time_left == 179.9
    assert moves[1, 1].white_reaction_time == 4.4 and moves[1, 3].white_reaction_time == 2.0
    assert out["game_opening"].count() == 0  # the third move lacks its second half
    months = {(r.player_name, r.year, r.month): r.n_games for r in out["months"].collect()}
    assert months == {("zoe", 2024, 2): 1, ("ann", 2024, 2): 2, ("bob", 2024, 2): 3}


def test_profiles_and_stats(spark):
    profile = spark.createDataFrame([(" Ann ", "A", "GM", 3, "https://x/country/DE", "17", "premium"), ("bob", None, None, None, None, "bad", None)], "username string, name string, title string, followers int, country string, joined string, status string")
    got = {r.player_name: r for r in archives.normalize_profile(profile).collect()}
    assert got["ann"].country == "DE" and got["ann"].joined == 17 and got["bob"].joined == 0
    text = '{"username": "Ann", "url": "u", "avatar": "a", "location": "Bonn", "is_streamer": true, "twitch_url": "t", "verified": false, "league": "Gold", "joined": "x", "country": "https://c/FR"}'
    full = archives.normalize_profile(spark.createDataFrame([(text,)], "t string").select(F.from_json("t", archives.PROFILE).alias("s")).select("s.*")).first()
    assert (full.url, full.avatar, full.location, full.is_streamer, full.twitch_url, full.verified, full.league, full.joined, full.country, full.name) == ("u", "a", "Bonn", True, "t", False, "Gold", 0, "FR", None)
    mode = "struct<last:struct<rating:int,percentile:double,percentage_rank:double>,best:struct<rating:int>,record:struct<game_count:int,win:int,loss:int,draw:int>>"
    text = json.dumps({"chess_blitz": {"last": {"rating": 1500, "percentile": 0.0, "percentage_rank": 88.5}, "best": {"rating": 1600}, "record": {"game_count": 5, "win": 2, "loss": 2, "draw": 1}}})
    stats = spark.createDataFrame([("ann", text)], "player_name string, t string").select("player_name", F.from_json("t", ", ".join(f"chess_{m} {mode}" for m in ("bullet", "blitz", "rapid"))).alias("s")).select("player_name", "s.*")
    row = archives.flatten_player_stats(stats).first()
    assert row.blitz_percentile == 88.5 and row.blitz_best == 1600 and row.bullet_rating is None and len(row) == 22


def test_logs(spark):
    text = "start\ndb cpu=1.5% mem=20MiB / 1GiB mem%=2.0 net=1kB / 2kB block=0B / 0B pids=3\ndb cpu=2.5% mem=1GiB / 1GiB mem%=4.0 pids=5\nnoise cpu\n"
    rows = spark.createDataFrame([(x,) for x in text.split("\n")], "value string")
    got = {(r.name, r.metric): (r.samples, r.low, r.mean, r.high) for r in logs.metrics_rollup(rows).collect()}
    assert got["db", "cpu_percent"] == (2, 1.5, 2.0, 2.5) and got["db", "mem_bytes"][3] == 2.0**30 and got["db", "pids"] == (2, 3.0, 4.0, 5.0)
    sensors = "coretemp-isa\nAdapter: ISA\nCore 0: +40.0°C (high)\nCore 1: +50.5°C\n\nnvme-pci\nAdapter: PCI\nComposite: +30.0°C\nCore 0: -1.5°C\ncoretemp-isa\nCore 0: +60.0°C\n"
    got = {(r.device, r.name): (r.samples, r.low, r.high) for r in logs.sectioned_metrics(spark.createDataFrame([("a", sensors)], "file string, value string")).collect()}
    assert got == {("coretemp-isa", "Core 0"): (2, 40.0, 60.0), ("coretemp-isa", "Core 1"): (1, 50.5, 50.5), ("nvme-pci", "Composite"): (1, 30.0, 30.0), ("nvme-pci", "Core 0"): (1, -1.5, -1.5)}


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_upserts(spark):
    old = spark.createDataFrame([(1, 10, ["a"]), (2, 20, ["b"])], "k int, n int, s array<string>")
    new = spark.createDataFrame([(2, 5, ["a", "b"]), (3, 7, [])], "k int, n int, s array<string>")
    assert rows(upserts.insert_ignore(old, new, ["k"]).select("k", "n")) == [(1, 10), (2, 20), (3, 7)]
    assert rows(upserts.upsert_replace(old, new, ["k"]).select("k", "n")) == [(1, 10), (2, 5), (3, 7)]
    assert rows(upserts.upsert_add(old, new, ["k"], ["n"], ["s"])) == [(1, 10, ["a"]), (2, 25, ["a", "b"]), (3, 7, [])]
    change = spark.createDataFrame([(1, None)], "k int, n int")
    assert rows(upserts.update_by_key(old, change, "k", ["n"]).select("k", "n")) == [(1, None), (2, 20)]
    assert rows(upserts.replace_keys(old, new, new, ["k"]).select("k", "n")) == [(1, 10), (2, 5), (3, 7)]
    assert rows(upserts.drop_orphans(old, new, "k").select("k")) == [(2,)]
    assert rows(upserts.drop_orphans(old, new, "k", spark.createDataFrame([(2,)], "k int")).select("k")) == [(1,), (2,)]
    incoming = spark.createDataFrame([(5, 1, 0), (5, 2, 1), (1, 3, 2)], "k int, n int, arrival int")
    assert rows(upserts.new_only(incoming, old, ["k"], "arrival")) == [(5, 2, 1)]


def test_payloads(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"a": 3}'), (2, "broken"), (3, None)], "k int, p string")
    assert rows(upserts.from_payload(df, "p", "a int", '{"a": -1}').select("k", "p.a")) == [(1, 3), (2, -1), (3, -1)]
    assert upserts.to_payload(df.where("k = 1"), ["k"]).first().payload == '{"k":1}'
    upserts.write_singleton(spark.range(1).select(F.lit(5).alias("n")), str(tmp_path / "s"))
    upserts.write_singleton(spark.range(1).select(F.lit(6).alias("n")), str(tmp_path / "s"))
    got = spark.read.parquet(str(tmp_path / "s")).collect()
    assert len(got) == 1 and got[0].n == 6 and got[0].id == 1 and got[0].refreshed_at
    upserts.append(df, str(tmp_path / "a"), ["k"])
    upserts.append(df, str(tmp_path / "a"), ["k"])
    assert spark.read.parquet(str(tmp_path / "a")).count() == 6


def test_filters_and_pages(spark):
    df = spark.range(25).select(F.col("id").alias("link"), (F.col("id") % 5).alias("r"))
    assert tables.rating_between(df, "r", 3, 1).count() == 15 and tables.rating_between(df, "r", None, 1).count() == 25
    assert [r.link for r in tables.paginate(df, [F.col("link")], 9, 10).collect()] == [20, 21, 22, 23, 24]
    assert tables.paginate(df, [F.col("link")], 9, 10, clamp=False).count() == 0
    assert tables.read_where(df, r=2, link=7).count() == 1 and tables.read_game(df, 3).count() == 1
    ranked = tables.global_rank(df.select((F.col("link") * 7 % 25).alias("v"), "link"), ["v", "link"], partitions=4)
    assert [r["rank"] for r in ranked.orderBy("v", "link").collect()] == list(range(1, 26))


def test_engine_output(spark):
    text = [
        ("a", True, 5.0, '[{"score": 30, "pv": ["e4", "e5"], "wdl": [1, 2, 3]}, {"score": 20, "pv": ["d4"]}, {"score": 10, "pv": []}]'),
        ("b", True, 6.0, '{"score": -9990, "pv": ["Qh5"], "tbhits": 4}'),
        ("c", False, 7.0, "[]"),
        ("d", True, None, "[]"),
    ]
    e = positions.read_evaluations(spark.createDataFrame(text, "fen string, is_valid boolean, elapsed_ms double, analysis string"))
    assert rows(positions.best_lines(e)) == [("a", 30.0, "e4 e5", 1.0, 2.0, 3.0), ("b", -9990.0, "Qh5", None, None, None)]
    assert rows(positions.continuations(e)) == [("a", 2, "d4", 20.0)]
    assert [r.fen for r in positions.timing_rows(e).collect()] == ["a"]
    scored = spark.createDataFrame([("a", "1", 0), ("a", "2", 1), (" ", "3", 2), ("b", "x", 3)], "fen string, score string, arrival int")
    assert rows(positions.clean_scored(scored).select("fen", "score")) == [("a", 1.0), ("b", 0.0)]


def test_fold_quarantines_whole_keys(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "!")], "k long, i int, t string")

    def step(state, token):
        if token == "!":
            raise ValueError("bad token")
        return state + token, state + token

    states, failed = positions.fold_sequences(df, "k", ["i"], "t", step, "")
    assert rows(states.select("key", "step", "state")) == [(1, 1, "a"), (1, 2, "ab")]
    assert rows(failed) == [(2, 2, "!", "ValueError: bad token")]
