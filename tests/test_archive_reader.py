import io
import json
import os
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_sources import game

from rookery.sources import archive_reader as ar
from rookery.sources import archives, updates
from rookery.streaming.jobs import run_once


class Slow(io.StringIO):
    """A text that comes a few characters at a time."""

    def read(self, size=-1):
        return super().read(min(size, 3) if size and size > 0 else size)


def games(text, **more):
    return list(ar.games_of(Slow(text), **more))


value = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.text(max_size=4), value, max_size=3), max_size=4), st.dictionaries(st.text(max_size=4).filter(lambda k: k != "games"), value, max_size=3), st.sampled_from([None, 1]), st.booleans())
def test_games_are_those_of_the_whole_text(rows, others, indent, ascii_only):
    text = json.dumps(others | {"games": rows} | {"z": 1}, indent=indent, ensure_ascii=ascii_only)
    assert [json.loads(g) for g in games(text)] == rows
    with pytest.raises(ar.Broken):
        games(text[: len(text) // 2])


@pytest.mark.parametrize("text", ["", "  ", "[]", "3", "{", '{"games": 5}', '{"games": [1]}', '{"games": [{}', '{"games": [{}]} x', '{"games": [{},]}', '{1: 2}', '{"a" 1}', '{"games": [{"a": "\x01"}]}', '{"games": ' + "[" * 100_000, "{not json"])
def test_broken_texts(text):
    with pytest.raises(ar.Broken):
        games(text)


def test_odd_but_whole_texts():
    assert games("{}") == games(' {"games": null} ') == games('{"games": []}') == games('{"other": [1, {"games": [{}]}]}') == []
    assert games('{"games": [null, {"a": 1}, null]}') == ['{"a": 1}']
    assert games('{"games": [{"a": "\x01"}]}', repair=True) == ['{"a": " "}']
    with pytest.raises(ar.Broken, match="too long"):
        list(ar.games_of(io.StringIO('{"games": [{"a": "' + "x" * 5_000_000), most=1_000_000))


def put(folder, player, month, text, age=5000):
    d = folder / f"player={player}/year=2024/month={month}"
    d.mkdir(parents=True, exist_ok=True)
    (d / "games.json").write_text(text)
    at = time.time() - age
    os.utime(d / "games.json", (at, at))


def rows(df):
    return sorted(map(repr, df.collect()))


def test_equals_whole_text_reader(spark, tmp_path):
    put(tmp_path, "ann", 1, json.dumps({"games": [game(1), game(2, pgn=None), game(3), None, game(1, white=("Zoe", "win"))]}))
    put(tmp_path, "ann", 2, json.dumps({"games": None}))
    put(tmp_path, "ann", 3, "{not json")
    put(tmp_path, "bob", 1, json.dumps({"games": [game(5)] * 3}).replace("Live", "Li\x01ve"))
    old, broken = archives.read_archives(spark, str(tmp_path), repair=True)
    for options in ({}, {"keep": 10}):  # kept while it is read, or read a second time
        new, bad = ar.opened(ar.archive_rows(spark, str(tmp_path), repair=True, **options))
        columns = [c for c in new.columns if c not in ("file", "arrival")]
        assert rows(new.select(*columns)) == rows(old.where("url IS NOT NULL").select(*[old[c].cast("string") if c == "player" else old[c] for c in columns]))
        assert bad.count() == broken.count() == 1
    assert ar.opened(ar.archive_rows(spark, str(tmp_path)))[1].count() == 2


def test_nothing_to_read(spark, tmp_path):
    assert ar.archive_rows(spark, str(tmp_path)).count() == 0


def test_streamed_job(spark, tmp_path):
    """Months come one after the other; each game is stored once, broken months go to quarantine, and a month that just changed waits."""
    source, place = tmp_path / "in", str(tmp_path / "store")
    put(source, "ann", 1, json.dumps({"games": [game(1), game(2)]}))
    put(source, "ann", 2, "{not json")
    store = updates.game_store(spark, place, 4)

    def run():
        run_once(ar.stream_archives(spark, str(source), settle=1000), updates.ArchiveBatches(store, "archives"), str(tmp_path / "progress"), "append")

    run()
    assert store.read("game").count() == 2 and store.read("broken_months").count() == 1
    put(source, "bob", 1, json.dumps({"games": [game(2), game(7)]}), age=3000)
    put(source, "bob", 2, json.dumps({"games": [game(8)]}), age=0)
    run()
    assert sorted(r.link for r in store.read("game").collect()) == [1, 2, 7]
    assert store.read("moves").count() == 3 * store.read("game").count() and store.read("broken_months").count() == 1
    run()
    assert store.read("game").count() == 3


def test_compressed_months_and_repeated_links(spark, tmp_path):
    """A link in two months: the last by file and place stays; texts that nobody asks for aren't shuffled."""
    import gzip

    game = lambda n, white: {"url": f"https://x/live/{n}", "pgn": '[Date "2024.01.02"]\n[StartTime "00:10:00"]\n\n1. e4 e5', "white": {"username": white, "rating": 1, "result": "win"}, "black": {"username": "b", "rating": 2, "result": "resigned"}}
    for month, games in ((1, [game(1, "old"), game(2, "x"), game(2, "y")]), (2, [game(1, "new")])):
        folder = tmp_path / f"player=p/year=2024/month={month}"
        folder.mkdir(parents=True)
        (folder / "m.txt.gz").write_bytes(gzip.compress(json.dumps({"games": games}).encode()))
    rows, broken = ar.opened(ar.archive_rows(spark, str(tmp_path)))
    parsed = archives.parsed_games(rows)
    assert sorted(map(tuple, parsed.select("link", "white").collect())) == [(1, "new"), (2, "y")] and broken.count() == 0
    exchanged = [x for x in parsed.select("link", "white")._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in x]
    assert exchanged and all("pgn" not in x for x in exchanged)


def test_a_game_is_parsed_once(spark):
    """Conditions and columns share what they are made of; moves need no shuffle."""
    rows, _ = ar.opened(spark.createDataFrame([("p", 2024, 1, "f", 0, json.dumps(game(1)), None)], ar.SCHEMA))
    parsed = archives.parsed_games(rows)
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and plan.count("\\[Date ") == 1
    assert "Exchange" not in archives.parsed_moves(rows.selectExpr("1L AS link", "pgn", "2D AS bonus"))._jdf.queryExecution().executedPlan().toString()


def test_a_long_month_is_read_once(tmp_path, monkeypatch):
    put(tmp_path, "ann", 1, json.dumps({"games": [game(i) for i in range(30)]}))
    reads, games = [], ar._Reads._games
    monkeypatch.setattr(ar._Reads, "_games", lambda self, *where: reads.append(where) or games(self, *where))
    reader = ar._Reads({"path": str(tmp_path), "keep": "1000"})
    batches = [b for task in ar._packed(reader.path, ar._listed(reader.path), 1) for b in reader.read(task)]
    assert [json.loads(g)["url"] for b in batches for g in b.column("game").to_pylist()] == [game(i)["url"] for i in range(30)]
    assert [i for b in batches for i in b.column("arrival").to_pylist()] == list(range(30)) and len(reads) == 1


def test_streamed_tables_equal_those_of_frames(spark, tmp_path):
    """Games of archives, dealt once, give what ingest_games gives: with links that come twice, are stored already, lack moves, and a game against oneself."""
    text = '[Date "2024.02.%02d"]\n[StartTime "00:10:00"]\n\n%s'
    moves = ["1. e4 {[%clk 0:02:59.9]} 1... e5 {[%clk 0:02:58]} 2. d4 d5 3. c4 {[%clk 0:01:00]} c5 4. a3 1-0", "1. e4 e5 2. -- d5 3. a3 a6 4. b3 b6", " ".join(f"{i}. a{i} b{i}" for i in range(1, 14)) + " 1/2-1/2", "*", ""]
    one = lambda i, who="b": game(i, pgn=text % (i % 9 + 1, moves[i % 5]), black=(who, "resigned"), white=(f"p{i % 4}", "win"))
    batches = [[one(i) for i in range(12)] + [one(3, "again"), one(4, "p0"), one(20, " ")], [one(i, "late") for i in range(8, 18)]]
    streamed, framed = (updates.game_store(spark, str(tmp_path / n), 4) for n in ("streamed", "framed"))
    for store in (streamed, framed):
        profiles = spark.createDataFrame([("p0", "A", 5), ("p1", None, 0)], "player_name string, name string, joined long")
        updates.store_profiles(store, profiles, profiles.select("player_name").limit(0), "p", 0)
    for number, games in enumerate(batches):
        batch = spark.createDataFrame([("x", 2024, 2, f"f{number}", i, json.dumps(g), None) for i, g in enumerate(games)], ar.SCHEMA)
        updates.ArchiveBatches(streamed, "a")(batch, number)
        parsed = archives.parsed_games(ar.opened(batch)[0])
        assert updates.ingest_games(framed, parsed.drop("pgn", "bonus"), archives.parsed_moves(parsed), "a", number)
    for name in ("game", "moves", "game_opening", "game_player", "months", "player", "main_mode_summary", "game_totals"):
        got, want = streamed.read(name), framed.read(name)
        assert set(got.columns) == set(want.columns) and rows(got.select(*want.columns)) == rows(want), name
    assert streamed.read("game").count() == 19 and rows(streamed.read("game").where("link IN (3, 9)").select("black")) == rows(spark.createDataFrame([("again",), ("b",)], "black string"))
    assert streamed.read("months").where("player_name = 'p0'").agg({"n_games": "sum"}).first()[0] == streamed.read("game_player").where("player_name = 'p0'").select("link").distinct().count()
