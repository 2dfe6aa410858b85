"""Queries of sources and sinks: monthly archives written from orders and read game by game, streams, appends, one-row tables, lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import games, tables
from ..operators.storage import shared_folder, written
from ..sources import archive_reader, archives, layout, updates, upserts
from ..sources.store import Rows, Store
from ..streaming import jobs
from .adapters import Tables
from .catalogue import _when, query
from .details import _texts


def _folder(t: Tables, kind: str) -> str:
    return f"{shared_folder(t.spark)}/{kind}-{uuid.uuid4().hex}"


def _archive_lines(t: Tables) -> DataFrame:
    """player, year, month, link and JSON of each order with lines. Written, so that texts are made once."""
    side = lambda key, rating, word: F.struct(F.concat(F.lit("P"), key.cast("string")).alias("username"), rating.cast("int").alias("rating"), word.alias("result"))
    cust, link, status = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderstatus")
    word = lambda won, lost: F.when(status == won, "win").when(status == lost, "resigned").otherwise("agreed")
    game = F.struct(
        F.concat(F.lit("https://x/live/"), link.cast("string")).alias("url"),
        "pgn",
        F.lit("180+2").alias("time_control"),
        F.lit("https://x/openings/C60").alias("eco"),
        side(cust, link % 500, word("F", "O")).alias("white"),
        side(cust + 1, link % 300, word("O", "F")).alias("black"),
    )
    where = [F.concat(F.lit("u"), F.substring("o_orderpriority", 1, 1)).alias("player"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")]
    found = t.raw("orders").join(_texts(t), F.col("o_orderkey") == F.col("link"))
    return written(found.select(*where, "link", F.concat(F.lit(","), F.to_json(game)).alias("value")))


def _write_archives(lines: DataFrame, path: str) -> None:
    """An archive file for each priority and month of orders, a line for each game; the files of priority 1 in February lack their end."""
    lines = lines.withColumn("place", F.lit(1))
    months = lines.select("player", "year", "month").distinct()
    head = months.withColumns({"place": F.lit(0), "link": F.lit(0).cast("long"), "value": F.lit('{"games": [null')})
    tail = months.where("NOT (player = 'u1' AND month = 2)").withColumns({"place": F.lit(2), "link": F.lit(0).cast("long"), "value": F.lit("]}")})
    folder, keys = F.col("player"), ["player", "year", "month"]
    rows = lines.unionByName(head).unionByName(tail).repartition(folder, "year", "month").sortWithinPartitions(*keys, "place", "link")
    rows.select(*keys, "value").write.mode("append").partitionBy(*keys).option("compression", "gzip").text(path)


_GAMES = """SELECT o_orderkey AS link, 'p' || o_custkey AS white, 'p' || (o_custkey + 1) AS black, CAST(o_orderkey % 500 AS INT) AS white_elo, CAST(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 ELSE 0.5 END AS DOUBLE) AS white_result,
strftime(date_trunc('day', o_orderdate) + INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S') AS played_at, n_moves FROM orders JOIN (SELECT l_orderkey, CAST(max(l_linenumber) AS INT) AS n_moves FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
WHERE NOT (substr(o_orderpriority, 1, 1) = '1' AND month(o_orderdate) = 2)"""
_COLUMNS = ["link", "white", "black", "white_elo", "white_result", "played_at", "n_moves"]


@query(_GAMES)
def archived_games(t: Tables) -> DataFrame:
    """Games out of archive files, cut and parsed one at a time; months that end too early give none."""
    path = _folder(t, "archives")
    _write_archives(_archive_lines(t), path)
    rows, _ = archive_reader.opened(archive_reader.archive_rows(t.spark, path))
    return _when(archives.parsed_games(rows), "played_at").select(*_COLUMNS)


@query("SELECT DISTINCT 'u1' AS player, CAST(year(o_orderdate) AS INT) AS year, CAST(2 AS INT) AS month FROM orders WHERE substr(o_orderpriority, 1, 1) = '1' AND month(o_orderdate) = 2 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def broken_archives(t: Tables) -> DataFrame:
    path = _folder(t, "archives")
    _write_archives(_archive_lines(t), path)
    return archive_reader.opened(archive_reader.archive_rows(t.spark, path))[1].select("player", "year", "month")


@query(_GAMES)
def streamed_archives(t: Tables) -> DataFrame:
    """A stream of archive files into a store, in two runs: what came before isn't read again."""
    path, store = _folder(t, "archives"), updates.game_store(t.spark, _folder(t, "store"), 8)
    progress, lines = _folder(t, "progress"), _archive_lines(t)
    for part in ("month <= 6", "month > 6"):
        _write_archives(lines.where(part), path)
        jobs.run_once(archive_reader.stream_archives(t.spark, path, settle=0), updates.ArchiveBatches(store, "archives"), progress, "append")
    return _when(store.read("game"), "played_at").select(*_COLUMNS)


# Streams and sinks


@query("SELECT event_id, user_id, event_type FROM events")
def streamed_first(t: Tables) -> DataFrame:
    """Events that come twice, through a stream that keeps the first of each and appends it to a table."""
    source, sink = _folder(t, "source"), _folder(t, "sink")
    rows = t.raw("events").select("event_id", "user_id", "event_type", "ts")
    for _ in range(2):
        rows.write.mode("append").parquet(source)
    stream = jobs.first_of_each(jobs.stream_parquet(t.spark, source, "ts"), ["event_id"], "ts", "1 day")
    jobs.run_once(stream, lambda batch, _: upserts.append(batch, sink, ["event_id", "user_id", "event_type"]), _folder(t, "progress"), "append")
    return t.spark.read.parquet(sink)


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_activity(t: Tables) -> DataFrame:
    """Counts by window and kind of a stream in two runs; each window's last count replaces the one before."""
    source, progress = _folder(t, "source"), _folder(t, "progress")
    store = Store(t.spark, _folder(t, "windows"), {"activity": ["start", "event_type"]}, 4)

    def keep(batch: DataFrame, number: int) -> None:
        store.commit("activity", number, {"activity": Rows(batch, lambda old, new: upserts.upsert_replace(old, new, ["start", "event_type"]))})

    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        t.raw("events").where(part).select("event_id", "event_type", "ts").write.mode("append").parquet(source)
        jobs.run_once(jobs.activity(jobs.stream_parquet(t.spark, source, "ts"), "ts", "event_type", delay="3650 days"), keep, progress, "update")
    return store.read("activity").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT link, white, mode FROM game", "game")
def appended_rows(t: Tables) -> DataFrame:
    """Two appends of rows with more columns than the table has."""
    path = _folder(t, "append")
    for part in ("link % 2 = 0", "link % 2 = 1"):
        upserts.append(t.game.where(part), path, ["link", "white", "mode"])
    return t.spark.read.parquet(path)


@query("SELECT CAST(1 AS INT) AS id, count(*) FILTER (fens_done) AS done, count(*) FILTER (NOT coalesce(fens_done, false)) AS pending, true AS stamped FROM game", "game")
def singleton_row(t: Tables) -> DataFrame:
    """A one-row table that was written twice."""
    path = _folder(t, "singleton")
    for rows in (t.game.where("link % 2 = 0"), t.game):
        upserts.write_singleton(games.processing_counts(rows), path)
    return t.spark.read.parquet(path).select(F.col("id").cast("int").alias("id"), "done", "pending", F.col("refreshed_at").isNotNull().alias("stamped"))


@query("SELECT label, count(*) AS games FROM game JOIN (VALUES ('low', 0, 99), ('middle', 100, 199), ('high', 200, 100000)) r(label, low, high) ON white_elo BETWEEN low AND high GROUP BY label", "game")
def inline_ranges(t: Tables) -> DataFrame:
    ranges = tables.ranges_df(t.spark, [("low", 0, 99), ("middle", 100, 199), ("high", 200, 100000)], "label string, low int, high int")
    return t.game.join(ranges, F.col("white_elo").between(F.col("low"), F.col("high"))).groupBy("label").agg(F.count("*").alias("games"))


# Layouts for lookups


@query("SELECT link, white, black, mode FROM game WHERE link IN (1, 7, 4096, 7777, 123456789)", "game")
def looked_up_games(t: Tables) -> DataFrame:
    """A few games out of a table that lies by link."""
    path = _folder(t, "games")
    layout.write_games(t.game, path)
    return layout.lookup(t.spark, path, "link", [1, 7, 4096, 7777, 123456789, None]).select("link", "white", "black", "mode")


@query("SELECT link, color, player_name FROM gp WHERE link IN (3, 4097, 9000)", "gp")
def looked_up_sides(t: Tables) -> DataFrame:
    """Both sides of a few games out of a table that lies by player: by Bloom filters."""
    path = _folder(t, "sides")
    layout.write_player_games(t.gp, path, distinct=100_000)
    return layout.lookup(t.spark, path, "link", [3, 4097, 9000]).select("link", "color", "player_name")


@query("SELECT link, color, rating FROM gp WHERE player_name = 4 ORDER BY played_at DESC, link DESC, color DESC LIMIT 10", "gp")
def clustered_page(t: Tables) -> DataFrame:
    """A player's newest games out of the same layout."""
    path = _folder(t, "sides")
    layout.write_player_games(t.gp, path)
    rows = t.spark.read.parquet(path).where("player_name = 4")
    return tables.paginate(rows, [F.col("played_at").desc(), F.col("link").desc(), F.col("color").desc()], 1, 10).select("link", "color", "rating")
