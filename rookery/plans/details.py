"""Further queries: pages with totals, labels, groups, deltas, texts and JSON made from the tables. Registered with the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import deltas, games, joins, positions, tables
from ..operators import natural_breaks as nb
from ..sources import archives, logs, upserts
from ..streaming import jobs
from .adapters import Tables
from .catalogue import _BREAKS, _when, query

# Pages with totals


@query(
    """, f AS (SELECT opening, count(*) AS n, avg(avg_elo) AS mean_elo FROM opening WHERE n_moves = 3 GROUP BY opening), s AS (SELECT count(*) AS total FROM f)
SELECT opening, n, mean_elo, total, CAST(2 AS INT) AS page, CAST(ceil(total / 7.0) AS INT) AS pages FROM (SELECT * FROM f ORDER BY n DESC, opening LIMIT 7 OFFSET 7), s""",
    "opening",
)
def openings_with_total(t: Tables) -> DataFrame:
    return games.openings_page(t.opening, 3, page=2, size=7)


@query(
    """, f AS (SELECT fen, n_games, score, n_games * abs(score) AS impact FROM fen WHERE abs(score) >= 300), s AS (SELECT count(*) AS total FROM f)
SELECT fen, n_games, score, impact, total, CAST(ceil(total / 50.0) AS INT) AS page, CAST(ceil(total / 50.0) AS INT) AS pages
FROM (SELECT *, row_number() OVER (ORDER BY impact DESC, n_games DESC, fen) AS place FROM f), s WHERE place > (ceil(total / 50.0) - 1) * 50""",
    "fen",
)
def last_scored_page(t: Tables) -> DataFrame:
    """Far past the end: the last page."""
    rows = tables.scored_min(t.fen, 300).select("fen", "n_games", "score", c.impact("n_games", "score").alias("impact"))
    return tables.page_with_total(rows, tables.scored_order("impact"), 10**4, 50)


@query(
    """SELECT link, color, strftime(stamp, '%Y-%m-%d %H:%M:%S') AS played_at, rating, total, CAST(1 AS INT) AS page, CAST(ceil(total / 5.0) AS INT) AS pages
FROM (SELECT link, color, played_at AS stamp, rating, count(*) OVER () AS total FROM gp WHERE player_name = 4) ORDER BY stamp DESC, link DESC, color LIMIT 5""",
    "gp",
)
def player_games_with_total(t: Tables) -> DataFrame:
    rows = t.gp.where("player_name = 4").select("link", "color", "played_at", "rating")
    order = [F.col("played_at").desc_nulls_last(), F.col("link").desc(), F.col("color")]
    return _when(tables.page_with_total(rows, order, 1, 5), "played_at")


@query("SELECT link, total_positions FROM (SELECT * FROM gas JOIN game USING (link) ORDER BY played_at DESC, link DESC LIMIT 30)", "gas", "game")
def recent_coverage(t: Tables) -> DataFrame:
    gas = positions.game_analysis_summary(t.association, t.fen).join(t.game.select("link", "played_at"), "link")
    return positions.coverage_page(gas, tables.coverage_order("recent"), 1, 30).select("link", "total_positions")


@query("SELECT link, avg_abs_score FROM gas ORDER BY avg_abs_score DESC NULLS LAST, link DESC LIMIT 30", "gas")
def advantage_coverage(t: Tables) -> DataFrame:
    gas = positions.game_analysis_summary(t.association, t.fen)
    return positions.coverage_page(gas, tables.coverage_order("advantage"), 1, 30).select("link", "avg_abs_score")


@query(
    """, c AS (SELECT n_move, white_move AS move, count(*) AS n FROM moves JOIN game USING (link) WHERE n_move BETWEEN 4 AND 6 AND white_move NOT IN ('', '--') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY n_move ORDER BY n DESC, move) AS place FROM c)
SELECT CAST(k.range AS INT) AS n_move, coalesce(move, '-') AS move, coalesce(n, 0) AS n, CAST(10 AS INT) AS total, CAST(2 AS INT) AS page, CAST(4 AS INT) AS pages FROM range(4, 7) k LEFT JOIN r ON r.n_move = k.range AND place = 1""",
    "moves",
    "game",
)
def top_moves_with_total(t: Tables) -> DataFrame:
    return games.top_moves_page(t.moves, t.game, page=2, size=3)


@query("SELECT n_moves, opening, count(*) AS n, CAST(sum(avg_elo) AS DOUBLE) AS elo_sum, count(avg_elo) AS rated FROM opening GROUP BY ALL", "opening")
def opening_counts(t: Tables) -> DataFrame:
    return positions.opening_counts(t.moves, t.game)


@query("SELECT fen_fen, game_link, n_move, score FROM association JOIN fen ON fen = fen_fen", "association", "fen")
def split_edges(t: Tables) -> DataFrame:
    """Edges with their positions' scores; frequent positions are met on the map side, whatever the size here."""
    table = t.fen.select(F.col("fen").alias("fen_fen"), "score")
    return joins.skew_join(t.association, table, "fen_fen", large=0).select("fen_fen", "game_link", "n_move", "score")


@query("SELECT 'p' || c_custkey AS player_name, c_name AS name, 'u/' || c_custkey AS url, CASE WHEN c_custkey % 2 = 0 THEN 'GM' END AS title, CAST(c_nationkey AS INT) AS followers, CAST(c_nationkey AS VARCHAR) AS country, c_mktsegment AS location, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey END AS joined, c_custkey % 5 = 0 AS is_streamer, c_custkey % 7 = 0 AS verified, 'L' || c_nationkey AS league FROM customer")
def player_profiles(t: Tables) -> DataFrame:
    """Profiles as JSON, made from customers and read again."""
    key, text = F.col("c_custkey"), lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    fields = {
        "username": text(" P", key.cast("string"), " "),
        "name": F.col("c_name"),
        "url": text("u/", key.cast("string")),
        "title": F.when(key % 2 == 0, "GM"),
        "followers": F.col("c_nationkey").cast("int"),
        "country": text("https://example.org/country/", F.col("c_nationkey").cast("string")),
        "location": F.col("c_mktsegment"),
        "joined": F.when(key % 3 == 0, "never").otherwise(key.cast("string")),
        "is_streamer": key % 5 == 0,
        "verified": key % 7 == 0,
        "league": text("L", F.col("c_nationkey").cast("string")),
    }
    raw = t.raw("customer").select(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("t"))
    rows = archives.normalize_profile(raw.select(F.from_json("t", archives.PROFILE).alias("s")).select("s.*"))
    return rows.select("player_name", "name", "url", "title", "followers", "country", "location", "joined", "is_streamer", "verified", "league")


# Labels, groups and sums


@query(
    "SELECT s.player_name, name, n_games, last_rating, (wins + draws / 2.0) / n_games AS score_rate FROM (SELECT * FROM summary WHERE mode = 'rapid' ORDER BY last_rating DESC, n_games DESC, player_name LIMIT 40) s LEFT JOIN player USING (player_name)",
    "summary",
)
def labelled_leaderboard(t: Tables) -> DataFrame:
    top = games.top_main_characters(games.main_mode_summary(t.gp, t.player), "rapid", 40)
    return games.labelled(top, t.player).select("player_name", "name", "n_games", "last_rating", "score_rate")


@query(
    ", rapid AS (SELECT rating FROM gp WHERE mode = 'rapid')" + _BREAKS.format(value="rating", source="rapid") + "SELECT value AS rating, n, CAST(class AS INT) AS class, low, high FROM h JOIN breaks ON value BETWEEN low AND high",
    "gp",
)
def rating_chart_groups(t: Tables) -> DataFrame:
    return games.rating_chart(t.gp, "rapid")


@query("SELECT player_name, count(*) AS games, avg(rating) AS avg_rating, avg(opponent_rating) AS avg_opponent_rating, avg(n_moves) AS avg_moves, avg(time_elapsed) AS avg_seconds FROM gp GROUP BY player_name", "gp")
def player_averages(t: Tables) -> DataFrame:
    return games.player_averages(t.gp)


@query(
    "SELECT count(*) AS games, count(*) FILTER (result = 1) AS win, count(*) FILTER (result = 0.5) AS draw, count(*) FILTER (result = 0) AS loss, count(*) FILTER (result IS NULL OR result NOT IN (0, 0.5, 1)) AS unknown FROM gp WHERE player_name = 4 AND mode = 'bullet' AND played_at >= TIMESTAMP '1996-01-01'",
    "gp",
)
def mode_games_summary(t: Tables) -> DataFrame:
    return games.label_counts(games.player_mode_games(t.gp, 4, "bullet", "1996-01-01"))


@query("SELECT count(*) AS games, CAST(sum(total_positions) AS BIGINT) AS positions, CAST(sum(analyzed_positions) AS BIGINT) AS analyzed, CAST(sum(unscored_positions) AS BIGINT) AS unscored FROM gas WHERE total_positions > 0", "gas")
def coverage_sums(t: Tables) -> DataFrame:
    return positions.coverage_sums(positions.game_analysis_summary(t.association, t.fen))


@query(
    ", rows AS (SELECT link, CAST(round(avg_elo) AS INT) AS rating, avg_elo, avg_abs_score FROM gas JOIN game USING (link) WHERE is_fully_analyzed)"
    + _BREAKS.format(value="rating", source="rows")
    + "SELECT link, avg_elo AS rating, avg_abs_score, row_number() OVER (ORDER BY avg_elo, link) AS rank, CASE class WHEN 0 THEN 'bad' WHEN 1 THEN 'medium' ELSE 'great' END AS label FROM rows JOIN breaks ON rows.rating BETWEEN low AND high",
    "gas",
    "game",
)
def ranked_groups(t: Tables) -> DataFrame:
    return positions.ranked_groups(t.game, positions.game_analysis_summary(t.association, t.fen)).select("link", "rating", "avg_abs_score", "rank", "label")


@query("SELECT CAST(sum(n_games) AS BIGINT) AS sum_n_games FROM (SELECT n_games FROM fen ORDER BY n_games DESC, fen LIMIT 500)", "fen")
def sum_of_top_positions(t: Tables) -> DataFrame:
    return positions.sum_n_games(positions.top_fens(t.fen, 500), -1)


@query("SELECT game_link, fen_fen, n_move FROM association WHERE fen_fen IN (SELECT fen FROM fen WHERE score IS NULL ORDER BY n_games DESC, fen LIMIT 25)", "association", "fen")
def edges_of_top_positions(t: Tables) -> DataFrame:
    return positions.edges_of_top(t.association, t.fen, 25, unscored=True).select("game_link", "fen_fen", "n_move")


# Deltas


@query("SELECT count(*) AS games, count(*) FILTER (mode = 'bullet') AS bullet_games, count(*) FILTER (mode = 'blitz') AS blitz_games, count(*) FILTER (mode = 'rapid') AS rapid_games, (SELECT count(*) FILTER (coalesce(joined, 0) <> 0) FROM player) AS main_players, (SELECT count(*) FILTER (coalesce(joined, 0) = 0) FROM player) AS secondary_players, (SELECT count(*) FROM fen) AS positions, (SELECT count(score) FROM fen) AS scored_positions, (SELECT count(*) - count(score) FROM fen) AS unscored_positions, (SELECT count(*) FILTER (score <> 0) FROM fen) AS nonzero_positions FROM game", "game", "player", "fen")
def merged_database_totals(t: Tables) -> DataFrame:
    """Totals of a part, and the delta of the rest: the same as totals of all."""
    some, rest = (games.database_summary(t.game.where(f"link % 3 {op} 0"), t.player.where(f"player_name % 3 {op} 0"), t.fen.where(f"fen % 3 {op} 0")) for op in ("=", "<>"))
    return deltas.merge_totals(some, rest)


@query("SELECT CAST(0 AS BIGINT) AS unscored_positions, count(*) AS positions FROM fen", "fen")
def floored_totals(t: Tables) -> DataFrame:
    """More scores arrive than positions are known to lack: the count stays at 0."""
    known = t.fen.agg(F.count("*").alias("positions"), F.lit(3).cast("long").alias("unscored_positions"))
    delta = t.fen.agg(F.lit(0).cast("long").alias("positions"), (-F.count("score")).alias("unscored_positions"))
    return deltas.merge_counts(known, delta, ["positions", "unscored_positions"])


@query(
    """SELECT d.bucket, count(score) AS positions, CAST(coalesce(sum(n_games), 0) AS BIGINT) AS appearances, coalesce(sum(abs(score)), 0.0) AS abs_score_sum FROM (VALUES ('equal', 0, 50), ('small', 50, 150), ('clear', 150, 300), ('decisive', 300, 9000), ('mate', 9000, 1000000)) d(bucket, lo, hi)
LEFT JOIN fen ON abs(score) >= lo AND abs(score) < hi GROUP BY d.bucket""",
    "fen",
)
def merged_scored_buckets(t: Tables) -> DataFrame:
    """Scores that arrive without counts of games: those are looked up, and unknown positions vanish."""
    scored = t.fen.where("fen % 4 = 1 AND score IS NOT NULL").select("fen", "score")
    strange = t.fen.where("fen % 50 = 2").select((-F.col("fen")).alias("fen"), F.lit(10.0).alias("score"))
    delta = positions.scored_position_summary(positions.with_n_games(scored.unionByName(strange), t.fen))
    return deltas.merge_keyed(positions.scored_position_summary(t.fen.where("fen % 4 <> 1")), delta, ["bucket"], ["positions", "appearances", "abs_score_sum"])


# Upserts


@query("SELECT link, min(white_elo) AS white_elo FROM (SELECT link, white_elo FROM game WHERE link % 2 = 0 UNION ALL SELECT link, white_elo FROM game WHERE link % 2 = 1) GROUP BY link", "game")
def inserted_rows(t: Tables) -> DataFrame:
    rows = t.game.select("link", "white_elo")
    return upserts.insert_ignore(rows.where("link % 2 = 0"), rows.withColumn("white_elo", F.col("white_elo") + F.when(F.col("link") % 2 == 0, 7).otherwise(0)), ["link"])


@query("SELECT game_link, fen_fen, n_move + CASE WHEN game_link % 5 = 0 THEN 100 ELSE 0 END AS n_move FROM association WHERE game_link % 5 > 0 OR n_move < 3", "association")
def replaced_keys(t: Tables) -> DataFrame:
    rows = t.association.select("game_link", "fen_fen", "n_move")
    new = rows.where("game_link % 5 = 0 AND n_move < 3").withColumn("n_move", F.col("n_move") + 100)
    return upserts.replace_keys(rows, new, rows.where("game_link % 5 = 0").select("game_link"), ["game_link"])


@query("SELECT link, total_positions FROM gas WHERE link NOT IN (SELECT link FROM game WHERE link % 6 = 0)", "gas", "game")
def scoped_orphans_dropped(t: Tables) -> DataFrame:
    gas = positions.game_analysis_summary(t.association, t.fen).select("link", "total_positions")
    return upserts.drop_orphans(gas, t.game.where("link % 6 > 0"), "link", t.game.where("link % 3 = 0").select("link"))


@query("SELECT fen, n_games, CAST(NULL AS DOUBLE) AS score FROM fen", "fen")
def cleared_scores(t: Tables) -> DataFrame:
    return upserts.clear_scores(t.fen.select("fen", "n_games", "score"))


@query("SELECT link, mode, white FROM game WHERE mode = 'rapid' AND fens_done", "game")
def equal_rows(t: Tables) -> DataFrame:
    return tables.read_where(t.game, mode="rapid", fens_done=True).select("link", "mode", "white")


@query("SELECT link, white, black FROM game WHERE link = 7", "game")
def one_game(t: Tables) -> DataFrame:
    return tables.read_game(t.game, 7).select("link", "white", "black")


@query("SELECT fen, score FROM (SELECT fen, CASE WHEN fen % 4 = 0 THEN 0.0 ELSE CAST(fen % 1000 AS DOUBLE) END AS score FROM fen)", "fen")
def cleaned_scores(t: Tables) -> DataFrame:
    """Each position arrives twice, some with scores that can't be read, and blank keys among them."""
    text = F.when(F.col("fen") % 4 == 0, "bad").otherwise((F.col("fen") % 1000).cast("string"))
    first = t.fen.select(F.col("fen").cast("string").alias("fen"), text.alias("score"), F.lit(0).alias("arrival"))
    again = first.select("fen", F.lit("-1").alias("score"), F.lit(1).alias("arrival"))
    blank = first.select(F.lit(" ").alias("fen"), "score", "arrival")
    return positions.clean_scored(first.unionByName(again).unionByName(blank)).select(F.col("fen").cast("long").alias("fen"), "score")


@query("SELECT l_orderkey AS link, l_linenumber AS n, CAST(l_partkey AS BIGINT) AS part FROM lineitem ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC LIMIT 10")
def newest_rows(t: Tables) -> DataFrame:
    rows = t.raw("lineitem").select(F.col("l_orderkey").alias("link"), F.col("l_linenumber").alias("n"), F.col("l_partkey").cast("long").alias("part"))
    return jobs.newest(rows.withColumn("id", F.col("n").cast("long") * 10**9 + F.col("part")), 10, "link", "id").select("link", "n", "part")


# Scalars over columns


@query(
    """SELECT o_orderkey AS link, strftime(make_timestamp(1990 + o_orderkey % 20, 1 + o_orderkey % 12, 1 + o_orderkey % 28, o_orderkey % 24, o_orderkey % 60, CAST(o_orderkey % 60 AS DOUBLE)), '%Y-%m-%d %H:%M:%S') AS at,
(o_custkey + o_orderkey) / 2.0 AS mean, nullif(lower(trim(CASE WHEN o_custkey % 9 = 0 THEN '  ' ELSE ' ' || o_orderpriority || ' ' END)), '') AS name, CAST(o_orderkey AS BIGINT) AS id,
CAST(CASE o_custkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 END AS DOUBLE) AS points, upper(strftime(o_orderdate, '%Y-%b-%d')) AS day, strftime(CAST(to_timestamp(o_orderkey * 86400 % 1000000000) AS DATE), '%Y-%m-%d') AS since FROM orders"""
)
def scalar_fields(t: Tables) -> DataFrame:
    key, part = F.col("o_orderkey"), lambda n: (F.col("o_orderkey") % n).cast("int")
    rows = t.raw("orders").withColumns({"y": part(20) + 1990, "mo": part(12) + 1, "d": part(28) + 1, "h": part(24), "mi": part(60), "s": part(60)})
    name = F.when(F.col("o_custkey") % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))
    word = F.get(F.array(*[F.lit(x) for x in ("Win", "agreed", " resigned", "strange")]), (F.col("o_custkey") % 4).cast("int"))
    return rows.select(
        key.alias("link"),
        F.date_format(c.played_at("y", "mo", "d", "h", "mi", "s"), "yyyy-MM-dd HH:mm:ss").alias("at"),
        c.mean_rating("o_custkey", "o_orderkey").alias("mean"),
        c.canonical(name).alias("name"),
        c.id_from_url(F.concat(F.lit("https://host/live/"), key.cast("string"))).alias("id"),
        c.points_of(word).alias("points"),
        c.day_label("o_orderdate").alias("day"),
        F.date_format(c.from_epoch(key * 86400 % 1000000000), "yyyy-MM-dd").alias("since"),
    )


# Game texts, written from orders and their lines and taken apart again


def _texts(t: Tables) -> DataFrame:
    """link and pgn: headers, and a move with clocks for each line of an order."""
    piece = lambda color, tick: F.concat(F.lit(f" {color}"), F.col("l_partkey").cast("string"), F.lit(" {[%clk 0:"), (F.col("n") + tick).cast("string"), F.lit(":"), (F.col("l_suppkey") % 60).cast("string"), F.lit(".5]}"))
    lines = t.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").alias("n")).repartition("l_orderkey")  # numbers are shuffled, texts aren't
    move = F.concat(F.col("n").cast("string"), F.lit("."), piece("w", 1), F.lit(" "), F.col("n").cast("string"), F.lit("..."), piece("b", 2))
    moves = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "l_partkey", "l_suppkey", move.alias("m")))), lambda x: x["m"]), " ").alias("moves"))
    day = F.date_format("o_orderdate", "yyyy.MM.dd")
    end = F.when(F.col("o_orderkey") % 5 == 0, "bad").otherwise(F.lit("00:20:00"))
    head = F.concat(F.lit('[Event "Live"]\n[UTCDate "1900.01.01"]\n[Date "'), day, F.lit('"]\n[StartTime "00:10:00"]\n[EndDate "'), day, F.lit('"]\n[EndTime "'), end, F.lit('"]\n\n'))
    orders = t.raw("orders").select("o_orderkey", head.alias("head"))
    return orders.join(moves, orders["o_orderkey"] == moves["l_orderkey"]).select(F.col("o_orderkey").alias("link"), F.concat("head", "moves", F.lit(" 1-0")).alias("pgn"))


@query(
    """SELECT o_orderkey AS link, strftime(o_orderdate, '%Y.%m.%d') AS day, strftime(o_orderdate + INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S') AS at, CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE 600.0 END::DOUBLE AS seconds, n AS n_moves, CAST(2 * k AS INT) AS tokens
FROM orders JOIN (SELECT l_orderkey, CAST(max(l_linenumber) AS INT) AS n, count(*) AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
)
def game_text_headers(t: Tables) -> DataFrame:
    rows = _texts(t)
    return rows.select(
        "link",
        c.header("pgn", "Date").alias("day"),
        F.date_format(c.header_time("pgn", "Date", "StartTime"), "yyyy-MM-dd HH:mm:ss").alias("at"),
        c.elapsed_seconds("pgn").alias("seconds"),
        c.move_count("pgn").alias("n_moves"),
        F.size(c.move_tokens("pgn")).alias("tokens"),
    )


@query(
    """SELECT l_orderkey AS link, CAST(row_number() OVER w AS INT) AS n_move, 'w' || l_partkey AS white, 'b' || l_partkey AS black, (l_linenumber + 1) * 60 + l_suppkey % 60 + 0.5::DOUBLE AS white_clock, (l_linenumber + 2) * 60 + l_suppkey % 60 + 0.5::DOUBLE AS black_clock
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)"""
)
def game_text_moves(t: Tables) -> DataFrame:
    told = _texts(t).select("link", c.paired_moves(c.move_tokens("pgn")).alias("pairs"), c.clock_seconds("pgn").alias("clocks"))  # once a game, not once a move
    rows = told.select("link", F.explode("pairs").alias("m"), "clocks")
    clock = lambda k: F.get("clocks", 2 * F.col("m.n_move") - k)
    return rows.select("link", "m.n_move", "m.white", "m.black", clock(2).alias("white_clock"), clock(1).alias("black_clock"))


@query(
    """SELECT p_partkey AS fen, CAST(p_size * 10 - 200 AS DOUBLE) AS score, 'a' || p_size || ' b' AS next_moves, CAST(p_partkey % 3 AS DOUBLE) AS wdl_win, CAST(1 AS DOUBLE) AS wdl_draw, CAST(2 AS DOUBLE) AS wdl_loss FROM part WHERE p_partkey % 10 > 0"""
)
def engine_best_lines(t: Tables) -> DataFrame:
    return positions.best_lines(_answers(t)).select(F.col("fen").cast("int").alias("fen"), "score", "next_moves", "wdl_win", "wdl_draw", "wdl_loss").withColumn("fen", F.col("fen").cast(t.raw("part").schema["p_partkey"].dataType))


@query("SELECT p_partkey AS fen, CAST(2 AS INT) AS rank, 'c' AS move, CAST(p_size AS DOUBLE) AS score FROM part WHERE p_partkey % 10 > 0 AND p_partkey % 2 = 0")
def engine_continuations(t: Tables) -> DataFrame:
    return positions.continuations(_answers(t))


@query("SELECT p_partkey AS fen, CAST(p_size AS DOUBLE) AS elapsed_ms FROM part WHERE p_partkey % 10 > 0 AND p_partkey % 3 > 0")
def engine_timing_rows(t: Tables) -> DataFrame:
    return positions.timing_rows(_answers(t)).select("fen", "elapsed_ms")


def _answers(t: Tables) -> DataFrame:
    """An engine's answers about parts: a list of two lines, or a single one; some from a tablebase, some invalid."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    hits = F.when(key % 3 == 0, F.lit(', "tbhits": 4')).otherwise(F.lit(""))
    one = F.concat(F.lit('{"score": '), (F.col("p_size") * 10 - 200).cast("string"), F.lit(', "pv": ["a'), size, F.lit('", "b"], "wdl": ['), (key % 3).cast("string"), F.lit(", 1, 2]"), hits, F.lit("}"))
    two = F.concat(F.lit("["), one, F.lit(', {"score": '), size, F.lit(', "pv": ["c"]}]'))
    rows = t.raw("part").select(key.alias("fen"), (key % 10 > 0).alias("is_valid"), F.col("p_size").cast("double").alias("elapsed_ms"), F.when(key % 2 == 0, two).otherwise(one).alias("analysis"))
    return positions.read_evaluations(rows)


@query(
    """SELECT name, metric, count(*) AS samples, min(v) AS low, max(v) AS high FROM (SELECT l_linestatus AS name, unnest(['cpu_percent', 'net_in_bytes', 'net_out_bytes', 'block_in_bytes', 'block_out_bytes']) AS metric,
unnest([CAST(l_linenumber AS DOUBLE), l_partkey * 1000.0, l_suppkey * 1000000.0, CAST(l_linenumber AS DOUBLE), l_partkey * 1024.0]) AS v FROM lineitem) GROUP BY ALL"""
)
def log_traffic(t: Tables) -> DataFrame:
    text = lambda n: F.col(n).cast("string")
    line = F.concat(text("l_linestatus"), F.lit(" cpu="), text("l_linenumber"), F.lit("% net="), text("l_partkey"), F.lit("kB / "), text("l_suppkey"), F.lit("MB block="), text("l_linenumber"), F.lit("B / "), text("l_partkey"), F.lit("KiB"))
    return logs.metrics_rollup(t.raw("lineitem").select(line.alias("value"))).drop("mean")


@query("SELECT c_custkey AS player_name, CAST(c_nationkey AS INT) AS fide, CAST(c_nationkey * 10 AS INT) AS puzzle_rush_best, CAST(c_nationkey + 1 AS INT) AS tactics_highest, CAST(c_nationkey - 1 AS INT) AS tactics_lowest FROM customer")
def player_other_stats(t: Tables) -> DataFrame:
    nation = F.col("c_nationkey").cast("int")
    tactics = F.struct(F.struct((nation + 1).alias("rating")).alias("highest"), F.struct((nation - 1).alias("rating")).alias("lowest"))
    rush = F.struct(F.struct((nation * 10).alias("score")).alias("best"))
    return archives.flatten_other_stats(t.raw("customer").select(F.col("c_custkey").alias("player_name"), nation.alias("fide"), rush.alias("puzzle_rush"), tactics.alias("tactics")))


# Samples and sweeps


@query("SELECT link, white FROM (SELECT link, white FROM game ORDER BY md5('42:' || link), link LIMIT 100)", "game")
def digest_sample(t: Tables) -> DataFrame:
    return tables.sample_by_digest(t.game.select("link", "white"), 100, "link")


@query(
    _BREAKS.format(value="black_elo", source="game")
    + ", total AS (SELECT sum(CAST(n AS DOUBLE) * value * value) - sum(CAST(n AS DOUBLE) * value) * sum(CAST(n AS DOUBLE) * value) / sum(CAST(n AS DOUBLE)) AS x FROM h) SELECT round(1 - max(cost) / max(x), 9) AS gvf FROM breaks, total",
    "game",
)
def breaks_goodness(t: Tables) -> DataFrame:
    hist = t.game.groupBy(F.col("black_elo").alias("value")).agg(F.count("*").alias("n"))
    return nb.goodness(hist, nb.natural_breaks(hist, 3)).select(F.round("gvf", 9).alias("gvf"))


# Prefixes


@query(
    """, p AS (SELECT link, n_move, row_number() OVER (PARTITION BY link ORDER BY n_move) AS step, white_move || '/' || black_move AS token FROM moves),
d AS (SELECT link, step, md5(step || ':' || token) AS m FROM p)
SELECT link, CAST(step AS INT) AS step, (sum(CAST('0x' || substr(m, 1, 10) AS BIGINT)) OVER w) || '-' || (sum(CAST('0x' || substr(m, 11, 10) AS BIGINT)) OVER w) || '-' || (sum(CAST('0x' || substr(m, 21, 10) AS BIGINT)) OVER w) AS state FROM d WINDOW w AS (PARTITION BY link ORDER BY step)""",
    "moves",
)
def running_prefixes(t: Tables) -> DataFrame:
    """Prefix states of games in two parts: the second goes on from the first's last states."""
    rows = t.moves.select("link", "n_move", F.concat_ws("/", "white_move", "black_move").alias("token"))
    first = positions.running_keys(rows.where("n_move <= 3"), ["link"], ["n_move"], "token")
    last = first.groupBy("link").agg(F.max_by(F.struct("step", "state"), "step").alias("s")).select("link", "s.step", "s.state")
    return first.unionByName(positions.running_keys(rows.where("n_move > 3"), ["link"], ["n_move"], "token", last))
