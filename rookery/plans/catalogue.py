"""All queries over the star-schema and event tables, and their SQL.

Every query runs an operator of the library over whole tables. Timestamps and dates leave as
text, so that results compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import deltas, games, positions, tables
from ..operators import natural_breaks as nb
from ..sources import logs, upserts
from .adapters import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_TIME = "yyyy-MM-dd HH:mm:ss"
ALL_MODES = ("bullet", "blitz", "rapid", "classical", "daily")


def query(sql: str | None = None, *needs: str):
    """Register a function of Tables, with SQL over the tables it needs."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_tables(sql, *needs)
        return f

    return add


def _when(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.date_format(n, _TIME) for n in names})


_T = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


# Moves and openings


@query(
    """, c AS (SELECT n_move, white_move AS move, count(*) AS n FROM moves JOIN game USING (link) WHERE n_move BETWEEN 1 AND 10 AND white_move NOT IN ('', '--') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY n_move ORDER BY n DESC, move) AS place FROM c)
SELECT CAST(k.range AS INT) AS n_move, coalesce(move, '-') AS move, coalesce(n, 0) AS n FROM range(1, 11) k LEFT JOIN r ON r.n_move = k.range AND place = 1""",
    "moves",
    "game",
)
def top_moves(t: Tables) -> DataFrame:
    return games.top_moves(t.moves, t.game)


@query(
    """, c AS (SELECT n_move, black_move AS move, count(*) AS n FROM moves JOIN game USING (link) WHERE mode = 'blitz' AND black_elo BETWEEN 100 AND 400 AND n_move BETWEEN 1 AND 12 AND black_move NOT IN ('', '--') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY n_move ORDER BY n DESC, move) AS place FROM c)
SELECT CAST(k.range AS INT) AS n_move, coalesce(move, '-') AS move, coalesce(n, 0) AS n FROM range(1, 13) k LEFT JOIN r ON r.n_move = k.range AND place = 1""",
    "moves",
    "game",
)
def top_moves_by_rating(t: Tables) -> DataFrame:
    return games.top_moves(t.moves, t.game, mode="blitz", color="black", low=400, high=100, max_move=12)


@query(
    """, c AS (SELECT n_move, white_move AS move, count(*) AS n FROM moves JOIN game USING (link) WHERE white = 7 AND n_move BETWEEN 1 AND 10 AND white_move NOT IN ('', '--') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY n_move ORDER BY n DESC, move) AS place FROM c)
SELECT CAST(k.range AS INT) AS n_move, coalesce(move, '-') AS move, coalesce(n, 0) AS n FROM range(1, 11) k LEFT JOIN r ON r.n_move = k.range AND place = 1""",
    "moves",
    "game",
)
def player_top_moves(t: Tables) -> DataFrame:
    return games.top_moves(t.moves, t.game, player=7)


@query("SELECT link, n_moves, opening FROM opening", "opening")
def opening_sequences(t: Tables) -> DataFrame:
    return t.opening.select("link", "n_moves", "opening")


@query("SELECT opening, count(*) AS n, avg(avg_elo) AS mean_elo FROM opening WHERE n_moves = 3 AND mode = 'rapid' GROUP BY opening ORDER BY n DESC, opening LIMIT 20", "opening")
def top_openings(t: Tables) -> DataFrame:
    return games.top_openings(t.opening, 3, "rapid")


@query("SELECT opening, count(*) AS n, avg(avg_elo) AS mean_elo FROM opening WHERE n_moves = 4 AND avg_elo BETWEEN 100 AND 300 GROUP BY opening ORDER BY n DESC, opening LIMIT 10 OFFSET 10", "opening")
def top_openings_page(t: Tables) -> DataFrame:
    return games.top_openings(t.opening, 4, None, 100, 300, page=2, size=10)


@query(
    """SELECT opening, count(*) AS n FROM opening WHERE n_moves = 3 AND link IN (SELECT link FROM gp WHERE player_name = 11 AND result = 1) GROUP BY opening ORDER BY n DESC, opening LIMIT 20""", "opening", "gp"
)
def player_openings(t: Tables) -> DataFrame:
    return games.player_openings(t.opening, t.gp, 11, "win")


@query("SELECT link, i + 1 AS place, p[2 * i + 1] AS white, p[2 * i + 2] AS black FROM (SELECT link, str_split(opening, ' ') AS p, CAST(unnest(range(n_moves)) AS INT) AS i FROM opening WHERE n_moves = 3)", "opening")
def opening_pairs(t: Tables) -> DataFrame:
    rows = t.opening.where("n_moves = 3").select("link", F.posexplode(games.opening_pairs("opening")).alias("i", "p"))
    return rows.select("link", (F.col("i") + 1).alias("place"), "p.white", "p.black")


@query("SELECT link, min(n_move) = 1 AND max(n_move) = count(*) AND count(DISTINCT n_move) = count(*) AS is_contiguous FROM (SELECT l_orderkey AS link, l_linenumber AS n_move FROM lineitem) GROUP BY link")
def contiguous_moves(t: Tables) -> DataFrame:
    return positions.contiguous(t.raw("lineitem").select(F.col("l_orderkey").alias("link"), F.col("l_linenumber").alias("n_move")))


@query("SELECT link, n_move, abs(coalesce(clock - lead(clock) OVER w, 0)) + 3.0 AS spent FROM (SELECT link, n_move, CAST((link * 31 + n_move * 17) % 600 AS DOUBLE) AS clock FROM moves) WINDOW w AS (PARTITION BY link ORDER BY n_move)", "moves")
def reaction_times(t: Tables) -> DataFrame:
    rows = t.moves.select("link", "n_move", ((F.col("link") * 31 + F.col("n_move") * 17) % 600).cast("double").alias("clock"))
    return positions.reaction_times(rows, "clock", F.lit(3.0), "spent").select("link", "n_move", "spent")


# Sequences


@query("SELECT user_id, CAST(week AS VARCHAR) AS week, string_agg(event_type, ' ' ORDER BY ts, event_id) AS tokens FROM sequences GROUP BY ALL", "sequences")
def ordered_sequences(t: Tables) -> DataFrame:
    rows = positions.ordered_tokens(t.sequences, ["user_id", "week"], ["ts", "event_id"], "event_type")
    return rows.select("user_id", F.col("week").cast("string").alias("week"), F.array_join("tokens", " ").alias("tokens"))


@query(
    """, s AS (SELECT user_id, week, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id, week ORDER BY ts, event_id) AS step FROM sequences)
SELECT user_id, CAST(week AS VARCHAR) AS week, CAST(step AS INT) AS step, sha256(string_agg(event_type, ' ') OVER (PARTITION BY user_id, week ORDER BY step)) AS state FROM s""",
    "sequences",
)
def prefix_states(t: Tables) -> DataFrame:
    rows = positions.ordered_tokens(t.sequences, ["user_id", "week"], ["ts", "event_id"], "event_type")
    return positions.prefix_keys(rows, ["user_id", "week"]).withColumn("week", F.col("week").cast("string"))


def _basket(state: dict, token: str) -> tuple[dict, str]:
    """A small user rule: counts of tokens so far."""
    state = state | {token: state.get(token, 0) + 1}
    return state, ",".join(f"{k}={state[k]}" for k in sorted(state))


@query(
    """SELECT event_id, user_id AS key, 'click=' || a || ',error=' || b || ',purchase=' || c || ',signup=' || d || ',view=' || e AS state FROM (
SELECT event_id, user_id, count(*) FILTER (event_type = 'click') OVER w AS a, count(*) FILTER (event_type = 'error') OVER w AS b, count(*) FILTER (event_type = 'purchase') OVER w AS c,
  count(*) FILTER (event_type = 'signup') OVER w AS d, count(*) FILTER (event_type = 'view') OVER w AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE a > 0 AND b > 0 AND c > 0 AND d > 0 AND e > 0"""
)
def folded_states(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    events = t.raw("events")
    states, _ = positions.fold_sequences(events, "user_id", ["ts", "event_id"], "event_type", _basket, {})
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    named = events.select("event_id", F.col("user_id").alias("key"), step.alias("step"))
    return states.where(F.size(F.split("state", ",")) == 5).join(named, ["key", "step"]).select("event_id", "key", "state")


# Summaries over games


@query(
    """SELECT (SELECT count(*) FROM game) AS games, (SELECT count(*) FILTER (mode = 'bullet') FROM game) AS bullet_games, (SELECT count(*) FILTER (mode = 'blitz') FROM game) AS blitz_games, (SELECT count(*) FILTER (mode = 'rapid') FROM game) AS rapid_games,
(SELECT count(*) FILTER (coalesce(joined, 0) <> 0) FROM player) AS main_players, (SELECT count(*) FILTER (coalesce(joined, 0) = 0) FROM player) AS secondary_players,
(SELECT count(*) FROM fen) AS positions, (SELECT count(score) FROM fen) AS scored_positions, (SELECT count(*) - count(score) FROM fen) AS unscored_positions, (SELECT count(*) FILTER (score <> 0) FROM fen) AS nonzero_positions""",
    "game",
    "player",
    "fen",
)
def database_summary(t: Tables) -> DataFrame:
    return games.database_summary(t.game, t.player, t.fen)


@query("SELECT mode, count(DISTINCT link) AS n_games FROM gp WHERE mode IN ('bullet', 'blitz', 'rapid') AND player_name IN (SELECT player_name FROM player WHERE coalesce(joined, 0) <> 0) GROUP BY mode", "gp", "player")
def main_mode_counts(t: Tables) -> DataFrame:
    return games.main_mode_counts(t.gp, t.player)


@query(f"SELECT * REPLACE ({_T.format('last_played_at')}) FROM summary", "summary")
def main_mode_summary(t: Tables) -> DataFrame:
    return _when(games.main_mode_summary(t.gp, t.player), "last_played_at")


@query(f"SELECT * REPLACE ({_T.format('last_played_at')}) FROM summary WHERE player_name % 10 = 3", "summary")
def affected_player_summary(t: Tables) -> DataFrame:
    batch = t.player.where("player_name % 10 = 3").select("player_name")
    return _when(deltas.affected(lambda rows: games.main_mode_summary(rows, t.player), t.gp, batch, ["player_name"]), "last_played_at")


@query(f"SELECT * REPLACE ({_T.format('last_played_at')}), (wins + draws / 2.0) / n_games AS score_rate FROM summary WHERE mode = 'blitz' ORDER BY last_rating DESC, n_games DESC, player_name LIMIT 50", "summary")
def top_main_characters(t: Tables) -> DataFrame:
    return _when(games.top_main_characters(games.main_mode_summary(t.gp, t.player), "blitz", 50), "last_played_at")


@query("SELECT rating, count(*) AS n FROM gp WHERE mode = 'bullet' GROUP BY rating", "gp")
def rating_chart(t: Tables) -> DataFrame:
    return games.rating_histogram(tables.require_mode(t.gp, "bullet"))


@query("SELECT *, (wins + draws / 2.0) / total AS score_rate FROM (SELECT color, count(*) AS total, count(*) FILTER (result = 1) AS wins, count(*) FILTER (result = 0.5) AS draws, count(*) FILTER (result = 0) AS losses FROM gp WHERE mode = 'rapid' AND rating BETWEEN 50 AND 400 GROUP BY color)", "gp")
def result_matrix(t: Tables) -> DataFrame:
    return games.result_matrix(tables.rating_between(tables.require_mode(t.gp, "rapid"), "rating", 50, 400))


@query(
    """SELECT count(*) AS games, avg(n_moves) AS avg_moves, quantile_cont(n_moves, 0.5) AS median_moves, quantile_cont(n_moves, 0.9) AS p90_moves, avg(time_elapsed) AS avg_seconds,
quantile_cont(time_elapsed / 60.0, 0.5) AS median_minutes, quantile_cont(time_elapsed / 60.0, 0.9) AS p90_minutes FROM game WHERE mode = 'blitz'""",
    "game",
)
def game_length(t: Tables) -> DataFrame:
    return games.game_length(tables.require_mode(t.game, "blitz"))


@query("SELECT CAST(n_moves // 10 * 10 AS BIGINT) AS low, CAST(n_moves // 10 * 10 + 9 AS BIGINT) AS high, count(*) AS n FROM game GROUP BY ALL", "game")
def moves_histogram(t: Tables) -> DataFrame:
    return games.moves_histogram(t.game)


@query(
    """SELECT CASE WHEN m < 1 THEN '0-1' WHEN m < 2 THEN '1-2' WHEN m < 3 THEN '2-3' WHEN m < 5 THEN '3-5' WHEN m < 10 THEN '5-10' WHEN m < 20 THEN '10-20' WHEN m < 40 THEN '20-40' ELSE '40+' END AS label,
CAST(CASE WHEN m < 1 THEN 1 WHEN m < 2 THEN 2 WHEN m < 3 THEN 3 WHEN m < 5 THEN 4 WHEN m < 10 THEN 5 WHEN m < 20 THEN 6 WHEN m < 40 THEN 7 ELSE 8 END AS INT) AS place, count(*) AS n FROM (SELECT time_elapsed / 60.0 AS m FROM game) GROUP BY ALL""",
    "game",
)
def minutes_histogram(t: Tables) -> DataFrame:
    return games.minutes_histogram(t.game)


@query("SELECT CAST(floor(time_elapsed / 60.0) AS BIGINT) AS low, CAST(floor(time_elapsed / 60.0) AS BIGINT) + 1 AS high, count(*) AS n FROM game WHERE white = 5 OR black = 5 GROUP BY ALL", "game")
def player_minute_bins(t: Tables) -> DataFrame:
    mine = t.gp.where("player_name = 5").select("link", "time_elapsed").distinct()
    return games.minute_bins(mine)


_HEAT = """SELECT d.unit, d.value, coalesce(n, 0) AS n FROM (
SELECT 'month' AS unit, CAST(range AS INT) AS value FROM range(1, 13) UNION ALL SELECT 'weekday', CAST(range AS INT) FROM range(0, 7) UNION ALL SELECT 'hour', CAST(range AS INT) FROM range(0, 24)) d
LEFT JOIN (SELECT 'month' AS unit, month(played_at) AS value, count(*) AS n FROM game GROUP BY ALL UNION ALL SELECT 'weekday', dayofweek(played_at), count(*) FROM game GROUP BY ALL
UNION ALL SELECT 'hour', hour(played_at), count(*) FROM game GROUP BY ALL) f USING (unit, value)"""


@query(_HEAT, "game")
def activity_heat(t: Tables) -> DataFrame:
    return games.activity_heat(t.game)


@query(
    """, g AS (SELECT * FROM gp WHERE player_name = 9)
SELECT 'month' AS unit, CAST(month(played_at) AS INT) AS value, count(*) AS n FROM g GROUP BY ALL UNION ALL SELECT 'weekday', CAST(dayofweek(played_at) AS INT), count(*) FROM g GROUP BY ALL UNION ALL SELECT 'hour', CAST(hour(played_at) AS INT), count(*) FROM g GROUP BY ALL""",
    "gp",
)
def player_activity(t: Tables) -> DataFrame:
    return games.activity_heat(t.gp.where("player_name = 9"), dense=False)


@query("SELECT player_name, color, count(*) AS games, count(*) FILTER (result = 1) AS wins, count(*) FILTER (result = 0) AS losses, count(*) FILTER (result = 0.5) AS draws, avg(rating) AS avg_rating, avg(n_moves) AS avg_moves FROM gp GROUP BY ALL", "gp")
def player_performance(t: Tables) -> DataFrame:
    return games.player_performance(t.gp)


@query("SELECT CASE WHEN white = 8 THEN white_str_result ELSE black_str_result END AS termination, count(*) AS n FROM game WHERE white = 8 OR black = 8 GROUP BY ALL", "game")
def player_terminations(t: Tables) -> DataFrame:
    return games.player_terminations(t.game, 8)


@query("SELECT eco, count(*) AS games, count(*) FILTER (result = 1) AS wins, count(*) FILTER (result = 0.5) AS draws, count(*) FILTER (result = 0) AS losses FROM gp WHERE eco <> 'no_eco' GROUP BY eco ORDER BY games DESC, eco LIMIT 10", "gp")
def top_eco(t: Tables) -> DataFrame:
    return games.top_eco(t.gp)


@query(
    f"""SELECT player_name, count(*) AS games, count(*) FILTER (result = 1) AS wins, count(*) FILTER (result = 0.5) AS draws, count(*) FILTER (result = 0) AS losses, strftime(min(played_at), '%Y-%m-%d %H:%M:%S') AS first_game, strftime(max(played_at), '%Y-%m-%d %H:%M:%S') AS last_game,
count(*) FILTER (mode = 'bullet') AS bullet_games, count(*) FILTER (mode = 'blitz') AS blitz_games, count(*) FILTER (mode = 'rapid') AS rapid_games FROM gp GROUP BY player_name""",
    "gp",
)
def player_summary(t: Tables) -> DataFrame:
    return _when(games.player_summary(t.gp), "first_game", "last_game")


@query(
    f"SELECT link, color, {_T.format('played_at')}, result, CASE WHEN result = 1 THEN 'win' WHEN result = 0.5 THEN 'draw' ELSE 'loss' END AS label FROM gp WHERE player_name = 4 AND mode = 'bullet' AND played_at >= TIMESTAMP '1996-01-01' AND played_at <= TIMESTAMP '2000-12-31'", "gp"
)
def player_mode_games(t: Tables) -> DataFrame:
    return _when(games.player_mode_games(t.gp, 4, "bullet", "1996-01-01", "2000-12-31"), "played_at").select("link", "color", "played_at", "result", "label")


@query(f"SELECT link, color, {_T.format('played_at')}, rating FROM (SELECT * FROM gp WHERE player_name = 4 ORDER BY played_at DESC, link DESC, color LIMIT 5 OFFSET 5)", "gp")
def player_games_page(t: Tables) -> DataFrame:
    return _when(games.player_games_page(t.gp, 4, 2, 5), "played_at").select("link", "color", "played_at", "rating")


@query(
    """SELECT player_name, sum(time_elapsed) / 3600.0 AS hours, coalesce(sum(time_elapsed) FILTER (mode = 'bullet'), 0.0) / 3600.0 AS bullet_hours, coalesce(sum(time_elapsed) FILTER (mode = 'blitz'), 0.0) / 3600.0 AS blitz_hours,
coalesce(sum(time_elapsed) FILTER (mode = 'rapid'), 0.0) / 3600.0 AS rapid_hours FROM gp GROUP BY player_name""",
    "gp",
)
def player_hours(t: Tables) -> DataFrame:
    return games.player_hours(t.gp)


@query(
    """SELECT player_name, mode, count(*) AS games, count(*) FILTER (result = 1) AS wins, count(*) FILTER (result = 0.5) AS draws, arg_min(rating, {'p': played_at, 'l': link, 'c': color}) AS oldest_rating,
arg_max(rating, {'p': played_at, 'l': link, 'c': color}) AS newest_rating, max(rating) AS best_rating, count(*) FILTER (result NOT IN (1, 0.5)) AS losses FROM gp GROUP BY ALL""",
    "gp",
)
def player_modes_stats(t: Tables) -> DataFrame:
    return games.player_modes_stats(t.gp)


@query(
    f""", r AS (SELECT * FROM gp WHERE player_name = 6 AND played_at >= DATE '2001-08-01' - 1825),
s AS (SELECT sum(rating) / count(*) AS mean, sqrt(CAST(count(*) * sum(CAST(rating AS BIGINT) * rating) - sum(rating) * sum(rating) AS DOUBLE)) / count(*) AS std, date_diff('day', CAST(min(played_at) AS DATE), DATE '2001-08-01') AS d FROM r WHERE mode = 'daily')
SELECT link, color, {_T.format('played_at')}, rating, CASE WHEN rating <= mean - std THEN 'behind' WHEN rating >= mean + std THEN 'ahead' ELSE 'around' END AS band, mean, std, CAST(d AS INT) AS days, CAST(least(d // 365, 20) AS INT) AS years
FROM r, s WHERE mode = 'daily'""",
    "gp",
)
def player_mode_chart(t: Tables) -> DataFrame:
    return _when(games.player_mode_chart(t.gp, 6, "daily", "2001-08-01", 1825, ALL_MODES), "played_at")


@query("SELECT player_name, CAST(year(played_at) AS INT) AS year, CAST(month(played_at) AS INT) AS month, count(DISTINCT link) AS n_games FROM gp GROUP BY ALL", "gp")
def month_ledger(t: Tables) -> DataFrame:
    return games.month_ledger(t.gp)


@query(
    """, l AS (SELECT DISTINCT player_name, CAST(1996 AS INT) AS year, CAST(1 + player_name % 12 AS INT) AS month FROM player)
SELECT l.player_name, l.year, l.month, count(DISTINCT link) AS n_games FROM l LEFT JOIN gp ON gp.player_name = l.player_name AND year(played_at) = l.year AND month(played_at) = l.month GROUP BY ALL""",
    "player",
    "gp",
)
def filled_month_ledger(t: Tables) -> DataFrame:
    ledger = t.player.select("player_name", F.lit(1996).alias("year"), (1 + F.col("player_name") % 12).cast("int").alias("month"))
    return games.month_ledger(t.gp, ledger)


@query("SELECT player_name, CAST(m // 100 AS INT) AS year, CAST(m % 100 AS INT) AS month FROM (SELECT player_name, max(year(played_at) * 100 + month(played_at)) AS m FROM gp GROUP BY player_name)", "gp")
def latest_month(t: Tables) -> DataFrame:
    return games.latest_month(games.month_ledger(t.gp))


@query("SELECT player_name, year, month, n_games, id FROM (SELECT o_custkey AS player_name, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, CAST(floor(o_totalprice / 50000) AS BIGINT) AS n_games, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate), month(o_orderdate) ORDER BY floor(o_totalprice / 50000) DESC, o_orderkey DESC) AS place FROM orders) WHERE place = 1")
def best_ledger_rows(t: Tables) -> DataFrame:
    rows = t.raw("orders").select(F.col("o_custkey").alias("player_name"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.floor(F.col("o_totalprice") / 50000).alias("n_games"), F.col("o_orderkey").alias("id"))
    return games.best_ledger_rows(rows)


@query("SELECT player_name, strftime(unnest(generate_series(date_trunc('month', f), TIMESTAMP '2001-08-01', INTERVAL 1 MONTH)), '%Y-%m') AS month FROM (SELECT player_name, min(played_at) AS f FROM gp GROUP BY player_name)", "gp")
def month_range(t: Tables) -> DataFrame:
    first = t.gp.groupBy("player_name").agg(F.min("played_at").cast("date").alias("first"))
    return tables.month_range(first, "first", F.lit("2001-08-01").cast("date"), ["player_name"]).select("player_name", F.date_format("month", "yyyy-MM").alias("month"))


@query("SELECT count(*) FILTER (fens_done) AS done, count(*) FILTER (NOT fens_done) AS pending FROM game", "game")
def processing_counts(t: Tables) -> DataFrame:
    return games.processing_counts(t.game)


@query("SELECT n_pieces, count(*) AS n, avg(elapsed_ms) AS avg_ms, min(elapsed_ms) AS min_ms, max(elapsed_ms) AS max_ms, CAST(grouping(n_pieces) AS INT) AS every FROM (SELECT l_linenumber AS n_pieces, CAST(l_partkey % 977 AS DOUBLE) AS elapsed_ms FROM lineitem) GROUP BY ROLLUP (n_pieces)")
def timing_summary(t: Tables) -> DataFrame:
    return games.timing_summary(t.raw("lineitem").select(F.col("l_linenumber").alias("n_pieces"), (F.col("l_partkey") % 977).cast("double").alias("elapsed_ms")))


@query(
    """, b AS (SELECT fen, score + fen % 13 AS y, fen % 5 AS n FROM fen WHERE score IS NOT NULL)
SELECT count(*) AS positions, count(*) FILTER (fen.fen % 3 = n) AS agreeing, count(*) FILTER (fen.fen % 3 = n) / count(*) AS agreement, avg(abs(score - y)) AS mean_diff, quantile_cont(abs(score - y), 0.5) AS median, quantile_cont(abs(score - y), 0.9) AS p90,
quantile_cont(abs(score - y), 0.95) AS p95, quantile_cont(abs(score - y), 0.99) AS p99 FROM fen JOIN b USING (fen)""",
    "fen",
)
def evaluation_stability(t: Tables) -> DataFrame:
    scored = t.fen.where("score IS NOT NULL")
    a = scored.select("fen", "score", (F.col("fen") % 3).alias("move"))
    return games.evaluation_stability(a, scored.select("fen", (F.col("score") + F.col("fen") % 13).alias("score"), (F.col("fen") % 5).alias("move")))


# Positions


@query("SELECT game_link AS link, count(*) AS total_positions FROM association WHERE fen_fen IN (SELECT fen FROM fen) GROUP BY game_link", "association", "fen")
def position_edges(t: Tables) -> DataFrame:
    return positions.game_analysis_summary(t.association, t.fen).select("link", "total_positions")


@query("SELECT fen_fen, count(*) AS n_games, list_aggregate(list_sort(list(DISTINCT '#' || n_move || '_' || move_color)), 'string_agg', ' ') AS counters FROM association GROUP BY fen_fen", "association")
def aggregate_positions(t: Tables) -> DataFrame:
    rows = t.association.withColumn("counter", F.concat(F.lit("#"), F.col("n_move").cast("string"), F.lit("_"), "move_color"))
    return positions.aggregate_positions(rows).withColumn("counters", F.array_join("counters", " "))


@query(
    """SELECT d.bucket, count(score) AS positions, CAST(coalesce(sum(n_games), 0) AS BIGINT) AS appearances, coalesce(sum(abs(score)), 0.0) AS abs_score_sum FROM (VALUES ('equal', 0, 50), ('small', 50, 150), ('clear', 150, 300), ('decisive', 300, 9000), ('mate', 9000, 1000000)) d(bucket, lo, hi)
LEFT JOIN fen ON abs(score) >= lo AND abs(score) < hi GROUP BY d.bucket""",
    "fen",
)
def scored_position_summary(t: Tables) -> DataFrame:
    return positions.scored_position_summary(t.fen)


@query(
    """SELECT count(*) AS scored, count(*) FILTER (score > 50) AS white_positions, count(*) FILTER (score < -50) AS black_positions, count(*) FILTER (abs(score) <= 50) AS balanced_positions, sum(score) AS score_sum, sum(abs(score)) AS abs_score_sum,
sum(wdl_win) AS wdl_win_sum, sum(wdl_draw) AS wdl_draw_sum, sum(wdl_loss) AS wdl_loss_sum, count(wdl_win) AS wdl_rows FROM fen WHERE score IS NOT NULL""",
    "fen",
)
def scored_totals(t: Tables) -> DataFrame:
    return positions.scored_totals(t.fen)


@query("SELECT * FROM gas", "gas")
def game_analysis_summary(t: Tables) -> DataFrame:
    return positions.game_analysis_summary(t.association, t.fen)


@query("SELECT * FROM gas WHERE link IN (SELECT link FROM game WHERE mode = 'daily')", "gas", "game")
def scoped_game_analysis(t: Tables) -> DataFrame:
    return positions.game_analysis_summary(t.association, t.fen, t.game.where("mode = 'daily'").select("link"))


@query("SELECT count(*) AS games, count(*) FILTER (is_fully_analyzed) AS fully, count(*) FILTER (NOT is_fully_analyzed) AS incomplete, CAST(sum(total_positions) AS BIGINT) AS positions, CAST(sum(analyzed_positions) AS BIGINT) AS analyzed FROM gas", "gas")
def coverage_overview(t: Tables) -> DataFrame:
    return positions.coverage_overview(positions.game_analysis_summary(t.association, t.fen))


@query("SELECT player_name, count(*) AS games, CAST(coalesce(sum(total_positions), 0) AS BIGINT) AS total_positions, CAST(coalesce(sum(analyzed_positions), 0) AS BIGINT) AS analyzed_positions, CAST(coalesce(sum(unscored_positions), 0) AS BIGINT) AS unscored_positions FROM gp LEFT JOIN gas USING (link) GROUP BY player_name", "gp", "gas")
def player_coverage(t: Tables) -> DataFrame:
    return positions.player_coverage(t.gp, positions.game_analysis_summary(t.association, t.fen))


@query(f"SELECT link, {_T.format('played_at')}, total_positions, analyzed_positions FROM (SELECT * FROM gas JOIN game USING (link) WHERE NOT is_fully_analyzed ORDER BY analyzed_positions / total_positions DESC, link DESC LIMIT 25)", "gas", "game")
def coverage_page(t: Tables) -> DataFrame:
    gas = tables.coverage_filter(positions.game_analysis_summary(t.association, t.fen), "incomplete").join(t.game.select("link", "played_at"), "link")
    return _when(positions.coverage_page(gas, tables.coverage_order("coverage"), 1, 25), "played_at").select("link", "played_at", "total_positions", "analyzed_positions")


def _scored(order: str, by: str):
    sql = f"SELECT fen, n_games, score, n_games * abs(score) AS impact FROM fen WHERE abs(score) >= 100 ORDER BY {by}, fen LIMIT 20 OFFSET 20"

    def run(t: Tables) -> DataFrame:
        return positions.scored_positions(t.fen, order, 100, page=2)

    run.__name__ = f"scored_positions_by_{order}"
    query(sql, "fen")(run)


_scored("frequency", "n_games DESC")
_scored("impact", "impact DESC, n_games DESC")
_scored("evaluation", "abs(score) DESC, n_games DESC")


@query("SELECT CAST(sum(n_games) AS BIGINT) AS sum_n_games FROM fen WHERE n_games > 30", "fen")
def sum_n_games(t: Tables) -> DataFrame:
    return positions.sum_n_games(t.fen, 30)


@query("SELECT fen, n_games FROM fen ORDER BY n_games DESC, fen LIMIT 100", "fen")
def top_positions(t: Tables) -> DataFrame:
    return positions.top_fens(t.fen, 100).select("fen", "n_games")


@query("SELECT fen, n_games FROM fen WHERE score IS NULL ORDER BY n_games DESC, fen LIMIT 100", "fen")
def next_unscored(t: Tables) -> DataFrame:
    return tables.next_batch(t.fen, 100).select("fen", "n_games")


@query("SELECT fen, n_games FROM fen WHERE score IS NULL AND fen IN (SELECT fen_fen FROM association JOIN gp ON gp.link = game_link WHERE player_name = 3) ORDER BY n_games DESC, fen LIMIT 50", "fen", "gp")
def player_unscored(t: Tables) -> DataFrame:
    return positions.player_unscored(t.fen, t.association, t.gp, 3, 50).select("fen", "n_games")


@query(
    """SELECT player_name, count(*) AS positions, count(*) FILTER (n_games = 1) AS once, count(*) FILTER (n_games > 1) AS more, count(score) AS scored FROM (
SELECT DISTINCT player_name, fen_fen FROM association JOIN gp ON gp.link = game_link) JOIN fen ON fen = fen_fen GROUP BY player_name""",
    "association",
    "gp",
    "fen",
)
def player_positions(t: Tables) -> DataFrame:
    return positions.player_positions(t.fen, t.association, t.gp)


# Natural breaks and ranks

_BREAKS = """, h AS (SELECT {value} AS value, count(*) AS n FROM {source} GROUP BY 1),
p AS (SELECT CAST(row_number() OVER o AS INT) AS i, value, sum(CAST(n AS DOUBLE)) OVER o AS sw, sum(CAST(n * value AS DOUBLE)) OVER o AS sx, sum(CAST(n * value AS DOUBLE) * value) OVER o AS sq FROM h WINDOW o AS (ORDER BY value)),
z AS (SELECT * FROM p UNION ALL SELECT 0, NULL, 0, 0, 0),
m AS (SELECT max(i) AS size FROM p),
c1 AS (SELECT b.i AS i, greatest(b.sq - b.sx * b.sx / b.sw, 0) AS cost FROM p b),
c2 AS (SELECT b.i, min({{'cost': c1.cost + greatest((b.sq - a.sq) - (b.sx - a.sx) * (b.sx - a.sx) / (b.sw - a.sw), 0), 'start': a.i + 1}}) AS c FROM c1 JOIN p a ON a.i = c1.i JOIN p b ON a.i < b.i GROUP BY b.i),
c3 AS (SELECT min({{'cost': c2.c.cost + greatest((b.sq - a.sq) - (b.sx - a.sx) * (b.sx - a.sx) / (b.sw - a.sw), 0), 's3': a.i + 1, 's2': c2.c.start}}) AS c FROM c2 JOIN p a ON a.i = c2.i JOIN p b ON a.i < b.i, m WHERE b.i = m.size),
k AS (SELECT unnest([0, 1, 2]) AS class, unnest([1, c.s2, c.s3]) AS start_i, unnest([c.s2 - 1, c.s3 - 1, m.size]) AS end_i, c.cost AS cost FROM c3, m),
breaks AS (SELECT class, start_i, min(value) AS low, max(value) AS high, CAST(sum(n) AS DOUBLE) AS weight, cost FROM k JOIN p ON i BETWEEN start_i AND end_i JOIN h USING (value) GROUP BY ALL)
"""


@query(_BREAKS.format(value="white_elo", source="game") + "SELECT CAST(class AS INT) AS class, CAST(start_i AS INT) AS start_i, low, high, weight, cost FROM breaks", "game")
def rating_breaks(t: Tables) -> DataFrame:
    hist = t.game.groupBy(F.col("white_elo").alias("value")).agg(F.count("*").alias("n"))
    return nb.natural_breaks(hist, 3)


@query(
    ", rows AS (SELECT link, CAST(round(avg_elo) AS INT) AS rating, gas.* EXCLUDE (link) FROM gas JOIN game USING (link) WHERE is_fully_analyzed)"
    + _BREAKS.format(value="rating", source="rows")
    + """, s AS (SELECT class AS "group", count(*) AS games, CAST(sum(total_positions) AS BIGINT) AS positions, min(rating) AS low, max(rating) AS high, sum(equal_positions) AS equal, sum(small_positions) AS small, sum(clear_positions) AS clear, sum(decisive_positions) AS decisive, sum(mate_positions) AS mate
FROM rows JOIN breaks b ON rating BETWEEN b.low AND b.high GROUP BY class)
SELECT CAST("group" AS INT) AS "group", games, positions, low, high, bucket, CAST(n AS BIGINT) AS n FROM (UNPIVOT s ON equal, small, clear, decisive, mate INTO NAME bucket VALUE n)""",
    "gas",
    "game",
)
def advantage_by_rating(t: Tables) -> DataFrame:
    return positions.advantage_by_rating(t.game, positions.game_analysis_summary(t.association, t.fen))


@query("SELECT rating, link, avg_abs_score, row_number() OVER (ORDER BY rating, link) AS rank, count(*) OVER () AS total FROM (SELECT avg_elo AS rating, link, avg_abs_score FROM gas JOIN game USING (link) WHERE is_fully_analyzed)", "gas", "game")
def ranked_games(t: Tables) -> DataFrame:
    return positions.ranked_games(t.game, positions.game_analysis_summary(t.association, t.fen))


@query(_BREAKS.format(value="white_elo", source="game") + "SELECT link, CAST(class AS INT) AS class FROM game JOIN breaks ON white_elo BETWEEN low AND high", "game")
def rating_classes(t: Tables) -> DataFrame:
    hist = t.game.groupBy(F.col("white_elo").alias("value")).agg(F.count("*").alias("n"))
    return nb.classify(t.game.select("link", "white_elo"), nb.natural_breaks(hist, 3), "white_elo").select("link", "class")


# Upserts and deltas over tables


@query("SELECT link, color, player_name FROM gp", "gp")
def two_sides(t: Tables) -> DataFrame:
    return t.gp.select("link", "color", "player_name")


@query("SELECT player_name FROM (SELECT white AS player_name FROM game UNION SELECT black FROM game) WHERE player_name NOT IN (SELECT player_name FROM player WHERE player_name % 4 > 0)", "game", "player")
def shell_players(t: Tables) -> DataFrame:
    return upserts.shell_players(t.game, t.player.where("player_name % 4 > 0")).select("player_name")


@query("SELECT link FROM game WHERE link % 3 = 1", "game")
def new_games(t: Tables) -> DataFrame:
    return upserts.new_only(t.game.where("link % 3 < 2"), t.game.where("link % 3 = 0"), ["link"]).select("link")


@query("SELECT link, CASE WHEN link % 5 = 0 THEN white_elo + 1000 ELSE white_elo END AS white_elo FROM game WHERE link % 2 = 0 OR link % 5 = 0", "game")
def replaced_rows(t: Tables) -> DataFrame:
    rows = t.game.select("link", "white_elo")
    return upserts.upsert_replace(rows.where("link % 2 = 0"), rows.where("link % 5 = 0").withColumn("white_elo", F.col("white_elo") + 1000), ["link"])


@query("SELECT fen_fen, count(*) AS n_games, list_aggregate(list_sort(list(DISTINCT n_move)), 'string_agg', ' ') AS counters FROM association GROUP BY fen_fen", "association")
def added_positions(t: Tables) -> DataFrame:
    make = lambda rows: positions.aggregate_positions(rows.withColumn("counter", F.col("n_move")))
    both = upserts.upsert_add(make(t.association.where("game_link % 2 = 0")), make(t.association.where("game_link % 2 = 1")), ["fen_fen"], ["n_games"], ["counters"])
    return both.withColumn("counters", F.array_join(F.transform("counters", lambda x: x.cast("string")), " "))


@query("SELECT fen, CASE WHEN fen % 6 = 0 THEN NULL WHEN fen % 6 = 1 THEN 5.0 ELSE score END AS score FROM fen", "fen")
def updated_scores(t: Tables) -> DataFrame:
    changes = t.fen.where("fen % 6 < 2").select("fen", F.when(F.col("fen") % 6 == 1, 5.0).alias("score"))
    return upserts.update_by_key(t.fen.select("fen", "score"), changes, "fen", ["score"])


@query("SELECT link, total_positions FROM gas WHERE link IN (SELECT link FROM game WHERE link % 4 > 0)", "gas", "game")
def orphans_dropped(t: Tables) -> DataFrame:
    gas = positions.game_analysis_summary(t.association, t.fen).select("link", "total_positions")
    return upserts.drop_orphans(gas, t.game.where("link % 4 > 0"), "link")


@query("SELECT link, fens_done OR mode = 'rapid' AS fens_done FROM game", "game")
def flagged_games(t: Tables) -> DataFrame:
    return upserts.set_flag(t.game.select("link", "mode", "fens_done"), F.col("mode") == "rapid", True).select("link", "fens_done")


@query("SELECT mode, player_name, n_games, wins, draws, losses FROM summary", "summary")
def merged_player_summary(t: Tables) -> DataFrame:
    make = lambda rows: games.main_mode_summary(rows, t.player)
    return deltas.merge_keyed(make(t.gp.where("link % 3 > 0")), make(t.gp.where("link % 3 = 0")), ["mode", "player_name"], ["n_games", "wins", "draws", "losses"])


@query("SELECT link, total_positions, analyzed_positions, unscored_positions, score_sum, abs_score_sum, max_abs_score, is_fully_analyzed, avg_score, avg_abs_score FROM gas", "gas")
def merged_game_analysis(t: Tables) -> DataFrame:
    """Half of the scores first, the other half as a delta."""
    old = t.fen.withColumn("score", F.when(F.col("fen") % 2 == 0, F.col("score")))
    new = t.fen.where("fen % 2 = 1 AND score IS NOT NULL")
    delta = positions.game_analysis_summary(t.association, new).withColumnRenamed("analyzed_positions", "newly")
    gas = deltas.merge_game_analysis(positions.game_analysis_summary(t.association, old), delta.select("link", "newly", "score_sum", "abs_score_sum", "max_abs_score", *[f"{b}_positions" for b in c.BUCKETS]), c.BUCKETS)
    return gas.select("link", "total_positions", "analyzed_positions", "unscored_positions", "score_sum", "abs_score_sum", "max_abs_score", "is_fully_analyzed", "avg_score", "avg_abs_score")


@query("SELECT * FROM (SELECT count(*) AS scored, sum(score) AS score_sum, CAST(sum(n_games) AS BIGINT) AS appearances FROM fen WHERE score IS NOT NULL)", "fen")
def merged_totals(t: Tables) -> DataFrame:
    make = lambda rows: rows.where("score IS NOT NULL").agg(F.count("*").alias("scored"), F.sum("score").alias("score_sum"), F.sum("n_games").alias("appearances"))
    return deltas.merge_counts(make(t.fen.where("fen % 2 = 0")), make(t.fen.where("fen % 2 = 1")), ["scored", "score_sum", "appearances"], floor=False)


# Text, JSON, samples


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(week(ts) AS INT) AS week FROM events")
def payload_field(t: Tables) -> DataFrame:
    rows = upserts.from_payload(t.raw("events").select("event_id", "ts", "props"), "props", "k bigint")
    return rows.select("event_id", F.col("props.k").alias("k"), F.weekofyear("ts").alias("week"))


@query("SELECT page_id, nullif(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1), '') AS lang, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, try_cast(regexp_extract(url, '([0-9]+)$', 1) AS BIGINT) AS number FROM pages")
def page_headers(t: Tables) -> DataFrame:
    found = lambda col, p: F.nullif(F.regexp_extract(col, p, 1), F.lit(""))
    return t.raw("pages").select("page_id", found("html", '<html lang="([^"]*)"').alias("lang"), found("html", "<title>([^<]*)</title>").alias("title"), found("url", "([0-9]+)$").try_cast("long").alias("number"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role, ' ' ORDER BY turn) AS roles, min(turn) = 0 AND max(turn) = count(*) - 1 AS is_contiguous FROM conversations GROUP BY conv_id")
def conversation_roles(t: Tables) -> DataFrame:
    rows = positions.ordered_tokens(t.raw("conversations"), ["conv_id"], ["turn"], "role")
    whole = positions.contiguous(t.raw("conversations").select(F.col("conv_id").alias("link"), (F.col("turn") + 1).alias("n_move")))
    return rows.select("conv_id", F.size("tokens").cast("long").alias("turns"), F.array_join("tokens", " ").alias("roles")).join(whole.withColumnRenamed("link", "conv_id"), "conv_id")


@query("SELECT count(*) AS named, (SELECT count(*) FILTER (coalesce(joined, 0) <> 0) FROM player) AS current, (SELECT count(joined) FROM player) AS with_joined FROM player WHERE name IS NOT NULL", "player")
def player_lists(t: Tables) -> DataFrame:
    named, current = tables.named_players(t.player).agg(F.count("*").alias("named")), tables.current_players(t.player).agg(F.count("*").alias("current"))
    return named.crossJoin(current).crossJoin(t.player.agg(F.count("joined").alias("with_joined")))


@query("SELECT part.p_brand, count(*) AS n FROM part WHERE p_size > 20 GROUP BY p_brand")
def parametrised_sql(t: Tables) -> DataFrame:
    return tables.run_sql(t.spark, "SELECT p_brand, count(*) AS n FROM {part} WHERE p_size > :least GROUP BY p_brand", {"least": 20}, part=t.raw("part"))


@query(
    """SELECT link, CASE WHEN k = 0 THEN 'daily' WHEN k = 1 THEN 'unknown' WHEN s < 180 THEN 'bullet' WHEN s < 600 THEN 'blitz' WHEN s <= 1800 THEN 'rapid' ELSE 'classical' END AS mode, CASE WHEN k > 1 THEN CAST(link % 7 AS DOUBLE) ELSE 0.0 END AS bonus
FROM (SELECT o_orderkey AS link, o_orderkey * 13 % 2400 AS s, o_orderkey % 10 AS k FROM orders)"""
)
def derived_modes(t: Tables) -> DataFrame:
    """Time controls in text, from the keys of orders."""
    key = F.col("o_orderkey")
    control = F.when(key % 10 == 0, F.concat(F.lit("1/"), (key * 13 % 2400).cast("string"))).when(key % 10 == 1, "none").otherwise(F.concat((key * 13 % 2400).cast("string"), F.lit("+"), (key % 7).cast("string")))
    return t.raw("orders").select(key.alias("link"), c.mode_of(control).alias("mode"), c.bonus_of(control).alias("bonus"))


@query("SELECT conv_id, turn, CAST(i + 1 AS INT) AS n_move, w[2 * i + 1] AS white, coalesce(w[2 * i + 2], '--') AS black FROM (SELECT conv_id, turn, str_split(text, ' ') AS w, unnest(range((len(str_split(text, ' ')) + 1) // 2)) AS i FROM conversations)")
def paired_tokens(t: Tables) -> DataFrame:
    rows = t.raw("conversations").select("conv_id", "turn", F.explode(c.paired_moves(F.split("text", " "))).alias("m"))
    return rows.select("conv_id", "turn", "m.n_move", "m.white", "m.black")


@query("SELECT p_partkey AS part, p_brand || '/' || p_type || ' w KQ -' AS position, sha256(p_brand || '/' || p_type || ' w KQ -') AS digest, '#' || p_size || '_' || (p_partkey % 9) AS counter, 'w' AS side, CAST(length(regexp_replace(split_part(p_brand || '/' || p_type, ' ', 1), '[^A-Za-z]', '', 'g')) AS INT) AS pieces FROM part")
def position_fields(t: Tables) -> DataFrame:
    """Position texts put together from parts, and taken apart again."""
    text = F.concat_ws(" ", F.concat_ws("/", "p_brand", "p_type"), F.lit("w KQ -"), F.col("p_size").cast("string"), (F.col("p_partkey") % 9).cast("string"))
    rows = t.raw("part").select(F.col("p_partkey").alias("part"), text.alias("f"))
    return rows.select("part", c.position_key("f").alias("position"), c.position_hash(c.position_key("f")).alias("digest"), c.position_counter("f").alias("counter"), c.side_to_move("f").alias("side"), c.piece_count("f").alias("pieces"))


@query("SELECT name, metric, count(*) AS samples, min(v) AS low, avg(v) AS mean, max(v) AS high FROM (SELECT l_linestatus AS name, 'cpu_percent' AS metric, CAST(l_partkey % 100 AS DOUBLE) AS v FROM lineitem UNION ALL SELECT l_linestatus, 'mem_bytes', CAST(l_suppkey AS DOUBLE) * 1048576 FROM lineitem UNION ALL SELECT l_linestatus, 'pids', CAST(l_linenumber AS DOUBLE) FROM lineitem) GROUP BY ALL")
def log_metrics(t: Tables) -> DataFrame:
    """Resource lines written from order lines, then parsed and rolled up."""
    line = F.concat(F.col("l_linestatus"), F.lit(" cpu="), (F.col("l_partkey") % 100).cast("string"), F.lit("% mem="), F.col("l_suppkey").cast("string"), F.lit("MiB / 64GiB pids="), F.col("l_linenumber").cast("string"))
    return logs.metrics_rollup(t.raw("lineitem").select(line.alias("value")))


@query("SELECT CAST(l_orderkey % 7 AS VARCHAR) AS device, l_returnflag AS name, count(*) AS samples, min(v) AS low, max(v) AS high FROM (SELECT *, CAST(l_quantity AS DOUBLE) AS v FROM lineitem) GROUP BY ALL")
def sensor_metrics(t: Tables) -> DataFrame:
    """A sensor log for each order, written from its lines under a header, then parsed."""
    lines = F.collect_list(F.concat(F.col("l_returnflag"), F.lit(": +"), F.col("l_quantity").cast("string"), F.lit("°C")))
    files = t.raw("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("file")).agg(F.array_join(lines, "\n").alias("body"), F.any_value((F.col("l_orderkey") % 7).cast("string")).alias("device"))
    return logs.sectioned_metrics(files.select("file", F.concat_ws("\n", "device", "body").alias("value"))).drop("mean")


@query()
def sampled_games(t: Tables) -> DataFrame:
    return tables.sample_n(t.game.select("link", "white", "black"), 200, ["link"])


_SWEEP = """, h AS (SELECT white_elo AS value, count(*) AS n FROM game GROUP BY 1),
p AS (SELECT row_number() OVER o AS i, sum(CAST(n AS DOUBLE)) OVER o AS sw, sum(CAST(n * value AS DOUBLE)) OVER o AS sx, sum(CAST(n * value AS DOUBLE) * value) OVER o AS sq FROM h WINDOW o AS (ORDER BY value)),
m AS (SELECT max(i) AS size, max(sw) AS w, arg_max(sx, i) AS x, arg_max(sq, i) AS q FROM p),
d AS MATERIALIZED (SELECT a.i AS a, b.i AS b, greatest((b.sq - a.sq) - (b.sx - a.sx) * (b.sx - a.sx) / (b.sw - a.sw), 0) AS cost FROM p a JOIN p b ON a.i < b.i),
c1 AS (SELECT i, greatest(sq - sx * sx / sw, 0) AS cost FROM p)""" + "".join(f", c{k} AS MATERIALIZED (SELECT d.b AS i, min(c{k - 1}.cost + d.cost) AS cost FROM c{k - 1} JOIN d ON d.a = c{k - 1}.i GROUP BY d.b)" for k in range(2, 11))


@query(_SWEEP + " UNION ALL ".join(f" SELECT CAST({k} AS INT) AS k, round(1 - cost / (q - x * x / w), 9) AS gvf FROM c{k}, m WHERE i = size" for k in range(2, 11)), "game")
def breaks_sweep(t: Tables) -> DataFrame:
    hist = t.game.groupBy(F.col("white_elo").alias("value")).agg(F.count("*").alias("n"))
    return nb.sweep(hist, range(2, 11)).withColumn("gvf", F.round("gvf", 9))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_activity(t: Tables) -> DataFrame:
    """Daily counts through a stream over the event files, whole when the stream has caught up."""
    import uuid

    from ..streaming import jobs

    folder = f"{tables.shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    delta = lambda batch: batch.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))
    merged = jobs.MergedSummary(t.spark, f"{folder}/summary", lambda old, new: deltas.merge_keyed(old, new, ["day", "event_type"], ["n"]), delta)
    jobs.run_once(jobs.stream_parquet(t.spark, t.sf_dir, "ts", "events*.parquet"), merged, f"{folder}/progress", "append")
    return merged.read()


from . import archived, details, sketched, updates  # noqa: E402, F401  further queries, which register themselves
