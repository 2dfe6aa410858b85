"""Star-schema and event tables in the shape of game tables, once for Spark and once as SQL.

Orders stand for games, order lines for moves and for edges to positions, parts for positions,
customers for players, a user's week of events for a sequence of tokens.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import openings
from ..operators.tables import game_players


class Tables:
    """Frames of one folder; each is built when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def game(self) -> DataFrame:
        first, link, price = F.substring("o_orderpriority", 1, 1), F.col("o_orderkey"), F.col("o_totalprice")
        result = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "P", 0.5).otherwise(0.0)
        mode = F.when(first == "1", "bullet").when(first == "2", "blitz").when(first == "3", "rapid").when(first == "4", "classical").otherwise("daily")
        word = F.when(F.col("o_orderstatus") == "F", "win").when(F.col("o_orderstatus") == "P", "agreed").otherwise("resigned")
        rows = self.raw("orders").select(
            link.alias("link"),
            F.col("o_custkey").alias("white"),
            ((F.col("o_custkey") * 7 + link) % 1500).alias("black"),
            F.floor(price / 1000).cast("int").alias("white_elo"),
            (link % 500).cast("int").alias("black_elo"),
            result.alias("white_result"),
            (1.0 - result).alias("black_result"),
            word.alias("white_str_result"),
            F.when(F.col("o_orderstatus") == "F", "resigned").when(F.col("o_orderstatus") == "P", "agreed").otherwise("win").alias("black_str_result"),
            mode.alias("mode"),
            (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), (link % 24).cast("int"))).alias("played_at"),
            F.floor(price / 100).cast("double").alias("time_elapsed"),
            (link % 83).cast("int").alias("n_moves"),
            F.when(F.col("o_custkey") % 40 == 0, "no_eco").otherwise(F.concat(F.lit("E"), (F.col("o_custkey") % 40).cast("string"))).alias("eco"),
            (link % 3 == 0).alias("fens_done"),
        )
        return rows.withColumn("avg_elo", (F.col("white_elo") + F.col("black_elo")) / 2.0)

    @cached_property
    def gp(self) -> DataFrame:
        return game_players(self.game)

    @cached_property
    def player(self) -> DataFrame:
        joined = F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal") + 1).when(F.col("c_custkey") % 2 == 0, 0)
        return self.raw("customer").select(F.col("c_custkey").alias("player_name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("name"), joined.cast("long").alias("joined"))

    @cached_property
    def moves(self) -> DataFrame:
        from pyspark.sql import Window

        order = Window.partitionBy("link").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
        return self.raw("lineitem").withColumnRenamed("l_orderkey", "link").select(  # renamed first: what comes by link later is dealt already
            "link",
            F.row_number().over(order).alias("n_move"),
            F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("white_move"),
            F.when(F.col("l_partkey") % 11 == 0, "--").otherwise(F.col("l_linestatus")).alias("black_move"),
        )

    @cached_property
    def opening(self) -> DataFrame:
        return openings(self.moves).join(self.game.select("link", "mode", "avg_elo", "played_at"), "link")

    @cached_property
    def association(self) -> DataFrame:
        rows = self.raw("lineitem").select(F.col("l_orderkey").alias("game_link"), F.col("l_partkey").alias("fen_fen"), F.col("l_linenumber").alias("n_move"), F.col("l_returnflag").alias("move_color"))
        return rows.distinct()

    @cached_property
    def fen(self) -> DataFrame:
        size = F.col("p_size")
        score = F.when(F.col("p_partkey") % 7 == 0, None).when(size >= 49, 9000 + size).otherwise((size - 25) * 20)
        seen = self.association.groupBy(F.col("fen_fen").alias("fen")).agg(F.count("*").alias("n_games"))
        rows = self.raw("part").select(F.col("p_partkey").alias("fen"), score.cast("double").alias("score"))
        wdl = [F.when(F.col("fen") % 5 > 0, F.col("fen") % k).cast("double").alias(n) for k, n in ((3, "wdl_win"), (4, "wdl_draw"), (5, "wdl_loss"))]
        return rows.join(seen, "fen", "left").select("fen", "score", F.coalesce("n_games", F.lit(0)).alias("n_games"), *wdl)

    @cached_property
    def sequences(self) -> DataFrame:
        """events with their week, as user_id, week, ts, event_id, event_type."""
        return self.raw("events").select("user_id", F.date_trunc("week", F.col("ts").cast("timestamp")).cast("date").alias("week"), "ts", "event_id", "event_type")


#: The same tables as SQL; each text is one common table expression.
CTE = {
    "game": """game AS (
  SELECT *, (white_elo + black_elo) / 2.0 AS avg_elo FROM (
  SELECT o_orderkey AS link, o_custkey AS white, (o_custkey * 7 + o_orderkey) % 1500 AS black,
    CAST(floor(o_totalprice / 1000) AS INT) AS white_elo, CAST(o_orderkey % 500 AS INT) AS black_elo,
    CAST(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'P' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS white_result,
    CAST(CASE o_orderstatus WHEN 'F' THEN 0.0 WHEN 'P' THEN 0.5 ELSE 1.0 END AS DOUBLE) AS black_result,
    CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'P' THEN 'agreed' ELSE 'resigned' END AS white_str_result,
    CASE o_orderstatus WHEN 'F' THEN 'resigned' WHEN 'P' THEN 'agreed' ELSE 'win' END AS black_str_result,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'bullet' WHEN '2' THEN 'blitz' WHEN '3' THEN 'rapid' WHEN '4' THEN 'classical' ELSE 'daily' END AS mode,
    o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) AS played_at,
    CAST(floor(o_totalprice / 100) AS DOUBLE) AS time_elapsed, CAST(o_orderkey % 83 AS INT) AS n_moves,
    CASE WHEN o_custkey % 40 = 0 THEN 'no_eco' ELSE 'E' || CAST(o_custkey % 40 AS VARCHAR) END AS eco,
    o_orderkey % 3 = 0 AS fens_done
  FROM orders))""",
    "gp": """gp AS (
  SELECT link, mode, played_at, eco, n_moves, time_elapsed, avg_elo, 'white' AS color, white AS player_name, black AS opponent_name, white_result AS result, white_elo AS rating, black_elo AS opponent_rating FROM game
  UNION ALL
  SELECT link, mode, played_at, eco, n_moves, time_elapsed, avg_elo, 'black', black, white, black_result, black_elo, white_elo FROM game)""",
    "player": """player AS (
  SELECT c_custkey AS player_name, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name,
    CAST(CASE WHEN c_acctbal > 0 THEN floor(c_acctbal) + 1 WHEN c_custkey % 2 = 0 THEN 0 END AS BIGINT) AS joined FROM customer)""",
    "moves": """moves AS (
  SELECT l_orderkey AS link, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus) AS INT) AS n_move,
    l_returnflag || CAST(l_linenumber AS VARCHAR) AS white_move, CASE WHEN l_partkey % 11 = 0 THEN '--' ELSE l_linestatus END AS black_move FROM lineitem)""",
    "opening": """opening AS (
  SELECT s.link, s.n_moves, s.opening, game.mode, game.avg_elo, game.played_at FROM (
    SELECT m.link, k.n AS n_moves, string_agg(m.white_move || ' ' || m.black_move, ' ' ORDER BY m.n_move) AS opening
    FROM moves m JOIN (SELECT CAST(range AS INT) AS n FROM range(3, 11)) k ON m.n_move <= k.n
    GROUP BY m.link, k.n HAVING count(*) = k.n AND count(*) FILTER (m.black_move = '--' OR m.white_move = '--') = 0) s JOIN game USING (link))""",
    "association": """association AS (SELECT DISTINCT l_orderkey AS game_link, l_partkey AS fen_fen, l_linenumber AS n_move, l_returnflag AS move_color FROM lineitem)""",
    "fen": """fen AS (
  SELECT p_partkey AS fen, CAST(CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_size >= 49 THEN 9000 + p_size ELSE (p_size - 25) * 20 END AS DOUBLE) AS score,
    coalesce(n, 0) AS n_games, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey % 3 AS DOUBLE) END AS wdl_win,
    CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey % 4 AS DOUBLE) END AS wdl_draw, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey % 5 AS DOUBLE) END AS wdl_loss
  FROM part LEFT JOIN (SELECT fen_fen, count(*) AS n FROM association GROUP BY fen_fen) a ON a.fen_fen = p_partkey)""",
    "gas": """gas AS (
  SELECT *, unscored_positions = 0 AS is_fully_analyzed, score_sum / nullif(analyzed_positions, 0) AS avg_score, abs_score_sum / nullif(analyzed_positions, 0) AS avg_abs_score FROM (
  SELECT game_link AS link, count(*) AS total_positions, count(score) AS analyzed_positions, count(*) - count(score) AS unscored_positions,
    coalesce(sum(score), 0.0) AS score_sum, coalesce(sum(abs(score)), 0.0) AS abs_score_sum, max(abs(score)) AS max_abs_score,
    count(*) FILTER (abs(score) < 50) AS equal_positions, count(*) FILTER (abs(score) >= 50 AND abs(score) < 150) AS small_positions, count(*) FILTER (abs(score) >= 150 AND abs(score) < 300) AS clear_positions,
    count(*) FILTER (abs(score) >= 300 AND abs(score) < 9000) AS decisive_positions, count(*) FILTER (abs(score) >= 9000) AS mate_positions
  FROM association JOIN fen ON fen_fen = fen GROUP BY game_link))""",
    "sequences": """sequences AS (SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, ts, event_id, event_type FROM events)""",
    "summary": """summary AS (
  SELECT mode, player_name, count(*) AS n_games, avg(rating) AS avg_rating, count(*) FILTER (result = 1) AS wins, count(*) FILTER (result = 0.5) AS draws, count(*) FILTER (result = 0) AS losses,
    count(*) FILTER (color = 'white') AS as_white, count(*) FILTER (color = 'black') AS as_black, arg_max(rating, {'p': played_at, 'l': link, 'c': color}) AS last_rating, max(played_at) AS last_played_at
  FROM gp WHERE player_name IN (SELECT player_name FROM player WHERE coalesce(joined, 0) <> 0) GROUP BY ALL)""",
}
_NEEDS = {"gp": ["game"], "opening": ["moves", "game"], "fen": ["association"], "gas": ["fen"], "summary": ["gp", "player"]}


def with_tables(body: str, *names: str) -> str:
    """SQL with the tables it names put before it."""
    done: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(CTE[n] for n in done) + "\n" + body if done else body  # a body that starts with a comma goes on with tables of its own
