"""Queries that run whole jobs over the tables in batches, with a batch that comes twice, and read what is stored then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.jobs import half_moves
from ..operators.positions import read_evaluations
from ..operators.storage import shared_folder
from ..sources import updates
from ..sources.store import Store
from ..streaming import folds, jobs
from .adapters import Tables
from .catalogue import _when, query


_stores: dict[tuple[str, str, str], Store] = {}


def _once(job):
    """A job's store serves all queries of a session over the same folder: each reads another of its tables."""

    def run(t: Tables) -> Store:
        place = (t.spark.sparkContext.applicationId, t.sf_dir, job.__name__)
        if place not in _stores:
            _stores[place] = job(t)
        return _stores[place]

    return run


def _store(t: Tables) -> Store:
    return updates.game_store(t.spark, f"{shared_folder(t.spark)}/store-{uuid.uuid4().hex}", buckets=8)


@_once
def _ingested(t: Tables) -> Store:
    """Two batches of games that overlap; the second comes twice."""
    store = _store(t)
    for number, part in ((0, "link % 3 < 2"), (1, "link % 3 > 0"), (1, "link % 3 > 0")):
        if number == 0:  # players known before the games are
            updates.store_profiles(store, t.player, t.player.select("player_name").limit(0), "profiles", 0)
        updates.ingest_games(store, t.game.where(part), t.moves.where(part), "games", number)
    return store


@query("SELECT link, white, black, mode FROM game", "game")
def ingested_games(t: Tables) -> DataFrame:
    return _ingested(t).read("game").select("link", "white", "black", "mode")


@query("SELECT link, n_moves, opening FROM opening", "opening")
def ingested_openings(t: Tables) -> DataFrame:
    return _ingested(t).read("game_opening").select("link", "n_moves", "opening")


@query("SELECT player_name, CAST(year(played_at) AS INT) AS year, CAST(month(played_at) AS INT) AS month, count(DISTINCT link) AS n_games FROM gp GROUP BY ALL", "gp")
def ingested_months(t: Tables) -> DataFrame:
    return _ingested(t).read("months")


@query("SELECT player_name, name, joined FROM player UNION ALL SELECT DISTINCT player_name, NULL, 0 FROM gp WHERE player_name NOT IN (SELECT player_name FROM player)", "player", "gp")
def ingested_players(t: Tables) -> DataFrame:
    return _ingested(t).read("player").select("player_name", "name", "joined")


@query("SELECT * REPLACE (strftime(last_played_at, '%Y-%m-%d %H:%M:%S') AS last_played_at) FROM summary", "summary")
def ingested_summary(t: Tables) -> DataFrame:
    return _when(_ingested(t).read("main_mode_summary"), "last_played_at")


@query("SELECT count(*) AS games, count(*) FILTER (mode = 'bullet') AS bullet_games, count(*) FILTER (mode = 'blitz') AS blitz_games, count(*) FILTER (mode = 'rapid') AS rapid_games FROM game", "game")
def ingested_totals(t: Tables) -> DataFrame:
    return _ingested(t).read("game_totals")


def _numbered(state: int, token: str) -> tuple[int, str]:
    """A small rule: a position is a half-move's number, side and token. One token is refused."""
    if token == "R7":
        raise ValueError("not a move")
    return state + 1, f"{token}/{state % 5} {'bw'[state % 2]} - - {state} 1"


@_once
def _evaluated(t: Tables) -> Store:
    """All games, their positions in two batches (the second has nothing to do), and answers for some positions in two batches that overlap."""
    store = _store(t)
    updates.ingest_games(store, t.game.withColumn("fens_done", F.lit(False)), t.moves, "games", 0)
    for number in (0, 1):
        updates.generate_positions(store, _numbered, 0, "positions", number)
    size = F.length("fen") * 40 + F.ascii("fen") - 300
    line = F.concat(F.lit('{"score": '), size.cast("string"), F.lit(', "pv": ["a", "b"], "wdl": [1, 2, 3]}, {"score": 1, "pv": ["c"]}'))
    answers = read_evaluations(store.read("fen").select("fen", F.lit(True).alias("is_valid"), F.concat(F.lit("["), line, F.lit("]")).alias("analysis")))
    for number, part in ((0, "fen LIKE '%/0 %' OR fen LIKE '%/1 %'"), (1, "fen LIKE '%/1 %' OR fen LIKE '%/2 %'"), (1, "fen LIKE '%/2 %'")):
        updates.store_evaluations(store, answers.where(part), "answers", number)
    return store


_EDGES = """, plies AS (
  SELECT link, 2 * n_move - 1 AS ply, white_move AS token FROM moves WHERE white_move NOT IN ('', '--') UNION ALL SELECT link, 2 * n_move, black_move FROM moves WHERE black_move NOT IN ('', '--')),
steps AS (SELECT link, token, row_number() OVER (PARTITION BY link ORDER BY ply) AS step FROM plies WHERE link IN (SELECT link FROM game) AND link NOT IN (SELECT link FROM plies WHERE token = 'R7')),
edges AS (SELECT link, CAST((step + 1) // 2 AS INT) AS n_move, CASE step % 2 WHEN 1 THEN 'white' ELSE 'black' END AS move_color, token || '/' || ((step - 1) % 5) || ' ' || CASE (step - 1) % 2 WHEN 0 THEN 'b' ELSE 'w' END || ' - -' AS fen FROM steps),
fens AS (SELECT fen, count(*) AS n_games, CASE WHEN fen LIKE '%/0 %' OR fen LIKE '%/1 %' OR fen LIKE '%/2 %' THEN CAST(length(fen) * 40 + ascii(fen) - 300 AS DOUBLE) END AS score FROM edges GROUP BY fen)
"""


@query(_EDGES + "SELECT fen, n_games, score, CASE WHEN score IS NOT NULL THEN 'a b' END AS next_moves FROM fens", "moves", "game")
def evaluated_positions(t: Tables) -> DataFrame:
    return _evaluated(t).read("fen").select("fen", "n_games", "score", "next_moves")


@query(_EDGES + "SELECT link, count(*) AS total_positions, count(score) AS analyzed_positions, coalesce(sum(abs(score)), 0.0) AS abs_score_sum, count(*) = count(score) AS is_fully_analyzed FROM edges JOIN fens USING (fen) GROUP BY link", "moves", "game")
def evaluated_games(t: Tables) -> DataFrame:
    return _evaluated(t).read("game_analysis_summary").select("link", "total_positions", "analyzed_positions", "abs_score_sum", "is_fully_analyzed")


@query(
    _EDGES
    + """SELECT count(*) AS scored, count(*) FILTER (score > 50) AS white_positions, count(*) FILTER (score < -50) AS black_positions, count(*) FILTER (abs(score) <= 50) AS balanced_positions, sum(score) AS score_sum, sum(abs(score)) AS abs_score_sum,
sum(1.0::DOUBLE) AS wdl_win_sum, sum(2.0::DOUBLE) AS wdl_draw_sum, sum(3.0::DOUBLE) AS wdl_loss_sum, count(*) AS wdl_rows FROM fens WHERE score IS NOT NULL""",
    "moves",
    "game",
)
def evaluated_totals(t: Tables) -> DataFrame:
    return _evaluated(t).read("scored_totals")


@query(_EDGES + "SELECT DISTINCT fen, CAST(2 AS INT) AS rank, 'c' AS move FROM fens WHERE score IS NOT NULL", "moves", "game")
def evaluated_continuations(t: Tables) -> DataFrame:
    return _evaluated(t).read("continuation").select("fen", "rank", "move")


@query(", plies AS (SELECT link, 2 * n_move - 1 AS ply, white_move AS token FROM moves WHERE white_move NOT IN ('', '--') UNION ALL SELECT link, 2 * n_move, black_move FROM moves WHERE black_move NOT IN ('', '--')), steps AS (SELECT link, token, row_number() OVER (PARTITION BY link ORDER BY ply) AS step FROM plies WHERE link IN (SELECT link FROM game)) SELECT link AS key, CAST(min(step) AS INT) AS step, 'R7' AS token FROM steps WHERE token = 'R7' GROUP BY link", "moves", "game")
def quarantined_games(t: Tables) -> DataFrame:
    return _evaluated(t).read("failures").select("key", "step", "token")


@query(_EDGES + "SELECT link AS key, CAST(step AS INT) AS step, token, token || '/' || ((step - 1) % 5) || ' ' || CASE (step - 1) % 2 WHEN 0 THEN 'b' ELSE 'w' END || ' - - ' || (step - 1) || ' 1' AS state FROM steps", "moves", "game")
def streamed_states(t: Tables) -> DataFrame:
    """States of games that grow: their first two moves come in one run of a stream, the others in the next."""
    folder = f"{shared_folder(t.spark)}/fold-{uuid.uuid4().hex}"
    sink = folds.FoldedStates(t.spark, f"{folder}/states", 8)
    plies = half_moves(t.moves).join(t.game.select("link"), "link", "left_semi").select("link", "ply", "n_move", "token")
    for part in ("n_move <= 2", "n_move > 2"):
        plies.where(part).write.mode("append").parquet(f"{folder}/plies")
        stream = t.spark.readStream.schema(plies.schema).parquet(f"{folder}/plies")
        with folds.lasting_state(t.spark):
            jobs.run_once(folds.fold_stream(stream, "link", "ply", "token", _numbered, 0), sink, f"{folder}/progress", "append")
    return sink.states().select("key", "step", "token", "state")
