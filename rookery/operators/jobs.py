"""Whole jobs: games to positions, and evaluations back onto positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import BUCKETS, position_counter, position_key
from ..sources.upserts import insert_ignore, replace_keys, set_flag, update_by_key, upsert_add
from .deltas import merge_game_analysis
from .positions import aggregate_positions, best_lines, continuations, fold_sequences, game_analysis_summary


def half_moves(moves: DataFrame) -> DataFrame:
    """link, ply, n_move, move_color, token of every half-move that was played."""
    plies = F.array(F.struct(F.lit(0).alias("side"), F.lit("white").alias("move_color"), F.col("white_move").alias("token")), F.struct(F.lit(1).alias("side"), F.lit("black").alias("move_color"), F.col("black_move").alias("token")))
    rows = moves.select("link", "n_move", F.explode(plies).alias("p")).select("link", "n_move", "p.*").where("token IS NOT NULL AND token NOT IN ('', '--')")
    return rows.select("link", (2 * F.col("n_move") - 1 + F.col("side")).alias("ply"), "n_move", "move_color", "token")


def position_edges(moves: DataFrame, step: Callable, start, keep: Callable[[DataFrame], DataFrame] = lambda out: out) -> tuple[DataFrame, DataFrame]:
    """(edges, failures) of games' moves: game_link, fen_fen, n_move, move_color, counter of each half-move's position.

    step(state, token) -> (state, position text). A game with a failing step gives no edges, only its failure.
    """
    states, failed = fold_sequences(half_moves(moves), "link", ["ply"], "token", step, start, keep=keep)
    edges = states.select(
        F.col("key").alias("game_link"), position_key("state").alias("fen_fen"), F.ceil(F.col("step") / 2).cast("int").alias("n_move"), F.when(F.col("step") % 2 == 1, "white").otherwise("black").alias("move_color"), position_counter("state").alias("counter")
    )
    return edges, failed


def generate_positions(game: DataFrame, moves: DataFrame, fen: DataFrame, association: DataFrame, step: Callable, start) -> dict[str, DataFrame]:
    """Positions of the games that aren't done: new fen, association and game tables, and failures.

    A game with a failing step goes to quarantine and is marked done all the same. The fen table counts
    occurrences, from edges that aren't stored yet, so a rerun adds nothing.
    """
    todo = game.where(~F.coalesce("fens_done", F.lit(False))).select("link")
    edges, failed = position_edges(moves.join(todo, "link", "left_semi"), step, start)
    keys = ["game_link", "fen_fen", "n_move", "move_color"]
    fresh = edges.dropDuplicates(keys).join(association.select(*keys), keys, "left_anti")
    added = aggregate_positions(fresh).withColumnRenamed("fen_fen", "fen")
    counted = upsert_add(fen, added, ["fen"], ["n_games"], ["counters"])
    done = game.join(todo.withColumn("__todo", F.lit(True)), "link", "left")
    return {
        "fen": counted.join(fen.drop("n_games", "counters"), "fen", "left"),
        "association": insert_ignore(association, fresh.select(*keys), keys),
        "game": set_flag(done, F.coalesce("__todo", F.lit(False)), True).drop("__todo"),
        "failures": failed,
    }


def first_answers(evaluations: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The first valid answer of each position, by arrival where there is such a column, else the least by value: reruns agree."""
    order = [c for c in (arrival, *[x for x in evaluations.columns if x not in ("fen", arrival)]) if c in evaluations.columns]
    first = evaluations.where(F.col("is_valid") & (F.size("analysis") > 0)).groupBy("fen").agg(F.min(F.struct(*order)).alias("answer"))
    return first.select("fen", "answer.*").select(*evaluations.columns)


def attach_evaluations(fen: DataFrame, continuation: DataFrame, association: DataFrame, gas: DataFrame, evaluations: DataFrame) -> dict[str, DataFrame]:
    """Engine answers onto positions: new fen, continuation and game summary tables.

    Only positions without a score count as newly scored in the games' summaries.
    """
    evaluations = first_answers(evaluations)
    best = best_lines(evaluations)
    columns = ["score", "next_moves", "wdl_win", "wdl_draw", "wdl_loss"]
    newly = best.join(fen.where("score IS NULL").select("fen"), "fen", "left_semi").where("score IS NOT NULL")
    delta = game_analysis_summary(association, newly).withColumnRenamed("analyzed_positions", "newly")
    delta = delta.select("link", "newly", "score_sum", "abs_score_sum", "max_abs_score", *[f"{b}_positions" for b in BUCKETS])
    return {
        "fen": update_by_key(fen, best, "fen", columns),
        "continuation": replace_keys(continuation, continuations(evaluations), best.select("fen"), ["fen"]),
        "game_analysis_summary": merge_game_analysis(gas, delta, BUCKETS),
    }
