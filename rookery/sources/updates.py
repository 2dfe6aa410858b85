"""Whole jobs over a Store: each changes its tables and refreshes what depends on them in one commit.

Inputs are frames, so that archives, files and other tables serve alike. A batch that comes again changes nothing.
Work and rewriting follow the batch: stored tables are read by the buckets that the batch's keys fall into.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions.columns import BUCKETS
from ..operators import deltas, games, jobs, positions
from ..operators.joins import counted_join
from ..operators.storage import written
from ..operators.tables import game_players
from .archive_reader import opened
from .archives import game_rows, moves_of, openings_of
from .store import Rows, Snapshot, Store, Whole
from .upserts import new_only, replace_keys, update_by_key, upsert_add, upsert_replace

#: Key columns of the tables of games; a key decides what lies together.
KEYS = {
    "game": ["link"],
    "moves": ["link"],
    "game_opening": ["link"],
    "game_player": ["player_name"],
    "player": ["player_name"],
    "months": ["player_name"],
    "main_mode_summary": ["player_name"],
    "fen": ["fen"],
    "association": ["game_link"],
    "association_by_fen": ["fen_fen"],
    "continuation": ["fen"],
    "game_analysis_summary": ["link"],
    "failures": ["key"],
    "broken_months": ["file"],
}
_BY_BUCKET = partial(deltas.merge_keyed, keys=["bucket"], sums=["positions", "appearances", "abs_score_sum"])
_OPENED = ["mode", "avg_elo", "played_at"]
_SCORES = ["score", "next_moves", "wdl_win", "wdl_draw", "wdl_loss"]


def game_store(spark: SparkSession, folder: str, buckets: int = 64) -> Store:
    return Store(spark, folder, KEYS, buckets)


def _rows(now: Snapshot, name: str, keys: DataFrame, like: DataFrame) -> DataFrame:
    """Stored rows of these keys; none where there is no such table yet."""
    return now.read_keys(name, keys) if name in now else like.limit(0)


def _merged_row(now: Snapshot, name: str, delta: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Whole:
    return Whole(merge(now.read(name), delta) if name in now else delta)


def _new_games(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """new_only by link; `parsed` itself where that is all. Where no link comes twice, which the links alone tell, whole rows needn't meet."""
    taken = written(stored.select("link"))
    known = not taken.isEmpty()
    if parsed.groupBy("link").count().where("count > 1").limit(1).count() == 0:
        return parsed.join(taken.hint("merge"), "link", "left_anti") if known else parsed
    return new_only(parsed, taken if known else parsed.limit(0), ["link"], "arrival" if "arrival" in parsed.columns else None)


def ingest_games(store: Store, parsed: DataFrame, moves: DataFrame, job: str, batch: int) -> bool:
    """New games of a batch, with their moves, openings, players' rows, months and unknown players; the summaries of
    the players they touch; and the totals. parsed: `game` rows; those that are stored already go."""
    now = store.snapshot()
    if now.manifest["applied"].get(job, -1) >= batch:
        return False
    new = written(_new_games(parsed, _rows(now, "game", parsed, parsed)))
    own = written(moves.join(new.select("link").hint("merge"), "link", "left_semi"))
    first = positions.opening_moves(own).where(F.size("parts") >= 3).join(new.select("link", *_OPENED).hint("merge"), "link")
    openings = positions.opening_prefixes(store.dealt("game_opening", first), ["link"], 3, 10, _OPENED)
    return _commit_games(store, now, Rows(new), Rows(own), openings, job, batch)


def ingest_texts(store: Store, told: DataFrame, job: str, batch: int) -> bool:
    """The same where games carry their moves: told has `game` rows with `tokens`, `clocks` and `bonus`, and `arrival`, whose largest
    value wins where a link comes twice. Games are dealt once, and what is made of each goes to the bucket where it lies."""
    now = store.snapshot()
    if now.manifest["applied"].get(job, -1) >= batch:
        return False
    dealt = written(store.dealt("game", told))
    new = _new_games(dealt, _rows(now, "game", dealt, dealt))
    new = new if new is dealt else written(store.dealt("game", new))
    game = new.select(*[x for x in told.columns if x not in ("tokens", "clocks", "bonus", "arrival")])
    return _commit_games(store, now, Rows(game, dealt=True), Rows(moves_of(new), dealt=True), openings_of(new, _OPENED), job, batch)


def _commit_games(store: Store, now: Snapshot, rows: Rows, moves: Rows, openings: DataFrame, job: str, batch: int) -> bool:
    """New games and what follows from them; openings come by bucket."""
    new = rows.new
    gp = game_players(new)
    sides = written(gp.select("player_name").distinct())
    names = sides.where("player_name IS NOT NULL")
    known = written(_rows(now, "player", names, names.withColumn("joined", F.lit(0).cast("long"))).select("player_name", "joined"))
    shells = names.join(known.select("player_name").hint("merge"), "player_name", "left_anti").withColumn("joined", F.lit(0).cast("long"))
    main = known.where(c.is_main("joined")).select("player_name")  # players that are new haven't joined
    every = _rows(now, "game_player", main, gp).select(*gp.columns).unionByName(gp)
    totals = new.agg(F.count("*").alias("games"), *[F.count_if(F.col("mode") == m).alias(f"{m}_games") for m in ("bullet", "blitz", "rapid")])
    return store.commit(
        job,
        batch,
        {
            "game": rows,
            "moves": moves,
            "game_player": Rows(gp),
            "game_opening": Rows(openings, dealt=True),
            "months": Rows(games.month_ledger(gp, unique=True), partial(upsert_add, keys=["player_name", "year", "month"], sums=["n_games"]), sides),
            "player": Rows(shells),
            "main_mode_summary": Rows(games.main_mode_summary(every, known), lambda old, rows: replace_keys(old, rows, names, ["player_name"]), main),
            "game_totals": _merged_row(now, "game_totals", totals, partial(deltas.merge_counts, counts=totals.columns)),
        },
        now,
    )


class ArchiveBatches:
    """A stream of archive rows into a store: new games by ingest_texts, broken months to the table `broken_months`.

    The two are commits of their own, each of which knows its batch, so a batch that comes again after either changes nothing.
    """

    def __init__(self, store: Store, job: str):
        self.store, self.job = store, job

    def __call__(self, batch: DataFrame, number: int) -> None:
        rows, broken = opened(written(batch))
        rows = game_rows(rows).withColumns({"tokens": c.tokens_of("words"), "clocks": c.clock_seconds("pgn"), "arrival": F.struct("file", "arrival")})
        ingest_texts(self.store, rows.drop("pgn", "words", "file"), self.job, number)
        self.store.commit(f"{self.job}/broken", number, {"broken_months": Rows(broken)})
        self.store.vacuum()


def store_profiles(store: Store, profiles: DataFrame, asked: DataFrame, job: str, batch: int) -> bool:
    """Fetched profiles replace their players' rows; a player that was asked for without an answer and isn't known gets a shell row."""
    now = store.snapshot()
    failed = asked.select("player_name").distinct().join(profiles.select("player_name"), "player_name", "left_anti")
    shells = failed.withColumn("joined", F.lit(0).cast("long"))
    shells = shells.join(_rows(now, "player", failed, failed).select("player_name"), "player_name", "left_anti")
    new = profiles.unionByName(shells, allowMissingColumns=True)
    return store.commit(job, batch, {"player": Rows(new, partial(upsert_replace, keys=["player_name"]))}, now)


def generate_positions(store: Store, step: Callable, start, job: str, batch: int) -> bool:
    """Positions of the games that aren't done; the affected games' summaries, scored totals and ratings follow."""
    now = store.snapshot()
    if now.manifest["applied"].get(job, -1) >= batch:
        return False
    todo = written(now.read("game").where(~F.coalesce("fens_done", F.lit(False))).select("link"))
    if "fen" in now and todo.isEmpty():
        return store.commit(job, batch, {}, now)
    moves = now.read("moves").join(todo.hint("merge"), "link", "left_semi")
    edges, failed = jobs.position_edges(moves, step, start, keep=written)
    keys = ["game_link", "fen_fen", "n_move", "move_color"]  # a game's step has one row, so no edge comes twice
    fresh = edges.join(_rows(now, "association", todo.select(F.col("link").alias("game_link")), edges).select(*keys).hint("merge"), keys, "left_anti")
    added = positions.aggregate_positions(fresh).withColumnRenamed("fen_fen", "fen")
    added = written(added.withColumns({c: F.lit(None).cast("string" if c == "next_moves" else "double") for c in _SCORES}))
    stored = _rows(now, "fen", added.select("fen"), added).select("fen", "score")
    seen = written(stored.unionByName(added.select("fen", "score").join(stored, "fen", "left_anti")))
    summary = positions.game_analysis_summary(edges.select(*keys), seen, join=counted_join)
    # More games reach positions that have a score: they appear more often, and nothing else changes.
    again = positions.scored_position_summary(stored.join(added.select("fen", "n_games"), "fen")).withColumns({"positions": F.lit(0).cast("long"), "abs_score_sum": F.lit(0.0)})
    fresh_fens = added.join(stored, "fen", "left_anti").agg(F.count("*").alias("positions"), F.lit(0).cast("long").alias("scored"), F.count("*").alias("unscored"))
    fen = lambda old, new: upsert_add(old, new, ["fen"], ["n_games"], ["counters"]).join(old.drop("n_games", "counters"), "fen", "left")
    return store.commit(
        job,
        batch,
        {
            "fen": Rows(added, fen),
            "association": Rows(fresh.select(*keys)),
            "association_by_fen": Rows(fresh.select(*keys)),
            "game": Rows(todo, lambda old, _: old.withColumn("fens_done", F.lit(True))),  # all that aren't done are meant
            "failures": Rows(failed.select("key", "step", "token", "error")),
            "game_analysis_summary": Rows(summary, lambda old, rows: replace_keys(old, rows, todo, ["link"])),
            "scored_position_summary": _merged_row(now, "scored_position_summary", again, _BY_BUCKET),
            "fen_totals": _merged_row(now, "fen_totals", fresh_fens, partial(deltas.merge_counts, counts=fresh_fens.columns)),
        },
        now,
    )


def store_evaluations(store: Store, evaluations: DataFrame, job: str, batch: int, player: str | None = None) -> bool:
    """Engine answers onto positions: scores, continuations, the games' summaries and the scored totals, by deltas.

    player: only positions of this player's games.
    """
    now = store.snapshot()
    if now.manifest["applied"].get(job, -1) >= batch:
        return False
    answers = jobs.first_answers(evaluations)
    if player is not None:
        mine = now.read("game_player").where(F.col("player_name") == player).select(F.col("link").alias("game_link"))
        reached = now.read_keys("association", mine).select(F.col("fen_fen").alias("fen"))
        answers = answers.join(reached, "fen", "left_semi")
    answers = written(answers)
    best = positions.best_lines(answers)
    old = written(now.read_keys("fen", answers.select("fen")))
    known = written(best.join(old.select("fen"), "fen", "left_semi"))
    newly = written(known.where("score IS NOT NULL").join(old.where("score IS NULL").select("fen", "n_games"), "fen"))
    delta = positions.game_analysis_summary(now.read_near("association_by_fen", newly.select(F.col("fen").alias("fen_fen"))), newly, join=counted_join)
    delta = delta.withColumnRenamed("analyzed_positions", "newly").select("link", "newly", "score_sum", "abs_score_sum", "max_abs_score", *[f"{b}_positions" for b in BUCKETS])
    delta = written(delta)
    turned = newly.agg(F.lit(0).cast("long").alias("positions"), F.count("*").alias("scored"), (-F.count("*")).alias("unscored"))
    changed = lambda gas, d: deltas.merge_game_analysis(gas, d, BUCKETS)
    lines = positions.continuations(answers)
    return store.commit(
        job,
        batch,
        {
            "fen": Rows(known, partial(update_by_key, key="fen", columns=_SCORES)),
            "continuation": Rows(lines, lambda old, rows: replace_keys(old, rows, known.select("fen"), ["fen"]), known.select("fen")),
            "game_analysis_summary": Rows(delta, changed),
            "scored_position_summary": _merged_row(now, "scored_position_summary", positions.scored_position_summary(newly), _BY_BUCKET),
            "fen_totals": _merged_row(now, "fen_totals", turned, partial(deltas.merge_counts, counts=turned.columns)),
            "scored_totals": _merged_row(now, "scored_totals", positions.scored_totals(newly), deltas.merge_scored_totals),
        },
        now,
    )


def refresh_ratings(store: Store, job: str, batch: int, k: int = 3) -> bool:
    """The advantage of fully analysed games by natural groups of rating, from the stored summaries."""
    now = store.snapshot()
    return store.commit(job, batch, {"scored_rating_summary": Whole(positions.advantage_by_rating(now.read("game"), now.read("game_analysis_summary"), k))}, now)
