"""Analytical queries over games, players and moves (game, game_player, moves, game_opening, player).

Each takes frames and returns a frame; sorts are top-k, gap fills come from `range`, and one
conditional aggregate replaces several scans wherever the numbers come from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MINUTES, MODES, floor_bin, history_span, is_main, is_real_token, labelled_bin, result_label, result_score, weekday
from .natural_breaks import natural_breaks
from .tables import page_bounds, page_with_total, paginate, pick, rating_between, require_mode, zero_filled


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def _all() -> Column:
    return F.count("*")


def score_rate(wins: str = "wins", draws: str = "draws", total: str = "total") -> Column:
    return F.try_divide(F.col(wins) + F.col(draws) / 2.0, F.col(total))


def database_summary(game: DataFrame, player: DataFrame, fen: DataFrame) -> DataFrame:
    """Totals of the three tables in one row, one scan of each."""
    games = game.agg(_all().alias("games"), *[_n(F.col("mode") == m).alias(f"{m}_games") for m in MODES])
    players = player.agg(_n(is_main("joined")).alias("main_players"), _n(~is_main("joined")).alias("secondary_players"))
    score = F.col("score")
    fens = fen.agg(_all().alias("positions"), F.count("score").alias("scored_positions"), _n(score.isNull()).alias("unscored_positions"), _n(score != 0).alias("nonzero_positions"))
    return games.crossJoin(players).crossJoin(fens)  # one row each


def main_mode_counts(gp: DataFrame, player: DataFrame) -> DataFrame:
    """Games with a main player, by mode; every mode has a row."""
    main = player.where(is_main("joined")).select("player_name")
    found = gp.where(F.col("mode").isin(*MODES)).join(main, "player_name", "left_semi").groupBy("mode").agg(F.count_distinct("link").alias("n_games"))
    domain = gp.sparkSession.createDataFrame([(m,) for m in MODES], "mode string")
    return zero_filled(found, domain, "mode", ["n_games"])


def main_mode_summary(gp: DataFrame, player: DataFrame, players: DataFrame | None = None) -> DataFrame:
    """By mode and main player: games, mean rating, results, colours and the last game. players: only these."""
    main = player.where(is_main("joined")).select("player_name")
    if players is not None:
        main = main.join(players.select("player_name"), "player_name", "left_semi")
    last = F.max_by(F.struct("rating", "played_at", "link"), F.struct("played_at", "link", "color"))
    out = gp.where(F.col("mode").isNotNull()).join(main, "player_name", "left_semi").groupBy("mode", "player_name")
    r = F.col("result")
    out = out.agg(
        _all().alias("n_games"),
        F.avg("rating").alias("avg_rating"),
        _n(r == 1.0).alias("wins"),
        _n(r == 0.5).alias("draws"),
        _n(r == 0.0).alias("losses"),
        _n(F.col("color") == "white").alias("as_white"),
        _n(F.col("color") == "black").alias("as_black"),
        last.alias("last"),
    )
    return out.select("*", F.col("last.rating").alias("last_rating"), F.col("last.played_at").alias("last_played_at")).drop("last")


def top_main_characters(summary: DataFrame, mode: str, limit: int = 100) -> DataFrame:
    """Leaderboard of a mode."""
    rows = require_mode(summary, mode).withColumn("score_rate", score_rate(total="n_games"))
    return rows.orderBy(F.col("last_rating").desc_nulls_last(), F.col("n_games").desc(), F.col("player_name")).limit(max(1, min(5000, limit)))


def labelled(rows: DataFrame, player: DataFrame) -> DataFrame:
    """A few rows with their players' names: the rows go to the players, whatever the number of those."""
    names = player.select("player_name", "name").join(F.broadcast(rows.select("player_name").distinct()), "player_name", "left_semi")
    return rows.join(names, "player_name", "left")


def rating_chart(gp: DataFrame, mode: str, k: int = 3) -> DataFrame:
    """The ratings of a mode with their counts, and the natural group that each is in: rating, n, class, low, high."""
    hist = rating_histogram(require_mode(gp, mode)).withColumnRenamed("rating", "value")
    groups = natural_breaks(hist, k).select("class", "low", "high")
    return hist.join(F.broadcast(groups), F.col("value").between(F.col("low"), F.col("high"))).select(F.col("value").alias("rating"), "n", "class", "low", "high")


def rating_histogram(df: DataFrame, rating: str = "rating") -> DataFrame:
    return df.where(F.col(rating).isNotNull()).groupBy(rating).agg(_all().alias("n"))


def top_moves(moves: DataFrame, game: DataFrame, mode: str | None = None, color: str = "white", low: int | None = None, high: int | None = None, max_move: int = 10, player: str | None = None, modes=MODES) -> DataFrame:
    """The move played most at each move number, with a row for every number up to max_move."""
    move, elo, name = pick(color, "white_move", "black_move"), pick(color, "white_elo", "black_elo"), pick(color, "white", "black")
    games = require_mode(game, mode, modes=modes) if mode is not None else game
    games = rating_between(games, elo, low, high)
    if player is not None:
        games = games.where(F.col(name) == player)
    played = moves.where(F.col("n_move").between(1, max_move) & is_real_token(move)).join(games.select("link"), "link")
    counts = played.groupBy("n_move", F.col(move).alias("move")).agg(_all().alias("n"))
    first = F.row_number().over(Window.partitionBy("n_move").orderBy(F.col("n").desc(), F.col("move")))
    best = counts.withColumn("place", first).where("place = 1").drop("place")
    every = moves.sparkSession.range(1, max_move + 1).select(F.col("id").cast("int").alias("n_move"))
    return every.join(best, "n_move", "left").select("n_move", F.coalesce("move", F.lit("-")).alias("move"), F.coalesce("n", F.lit(0)).alias("n"))


def top_moves_page(moves: DataFrame, game: DataFrame, page: int = 1, size: int = 10, max_move: int = 10, **filters) -> DataFrame:
    """A page of top_moves, with total (of move numbers), page and pages. Only moves of the page's numbers are counted."""
    page, size, offset = page_bounds(max_move, page, size, 10)
    asked = moves.where(F.col("n_move").between(offset + 1, offset + size))
    rows = top_moves(asked, game, max_move=min(max_move, offset + size), **filters).where(F.col("n_move") > offset)
    return rows.select("*", F.lit(max_move).alias("total"), F.lit(page).alias("page"), F.lit(-(-max_move // size)).alias("pages"))


def top_openings(opening: DataFrame, n_moves: int = 3, mode: str | None = None, low: int | None = None, high: int | None = None, page: int = 1, size: int = 20, modes=MODES) -> DataFrame:
    """Most common openings of so many moves, with their mean rating."""
    rows = require_mode(opening, mode, modes=modes) if mode is not None else opening
    rows = rating_between(rows, "avg_elo", low, high).where((F.col("n_moves") == n_moves) & is_real_token("opening"))
    found = rows.groupBy("opening").agg(_all().alias("n"), F.avg("avg_elo").alias("mean_elo"))
    return paginate(found, [F.col("n").desc(), F.col("opening")], page, size)


def openings_page(opening: DataFrame, n_moves: int = 3, page: int = 1, size: int = 20) -> DataFrame:
    """As top_openings, with total, page and pages."""
    rows = opening.where((F.col("n_moves") == n_moves) & is_real_token("opening"))
    found = rows.groupBy("opening").agg(_all().alias("n"), F.avg("avg_elo").alias("mean_elo"))
    return page_with_total(found, [F.col("n").desc(), F.col("opening")], page, size)


def player_openings(opening: DataFrame, gp: DataFrame, player: str, result: str | None = None, n_moves: int = 3, page: int = 1, size: int = 20) -> DataFrame:
    mine = gp.where((F.col("player_name") == player) & (F.col("result") == result_score(result))).select("link")
    rows = opening.where((F.col("n_moves") == n_moves) & is_real_token("opening")).join(mine, "link", "left_semi")
    return paginate(rows.groupBy("opening").agg(_all().alias("n")), [F.col("n").desc(), F.col("opening")], page, size)


def opening_pairs(opening: Column | str) -> Column:
    """An opening's text as (white, black) pairs in order."""
    t = F.split(F.col(opening) if isinstance(opening, str) else opening, " ")
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(t) - 1) / 2).cast("int")), lambda i: F.struct(F.get(t, 2 * i).alias("white"), F.get(t, 2 * i + 1).alias("black")))


def result_matrix(gp: DataFrame) -> DataFrame:
    """Results by colour with score rates."""
    r = F.col("result")
    out = gp.groupBy("color").agg(_all().alias("total"), _n(r == 1.0).alias("wins"), _n(r == 0.5).alias("draws"), _n(r == 0.0).alias("losses"))
    return out.withColumn("score_rate", score_rate())


def game_length(game: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: count, mean, median and 90th percentile of moves and of elapsed minutes."""
    minutes = F.col("time_elapsed") / 60.0
    share = F.percentile_approx if approximate else F.percentile
    both = lambda c: share(c, F.array(F.lit(0.5), F.lit(0.9)))
    out = game.agg(_all().alias("games"), F.avg("n_moves").alias("avg_moves"), both(F.col("n_moves")).alias("m"), F.avg("time_elapsed").alias("avg_seconds"), both(minutes).alias("e"))
    return out.select("games", "avg_moves", F.get("m", 0).cast("double").alias("median_moves"), F.get("m", 1).cast("double").alias("p90_moves"), "avg_seconds", F.get("e", 0).alias("median_minutes"), F.get("e", 1).alias("p90_minutes"))


def moves_histogram(game: DataFrame, width: int = 10) -> DataFrame:
    return game.where("n_moves IS NOT NULL").groupBy(floor_bin("n_moves", width).alias("low")).agg(_all().alias("n")).select("low", (F.col("low") + width - 1).alias("high"), "n")


def minutes_histogram(game: DataFrame, edges: tuple[int, ...] = MINUTES) -> DataFrame:
    """Irregular bins of elapsed minutes."""
    bins = game.where("time_elapsed >= 0").select(labelled_bin(F.col("time_elapsed") / 60.0, edges).alias("b"))
    return bins.groupBy("b.label", "b.place").agg(_all().alias("n"))


def minute_bins(game: DataFrame, width: int = 1) -> DataFrame:
    """Regular bins of elapsed minutes."""
    return game.where("time_elapsed >= 0").groupBy(floor_bin(F.col("time_elapsed") / 60.0, width).alias("low")).agg(_all().alias("n")).select("low", (F.col("low") + width).alias("high"), "n")


def activity_heat(df: DataFrame, at: str = "played_at", dense: bool = True) -> DataFrame:
    """Counts by month, weekday (0 is Sunday) and hour in one pass: unit, value, n."""
    parts = F.array(
        F.struct(F.lit("month").alias("unit"), F.month(at).alias("value")),
        F.struct(F.lit("weekday").alias("unit"), weekday(at).alias("value")),
        F.struct(F.lit("hour").alias("unit"), F.hour(at).alias("value")),
    )
    found = df.where(F.col(at).isNotNull()).select(F.explode(parts).alias("p")).groupBy("p.unit", "p.value").agg(_all().alias("n"))
    if not dense:
        return found
    domain = [("month", i) for i in range(1, 13)] + [("weekday", i) for i in range(7)] + [("hour", i) for i in range(24)]
    return df.sparkSession.createDataFrame(domain, "unit string, value int").join(found, ["unit", "value"], "left").na.fill(0, ["n"])


def player_performance(gp: DataFrame, player: str | None = None) -> DataFrame:
    """Results and averages by player and colour."""
    rows = gp if player is None else gp.where(F.col("player_name") == player)
    r = F.col("result")
    return rows.groupBy("player_name", "color").agg(_all().alias("games"), _n(r == 1.0).alias("wins"), _n(r == 0.0).alias("losses"), _n(r == 0.5).alias("draws"), F.avg("rating").alias("avg_rating"), F.avg("n_moves").alias("avg_moves"))


def player_averages(gp: DataFrame) -> DataFrame:
    """By player: mean ratings of both sides, moves and seconds."""
    means = {"avg_rating": "rating", "avg_opponent_rating": "opponent_rating", "avg_moves": "n_moves", "avg_seconds": "time_elapsed"}
    return gp.groupBy("player_name").agg(_all().alias("games"), *[F.avg(c).alias(n) for n, c in means.items()])


def label_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    """One row: games in all and by label."""
    return rows.agg(_all().alias("games"), *[_n(F.col(label) == x).alias(x) for x in ("win", "draw", "loss", "unknown")])


def player_terminations(game: DataFrame, player: str) -> DataFrame:
    """How a player's games ended, by the word on their own side."""
    mine = F.when(F.col("white") == player, F.col("white_str_result")).when(F.col("black") == player, F.col("black_str_result"))
    return game.select(mine.alias("termination")).where("termination IS NOT NULL").groupBy("termination").agg(_all().alias("n"))


def top_eco(gp: DataFrame, player: str | None = None, limit: int = 10) -> DataFrame:
    rows = gp if player is None else gp.where(F.col("player_name") == player)
    r = F.col("result")
    rows = rows.where("eco IS NOT NULL AND eco <> 'no_eco'").groupBy("eco").agg(_all().alias("games"), _n(r == 1.0).alias("wins"), _n(r == 0.5).alias("draws"), _n(r == 0.0).alias("losses"))
    return rows.orderBy(F.col("games").desc(), F.col("eco")).limit(limit)


def player_summary(gp: DataFrame) -> DataFrame:
    """By player: results, first and last game, games by mode."""
    r = F.col("result")
    modes = [_n(F.col("mode") == m).alias(f"{m}_games") for m in MODES]
    return gp.groupBy("player_name").agg(_all().alias("games"), _n(r == 1.0).alias("wins"), _n(r == 0.5).alias("draws"), _n(r == 0.0).alias("losses"), F.min("played_at").alias("first_game"), F.max("played_at").alias("last_game"), *modes)


def player_mode_games(gp: DataFrame, player: str, mode: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """A player's games of a mode with labels, newest first when sorted by played_at."""
    rows = require_mode(gp, mode).where(F.col("player_name") == player)
    if start:
        rows = rows.where(F.col("played_at") >= F.lit(start).cast("timestamp"))
    if end:
        rows = rows.where(F.col("played_at") <= F.lit(end).cast("timestamp"))
    return rows.withColumn("label", result_label("result"))


def player_games_page(gp: DataFrame, player: str, page: int, size: int) -> DataFrame:
    """Past the end a page is empty here, not the last one."""
    rows = gp.where(F.col("player_name") == player)
    return paginate(rows, [F.col("played_at").desc_nulls_last(), F.col("link").desc(), F.col("color")], page, size, clamp=False)


def player_hours(gp: DataFrame) -> DataFrame:
    """Hours played, in all and by mode."""
    hours = lambda c: F.coalesce(F.sum(c), F.lit(0.0)) / 3600.0
    modes = [hours(F.when(F.col("mode") == m, F.col("time_elapsed"))).alias(f"{m}_hours") for m in MODES]
    return gp.groupBy("player_name").agg(hours(F.col("time_elapsed")).alias("hours"), *modes)


def player_modes_stats(gp: DataFrame) -> DataFrame:
    """By player and mode: results (whatever isn't a win or a draw is a loss), oldest and newest rating."""
    order, r = F.struct("played_at", "link", "color"), F.col("result")
    rows = gp.withColumn("mode", F.coalesce("mode", F.lit("unknown")))
    out = rows.groupBy("player_name", "mode").agg(
        _all().alias("games"), _n(r == 1.0).alias("wins"), _n(r == 0.5).alias("draws"), F.min_by("rating", order).alias("oldest_rating"), F.max_by("rating", order).alias("newest_rating"), F.max("rating").alias("best_rating")
    )
    return out.withColumn("losses", F.col("games") - F.col("wins") - F.col("draws"))


def player_mode_chart(gp: DataFrame, player: str, mode: str, as_of: str, days: int | None = None, modes=MODES) -> DataFrame:
    """Rating history with bands: at most a standard deviation from the mean, behind or ahead, and the history's span.

    The deviation is the population's, from whole-number sums, so it doesn't depend on their order.
    """
    rows = require_mode(gp, mode, modes=modes).where((F.col("player_name") == player) & F.col("rating").isNotNull())
    if days:
        rows = rows.where(F.col("played_at") >= F.date_sub(F.lit(as_of).cast("date"), days))
    n, s, q = F.count("*"), F.sum(F.col("rating").cast("long")), F.sum(F.col("rating").cast("long") * F.col("rating"))
    stats = rows.agg((s / n).alias("mean"), (F.sqrt((n * q - s * s).cast("double")) / n).alias("std"), history_span(F.min("played_at"), F.lit(as_of).cast("date")).alias("span"))
    band = F.when(F.col("rating") <= F.col("mean") - F.col("std"), "behind").when(F.col("rating") >= F.col("mean") + F.col("std"), "ahead").otherwise("around")
    return rows.crossJoin(F.broadcast(stats)).select("link", "color", "played_at", "rating", band.alias("band"), "mean", "std", F.col("span.days").alias("days"), F.col("span.years").alias("years"))


def month_ledger(gp: DataFrame, months: DataFrame | None = None, unique: bool = False) -> DataFrame:
    """Games by player and month; with a ledger of months, those without games count 0. unique: gp has both sides of each game once."""
    n = F.count_distinct("link")
    if unique:  # a game against oneself counts once; links needn't be told apart
        gp, n = gp.where(~((F.col("color") == "black") & F.col("player_name").eqNullSafe(F.col("opponent_name")))), F.count("link")
    rows = gp.where("played_at IS NOT NULL").groupBy("player_name", F.year("played_at").alias("year"), F.month("played_at").alias("month")).agg(n.alias("n_games"))
    if months is None:
        return rows
    keys = ["player_name", "year", "month"]
    return months.select(*keys).distinct().join(rows, keys, "left").na.fill(0, ["n_games"])


def latest_month(ledger: DataFrame) -> DataFrame:
    """The newest valid month of each player."""
    valid = ledger.where(F.col("month").between(1, 12)).groupBy("player_name").agg(F.max(F.struct("year", "month")).alias("m"))
    return valid.select("player_name", "m.year", "m.month")


def best_ledger_rows(ledger: DataFrame) -> DataFrame:
    """One row a player and month: the one with most games, then the highest id."""
    order = Window.partitionBy("player_name", "year", "month").orderBy(F.col("n_games").desc(), F.col("id").desc())
    return ledger.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def processing_counts(game: DataFrame) -> DataFrame:
    return game.agg(_n(F.col("fens_done")).alias("done"), _n(~F.coalesce(F.col("fens_done"), F.lit(False))).alias("pending"))


def timing_summary(times: DataFrame) -> DataFrame:
    """Engine times in all (null n_pieces) and by number of pieces, in one pass."""
    return times.rollup("n_pieces").agg(_all().alias("n"), F.avg("elapsed_ms").alias("avg_ms"), F.min("elapsed_ms").alias("min_ms"), F.max("elapsed_ms").alias("max_ms"), F.grouping("n_pieces").cast("int").alias("every"))


def evaluation_stability(a: DataFrame, b: DataFrame, key: str = "fen") -> DataFrame:
    """Agreement of two evaluations of the same positions, and percentiles of their difference."""
    both = a.select(key, F.col("score").alias("x"), F.col("move").alias("m")).join(b.select(key, F.col("score").alias("y"), F.col("move").alias("n")), key)
    d = F.abs(F.col("x") - F.col("y"))
    out = both.agg(_all().alias("positions"), _n(F.col("m") == F.col("n")).alias("agreeing"), F.avg(d).alias("mean_diff"), F.percentile(d, F.array(*[F.lit(p) for p in (0.5, 0.9, 0.95, 0.99)])).alias("p"))
    return out.select("positions", "agreeing", F.try_divide("agreeing", "positions").alias("agreement"), "mean_diff", *[F.get("p", i).alias(n) for i, n in enumerate(("median", "p90", "p95", "p99"))])
