"""Sequences, positions and their evaluations."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import BUCKETS, advantage_bucket, impact, is_real_token, side_of
from .joins import skew_join
from .natural_breaks import classify, natural_breaks
from .storage import written
from .tables import global_rank, melt, paginate, scored_min, scored_order


def ordered_tokens(df: DataFrame, keys: Sequence[str], order: Sequence[str], token: str, most: int | None = None) -> DataFrame:
    """keys, tokens: each key's tokens in order."""
    pairs = F.array_sort(F.collect_list(F.struct(*order, F.col(token).alias("__token"))))
    out = df.groupBy(*keys).agg(F.transform(pairs, lambda p: p["__token"]).alias("tokens"))
    return out if most is None else out.withColumn("tokens", F.slice("tokens", 1, most))


def opening_moves(moves: DataFrame, high: int = 10) -> DataFrame:
    """link, parts: the first full moves as text, up to `high`, as far as they run 1, 2, 3, ... without a missing half-move."""
    first = moves.where(F.col("n_move").between(1, high))
    both = F.array_sort(F.collect_list(F.struct("n_move", "white_move", "black_move")))
    games = first.groupBy("link").agg(both.alias("m"))
    fits = F.transform("m", lambda x, i: F.coalesce((x["n_move"] == i + 1) & is_real_token(x["white_move"]) & is_real_token(x["black_move"]), F.lit(False)))
    broken = F.array_position(fits, False)
    run = F.when(broken == 0, F.size("m")).otherwise(broken - 1).cast("int")
    return games.select("link", F.transform(F.slice("m", F.lit(1), run), lambda x: F.concat_ws(" ", x["white_move"], x["black_move"])).alias("parts"))


def opening_prefixes(rows: DataFrame, keep: Sequence[str], low: int, high: int, more: Sequence[str] = ()) -> DataFrame:
    """keep, n_moves, opening, more: each row's parts as texts of low to high moves; only lengths that are there."""
    sizes = F.explode(F.sequence(F.lit(low), F.least(F.lit(high), F.size("parts")))).alias("n_moves")
    rows = rows.where(F.size("parts") >= low).select(*keep, *more, "parts", sizes)
    return rows.select(*keep, "n_moves", F.array_join(F.slice("parts", F.lit(1), F.col("n_moves")), " ").alias("opening"), *more)


def openings(moves: DataFrame, low: int = 3, high: int = 10) -> DataFrame:
    """link, n_moves, opening: the first n full moves as text, for games that have them all without a missing half-move."""
    return opening_prefixes(opening_moves(moves, high), ["link"], low, high)


def opening_counts(moves: DataFrame, game: DataFrame, low: int = 3, high: int = 10) -> DataFrame:
    """n_moves, opening, n, elo_sum, rated of all openings. Games with the same moves are counted together first, so
    each different sequence, not each game, is spelled out to its prefixes."""
    rows = opening_moves(moves, high).where(F.size("parts") >= low).join(game.select("link", "avg_elo"), "link")
    same = rows.groupBy("parts").agg(F.count("*").alias("n"), F.sum("avg_elo").alias("elo_sum"), F.count("avg_elo").alias("rated"))
    return opening_prefixes(same, ["n", "elo_sum", "rated"], low, high).groupBy("n_moves", "opening").agg(*[F.sum(c).alias(c) for c in ("n", "elo_sum", "rated")])


def contiguous(moves: DataFrame) -> DataFrame:
    """link, is_contiguous: whether move numbers run 1, 2, 3, ..."""
    return moves.groupBy("link").agg(((F.min("n_move") == 1) & (F.max("n_move") == F.count("*")) & (F.count_distinct("n_move") == F.count("*"))).alias("is_contiguous"))


def reaction_times(moves: DataFrame, clock: str, bonus: Column, out: str, lagged: bool = False) -> DataFrame:
    """Seconds spent: the change to the next clock (or from the one before) plus the bonus; the bonus alone at the end."""
    order = Window.partitionBy("link").orderBy("n_move")
    other = F.lag(clock).over(order) if lagged else F.lead(clock).over(order)
    return moves.withColumn(out, F.round(F.coalesce(F.abs(F.col(clock) - other), F.lit(0.0)) + bonus, 3))


def prefix_keys(sequences: DataFrame, keys: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """One state a step: the digest of the tokens so far. Equal prefixes are equal states; transpositions are not merged."""
    steps = F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.struct(i.alias("step"), F.sha2(F.array_join(F.slice(tokens, F.lit(1), i), " ").cast("binary"), 256).alias("state")))
    return sequences.where(F.size(tokens) > 0).select(*keys, F.explode(steps).alias("s")).select(*keys, "s.step", "s.state")


def running_keys(df: DataFrame, keys: Sequence[str], order: Sequence[str], token: str, before: DataFrame | None = None) -> DataFrame:
    """keys, step, state of each row: a digest of the tokens up to it, in work that grows with the rows and not with their square.

    The digest is three running sums of 40 bits of each token's own digest with its step, so it can be continued: before
    has the last step and state of keys whose earlier rows aren't here. No sequence is collected. Equal prefixes are equal states;
    other ones differ but for chance (about 2^-120 a pair). A null token counts as an empty one; ties in `order` go by token.
    """
    w = Window.partitionBy(*keys).orderBy(*order, token)
    rows = df.select(*dict.fromkeys([*keys, *order, token]))
    done = {"__done": F.lit(0), **{f"__from{i}": F.lit(0).cast("long") for i in range(3)}}
    if before is None:
        rows = rows.withColumns(done)
    else:
        sums = [F.split("state", "-")[i].cast("long").alias(f"__from{i}") for i in range(3)]
        rows = rows.join(before.select(*keys, F.col("step").alias("__done"), *sums), list(keys), "left").na.fill(0, list(done))
    # All windows have one order, so rows are sorted once.
    rows = rows.withColumn("__step", F.row_number().over(w) + F.col("__done"))
    digest, sums = F.md5(F.concat_ws(":", "__step", F.coalesce(F.col(token).cast("string"), F.lit(""))).cast("binary")), w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = lambda i: F.sum(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 10).cast("long")).over(sums) + F.col(f"__from{i}")
    return rows.select(*keys, F.col("__step").alias("step"), F.concat_ws("-", *[part(i) for i in range(3)]).alias("state"))


def fold_sequences(df: DataFrame, key: str, order: Sequence[str], token: str, step: Callable, start, key_type: str = "long", keep: Callable[[DataFrame], DataFrame] = lambda out: out) -> tuple[DataFrame, DataFrame]:
    """States and failures of a user's step(state, token) -> (state, text), folded along each key.

    A key with any failing step contributes no states, only its first failure (key, step, token,
    error). Rows are dealt by key and sorted; a task goes through them once and holds one key's states at a time.
    keep: what becomes of the folded rows before they are parted into states and failures, such as writing them.
    """
    names = ["key", "step", "state", "token", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        now, state, held, failed, kinds = nothing, start, [], None, None

        def told(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int32(), pa.string(), batch.schema.field(1).type, pa.string()]
            done = []
            for own, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now is nothing or own != now:
                    done += held if failed is None else [failed]
                    now, state, held, failed = own, start, [], None
                if failed is not None:
                    continue
                try:
                    state, text = step(state, t)
                except Exception as e:  # noqa: BLE001  a user's rule: the key goes to quarantine with the reason
                    failed, held = (own, len(held) + 1, None, t, f"{type(e).__name__}: {e}"), []
                else:
                    held.append((own, len(held) + 1, text, t, None))
            yield told(done)
        if kinds:
            yield told(held if failed is None else [failed])

    rows = df.select(key, *[o for o in order if o != key], token).repartition(key).sortWithinPartitions(key, *order)
    out = keep(rows.select(F.col(key).cast(key_type), F.col(token).cast("string")).mapInArrow(run, f"key {key_type}, step int, state string, token string, error string"))
    return out.where("error IS NULL").drop("error"), out.where("error IS NOT NULL").drop("state")


def aggregate_positions(association: DataFrame, key: str = "fen_fen", counter: str = "counter", count_games: bool = False) -> DataFrame:
    """Distinct positions with their occurrences (or games) and the sorted set of their counters."""
    n = F.count_distinct("game_link") if count_games else F.count("*")
    return association.groupBy(key).agg(n.alias("n_games"), F.array_sort(F.collect_set(counter)).alias("counters"))


def scored_position_summary(fen: DataFrame) -> DataFrame:
    """By advantage bucket: positions, appearances and the sum of absolute scores; every bucket has a row."""
    rows = fen.where("score IS NOT NULL").select(advantage_bucket("score").alias("bucket"), "n_games", F.abs("score").alias("size"))
    found = rows.groupBy("bucket").agg(F.count("*").alias("positions"), F.sum("n_games").alias("appearances"), F.sum("size").alias("abs_score_sum"))
    domain = fen.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    return domain.join(found, "bucket", "left").na.fill(0)


def scored_totals(fen: DataFrame) -> DataFrame:
    """One row: sides better, score sums, and win/draw/loss sums of complete rows."""
    side, complete = side_of("score"), F.col("wdl_win").isNotNull() & F.col("wdl_draw").isNotNull() & F.col("wdl_loss").isNotNull()
    sums = [F.coalesce(F.sum(F.when(complete, F.col(c))), F.lit(0.0)).alias(f"{c}_sum") for c in ("wdl_win", "wdl_draw", "wdl_loss")]
    sides = [F.count_if(side == s).alias(f"{s}_positions") for s in ("white", "black", "balanced")]
    return fen.where("score IS NOT NULL").agg(F.count("*").alias("scored"), *sides, F.coalesce(F.sum("score"), F.lit(0)).alias("score_sum"), F.coalesce(F.sum(F.abs("score")), F.lit(0)).alias("abs_score_sum"), *sums, F.count_if(complete).alias("wdl_rows"))


def game_analysis_summary(association: DataFrame, fen: DataFrame, links: DataFrame | None = None, join: Callable[[DataFrame, DataFrame, str], DataFrame] = skew_join) -> DataFrame:
    """By game: coverage, scores and buckets of its distinct positions' edges. Edges without a position vanish. join: how edges meet positions."""
    edges = association if links is None else association.join(links, association["game_link"] == links["link"], "left_semi")
    rows = join(edges, fen.select(F.col("fen").alias("fen_fen"), "score"), "fen_fen")
    bucket = advantage_bucket("score")
    out = rows.groupBy(F.col("game_link").alias("link")).agg(
        F.count("*").alias("total_positions"),
        F.count("score").alias("analyzed_positions"),
        F.count_if(F.col("score").isNull()).alias("unscored_positions"),
        F.coalesce(F.sum("score"), F.lit(0)).alias("score_sum"),
        F.coalesce(F.sum(F.abs("score")), F.lit(0)).alias("abs_score_sum"),
        F.max(F.abs("score")).alias("max_abs_score"),
        *[F.count_if(bucket == b).alias(f"{b}_positions") for b in BUCKETS],
    )
    return with_averages(out)


def with_averages(gas: DataFrame) -> DataFrame:
    """The columns that follow from counts and sums."""
    gas = gas.withColumn("is_fully_analyzed", F.col("unscored_positions") == 0)
    gas = gas.withColumn("avg_score", F.try_divide("score_sum", "analyzed_positions"))
    return gas.withColumn("avg_abs_score", F.try_divide("abs_score_sum", "analyzed_positions"))


def coverage_overview(gas: DataFrame) -> DataFrame:
    return gas.where("total_positions > 0").agg(F.count("*").alias("games"), F.count_if("is_fully_analyzed").alias("fully"), F.count_if(~F.col("is_fully_analyzed")).alias("incomplete"), F.sum("total_positions").alias("positions"), F.sum("analyzed_positions").alias("analyzed"))


def coverage_sums(gas: DataFrame) -> DataFrame:
    """One row: games, and their positions in all, analysed and unscored."""
    sums = {"positions": "total_positions", "analyzed": "analyzed_positions", "unscored": "unscored_positions"}
    return gas.where("total_positions > 0").agg(F.count("*").alias("games"), *[F.sum(c).alias(n) for n, c in sums.items()])


def player_coverage(gp: DataFrame, gas: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return gp.join(gas, "link", "left").groupBy("player_name").agg(F.count("*").alias("games"), zero("total_positions"), zero("analyzed_positions"), zero("unscored_positions"))


def coverage_page(gas: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    return paginate(gas, order, page, size)


def scored_positions(fen: DataFrame, order: str = "impact", least: int = 0, page: int = 1, size: int = 20) -> DataFrame:
    rows = scored_min(fen, least).select("fen", "n_games", "score", impact("n_games", "score").alias("impact"))
    return paginate(rows, scored_order(order), page, size)


def sum_n_games(fen: DataFrame, least: int) -> DataFrame:
    return fen.where(F.col("n_games") > least).agg(F.coalesce(F.sum("n_games"), F.lit(0)).alias("sum_n_games"))


def top_fens(fen: DataFrame, limit: int, unscored: bool = False) -> DataFrame:
    rows = fen.where("score IS NULL") if unscored else fen
    return rows.orderBy(F.col("n_games").desc(), F.col("fen")).limit(limit)


def edges_of_top(association: DataFrame, fen: DataFrame, limit: int, unscored: bool = False) -> DataFrame:
    """Edges to the positions that occur most."""
    top = top_fens(fen, limit, unscored).select(F.col("fen").alias("fen_fen"))
    return association.join(F.broadcast(top), "fen_fen", "left_semi")


def with_n_games(scored: DataFrame, fen: DataFrame) -> DataFrame:
    """Newly scored positions with the games they occur in; unknown positions vanish."""
    return scored.join(fen.select("fen", "n_games"), "fen")


def player_positions(fen: DataFrame, association: DataFrame, gp: DataFrame, approximate: bool = False) -> DataFrame:
    """By player: distinct positions, those seen once, more often, and scored."""
    edges = association.join(gp.select(F.col("link").alias("game_link"), "player_name").distinct(), "game_link")
    rows = skew_join(edges.select("player_name", "fen_fen").distinct(), fen.select(F.col("fen").alias("fen_fen"), "n_games", "score"), "fen_fen")
    if approximate:
        return edges.groupBy("player_name").agg(F.approx_count_distinct("fen_fen").alias("positions"))
    return rows.groupBy("player_name").agg(F.count("*").alias("positions"), F.count_if(F.col("n_games") == 1).alias("once"), F.count_if(F.col("n_games") > 1).alias("more"), F.count("score").alias("scored"))


def player_unscored(fen: DataFrame, association: DataFrame, gp: DataFrame, player: str, size: int) -> DataFrame:
    """A player's next positions to evaluate."""
    mine = association.join(gp.where(F.col("player_name") == player).select(F.col("link").alias("game_link")), "game_link", "left_semi").select(F.col("fen_fen").alias("fen"))
    return fen.where("score IS NULL").join(mine, "fen", "left_semi").orderBy(F.col("n_games").desc(), F.col("fen")).limit(size)


def advantage_by_rating(game: DataFrame, gas: DataFrame, k: int = 3, rating: str = "avg_elo") -> DataFrame:
    """Fully analysed games in natural groups of mean rating: games and bucket totals, one row a group and bucket."""
    rows = gas.where("is_fully_analyzed AND total_positions > 0").join(game.select("link", F.round(rating).cast("int").alias("rating")), "link").where("rating IS NOT NULL")
    rows = written(rows)  # read twice: for the histogram, and for the groups' sums
    breaks = natural_breaks(rows.groupBy("rating").agg(F.count("*").alias("n")), k, "rating")
    told = classify(rows, breaks, "rating", "group")
    sums = told.groupBy("group").agg(F.count("*").alias("games"), F.sum("total_positions").alias("positions"), F.min("rating").alias("low"), F.max("rating").alias("high"), *[F.sum(f"{b}_positions").alias(b) for b in BUCKETS])
    return melt(sums, ["group", "games", "positions", "low", "high"], list(BUCKETS), "bucket", "n")


def ranked_games(game: DataFrame, gas: DataFrame, rating: str = "avg_elo") -> DataFrame:
    """Each analysed game's place by rating among all, and their number."""
    rows = gas.where("is_fully_analyzed").join(game.select("link", F.col(rating).alias("rating")), "link").select("rating", "link", "avg_abs_score")
    return global_rank(rows, ["rating", "link"], total="total")


def ranked_groups(game: DataFrame, gas: DataFrame, rating: str = "avg_elo", labels: tuple[str, ...] = ("bad", "medium", "great")) -> DataFrame:
    """ranked_games with the label of the natural group of the rounded rating."""
    rows = ranked_games(game, gas, rating).withColumn("value", F.round("rating").cast("int"))
    breaks = natural_breaks(rows.groupBy("value").agg(F.count("*").alias("n")), len(labels))
    told = classify(rows, breaks, "value", "class")
    return told.withColumn("label", F.get(F.array(*[F.lit(x) for x in labels]), F.col("class"))).drop("value", "class")


ENGINE = "array<struct<score:double,pv:array<string>,wdl:array<int>,time:double,tbhits:bigint>>"


def read_evaluations(df: DataFrame, text: str = "analysis") -> DataFrame:
    """Engine answers as an array, whether the text holds one object or a list of them."""
    t = F.trim(F.col(text))
    return df.withColumn(text, F.from_json(F.when(t.startswith("["), t).otherwise(F.concat(F.lit("["), t, F.lit("]"))), ENGINE))


def best_lines(evaluations: DataFrame) -> DataFrame:
    """fen, score, next_moves and win/draw/loss of the first line of valid answers."""
    first = F.get("analysis", 0)
    wdl = [F.get(first["wdl"], i).cast("double").alias(n) for i, n in enumerate(("wdl_win", "wdl_draw", "wdl_loss"))]
    return evaluations.where(F.col("is_valid") & (F.size("analysis") > 0)).select("fen", first["score"].alias("score"), F.array_join(first["pv"], " ").alias("next_moves"), *wdl)


def continuations(evaluations: DataFrame) -> DataFrame:
    """fen, rank 2 to 4, first move and score of the other lines."""
    rows = evaluations.where("is_valid").select("fen", F.posexplode(F.slice("analysis", 2, 3)).alias("p", "line"))
    return rows.select("fen", (F.col("p") + 2).alias("rank"), F.get(F.col("line.pv"), 0).alias("move"), F.col("line.score").alias("score")).where("move IS NOT NULL")


def timing_rows(evaluations: DataFrame) -> DataFrame:
    """Valid answers with a time and without tablebase hits."""
    looked_up = F.exists("analysis", lambda x: F.coalesce(x["tbhits"], F.lit(0)) > 0)
    return evaluations.where(F.col("is_valid") & F.col("elapsed_ms").isNotNull() & ~F.coalesce(looked_up, F.lit(False)))


def clean_scored(rows: DataFrame, key: str = "fen", score: str = "score", arrival: str = "arrival") -> DataFrame:
    """The first row of each key; blank keys go, an unreadable score is 0."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(arrival))
    rows = rows.where(F.trim(F.col(key)) != "").withColumn("__place", first).where("__place = 1").drop("__place")
    return rows.withColumn(score, F.coalesce(F.col(score).try_cast("double"), F.lit(0.0)))
