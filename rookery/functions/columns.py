"""Column functions: predicates, labels, bins and text parsing of game records.

They only build expressions, so Catalyst prunes, pushes down and compiles them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Result words by points.
WIN = ("win", "kingofthehill")
DRAW = ("50move", "agreed", "insufficient", "repetition", "stalemate", "timevsinsufficient")
LOSS = ("checkmated", "resigned", "threecheck", "timeout", "abandoned")
MODES = ("bullet", "blitz", "rapid")
BUCKETS = ("equal", "small", "clear", "decisive", "mate")
#: Upper edges of the advantage buckets, in centipawns; the last bucket is open.
EDGES = (50, 150, 300, 9000)
#: Edges of game-length bins, in minutes; the last bin is open.
MINUTES = (0, 1, 2, 3, 5, 10, 20, 40)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mode_of(time_control: Column | str) -> Column:
    """Game mode from a time control such as 600+5 or 1/86400."""
    c = F.trim(_col(time_control))
    first = F.substring_index(c, "+", 1)
    seconds = F.when(F.regexp_like(first, F.lit("^[0-9]+$")), first.try_cast("int"))
    timed = F.when(seconds < 180, "bullet").when(seconds < 600, "blitz").when(seconds <= 1800, "rapid").when(seconds.isNotNull(), "classical")
    return F.when(c.contains("/"), "daily").otherwise(F.coalesce(timed, F.lit("unknown")))


def bonus_of(time_control: Column | str) -> Column:
    """Seconds added a move: what follows the plus sign, else 0."""
    return F.coalesce(F.split_part(F.trim(_col(time_control)), F.lit("+"), F.lit(2)).try_cast("double"), F.lit(0.0))


def played_at(year: str, month: str, day: str, hour: str, minute: str, second: str) -> Column:
    return F.make_timestamp(*[F.col(c) for c in (year, month, day, hour, minute, second)])


def mean_rating(white: Column | str, black: Column | str) -> Column:
    return (_col(white) + _col(black)) / 2.0


def points_of(result: Column | str) -> Column:
    """1, 0.5 or 0 by the word of a result; null for an unknown word."""
    c = F.lower(F.trim(_col(result)))
    return F.when(c.isin(*WIN), 1.0).when(c.isin(*DRAW), 0.5).when(c.isin(*LOSS), 0.0)


def result_label(points: Column | str) -> Column:
    c = _col(points)
    return F.when(c == 1.0, "win").when(c == 0.5, "draw").when(c == 0.0, "loss").otherwise("unknown")


def result_score(word: str | None) -> float:
    """Points of a result parameter; anything unknown asks for wins."""
    return {"loss": 0.0, "draw": 0.5}.get((word or "").strip().lower(), 1.0)


def is_real_token(c: Column | str) -> Column:
    c = _col(c)
    return c.isNotNull() & (c != "") & (c != "--")


def is_main(joined: Column | str) -> Column:
    return F.coalesce(_col(joined), F.lit(0)) != 0


def canonical(name: Column | str) -> Column:
    """Lower-cased and trimmed; null where nothing is left."""
    return F.nullif(F.lower(F.trim(_col(name))), F.lit(""))


def advantage_bucket(score: Column | str) -> Column:
    size = F.abs(_col(score))
    return reduce(lambda w, e: w.when(size < e[1], e[0]), zip(BUCKETS[1:], EDGES[1:], strict=False), F.when(size < EDGES[0], BUCKETS[0])).when(size >= EDGES[-1], BUCKETS[-1])


def side_of(score: Column | str) -> Column:
    c = _col(score)
    return F.when(c > 50, "white").when(c < -50, "black").when(c.isNotNull(), "balanced")


def impact(n_games: Column | str, score: Column | str) -> Column:
    return _col(n_games) * F.abs(_col(score))


def floor_bin(c: Column | str, width: int) -> Column:
    """The lower edge of regular bins."""
    return (F.floor(_col(c) / width) * width).cast("long")


def labelled_bin(c: Column | str, edges: tuple[int, ...] = MINUTES) -> Column:
    """struct(label, place) of irregular bins [edge, next edge); the last bin is open."""
    c = _col(c)
    cell = lambda i, label: F.struct(F.lit(label).alias("label"), F.lit(i + 1).alias("place"))
    out = F.when(c < edges[1], cell(0, f"{edges[0]}-{edges[1]}"))
    for i in range(1, len(edges) - 1):
        out = out.when(c < edges[i + 1], cell(i, f"{edges[i]}-{edges[i + 1]}"))
    return out.when(c.isNotNull(), cell(len(edges) - 1, f"{edges[-1]}+"))


def id_from_url(url: Column | str) -> Column:
    return F.element_at(F.split(_col(url), "/"), -1).try_cast("long")


def last_segment(url: Column | str) -> Column:
    return F.element_at(F.split(_col(url), "/"), -1)


def once(*columns: Column) -> Column:
    """These columns, computed once a row: conditions and columns that refer to them don't repeat what they are made of."""
    return F.inline(F.array(F.struct(*columns)))


def header(text: Column | str, name: str) -> Column:
    """Value of a [Name "value"] line; null where it is missing."""
    return F.nullif(F.regexp_extract(_col(text), rf'\[{name} "([^"]*)"\]', 1), F.lit(""))


def header_time(text: Column | str, day: str, clock: str) -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", header(text, day), header(text, clock)), F.lit("yyyy.MM.dd HH:mm:ss"))


def elapsed_seconds(text: Column | str, start: Column | str | None = None) -> Column:
    """From start to end; 0 where either is missing or malformed. start: where it is known already."""
    start, end = header_time(text, "Date", "StartTime") if start is None else _col(start), header_time(text, "EndDate", "EndTime")
    return F.coalesce(F.unix_timestamp(end) - F.unix_timestamp(start), F.lit(0)).cast("double")


#: How a game's moves end.
RESULTS = ("1-0", "0-1", "1/2-1/2", "*")


def move_text(pgn: Column | str) -> Column:
    """What follows the last header line."""
    return F.trim(F.regexp_replace(_col(pgn), r"(?s)^(?:\s*\[[^\]\n]*\]\s*\n)*", ""))


def bare_moves(pgn: Column | str) -> Column:
    """Move text without comments and results."""
    text = F.regexp_replace(move_text(pgn), r"\{[^}]*\}", " ")
    return F.trim(F.regexp_replace(text, r"(?:^|\s)(?:1-0|0-1|1/2-1/2|\*)(?=\s|$)", " "))


def move_words(pgn: Column | str) -> Column:
    """Half-moves, move numbers, results and empty words outside comments, in order."""
    return F.split(move_text(pgn), r"\s+|\{[^}]*\}")


def tokens_of(words: Column | str) -> Column:
    """Half-moves among words."""
    return F.filter(_col(words), lambda x: (x != "") & ~x.contains(".") & ~x.isin(*RESULTS))


def count_of(words: Column | str) -> Column:
    """The largest move number among words, 0 if there is none."""
    numbers = F.filter(_col(words), lambda x: x.contains("."))
    return F.coalesce(F.array_max(F.transform(numbers, lambda x: F.regexp_extract(x, r"^(\d+)\.", 1).try_cast("int"))), F.lit(0))


def move_tokens(pgn: Column | str) -> Column:
    """Half-moves in order; move numbers are dropped."""
    return tokens_of(move_words(pgn))


def move_count(pgn: Column | str) -> Column:
    """The largest move number in the text, 0 if there is none."""
    return count_of(move_words(pgn))


def clock_seconds(pgn: Column | str) -> Column:
    """Clock readings in order, in seconds; an unreadable one is 0."""
    readings = F.regexp_extract_all(_col(pgn), F.lit(r"%clk ([0-9:.]+)"), F.lit(1))

    def seconds(t: Column) -> Column:
        total = F.aggregate(F.split(t, ":"), F.lit(0.0), lambda acc, p: acc * 60 + p.try_cast("double"))
        return F.coalesce(F.round(total, 3), F.lit(0.0))

    return F.transform(readings, seconds)


def paired_moves(tokens: Column | str) -> Column:
    """array of struct(n_move, white, black); a missing last half-move is --."""

    def paired(t: Column) -> Column:
        steps = F.when(F.size(t) > 0, F.sequence(F.lit(1), F.ceil(F.size(t) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(steps, lambda n: F.struct(n.alias("n_move"), F.get(t, 2 * n - 2).alias("white"), F.coalesce(F.get(t, 2 * n - 1), F.lit("--")).alias("black")))

    return F.get(F.transform(F.array(_col(tokens)), paired), 0)  # tokens are computed once, not once for each move


def position_key(fen: Column | str) -> Column:
    """The first four fields of a position."""
    return F.substring_index(_col(fen), " ", 4)


def position_counter(fen: Column | str) -> Column:
    c = _col(fen)
    return F.concat(F.lit("#"), F.split_part(c, F.lit(" "), F.lit(5)), F.lit("_"), F.split_part(c, F.lit(" "), F.lit(6)))


def side_to_move(fen: Column | str) -> Column:
    return F.split_part(_col(fen), F.lit(" "), F.lit(2))


def position_hash(fen: Column | str) -> Column:
    return F.sha2(_col(fen).cast("binary"), 256)


def piece_count(fen: Column | str) -> Column:
    return F.length(F.regexp_replace(F.split_part(_col(fen), F.lit(" "), F.lit(1)), "[^A-Za-z]", ""))


def day_label(ts: Column | str) -> Column:
    """2024-JAN-05."""
    return F.upper(F.date_format(_col(ts), "yyyy-MMM-dd"))


def weekday(ts: Column | str) -> Column:
    """0 is Sunday."""
    return F.dayofweek(_col(ts)) - 1


def from_epoch(seconds: Column | str) -> Column:
    return F.to_date(F.timestamp_seconds(_col(seconds)))


def history_span(first: Column | str, as_of: Column | str) -> Column:
    """struct(days, years) from the first game to a day; at most 20 years."""
    days = F.datediff(_col(as_of), _col(first))
    return F.struct(days.alias("days"), F.least(F.floor(days / 365).cast("int"), F.lit(20)).alias("years"))
