"""Monthly archives of games and player profiles: JSON in, tables out, without any Python per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators.tables import game_players

_SIDE = "struct<username:string,rating:int,result:string>"
GAME = f"struct<url:string,pgn:string,time_control:string,eco:string,white:{_SIDE},black:{_SIDE}>"
ARCHIVE = f"games array<{GAME}>"


def read_archives(spark: SparkSession, path: str, repair: bool = False) -> tuple[DataFrame, DataFrame]:
    """(games, broken): a row for each game, and the files that can't be read.

    Months lie under player=.../year=.../month=...; months without games give no rows. With repair,
    raw control characters inside strings become spaces before parsing.
    """
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", False).text(path).withColumn("file", F.input_file_name())
    text = F.regexp_replace("value", r"[\x00-\x1F]", " ") if repair else F.col("value")
    good = F.try_parse_json(text).isNotNull()
    parsed = raw.withColumn("archive", F.when(good, F.from_json(text, ARCHIVE)))
    keep = [x for x in ("player", "year", "month") if x in raw.columns]
    games = parsed.where("archive IS NOT NULL").select(*keep, "file", F.posexplode("archive.games").alias("arrival", "game")).select(*keep, "file", "arrival", "game.*")
    return games, parsed.where("archive IS NULL").select("file", "value")


def game_rows(raw: DataFrame) -> DataFrame:
    """`game` rows with their text (pgn) and the words of its moves. Games without a text, a link, a start or known results go; a repeated link stays so."""
    told = c.once(
        c.id_from_url("url").alias("link"),
        c.header_time("pgn", "Date", "StartTime").alias("played_at"),
        c.points_of("white.result").alias("white_result"),
        c.points_of("black.result").alias("black_result"),
        c.move_words("pgn").alias("words"),
    )
    rows = raw.where("pgn IS NOT NULL").select("*", told)
    rows = rows.where("link IS NOT NULL AND played_at IS NOT NULL AND white_result IS NOT NULL AND black_result IS NOT NULL").select(
        "link",
        c.canonical("white.username").alias("white"),
        c.canonical("black.username").alias("black"),
        F.col("white.rating").alias("white_elo"),
        F.col("black.rating").alias("black_elo"),
        "white_result",
        "black_result",
        F.col("white.result").alias("white_str_result"),
        F.col("black.result").alias("black_str_result"),
        "time_control",
        c.mode_of("time_control").alias("mode"),
        c.bonus_of("time_control").alias("bonus"),
        "played_at",
        c.elapsed_seconds("pgn", "played_at").alias("time_elapsed"),
        c.count_of("words").alias("n_moves"),
        F.coalesce(c.last_segment("eco"), F.lit("no_eco")).alias("eco"),
        "pgn",
        "words",
        F.lit(False).alias("fens_done"),
        *[F.col(x) for x in ("file", "arrival") if x in raw.columns],
    )
    return rows.withColumn("avg_elo", c.mean_rating("white_elo", "black_elo"))


def parsed_games(raw: DataFrame) -> DataFrame:
    """game_rows with their text; the last of a repeated link stays."""
    rows = game_rows(raw).drop("words")
    if "arrival" in rows.columns:  # by a window, so that columns nobody asks for, the texts above all, aren't shuffled
        place = F.row_number().over(Window.partitionBy("link").orderBy(F.col("file").desc(), F.col("arrival").desc()))
        return rows.withColumn("__place", place).where("__place = 1").drop("__place", "file", "arrival")
    return rows.groupBy("link").agg(F.max(F.struct(*[F.col(x) for x in rows.columns])).alias("r")).select("r.*").drop("file")


def parsed_moves(games: DataFrame) -> DataFrame:
    """`moves` rows from the games' texts, with clocks and reaction times."""
    return moves_of(games.select("link", "bonus", c.move_tokens("pgn").alias("tokens"), c.clock_seconds("pgn").alias("clocks")))


def moves_of(games: DataFrame) -> DataFrame:
    """`moves` rows of games, one a link, with their tokens and clocks. A side's next clock lies in the same game, so nothing is shuffled."""
    n, half = F.col("n_move"), F.size("tokens")
    rows = games.where(half > 0).select("link", "bonus", "tokens", "clocks", F.explode(F.sequence(F.lit(1), F.ceil(half / 2).cast("int"))).alias("n_move"))
    at = lambda k: F.coalesce(F.get("clocks", 2 * n - k), F.lit(0.0))
    spent = lambda k: F.round(F.when(2 * n < half, F.abs(at(k) - at(k - 2))).otherwise(F.lit(0.0)) + F.col("bonus"), 3)
    return rows.select(
        "link",
        "n_move",
        F.get("tokens", 2 * n - 2).alias("white_move"),
        F.coalesce(F.get("tokens", 2 * n - 1), F.lit("--")).alias("black_move"),
        at(2).alias("white_time_left"),
        at(1).alias("black_time_left"),
        spent(2).alias("white_reaction_time"),
        spent(1).alias("black_reaction_time"),
    )


def openings_of(games: DataFrame, more: list[str], low: int = 3, high: int = 10) -> DataFrame:
    """link, n_moves, opening, more: as positions.openings, of games with their tokens."""
    gap = F.array_position("tokens", "--")
    full = F.floor(F.when(gap > 0, gap - 1).otherwise(F.size("tokens")) / 2).cast("int")
    rows = games.where(full >= low).select("link", "tokens", *more, F.explode(F.sequence(F.lit(low), F.least(F.lit(high), full))).alias("n_moves"))
    return rows.select("link", "n_moves", F.array_join(F.slice("tokens", F.lit(1), 2 * F.col("n_moves")), " ").alias("opening"), *more)


def ingest(raw: DataFrame) -> dict[str, DataFrame]:
    """All tables of an archive: game, game_player, moves, game_opening, months."""
    from ..operators.games import month_ledger
    from ..operators.positions import openings

    games = parsed_games(raw)
    moves = parsed_moves(games)
    gp = game_players(games)
    opening = openings(moves).join(games.select("link", "mode", "avg_elo", "played_at"), "link")
    return {"game": games.drop("pgn", "bonus"), "game_player": gp, "moves": moves, "game_opening": opening, "months": month_ledger(gp)}


PROFILE = "username string, name string, url string, title string, avatar string, followers int, country string, location string, joined string, status string, is_streamer boolean, twitch_url string, verified boolean, league string"


def normalize_profile(df: DataFrame) -> DataFrame:
    """Profile JSON fields (as in PROFILE) to a player row; fields that the frame lacks are null."""
    kinds = {"is_streamer": "boolean", "verified": "boolean", "followers": "int"}
    plain = lambda n: F.col(n) if n in df.columns else F.lit(None).cast(kinds.get(n, "string")).alias(n)
    return df.select(
        c.canonical("username").alias("player_name"),
        *[plain(n) for n in ("name", "url", "title", "avatar", "followers")],
        c.last_segment("country").alias("country"),
        plain("location"),
        F.coalesce(F.col("joined").try_cast("long"), F.lit(0)).alias("joined"),
        *[plain(n) for n in ("status", "is_streamer", "twitch_url", "verified", "league")],
    )


def flatten_player_stats(df: DataFrame, modes: tuple[str, ...] = c.MODES) -> DataFrame:
    """Seven numbers a mode from nested statistics; a percentile of 0 counts as missing."""
    out = ["player_name"]
    for m in modes:
        s = F.col(f"chess_{m}")
        share = F.coalesce(F.nullif(s["last"]["percentile"], F.lit(0.0)), s["last"]["percentage_rank"])
        fields = {"rating": s["last"]["rating"], "percentile": share, "best": s["best"]["rating"], "games": s["record"]["game_count"], "wins": s["record"]["win"], "losses": s["record"]["loss"], "draws": s["record"]["draw"]}
        out += [v.alias(f"{m}_{k}") for k, v in fields.items()]
    return df.select(*out)


def flatten_other_stats(df: DataFrame) -> DataFrame:
    """The four numbers of a player that no mode has."""
    tactics = F.col("tactics")
    return df.select(
        "player_name",
        "fide",
        F.col("puzzle_rush")["best"]["score"].alias("puzzle_rush_best"),
        tactics["highest"]["rating"].alias("tactics_highest"),
        tactics["lowest"]["rating"].alias("tactics_lowest"),
    )
