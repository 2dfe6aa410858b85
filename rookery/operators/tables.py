"""Filters, paging and reshaping that the analytical queries share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import MODES, is_main
from .paging import page_bounds, page_with_total, paginate  # noqa: F401  part of this module's functions
from .storage import shared_folder, written  # noqa: F401


def read_where(df: DataFrame, **equal) -> DataFrame:
    """Rows with these values; the conditions reach the scan."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), equal.items(), df)


def read_game(games: DataFrame, link: int) -> DataFrame:
    return games.where(F.col("link") == link)


def run_sql(spark: SparkSession, sql: str, params: dict | None = None, **tables: DataFrame) -> DataFrame:
    """Parametrised SQL over frames given by name, e.g. run_sql(spark, "select * from {g} where x > :k", {"k": 1}, g=df)."""
    return spark.sql(sql, args=params or {}, **tables)


def rating_between(df: DataFrame, col: str, low: int | None, high: int | None) -> DataFrame:
    """Inclusive; either bound missing means no filter, and crossed bounds are swapped."""
    if low is None or high is None:
        return df
    low, high = min(low, high), max(low, high)
    return df.where(F.col(col).between(low, high))


def require_mode(df: DataFrame, mode: str, col: str = "mode", modes: Sequence[str] = MODES) -> DataFrame:
    """Rows of a known mode; none for an unknown one."""
    mode = (mode or "").strip().lower()
    return df.where(F.col(col) == mode) if mode in modes else df.where(F.lit(False))


def pick(color: str, white: str, black: str) -> str:
    """The column of a colour; anything but black means white."""
    return black if (color or "").strip().lower() == "black" else white


def scored_min(df: DataFrame, least: int, score: str = "score") -> DataFrame:
    least = max(0, min(10000, least))
    return df.where(F.col(score).isNotNull() & (F.abs(F.col(score)) >= least))


def coverage_filter(df: DataFrame, status: str) -> DataFrame:
    df = df.where("total_positions > 0")
    if status == "fully":
        return df.where("is_fully_analyzed")
    return df.where("NOT is_fully_analyzed") if status == "incomplete" else df


def named_players(players: DataFrame) -> DataFrame:
    return players.where("name IS NOT NULL").select("player_name", "name")


def current_players(players: DataFrame) -> DataFrame:
    """Null counts as not joined."""
    return players.where(is_main("joined"))


SCORED_ORDERS = {
    "frequency": lambda: [F.col("n_games").desc(), F.col("fen").asc()],
    "impact": lambda: [F.col("impact").desc(), F.col("n_games").desc(), F.col("fen").asc()],
    "evaluation": lambda: [F.abs("score").desc(), F.col("n_games").desc(), F.col("fen").asc()],
}
COVERAGE_ORDERS = {
    "recent": lambda: [F.col("played_at").desc_nulls_last(), F.col("link").desc()],
    "coverage": lambda: [F.try_divide("analyzed_positions", "total_positions").desc_nulls_last(), F.col("link").desc()],
    "advantage": lambda: [F.col("avg_abs_score").desc_nulls_last(), F.col("link").desc()],
}


def scored_order(name: str) -> list[Column]:
    return SCORED_ORDERS.get(name, SCORED_ORDERS["impact"])()


def coverage_order(name: str) -> list[Column]:
    return COVERAGE_ORDERS.get(name, COVERAGE_ORDERS["recent"])()


def next_batch(positions: DataFrame, size: int) -> DataFrame:
    """Unscored positions that occur most."""
    return positions.where("score IS NULL").orderBy(F.col("n_games").desc(), F.col("fen")).limit(size)


def sample_n(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash of their key: a random sample that reruns repeat."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def sample_by_digest(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded MD5 of their key, which other systems can repeat."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def ranges_df(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small constant relation."""
    return spark.createDataFrame(list(rows), schema)


def two_sides(df: DataFrame, white: dict[str, str], black: dict[str, str], keep: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Each row as two, one a side, in a single scan. white and black: output column to source column."""
    sides = [F.struct(F.lit(name).alias("color"), *[F.col(src).alias(out) for out, src in cols.items()]) for name, cols in (("white", white), ("black", black))]
    out = df.select(*keep, F.explode(F.array(*sides)).alias("__side")).select(*keep, "__side.*")
    return out if where is None else out.where(where)


def game_players(games: DataFrame) -> DataFrame:
    """`game` as one row for each player of a game."""
    names = {"player_name": "white", "opponent_name": "black", "result": "white_result", "rating": "white_elo", "opponent_rating": "black_elo"}
    flipped = {"player_name": "black", "opponent_name": "white", "result": "black_result", "rating": "black_elo", "opponent_rating": "white_elo"}
    return two_sides(games, names, flipped, ["link", "mode", "played_at", "eco", "n_moves", "time_elapsed", "avg_elo"])


def melt(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """Columns to rows."""
    return df.unpivot(list(keys), list(values), name, value)


def zero_filled(df: DataFrame, domain: DataFrame, key: str, counts: Sequence[str]) -> DataFrame:
    """A row for each value of a small fixed domain."""
    return domain.join(df, key, "left").na.fill(0, list(counts))


def month_range(df: DataFrame, first: str, as_of: Column, keep: Sequence[str]) -> DataFrame:
    """Every month from a date to another, both included; nothing where the first lies after."""
    start, end = F.trunc(F.col(first), "MM"), F.trunc(as_of, "MM")
    months = F.when(start <= end, F.sequence(start, end, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))
    return df.select(*keep, F.explode(months).alias("month"))


def global_rank(df: DataFrame, order: Sequence[str], rank: str = "rank", partitions: int | None = None, total: str | None = None) -> DataFrame:
    """row_number over all rows without a single-partition window; `total` names a column with their number.

    Rows are range-partitioned by the order once and written; each partition's rows are numbered on
    their own and lifted by the sizes of those before, one small row a partition. Written, the partitions
    stay what they were when an executor is lost.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__size"))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = [F.coalesce(F.sum("__size").over(upto), F.lit(0)).alias("__before"), F.sum("__size").over(Window.partitionBy(F.lit(0))).alias("__total")]
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    told = dealt.join(F.broadcast(sizes.select("__part", *counts)), "__part").withColumn(rank, F.col("__before") + own)
    return (told if total is None else told.withColumn(total, F.col("__total"))).drop("__part", "__before", "__total")
