"""Tables laid out for lookups: a key's rows lie together, and a reader skips the row groups that can't have a key.

Rows are dealt by ranges of the whole order and sorted, so the smallest and largest key of a row group name what it has; a key with
more rows than a task should write goes over several files, since the order's later columns split it. Other columns that rows are looked up
by have no such order: they get a Bloom filter for each row group, which a reader asks before it reads the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group: smaller groups are skipped more finely, at some more metadata.
GROUP = 16 << 20
#: Share of absent keys that a Bloom filter lets through.
FALSE = 0.01


def write_for_lookups(df: DataFrame, path: str, order: Sequence[str], blooms: Sequence[str] = (), distinct: int = 1_000_000, files: int | None = None, group: int = GROUP) -> None:
    """Write df in `order`, whose first column is its key. blooms: further columns to look rows up by.

    distinct: keys that a Bloom filter expects in a row group; more make it let through more, never too little.
    files: ranges; otherwise as many as adaptive execution finds right for the size.
    """
    ranged = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    out = ranged.sortWithinPartitions(*order).write.mode("overwrite").option("parquet.block.size", str(group)).option("compression", "zstd")
    for c in blooms:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(distinct)).option(f"parquet.bloom.filter.fpp#{c}", str(FALSE))
    out.parquet(path)


def write_games(game: DataFrame, path: str, **how) -> None:
    """Games by link: read_game reads the one row group that may have it."""
    write_for_lookups(game, path, ["link"], **how)


def write_player_games(gp: DataFrame, path: str, **how) -> None:
    """Both sides' rows by player and time, so a player's page reads the player's row groups; rows of one game by its link's Bloom filter."""
    write_for_lookups(gp, path, ["player_name", "played_at", "link", "color"], blooms=["link"], **how)


def lookup(spark: SparkSession, path: str, column: str, values: Sequence) -> DataFrame:
    """Rows with one of a few values, as a filter that reaches the row groups. Nulls and repeats among the values have no effect."""
    wanted = sorted({v for v in values if v is not None})
    rows = spark.read.parquet(path)
    return rows.where(F.col(column).isin(wanted)) if wanted else rows.limit(0)
