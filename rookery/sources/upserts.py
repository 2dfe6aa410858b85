"""Inserts, upserts and replacements as frames; sinks write what they return.

Sides that are as large as a batch or a table meet in a shuffle: files of keys are small, but what is broadcast of them isn't.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    df.select(*columns).write.mode("append").parquet(path)


def new_only(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], arrival: str | None = None) -> DataFrame:
    """Rows whose key isn't stored; of repeated keys the last to arrive."""
    if arrival is None:
        rows = incoming.dropDuplicates(list(keys))
    else:
        last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(arrival).desc()))
        rows = incoming.withColumn("__place", last).where("__place = 1").drop("__place")
    return rows.join(stored.select(*keys).hint("merge"), list(keys), "left_anti")


def insert_ignore(target: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.unionByName(new_only(new, target, keys))


def upsert_replace(target: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows take the place of those with their key."""
    return target.join(new.select(*keys).distinct().hint("merge"), list(keys), "left_anti").unionByName(new)


def upsert_add(target: DataFrame, new: DataFrame, keys: Sequence[str], sums: Sequence[str], sets: Sequence[str] = ()) -> DataFrame:
    """Sums are added and sets (arrays) united, sorted; pre-aggregated before the shuffle."""
    both = target.select(*keys, *sums, *sets).unionByName(new.select(*keys, *sums, *sets)).groupBy(*keys)
    united = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in sets]
    return both.agg(*[F.sum(c).alias(c) for c in sums], *united)


def update_by_key(target: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns of matched rows are replaced, by null too. Of changes with the same key the largest counts, so no row is multiplied."""
    changes = changes.groupBy(key).agg(F.max(F.struct(*columns)).alias("__new")).select(key, "__new.*")
    new = changes.select(F.col(key), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    rows = target.join(new.hint("merge"), key, "left")
    return rows.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def replace_keys(target: DataFrame, new: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of the affected keys go; their new rows come."""
    return target.join(keys_df.select(*keys).distinct().hint("merge"), list(keys), "left_anti").unionByName(new)


def drop_orphans(target: DataFrame, source: DataFrame, key: str, scope: DataFrame | None = None) -> DataFrame:
    """Rows whose source is gone go; with a scope, only keys in it are looked at."""
    if scope is None:
        return target.join(source.select(key).distinct(), key, "left_semi")
    gone = scope.select(key).join(source.select(key), key, "left_anti").distinct()
    return target.join(gone, key, "left_anti")


def set_flag(df: DataFrame, condition: Column, value: bool, flag: str = "fens_done") -> DataFrame:
    return df.withColumn(flag, F.when(condition, F.lit(value)).otherwise(F.col(flag)))


def clear_scores(fen: DataFrame) -> DataFrame:
    return fen.withColumns({c: F.lit(None).cast(fen.schema[c].dataType) for c in ("score", "wdl_win", "wdl_draw", "wdl_loss") if c in fen.columns})


def write_singleton(df: DataFrame, path: str) -> None:
    """A one-row summary with the time of its refresh."""
    df.withColumn("id", F.lit(1)).withColumn("refreshed_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(path)


def to_payload(df: DataFrame, columns: Sequence[str], out: str = "payload") -> DataFrame:
    return df.withColumn(out, F.to_json(F.struct(*columns)))


def from_payload(df: DataFrame, column: str, schema: str, fallback: str = "{}") -> DataFrame:
    """Parsed JSON; text that can't be parsed counts as the fallback."""
    read = lambda c: F.from_json(c, schema, {"mode": "PERMISSIVE"})
    good = F.try_parse_json(F.col(column)).isNotNull()
    return df.withColumn(column, read(F.when(good, F.col(column)).otherwise(F.lit(fallback))))


def shell_players(games: DataFrame, players: DataFrame) -> DataFrame:
    """Names on either side that have no player row: new rows with joined 0."""
    names = games.select(F.explode(F.array("white", "black")).alias("player_name")).where("player_name IS NOT NULL").distinct()
    return names.join(players.select("player_name").hint("merge"), "player_name", "left_anti").withColumn("joined", F.lit(0).cast("long"))
