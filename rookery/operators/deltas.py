"""Summaries kept up to date by deltas instead of rescans. merge(refresh(old), delta(new)) equals refresh(all)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .positions import with_averages


def merge_counts(summary: DataFrame, delta: DataFrame, counts: Sequence[str], floor: bool = True) -> DataFrame:
    """One-row summaries: counts are added, never below 0."""
    both = summary.select([F.col(c).alias(f"__a_{c}") for c in counts]).crossJoin(F.broadcast(delta.select([F.col(c).alias(f"__b_{c}") for c in counts])))
    total = lambda c: F.col(f"__a_{c}") + F.coalesce(F.col(f"__b_{c}"), F.lit(0))
    return both.select([(F.greatest(total(c), F.lit(0)) if floor else total(c)).alias(c) for c in counts])


def merge_totals(summary: DataFrame, delta: DataFrame) -> DataFrame:
    """Database totals and what a batch adds, which is never below 0; unscored positions can become fewer."""
    grown = delta.select([F.col(c) if c == "unscored_positions" else F.greatest(F.col(c), F.lit(0)).alias(c) for c in delta.columns])
    return merge_counts(summary, grown, summary.columns)


def merge_scored_totals(summary: DataFrame, delta: DataFrame) -> DataFrame:
    """scored_totals and those of newly scored positions: sides, score sums and win/draw/loss sums with their rows are added."""
    return merge_counts(summary, delta, summary.columns, floor=False)


def merge_keyed(summary: DataFrame, delta: DataFrame, keys: Sequence[str], sums: Sequence[str] = (), most: Sequence[str] = ()) -> DataFrame:
    """Keyed summaries: sums are added and maxima merged; new keys appear."""
    cols = [*keys, *sums, *most]
    both = summary.select(*cols).unionByName(delta.select(*cols)).groupBy(*keys)
    return both.agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in most])


def merge_game_analysis(gas: DataFrame, delta: DataFrame, buckets: Sequence[str]) -> DataFrame:
    """Newly scored positions of games: counts move from unscored to analysed within what is there, averages follow from sums.

    delta: link, newly, score_sum, abs_score_sum, max_abs_score and a count for each bucket.
    """
    d = delta.select("link", *[F.col(c).alias(f"__{c}") for c in delta.columns if c != "link"])
    rows = gas.join(d.hint("merge"), "link", "left")  # files of deltas are small, but what is broadcast of them isn't
    zero = lambda c: F.coalesce(F.col(f"__{c}"), F.lit(0))
    new: dict[str, Column] = {
        "analyzed_positions": F.least(F.col("analyzed_positions") + zero("newly"), F.col("total_positions")),
        "unscored_positions": F.greatest(F.col("unscored_positions") - zero("newly"), F.lit(0)),
        "score_sum": F.col("score_sum") + zero("score_sum"),
        "abs_score_sum": F.col("abs_score_sum") + zero("abs_score_sum"),
        "max_abs_score": F.greatest("max_abs_score", "__max_abs_score"),
        **{f"{b}_positions": F.col(f"{b}_positions") + zero(f"{b}_positions") for b in buckets},
    }
    return with_averages(rows.select("link", "total_positions", *[c.alias(n) for n, c in new.items()]))


def affected(summary_of, rows: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """summary_of the rows whose keys a batch touches: what has to replace the old rows of these keys."""
    return summary_of(rows.join(batch.select(*keys).distinct(), list(keys), "left_semi"))
