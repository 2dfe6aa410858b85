"""Weighted natural breaks (least squared deviation classes) of a histogram, and how well classes fit.

Spark makes the histogram, which is the only thing that grows with the rows. Over its sorted values, prefix sums turn
the cost of a class into a subtraction. The best start of the last class never moves back as the end moves on, so
each further class takes a divide and conquer over the ends: the middle end's best start bounds those of both halves,
and all middles of a depth are searched together, in O(n log n) for n values. That is one task on the histogram, some
24 bytes a value; beyond `MOST` values `binned` coarsens it first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values that a histogram may have.
MOST = 4_000_000


def binned(df: DataFrame, value: str, bins: int) -> DataFrame:
    """At most so many distinct values: each becomes the lower edge of a regular bin."""
    ends = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    width = F.greatest((F.col("__hi") - F.col("__lo")) / bins, F.lit(1e-12))
    cell = F.least(F.floor((F.col(value) - F.col("__lo")) / width), F.lit(bins - 1))
    return df.crossJoin(F.broadcast(ends)).withColumn(value, F.col("__lo") + cell * width).drop("__lo", "__hi")


def _best_starts(before: np.ndarray, sums: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Costs and starts for each end from `first` on: before[a] + the cost of the places after a up to the end, least over a < end.

    sums: prefix sums of w, w x and w x^2 in rows, with a column of zeros first. Ends and a count places; a is at least first - 1.
    """
    sw, sx, sq = sums
    size = sums.shape[1] - 1
    cost, start = np.full(size + 1, np.inf), np.zeros(size + 1, dtype=np.int64)
    low, high = np.array([first]), np.array([size])  # ends of each part still open
    least, most = np.array([first - 1]), np.array([size - 1])  # what its starts lie between
    while len(low):
        middle = (low + high) // 2
        stop = np.minimum(most, middle - 1)
        n = stop - least + 1
        upto = np.cumsum(n)
        a = np.repeat(least - upto + n, n) + np.arange(upto[-1])
        b = np.repeat(middle, n)
        dx = sx[b] - sx[a]
        each = before[a] + np.maximum((sq[b] - sq[a]) - dx * dx / (sw[b] - sw[a]), 0.0)
        begin = upto - n
        found = np.minimum.reduceat(each, begin)
        place = np.where(each == np.repeat(found, n), np.arange(len(each)), len(each))
        at = a[np.minimum.reduceat(place, begin)]
        cost[middle], start[middle] = found, at
        left, right = middle > low, middle < high
        low, high, least, most = (np.concatenate([x[left], y[right]]) for x, y in ((low, middle + 1), (middle - 1, high), (least, at), (at, most)))
    return cost, start


def layers(value: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, list[float], list[np.ndarray]]:
    """Prefix sums of sorted values, and for 1, ..., k classes the total cost and the best start of the last class by end."""
    x, w = value.astype(float), weight.astype(float)
    sums = np.zeros((3, len(x) + 1))
    sums[:, 1:] = np.cumsum([w, w * x, w * x * x], axis=1)
    sw, sx, sq = sums[:, 1:]
    cost = np.concatenate([[np.inf], np.maximum(sq - sx * sx / sw, 0.0)])
    costs, starts = [float(cost[-1])], [np.zeros(len(x) + 1, dtype=np.int64)]
    for classes in range(2, k + 1):
        cost, start = _best_starts(cost, sums, classes)
        costs.append(float(cost[-1]))
        starts.append(start)
    return sums, costs, starts


def _on_histogram(histogram: DataFrame, value: str, weight: str, most: int, schema: str, told: Callable[[pa.Array, np.ndarray], dict]) -> DataFrame:
    """What `told` makes of the sorted values and their weights, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n > most:
                raise ValueError(f"more than {most} values: use binned() first")
        if n:
            table = pa.Table.from_batches(held)
            yield pa.RecordBatch.from_pydict(told(table.column(0).combine_chunks(), table.column(1).to_numpy()))

    rows = histogram.where(F.col(value).isNotNull()).select(F.col(value).alias("value"), F.col(weight).cast("double").alias("weight"))
    return rows.repartition(1).sortWithinPartitions("value").mapInArrow(run, schema)


def natural_breaks(histogram: DataFrame, k: int = 3, value: str = "value", weight: str = "n", most: int = MOST) -> DataFrame:
    """One row a class: class (0, ...), start_i, low, high, weight, and the total cost. Ties take the smallest start of the last class.

    Fewer values than classes: one class for each value.
    """

    def told(values: pa.Array, weights: np.ndarray) -> dict:
        n = len(values)
        classes = min(k, n)
        sums, costs, starts = layers(values.to_numpy(zero_copy_only=False), weights, classes)
        ends = [n]
        for start in starts[:0:-1]:
            ends.insert(0, int(start[ends[0]]))
        begins = np.array([0, *ends[:-1]])
        last = np.array(ends) - 1
        low, high = values.take(pa.array(begins)), values.take(pa.array(last))
        return {"class": pa.array(np.arange(classes), pa.int32()), "start_i": pa.array(begins + 1, pa.int32()), "low": low, "high": high, "weight": pa.array(sums[0][last + 1] - sums[0][begins]), "cost": pa.array([costs[-1]] * classes)}

    kind = histogram.schema[value].dataType.simpleString()
    return _on_histogram(histogram, value, weight, most, f"class int, start_i int, low {kind}, high {kind}, weight double, cost double", told)


def classify(df: DataFrame, breaks: DataFrame, value: str, label: str = "class") -> DataFrame:
    """The class of each row: a range join to a few broadcast rows. Values between classes go to the lower one."""
    edges = breaks.select(F.col("low").alias("__low"), F.lead("low").over(Window.orderBy("class")).alias("__next"), F.col("class").alias(label))
    return df.join(F.broadcast(edges), (F.col(value) >= F.col("__low")) & (F.col("__next").isNull() | (F.col(value) < F.col("__next"))), "left").drop("__low", "__next")


def goodness(histogram: DataFrame, breaks: DataFrame, value: str = "value", weight: str = "n") -> DataFrame:
    """Share of the variance that the classes explain, in one row: gvf."""
    x, w = F.col(value).cast("double"), F.col(weight).cast("double")
    total = histogram.agg((F.sum(w * x * x) - F.sum(w * x) * F.sum(w * x) / F.sum(w)).alias("total"))
    within = breaks.agg(F.max("cost").alias("within"))
    return total.crossJoin(within).select(F.coalesce(1 - F.try_divide("within", "total"), F.lit(1.0)).alias("gvf"))


def sweep(histogram: DataFrame, ks: range = range(2, 11), value: str = "value", weight: str = "n", most: int = MOST) -> DataFrame:
    """gvf for each number of classes, all from one search."""

    def told(values: pa.Array, weights: np.ndarray) -> dict:
        sums, costs, _ = layers(values.to_numpy(zero_copy_only=False), weights, min(max(ks), len(values)))
        w, x, q = sums[:, -1]
        total = q - x * x / w
        fits = [1 - costs[min(k, len(costs)) - 1] / total if total else 1.0 for k in ks]
        return {"k": pa.array(list(ks), pa.int32()), "gvf": pa.array(fits, pa.float64())}

    return _on_histogram(histogram, value, weight, most, "k int, gvf double", told)
