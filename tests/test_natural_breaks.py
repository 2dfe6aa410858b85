from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.operators import natural_breaks as nb


def brute(hist, k):
    """Least cost over all cuts."""
    x, w = np.array([h[0] for h in hist], float), np.array([h[1] for h in hist], float)

    def cost(a, b):
        mean = np.average(x[a:b], weights=w[a:b])
        return (w[a:b] * (x[a:b] - mean) ** 2).sum()

    best = None
    for cut in combinations(range(1, len(x)), k - 1):
        ends = [0, *cut, len(x)]
        total = sum(cost(a, b) for a, b in zip(ends, ends[1:]))
        if best is None or total < best[0] - 1e-9:
            best = (total, [a + 1 for a in ends[:-1]])
    return best


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_against_all_cuts(spark, k):
    rng = np.random.default_rng(k)
    hist = [(float(v), int(n)) for v, n in zip(sorted(rng.choice(200, 18, replace=False)), rng.integers(1, 9, 18))]
    got = nb.natural_breaks(spark.createDataFrame(hist, "value double, n long"), k).orderBy("class").collect()
    want = brute(hist, k)
    assert [r.start_i for r in got] == want[1] and got[0].cost == pytest.approx(want[0])
    assert sum(r.weight for r in got) == sum(n for _, n in hist)


def test_few_values(spark):
    two = spark.createDataFrame([(1.0, 3), (5.0, 2)], "value double, n long")
    assert [(r.low, r.high) for r in nb.natural_breaks(two, 3).orderBy("class").collect()] == [(1.0, 1.0), (5.0, 5.0)]
    assert nb.natural_breaks(two.limit(0), 3).count() == 0
    same = spark.createDataFrame([(4.0, 9)], "value double, n long")
    assert nb.natural_breaks(same, 3).count() == 1 and nb.goodness(same, nb.natural_breaks(same, 3)).first().gvf == 1.0


def test_sample_mixture(spark):
    rng = np.random.default_rng(42)
    x = np.concatenate([rng.lognormal(1.2, 0.55, 700), rng.normal(25, 4, 250), rng.normal(55, 3, 40), rng.uniform(90, 140, 10)])
    df = nb.binned(spark.createDataFrame([(float(v),) for v in x], "value double"), "value", 200)
    hist = df.groupBy("value").agg(F.count("*").alias("n"))
    fits = {r.k: r.gvf for r in nb.sweep(hist, range(2, 5)).collect()}
    assert 0.5 < fits[2] < fits[3] < fits[4] <= 1
    classes = nb.classify(df, nb.natural_breaks(hist, 3), "value").groupBy("class").count().collect()
    assert sum(r["count"] for r in classes) == 1000 and len(classes) == 3


def quadratic(x, w, k):
    """Costs and starts of every layer by comparing all starts."""
    sw, sx, sq = (np.concatenate([[0.0], np.cumsum(c)]) for c in (w, w * x, w * x * x))
    cost = lambda a, b: max((sq[b] - sq[a]) - (sx[b] - sx[a]) * (sx[b] - sx[a]) / (sw[b] - sw[a]), 0.0)
    now, out = [np.inf] + [cost(0, b) for b in range(1, len(x) + 1)], []
    for classes in range(2, k + 1):
        best = [min(((now[a] + cost(a, b), a) for a in range(classes - 1, b)), default=(np.inf, 0)) for b in range(len(x) + 1)]
        now = [c for c, _ in best]
        out.append((now[-1], [a for _, a in best]))
    return out


@pytest.mark.parametrize("n", [5, 40, 173])
def test_search_against_all_starts(n):
    rng = np.random.default_rng(n)
    for values in (np.sort(rng.choice(10 * n, n, replace=False)).astype(float), np.arange(n) * 2.0):
        weights = rng.integers(1, 50, n).astype(float)
        _, costs, starts = nb.layers(values, weights, 5)
        for (cost, at), c, s in zip(quadratic(values, weights, 5), costs[1:], starts[1:], strict=True):
            assert c == cost
            assert s[n] == at[n]


def test_a_million_values(spark):
    hist = spark.range(1_000_000).select((F.col("id") + F.when(F.col("id") >= 400_000, 3_000_000).otherwise(0)).alias("value"), F.lit(1).cast("long").alias("n"))
    found = nb.natural_breaks(hist, 2)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.start_i, r.weight) for r in found.orderBy("class").collect()] == [(1, 400_000.0), (400_001, 600_000.0)]


def test_too_many_values_are_refused(spark):
    with pytest.raises(Exception, match="more than 5 values"):
        nb.natural_breaks(spark.range(6).withColumn("n", F.lit(1)), 2, "id", most=5).collect()


def test_sweep_equals_single_searches(spark):
    rng = np.random.default_rng(9)
    hist = spark.createDataFrame([(int(v), int(n)) for v, n in zip(sorted(rng.choice(500, 60, replace=False)), rng.integers(1, 9, 60))], "value int, n long")
    for r in nb.sweep(hist, range(2, 6)).collect():
        assert r.gvf == pytest.approx(nb.goodness(hist, nb.natural_breaks(hist, r.k)).first().gvf, rel=1e-12)
