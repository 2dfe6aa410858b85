import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from rookery.llm import mixing as op


def brute_targets(total):
    """total: words by source. Reshares until nothing is above its cap."""
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    capped, everything = set(), sum(total.values())
    while True:
        free = [s for s in names if s not in capped]
        left = everything - sum(3 * total[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 3 * total[s] * (1 + 1e-12)}
        if not over:
            return {s: 3 * total[s] if s in capped else level * weight[s] for s in names}
        capped |= over


def check(got, rows):
    total = defaultdict(int)
    for r in rows:
        total[r[2]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = brute_targets(total)
    assert len(got) == len(rows)
    source = {r[0]: r[2] for r in rows}
    sums, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        sums[s] += r.copies * r["size"]
        largest[s] = max(largest[s], r["size"])
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.source_size == total[s]
        assert 0 <= r.copies <= 3
    return sums, want, largest


def test_targets_and_sums(docs_of):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 300)), rng.choice(["a", "a", "a", "b", "ü", "zz"]).item() if i % 7 else None) for i in range(6000)]
    rows += [(10000, "one two three", "tiny")]
    for block in (2000, 50):
        sums, want, largest = check(op.mixture(docs_of(rows), block=block).collect(), rows)
        for s, w in want.items():
            assert abs(sums[s] - w) <= min(largest[s], 0.02 * w + 10), s
        first = sorted((r.doc_id, r.copies) for r in op.mixture(docs_of(rows), block=block).collect())
        assert first == sorted((r.doc_id, r.copies) for r in op.mixture(docs_of(rows).repartition(13), block=block).collect())


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(3)
    size, p = rng.integers(1, 1000, 500), np.full(500, 0.37)
    out = op.fly(size, p, rng.random, False)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * size).sum() - (p * size).sum()) < 1e-3
    mean = np.mean([op.fly(size[:20], p[:20], np.random.default_rng(k).random, True) for k in range(3000)], axis=0)
    assert np.abs(mean - 0.37).max() < 0.05


def test_awkward_rows(docs_of, awkward):
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in awkward]
    got = op.mixture(docs_of(rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 3 for r in got)
    docs = docs_of(rows, {"copies": F.lit(1), "number": F.lit(2), "row": F.lit(3)})
    mixed = op.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert op.mixture(docs_of([])).count() == 0 and op.mix(docs_of([])).count() == 0


def test_large_ids_beside_null(spark, docs_of):
    rows = [(2**53 + 1, "a b c"), (2**53 + 3, "d e f"), (None, "g h i")]
    want = sorted(map(str, (2**53 + 1, 2**53 + 3, None)))
    assert sorted(str(r.doc_id) for r in op.mixture(docs_of(rows)).collect()) == want
    assert sorted(str(r.doc_id) for r in op.mix(docs_of(rows)).collect()) == want
    text = docs_of(rows).withColumn("doc_id", F.concat(F.lit("id "), F.col("doc_id").cast("string")))
    assert sorted(str(r.doc_id) for r in op.mix(text).collect()) == ["None", f"id {2**53 + 1}", f"id {2**53 + 3}"]


def test_alike_rows_are_split(docs_of, monkeypatch):
    """A third of all rows are one row over and over; no group of the flight holds more than some blocks."""
    rows = [(1, "same words here", "a")] * 4000 + [(10 + i, "w " * (i % 50), "a" if i % 2 else "b") for i in range(8000)]
    seen = []
    flight = op._flight

    def watched(land):
        run = flight(land)

        def told(t):
            if t.num_rows > 700:
                raise AssertionError(f"{t.num_rows} rows in a group")
            return run(t)

        return told

    monkeypatch.setattr(op, "_flight", watched)
    got = op.mixture(docs_of(rows), block=200).collect()
    assert len(got) == len(rows) and not seen
    sums, target = defaultdict(int), {}
    named = {i: s for i, _, s in rows}
    for r in got:
        sums[named[r.doc_id]] += r.copies * r["size"]
        target[named[r.doc_id]] = r.target
    assert all(abs(sums[s] - target[s]) <= 0.02 * target[s] + 10 for s in sums)


def test_query(spark, sf):
    got = op.op8_mixing(spark, sf)
    assert got.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    by = got.join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.max("size").alias("m")).collect()
    assert all(abs(r.t - r.w) <= min(r.m, 0.02 * r.w + 10) for r in by)
