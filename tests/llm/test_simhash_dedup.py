import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rookery.llm import simhash_dedup as op
from rookery.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_mark(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_classes(ids, marks):
    """Component (least id) of each row, by comparing all pairs."""
    m = np.array(marks, dtype=np.uint64)
    root = list(range(len(m)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(m)):
        for j in np.flatnonzero(np.bitwise_count(m[i] ^ m[i + 1 :]) <= 4) + i + 1:
            a, b = top(i), top(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        r = top(i)
        if x is not None:
            least[r] = min(least.get(r, x), x)
    return [least.get(top(i)) for i in range(len(m))]


def test_fingerprints(docs_of, awkward):
    rows = [r for r in awkward if len(r[1] or "") < 100000] + [(50, "One two\x0bthree"), (51, "a b c d"), (52, "\x1ca b\x85c d e")]
    got = op.near_classes(docs_of(rows)).collect()
    assert sorted((str(r.id), r.mark % 2**64) for r in got) == sorted((str(r[0]), brute_mark(r[1])) for r in rows)


def test_links_lose_nothing(spark):
    rng = random.Random(7)
    marks = {rng.getrandbits(64) for _ in range(800)}
    for m in list(marks)[:120]:  # chains of near fingerprints
        for _ in range(rng.randrange(1, 12)):
            for _ in range(rng.randrange(1, 6)):
                m ^= 1 << rng.randrange(64)
            marks.add(m)
    marks = sorted(marks)
    frame = spark.createDataFrame([(op._signed(m),) for m in marks], "mark long")
    want = brute_classes(marks, marks)
    for chunk in (op.CHUNK, 3):
        roots = {r.node % 2**64: r.root for r in components(op.links(frame, chunk)).collect()}
        classes = {}
        for m, w in zip(marks, want, strict=True):
            classes.setdefault(roots.get(m, op._signed(m)), set()).add(w)
        assert all(len(x) == 1 for x in classes.values())
        assert len(classes) == len(set(want))


def test_large_buckets_are_cut_by_pivots(spark):
    """Buckets far beyond the chunk, cut level by level: all pairs in reach still meet."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    marks = {base}
    while len(marks) < 900:
        m = base
        for _ in range(rng.randrange(1, 12)):
            m ^= 1 << rng.randrange(20)  # four blocks stay the same
        marks.add(m)
    frame = spark.createDataFrame([(op._signed(m),) for m in sorted(marks)], "mark long")
    pairs = {(r.a, r.b) for r in op.links(frame, 50).collect()}
    assert all(bin((a ^ b) % 2**64).count("1") for a, b in pairs)
    roots = {r.node: r.root for r in components(op.links(frame, 50)).collect()}
    want = brute_classes(sorted(marks), sorted(marks))
    classes = {}
    for m, w in zip(sorted(marks), want, strict=True):
        classes.setdefault(roots.get(op._signed(m), op._signed(m)), set()).add(w)
    assert all(len(x) == 1 for x in classes.values()) and len(classes) == len(set(want))


def test_one_of_rows_that_are_alike_stays(docs_of):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2**53 + 1, "z y x w v u"), (2**53 + 3, "z y x w v u"), (None, "no id at all here")]
    kept = op.near_dedup(docs_of(rows, {c: F.lit("mine") for c in ("number", "row", "mark", "keeper", "rows", "root", "least")})).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("1", "a b c d e f"), ("9007199254740993", "z y x w v u"), ("None", "no id at all here")]
    assert all(r.number == r.row == r.least == "mine" for r in kept)


def test_query_by_brute_force(spark, sf):
    got = op.op7_simhash_dedup(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)
    marks = [int(x, 16) for x in got.fingerprint]
    short = docs.text.str.len() < 3000
    assert [m for m, s in zip(marks, short, strict=True) if s] == [brute_mark(t) for t in docs.text[short]]
    assert got.component_id.tolist() == brute_classes(docs.doc_id.tolist(), marks)


def test_rows_that_stay(docs_of, awkward):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(100 + i, base + f" tail{i % 3}") for i in range(30)] + [(200, "quite another text altogether " * 9)]
    docs = docs_of(rows, {"mark": F.lit(1), "id": F.lit(2)})
    kept = op.near_dedup(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = brute_classes([r[0] for r in rows], [brute_mark(r[1]) for r in rows])
    assert sorted(ids) == sorted(set(want))
    again = [r.doc_id for r in op.near_dedup(docs_of(awkward)).collect()]
    assert set(again) >= {4, 6, 7, 8, 9} and 5 not in again
    assert op.near_dedup(docs_of([])).count() == 0 and op.near_classes(docs_of([])).count() == 0


def _roots(n, links):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        x, y = top(i), top(j)
        root[max(x, y)] = min(x, y)
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("flips", [4, 9])
def test_flood_of_a_dense_bucket(flips):
    """Flips of one fingerprint: a dense group, and one of many small components; against all pairs."""
    rng = np.random.default_rng(flips)
    marks = np.unique(np.array([sum(1 << int(b) for b in rng.choice(64, flips, replace=False)) for _ in range(1500)], dtype=np.uint64))
    near = np.argwhere(np.triu(np.bitwise_count(marks[:, None] ^ marks[None, :]) <= op.RADIUS, 1))
    want = _roots(len(marks), near.tolist())
    members, roots = op._flood(marks)
    at = {int(m): i for i, m in enumerate(marks)}
    assert _roots(len(marks), [(at[int(a)], at[int(b)]) for a, b in zip(members, roots, strict=True)]) == want
    assert len(members) == len(marks) - len(set(want))


def test_flood_takes_a_large_dense_bucket():
    """40,000 members within eight bits of each other are one component after few comparisons."""
    rng = np.random.default_rng(1)
    bits = np.argsort(rng.random((40_000, 64)), axis=1)[:, :4].astype(np.uint64)
    marks = np.unique((np.uint64(1) << bits).sum(axis=1, dtype=np.uint64))
    members, roots = op._flood(marks)
    assert len(members) == len(marks) - 1 and len(np.unique(roots)) == 1


def test_links_are_pairs_within_the_radius(spark):
    """In small and in large buckets: chains of fingerprints four bits apart, whose ends are far apart."""
    rng = np.random.default_rng(5)
    marks, at = [], 0
    for _ in range(600):
        for bit in rng.choice(12, 4, replace=False):
            at ^= 1 << int(bit)
        marks.append(at)
    frame = spark.createDataFrame([(m,) for m in set(marks)], "mark long")
    pairs = [(r.a, r.b) for r in op.links(frame).collect()]
    assert pairs and all((a ^ b).bit_count() <= op.RADIUS for a, b in pairs)


def test_near_stage_takes_fingerprints(spark, docs_of, monkeypatch):
    """Without any bands, the fingerprints and their pivot tables still find the copies that they can; whole sets refuse what isn't alike."""
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, " ".join(f"q{i}" for i in range(50))), (4, "a b"), (5, "a  b"), (6, None)]
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(op.sets, "links", lambda *_: none)
    got = {r.id: r.component_id for r in op.near_classes(docs_of(rows), shingle=5, similarity=0.8).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}
