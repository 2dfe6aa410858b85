import random

import pytest

import corpus_pipeline
from rookery.llm import minhash_dedup
from rookery.llm.simhash_dedup import near_classes, near_dedup
from test_simhash_dedup import LOWER


def brute_set(text, n=5):
    w = (text or "").translate(LOWER).split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute_least(rows, similarity):
    """Component (least id) of each row, by comparing all pairs."""
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and len(a & b) >= similarity * len(a | b)):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [least.get(top(i)) for i in range(len(rows))]


def edited(seed=3, n=60):
    """Texts and copies of them with one to a few words changed: similarities on both sides of 0.8."""
    rng, rows = random.Random(seed), []
    for _ in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(3, 200))]
        for k in range(rng.randrange(1, 5)):
            other = list(words)
            for _ in range(k * max(1, len(words) // 80)):
                other[rng.randrange(len(other))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(other)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [(minhash_dedup.PIECE, minhash_dedup.GROWTH, minhash_dedup.MEMBERS), (2, 2, 2)])
def test_classes_by_brute_force(docs_of, monkeypatch, sizes):
    rows = edited()
    monkeypatch.setattr(minhash_dedup.links, "__defaults__", sizes)
    got = {r.id: r.component_id for r in near_classes(docs_of(rows), shingle=5, similarity=0.8).collect()}
    want = brute_least(rows, 0.8)
    assert got == {d: c for (d, _), c in zip(rows, want, strict=True)}
    assert len(set(want)) < len(rows)


def test_stage_drops_near_copies_from_08(spark, sf, docs_of):
    """Far more than four bits of the fingerprints differ in some of these pairs."""
    rows = edited(seed=11)
    kept = sorted(r.doc_id for r in corpus_pipeline.near(spark, docs_of(rows), sf).collect())
    assert kept == sorted(set(brute_least(rows, 0.8)))


def test_awkward_rows(docs_of, awkward):
    rows = [(d, t) for d, t, *_ in awkward]
    got = near_classes(docs_of(awkward), shingle=5, similarity=0.8).collect()
    want = brute_least(rows, 0.8)
    assert sorted((str(r.id), str(r.component_id)) for r in got) == sorted((str(d), str(c)) for (d, _), c in zip(rows, want, strict=True))
    kept = near_dedup(docs_of(awkward), shingle=5, similarity=0.8).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(d) for (d, _), c in zip(rows, want, strict=True) if c is None or d == c)
    assert near_dedup(docs_of([]), shingle=5, similarity=0.8).count() == 0
