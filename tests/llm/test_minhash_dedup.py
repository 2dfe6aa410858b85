"""Near duplicates against all pairs of whole sets."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.llm import minhash_dedup as md
from rookery.llm.common import heavy_join, saved


def shingles(text, width=2):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) or frozenset([tuple(words)])


def plain(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs; rows: (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    groups = {}
    for i, s in enumerate(sets):
        if s:
            root[i] = groups.setdefault(s, i)
    distinct = sorted(groups.items(), key=lambda g: len(g[0]))
    for x, (s, i) in enumerate(distinct):
        for t, j in distinct[x + 1 :]:
            if 80 * len(t) > 100 * len(s):
                break
            both = len(s & t)
            if 100 * both >= 80 * (len(s) + len(t) - both):
                root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(top(i)), d == least.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(md.op12_minhash_dedup(spark, sf)) == plain(rows)


def test_awkward_rows(docs_of, awkward):
    rows = awkward + [(30, "one"), (31, "ONE"), (32, "one two"), (33, "two one"), (34, "a b c d e f"), (35, "a b c d e"), (36, "a b c d e f g")]
    docs = docs_of(rows, {"number": F.lit(1), "node": F.lit(2), "n": F.lit(3), "keys": F.lit("k"), "root": F.lit(4)})
    assert got(md.near_classes(docs)) == plain([r[:2] for r in rows])


def test_empty_table_and_other_names(docs_of):
    assert got(md.near_classes(docs_of([]))) == []
    docs = docs_of([(1, "a b c"), (2, "A B C"), (3, None)]).select(F.col("doc_id").cast("string").alias("a"), F.col("text").alias("b"))
    assert sorted(map(tuple, md.near_classes(docs, "a", "b").collect())) == [("1", 2, "1", True), ("2", 2, "1", False), ("3", 0, "3", True)]


def variants(seed, n, words, swaps):
    """Near copies of one text: their links to each other are at the edge, so that stars leave some apart."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10000)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(swaps)):
            own[rng.randrange(words)] = f"x{rng.randrange(10000)}"
        yield " ".join(own)


@pytest.mark.parametrize("growth", [2, 8])
def test_links_that_no_star_has(docs_of, growth):
    rows = [(i, t) for i, t in enumerate([*variants(1, 120, 60, 9), *variants(2, 80, 30, 5), *variants(3, 40, 8, 3)])]
    random.Random(4).shuffle(rows)
    out = got(md.near_classes(docs_of(rows), piece=7, growth=growth, most=20))
    assert out == plain(rows)
    assert 3 < len({c for _, _, c, _ in out}) < len(rows)


def test_chain(docs_of):
    """Each text is like the next only: the component is reached through all of them."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 100])) for i in range(30)]
    want = plain(rows)
    assert got(md.near_classes(docs_of(rows))) == want and len({c for _, _, c, _ in want}) == 1


def test_bins_agree_as_often_as_sets_are_alike():
    """Densified bins of small and large sets."""
    rng = np.random.default_rng(5)
    for size in (5, 20, 100, 3000):
        agree = []
        for _ in range(300):
            both = rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64)
            cut = size // 10 + 1
            x, y = np.unique(both[cut:]), np.unique(both[:-cut])
            agree.append((md.one_permutation(x) == md.one_permutation(y)).mean() - len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
        assert abs(np.mean(agree)) < 0.02


def test_bitmaps_rule_out_no_link():
    """Bits that differ are never more than shingles that only one set has, at any width."""
    rng = np.random.default_rng(7)
    for size in (1, 9, 64, 70, 600):
        for _ in range(50):
            both = np.unique(rng.integers(0, 2**63, size + size // 3 + 1, dtype=np.int64).astype(np.uint64))
            x, y = both[: size // 2 + 1], both[size // 3 :]
            a, b = md.parity_bits(x)[None, :], md.parity_bits(y)[None, :]
            width = min(a.shape[1], b.shape[1])
            apart = int(np.bitwise_count(md.folded(a, width) ^ md.folded(b, width)).sum())
            assert apart <= len(np.setxor1d(x, y)) and (apart - len(np.setxor1d(x, y))) % 2 == 0


def test_bands_find_pairs_at_the_threshold():
    rng, missed = np.random.default_rng(6), 0
    for size in (4, 8, 36, 360):
        for _ in range(300):
            both = np.unique(rng.integers(0, 2**63, size + size // 4, dtype=np.int64).astype(np.uint64))
            rng.shuffle(both)
            missed += not (md.band_keys(np.sort(both[:size])) == md.band_keys(np.sort(both))).any()
    assert missed <= 1


def test_texts_travel_instead_of_their_sets(spark, sf):
    """What comparing writes is smaller than the sets' hashes; sets are made where they meet, and tell the same."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 500").selectExpr("monotonically_increasing_id() AS number", "text").limit(200)
    texts = {r.number: r.text for r in rows.collect()}
    docs = spark.createDataFrame(list(texts.items()), "number long, text string")
    order = sorted(texts)
    edges = saved(spark.createDataFrame([(order[0], n) for n in order[1:]] + [(order[1], n) for n in order[2:9]], "centre long, member long"))
    sets = md.Sets(docs, 2)
    near = {(r.centre, r.member): r.near for r in md.compared(edges, sets, 80, 16).collect()}
    assert len(near) == len(order) + 6
    for (a, b), alike in near.items():
        x, y = shingles(texts[a]), shingles(texts[b])
        assert alike == (100 * len(x & y) >= 80 * len(x | y))
    stored = sum(os.path.getsize(f.removeprefix("file:")) for f in sets.made.inputFiles())
    assert stored < sum(8 * len(shingles(t)) for t in texts.values())


def test_heavy_keys_are_filtered_without_a_join(spark):
    left = saved(spark.createDataFrame([(1, -(2**40))] * 90 + [(2, 5), (2, -(2**40)), (None, 5)], "t int, key long"))
    right = saved(spark.createDataFrame([(1, -(2**40), 90, "a"), (2, 5, 1, "b")], "t int, key long, n long, v string"))
    for how, more in (("inner", []), ("left", [None, None])):
        joined = heavy_join(left, right, ["t", "key"], "n", 93, how)
        assert sorted(r.v or "" for r in joined.collect()) == sorted([*(x or "" for x in more), *["a"] * 90, "b"])
        assert "LeftAnti" not in joined._jdf.queryExecution().executedPlan().toString()
