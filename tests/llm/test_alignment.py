"""Alignment of two tokenizers against plain loops over tokens and byte offsets."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.llm import alignment

NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def use():
    return alignment.tokenizers(alignment.default_vocabularies())


def plain(use, rows):
    """(doc_id, measures...) by loops; rows: (doc_id, text)."""
    groups_of = []
    for _, text in rows:
        groups = []
        if text:
            (a,), (b,) = use.encode([text])
            spell = lambda side, ids: [side.spelled[i] for i in ids]
            x, y = spell(use.left, a), spell(use.right, b)
            if b"".join(x) == b"".join(y) == (" " + text).encode():
                groups, i, j, at, bt, own = [], 0, 0, 0, 0, ([], [])
                while i < len(a) or j < len(b):
                    if at <= bt and i < len(a):
                        own[0].append(a[i])
                        at, i = at + len(x[i]), i + 1
                    else:
                        own[1].append(b[j])
                        bt, j = bt + len(y[j]), j + 1
                    if at == bt:
                        groups.append(own)
                        own = ([], [])
        groups_of.append(groups)
    links = [Counter((p, q) for g in groups for p in g[0] for q in g[1]) for groups in groups_of]
    docs = Counter(k for c in links for k in c)
    top = defaultdict(int)
    for (a, _), n in docs.items():
        top[a] = max(top[a], n)
    out = []
    for (doc_id, _), groups, c in zip(rows, groups_of, links, strict=True):
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(c.values()), sum(n for k, n in c.items() if docs[k] == top[k[0]]), sum(n * docs[k] for k, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def got(docs):
    return sorted(map(tuple, alignment.align(docs).select("doc_id", *NAMES).collect()), key=str)


def test_whole_table(spark, sf, use):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, alignment.op11_alignment(spark, sf).collect()), key=str) == plain(use, rows)


def test_awkward_rows(docs_of, awkward, use):
    rows = awkward + [(20, "<|endoftext|> <s> <unk> </s> <0x41>"), (21, "emoji 😀👩‍👩‍👧 漢字 ▁ x"), (22, "▁"), (23, "  two  spaces\n\n\ttabs "), (24, "漢字かな交じり文 عربى עברית"), (25, "ﬁ ﬂ ① ½   　 é"), (26, "\x00 \x01 \x7f"), (27, "😀" * 300)]
    docs = docs_of(rows, {"pairs": F.lit(1), "text_sha256": F.lit("x"), "copies": F.lit(2), "n_a": F.lit(3)})
    assert got(docs) == plain(use, [r[:2] for r in rows])


def test_empty_table_and_other_names(docs_of, use):
    assert got(docs_of([])) == []
    docs = docs_of([(1, "one two"), (2, "one two"), (3, None)]).select(F.col("doc_id").alias("a"), F.col("text").alias("b"))
    out = {r.a: r for r in alignment.align(docs, "a", "b").collect()}
    assert out[1].n_links == out[2].n_links > 0 and out[1].count_sum == 2 * out[1].n_links and out[3].n_a == 0 and out[3].groups_sha256 == ""


def test_frequent_and_rare_pairs_meet_the_same_counts(docs_of, use, monkeypatch):
    rows = [(i, f"the word {i % 7} and the w{i}") for i in range(300)]
    monkeypatch.setattr(alignment, "FREQUENT", 20)
    assert got(docs_of(rows)) == plain(use, rows)


def test_both_readers_of_the_first_vocabulary_agree(spark, sf, use):
    rng = random.Random(8)
    letters = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xA0, 0x180), *range(0x2010, 0x2060), 0x20AC, 0x4E00, 0x1F600]]
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(3000)] + ["it's we'll I'D don't  \n\n x", "<|endoftext|>", "a" * 5000]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r.text]
    assert all(use.encode_a(t) == use.a.encode(" " + t, add_special_tokens=False).ids for t in texts)
    assert sum(not alignment._UNUSUAL.search(t) for t in texts) > 1000


def test_large_groups_are_reduced_exactly():
    """Two groups whose tokens repeat, spelled out or reduced to different ids."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 40, 500), rng.integers(0, 30, 400)
    group_a, group_b = np.repeat([0, 1, 2], [200, 1, 299]), np.repeat([0, 1, 2], [100, 299, 1])
    text = np.array([0, 0, 1])
    whole, cut = (alignment.links_of(a, b, group_a, group_b, 3, text, many) for many in (10**9, 10))
    assert all((x == y).all() for x, y in zip(whole, cut, strict=True))
