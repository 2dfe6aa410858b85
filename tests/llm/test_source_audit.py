"""Source divergence against plain loops and SQL; the pointer sort against sorted()."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from rookery.llm import source_audit as sa

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least):
    """rows: (text, lang, source)."""
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        docs[lang].update(set(terms))
        count[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)
        sources = sorted(s for x, s in groups if x == lang)
        every = Counter()
        for s in sources:
            every.update(count[lang, s])

        def shares(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)  # noqa: B023
            return {t: 1 + 1000000000 * (c[t] + 5) // total for t in kept}  # noqa: B023

        p, q = {s: shares(count[lang, s]) for s in sources}, shares(every)
        for s in sources:
            found = [("pair", r, sum(abs(p[s][t] - p[r][t]) for t in kept)) for r in sources if r != s]
            found += [("term", t, p[s][t] - q[t]) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, most in (("pair", 10**9), ("term", 50)):
                own = sorted((f for f in found if f[0] == part), key=lambda f: (-f[2], f[1].encode()))
                out += [(lang, s, *f, i) for i, f in enumerate(own, 1) if i <= most]
    return sorted(out)


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sa.op13_source_audit(spark, sf)
    want = con.sql(sa.ORACLE)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def make(docs_of, rows, **extra):
    return docs_of([(i, t) for i, (t, _, _) in enumerate(rows)], extra).drop("lang", "source").join(
        docs_of([]).sparkSession.createDataFrame([(i, x, s) for i, (_, x, s) in enumerate(rows)], "doc_id long, lang string, source string"), "doc_id"
    )


def test_awkward_rows(docs_of, awkward):
    rows = [(t, "en" if i % 2 else None, s) for i, (_, t, s) in enumerate([(r[0], r[1], r[2] if len(r) > 2 else "s") for r in awkward])] * 2
    rows += [("Zwei ZWEI zwei-drei ÀÉ àé " * 3, "de", f"s{i % 3}") for i in range(9)] + [(None, "xx", "only"), ("", "yy", "a"), ("none", "yy", "b"), ("a" * 100 + " " + "a" * 101, "de", "s1")]
    docs = make(docs_of, rows, term=F.lit("x"), n=F.lit(1), block=F.lit(2), p=F.lit(3))
    for least in (1, 2, 5):
        for shard in (10, 1 << 20):
            assert sorted(map(tuple, sa.source_audit(docs, least=least, shard=shard, block=2).collect())) == plain(rows, least)


def test_empty_table(docs_of):
    assert sa.source_audit(docs_of([])).collect() == []


def test_more_terms_than_a_dense_step(docs_of, monkeypatch):
    monkeypatch.setattr(sa, "WIDE", 3)
    rng = np.random.default_rng(3)
    rows = [(" ".join("w" + "abcdefghij"[x] for x in rng.integers(0, 10, 30)), "en", f"s{i % 4}") for i in range(40)]
    assert sorted(map(tuple, sa.source_audit(make(docs_of, rows), least=1, block=4).collect())) == plain(rows, 1)


def test_pointer_sort():
    words = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefghij" * 3, "abcdefghij" * 3 + "k", "é", "zz"] * 3 + ["abcdefgh" * 2]
    raw = "\n".join(words).encode()
    padded = np.frombuffer(raw + bytes(8), dtype=np.uint8)
    starts, lengths = sa.pointers(padded[:-8], np.array([0, len(raw)]))
    order, runs = sa.equal_runs(padded, starts, lengths)
    told = [raw[starts[i] : starts[i] + lengths[i]].decode() for i in order]
    assert told == sorted(words, key=str.encode)
    assert [told[i] for i in runs] == sorted(set(words), key=str.encode)
    assert all(x < y for a, b in zip(runs, [*runs[1:], len(order)], strict=True) for x, y in zip(order[a:b], order[a + 1 : b], strict=False))


def test_terms_end_with_their_text():
    data = np.frombuffer(b"abcdef", dtype=np.uint8)
    starts, lengths = sa.pointers(data, np.array([0, 2, 2, 5, 6]))
    assert starts.tolist() == [0, 2, 5] and lengths.tolist() == [2, 3, 1]


def test_shares_are_exact(spark):
    n, total, kept = 123456789012345678, 987654321098765432, 1234567
    got = spark.range(1).select(sa.share(F.lit(n), F.lit(total), F.lit(kept))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * kept)
