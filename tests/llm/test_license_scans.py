import random
import re

from pyspark.sql import functions as F

from rookery.llm import license_scans as op


def brute(text):
    """Names and best shares over the same windows, every one of them verified."""
    w = op.words_in(text or "")
    out = {}
    for name, template in op.TEMPLATES.items():
        t = op.plan(name, template)
        blocks = -(-max(0, len(w) - op.SHINGLE + 1) // t.block)
        for p in range(0, max(blocks - t.blocks, 0) + 1 if blocks else 0):
            piece = w[p * t.block : p * t.block + t.block * t.blocks + op.SHINGLE - 1]
            share = len(set(t.shingles) & set(op.shingles_of(piece))) / len(t.shingles)
            if share >= op.CONTAINED and share > out.get(name, (0, 0))[0]:
                out[name] = (share, p * t.block)
    return out


def test_plans_guarantee_retrieval():
    for name, text in op.TEMPLATES.items():
        t = op.plan(name, text)
        needed = -(-len(t.shingles) * 4 // 5)
        j = needed / (t.block * t.blocks + len(t.shingles) - needed)
        assert (1 - j) ** t.bands <= 1 / op.MISSED + 1e-12
        assert t.bands <= 24


def test_hash_is_the_column_function(spark):
    row = spark.range(1).select(F.xxhash64(*[F.lit(x) for x in ("released", "under", "the", "mit", "lizenz-ü")])).first()
    assert row[0] == op.hash_of("released under the mit lizenz-ü")


def planted(n, seed=1):
    rng = random.Random(seed)
    filler = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        text = rng.choices(filler, k=rng.randrange(0, 250))
        for name in rng.sample(list(op.TEMPLATES), rng.randrange(0, 3)):
            words = op.TEMPLATES[name].split()
            if rng.random() < 0.4 and len(words) > 20:  # one word changed near an end
                words[rng.choice([0, 1, -1, -2])] = "changed"
            at = rng.randrange(0, len(text) + 1)
            text[at:at] = words
        rows.append((i, " ".join(text)))
    return rows


def test_by_brute_force(spark, sf, docs_of, awkward):
    rows = planted(500) + [(1000 + i, r[1]) for i, r in enumerate(awkward)]
    rows += [(2000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(250).collect()]
    docs = docs_of([(d, t) for d, t in rows], {n: F.lit(2) for n in ("words", "sh", "may", "found", "x1", "row", "name", "__words")})
    want = {(d, n): v for d, t in rows for n, v in brute(t).items()}
    out = op.scanned(docs)
    assert out.columns == ["row", "found"] and out.select("row.*").columns == docs.columns
    got = {(r.row.doc_id, f.name): (f.share, f["at"]) for r in out.collect() for f in r["found"]}
    assert set(got) <= set(want) and len(got) >= 0.995 * len(want) and len(want) > 300
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 for k in got if k[1] in ("mit", "cc-by-nc-4.0", "apache-2.0"))
    assert all(got[k][0] >= op.CONTAINED for k in got)


def test_empty(docs_of):
    assert op.scanned(docs_of([])).count() == 0


def test_query(spark, sf):
    got = {r.doc_id: r.licenses for r in op.op10_license_scans(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        if re.search(r"Released under the MIT License\.", r.text or ""):
            assert "mit" in got[r.doc_id].split(",")
        if re.search(r"Licensed under the Apache License, Version 2\.0\.", r.text or ""):
            assert "apache-2.0" in got[r.doc_id].split(",")
