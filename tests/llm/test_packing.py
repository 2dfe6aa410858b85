import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rookery.llm import packing as op

TEXTS = ["", "Hello, world. it's 42!", "ÀÉÎ straße. Ünïcödé, naïve", "a\x1cb !\x1c! x", "ΑΣ ΣΑΣ, İstanbul", "<|endoftext|> x<|startoftext|>", "é é ́x", "tab\tnew\nline\x0bfeed", "日本語テキスト, ok", "a.b ,. ... ,", " x y", "don't we'LL I'm"]


def test_encoder_agrees_with_tokenizer(spark, sf):
    full = Tokenizer.from_file(op.default_vocabulary())
    texts = TEXTS + [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").limit(400).collect()]
    enc = op.PieceEncoder(op.default_vocabulary(), remembered=500)
    for t, got in zip(texts, enc.encode(texts), strict=True):
        assert got.tolist() == full.encode(t, add_special_tokens=False).ids, t[:80]


def test_encoder_on_every_letter_it_merges_itself():
    """Each character of the class, alone, in runs, capital, before points and digits; and what looks like one but isn't."""
    full, enc = Tokenizer.from_file(op.default_vocabulary()), op.PieceEncoder(op.default_vocabulary())
    letters = [c for c in map(chr, range(33, 0xD7A4)) if re.fullmatch(f"[{op.LETTERS}]", c)]
    rng = np.random.default_rng(3)
    words = letters + ["".join(rng.choice(letters, rng.integers(1, 9))) + e for _ in range(300) for e in ("", ",", ".", "1", "'s", "...", "'LL")]
    words += ["J\u030c", "\u212a", "\u2126x", "E\u0301a", "\u0130I", "a\u0130", "\u30cb\u3099", "\uac00\u11a8", "a\u00a0b", "\u00d7", "x\u3000y", "a\x00b", "don't'ss", "<|ENDOFTEXT|>", "a<|endoftext|>b", "\u4e2d" * 3000]
    words += ["".join(rng.choice(list("abAB'sStTdDmlLrevE.,01-<|>_")) for _ in range(rng.integers(1, 9))) for _ in range(3000)]
    want = [e.ids for e in full.encode_batch_fast(words, add_special_tokens=False)]
    assert [x.tolist() for x in enc.encode(words)] == want
    joined = enc.encode(["  ".join(words) + "\r\n"])[0].tolist()
    assert joined == [t for x in want for t in x]


def test_words_are_merged_in_bulk(spark, sf):
    """Next to nothing of plain texts goes through the tokenizer word by word, however many words are new (they took most of the time)."""
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").limit(400).collect()]
    enc, seen = op.PieceEncoder(op.default_vocabulary()), []

    class Watched:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, words, **more):
            seen.extend(words)
            return self.tokenizer.encode_batch_fast(words, **more)

    for name, value in list(vars(enc).items()):
        if isinstance(value, Tokenizer):
            setattr(enc, name, Watched(value))
    enc.encode(texts)
    assert sum(map(len, seen)) < 0.02 * len("".join({w for t in texts for w in t.split()}))


def test_every_token_comes_out_of_its_own_bytes():
    """So merging any neighbours that make up a token, by rank, is the same as the listed merges."""
    model = json.loads(open(op.default_vocabulary(), encoding="utf-8").read())["model"]
    rank = {tuple(m): i for i, m in enumerate(model["merges"])}
    for left, right in model["merges"]:
        token = left + right
        parts = [*token.removesuffix(op.CLOSE)]
        if token.endswith(op.CLOSE):
            parts[-1] += op.CLOSE
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), len(rank)))
            assert (parts[best], parts[best + 1]) in rank, token
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        assert parts == [token]


def verify(rows, pieces, window=op.WINDOW):
    full = Tokenizer.from_file(op.default_vocabulary())
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(full.encode(t or "", add_special_tokens=False).ids + [1])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(want)
    for i, found in by_doc.items():
        if len(want[i]) > 1:
            assert sum(p.length for p in found) == sum(map(len, want[i]))
            continue
        ids, at = np.array(want[i][0], dtype="<u4"), 0
        for p in sorted(found, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for found in by_seq.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window and at & (at - 1) == 0  # full, or a power of two: nothing is padded


def test_round_trip(docs_of, awkward):
    rows = [(r[0], r[1]) for r in awkward] + [(100 + i, t) for i, t in enumerate(TEXTS)]
    docs = docs_of(rows, {c: F.lit(1) for c in ("shard", "ids", "number", "id", "centre", "piece", "extra", "n")})
    verify(rows, op.pack(docs).collect())
    verify(rows, op.pack(docs, shard=40).collect())
    assert op.pack(docs_of([])).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    verify(rows, op.op2_packing(spark, sf).collect())


def test_bm25_by_brute_force():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 50, rng.integers(1, 60)).astype(np.uint16) for _ in range(40)]
    index = op.Shard(docs)
    mean = np.mean([len(d) for d in docs])
    df = {t: sum(t in d for d in docs) for t in range(50)}

    def weight(d, t):
        tf = int((d == t).sum())
        return max(0, np.log((40 - df[t] + 0.5) / (df[t] + 0.5))) * tf * (op.K1 + 1) / (tf + op.K1 * (1 - op.B + op.B * len(d) / mean))

    for seed in range(5):
        terms = {int(t) for t in docs[seed] if df[int(t)] > 1}
        want = [sum(weight(d, t) for t in terms) for d in docs]
        used = np.zeros(40, dtype=bool)
        used[seed] = True
        got = index.neighbours(seed, used)
        assert [round(want[i], 3) for i in got] == sorted((round(want[i], 3) for i in got), reverse=True)
        assert {int(i) for i in got} == {i for i in range(40) if i != seed and want[i] > 1e-9}


def test_related_documents_meet():
    rng = np.random.default_rng(6)
    topics = [rng.integers(k * 300, k * 300 + 300, (60, 200)) for k in range(4)]
    docs = [d.astype(np.uint16) for t in topics for d in t]
    order = rng.permutation(len(docs))
    pieces = op.fill([docs[i] for i in order], 2048)
    mixed = defaultdict(set)
    for doc, _, _, sequence, _ in pieces:
        mixed[sequence].add(order[doc] // 60)
    assert np.mean([len(x) for x in mixed.values()]) < 1.5


def test_large_ids_beside_null(docs_of):
    rows = [(2**53 + 1, "a b c"), (2**53 + 3, "d e f"), (None, "g h i")]
    assert sorted(str(r.doc_id) for r in op.pack(docs_of(rows)).collect()) == sorted(map(str, (2**53 + 1, 2**53 + 3, None)))
    text = docs_of(rows).withColumn("doc_id", F.concat(F.lit("id "), F.col("doc_id").cast("string")))
    assert sorted(str(r.doc_id) for r in op.pack(text).collect()) == ["None", f"id {2**53 + 1}", f"id {2**53 + 3}"]


def test_alike_rows_are_split(docs_of, monkeypatch):
    """A third of all rows are one row over and over; no group holds more than some shards of tokens."""
    rows = [(7, "the same words over and over")] * 3000 + [(10 + i, f"w{i} x{i % 7} y{i % 11}") for i in range(3000)]
    packed = op._packed

    def watched(window):
        run = packed(window)

        def told(t):
            if sum(map(len, t.column("ids").to_pylist())) > 2 * 3 * 2000:
                raise AssertionError("a large group")
            return run(t)

        return told

    monkeypatch.setattr(op, "_packed", watched)
    verify(rows, op.pack(docs_of(rows), shard=2000).collect())


def test_dealing_brings_neighbours_together(spark):
    """Of the ten best documents of the whole index, far more lie in the seed's shard than by chance."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 0")
    found = op.dealt(op.saved(op.tokenised(docs, "doc_id", "text", op.default_vocabulary())), op.SHARD).select("id", "centre", "piece", "extra", "ids").toPandas().sort_values("id")
    shard = (found.centre * 1000000 + found.piece * 1000 + found.extra).to_numpy()
    index = op.Shard([np.frombuffer(i, dtype=np.uint16) for i in found.ids])
    none = np.zeros(len(found), dtype=bool)
    seeds = [i for i in range(len(found)) if found.id.iloc[i] % 40 == 0]
    hits = []
    for i in seeds:
        best = [j for j in index.neighbours(i, none)[:11].tolist() if j != i][:10]
        if best:
            hits.append(np.mean(shard[best] == shard[i]))
    chance = (np.bincount(np.unique(shard, return_inverse=True)[1]) ** 2).sum() / len(shard) ** 2
    print("recall of the top ten", np.mean(hits), "by chance", chance, "shards", len(set(shard)))
    assert np.mean(hits) > 2 * chance


def test_sequence_ids_of_many_input_tasks(spark):
    """Row numbers as tasks 0, 2048, 5000 and 10^6 give them: dense afterwards, and no two documents share an id."""
    tasks = [0, 1, 2048, 5000, 10**6]
    rows = spark.createDataFrame([((t << 33) + i, t) for t in tasks for i in range(20)], "number long, id long")
    got = [r.number for r in op.numbered(rows).orderBy("id", "number").collect()]
    assert got == list(range(100))
    number = np.array([(1 << 43) - 2, 5, (1 << 43) - 1])
    ids = op._sequence_ids(np.array([0, 0, 0, 1, 2]), np.array([0, 1, 2, 3, 4]), number)
    assert len(set(ids.tolist())) == 5 and ids.min() >= 0
    with pytest.raises(OverflowError):
        op._sequence_ids(np.array([0]), np.array([0]), np.array([1 << 43]))


def test_many_rows_have_different_sequences(spark):
    """10^6 row numbers over 4000 tasks stay different."""
    rows = spark.range(1_000_000, numPartitions=8).select(((F.col("id") % 4000) * (1 << 33) + F.floor(F.col("id") / 4000)).alias("number"))
    out = op.numbered(rows).agg(F.count_distinct("number"), F.min("number"), F.max("number")).first()
    assert tuple(out) == (1_000_000, 0, 999_999)
