"""Operator 11: how the tokens of two tokenizers align over a corpus, each distinct text once.

1. Rows are shuffled by their full text and counted, combined in each task first, so that a text that a third
   of the rows share is one row for each task. Each distinct text then is tokenised once by both tokenizers.
2. A batch's tokens are two lists of byte lengths. Offsets where tokens of both end cut the batch into groups;
   a link is a pair of one token of each side in a group. Groups of many tokens (`MANY` links or more) are first
   reduced to their different ids and how often each occurs, so no link is spelled out that only repeats.
3. Every text's measures and its different id pairs are written, with how many documents have the text.
   Pairs are counted over all texts, weighted by that number, in tasks first.
4. Pairs meet their counts again: those that hold more than a `FREQUENT`-th of all rows, fewer than `FREQUENT` of
   them, on the map side, the rare ones in a shuffle. A text's pairs lie together, so tasks add them up first.
5. Measures go back to the documents by the SHA-256 of the text; texts of many documents on the map side.

Defined cases: null and empty texts, and texts whose tokens don't spell a space and the text (a character that a
tokenizer normalises), have no tokens: all numbers 0 and '' for the digest. Special tokens' names in a text are
plain text. Repeated rows and null ids are documents like any others, and count as often as they are there; ties
for the highest count are all best. Texts of any length are tokenised whole. An empty table gives no rows.
Columns besides id and text don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, heavy_join, saved

#: Pairs that meet their counts on the map side: each holds more than a FREQUENT-th of all rows of pairs.
FREQUENT = 100_000
#: Bytes and texts that are aligned together; links from which a group is reduced to its different ids.
BYTES, TEXTS, MANY = 1 << 20, 1024, 4096

#: How texts are split before byte pairs are merged, and special tokens at the end of the first vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = 1
#: Texts that only the first tokenizer itself reads: characters beyond Latin letters and common marks, controls, very long runs.
_UNUSUAL = re.compile(r"[^\t-\r\x20-\x7e\xa1-\xac\xae-\u017f\u2010-\u2027\u2030-\u205e\u20ac]|\S{2000}|\s{2000}")

PAIR = "struct<a:int,b:int,times:bigint>"
MEASURED = f"text_sha256 string, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{PAIR}>"
_PAIRS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("times", pa.int64())]))


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Side:
    """What a token id stands for: its bytes, their number, and its number as text after each separator."""

    def __init__(self, spelled: list[bytes], first: str):
        self.spelled = spelled
        self.sizes = np.array([len(s) for s in spelled], dtype=np.int64)
        self.shown = [first + str(i) for i in range(len(spelled))] + ["," + str(i) for i in range(len(spelled))]


class Tokenizers:
    def __init__(self, byte_level: str, pieces: str):
        from sentencepiece import SentencePieceProcessor
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=pieces)
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        entries = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda kv: kv[1])
        assert [i for _, i in entries] == list(range(len(entries)))
        self.left = Side([bytes(byte[c] for c in token) for token, _ in entries], ";")
        pieces_of = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        # The same vocabulary as ranks, whose library is faster; character classes of the common range are the same in both.
        ranks = {token: i for i, token in enumerate(self.left.spelled) if i < len(entries) - SPECIAL}
        self.ranked = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.right = Side([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces_of], "|")

    def encode_a(self, text: str) -> list[int]:
        if _UNUSUAL.search(text):
            return self.a.encode(" " + text, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(" " + text)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [self.encode_a(t) for t in texts], self.b.encode(texts, num_threads=1)


_loaded: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(vocabularies: tuple[str, str]) -> Tokenizers:
    if vocabularies not in _loaded:
        _loaded[vocabularies] = Tokenizers(*vocabularies)
    return _loaded[vocabularies]


def _spell(side: Side, ids: list[int]) -> bytes:
    return b"".join(map(side.spelled.__getitem__, ids))


def _expanded(first: np.ndarray, n: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Numbers first[i], ..., first[i] + n[i] - 1 for each i; times is their total."""
    ends = np.cumsum(n)
    return np.repeat(first - ends + n, n) + np.arange(times)


def links_of(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, groups: int, text: np.ndarray, many: int = MANY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of each group; and text, a, b and times of the different linked pairs of each text. text: of each group."""
    n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    links = n_a * n_b
    weight_a, weight_b = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
    if (large := links >= many).any():
        a, group_a, weight_a = _reduced(a, group_a, large)
        b, group_b, weight_b = _reduced(b, group_b, large)
        n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    begin_b = np.cumsum(n_b) - n_b
    each = n_b[group_a]
    total = int(each.sum())
    at_a, at_b = np.repeat(np.arange(len(a)), each), _expanded(begin_b[group_a], each, total)
    key = (text[group_a[at_a]].astype(np.uint64) << np.uint64(40)) | (a[at_a].astype(np.uint64) << np.uint64(20)) | b[at_b].astype(np.uint64)
    weight = weight_a[at_a] * weight_b[at_b]
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if total else np.zeros(0, np.int64)
    times = np.add.reduceat(weight[order], begin) if total else np.zeros(0, np.int64)
    key = key[begin]
    low = np.uint64((1 << 20) - 1)
    return links, (key >> np.uint64(40)).astype(np.int64), ((key >> np.uint64(20)) & low).astype(np.int32), (key & low).astype(np.int32), times


def _reduced(ids: np.ndarray, group: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens in order of their groups, of large ones each id once with its number."""
    inside = large[group]
    key, n = np.unique((group[inside].astype(np.int64) << 20) | ids[inside], return_counts=True)
    own, group, weight = np.concatenate([ids[~inside], key & ((1 << 20) - 1)]), np.concatenate([group[~inside], key >> 20]), np.concatenate([np.ones((~inside).sum(), np.int64), n])
    order = np.argsort(group, kind="stable")
    return own[order], group[order], weight[order]


def aligned(use: Tokenizers, texts: list[str | None]) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Measures and group digests of each text; where its pairs end; and a, b, times of all pairs."""
    count = len(texts)
    ids_a, ids_b = use.encode([t or "" for t in texts])
    for i, t in enumerate(texts):
        want = (" " + t).encode() if t else None
        if want is None or _spell(use.left, ids_a[i]) != want or _spell(use.right, ids_b[i]) != want:
            ids_a[i], ids_b[i] = [], []
    n_a, n_b = (np.fromiter(map(len, ids), dtype=np.int64, count=count) for ids in (ids_a, ids_b))
    a, b = (np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
    # Both sides of a text have the same bytes, so a text's last tokens end a group, and ends can run through the batch.
    ends_a, ends_b = np.cumsum(use.left.sizes[a]), np.cumsum(use.right.sizes[b])
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    own_a = np.repeat(np.arange(count), n_a)
    text = np.zeros(len(cuts), dtype=np.int64)
    text[group_a] = own_a
    links, pair_text, pair_a, pair_b, times = links_of(a, b, group_a, group_b, len(cuts), text)
    measures = {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(text, minlength=count), "n_links": np.bincount(text, links, minlength=count).astype(np.int64)}

    # The groups as text: each group's A ids, then its B ids.
    in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
    upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
    later_a, later_b = np.arange(len(a)) != (upto_a - in_a)[group_a], np.arange(len(b)) != (upto_b - in_b)[group_b]
    shown = np.empty(len(a) + len(b), dtype=object)
    left, right = use.left, use.right
    shown[np.arange(len(a)) + (upto_b - in_b)[group_a]] = list(map(left.shown.__getitem__, (a + later_a * len(left.spelled)).tolist()))
    shown[np.arange(len(b)) + upto_a[group_b]] = list(map(right.shown.__getitem__, (b + later_b * len(right.spelled)).tolist()))
    stops = np.cumsum(n_a + n_b).tolist()
    digests = ["" if n == 0 else hashlib.sha256("".join(shown[stop - n : stop])[1:].encode()).hexdigest() for stop, n in zip(stops, (n_a + n_b).tolist(), strict=True)]
    return measures, digests, np.searchsorted(pair_text, np.arange(count), side="right"), (pair_a, pair_b, times)


def _aligner(vocabularies: tuple[str, str]) -> Callable:
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = tokenizers(vocabularies)

        def told(part: pa.RecordBatch) -> pa.RecordBatch:
            measures, digests, stops, (a, b, times) = aligned(use, part.column(1).to_pylist())
            pairs = pa.StructArray.from_arrays([pa.array(a), pa.array(b), pa.array(times)], fields=list(_PAIRS.value_type))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), pairs)
            columns = [part.column(0), part.column(2), *[pa.array(measures[k]) for k in ("n_a", "n_b", "n_groups", "n_links")], pa.array(digests, pa.string()), lists]
            return pa.RecordBatch.from_arrays(columns, ["text_sha256", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

        for batch in rows:
            at, size = 0, 0
            for i, n in enumerate(batch.column(3).to_pylist()):
                size += n
                if size >= BYTES or i + 1 - at >= TEXTS:
                    yield told(batch.slice(at, i + 1 - at))
                    at, size = i + 1, 0
            if at < batch.num_rows:
                yield told(batch.slice(at))

    return batches


def text_measures(docs: DataFrame, text: str = "text", vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """The written table of each distinct text's measures and pairs, with the number of its documents (copies)."""
    distinct = docs.select(F.col(text).alias("text")).where("text IS NOT NULL AND text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    rows = distinct.select(F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "text", "copies", F.octet_length("text").alias("bytes"))
    return saved(rows.mapInArrow(_aligner(vocabularies or default_vocabularies()), MEASURED))


def pair_counts(measured: DataFrame) -> DataFrame:
    """a, b, texts, documents of each linked pair, and whether no pair of its a has more documents (best)."""
    pairs = measured.select("copies", F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("texts"), F.sum("copies").alias("documents"))
    pairs = saved(pairs)
    # An id has at most as many partners as the other vocabulary has entries.
    most = pairs.groupBy("a").agg(F.max("documents").alias("most"))
    return pairs.join(most, "a").select("a", "b", "texts", "documents", (F.col("documents") == F.col("most")).alias("best"))


def align(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """One row for each document: its id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    measured = text_measures(docs, text, vocabularies)
    counts = saved(pair_counts(measured))
    total = counts.agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]
    pairs = measured.select("text_sha256", F.explode("pairs").alias("p")).select("text_sha256", "p.a", "p.b", "p.times")
    met = heavy_join(pairs, counts, ["a", "b"], "texts", total, heavy=FREQUENT)
    sums = met.groupBy("text_sha256").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum"))
    told = saved(measured.drop("pairs").join(sums, "text_sha256", "left"))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    ids = docs.select(F.col(id_col).alias("id"), F.when(F.col(text) != "", F.sha2(F.col(text).cast("binary"), 256)).alias("text_sha256"))
    there = ids.where("text_sha256 IS NOT NULL")
    out = heavy_join(there, told, ["text_sha256"], "copies", told.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0])
    out = out.select("id", *names, "groups_sha256").unionByName(ids.where("text_sha256 IS NULL").select("id"), allowMissingColumns=True)
    return out.select(F.col("id").alias(id_col), *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))
