"""Operator 2: lexical retrieval packing.

Documents are tokenised once and dealt to shards of some `SHARD` tokens by their content. Each shard
is one task group: it builds a BM25 inverted index of its own documents (postings by token, with
document frequencies and lengths) and fills windows of `WINDOW` tokens. A seed document opens a
window; all its terms are looked up in the index; the best unused neighbours follow until the
window is full. The document that reaches over the edge is cut there and goes on as the seed of the
next window. When a query finds no unused neighbour, the next unused document by length is taken.
So every window but a shard's last is full; the last one's tokens are cut into sequences whose
lengths are powers of two, which need no padding. Terms in half of a shard's documents or more
weigh nothing, as in BM25's first form, whose inverse frequency is 0 there or less.

Dealing: a document can be used once, so it lies in one shard, and only neighbours in its shard can
be found. Documents go to the nearest of up to `CENTRES` centres of hashed term vectors, fitted by
spherical k-means on `SAMPLE` documents; a centre of several shards deals its documents by the
first term of a weighted race, in which rare terms win more often and which documents of much the
same terms run alike. Where that leaves a shard too large (rows that are alike), row numbers deal it again.

Tokens travel as unsigned 16-bit numbers; no id of the vocabulary needs more.

Tokenising: white-space-separated words of a text are independent under this tokenizer, so Arrow names the
different words of some `REMEMBERED` bytes of texts, and each is encoded once. Words of printable ASCII and common letters are
lower-cased, parted into pieces by the tokenizer's rule and merged in bulk by the vocabulary's ranks, in which a space after
a piece stands for its closing mark; everything unusual goes through the tokenizer as it is. By ranks, any two neighbours merge
that make up a token; that is what the merges do where each token comes out of its own bytes, which a test shows for this vocabulary.
Tests hold the result against the tokenizer on whole texts.

Defined cases: null and empty texts are documents of one token (the end token, id 1). Very long texts are cut over as
many windows as they need. Null and repeated ids, of any type, and repeated rows are packed like any others; ties in
score go by content. An empty table gives no rows. Columns besides id and text don't matter.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, heavy_join, saved, steps, whole

WINDOW = 2048
#: Tokens that share an index, more or less.
SHARD = 1_000_000
END = 1
#: BM25's parameters.
K1, B = 1.2, 0.75
#: Documents that centres are fitted on, centres at most, numbers in a term vector, and rounds of fitting.
SAMPLE, CENTRES, WIDTH, ROUNDS = 2048, 64, 512, 10
#: Sequences that one document opens, at most: a document has fewer than 2^31 bytes, and as many tokens.
TURNS = 1 << 20
#: Bytes of text whose different words are encoded together.
REMEMBERED = 12_000_000
#: The vocabulary's mark of a piece's last token.
CLOSE = "</w>"
#: Letters, as a regular expression class body, that are what they are in every version of Unicode, compose with none of each
#: other and have one letter as their lower case. Words of these and of printable ASCII needn't go through the tokenizer itself.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u0391-\u03a1\u03a3-\u03a9\u03b1-\u03c9\u0400-\u045f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
#: The tokenizer's own rule for parting a word into pieces, for such words.
PRETOKENS = f"('s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+)"

PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PieceEncoder:
    """Token ids of whole texts; within a step, each different word is encoded once."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.full, self.remembered = Tokenizer.from_file(path), remembered
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        alphabet = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        assert set(alphabet) == set(pre_tokenizers.ByteLevel.alphabet())
        model = json.loads(self.full.to_str())["model"]
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        tokens = [*alphabet, *(c + CLOSE for c in alphabet), *merged]  # a last byte takes its mark before anything is merged
        spelled = [bytes(alphabet[c] for c in t.removesuffix(CLOSE)) + b" " * t.endswith(CLOSE) for t in tokens]
        ranks = {b: i for i, b in enumerate(spelled)}
        assert len(ranks) == len(tokens)
        self.ids = np.array([model["vocab"][t] for t in tokens], dtype=np.uint16)
        self.closes = np.array([t.endswith(CLOSE) for t in tokens])
        self.ranked = tiktoken.Encoding("ranked", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    def _merged(self, spelled: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens each word has, and all of them. spelled: the word's pieces, each with a space after it."""
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(spelled)], pa.int32()), spelled), "")[0].as_py()
        ranks = np.array(self.ranked.encode_ordinary(text), dtype=np.int32)
        ends = np.concatenate(([0], np.flatnonzero(self.closes[ranks]) + 1))
        last = np.cumsum(pc.count_substring(spelled, " ").to_numpy())
        assert len(ends) == (last[-1] if len(last) else 0) + 1
        return np.diff(ends[last], prepend=0), self.ids[ranks]

    def _spell(self, words: pa.Array) -> pa.ListArray:
        """The tokens of each of some different words without white space."""
        plain = pc.and_(pc.match_substring_regex(words, f"^[!-~{LETTERS}]*$"), pc.invert(pc.match_substring(words, "<|")))
        letters, pointed = (pc.match_substring_regex(words, f"^[{LETTERS}]+{c}$") for c in ("", "[,.]"))
        kinds = [letters, pointed, pc.and_not(plain, pc.or_(letters, pointed)), pc.invert(plain)]
        order = np.concatenate([np.flatnonzero(k.to_numpy(zero_copy_only=False)) for k in kinds])
        small = [pc.utf8_lower(words.filter(k)) for k in kinds[:3]]
        small[:2] = [pc.binary_join_element_wise(w, "", " ") for w in small[:2]]
        for c in ",.":
            small[1] = pc.replace_substring(small[1], c, " " + c)
        small[2] = pc.replace_substring_regex(small[2], PRETOKENS, r"\1 ")
        n, ids = self._merged(pa.concat_arrays(small))
        odd = [np.array(e.ids, dtype=np.uint16) for e in self.full.encode_batch_fast(words.filter(kinds[3]).to_pylist(), add_special_tokens=False)]
        ends = np.cumsum([0, *n.tolist(), *map(len, odd)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([ids, *odd])))
        return lists.take(pa.array(np.argsort(order)))

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """uint16 ids of each text, without the end token."""
        rows = pa.record_batch([texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())], ["text"])
        return [ids for step in steps(rows, 0, self.remembered) for ids in self._encode(step.column(0))]

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        found = self._spell(words.dictionary).take(words.indices)
        ends = found.offsets.to_numpy()[np.cumsum([0, *pc.list_value_length(split).to_pylist()])].tolist()
        tokens = found.values.to_numpy()
        return [tokens[a:b] for a, b in pairwise(ends)]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


class Dealer(NamedTuple):
    """What deals documents: centres (a row each), inverse frequencies of hashed terms, and the race of tokens."""

    centres: np.ndarray
    weight: np.ndarray
    race: np.ndarray

    def deal(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The centre of each document, and the number of the token that wins its race."""
        starts = np.cumsum([0, *(len(d) for d in docs)])[:-1]
        first = np.minimum.reduceat(self.race[np.concatenate(docs)], starts)
        return (term_vectors(docs) * self.weight @ self.centres.T).argmax(axis=1), first.view(np.int32)


def _hashed(tokens: np.ndarray) -> np.ndarray:
    return (tokens.astype(np.int64) * 40503 % 65536) // (65536 // WIDTH)


def term_vectors(docs: list[np.ndarray]) -> np.ndarray:
    """A row of logarithmic counts of hashed tokens for each document."""
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    counts = np.bincount(owner * WIDTH + _hashed(np.concatenate(docs)), minlength=len(docs) * WIDTH)
    return np.log1p(counts.reshape(len(docs), WIDTH)).astype(np.float32)


def fit(x: np.ndarray, centres: int) -> Dealer:
    """Spherical k-means of some documents' term vectors, from fixed random starts."""
    rng = np.random.default_rng(11)
    weight = np.log1p(len(x) / ((x > 0).sum(axis=0) + 0.5)).astype(np.float32)
    race = (rng.exponential(size=65536) / weight[_hashed(np.arange(65536))] ** 2).astype(np.float32)
    x = x * weight
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = x[rng.choice(len(x), min(centres, len(x)), replace=False)]
    for _ in range(ROUNDS):
        nearest = (x @ found.T).argmax(axis=1)
        for k in np.unique(nearest):
            mean = x[nearest == k].mean(axis=0)
            found[k] = mean / np.linalg.norm(mean)
    return Dealer(found, weight, race)


def _sampled(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """number, tokens and term vector of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([END], dtype=np.uint16)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                ids = [np.concatenate([i, end]) for i in enc.encode(part.column(1))]
                vectors = pa.FixedSizeListArray.from_arrays(pa.array(term_vectors(ids).ravel()), WIDTH).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) for i in ids], pa.int64()), vectors], ["number", "n", "vector"])

    return run


def dealer_of(rows: DataFrame, vocabulary: str, shard: int) -> Dealer:
    """Fitted on some `SAMPLE` of the rows (number, id, text), of which only term vectors come to the driver."""
    total = rows.count()
    share = F.lit(int((1 << 30) * min(1.0, SAMPLE / max(1, total))))
    some = rows.where(F.pmod(F.xxhash64("number"), F.lit(1 << 30)) < share).select("number", "text")
    got = some.mapInArrow(_sampled(vocabulary), "number long, n long, vector array<float>").toArrow().sort_by("number")
    if not got.num_rows:
        return fit(np.ones((1, WIDTH), dtype=np.float32), 1)
    tokens = float(np.mean(got.column("n").to_numpy())) * total
    x = got.column("vector").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
    return fit(x, int(max(1, min(CENTRES, tokens / shard))))


def _tokenised(path: str, dealer: Dealer) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([END], dtype=np.uint16)
        for step in chain.from_iterable(steps(b, 2, enc.remembered) for b in batches):
            encoded = enc.encode(step.column(2))
            for at in range(0, step.num_rows, 512):
                part = step.slice(at, 512)
                ids = [np.concatenate([i, end]) for i in encoded[at : at + 512]]
                centre, first = dealer.deal(ids)
                packed = pa.array([i.tobytes() for i in ids], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(centre.astype(np.int32)), pa.array(first), pa.array([len(i) for i in ids], pa.int64()), packed],
                    ["number", "id", "centre", "first", "n", "ids"],
                )

    return run


class Shard:
    """A BM25 inverted index of some documents. docs: their token ids."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        self.lengths = np.array([len(d) for d in docs], dtype=np.int64)
        owner = np.repeat(np.arange(n, dtype=np.int64), self.lengths)
        pairs, tf = np.unique(owner << 16 | np.concatenate(docs) if n else np.zeros(0, np.int64), return_counts=True)
        doc, token = pairs >> 16, pairs & 65535
        df = np.bincount(token, minlength=65536)
        idf = np.maximum(0, np.log((n - df + 0.5) / (df + 0.5)))
        norm = K1 * (1 - B + B * self.lengths / max(1.0, self.lengths.mean() if n else 1.0))
        weight = (idf[token] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        telling = (idf[token] > 0) & (df[token] > 1)
        doc, token, weight = doc[telling], token[telling], weight[telling]
        self.first = np.searchsorted(doc, np.arange(n + 1))  # where a document's own terms are
        self.token = token
        order = np.argsort(token, kind="stable")
        self.post_doc, self.post_weight = doc[order], weight[order]
        self.post_first = np.concatenate(([0], np.cumsum(np.bincount(token, minlength=65536))))

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a telling term with the seed, best first."""
        own = self.token[self.first[seed] : self.first[seed + 1]]
        start = self.post_first[own]
        n = self.post_first[own + 1] - start
        ends = np.cumsum(n)
        at = np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        score = np.bincount(self.post_doc[at], self.post_weight[at], len(self.lengths))
        score[used] = 0
        found = np.flatnonzero(score)
        return found[np.lexsort((found, -score[found]))]


def fill(docs: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard."""
    index = Shard(docs)
    n, used = len(docs), np.zeros(len(docs), dtype=bool)
    fallback = iter(np.lexsort((np.arange(n), -index.lengths)).tolist())
    out: list[tuple[int, int, int, int, int]] = []
    sequence, room, queue = 0, window, iter(())
    total = int(index.lengths.sum())
    tail = total - total % window  # tokens from here on don't fill a window
    cuts = [window] * (total // window) + [1 << k for k in range(window.bit_length() - 1, -1, -1) if (total - tail) >> k & 1]
    room = cuts[0] if cuts else 0
    seed = -1
    for _ in range(n):
        doc = next((d for d in queue if not used[d]), -1)
        if doc < 0:
            doc = next(d for d in fallback if not used[d])
            seed = doc
        used[doc] = True
        start, rest = 0, int(index.lengths[doc])
        turned = seed == doc
        while rest:
            part = min(rest, room)
            out.append((doc, start, part, sequence, cuts[sequence] - room))
            start, rest, room = start + part, rest - part, room - part
            if not room:
                sequence += 1
                room, turned = (cuts[sequence] if sequence < len(cuts) else 0), True
        if turned:  # it opened a window: its neighbours come next
            seed = doc
            queue = iter(index.neighbours(doc, used).tolist())
    return out


def _sequence_ids(at: np.ndarray, sequence: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Each sequence by the dense row number of the document that opens it, and how many that document has opened before."""
    if len(number) and int(number.max()) >= (1 << 63) // TURNS:
        raise OverflowError("too many documents for 64-bit sequence numbers")
    opens = np.flatnonzero(np.diff(sequence, prepend=-1))
    doc, turn = at[opens], np.zeros(len(opens), dtype=np.int64)
    for i in range(1, len(opens)):
        turn[i] = turn[i - 1] + 1 if doc[i] == doc[i - 1] else 0
    return (number[doc] * TURNS + turn)[np.searchsorted(opens, np.arange(len(at)), side="right") - 1]


def _packed(window: int) -> Callable[[pa.Table], pa.Table]:
    def run(shard: pa.Table) -> pa.Table:
        ids = shard.column("ids").to_pylist()
        crc = [zlib.crc32(i) for i in ids]
        order = np.lexsort((shard.column("number").to_numpy(), [len(i) for i in ids], crc))
        docs = [np.frombuffer(ids[i], dtype=np.uint16) for i in order.tolist()]
        at, start, length, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*fill(docs, window), strict=True))
        sums = [zlib.crc32(docs[d][s : s + n].astype("<u4").tobytes()) for d, s, n in zip(at.tolist(), start.tolist(), length.tolist(), strict=True)]
        own = _sequence_ids(at, sequence, shard.column("number").to_numpy()[order])
        columns = {
            "doc_id": shard.column("id").take(pa.array(order[at])),
            "start": start,
            "length": length,
            "ids_crc32": np.array(sums, dtype=np.int64),
            "doc_tokens": np.array([len(d) for d in docs], dtype=np.int64)[at],
            "sequence_id": own,
            "offset": offset,
        }
        return pa.table(columns)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """All documents as pieces of sequences of at most `window` tokens; columns: see PIECES. window: a power of two."""
    vocabulary = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()
    tokens = numbered(saved(tokenised(docs, id_col, text_col, vocabulary, shard)))
    return dealt(tokens, shard).groupBy("centre", "piece", "extra").applyInArrow(_packed(window), PIECES.format(id=kind))


def tokenised(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, shard: int = SHARD) -> DataFrame:
    """number, id, centre, first, n (tokens) and ids of each document."""
    rows = docs.select(F.monotonically_increasing_id().alias("number"), F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_tokenised(vocabulary, dealer_of(rows, vocabulary, shard)), f"number long, id {kind}, centre int, first int, n long, ids binary")


def numbered(tokens: DataFrame) -> DataFrame:
    """The written table with its rows' numbers made dense, so that a number and its turns fit 63 bits at any number of tasks.

    monotonically_increasing_id has the task in its upper bits; one small row a task says how many rows came before.
    """
    task = F.shiftright("number", 33)
    sizes = tokens.groupBy(task.alias("task")).agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = tokens.withColumn("task", task).join(F.broadcast(sizes.select("task", before.alias("before"))), "task")
    return told.withColumn("number", F.col("before") + F.col("number").bitwiseAND((1 << 33) - 1)).select(*tokens.columns)


def dealt(tokens: DataFrame, shard: int) -> DataFrame:
    """Tokens (a written table) with piece and extra: a shard's documents have the same centre, piece and extra."""
    pieces = [1] * (CENTRES + 1)
    for r in tokens.groupBy("centre").agg(F.sum("n").alias("n")).collect():  # at most CENTRES rows
        pieces[r.centre] = max(1, round(r.n / shard))
    many = F.get(F.array(*[F.lit(p) for p in pieces]), F.col("centre"))
    rows = tokens.withColumn("piece", F.pmod(F.xxhash64("first"), many).cast("int"))
    sums = rows.groupBy("centre", "piece").agg(F.sum("n").alias("tokens"), F.count("*").alias("many"))
    large = saved(sums.where(F.col("tokens") > 2 * shard).select("centre", "piece", F.ceil(F.col("tokens") / shard).alias("parts"), "many"))
    if large.isEmpty():
        return rows.withColumn("extra", F.lit(0).cast("long"))
    told = heavy_join(rows, large, ["centre", "piece"], "many", tokens.count(), "left")
    return told.withColumn("extra", F.coalesce(F.pmod(F.xxhash64("number"), F.col("parts")), F.lit(0).cast("long"))).drop("parts")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
