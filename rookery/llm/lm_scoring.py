"""Operator 1: masked pseudo-likelihood of documents under a bidirectional window network.

Every word w of a text is hidden in turn and predicted from the `SIDE` words on either side of it;
the summed log-probabilities score the document. With v(w) the slot of a word,

    log p(w | sides) = log p(class of v | sides) + log p(v | class, sides) + log n(w) / n(v).

* Word counts n(w) are gathered from the whole corpus in a shuffle and stay a table that grows
  with it. The `Shape.frequent` words that occur most often have a slot of their own, where the last
  term is 0. All others share the remaining slots by their first two letters, so the probabilities
  of all words of the corpus sum to one.
* The network: a vector for each slot, scaled by position and summed over the sides, through tanh, to a
  softmax over classes of slots and one over the slots of the class.
* Training covers every word. Each task trains a copy of the network in numpy, by Adagrad, over its
  part of a slice of the corpus; then weights and squared gradients are averaged by place in a
  shuffle, in proportion to the words each copy has seen, and the next slice starts from them.
  A corpus of fewer than `LEAST` words is passed several times.
* Counts travel to the texts in two ways: those of the `DIRECT` most frequent words (a fixed
  bound: 8 bytes a word and 8 a count) with the tasks; the remaining words go to the counts in a
  join, none of them frequent. Both ways give the same number.

Defined cases: null and empty texts have no words, log-likelihood 0 and a null mean. Null and
repeated ids are scored row by row, and repeated rows score alike; there are no ties to break but those of equally
frequent words, which go by hash. A very long text is scored as a whole, in steps of bounded
memory. An empty corpus gives no rows. Columns besides id and text don't matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import pairwise, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, saved, shared_folder, steps, whole, words_of

#: Slices of the corpus; the weights are averaged after each.
SLICES = 4
#: Words that training sees at least, and passes that this may take at most.
LEAST, PASSES = 4_000_000, 8
#: Words of a slice that are worth a training task of their own.
TASK = 250_000
#: Adagrad's rate, and the squared gradients it starts from.
RATE, START = 0.2, 1e-7
#: Words a step of training takes, and one of scoring.
STEP = 8192
SCORE_STEP = 65536
#: Rows of a step whose scores are held at once: small arrays are used again from the cache, large ones are paged in anew each time.
BLOCK = 512
#: Words whose counts travel with the tasks, and bytes of text whose different words are looked up together.
DIRECT = 262_144
REMEMBERED = 4_000_000
#: Numbers in a row of weights.
ROW = 1024
#: Unit of the summed logarithms: whole numbers, so that reruns agree.
UNIT = 1e9


class Shape(NamedTuple):
    vocabulary: int = 4096
    frequent: int = 3072
    classes: int = 64
    width: int = 16
    side: int = 2

    @property
    def members(self) -> int:
        return self.vocabulary // self.classes

    def slot(self, rank):
        """Slots by rank: frequent words first, then the shared ones; classes take turns, so all are about as likely."""
        return rank % self.classes * self.members + rank // self.classes

    def parts(self) -> dict[str, tuple[int, ...]]:
        return {
            "vector": (self.vocabulary + 1, self.width),
            "scale": (2 * self.side, self.width),
            "class_w": (self.width, self.classes),
            "class_b": (self.classes,),
            "slot_w": (self.classes, self.width, self.members),
            "slot_b": (self.classes, self.members),
        }

    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.parts().values())

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, s in self.parts().items():
            n = int(np.prod(s))
            out[name] = flat[at : at + n].reshape(s)
            at += n
        return out


class State(NamedTuple):
    """Weights, and the sums of squared gradients."""

    flat: np.ndarray
    seen: np.ndarray


def start(shape: Shape, counts: np.ndarray) -> State:
    """Small fixed pseudo-random weights; the biases are the log frequencies of classes and slots."""
    rng = np.random.default_rng(7)
    smooth = (counts + 0.5).reshape(shape.classes, shape.members)
    fixed = {
        "scale": np.ones(shape.parts()["scale"]),
        "class_b": np.log(smooth.sum(axis=1) / smooth.sum()),
        "slot_b": np.log(smooth / smooth.sum(axis=1, keepdims=True)),
    }
    flat = np.concatenate([(fixed[n] if n in fixed else rng.normal(0, 0.1, s)).ravel() for n, s in shape.parts().items()]).astype(np.float32)
    return State(flat, np.full_like(flat, START))


def _blocks(n: int, start: int = 0) -> list[slice]:
    return [slice(a, min(a + BLOCK, n)) for a in range(start, n, BLOCK)]


def _bounded(w: np.ndarray) -> bool:
    """Whether no score of hidden values, which are within -1 and 1, can leave what exp takes in single precision."""
    return bool(np.abs(w).sum(axis=-2).max() < 80)


class Network:
    def __init__(self, shape: Shape, state: State):
        self.shape, self.flat, self.seen = shape, state.flat.copy(), state.seen.copy()
        self.w = shape.views(self.flat)
        self.each = np.empty((shape.width, 0))
        self.held = np.empty(BLOCK * max(shape.classes, shape.members), dtype=np.float32)

    def _layers(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights of classes, and of slots by class, each with its biases as the last row."""
        return np.vstack([self.w["class_w"], self.w["class_b"]]), np.concatenate([self.w["slot_w"], self.w["slot_b"][:, None]], axis=1)

    def _scores(self, h: np.ndarray, w: np.ndarray, bounded: bool) -> np.ndarray:
        """Scores of some rows up to a number for each row; they hold until the next call."""
        x = np.matmul(h, w, out=self.held[: len(h) * w.shape[1]].reshape(len(h), -1))
        if not bounded:
            x -= x.max(axis=-1, keepdims=True)
        return x

    def _log_p(self, h: np.ndarray, w: np.ndarray, bounded: bool, chosen: np.ndarray) -> np.ndarray:
        """Log-softmax of one chosen column a row."""
        x = self._scores(h, w, bounded)
        own = x[np.arange(len(x)), chosen]
        return own - np.log(np.exp(x, out=x).sum(axis=-1))

    def _errors(self, h: np.ndarray, w: np.ndarray, bounded: bool, chosen: np.ndarray) -> np.ndarray:
        """Softmax less one at the chosen column."""
        x = self._scores(h, w, bounded)
        np.exp(x, out=x)
        x /= x.sum(axis=-1, keepdims=True)
        x[np.arange(len(x)), chosen] -= 1
        return x

    def _hidden(self, sides: np.ndarray) -> np.ndarray:
        """Hidden values, and a last column of ones for the biases."""
        beside = [self.w["vector"] * scale for scale in self.w["scale"]]
        out = np.ones((len(sides), self.shape.width + 1), dtype=np.float32)
        for rows in _blocks(len(sides)):
            at = np.ascontiguousarray(sides[rows].T)
            total = beside[0].take(at[0], axis=0)
            for k in range(1, len(at)):
                total += beside[k].take(at[k], axis=0)
            np.tanh(total, out=out[rows, :-1])
        return out

    def _sorted(self, slots: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order by class, and (class, from, to) of each class that occurs."""
        classes = (slots // self.shape.members).astype(np.uint16)
        order = np.argsort(classes, kind="stable")
        cuts = np.searchsorted(classes[order], np.arange(self.shape.classes + 1)).tolist()
        return order, [(c, a, b) for c, (a, b) in enumerate(pairwise(cuts)) if a < b]

    def log_p(self, slots: np.ndarray, sides: np.ndarray) -> np.ndarray:
        """Log-probability of each slot given its sides (columns: positions)."""
        order, classes = self._sorted(slots)
        slots, h, m = slots[order], self._hidden(sides[order]), self.shape.members
        out, (top, low) = np.empty(len(slots), dtype=np.float32), self._layers()
        bounded = _bounded(top) and _bounded(low)
        for rows in _blocks(len(slots)):
            out[rows] = self._log_p(h[rows], top, bounded, slots[rows] // m)
        for c, a, b in classes:
            for rows in _blocks(b, a):
                out[rows] += self._log_p(h[rows], low[c], bounded, slots[rows] % m)
        back = np.empty_like(out)
        back[order] = out
        return back

    def learn(self, slots: np.ndarray, sides: np.ndarray, rate: float) -> None:
        """One Adagrad step on the mean loss of some words."""
        order, classes = self._sorted(slots)
        slots, sides, m, n = slots[order], sides[order], self.shape.members, len(slots)
        h, (top, low) = self._hidden(sides), self._layers()
        bounded = _bounded(top) and _bounded(low)
        g, g_top, g_low = np.zeros_like(self.flat), np.zeros_like(top), np.zeros_like(low)
        part = self.shape.views(g)
        dh = np.empty((n, self.shape.width), dtype=np.float32)
        for rows in _blocks(n):
            d = self._errors(h[rows], top, bounded, slots[rows] // m)
            g_top += h[rows].T @ d
            np.matmul(d, top[:-1].T, out=dh[rows])
        for c, a, b in classes:
            for rows in _blocks(b, a):
                d = self._errors(h[rows], low[c], bounded, slots[rows] % m)
                g_low[c] += h[rows].T @ d
                dh[rows] += d @ low[c, :-1].T
        part["class_w"][:], part["class_b"][:] = g_top[:-1], g_top[-1]
        part["slot_w"][:], part["slot_b"][:] = g_low[:, :-1], g_low[:, -1]
        dh *= 1 - h[:, :-1] ** 2
        vector, scale = self.w["vector"], self.w["scale"]
        beside = np.ascontiguousarray(sides.T)
        if self.each.shape[1] != beside.size:
            self.each = np.empty((self.shape.width, beside.size))
        for k in range(len(beside)):
            for rows in _blocks(n):
                part["scale"][k] += np.einsum("ij,ij->j", vector.take(beside[k, rows], axis=0), dh[rows])
            self.each[:, k * n : (k + 1) * n] = (dh * scale[k]).T
        beside = beside.ravel()
        for x in range(self.shape.width):
            part["vector"][:, x] += np.bincount(beside, self.each[x], self.shape.vocabulary + 1)
        g /= n
        self.seen += g * g
        g *= rate
        g /= np.sqrt(self.seen)
        self.flat -= g


def windows(docs: list[np.ndarray], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """All slots of some documents, one after another, and those beside each; the number after the vocabulary stands outside a text."""
    pad = np.full(shape.side, shape.vocabulary, dtype=np.int64)
    line = np.concatenate([pad, *(x for d in docs for x in (d, pad))]) if docs else pad
    at = np.flatnonzero(line < shape.vocabulary)
    steps = [k for k in range(-shape.side, shape.side + 1) if k]
    return line[at], np.stack([line[at + k] for k in steps], axis=1) if len(at) else np.zeros((0, len(steps)), np.int64)


class Lexicon:
    """Slots and counts of words: of `DIRECT` words by their hashes, of the others by their first letters."""

    def __init__(self, shape: Shape, hashes: np.ndarray, counts: np.ndarray, shared: np.ndarray):
        """hashes, counts: of the most frequent words, in order; shared: words in each shared slot."""
        self.shape, self.hashes, self.counts, self.shared = shape, hashes, counts, shared
        self.key = uuid.uuid4().hex

    def slot_counts(self) -> np.ndarray:
        out = np.zeros(self.shape.vocabulary)
        own = self.counts[: self.shape.frequent]
        out[self.shape.slot(np.arange(len(own)))] = own
        out[self.shape.slot(self.shape.frequent + np.arange(len(self.shared)))] = self.shared
        return out


def _hashes(words: pa.Array) -> np.ndarray:
    """As Spark's xxhash64 of each string."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words.cast(pa.binary()).to_numpy(zero_copy_only=False), repeat(42)), np.uint64, len(words)).view(np.int64)


def shared_numbers(words: pa.Array, shape: Shape) -> np.ndarray:
    first = pc.utf8_slice_codeunits(words, 0, 2).dictionary_encode()
    return (_hashes(first.dictionary) % (shape.vocabulary - shape.frequent))[first.indices.to_numpy()]


class Reader:
    """Words of texts as slots; within a step, each different word is looked up once, all of them together."""

    def __init__(self, lexicon: Lexicon, remembered: int = REMEMBERED):
        self.lexicon, self.shape, self.remembered = lexicon, lexicon.shape, remembered
        self.order = np.argsort(lexicon.hashes)
        self.ordered = lexicon.hashes[self.order]

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """slots, logs (log n(w) / n(v), without n(w) where it isn't known here) and rest (the hash where it isn't, else 0) of different words."""
        shape, h, k = self.shape, _hashes(words), shared_numbers(words, self.shape)
        rank, known = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        if len(self.ordered):
            at = np.minimum(np.searchsorted(self.ordered, h), len(self.ordered) - 1)
            known, rank = self.ordered[at] == h, self.order[at]
        own = known & (rank < shape.frequent)
        slots = np.where(own, shape.slot(rank), shape.slot(shape.frequent + k)).astype(np.uint16)
        count = np.where(known, self.lexicon.counts[rank], 1) if len(self.ordered) else 1
        logs = np.where(own, 0.0, np.log(count / np.maximum(self.lexicon.shared, 1)[k]))
        return slots, logs, np.where(known, 0, h)

    def read(self, texts: list[str] | pa.Array) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        """Words in each text, and slots, logs and rest of all words."""
        split = pc.ascii_split_whitespace(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        words = split.flatten()
        some = pc.not_equal(words, "")  # white space at an end of a text leaves an empty word there
        before = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))
        lengths = np.diff(before[np.cumsum([0, *pc.list_value_length(split).to_pylist()])]).tolist()
        found = words.filter(some).dictionary_encode()
        at = found.indices.to_numpy()
        slots, logs, rest = self._known(found.dictionary)
        return lengths, slots[at], logs[at], rest[at]


_readers: dict[str, Reader] = {}


def _reader(lexicon: Lexicon) -> Reader:
    """One at a time in each worker."""
    if lexicon.key not in _readers:
        _readers.clear()
        _readers[lexicon.key] = Reader(lexicon)
    return _readers[lexicon.key]


def _in_slots(lexicon: Lexicon) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(lexicon)
        for batch in batches:
            for part in steps(batch, 2, reader.remembered):
                lengths, slots, logs, rest = reader.read(part.column(2))
                ends = np.cumsum([0, *lengths]).tolist()
                spans = list(pairwise(ends))
                asked = [rest[a:b][rest[a:b] != 0] for a, b in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(lengths, pa.int64()),
                        pa.array([slots[a:b].tobytes() for a, b in spans], pa.binary()),
                        pa.array([float(logs[a:b].sum()) for a, b in spans], pa.float64()),
                        pa.array(asked, pa.list_(pa.int64())),
                    ],
                    ["row", "id", "n_words", "slots", "logs", "rest"],
                )

    return run


def word_counts(docs: DataFrame, shape: Shape, text_col: str) -> DataFrame:
    """The written table of all words: h (hash), n (how often), k (the slot it would share)."""
    words = docs.select(F.explode(words_of(whole(F.col(text_col)))).alias("w"))
    shared = F.pmod(F.xxhash64(F.substring("w", 1, 2)), F.lit(shape.vocabulary - shape.frequent)).cast("int")
    words = words.select(F.xxhash64("w").alias("h"), shared.alias("k"))
    return saved(words.groupBy("h").agg(F.count("*").alias("n"), F.min("k").alias("k")))  # numbers only, so nothing is sorted


def lexicon_of(counts: DataFrame, shape: Shape, direct: int = DIRECT) -> Lexicon:
    """To the driver come `direct` words and a number for each shared slot."""
    top = counts.orderBy(F.col("n").desc(), "h").limit(max(direct, shape.frequent)).select("h", "n").toArrow()
    hashes, n = (top.column(c).to_numpy().astype(np.int64) for c in ("h", "n"))
    shared = np.zeros(shape.vocabulary - shape.frequent)
    for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect():
        shared[r.k] = r.n
    own = counts.sparkSession.createDataFrame([(int(h),) for h in hashes[: shape.frequent]], "h long")
    for r in counts.join(F.broadcast(own), "h").groupBy("k").agg(F.sum("n").alias("n")).collect():
        shared[r.k] -= r.n
    return Lexicon(shape, hashes, n, shared)


def in_slots(docs: DataFrame, lexicon: Lexicon, id_col: str, text_col: str) -> DataFrame:
    """The written table of row (a number), id, n_words, slots, logs, rest and slice, a row for each document."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    rows = rows.mapInArrow(_in_slots(lexicon), f"row long, id {kind}, n_words long, slots binary, logs double, rest array<bigint>")
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(SLICES)).cast("int"))
    path = f"{shared_folder(docs.sparkSession)}/{uuid.uuid4().hex}"
    rows.write.partitionBy("slice").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def _numbers(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=np.uint16).astype(np.int64) if x.is_valid else np.zeros(0, np.int64) for x in column]


def _grouped(docs: list[np.ndarray], least: int) -> Iterator[list[np.ndarray]]:
    held, n = [], 0
    for d in docs:
        held.append(d)
        n += len(d)
        if n >= least:
            yield held
            held, n = [], 0
    if held:
        yield held


def _trainer(shape: Shape, state: State, rate: float, step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, n = Network(shape, state), 0
        for batch in batches:
            for docs in _grouped(_numbers(batch.column(0)), 16 * step):
                slots, sides = windows(docs, shape)
                for at in range(0, len(slots), step):
                    net.learn(slots[at : at + step], sides[at : at + step], rate)
                n += len(slots)
        if n:
            rows = -(-len(net.flat) // ROW)
            for part, flat in enumerate((net.flat, net.seen)):
                values = np.zeros(rows * ROW, dtype=np.float32)
                values[: len(flat)] = flat
                lists = pa.FixedSizeListArray.from_arrays(pa.array(values), ROW).cast(pa.list_(pa.float32()))
                numbers = np.arange(rows, dtype=np.int32) + part * rows
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(np.full(rows, n, dtype=np.float64)), lists], ["row", "n", "w"])

    return run


def _mean(rows: pa.Table) -> pa.Table:
    """One row of the weighted mean of vectors of the same place."""
    n = rows.column("n").to_numpy()
    vectors = np.stack([x.values.to_numpy(zero_copy_only=False) for x in rows.column("w").combine_chunks()])
    mean = (n @ vectors / n.sum()).astype(np.float32)
    return pa.table({"row": rows.column("row")[:1], "n": pa.array([n.sum()]), "w": pa.array([mean], pa.list_(pa.float32()))})


def averaged(rows: DataFrame, shape: Shape, part: int = 64) -> State | None:
    """Weights and squared gradients averaged by place, in two steps of few vectors each. rows: row, n, w of all copies."""
    schema = "row int, n double, w array<float>"
    some = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(part)))
    some = some.groupBy("row", "part").applyInArrow(lambda t: _mean(t.drop_columns(["part"])), schema)
    got = some.groupBy("row").applyInArrow(_mean, schema).select("row", "w").toArrow().sort_by("row")
    if not got.num_rows:
        return None
    both = np.array(got.column("w").combine_chunks().values.to_numpy(zero_copy_only=False), dtype=np.float32).reshape(2, -1)[:, : shape.size()]
    return State(both[0], both[1])


def train(words: DataFrame, shape: Shape, counts: np.ndarray, rate: float = RATE, step: int = STEP, least: int = LEAST, task: int = TASK) -> State:
    """words: slots and slice. counts: words in each slot, all of which the passes see."""
    total = int(counts.sum())
    state = start(shape, counts)
    passes = min(PASSES, max(1, -(-least // max(1, total))))
    slices = max(1, SLICES // passes)
    for done in range(passes * slices):
        rows = words if slices == 1 else words.where(F.pmod("slice", F.lit(slices)) == done % slices)
        tasks = max(1, total // slices // task)
        copies = rows.select("slots").coalesce(tasks).mapInArrow(_trainer(shape, state, rate, step), "row int, n double, w array<float>")
        state = averaged(copies, shape) or state
    return state


def _scorer(shape: Shape, state: State) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of row, id, n_words, logs, slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(shape, state)
        for batch in batches:
            totals = []
            for docs in _grouped(_numbers(batch.column(4)), SCORE_STEP):
                slots, sides = windows(docs, shape)
                each = np.concatenate([np.zeros(1), *(net.log_p(slots[at : at + SCORE_STEP], sides[at : at + SCORE_STEP]) for at in range(0, len(slots), SCORE_STEP))], dtype=np.float64)
                ends = np.cumsum([0] + [len(d) for d in docs])
                totals += np.diff(np.cumsum(each)[ends]).tolist()
            sums = pa.array(np.array(totals) + batch.column(3).to_numpy(zero_copy_only=False), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sums], ["row", "id", "n_words", "score"])

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape = Shape(), direct: int = DIRECT) -> DataFrame:
    """One row for each row of `docs`: id, n_words, log_likelihood, mean_log_likelihood."""
    counts = word_counts(docs, shape, text_col)
    lexicon = lexicon_of(counts, shape, direct)
    words = in_slots(docs, lexicon, id_col, text_col)
    state = train(words, shape, lexicon.slot_counts())
    kind = docs.schema[id_col].dataType.simpleString()
    out = words.select("row", "id", "n_words", "logs", "slots").mapInArrow(_scorer(shape, state), f"row long, id {kind}, n_words long, score double")
    least = int(lexicon.counts[-1]) if len(lexicon.counts) >= direct else 0
    if least > 1:  # words that occur once need no count: log 1 is 0
        known = counts.where((F.col("n") > 1) & (F.col("n") <= least)).select("h", F.round(F.log("n") * UNIT).cast("long").alias("x"))
        asked = words.where(F.size("rest") > 0).select("row", F.explode("rest").alias("h"))
        more = asked.join(known, "h").groupBy("row").agg(F.sum("x").alias("x"))
        out = saved(out).join(more, "row", "left").withColumn("score", F.col("score") + F.coalesce(F.col("x"), F.lit(0)) / UNIT)
    return out.select(F.col("id").alias(id_col), "n_words", F.col("score").alias("log_likelihood"), F.try_divide("score", "n_words").alias("mean_log_likelihood"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
