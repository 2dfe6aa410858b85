"""Operator 7: near-duplicates by SimHash, with pivot distance tables.

Equal fingerprints are merged first, so copies cost nothing further. A pair of different
fingerprints that differ in at most `RADIUS` = 4 of 64 bits agrees in at least two of six blocks
of bits; so both meet in one of the 15 buckets keyed by two blocks. Within a bucket the pivot
table works: the Hamming distances of each fingerprint to `PIVOTS` fixed reference fingerprints.
By the triangle inequality no distance to a pivot differs by more than 4 in a link. Members are
sorted by the first distance, so the comparison of a member stops where that coordinate is 4
away; of the rest, pairs whose largest coordinate difference exceeds 4 are discarded, and the
survivors are verified bit by bit. The links that a bucket returns are such pairs, few more than
a spanning forest has.

Pivot distances alone can't name candidates: distances of 64-bit fingerprints gather around 32,
so any split by them keeps most pairs together and work would be quadratic. That's why the
buckets come first; they lose no link.

A bucket of more than `CHUNK` members is cut by the table: by the distance to the first pivot, in ranges of
`RANGE`, then by that to the next one, and so on while a piece is too large and `LEVELS` last. A
member also lies in the range that starts within 4 of its distance, so a pair whose distances differ by at most 4 meets
in the range of the larger one; others are no link. What is still large then are fingerprints so much alike that
the table can't part them. In buckets of more than `MANY` members, whoever is reached from another leaves at once, so a dense
group, which is mostly one component, costs few comparisons for each member; far apart, members are parted by the table.

Defined cases: null text counts as empty; no words give fingerprint zero; rows with equal
fingerprints (repeated rows, too) share a component, named by its smallest id; null ids get a component but never name it (it is null if all
its ids are null). Very long texts count whole. Empty tables give no rows. `near_dedup` keeps one row of each component, even of
rows that are alike in id and text, and columns of any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash_dedup as sets
from .common import boxed, documents, field, heavy_join, saved, unboxed
from .components import components

RADIUS = 4
SHINGLE = 4
PIVOTS = 16
#: Members from which a bucket is cut, the width of a range of distances, and pivots that cut at most.
CHUNK, RANGE, LEVELS = 4096, 6, 4
#: Members up to which the buckets of a task are compared together, step by step.
MANY = 256

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks() -> list[int]:
    """The bits of each two of the six blocks."""
    bits = [((1 << n) - 1) << at for at, n in _BLOCKS]
    return [_signed(a | b) for a, b in combinations(bits, 2)]


def pivots() -> np.ndarray:
    """Fixed reference fingerprints: hashes of 0, 1, 2, ..."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), 42) for i in range(PIVOTS)], dtype=np.uint64)


def simhash(text: str | None) -> int:
    """Signed 64-bit fingerprint of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return _signed(digest(joined, 42))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = len(words) - SHINGLE + 1
    hashes = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[:last].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)), dtype=np.uint64, count=last)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, last, 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return _signed(int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0]))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        marks = pa.array((simhash(t) for t in (x.as_py() for x in b.column(2))), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), marks], ["number", "id", "mark"])


def fingerprints(rows: DataFrame, kind: str) -> DataFrame:
    """The written table of number, id and fingerprint (mark), a row for each row (number, id, text)."""
    return saved(rows.select("number", "id", "text").mapInArrow(_fingerprint_batches, f"number long, id {kind}, mark bigint"))


def _forest(marks: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs that join all buckets of some sorted rows; bucket: a number for each row, equal and adjacent for a bucket."""
    table = np.bitwise_count(marks[:, None] ^ pivots()[None, :]).astype(np.int16)
    order = np.lexsort((table[:, 0], bucket))
    marks, bucket, table = marks[order], bucket[order], table[order]
    root = np.arange(len(marks))

    def top(x: np.ndarray) -> np.ndarray:
        while True:
            up = root[x]
            if (up == x).all():
                return x
            x = up

    none = np.zeros(0, dtype=np.uint64)
    members, others = [none], [none]
    at, step = np.arange(len(marks)), 0
    while True:
        step += 1
        at = at[at + step < len(marks)]
        near = at + step
        open_ = (bucket[at] == bucket[near]) & (table[near, 0] - table[at, 0] <= RADIUS)
        at, near = at[open_], near[open_]
        if not len(at):
            break
        could = np.abs(table[at] - table[near]).max(axis=1) <= RADIUS
        a, b = at[could], near[could]
        linked = np.bitwise_count(marks[a] ^ marks[b]) <= RADIUS
        a, b = a[linked], b[linked]
        while len(a):
            x, y = top(a), top(b)
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            used = root[np.maximum(x, y)] == np.minimum(x, y)
            members.append(marks[a[used]])
            others.append(marks[b[used]])
    return np.concatenate(members), np.concatenate(others)


def _flood(marks: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) of one bucket of many members, or with `pairs` (member, the one it was reached from); different fingerprints.

    Whoever is reached leaves, so members that are joined already are never compared with each other.
    """
    refs = pivots()
    order = np.argsort(np.bitwise_count(marks ^ refs[0]), kind="stable")
    left = marks[order]
    table = np.bitwise_count(left[:, None] ^ refs[None, :]).astype(np.int16)
    members, roots = [], []
    while len(left):
        root, queue = left[0], [(left[0], table[0])]
        left, table = left[1:], table[1:]
        while queue and len(left):
            mark, row = queue.pop()
            low, high = np.searchsorted(table[:, 0], (row[0] - RADIUS, row[0] + RADIUS + 1))
            could = low + np.flatnonzero(np.abs(table[low:high] - row).max(axis=1) <= RADIUS)
            near = could[np.bitwise_count(left[could] ^ mark) <= RADIUS]
            if len(near):
                queue.extend(zip(left[near], table[near], strict=True))
                members.append(left[near])
                roots.append(np.full(len(near), mark if pairs else root))
                left, table = np.delete(left, near), np.delete(table, near, axis=0)
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *members]), np.concatenate([none, *roots])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket (t, key, c); whole buckets are compared together, up to some 64k rows."""
    held: list[np.ndarray] = []

    def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1))))
        sizes = np.diff(np.append(starts, len(rows)))
        marks, bucket = np.ascontiguousarray(rows[:, 3]).view(np.uint64), np.repeat(np.arange(len(starts)), sizes)
        few = (sizes <= MANY)[bucket]
        found = [_forest(marks[few], bucket[few])] if few.any() else []
        found += [_flood(marks[starts[i] : starts[i] + sizes[i]], True) for i in np.flatnonzero(sizes > MANY)]
        for a, b in found:
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    count = 0
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        if not len(rows):
            continue
        held.append(rows)
        count += len(rows)
        if count >= 65536:
            rows = np.concatenate(held)
            last = (rows[:, :3] == rows[-1, :3]).all(axis=1)
            first = int(np.flatnonzero(last)[0])
            if first:
                yield from flush(rows[:first])
            held, count = [rows[first:]], len(rows) - first
    if held:
        yield from flush(np.concatenate(held))


def links(marks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that join all different fingerprints (column mark) at most RADIUS bits apart into their components."""
    keys = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.col("mark").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks())]))
    rows = marks.select("mark", keys.alias("k")).select("k.t", "k.key", F.lit(0).cast("long").alias("c"), "mark")
    done = None
    for level in range(LEVELS):
        large = rows.groupBy("t", "key", "c").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
        large = saved(large)
        if large.isEmpty():
            break
        keys = ["t", "key", "c"]
        small = rows.join(large.select(*keys), keys, "left_anti")
        done = small if done is None else done.unionByName(small)
        total = large.agg(F.sum("n")).first()[0]
        cut = heavy_join(saved(rows), large, keys, "n", total)
        distance = F.bit_count(F.col("mark").bitwiseXOR(F.lit(_signed(int(pivots()[level])))))
        ranges = F.array_distinct(F.array(F.floor(distance / RANGE), F.floor((distance + RADIUS) / RANGE)))
        # 64 / RANGE + 1 ranges have a number below 16, with room for each level before
        rows = saved(cut.select("t", "key", F.explode(ranges).alias("r"), "c", "mark").select("t", "key", (F.col("c") * 16 + F.col("r") + 1).alias("c"), "mark"))
    rows = rows if done is None else done.unionByName(rows)
    return rows.repartition("t", "key", "c").sortWithinPartitions("t", "key", "c").mapInArrow(_links, "a bigint, b bigint")


def _confirmed(marked: DataFrame, nodes: DataFrame, whole_sets: sets.Sets, percent: float) -> DataFrame:
    """Links (a, b) of nodes whose fingerprints link and whose whole sets are alike. Written.

    A fingerprint's first node meets its other nodes and the first ones of the fingerprints that it links with.
    """
    own = marked.select("number", "mark").join(nodes.select(F.col("node").alias("number")), "number")
    firsts = saved(own.groupBy("mark").agg(F.min("number").alias("first"), F.count("*").alias("n")))
    copies = heavy_join(saved(own), firsts, ["mark"], "n", own.count()).where("number <> first").select(F.col("first").alias("a"), F.col("number").alias("b"))
    name = lambda side: firsts.select(F.col("mark").alias(side), F.col("first").alias(f"{side}_first"))
    pairs = links(firsts.select("mark")).distinct().join(name("a"), "a").join(name("b"), "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    both = pairs.unionByName(copies).select(F.least("a", "b").alias("centre"), F.greatest("a", "b").alias("member")).distinct()
    done = sets.compared(saved(both), whole_sets, percent)
    return done.where("near").select(F.col("centre").alias("a"), F.col("member").alias("b"))


def _classes(rows: DataFrame, kind: str, shingle: int, similarity: float | None) -> DataFrame:
    """number, id, mark, component_id and keeper (the number of the row that names the component, if any id does). rows: number, id, text.

    Rows of one fingerprint are one node; with a similarity, rows of one set of shingles are.
    """
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "number"))).alias("first")
    if similarity is None:
        if shingle != SHINGLE:
            raise ValueError("fingerprints have shingles of SHINGLE words")
        marked, same = fingerprints(rows, kind), ["mark"]
        nodes = saved(marked.groupBy(*same).agg(F.any_value("mark").alias("node"), first, F.count("*").alias("rows")))
        found = links(nodes.select("mark"))
    else:
        full, same = sets.marks(rows, shingle, kind), ["d1", "d2"]
        marked = full.select("number", "id", *same)
        nodes = saved(marked.groupBy(*same).agg(F.min("number").alias("node"), first, F.count("*").alias("rows")))
        whole_sets, percent = sets.Sets(rows, shingle), round(100 * similarity, 9)
        near = _confirmed(fingerprints(rows, kind), nodes, whole_sets, percent)
        found = sets.links(sets.nodes_of(full, nodes), whole_sets, percent).unionByName(near)
    named = nodes.join(components(found), "node", "left").select(*same, "node", "first", "rows", F.coalesce("root", "node").alias("root"))
    named = saved(named)
    least = saved(named.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("marks")))
    told = heavy_join(named.select(*same, "node", "rows", "root"), least, ["root"], "marks", named.count())
    told = saved(told.select(*same, "node", F.col("least.id").alias("component_id"), F.col("least.number").alias("keeper"), "rows"))
    out = heavy_join(marked, told, same, "rows", marked.count())
    return out.select("number", "id", F.col("node").alias("mark"), "component_id", "keeper")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """One row for each row of `docs`: id, mark, component_id (smallest id reachable).

    Without a similarity, links and marks are those of the fingerprints (shingles of SHINGLE words, RADIUS bits). With
    one, links are all pairs whose sets of `shingle`-word shingles reach that Jaccard similarity: those that fingerprints and
    pivot tables link, confirmed on whole sets, and the others by operator 12's bands, stars and whole sets, as most such
    pairs differ in far more bits than fingerprints allow; marks number the sets.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("number"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows if similarity is None else saved(rows)
    return _classes(rows, docs.schema[id_col].dataType.simpleString(), shingle, similarity).select("id", "mark", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The rows of `docs` that stay: the one whose id names its component. Components without any id stay whole.

    The rows are written once, numbered, so that what goes is told by number, whatever ids there are.
    """
    rows = saved(boxed(docs).withColumn("number", F.monotonically_increasing_id()))
    texts = rows.select("number", field(id_col).alias("id"), field(text_col).alias("text"))
    classes = _classes(texts, docs.schema[id_col].dataType.simpleString(), shingle, similarity)
    gone = saved(classes.where("keeper IS NOT NULL AND number <> keeper").select("number"))
    return unboxed(rows.join(gone, "number", "left_anti"), docs.columns)


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_classes(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")
