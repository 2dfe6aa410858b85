"""Operator 12: near duplicates by one-permutation MinHash, banded buckets and star-shaped candidate edges.

A document is the set of its runs of `shingle` lower-cased words (fewer words are one shingle). Documents are
linked when their sets' Jaccard similarity reaches `percent` / 100; a component is whatever links join.

1. Each different set is one node, so copies cost nothing further. One hash of each shingle does it all: its top
   bits name one of `BINS` bins, and a bin's value is the least hash in it. An empty bin borrows the value of a
   bin that a hash of (bin, attempt) names, attempts going on until that bin isn't empty: the optimal
   densification, in which any bin of two sets agrees with a chance of their similarity.
2. `BANDS` bands of `ROWS` bins are the keys of buckets. A pair at 0.8 shares no bucket with a chance of
   (1 - 0.8^ROWS)^BANDS = 5e-8.
3. Stars: the members of a bucket are compared with its centre, its least node, so a bucket of n members has n - 1
   candidate edges; edges that several bands name are one. Whole sets decide: centre and members meet in pieces
   of `PIECE` edges, so a hub is spread over many tasks.
4. Members that their star left in different components can still be alike. Such a bucket goes on with more centres,
   `GROWTH` times as many each round, those first that aren't with the first centre; a centre meets
   all members of other components, and then leaves the bucket. A bucket is settled when
   all members left are in one component. A task holds the centres and up to some `MEMBERS` members of a bucket as
   parity bitmaps of their shingles: two bitmaps differ in no more bits than the sets have shingles that
   only one of them has, so most pairs below the threshold are ruled out there, without loss, and only the others become
   edges. No pair is compared twice, and no pair that shares a bucket is left out.

Defined cases: null and empty texts, and texts without words, have the empty set and no links; their component is
themselves. Very long texts are read whole. Repeated rows of a text are one node, each row has its own result; a row
whose id is null takes the least id of its component, and null where none has an id; it counts as kept then only. An
empty table gives no rows. Ties don't arise, as the least id names the component. Columns besides id and text don't
matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, heavy_join, saved, whole
from .components import components

ROWS, BANDS = 4, 32
BINS = ROWS * BANDS
#: Edges of one centre that a task compares together, about; centres of a bucket grow so much from round to round;
#: members of a bucket that a task holds beside its centres, about.
PIECE, GROWTH, MEMBERS = 512, 16, 2048
#: Bits of a bitmap for each shingle, and bits of the smallest.
SPARSE, FEW_BITS = 4, 256
#: Texts that are read together.
TEXTS = 256

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.array([xxhash.xxh64_intdigest(f"odd {i}".encode(), 42) | 1 for i in range(4)], dtype=np.uint64)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
MARKED = "number long, id {id}, n_shingles long, d1 long, d2 long, keys array<bigint>, bits binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _ODD[0]
    x ^= x >> np.uint64(32)
    x *= _ODD[1]
    x ^= x >> np.uint64(29)
    return x


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    each = np.fromiter((digest(w, 42) for w in words), dtype=np.uint64, count=len(words))
    width = min(shingle, len(each))
    last = len(each) - width + 1
    out = np.full(last, width, dtype=np.uint64)
    for i in range(width):
        out = _mix(out ^ each[i : i + last])
    return np.unique(out)


def _donors() -> np.ndarray:
    """For each bin, the bins that it asks in turn; rows of BINS, attempts of columns."""
    bins = np.arange(BINS, dtype=np.uint64)[:, None] << np.uint64(32)
    return (_mix(bins + np.arange(1, 4 * BINS, dtype=np.uint64)[None, :]) >> np.uint64(40)).astype(np.int64) % BINS


_ASKED = _donors()
#: Attempts that are looked at first; most bins need no more.
_SOON = 16


def one_permutation(found: np.ndarray) -> np.ndarray:
    """A value for each of BINS bins of a set, empty ones densified."""
    spread = _mix(found ^ _ODD[2])
    least = np.full(BINS, _EMPTY, dtype=np.uint64)
    np.minimum.at(least, ((spread >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64), spread)
    full = least != _EMPTY
    if full.all():
        return least
    empty = np.flatnonzero(~full)
    asked = full[_ASKED[empty, :_SOON]]
    donor = _ASKED[empty, asked.argmax(axis=1)]
    for i in np.flatnonzero(~asked.any(axis=1)).tolist():
        later = full[_ASKED[empty[i]]]
        # a set of very few shingles may be out of luck at every attempt: the next full bin
        donor[i] = _ASKED[empty[i], later.argmax()] if later.any() else (empty[i] + np.flatnonzero(np.roll(full, -int(empty[i])))[0]) % BINS
    least[empty] = least[donor]
    return least


def band_keys(found: np.ndarray) -> np.ndarray:
    key = np.zeros(BANDS, dtype=np.uint64)
    for part in one_permutation(found).reshape(BANDS, ROWS).T:
        key = _mix(key ^ part)
    return key.view(np.int64)


def parity_bits(found: np.ndarray) -> np.ndarray:
    """A bitmap whose bits are the parities of the numbers of shingles that fall on them; a power of two in size."""
    size = max(FEW_BITS, 1 << int(SPARSE * len(found) - 1).bit_length()) if len(found) else FEW_BITS
    odd = np.bincount((_mix(found ^ _ODD[3]) >> np.uint64(8)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows) as if they had been made with fewer bits."""
    while bits.shape[1] > size:
        bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
    return bits


def _digest(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    raw = xxhash.xxh3_128_digest(found.tobytes())
    return tuple(int.from_bytes(raw[i : i + 8], "big", signed=True) for i in (0, 8))


def _marker(shingle: int) -> Callable:
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                sets = [shingle_set(t.as_py(), shingle) for t in part.column(2)]
                marks = [_digest(s) for s in sets]
                keys = [band_keys(s) if len(s) else None for s in sets]
                columns = [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in marks]), pa.array([m[1] for m in marks]), pa.array(keys, pa.list_(pa.int64())), pa.array([parity_bits(s).tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["number", "id", "n_shingles", "d1", "d2", "keys", "bits"])

    return batches


def _comparer(shingle: int, percent: int) -> Callable:
    """Rows come sorted by centre, piece and place: the centre's text, then those of its members. Sets are made here, as they are larger than their texts."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for b in rows:
            a, node, near = [], [], []
            for centre, piece, member, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                other = shingle_set(text, shingle)
                if (centre, piece) != now:
                    assert member is None
                    now, own = (centre, piece), other
                    continue
                at = np.searchsorted(own, other)
                at[at == len(own)] = 0
                both = int((own[at] == other).sum())
                a.append(centre)
                node.append(member)
                near.append(100 * both >= percent * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(node, pa.int64()), pa.array(near, pa.bool_())], ["centre", "member", "near"])

    return batches


class Sets:
    """The texts of nodes, gathered when a round first asks for them, and kept."""

    def __init__(self, rows: DataFrame, shingle: int):
        self.rows, self.shingle, self.made = rows, shingle, None

    def of(self, nodes: DataFrame) -> DataFrame:
        """node, text of all nodes asked for so far. nodes: different ones."""
        new = nodes if self.made is None else nodes.join(self.made.select("node"), "node", "left_anti")
        made = saved(self.rows.join(saved(new).withColumnRenamed("node", "number"), "number").select(F.col("number").alias("node"), "text"))
        self.made = made if self.made is None else self.made.unionByName(made)
        return self.made


def compared(edges: DataFrame, sets: Sets, percent: int, piece: int = PIECE) -> DataFrame:
    """centre, member and whether they are alike, for each edge (centre, member), all different. Written."""
    have = sets.of(edges.select(F.explode(F.array("centre", "member")).alias("node")).distinct())
    n = edges.groupBy("centre").agg(F.count("*").alias("n"))
    pieces = saved(n.select("centre", "n", F.ceil(F.col("n") / piece).cast("int").alias("pieces")))
    dealt = heavy_join(edges, pieces, ["centre"], "n", edges.count()).select("centre", F.pmod(F.xxhash64("member"), F.col("pieces")).cast("int").alias("piece"), "member")
    centres = pieces.select("centre", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(None).cast("long").alias("member"))
    # A node meets as many texts as it has edges; none has more than one edge for each bucket it is in and centre there, and a centre one row a piece.
    places = dealt.unionByName(centres).withColumn("node", F.coalesce("member", "centre"))
    rows = places.join(have, "node").select("centre", "piece", "member", "text")
    rows = rows.repartition("centre", "piece").sortWithinPartitions("centre", "piece", F.col("member").asc_nulls_first())
    return saved(rows.mapInArrow(_comparer(sets.shingle, percent), "centre long, member long, near boolean"))


def _possible(percent: int) -> Callable:
    """Rows come sorted by bucket (t, key), piece and place: the bucket's centres (0), then members (1)."""

    def survivors(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        place, node, size, root = (np.array([r[i] for r in rows], dtype=np.int64) for i in (3, 4, 5, 6))
        width = np.array([len(r[7]) // 8 for r in rows])
        for w in np.unique(width):
            # members of one width meet all centres; of two widths the larger is folded
            own = np.flatnonzero((place == 1) & (width == w))
            if not len(own):
                continue
            maps = np.frombuffer(b"".join(rows[i][7] for i in own), dtype=np.uint64).reshape(-1, w)
            for i in np.flatnonzero(place == 0):
                other = np.frombuffer(rows[i][7], dtype=np.uint64)[None, :]
                both = min(w, other.shape[1])
                apart = np.bitwise_count(folded(maps, both) ^ folded(other, both)).sum(axis=1, dtype=np.int64)
                shared = (size[own] + size[i] - apart) // 2
                near = (100 * shared >= percent * (size[own] + size[i] - shared)) & (root[own] != root[i])
                if near.any():
                    yield np.full(near.sum(), node[i]), node[own[near]]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            for a, b in survivors(held):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["centre", "member"])

        for b in rows:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if row[:3] != now:
                    yield from flush()
                    now, held = row[:3], []
                held.append(row)
        yield from flush()

    return batches


def links(nodes: DataFrame, sets: Sets, percent: int, piece: int = PIECE, growth: int = GROWTH, most: int = MEMBERS) -> DataFrame:
    """Links (a, b) that join nodes (node, size, keys, bits; a row for each) into their components."""
    nodes = saved(nodes)
    rows = saved(nodes.select(F.posexplode("keys").alias("t", "key"), "node", "size"))
    stars = rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("c")).where("n > 1")
    stars = saved(stars.select("t", "key", "n", F.col("c.node").alias("centre"), F.col("c.size").alias("centre_size")))
    total = stars.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    members = saved(heavy_join(rows, stars, ["t", "key"], "n", total))
    fits = 100 * F.least("size", "centre_size") >= percent * F.greatest("size", "centre_size")
    edges = members.where((F.col("node") != F.col("centre")) & fits).select("centre", F.col("node").alias("member")).distinct()
    done = compared(saved(edges), sets, percent, piece)
    found = done.where("near").select(F.col("centre").alias("a"), F.col("member").alias("b"))

    # Buckets of two are settled by their star, and a star's centre has met all members.
    left = saved(heavy_join(members.where("node <> centre").select("t", "key", "node", "size"), stars.where("n > 2").select("t", "key", "n"), ["t", "key"], "n", total))
    centres = 1
    while not left.isEmpty():
        root = components(found)
        told = left.join(root, "node", "left").select("t", "key", "node", "size", F.coalesce("root", "node").alias("root"))
        ends = saved(told.groupBy("t", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high"))
        if ends.isEmpty():
            break
        n = ends.agg(F.sum("n")).first()[0]
        ends = ends.select("t", "key", "n", "low", F.ceil(F.col("n") / most).cast("int").alias("pieces"))
        told = saved(heavy_join(told, ends, ["t", "key"], "n", n))
        centres *= growth
        # Only the first rows of each bucket leave a task; whoever isn't with the bucket's least root comes first.
        place = F.row_number().over(Window.partitionBy("t", "key").orderBy(F.col("root") == F.col("low"), "node"))
        chosen = saved(told.withColumn("place", place).where(F.col("place") <= centres).drop("place"))
        every = chosen.select("t", "key", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(0).alias("place"), "node", "size", "root")
        met = every.unionByName(told.select("t", "key", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int").alias("piece"), F.lit(1).alias("place"), "node", "size", "root"))
        met = met.join(nodes.select("node", "bits"), "node").select("t", "key", "piece", "place", "node", "size", "root", "bits")
        met = met.repartition("t", "key", "piece").sortWithinPartitions("t", "key", "piece", "place")
        pairs = met.mapInArrow(_possible(percent), "centre long, member long").distinct()
        fresh = saved(pairs.join(done.select("centre", "member"), ["centre", "member"], "left_anti"))
        done = done.unionByName(compared(fresh, sets, percent, piece))
        found = done.where("near").select(F.col("centre").alias("a"), F.col("member").alias("b"))
        left = saved(told.join(chosen.select("t", "key", "node"), ["t", "key", "node"], "left_anti").select("t", "key", "node", "size"))
    return found


def marks(texts: DataFrame, shingle: int, kind: str) -> DataFrame:
    """The written table of number, id, n_shingles, d1 and d2 (the set), keys and bits, a row for each row (number, id, text)."""
    return saved(texts.select("number", "id", "text").mapInArrow(_marker(shingle), MARKED.format(id=kind)))


def nodes_of(marked: DataFrame, sets: DataFrame) -> DataFrame:
    """node, size, keys and bits of the sets that aren't empty. sets: a row for each set, node being the number of one of its rows."""
    rows = marked.where("n_shingles > 0").join(sets.select(F.col("node").alias("number")), "number", "left_semi")
    return rows.select(F.col("number").alias("node"), F.col("n_shingles").alias("size"), "keys", "bits")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2, percent: int = 80, piece: int = PIECE, growth: int = GROWTH, most: int = MEMBERS) -> DataFrame:
    """One row for each document: id, n_shingles, component_id, kept."""
    texts = saved(docs.select(F.monotonically_increasing_id().alias("number"), F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text")))
    marked = marks(texts, shingle, docs.schema[id_col].dataType.simpleString())
    sets = saved(marked.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("number").alias("node"), F.min("id").alias("least"), F.count("*").alias("n")))
    root = saved(components(links(nodes_of(marked, sets), Sets(texts.select("number", "text"), shingle), percent, piece, growth, most)))
    told = saved(sets.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")))
    sizes = saved(told.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_sets")))
    names = saved(heavy_join(told, sizes, ["root"], "n_sets", told.count()).select("d1", "d2", "n", "component_id"))
    rows = marked.select("id", "n_shingles", "d1", "d2")
    met = heavy_join(rows.where("n_shingles > 0"), names, ["d1", "d2"], "n", marked.count()).select("id", "n_shingles", "component_id")
    out = met.unionByName(rows.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir))
