"""Operator 13: how far the sources of each language diverge in their words, by a token-start pointer sort.

1. Each task reads Arrow batches and takes documents together up to `SHARD` bytes. Their texts are one byte
   buffer, A-Z lower-cased; a pointer marks where each term (a run of letters or of characters beyond ASCII)
   starts. Nothing is cut out of the buffer.
2. The pointers of each (lang, source) slice are put in order by a multikey quicksort: eight bytes are one
   key digit, and only runs of equal pointers whose terms go on are sorted by the next digit. Equal runs then
   are the terms; a run's length is the count, and its changes of document are the document frequency.
3. Runs (lang, source, term, count, documents) are added up by Spark, combined in each task first. Everything
   after that is relational: terms in at least `LEAST` documents of their language stay, shares are whole
   numbers, and terms are ranked by windows that keep `TOP` rows a group in each task.
4. Pairs of sources: the terms are dealt to blocks, each block holds every source's row of its language, and a
   task adds up |p - q| for all sources at once, `WIDE` terms at a time. It keeps one number for each pair of
   sources, as many as the result has.

Defined cases: null text, lang and source are ''. Texts without terms and empty texts still make their
(lang, source) group occur. Repeated rows count as often as they are there, null ids count like any other,
ties go by the UTF-8 order of the item. Texts and terms of any length are read whole. An empty table gives no rows.
Columns besides text, lang and source don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, saved, whole

#: Documents of its language that a term is in, at least; what is added to each count; the unit of shares; ranks of terms.
LEAST, ADDED, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of text that are sorted together, more or less (a document is never cut).
SHARD = 6 << 20
#: Terms in a block of pairs, more or less, and blocks at most; terms in a dense step.
BLOCK, BLOCKS, WIDE = 4096, 4096, 256

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of terms, after lower-casing: small letters and whatever isn't ASCII.
_TERM = np.array([97 <= c <= 122 or c >= 128 for c in range(256)])
#: What is kept of an eight-byte digit of which only so many bytes belong to the term.
_KEEP = np.array([0] + [(1 << 64) - (1 << (8 * (8 - n))) for n in range(1, 9)], dtype=np.uint64)

RUNS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
PAIRS = "lang string, source string, other string, value long"


def pointers(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where terms start, and their lengths, in texts that follow each other in `data`; a term ends with its text."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _TERM[data]
    begin, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = cuts[(cuts > 0) & (cuts < len(data))]
    begin[edges] = inside[edges + 1]
    end[edges - 1] = inside[edges]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) - starts + 1


def digits(padded: np.ndarray, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes of each term as a number, zero behind its end. `padded` has eight bytes more than its texts."""
    eight = np.ndarray((len(padded) - 7,), dtype=">u8", buffer=padded, strides=(1,))
    return eight[starts].astype(np.uint64) & _KEEP[np.clip(left, 0, 8)]


def equal_runs(padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of the pointers by their terms, and where each run of equal terms starts in it."""
    key = digits(padded, starts, lengths)
    order = np.argsort(key, kind="stable")
    key = key[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = key[1:] != key[:-1]
    at, depth = np.arange(len(order)), 8
    while True:
        # Places of `order` in runs of two or more in which some term goes on.
        run = np.cumsum(fresh[at]) - 1
        more = lengths[order[at]] > depth
        goes = (np.bincount(run, more) > 0) & (np.bincount(run) > 1)
        at = at[goes[run]]
        if not len(at):
            return order, np.flatnonzero(fresh)
        run = np.cumsum(fresh[at])
        own = order[at]
        key = digits(padded, np.minimum(starts[own] + depth, len(padded) - 8), lengths[own] - depth)
        sort = np.lexsort((key, run))
        order[at], key = own[sort], key[sort]
        fresh[at[1:]] |= key[1:] != key[:-1]
        depth += 8


def term_runs(texts: pa.ChunkedArray, group: np.ndarray, names: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """The runs of one shard. group: each text's place in `names` (lang, source)."""
    deal = np.argsort(group, kind="stable")
    texts, group = pa.concat_arrays(texts.cast(pa.large_string()).chunks).take(pa.array(deal)), group[deal]
    cuts = np.frombuffer(texts.buffers()[1], dtype=np.int64)[: len(texts) + 1]
    body = texts.buffers()[2]
    raw = (body.to_pybytes() if body else b"").translate(_LOWER) + bytes(8)
    padded = np.frombuffer(raw, dtype=np.uint8)
    starts, lengths = pointers(padded[:-8], cuts)
    doc = np.searchsorted(cuts, starts, side="right") - 1
    slices = np.searchsorted(group[doc], np.arange(len(names) + 1)) if len(doc) else np.zeros(len(names) + 1, dtype=int)
    for i, (lang, source) in enumerate(names):
        a, b = slices[i], slices[i + 1]
        if a == b:
            continue
        order, runs = equal_runs(padded, starts[a:b], lengths[a:b])
        own = doc[a:b][order]
        seen = np.ones(len(own), dtype=bool)
        seen[1:] = own[1:] != own[:-1]
        seen[runs] = True
        first = a + order[runs]
        terms = [raw[s : s + n].decode() for s, n in zip(starts[first].tolist(), lengths[first].tolist(), strict=True)]
        n = len(terms)
        columns = [pa.repeat(lang, n), pa.repeat(source, n), pa.array(terms, pa.string()), pa.array(np.diff(np.append(runs, b - a))), pa.array(np.add.reduceat(seen.astype(np.int64), runs))]
        yield pa.RecordBatch.from_arrays(columns, schema=RUNS)


def _sorter(shard: int) -> Callable:
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            place: dict[tuple[str, str], int] = {}
            group = [place.setdefault(k, len(place)) for k in zip(table.column("lang").to_pylist(), table.column("source").to_pylist(), strict=True)]
            yield from term_runs(table.column("text"), np.array(group, dtype=np.int64), list(place))

        for b in rows:
            at = 0
            for i, s in enumerate(pc.binary_length(b.column("text")).to_pylist()):
                size += s
                if size >= shard:
                    held.append(b.slice(at, i + 1 - at))
                    yield from flush()
                    held.clear()
                    at, size = i + 1, 0
            if at < b.num_rows:
                held.append(b.slice(at))
        if held:
            yield from flush()

    return batches


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", shard: int = SHARD) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents) of all terms."""
    rows = docs.select(whole(F.col(lang)).alias("lang"), whole(F.col(source)).alias("source"), whole(F.col(text)).alias("text"))
    runs = rows.mapInArrow(_sorter(shard), "lang string, source string, term string, n long, docs long")
    return runs.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """The smoothed share in units of 1 / UNIT, exact for any count."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(F.lit(UNIT)) * wide(n + ADDED), wide(total + ADDED * kept))


def _divergence(wide: int) -> Callable:
    """Rows come sorted by block, lang, kind and term: first the sources of the language (kind 0) with their share of a term they lack."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lang = None, None
        names: list[str] = []
        place: dict[str, int] = {}
        lacking = total = dense = None
        filled, term = 0, None

        def step() -> None:
            for i in range(len(names)):
                total[i, i + 1 :] += np.abs(dense[i + 1 :, :filled] - dense[i, :filled]).sum(axis=1)
            dense[:, :filled] = lacking[:, None]

        def flush() -> Iterator[pa.RecordBatch]:
            if dense is not None and filled:
                step()
            if len(names) < 2:
                return
            sums = total if total is not None else np.zeros((len(names), len(names)), dtype=np.int64)
            for i in range(len(names) - 1):
                n = len(names) - 1 - i
                columns = [pa.repeat(lang, n), pa.repeat(names[i], n), pa.array(names[i + 1 :], pa.string()), pa.array(sums[i, i + 1 :])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "other", "value"])

        for b in rows:
            for block, in_lang, kind, in_term, source, p in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (block, in_lang) != now:
                    if now is not None:
                        yield from flush()
                    now, lang, names, place, lacking, total, dense, filled, term = (block, in_lang), in_lang, [], {}, [], None, None, 0, None
                if kind == 0:
                    place[source] = len(names)
                    names.append(source)
                    lacking.append(p)
                    continue
                if dense is None:
                    lacking = np.array(lacking, dtype=np.int64)
                    total = np.zeros((len(names), len(names)), dtype=np.int64)
                    dense = np.repeat(lacking[:, None], wide, axis=1)
                if in_term != term:
                    if filled == wide:
                        step()
                        filled = 0
                    filled, term = filled + 1, in_term
                dense[place[source], filled - 1] = p
        if now is not None:
            yield from flush()

    return batches


def source_audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: how far other sources are, and the terms that a source has most above its language."""
    counts = saved(term_counts(docs, text, lang, source, shard))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least)
    # A kept term is as frequent in one language as it likes: rows of one (lang, term) are at most the sources.
    rows = saved(counts.join(kept.select("lang", "term", "all_n"), ["lang", "term"]))
    groups = docs.select(whole(F.col(lang)).alias("lang"), whole(F.col(source)).alias("source")).distinct()
    sums = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kinds = rows.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kept"))
    langs = sums.groupBy("lang").agg(F.sum("total").alias("lang_total")).join(kinds, "lang")
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    blocks = F.least(F.lit(BLOCKS), F.floor(F.col("kept") / block) + 1).cast("int")
    groups = saved(groups.withColumn("blocks", blocks).withColumn("lacking", F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(0)))

    told = rows.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("all_n"), F.col("lang_total"), F.col("kept")).alias("q"), F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    )
    every = groups.select(F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "lang", F.lit(0).alias("kind"), F.lit("").alias("term"), "source", F.col("lacking").alias("p"))
    dealt = every.unionByName(told.select("block", "lang", F.lit(1).alias("kind"), "term", "source", "p"))
    dealt = dealt.repartition("block", "lang").sortWithinPartitions("block", "lang", "kind", "term", "source")
    pairs = dealt.mapInArrow(_divergence(WIDE), PAIRS).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = F.array(F.struct(F.col("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))
    pairs = pairs.select("lang", F.explode(both).alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    terms = told.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item")))
    out = [pairs.withColumn("rank", place), terms.withColumn("rank", place).where(F.col("rank") <= top)]
    return out[0].unionByName(out[1]).select("lang", "source", "part", "item", "value", "rank")


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), w AS (
  SELECT row, lang, source, term, count(*) AS n FROM (SELECT row, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL
), k AS (
  SELECT lang, term, sum(n) AS n FROM w GROUP BY lang, term HAVING count(*) >= 30
), c AS (
  SELECT lang, source, term, sum(w.n) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL
), v AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang
), g AS (
  SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + 1000000000 * (coalesce(c.n, 0) + 5) // (g.total + 5 * v.v) AS BIGINT) AS p, CAST(1 + 1000000000 * (k.n + 5) // (v.total + 5 * v.v) AS BIGINT) AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""
