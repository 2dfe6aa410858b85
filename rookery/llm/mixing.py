"""Operator 8: mixing sources to target weights by the cube method.

Sources weigh 1, 2, 3, repeating in code point order, null last. Their targets share all words
by weight, none above `MOST` times its own size. A source whose target is r times its size takes
every document floor(r) times; one copy more is drawn with probability r - floor(r) by balanced
sampling. The cube method's flight phase moves the vector of probabilities along directions in
the null space of two constraints, total words and total documents, until in every block of
some `BLOCK` documents at most two probabilities are still fractional. Those of a thousand
blocks or so then form one block of the next level, and so on, until one small block is left in
each source, where the landing drops the constraint on documents, and then that on words. A large
document can stay fractional to the end; so, last, single documents of the last block are flipped
while that brings the words nearer to their total. That step is outside the method: probabilities of the last
block's documents, `BLOCK` of a source at most, hold no longer exactly.

Rows are numbered in a written table, and only numbers, sources and sizes are shuffled. Blocks go by a
hash of the row's content and are worked off in a fixed order, so reruns agree. Rows that are alike fall
into one block; a block that has grown too large is dealt again by row numbers. No task holds more than some
blocks.

Defined cases: null text has size 0, and so has an empty one; a very long one counts whole. Null is a source of
its own; null and repeated ids, and repeated rows, are rows like any others; ties in size go by hash; an
empty table gives no rows. No document is taken more than `MOST` times. `mix` keeps columns of any names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import global_rank
from .common import SPACE, boxed, documents, field, heavy_join, saved, unboxed, whole

WEIGHTS = (1, 2, 3)
MOST = 3
#: Rows that a block of the flight has, more or less.
BLOCK = 2000
SEED = 42


def _key(row_id: Column, text: Column, source: Column) -> Column:
    return F.xxhash64(row_id, F.lit(SEED), text, F.lit(SEED), source)


def numbered_sizes(rows: DataFrame, text_col: str, source_col: str, id_col: str) -> DataFrame:
    """The written table of number, source, size and key (a hash of the content). rows: number and row."""
    size = F.regexp_count(whole(field(text_col)), F.lit(f"[^{SPACE}]+")).cast("long")
    key = _key(field(id_col), field(text_col), field(source_col))
    return saved(rows.select("number", field(source_col).alias("source"), size.alias("size"), key.alias("key")))


def targets(rows: DataFrame) -> DataFrame:
    """A row for each source: source, total (words), rows, target.

    The excess of sources above their caps is reshared, one aggregate over the sources a round, until no
    further source reaches its cap.
    """
    each = saved(rows.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("rows")))
    ranked = global_rank(each.select("source", F.col("source").isNull().alias("none")), ["none", "source"])
    weight = F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))).cast("int"))
    ranked = ranked.select(F.col("source").alias("named"), weight.alias("w"))
    each = each.join(ranked, each["source"].eqNullSafe(ranked["named"])).drop("named")
    each = saved(each.withColumn("cap", F.col("total") * float(MOST)))
    everything = float(each.agg(F.sum("total")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("w")
        part = each.agg(F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("used"), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0)).alias("w")).first()
        if part.n == capped or not part.w:
            break
        level, capped = (everything - part.used) / part.w, part.n
    target = F.least(F.col("cap"), F.lit(level) * F.col("w"))
    return each.select("source", "total", "rows", target.alias("target"))


def fly(size: np.ndarray, p: np.ndarray, draw: Callable[[], float], land: bool) -> np.ndarray:
    """Flight over units in order, keeping sum(p) and sum(p * size); then, if `land`, the landing."""
    start, p = p, p.astype(float).copy()
    live: list[int] = []
    eps = 1e-9

    def move(units: list[int], u: list[float]) -> None:
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(units, u, strict=True) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(units, u, strict=True) if x)
        step = up if draw() * (up + down) < down else -down
        for i, x in zip(units, u, strict=True):
            moved = p[i] + step * x
            p[i] = 0.0 if moved < eps else 1.0 if moved > 1 - eps else moved

    def settle() -> None:
        live[:] = [i for i in live if 0 < p[i] < 1]

    for i in np.flatnonzero((p > 0) & (p < 1)).tolist():
        live.append(i)
        while len(live) == 3:
            a, b, c = (float(size[k]) for k in live)
            u = [b - c, c - a, a - b]  # orthogonal to (1, 1, 1) and (a, b, c)
            move(live, u if any(u) else [1.0, -1.0, 0.0])
            settle()
    if land:
        if len(live) == 2:  # the documents' constraint goes; words stay in balance
            a, b = (float(size[k]) for k in live)
            move(live, [b, -a] if a and b else [1.0, -1.0])
            settle()
        while live:
            move(live[:1], [1.0])
            settle()
        _settle_words(size.astype(float), start, p)
    return p


def _settle_words(size: np.ndarray, start: np.ndarray, p: np.ndarray) -> None:
    """Flip single documents of the last block while that brings the words nearer to their total."""
    free = np.flatnonzero((start > 0) & (start < 1))
    for _ in range(len(free)):
        lack = float(((start - p) * size).sum())
        change = np.where(p[free] > 0.5, -size[free], size[free])
        best = int(np.argmin(np.abs(lack - change)))
        if not abs(lack - change[best]) < abs(lack):
            break
        p[free[best]] = 1.0 - p[free[best]]


_UNITS = "number long, key long, size long, p double, of string, block long, extra long"


def _flight(land: bool) -> Callable[[pa.Table], pa.Table]:
    def run(block: pa.Table) -> pa.Table:
        number, key, size, p = (block.column(c).to_numpy() for c in ("number", "key", "size", "p"))
        order = np.lexsort((number, key, -size))
        seed = int(key.view(np.uint64).min()) ^ SEED
        block = block.take(order)
        moved = fly(size[order], p[order], np.random.default_rng(seed).random, land)
        return block.set_column(block.column_names.index("p"), "p", pa.array(moved))

    return run


def copies(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """number, size, total, target, copies (how often the mix takes the row). rows: see numbered_sizes."""
    each = saved(targets(rows))
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("total")), F.lit(0.0))
    base = F.floor(ratio + 1e-12)
    each = saved(each.select(F.col("source").alias("from"), "total", "rows", "target", base.cast("long").alias("base"), F.greatest(F.lit(0.0), ratio - base).alias("p")))
    blocks = max(1, -(-(each.agg(F.max("rows")).first()[0] or 0) // block))
    keyed = rows.withColumn("has", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")))
    told = each.withColumn("has", F.coalesce(F.concat(F.lit("="), F.col("from").cast("string")), F.lit("null"))).drop("from")
    told = heavy_join(keyed.drop("source"), told.withColumn("many", F.col("rows")), ["has"], "many", rows.count()).withColumnRenamed("has", "of")
    told = saved(told.withColumn("block", F.pmod("key", F.greatest(F.lit(1), F.ceil(F.col("rows") / block)))))
    # Only rows that are alike make a block large.
    large = saved(told.groupBy("of", "block").agg(F.count("*").alias("n")).where(F.col("n") > 2 * block + 100))
    units = told.select("number", "key", "size", "p", "of", "block")
    if large.isEmpty():
        units = units.withColumn("extra", F.lit(0).cast("long"))
    else:
        pieces = large.select("of", "block", F.ceil(F.col("n") / block).alias("pieces"), F.col("n").alias("many"))
        units = heavy_join(units, pieces, ["of", "block"], "many", rows.count(), "left")
        units = saved(units.withColumn("extra", F.coalesce(F.pmod(F.xxhash64("number"), F.col("pieces")), F.lit(0).cast("long"))).drop("pieces"))
    left, done = units, None
    while True:
        land = blocks == 1 and left.where("extra > 0").isEmpty()
        moved = saved(left.groupBy("of", "block", "extra").applyInArrow(_flight(land), _UNITS))
        settled = moved if land else moved.where("p <= 0 OR p >= 1")
        done = settled if done is None else done.unionByName(settled)
        if land:
            break
        # what is left of a large block's pieces meets first, then that of neighbouring blocks
        left = moved.where("p > 0 AND p < 1")
        if left.where("extra > 0").isEmpty():
            left = left.withColumn("block", F.floor(F.col("block") / (block // 2)))
            blocks = -(-blocks // (block // 2))
        else:
            left = left.withColumn("extra", F.floor(F.col("extra") / (block // 2)))
    drawn = done.select("number", F.col("p").cast("long").alias("drawn"))
    return told.join(drawn, "number").select("number", "size", "total", "target", (F.col("base") + F.col("drawn")).alias("copies"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """One row for each row of `docs`: id, size, source_size, target, copies (how often the mix takes it)."""
    rows = boxed(docs.select(id_col, text_col, source_col)).withColumn("number", F.monotonically_increasing_id())
    size = F.regexp_count(whole(field(text_col)), F.lit(f"[^{SPACE}]+")).cast("long")
    key = _key(field(id_col), field(text_col), field(source_col))
    rows = saved(rows.select("number", field(id_col).alias("id"), field(source_col).alias("source"), size.alias("size"), key.alias("key")))
    taken = copies(rows.drop("id"), block)
    out = rows.select("number", "id").join(taken, "number")
    return out.select(F.col("id").alias(id_col), "size", F.col("total").alias("source_size"), "target", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it. They are written once, numbered."""
    rows = saved(boxed(docs).withColumn("number", F.monotonically_increasing_id()))
    taken = copies(numbered_sizes(rows, text_col, source_col, id_col), block).where("copies > 0").select("number", "copies")
    every = rows.join(taken, "number").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return unboxed(every, docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
