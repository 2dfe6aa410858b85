"""Operator 9: rule counts and a hashed n-gram log-likelihood ratio, all row-local but for two small counts.

Words and word pairs are hashed into `BUCKETS` buckets. One pass over the corpus counts each
bucket in all documents (the raw multinomial) and in the trusted ones (the target
multinomial). Both counts are fixed arrays of `BUCKETS` numbers, used as a scalar subquery. The second
pass sums the smoothed log ratio of the two over the n-grams of each document and divides by their
number. A document's own n-grams are left out of the counts that judge it, of the target's where it is
trusted, so it is judged as one that the corpus hasn't seen, however small that is. Logarithms are
rounded to whole numbers before they are summed, so reruns agree to the last bit, in any order.

The threshold comes from the trusted documents' own scores, each left out of the counts that judge it:
their exact `SHARE` quantile, less `MARGIN`. Every document below it is rejected.

Trusted documents: all whose id has a row of `labels` with quality 1. Whole-number ids are kept as bitmaps of 64 neighbours. Up to `FEW` of
these meet the documents on the map side, more in a shuffle. Nothing is bounded.

Defined cases: null text has no words, fails the base rules and is rejected, and so does an empty one. A very
long text is judged whole. Rows with a null or repeated id are judged one by one, and repeated rows alike. A score
at the threshold passes. With no trusted rows the ratio is 0 and only the base
rules reject. An empty table gives no rows. Columns of `docs` may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import documents, field, held, let, saved, unboxed, whole, words_of

#: Hash buckets of words and pairs together.
BUCKETS = 16384
#: Bitmaps of trusted ids that are broadcast, at most: some 40 MB.
FEW = 1_000_000
#: Scores are counted in cells of a thousandth before the quantile's own are sorted.
CELLS = 1000
#: Added to each bucket's count, for smoothing.
ALPHA = 2.0
#: Share of the trusted documents that the threshold would leave out, and how far it lies below their quantile.
SHARE, MARGIN = 0.01, 0.02
#: Unit of the logarithms.
UNIT = 1e6

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def ngram_buckets(hashes: Column) -> Column:
    """Buckets of all words and of all pairs of neighbours. hashes: those of the words, in order."""
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    ones = F.transform(hashes, bucket)
    twos = F.transform(F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda h, i: bucket(F.xxhash64(F.get(hashes, i), h)))
    return F.concat(ones, twos)


def _places(docs: DataFrame, id_col: str) -> tuple[Column, Column]:
    """Where an id is told: the key of its bitmap and the bit there. Other ids than whole numbers have a bitmap each."""
    place = F.col(f"`{id_col}`")
    whole_number = isinstance(docs.schema[id_col].dataType, IntegralType)
    return (F.shiftright(place.cast("long"), 6), place.cast("long").bitwiseAND(F.lit(63)).cast("int")) if whole_number else (place, F.lit(0))


def trusted_ids(labels: DataFrame, few: int = FEW) -> DataFrame:
    """key, bits: bitmaps of the ids of all rows with quality 1; to be broadcast where there are few."""
    key, bit = _places(labels, "doc_id")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    maps = saved(labels.where("quality = 1 AND doc_id IS NOT NULL").groupBy(key.alias("key")).agg(F.bit_or(one).alias("bits")))
    return F.broadcast(maps) if maps.count() <= few else maps.hint("merge")


def with_trust(docs: DataFrame, trusted: DataFrame, id_col: str) -> DataFrame:
    """Boxed rows with own: whether the document is trusted."""
    key, bit = _places(docs, id_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"), bit.alias("bit"))
    return rows.join(trusted, "key", "left").select("row", F.coalesce(F.getbit("bits", F.col("bit")) == 1, F.lit(False)).alias("own"))


def ngram_counts(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One written row: t and r, the buckets' counts in trusted and in all documents, and their sums nt and nr.

    Besides, for a bucket that a text has once, the log ratio of counts without it: one, and own where the text is trusted.
    """
    grams = with_trust(docs.select(id_col, text_col), trusted, id_col).select("own", _hashes(words_of(whole(field(text_col)))).alias("h"))
    grams = grams.select(F.col("own").cast("long").alias("own"), F.explode(ngram_buckets(F.col("h"))).alias("b"))
    counts = grams.groupBy("b").agg(F.sum("own").alias("t"), F.count("*").alias("r"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").na.fill(0, ["t", "r"])
    one = lambda t: F.round(F.log((t + ALPHA) / (F.col("r") - 1 + ALPHA)) * UNIT).cast("int")
    every = every.select("b", "t", "r", one(F.col("t")).alias("one"), one(F.col("t") - 1).alias("own"))
    pairs = every.agg(F.array_sort(F.collect_list(F.struct("b", "t", "r", "one", "own"))).alias("p"), F.sum("t").alias("nt"), F.sum("r").alias("nr"))
    arrays = [F.col("p").getField(c).alias(c) for c in ("t", "r", "one", "own")]
    return saved(pairs.select(F.struct(*arrays, "nt", "nr").alias("model")))


def with_rule_counts(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Boxed rows with the counts of the base rules and h, the hashes of the words."""
    text = whole(field(text_col))
    symbols = "#*$%&|<>"
    bare = text
    for s in symbols:
        bare = F.replace(bare, F.lit(s), F.lit(""))
    out = (
        rows.withColumn("w", words_of(text))
        .withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn("h", _hashes(F.col("w")))
        .withColumn("n_words", F.size("w").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("w", "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(bare)).cast("long"))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .drop("w", "lines")
    )
    h = F.col("h")
    windows = F.transform(F.slice(h, 3, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(F.get(h, i), F.get(h, i + 1), x))
    out = out.withColumn("g", windows)
    # Where any window occurs twice, all are sorted with their places: equal ones become neighbours.
    placed = F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    out = out.withColumn("sorted", F.when(F.size(F.array_distinct("g")) < F.size("g"), placed))
    s = F.col("sorted")
    same = lambda v, i: F.coalesce(v["x"] == F.get(s, i)["x"], F.lit(False))
    # places of windows equal to the neighbour before or after, in order; each covers three words
    marked = F.filter(s, lambda v, i: same(v, i - 1) | same(v, i + 1))
    out = out.withColumn("marked", F.sort_array(F.transform(marked, lambda v: v["i"])))
    m = F.col("marked")
    covered = F.aggregate(F.transform(m, lambda p, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), p - F.get(m, i - 1)))), F.lit(0), lambda a, x: a + x)
    return out.withColumn("n_repeat_words", held(F.coalesce(covered, F.lit(0)).cast("long"))).drop("g", "sorted", "marked")


def log_ratio_sum(buckets: Column, model: Column, own: Column) -> Column:
    """Summed log ratio, in millionths, of a text's n-grams under counts without its own. own: whether the text is in the target's counts.

    All n-grams count as if they occurred once; those that don't are then set right.
    """
    n = F.size(buckets).cast("long")
    level = F.log((model["nt"] - F.when(own, n).otherwise(0) + ALPHA * BUCKETS) / (model["nr"] - n + ALPHA * BUCKETS))
    once = F.when(own, model["own"]).otherwise(model["one"])

    def more(again: Column, table: Column) -> Column:
        """again: buckets that occur c times, c - 1 times each, in order."""

        def one(at: Column, before: Column) -> Column:
            b, c = F.get(again, at), at - before + 1
            ratio = F.log((F.get(model["t"], b) - F.when(own, c).otherwise(0) + ALPHA) / (F.get(model["r"], b) - c + ALPHA))
            return c * (F.round(ratio * UNIT).cast("long") - F.get(table, b))

        ends = F.filter(F.sequence(F.lit(0), F.size(again) - 1), lambda i: ~F.get(again, i).eqNullSafe(F.get(again, i + 1)))
        each = let(ends, lambda e: F.transform(e, lambda at, i: one(at, F.coalesce(F.get(e, i - 1), F.lit(-1)))))
        return F.when(F.size(again) > 0, F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(0)

    def total(table: Column) -> Column:
        single = F.aggregate(buckets, F.lit(0).cast("long"), lambda a, b: a + F.get(table, b))
        again = let(F.sort_array(buckets), lambda s: F.filter(s, lambda b, i: b == F.get(s, i + 1)))
        return single + let(again, lambda x: more(x, table)) - n * F.round(level * UNIT).cast("long")

    return F.when((model["nt"] > 0) & (n > 0), let(once, total)).otherwise(0)


def _scored(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Rows with own and h and, in h's place, score: the mean log ratio (null without words)."""
    out = rows.withColumn("grams", ngram_buckets(F.col("h"))).withColumn("model", model.scalar())
    out = out.withColumn("sum", log_ratio_sum(F.col("grams"), F.col("model"), F.col("own")))
    return out.withColumn("score", held(F.try_divide(F.col("sum") / F.lit(UNIT), F.size("grams")))).drop("grams", "model", "sum", "h")


def quantile(rows: DataFrame, share: float, column: str = "score") -> float | None:
    """The exact quantile, between two neighbours where it lies there; null where there is no value. rows: a written table.

    No task holds all values: they are counted by cells, and only the values of the quantile's own cells are sorted.
    """
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("x"), F.floor(F.col(column) * CELLS).alias("cell"))
    cells = saved(values.groupBy("cell").agg(F.count("*").alias("n")))
    n = cells.agg(F.sum("n")).first()[0]
    if not n:
        return None
    low, part = divmod(share * (n - 1), 1)
    high = min(low + 1, n - 1)
    upto = lambda by: F.sum("n").over(Window.orderBy(by))
    near = cells.withColumn("upto", upto("cell")).where((F.col("upto") > low) & (F.col("upto") - F.col("n") <= high))
    first, last, before = near.agg(F.min("cell"), F.max("cell"), F.min(F.col("upto") - F.col("n"))).first()
    each = values.where(F.col("cell").between(first, last)).groupBy("x").agg(F.count("*").alias("n")).withColumn("upto", before + upto("x"))
    a, b = each.agg(*[F.min(F.when(F.col("upto") > at, F.col("x"))) for at in (low, high)]).first()
    return a + (b - a) * part


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, margin: float = MARGIN) -> DataFrame:
    """row (a struct of the columns of `docs`), the counts of STATS, base_failed, score (mean log ratio) and kept.

    Scored rows are written once; the threshold is the quantile of the trusted ones among them, from 50 words on.
    """
    trusted = trusted_ids(labels)
    model = ngram_counts(docs, trusted, id_col, text_col)
    out = saved(_scored(with_rule_counts(with_trust(docs, trusted, id_col), text_col), model))
    least = quantile(out.where("own AND n_words >= 50"), share)
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    passes = F.coalesce(F.col("score") >= (float("-inf") if least is None else least - margin), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & passes).drop("own")


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that pass, with their columns."""
    return unboxed(judged(docs, labels, id_col, text_col).where("kept"), docs.columns)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select(field("doc_id").alias("doc_id"), *STATS, "base_failed", "kept", "score")
