"""Operator 4: personal data, and the terms that give it away.

Base spans come from four patterns. Each value found is a protected entity, and so is what it has
in common with others (`pools`): an address's domain, a number's first digits. From the corpus, in
which equal texts count once:
n(e) texts with the entity, n(t) with the term, n(e, t) with both, N in all. With the chance of the entity
beside the term smoothed by `PRIOR` texts of the base rate,

    p(e | t) = (n(e, t) + PRIOR n(e) / N) / (n(t) + PRIOR),

the share of the entity's information that the term discloses is log(p(e | t) N / n(e)) / log(N / n(e)),
which nears 1 where the term occurs with the entity only, the more so the more often it does. In texts with the entity, terms from
`GENERALISE` on are replaced by a general word, terms from `REMOVE` on are removed. No entity and no pair is
too rare to count.

Terms are runs of three or more letters outside the base spans, lower-cased, in all counts alike. Entities that occur in
one text only need no pairs: there n(e) and n(e, t) are 1, and n(t) decides alone. For the others, the terms of a
text are cut into pieces of `PIECE` and dealt out before they are paired, pairs of frequent terms that can't reach `GENERALISE` go, and
the others are written with their texts and summed before the shuffle. Telling pairs go back to the texts that have both, not to all
texts of the entity, so no step has more rows than texts have pairs. Whole texts are never shuffled. Terms of texts without personal data are once, by hash, but only where
so many rows repeat a text that their numbers can't be broadcast.

Defined cases: null text counts as empty. Rows with null or repeated ids are told apart by their
texts' hashes; equal rows get equal results. Very long texts are searched whole. Of overlapping spans all are told, and `sanitised`
takes the one that starts first, of those the longest. Empty tables give no rows. Columns of `docs` may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, documents, field, heavy_join, saved, unboxed, whole
from .spans import as_text, count_of, matches, row_hash, spans

GENERALISE = 0.8
REMOVE = 0.95
#: Texts of the base rate that smooth a term's estimate, and terms of a text that are paired at once.
PRIOR, PIECE = 2.0, 256
#: Rows up to which a side is broadcast (some 10 MB).
SMALL = 100_000

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("general", "remove")
_LETTERS = r"\p{L}{3,}+"
#: What stands in for a span.
MARKS = {"email": "[email]", "ip": "[ip]", "card": "[card]", "phone": "[phone]", "general": "[term]", "remove": ""}

# The patterns of the contract, written so that no long run is tried more than twice: possessive
# runs, and starts only where a run starts or the match before has ended.
_NAME = "A-Za-z0-9._%+-"
_PATTERNS = {
    "email": rf"(?:(?<![{_NAME}])|\G)[{_NAME}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_MAY = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether 16 to 19 digits pass; every second from the right counts double."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    value = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(value, F.lit(0), lambda a, v: a + v) % 10 == 0


def _good(kind: str) -> callable:
    if kind == "ip":
        return lambda m: F.forall(F.split(m["value"], r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return lambda m: F.length(_digits(m["value"])).between(16, 19) & _luhn(F.substring(_digits(m["value"]), 1, 19))
    if kind == "phone":
        return lambda m: F.length(_digits(m["value"])).between(8, 15)
    return lambda m: F.lit(True)


def base_spans(text: Column) -> Column:
    """kind, start, end, value by kind, then start."""
    return F.concat(*[spans(text, text.rlike(_MAY[k]), _PATTERNS[k], k, _good(k)) for k in KINDS])


def _terms(text: Column, found: Column) -> Column:
    """term, start, end of each run of letters that touches no base span."""
    words = F.transform(matches(text, _LETTERS, "term"), lambda m: F.struct(F.lower(m["value"]).alias("term"), m["start"].alias("start"), m["end"].alias("end")))
    return F.filter(words, lambda w: ~F.exists(found, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))


def _near(df: DataFrame, small: int) -> DataFrame:
    """Broadcast a written side where its size has been checked."""
    return F.broadcast(df) if df.count() <= small else df


def entities(found: Column) -> Column:
    """Hashes of the values of base spans, and of what they share with others."""
    digits = lambda s: _digits(s["value"])
    pool = lambda s: (
        F.when(s["kind"] == "email", F.substring_index(F.lower(s["value"]), "@", -1))
        .when(s["kind"] == "ip", F.substring_index(s["value"], ".", 2))
        .when(s["kind"] == "card", F.substring(digits(s), 1, 6))
        .otherwise(F.substring(digits(s), 1, 5))
    )
    own = F.transform(found, lambda s: F.xxhash64(s["kind"], F.lower(s["value"])))
    return F.array_distinct(F.concat(own, F.transform(found, lambda s: F.xxhash64(F.lit("pool"), s["kind"], pool(s)))))


def disclosed(net: Column, ne: Column, nt: Column, total: int, prior: float = PRIOR) -> Column:
    """The share of an entity's information that a term discloses; null where the entity is in every text."""
    rate = ne / F.lit(float(max(total, 1)))
    return F.try_divide(F.log((net + prior * rate) / (nt + prior) / rate), -F.log(rate))


def _kind(share: Column) -> Column:
    return F.when(share >= REMOVE, "remove").when(share >= GENERALISE, "general")


def term_counts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """nt beside each row of the wanted terms. texts: see `different_texts`."""
    here = F.when(F.col("words").isNull(), F.split("terms", " ")).otherwise(F.array_distinct(F.transform("words", lambda w: w["term"])))
    words = texts.select(F.explode(here).alias("term")).where("term <> ''")
    return words.groupBy("term").agg(F.count("*").alias("nt")).join(wanted, "term")


def different_texts(based: DataFrame, small: int = SMALL) -> DataFrame:
    """Different texts: hash, and entities and words of those with base spans, terms (different ones, joined by a space) of the others.

    Words have their places only where there are base spans. Of equal texts the first by row number stays: where few
    rows go, their numbers are broadcast to the written table; else equal texts meet by their hashes, in one shuffle.
    """
    has = F.size("base") > 0
    terms = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_LETTERS), F.lit(0)), lambda w: F.lower(w)))
    told = [F.when(has, entities(F.col("base"))).alias("entities"), F.when(has, _terms(F.col("text"), F.col("base"))).alias("words"), F.when(~has, F.array_join(terms, " ")).alias("terms")]
    each = saved(based.select(F.monotonically_increasing_id().alias("number"), "hash", *told))
    copied = saved(each.groupBy("hash").agg(F.min("number").alias("first"), F.count("*").alias("n")).where("n > 1"))
    again = saved(heavy_join(each.select("hash", "number"), copied, ["hash"], "n", each.count()).where("number <> first").select("number"))
    if again.count() <= small:
        return each.join(F.broadcast(again), "number", "left_anti")
    return saved(each.dropDuplicates(["hash"]))


def possible_pairs(dealt: DataFrame, frequent: DataFrame, total: int) -> DataFrame:
    """entity, ne, term of each text (often, terms; other columns stay). frequent: term, nt and, if known, np of so few that they are broadcast.

    A share grows with n(e, t), which is at most n(e) and np, the private texts with the term: most words are too frequent elsewhere, whatever the pairs' counts.
    """
    others = [c for c in dealt.columns if c not in ("often", "terms")]
    words = dealt.select(*others, "often", F.explode("terms").alias("term")).join(F.broadcast(frequent), "term", "left")
    beside = "np" if "np" in frequent.columns else "nt"
    pairs = words.select(*others, "term", "nt", beside, F.explode("often").alias("e"))
    most = disclosed(F.least("e.ne", beside), F.col("e.ne"), F.col("nt"), total)
    return pairs.where(F.col("nt").isNull() | (most >= GENERALISE)).select(*others, "e.entity", "e.ne", "term")


def told_terms(pairs: DataFrame, known: DataFrame, total: int) -> DataFrame:
    """hash, term, kind: of the pairs (hash, entity, ne, term; a written table) those that are telling, in the texts that have them. known: term, nt."""
    counted = pairs.groupBy("entity", "ne", "term").agg(F.count("*").alias("net"))
    told = counted.join(known, "term").select("entity", "term", "net", _kind(disclosed(F.col("net"), F.col("ne"), F.col("nt"), total)).alias("kind"))
    told = saved(told.where("kind IS NOT NULL"))
    there = heavy_join(pairs.select("hash", "entity", "term"), told, ["entity", "term"], "net", pairs.count())
    return there.groupBy("hash", "term").agg(F.max("kind").alias("kind"))


def disclosures(texts: DataFrame, private: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(term, kind) for entities of one text, (hash, term, kind) for others, and frequent terms that aren't telling.

    texts: see `different_texts`; private: hash, entities, words of those with entities.
    """
    total = texts.count()
    often = private.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("ne"))
    often = saved(often.where("ne > 1"))
    terms = F.array_distinct(F.transform("words", lambda w: w["term"]))
    known = saved(term_counts(texts, saved(private.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("np")))))
    single = saved(known.select("term", _kind(disclosed(F.lit(1), F.lit(1), F.col("nt"), total)).alias("kind")).where("kind IS NOT NULL"))
    here = private.select("hash", F.explode("entities").alias("entity")).join(_near(often, small), "entity").groupBy("hash").agg(F.collect_list(F.struct("entity", "ne")).alias("often"))
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.size("terms"), F.lit(1)), F.lit(PIECE)), lambda i: F.slice(F.col("terms"), i, F.lit(PIECE)))
    dealt = private.select("hash", terms.alias("terms")).join(here, "hash").select("hash", "often", F.explode(pieces).alias("terms")).repartition(F.xxhash64("terms"))
    frequent = saved(known.orderBy(F.col("np").desc(), "term").limit(small))
    told = saved(told_terms(saved(possible_pairs(dealt, frequent, total)), known, total))
    quiet = frequent.select("term").join(told.select("term").unionByName(single.select("term")), "term", "left_anti")
    return single, told, saved(quiet)


def found_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """One row for each row of `docs`: id, hash, base (kind, start, end, value), spans (kind, start, end; base ones first)."""
    rows = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    based = rows.select("id", row_hash(F.col("text")).alias("hash"), "text", base_spans(F.col("text")).alias("base"))
    texts = different_texts(based, small)
    private = saved(texts.where("words IS NOT NULL").select("hash", "entities", "words"))
    single, told, quiet = disclosures(texts, private, small)
    words = private.select("hash", F.explode("words").alias("w")).select("hash", "w.term", "w.start", "w.end").join(F.broadcast(quiet), "term", "left_anti")
    often = private.select("hash", F.explode("entities").alias("entity"))
    once = saved(often.groupBy("entity").agg(F.count("*").alias("ne"), F.min("hash").alias("hash")).where("ne = 1").select("hash").distinct())
    alone = words.join(_near(once, small), "hash", "left_semi").join(_near(single, small), "term").select("hash", "start", "end", "kind")
    shared = words.join(told, ["hash", "term"]).select("hash", "start", "end", "kind")
    hits = alone.unionByName(shared).groupBy("hash", "start", "end").agg(F.max("kind").alias("kind"))  # remove wins over general
    more = saved(hits.groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("more")))
    side = _near(more, small // 10)
    out = based.select("id", "hash", "base").join(side, "hash", "left")
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return out.select("id", "hash", "base", F.concat(plain, F.coalesce("more", F.slice(plain, 1, 0))).alias("spans"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """`docs` with their texts sanitised. Of overlapping spans the one that starts first counts. Null texts stay null."""
    found = found_spans(docs, id_col, text_col, small).where(F.size("spans") > 0).groupBy("hash").agg(F.any_value("spans").alias("spans"))
    text = field(text_col)
    told = boxed(docs).withColumn("hash", row_hash(whole(text))).join(found, "hash", "left")
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    mark = lambda kind: F.element_at(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv]), kind)
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    walked = F.aggregate(
        order,
        start,
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
            F.struct(F.concat(acc["done"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), mark(s["kind"])).alias("done"), (-s["back"]).alias("at"))
        ),
        lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return unboxed(told, docs.columns, **{text_col: F.when(F.col("spans").isNull(), text).otherwise(walked)})


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = found_spans(documents(spark, sf_dir))
    counts = [count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
