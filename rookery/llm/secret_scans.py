"""Operator 5: secrets, by a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams follows: alternatives, each a
set of trigrams that all must occur in a text (lower-cased) that the rule can match. The index
holds, for every document, the postings (trigram, document) of the trigrams that any query
names; an alternative's postings are intersected by counting them per document. Candidates are
verified with the regular expression itself; rules without mandatory trigrams scan all texts.

The candidates travel to the documents: as a broadcast while there are at most `SMALL` of them,
in a shuffle by id and text hash beyond that.

Defined cases: null text counts as empty; rows with null or repeated ids are told apart by their
texts' hashes, and equal rows get equal results. An empty table gives no rows. Texts of any length are searched whole.
Spans of a kind never overlap, the leftmost stays; spans of different kinds at one place go by the order of the rules.
Columns besides id and text don't matter, whatever their names.
"""

from __future__ import annotations

from re import _constants as kinds
from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, documents, saved, whole
from .spans import as_text, count_of, row_hash, spans

#: Candidates up to which they are broadcast (some 10 MB).
SMALL = 100_000


class Rule(NamedTuple):
    pattern: str
    #: The least length of this group; other matches are dropped.
    group: int
    least: int


#: The base rules, in the order of the report.
BASE = {
    "assign": Rule(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": Rule(r"AKIA[A-Z0-9]+", 0, 20),
    "hex": Rule(r"[0-9a-f]{24,}", 0, 24),
}
#: Further shapes of credentials.
MORE = {
    "pem": Rule(r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    "github": Rule(r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    "slack": Rule(r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    "google": Rule(r"AIza[0-9A-Za-z_-]{35,}", 0, 0),
    "stripe": Rule(r"[rs]k_live_[0-9A-Za-z]{16,}", 0, 0),
    "jwt": Rule(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0),
}

_WIDE = 8


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigrams that must all occur in the lower-cased text; an empty list: no such query."""

    def walk(items, states: set[tuple[frozenset[str], str]]) -> set[tuple[frozenset[str], str]]:
        for kind, value in items:
            if kind is kinds.LITERAL:
                states = {(done, run + chr(value).lower()) for done, run in states}
            elif kind is kinds.IN and all(k is kinds.LITERAL for k, _ in value) and len(value) <= _WIDE:
                states = {(done, run + chr(c).lower()) for done, run in states for _, c in value}
            elif kind is kinds.SUBPATTERN:
                states = walk(value[3], states)
            elif kind is kinds.BRANCH:
                states = set().union(*(walk(b, states) for b in value[1]))
            elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT):
                low, high, body = value
                if (low, high) == (0, 1):
                    states = states | walk(body, states)
                else:
                    states = {(cut(s), "") for s in (walk(body, states) if low else states)}
            elif kind in (kinds.AT, kinds.ASSERT, kinds.ASSERT_NOT):
                continue
            else:
                states = {(cut(s), "") for s in states}
        return states

    def cut(state: tuple[frozenset[str], str]) -> frozenset[str]:
        done, run = state
        return done | {run[i : i + 3] for i in range(len(run) - 2)}

    found = {cut(s) for s in walk(list(parser.parse(pattern)), {(frozenset(), "")})}
    if frozenset() in found:
        return []
    return sorted((f for f in found if not any(g < f for g in found)), key=sorted)


def queries_of(rules: dict[str, Rule]) -> dict[str, list[frozenset[str]]]:
    return {name: trigram_query(rule.pattern) for name, rule in rules.items()}


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(__id, __hash, trigram) for each of `trigrams` that a document has. docs: __id, __hash, __text."""
    low = docs.select("__id", "__hash", ascii_lower(F.col("__text")).alias("__low"))
    has = F.array_compact(F.array(*[F.when(F.contains("__low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("__id", "__hash", F.explode(has).alias("trigram"))


def candidates(docs: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(__id, __hash, __rules): what each document has to be verified for."""
    rows = [(name, k, t, len(clause)) for name, q in queries.items() for k, clause in enumerate(q) for t in sorted(clause)]
    terms = F.broadcast(docs.sparkSession.createDataFrame(rows, "rule string, clause int, trigram string, size int"))
    met = postings(docs, sorted({r[2] for r in rows})).join(terms, "trigram")
    # A document's postings come from one task, so the partial count is the count; repeated rows count double, hence distinct.
    full = met.groupBy("__id", "__hash", "rule", "clause", "size").agg(F.count_distinct("trigram").alias("n")).where("n = size")
    return full.groupBy("__id", "__hash").agg(F.collect_set("rule").alias("__rules"))


def rule_spans(text: Column, name: str, rule: Rule, may: Column) -> Column:
    part = "part" if rule.group else "value"
    return spans(text, may, rule.pattern, name, lambda m: F.length(m[part]) >= rule.least, rule.group)


def secrets(docs: DataFrame, rules: dict[str, Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """One row for each row of `docs`: __id and __spans (kind, start, end, value), by start, then by the order of the rules."""
    rules = rules or BASE | MORE
    queries = queries_of(rules)
    indexed = {n: q for n, q in queries.items() if q}
    rows = docs.select(F.col(id_col).alias("__id"), row_hash(F.col(text_col)).alias("__hash"), whole(F.col(text_col)).alias("__text"))
    found = saved(candidates(rows, indexed)) if indexed else None
    if found is not None:
        there = found.select(F.col("__id").alias("__cid"), F.col("__hash").alias("__chash"), "__rules")
        there = F.broadcast(there) if found.count() <= small else there
        rows = rows.join(there, rows["__id"].eqNullSafe(there["__cid"]) & (rows["__hash"] == there["__chash"]), "left")
    else:
        rows = rows.withColumn("__rules", F.lit(None).cast("array<string>"))
    text, every = F.col("__text"), []
    for name, rule in rules.items():
        may = F.coalesce(F.array_contains("__rules", name), F.lit(False)) if name in indexed else text.rlike(rule.pattern)
        every.append(rule_spans(text, name, rule, may))
    order = {name: i for i, name in enumerate(rules)}
    place = lambda s: F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), s["kind"])
    sort = F.array_sort(F.transform(F.concat(*every), lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s.alias("s"))))
    return rows.select("__id", F.transform(sort, lambda x: x["s"]).alias("__spans"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets(documents(spark, sf_dir))
    every = F.col("__spans")
    base = F.filter(every, lambda s: s["kind"].isin(*BASE))
    counts = [count_of(every, k).alias(f"n_{k}") for k in BASE]
    return out.select(F.col("__id").alias("doc_id"), *counts, F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text(every).alias("spans"))
