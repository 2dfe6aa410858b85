"""Operator 6: URL rules, and trust spread over the graph of hosts.

A rule names a host and the start of a path; it fits its host and all subdomains, and the
longest rule that fits a URL decides. Other URLs get their host's verdict from two propagations:

* trust: personalised PageRank from the hosts of pages that a rule allows, along links;
* distrust: the same from the hosts of pages that a rule blocks, against the links' direction,
  since who links to a blocked host is suspect.

Links are the absolute and protocol-relative hrefs of pages, counted by pairs of hosts, and each
subdomain's link to the domain above it. Relative hrefs stay on their host and say nothing.
A host is blocked where its distrust exceeds `RATIO` times its trust. Every page that a rule judges brings the same mass, whichever its
verdict, so neither kind outweighs the other where it has fewer pages. Scores are unrounded, and no least score has to be exceeded, so
a pattern of links gets the same verdict in a table of any size. Both propagations share the rounds; each round is one join and one
sum over edges that were pre-aggregated. Every `STEP` rounds the scores are written, until no host's
score has grown by more than `TOLERANCE` of itself since they were written before. Scores never
fall, and a host that is reached for the first time has grown by all of its score, so rounds go on until
every host that can be reached has been.

In the graph a host goes without user and port, on pages as in links, while the report keeps it as the url
has it. Numeric addresses have no domain above them, and no link leads up to a suffix such as co.uk.
Hosts without links out pass nothing on. Hosts with very many links, and pages of one host, meet their scores on the map side.

Defined cases: null urls and urls without :// have an empty host and path; no rule fits them and
they are allowed. Null and empty html has no links; very long html is read whole. Null and repeated ids, and repeated rows, are
judged row by row, and a repeated page's links count again. Equal trust and distrust allow. Without any blocked seeds every
host is allowed. An empty table gives no rows. Columns besides id, url and html don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, heavy_join, saved, whole

#: Rule (host and path) and verdict.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
DAMPING = 0.85
#: Rounds between two written checkpoints, and the largest change between two, as a share of a host's score, that counts as settled.
STEP = 4
TOLERANCE = 1e-4
RATIO = 1.0
#: Inverse of the share of all links from which a host's are told their score on the map side.
HUBS = 1000
#: Shares within so much of each other are equal: sums of the same terms in another order.
NOISE = 1e-9

#: Second levels that are suffixes under a country's two letters.
SUFFIXES = ("ac", "co", "com", "edu", "gov", "net", "org")
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?i)\bhref\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s<>]+)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(whole(url), _URL, 1))


def node_of(host: Column) -> Column:
    """The host as it stands in the graph."""
    return F.regexp_replace(ascii_lower(host), r"^.*@|:\d*$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(whole(url), _URL, 2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""

    def fits(rule: str) -> Column:
        name, slash, rest = rule.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)

    longest = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    return reduce(lambda c, r: c.when(fits(r[0]), F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("verdict"))), longest, F.when(F.lit(False), None))


def host_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """Counted links between different hosts: src, dst, n."""
    links = pages.select(node_of(host_of(F.col(url_col))).alias("src"), F.explode(F.regexp_extract_all(whole(F.col(html_col)), F.lit(_LINK), F.lit(1))).alias("dst"))
    links = links.select("src", node_of(F.col("dst")).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    links = saved(links.where("src <> '' AND dst <> '' AND src <> dst"))
    hosts = pages.select(node_of(host_of(F.col(url_col))).alias("h")).distinct().unionByName(links.select(F.col("dst").alias("h"))).distinct()
    labels = F.split("h", "\\.")
    # a.b.example.org -> b.example.org -> example.org; not up to a bare suffix
    bare = F.when((F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, -2).isin(*SUFFIXES), 3).otherwise(2)
    steps = F.transform(F.sequence(F.lit(1), F.size(labels) - bare), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("src"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("dst")))
    numeric = F.col("h").rlike(r"^[0-9.]+$") | F.col("h").startswith("[")
    above = hosts.where((F.size(labels) > bare) & ~numeric).select(F.explode(steps).alias("e")).select("e.src", "e.dst").distinct().withColumn("n", F.lit(1).cast("long"))
    return links.unionByName(above).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """kind (t or d), host, score after `rounds` rounds, or once settled. edges: src, dst, n; seeds: kind, host, share."""
    ways = edges.select(F.lit("t").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("d").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    ways = saved(ways)
    out = saved(ways.groupBy("kind", "src").agg(F.sum("n").alias("out"), F.count("*").alias("many")))
    total = ways.count()
    ways = saved(heavy_join(ways, out, ["kind", "src"], "many", total).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("out") * damping).alias("w")))
    # hosts with more than a thousandth of all links: at most some thousand
    hubs = out.where(F.col("many") > max(64, total // HUBS)).select("kind", F.col("src").alias("host"))
    hubs = F.broadcast(saved(hubs))
    far, near = saved(ways.join(hubs, ["kind", "host"], "left_anti")), saved(ways.join(hubs, ["kind", "host"], "left_semi"))
    none = near.isEmpty()
    seeds = saved(seeds)
    base = seeds.select("kind", "host", (F.col("share") * (1 - damping)).alias("score"))
    now = before = base
    done = 0
    while rounds is None or done < rounds:
        moved = now.join(far, ["kind", "host"])
        if not none:
            moved = moved.unionByName(near.join(F.broadcast(now.join(hubs, ["kind", "host"], "left_semi")), ["kind", "host"]))
        moved = moved.select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("w")).alias("score"))
        now = moved.unionByName(base).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        done += 1
        if done % STEP == 0 or done == rounds:
            now = saved(now)
            if rounds is None and _change(before, now) <= tolerance:
                break
            before = now
    return now


def _change(before: DataFrame, now: DataFrame) -> float:
    """The largest growth of a score since `before`, as a share of the score."""
    old = before.select("kind", "host", F.col("score").alias("old"))
    grown = now.join(old, ["kind", "host"], "left").where("score > 0").select(((F.col("score") - F.coalesce("old", F.lit(0.0))) / F.col("score")).alias("x"))
    return grown.agg(F.max("x")).first()[0] or 0.0


def host_scores(pages: DataFrame, rules: tuple = RULES, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, trust, distrust: of every host with either."""
    places = pages.select(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    told = places.select(node_of(F.col("host")).alias("host"), rule_of(F.col("host"), F.col("path"), rules)["verdict"].alias("verdict")).where("verdict IS NOT NULL AND host <> ''")
    count = saved(told.groupBy("host", F.when(F.col("verdict") == "allow", "t").otherwise("d").alias("kind")).agg(F.count("*").alias("n")))
    every = count.agg(F.sum("n")).first()[0] or 1  # one mass for both kinds
    seeds = count.select("kind", "host", (F.col("n") / every).alias("share"))
    scores = propagate(host_edges(pages, url_col, html_col), seeds)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    return scores.groupBy("host").agg(of("t").alias("trust"), of("d").alias("distrust"))


def url_verdicts(pages: DataFrame, rules: tuple = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = RATIO) -> DataFrame:
    """One row for each row of `pages`: id, host, path, rule, verdict, trust, distrust (told to nine digits)."""
    scores = host_scores(pages, rules, url_col, html_col).where("host <> ''").select(F.col("host").alias("node"), "trust", "distrust")
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = saved(rows.withColumn("node", node_of(F.col("host"))).withColumn("fits", rule_of(F.col("host"), F.col("path"), rules)))
    many = rows.groupBy("node").agg(F.count("*").alias("many"))
    scores = saved(scores.join(many, "node"))
    rows = heavy_join(rows, scores, ["node"], "many", rows.count(), "left").na.fill(0.0, ["trust", "distrust"])
    spread = F.when(F.col("distrust") > ratio * (1 + NOISE) * F.col("trust"), "block").otherwise("allow")
    told = [F.format_string("%.8e", c).cast("double").alias(c) for c in ("trust", "distrust")]
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("fits")["rule"].alias("rule"), F.coalesce(F.col("fits")["verdict"], spread).alias("verdict"), *told)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
