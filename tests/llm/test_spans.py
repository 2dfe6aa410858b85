"""Operators 4 and 5: spans by brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from math import log

import pytest
from pyspark.sql import functions as F

from rookery.llm import pii, secret_scans
from rookery.llm.common import saved

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def brute_pii(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def digest(found):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest()


ALPHABET = ["a@b.c", "@", ".", "_", "x.y@z-1.co.uk", "é", " ", "1.2.3.4", "256.1.1.1", "+", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (0)30 1234-567", "12", "-", "0", "007.08.9.255", "0.0.0.0.1", "a", "%", "𝔘", "\n"]
SECRET = ["password", "=", ": ", "token", '"', "'", "Api_Key", "apikey", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "0123456789abcdef01234567", "x", " ", "é", "SECRET=", "abc", "hunter22", "𝔘", "ghp_" + "a1" * 18, "-----BEGIN RSA PRIVATE KEY-----"]


def noise(parts, n, seed):
    rng = random.Random(seed)
    return [(i, "".join(rng.choices(parts, k=rng.randrange(1, 14)))) for i in range(n)]


PARTS = ["a.", "1", "1 2-", "+1", "9.8.7.6 ", "f", "token=", "x@y."]
LONG = [(9000 + i, p * 1500) for i, p in enumerate(PARTS)]  # brute force is quadratic on these
VERY_LONG = [(9100 + i, p * (200000 // len(p))) for i, p in enumerate(PARTS)]


def test_pii_base_by_brute_force(spark, sf, docs_of, awkward):
    rows = noise(ALPHABET, 1500, 1) + LONG + [(10000 + (r[0] or 0), r[1]) for r in awkward[:5]]
    rows += [(20000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(300).collect()]
    got = docs_of(rows).select("doc_id", "text", F.transform(pii.base_spans(F.coalesce("text", F.lit(""))), lambda s: F.struct(s["kind"], s["start"], s["end"])).alias("s")).collect()
    for r in got:
        assert [tuple(s) for s in r.s] == brute_pii(r.text), r.text[:200]


def test_secrets_base_by_brute_force(spark, sf, docs_of, awkward):
    rows = noise(SECRET, 1500, 2) + LONG + [(10000 + i, r[1]) for i, r in enumerate(awkward)]
    rows += [(20000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(300).collect()]
    texts = dict(rows)
    for small in (secret_scans.SMALL, 0):
        for r in secret_scans.secrets(docs_of(rows), small=small).collect():
            found = [(s.kind, s.start, s.end) for s in r["__spans"]]
            assert [s for s in found if s[0] in secret_scans.BASE] == brute_secrets(texts[r["__id"]]), texts[r["__id"]][:200]
            more = [(n, m.start(), m.end()) for n, x in secret_scans.MORE.items() for m in re.finditer(x.pattern, texts[r["__id"]] or "")]
            assert sorted(s for s in found if s[0] in secret_scans.MORE) == sorted(more)


def test_trigram_queries():
    q = secret_scans.trigram_query
    assert q("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert q("[0-9a-f]{24,}") == [] and q("ab") == [] and q("abc|.") == []
    assert q("(?:foo|bar)z?") == [frozenset({"bar"}), frozenset({"foo"})]
    assert q("ab[cd]e") == [frozenset({"abc", "bce"}), frozenset({"abd", "bde"})]
    assert q("(abcd)+x*efg") == [frozenset({"abc", "bcd", "efg"})]
    for rule in (secret_scans.BASE | secret_scans.MORE).values():
        query = q(rule.pattern)
        for _, text in noise(SECRET, 800, 3):
            if re.search(rule.pattern, text) and query:
                assert any(all(t in text.lower() for t in clause) for clause in query)


def pool(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": value.lower().rsplit("@", 1)[-1], "ip": ".".join(value.split(".")[:2]), "card": digits[:6], "phone": digits[:5]}[kind]


def brute_terms(rows):
    """Term spans by the definition, equal texts once."""
    words, entities = {}, {}
    for t in {t or "" for _, t in rows}:
        base = brute_pii(t)
        entities[t] = {(k, t[s:e].lower()) for k, s, e in base} | {("pool", k, pool(k, t[s:e])) for k, s, e in base}
        every = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t)]
        words[t] = [w for w in every if not any(s < w[2] and w[1] < e for _, s, e in base)]
    n = len(words)
    ne, nt, net = Counter(), Counter(), Counter()
    for t in words:
        here = {w[0] for w in words[t]}
        ne.update(entities[t])
        nt.update(here)
        net.update((e, w) for e in entities[t] for w in here)
    out = defaultdict(set)
    for d, t in rows:
        for e in entities[t or ""]:
            for w, s, end in words[t or ""]:
                rate = ne[e] / n
                if rate < 1:
                    share = log((net[e, w] + pii.PRIOR * rate) / (nt[w] + pii.PRIOR) / rate) / -log(rate)
                    if share >= pii.GENERALISE:
                        out[d].add(("remove" if share >= pii.REMOVE else "general", s, end))
    return {d: {x for x in v if not (x[0] == "general" and ("remove", *x[1:]) in v)} for d, v in out.items()}


@pytest.mark.parametrize("small", [pii.SMALL, 0])
def test_telling_terms_by_brute_force(docs_of, small):
    rng = random.Random(4)
    people = [("ann@mail.example.org", "violinist Zürich"), ("+49 30 1234567", "harbourmaster"), ("10.0.0.1", "gateway rack")]
    rows = []
    for i in range(240):
        text = " ".join(rng.choices(["the", "boat", "river", "stone", "hill", "über"], k=12))
        if i % 8 == 0:
            contact, tell = people[i // 8 % 3]
            text += f" {contact} {tell} {text[:20]}"
        if i % 50 == 7:
            text += " violinist"
        rows.append((i, text))
    rows += [(1000, None), (1001, "lone@x.yz unheard"), (1002, "lone@x.yz unheard"), (1003, "the only@other.net boat rarest " + "word " * 300)]
    want = brute_terms(rows)
    got = pii.found_spans(docs_of(rows), small=small).collect()
    assert len(got) == len(rows) and any(want.values())
    for r in got:
        found = {tuple(s) for s in r.spans}
        assert {s for s in found if s[0] in pii.TERM_KINDS} == want.get(r.id, set())
        assert [tuple(s) for s in r.spans if s[0] in pii.KINDS] == brute_pii(dict(rows)[r.id])
    clean = {r.doc_id: r.text for r in pii.sanitised(docs_of(rows, {"kind": F.lit(1)}), small=small).collect()}
    assert clean[1000] is None and clean[1001] == clean[1002] and clean[1001].startswith("[email] ")
    assert want[1003] and "rarest" not in clean[1003]
    for d, text in clean.items():
        assert not brute_pii(text)
        if want.get(d):
            assert not re.search("harbourmaster|gateway", text)


def test_awkward_rows(docs_of, awkward):
    rows = [r[:2] for r in awkward] + VERY_LONG
    docs = docs_of(rows, {c: F.lit(2) for c in ("spans", "rule", "id", "hash", "base", "row", "words", "entities", "term", "text_", "__own", "__words")})
    assert len(pii.found_spans(docs).collect()) == len(rows) == len(secret_scans.secrets(docs).collect())
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns and len(clean.collect()) == len(rows)
    assert pii.found_spans(docs_of([])).count() == 0 == secret_scans.secrets(docs_of([])).count()


def test_queries(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op4_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_pii(texts[r.doc_id])
        n = Counter(k for k, _, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in pii.KINDS) and r.base_sha256 == digest(base)
    rows = secret_scans.op5_secret_scans(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_secrets(texts[r.doc_id])
        n = Counter(k for k, _, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(n[k] for k in secret_scans.BASE) and r.base_sha256 == digest(base)


def test_pairs_of_frequent_terms_go_before_they_are_counted(spark):
    """Only pairs that some count could make telling are left; terms that aren't told apart stay."""
    dealt = spark.createDataFrame([([(1, 2), (2, 900)], ["the", "rare", "other"])], "often array<struct<entity:long,ne:long>>, terms array<string>")
    frequent = spark.createDataFrame([("the", 990), ("rare", 2)], "term string, nt long")
    got = sorted((r.entity, r.term) for r in pii.possible_pairs(dealt, frequent, 10_000).collect())
    assert (1, "rare") in got and (1, "the") not in got and (2, "the") in got and {(1, "other"), (2, "other")} <= set(got)


def test_telling_pairs_go_back_to_texts_that_have_both(spark):
    """300 texts of one entity, with 20 telling terms each: 6,000 rows meet 6,000 telling pairs, not 300 times as many; nothing else is written."""
    rows = [(d, 1, 300, f"t{d}x{i}") for d in range(300) for i in range(20)]
    pairs = saved(spark.createDataFrame(rows, "hash long, entity long, ne long, term string"))
    known = saved(spark.createDataFrame([(r[3], 1) for r in rows], "term string, nt long"))
    told = pii.told_terms(pairs, known, 10**9)
    assert {(r.hash, r.term) for r in told.collect()} == {(r[0], r[3]) for r in rows}
    todo, joined = [told._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName():
            joined.append(node.metrics().apply("numOutputRows").value())
        todo += [node.finalPhysicalPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
    assert sum(joined) == len(rows)
