import hashlib
from collections import defaultdict

import pytest

from rookery.llm import exact_dedup as op

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        top = max(known) if known else None
        ids = sorted(ids, key=lambda i: (i is None, -(i or 0)))
        out += [(i, top, len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("support", [1e-4, 0.02, 0.3])
def test_classes(docs_of, awkward, support):
    rows = [*awkward, *[(100 + i, "Hot copy") for i in range(400)], *[(600 + i, f"t{i % 40}") for i in range(200)]]
    got = op.duplicate_classes(docs_of(rows), support=support).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_rows_that_stay(docs_of, awkward):
    from pyspark.sql import functions as F

    rows = [*awkward, *[(100 + i, "Hot copy") for i in range(300)]]
    docs = docs_of(rows, {"digest": F.lit("x"), "kept": F.lit(1), "n": F.lit(2)})
    got = op.exact_dedup(docs, support=0.1)
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in got.collect()) == sorted((x[0] is None, x[0]) for x in brute(rows) if x[3])


def test_empty(docs_of):
    assert op.duplicate_classes(docs_of([])).count() == 0
    assert op.exact_dedup(docs_of([])).count() == 0


def test_query_matches_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(op.ORACLE)
    got = op.op3_exact_dedup(spark, sf).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
