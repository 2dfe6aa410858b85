"""Every query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from rookery.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(rows):
    return sorted((tuple(x for x in r) for r in rows), key=lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, (int, float)) else (True, "number", float(x)) for x in r))


KIND = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf)
    want = duck.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: KIND[dict(got.dtypes)[c]] for c in columns} == {c: kinds[c] for c in columns}
    a, b = plain(got.select(*[f"`{c}`" for c in columns]).collect()), plain(want.select(*[f'"{c}"' for c in columns]).fetchall())
    assert len(a) == len(b) and len(a) > 0
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-12)) for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_has_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
