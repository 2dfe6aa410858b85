import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) tuples."""

    def make(rows, extra=None):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name, value in (extra or {}).items():
            df = df.withColumn(name, value)
        return df

    return make


@pytest.fixture
def awkward():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = "word " * 60000 + "end"
    return [
        (1, None, None),
        (2, "", "a"),
        (3, "  \n\t ", "a"),
        (4, "Same text here " * 30, "b"),
        (5, "same TEXT here " * 30, "b"),
        (5, "same TEXT here " * 30, "b"),
        (6, long, "c"),
        (None, "no id " * 80, None),
        (None, None, "c"),
        (7, "x", "d"),
        (8, "Ünï cödé ÀÉ " * 40, "d"),
        (9, "a" * 200000, "e"),
        (10, "1 2 3 4 5 " * 4000, "e"),
    ]
