"""Functions that return documents, and every stage of the pipeline: awkward rows, and columns with the names that they use inside."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rookery.llm.exact_dedup import exact_dedup
from rookery.llm.mixing import mix
from rookery.llm.pii import sanitised
from rookery.llm.quality_rules import quality_filter
from rookery.llm.simhash_dedup import near_dedup

NAMES = (
    "row id number key size source_ copies copy p of block extra total rows target base drawn many pieces mark marks root first least keeper component_id "
    "h w lines g sorted marked grams model sum trusted score kept n_words base_failed digest n top place most here hash spans more term entity words clean "
    "__n __id __own __copies __gone __spans __mark __digest __words item a b t c"
).split()


def functions(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    return {"quality": lambda d: quality_filter(d, labels), "exact": exact_dedup, "near": near_dedup, "alike": lambda d: near_dedup(d, shingle=5, similarity=0.8), "mix": mix, "sanitised": sanitised}


@pytest.mark.parametrize("name", ["quality", "exact", "near", "alike", "mix", "sanitised"])
def test_columns_of_any_name(spark, docs_of, awkward, name):
    rows = [*awkward, (50, "mail ann@x.org " + " ".join(f"w{i}" for i in range(80))), (2**53 + 1, "long id " * 40)]
    docs = docs_of(rows, {n: F.lit(f"my {n}") for n in NAMES}).withColumn("with.dot", F.lit(5))
    out = functions(spark)[name](docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = out.collect()
    assert got and {str(r.doc_id) for r in got} <= {str(r[0]) for r in rows}
    assert all(r[n] == f"my {n}" for r in got for n in NAMES) and all(r["with.dot"] == 5 for r in got)


def test_stages_one_after_another(spark, sf, docs_of, awkward):
    """All stages on awkward rows and on none, with clashing columns; all but the last keep the columns."""
    filler = [(100 + i, " ".join(f"w{(i * 7 + k) % 900}" for k in range(60 + i))) for i in range(30)]
    for rows in ([*awkward, *filler, *filler[:3]], []):
        docs = docs_of(rows, {n: F.lit(n) for n in NAMES})
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != "pack":
                assert out.columns == docs.columns, name
                docs = spark.createDataFrame(out.collect(), docs.schema)
                assert bool(docs.count()) == bool(rows), name
        pieces = out.collect()
        assert sorted({str(p.doc_id) for p in pieces}) == sorted({str(r.doc_id) for r in docs.collect()})
