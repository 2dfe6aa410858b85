import uuid
from collections import Counter

import pytest

import corpus_pipeline
from rookery.llm.common import shared_folder
from rookery.llm.quality_rules import op9_quality_rules


@pytest.fixture(scope="module")
def steps(spark, sf):
    """What each stage gets and gives."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_columns(steps):
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_quality_keeps_what_the_query_keeps(spark, sf, steps):
    kept = {r.doc_id for r in op9_quality_rules(spark, sf).where("kept").collect()}
    assert {r.doc_id for r in steps[0][2].collect()} == kept


def test_exact_leaves_one_of_each(steps):
    from test_exact_dedup import brute

    _, before, after = steps[1]
    want = {x[0] for x in brute([(r.doc_id, r.text) for r in before.collect()]) if x[3]}
    assert {r.doc_id for r in after.collect()} == want and after.count() == len(want)


def test_near_leaves_one_of_each(steps):
    """The stage joins texts from 0.8 on five words, unlike op7's query, whose contract has fingerprints within four bits."""
    from test_similar import brute_least

    _, before, after = steps[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(brute_least(rows, 0.8)))


def test_mix_nears_targets(steps):
    from test_mixing import brute_targets

    _, before, after = steps[3]
    size = lambda rows: Counter({s: n for s, n in _sums(rows).items()})
    want, got = brute_targets(size(before.collect())), size(after.collect())
    assert max(Counter(r.doc_id for r in after.collect()).values()) <= 3
    assert all(abs(got[s] - w) < 0.02 * w + 10 for s, w in want.items())


def _sums(rows):
    out = Counter()
    for r in rows:
        out[r.source] += len((r.text or "").split())
    return out


def test_pack_holds_everything(steps):
    from test_packing import verify

    _, before, after = steps[4]
    verify([(r.doc_id, r.text) for r in before.collect()], after.collect())


def test_run(spark, sf, steps):
    assert corpus_pipeline.run(spark, sf).count() == pytest.approx(steps[-1][2].count(), rel=0.02)
