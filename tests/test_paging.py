"""Pages against slices of a sorted list."""

import pytest
from pyspark.sql import functions as F

from rookery.operators import games, paging


@pytest.fixture(scope="module")
def rows(spark):
    """One value holds a third of all rows; the columns have names that paging uses itself."""
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50)
    return spark.range(5000).select(key.cast("int").alias("page"), F.col("id").alias("total"), F.lit("x").alias("__place"), F.lit(1).alias("range"), F.lit(2).alias("at"), F.lit(3).alias("row"))


def order():
    return [F.col("page").desc(), F.col("total")]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    return paging.PageIndex.build(rows, order(), str(tmp_path_factory.mktemp("index") / "i"), ranges=7)


def plain(rows):
    return sorted(map(tuple, rows.collect()), key=lambda r: (-r[0], r[1]))


def test_every_page_of_an_index(rows, index):
    want = plain(rows)
    assert index.total == 5000 and index.pages(100) == 50
    for page, size in ((1, 100), (2, 37), (25, 100), (50, 100), (136, 37)):
        at = (page - 1) * size
        assert list(map(tuple, index.page(page, size).collect())) == want[at : at + size]
    assert list(map(tuple, index.page(10**8, 100).collect())) == want[4900:]
    assert index.page(10**8, 100, clamp=False).count() == 0


def test_a_page_opens_one_or_two_ranges(index):
    assert len({f for f in index.page(20, 100).inputFiles()}) >= 1
    plan = index.slice(2000, 100)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(range" in plan or "range" in plan.split("PartitionFilters")[1][:80]


def test_ties_fill_many_ranges(spark, tmp_path):
    index = paging.PageIndex.build(spark.range(3000).withColumn("k", F.lit(1)), [F.col("k")], str(tmp_path / "i"), ranges=6)
    assert len(index.ranges) > 3
    seen = [r.id for p in range(1, 31) for r in index.page(p, 100).collect()]
    assert sorted(seen) == list(range(3000))


def test_empty_table(spark, tmp_path):
    index = paging.PageIndex.build(spark.range(0), [F.col("id")], str(tmp_path / "i"))
    assert index.total == 0 and index.page(3, 10).columns == ["id"] and index.page(3, 10).count() == 0
    index.drop()


def test_pages_of_frames(rows):
    want = plain(rows)
    assert [tuple(r) for r in paging.paginate(rows, order(), 3, 40).collect()] == want[80:120]
    assert [tuple(r) for r in paging.paginate(rows, order(), 10**8, 100).collect()] == want[4900:]
    assert paging.paginate(rows, order(), 10**8, 100, clamp=False).count() == 0
    with pytest.raises(ValueError):
        paging.page_with_total(rows, order(), 1, 10)
    for page in (2, 10**8):
        got = paging.page_with_total(rows, order(), page, 60, names=("n", "p", "ps")).collect()
        at = (min(page, 84) - 1) * 60
        assert [tuple(r)[:6] for r in got] == want[at : at + 60] and {tuple(r)[6:] for r in got} == {(5000, min(page, 84), 84)}


def test_no_top_k_of_deep_pages(rows):
    assert "TakeOrdered" not in paging.paginate(rows, order(), 10**4, 50)._jdf.queryExecution().executedPlan().toString()


def test_pages_of_top_moves(spark):
    moves = spark.createDataFrame([(g, n, f"w{n}", "b") for g in range(5) for n in range(1, 9)], "link long, n_move int, white_move string, black_move string")
    game = spark.range(5).withColumnRenamed("id", "link")
    got = sorted(map(tuple, games.top_moves_page(moves, game, page=9, size=4, max_move=10).collect()))
    assert got == [(9, "-", 0, 10, 3, 3), (10, "-", 0, 10, 3, 3)]
    assert [r.move for r in games.top_moves_page(moves, game, page=2, size=3).orderBy("n_move").collect()] == ["w4", "w5", "w6"]
