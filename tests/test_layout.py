import pytest
from pyspark.sql import functions as F

from rookery.operators import games
from rookery.plans.adapters import Tables
from rookery.sources import layout


def scanned(df):
    """Rows that the scans of an executed frame let through: those of the row groups and pages that are read."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    plan = plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") and "Adaptive" in plan.getClass().getName() else plan
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        leaf = leaf.plan() if "QueryStage" in leaf.getClass().getName() else leaf
        while leaf.children().size():
            leaf = leaf.children().apply(0)
        if leaf.metrics().contains("numOutputRows"):
            total += leaf.metrics().apply("numOutputRows").value()
    return total


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def tables(spark, sf):
    return Tables(spark, sf)


def test_a_game_is_one_row_group(spark, tables, tmp_path):
    path = str(tmp_path / "game")
    layout.write_games(tables.game, path, files=6, group=1 << 16)
    stored, n = spark.read.parquet(path), tables.game.count()
    assert rows(stored) == rows(tables.game)
    link = tables.game.agg(F.max("link")).first()[0]
    one = layout.lookup(spark, path, "link", [link, None, link])
    assert one.count() == 1 and 1 <= scanned(one) <= n / 6
    assert layout.lookup(spark, path, "link", []).count() == layout.lookup(spark, path, "link", [None]).count() == 0


def test_a_players_page_and_a_games_rows(spark, tables, tmp_path):
    path, plain = str(tmp_path / "gp"), str(tmp_path / "plain")
    layout.write_player_games(tables.gp, path, files=16, distinct=20_000)
    tables.gp.repartition(16, "player_name").write.parquet(plain)
    stored, n = spark.read.parquet(path), tables.gp.count()
    page = games.player_games_page(stored, 4, 1, 20)
    assert rows(page) == rows(games.player_games_page(tables.gp, 4, 1, 20))
    assert scanned(stored.where("player_name = 4")) <= n / 8
    link = tables.gp.agg(F.min("link")).first()[0]
    found = layout.lookup(spark, path, "link", [link])
    assert found.count() == 2 and scanned(found) <= n / 4  # its two players' files, and what a filter lets through
    assert scanned(spark.read.parquet(plain).where(F.col("link") == link)) > scanned(found)
    between = spark.read.parquet(path).where("link = 5000000000")
    assert between.count() == 0


def test_a_hot_player_goes_over_many_files(spark, tmp_path):
    hot = spark.range(40_000).select(F.when(F.col("id") % 3 > 0, "ann").otherwise(F.col("id").cast("string")).alias("player_name"), F.col("id").alias("link"), F.timestamp_seconds("id").alias("played_at"), F.lit("white").alias("color"))
    path = str(tmp_path / "hot")
    layout.write_player_games(hot, path, files=8)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * 40_000 / 8


def test_empty_table(spark, tables, tmp_path):
    path = str(tmp_path / "none")
    layout.write_games(tables.game.limit(0), path)
    assert layout.lookup(spark, path, "link", [1]).count() == 0
