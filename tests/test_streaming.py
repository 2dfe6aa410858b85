import pytest
from pyspark.sql import functions as F

from rookery.operators import deltas
from rookery.streaming import jobs


def counts(df):
    return {(str(r.day), r.event_type): r.n for r in df.collect()}


def daily(batch):
    return batch.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


def merged(spark, folder):
    return jobs.MergedSummary(spark, folder, lambda old, new: deltas.merge_keyed(old, new, ["day", "event_type"], ["n"]), daily)


def test_merged_summary_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    source, folder = str(tmp_path / "in"), str(tmp_path / "summary")
    events.where("event_id % 2 = 0").coalesce(1).write.mode("append").parquet(source)
    jobs.run_once(jobs.stream_parquet(spark, source, "ts"), merged(spark, folder), str(tmp_path / "progress"), "append")
    events.where("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(source)
    query = jobs.run_once(jobs.stream_parquet(spark, source, "ts"), merged(spark, folder), str(tmp_path / "progress"), "append")
    assert jobs.describe(query)["rows"] == events.where("event_id % 2 = 1").count()
    assert counts(merged(spark, folder).read()) == counts(daily(events))


def test_a_replayed_batch_counts_once(spark, tmp_path):
    batch = spark.createDataFrame([("2024-01-01 00:00:00", "view")], "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    summary = merged(spark, str(tmp_path / "s"))
    for number in (0, 0, 1, 1, 0):
        summary(batch, number)
    assert counts(summary.read()) == {("2024-01-01", "view"): 2} and summary.versions()[-1] == 1


def test_a_new_checkpoint_is_told(spark, sf, tmp_path):
    """Neither dropped nor counted twice: an error, or merged where the caller says that only new rows come."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    first, second, folder = str(tmp_path / "in"), str(tmp_path / "more"), str(tmp_path / "summary")
    events.where("event_id % 2 = 0").coalesce(1).write.parquet(first)
    events.where("event_id % 2 = 1").coalesce(1).write.parquet(second)
    jobs.run_once(jobs.stream_parquet(spark, first, "ts"), merged(spark, folder), str(tmp_path / "p1"), "append")
    before = counts(merged(spark, folder).read())
    with pytest.raises(Exception, match="another query or checkpoint"):
        jobs.run_once(jobs.stream_parquet(spark, second, "ts"), merged(spark, folder), str(tmp_path / "p2"), "append")
    assert counts(merged(spark, folder).read()) == before
    adopting = merged(spark, folder)
    adopting.adopt = True
    jobs.run_once(jobs.stream_parquet(spark, second, "ts"), adopting, str(tmp_path / "p3"), "append")
    assert counts(adopting.read()) == counts(daily(events))


def test_first_of_each(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").limit(500)
    source = str(tmp_path / "in")
    events.unionByName(events).coalesce(1).write.parquet(source)
    out = []
    frame = jobs.first_of_each(jobs.stream_parquet(spark, source, "ts"), ["event_id"], "ts", "1 day")
    jobs.run_once(frame, lambda batch, n: out.append(batch.count()), str(tmp_path / "progress"), "append")
    assert sum(out) == 500


def test_activity(spark, sf, tmp_path):
    source = str(tmp_path / "in")
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.coalesce(1).write.parquet(source)
    final = {}

    def keep(batch, n):
        final.update({(str(r.start.date()), r.event_type): r.n for r in batch.collect()})

    jobs.run_once(jobs.activity(jobs.stream_parquet(spark, source, "ts"), "ts", "event_type"), keep, str(tmp_path / "progress"), "update")
    assert final == counts(daily(events))


def test_retention_and_ensure_built(spark, tmp_path):
    log = spark.createDataFrame([(i, i // 2) for i in range(12)], "id int, created_at int")
    assert [r.id for r in jobs.newest(log).orderBy("id").collect()] == list(range(2, 12))
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert jobs.ensure_built(spark, str(tmp_path / "p"), build).count() == 3
    assert calls == [1]
