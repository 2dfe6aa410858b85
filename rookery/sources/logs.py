"""Measurements out of text logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes by unit.
UNITS = {"B": 1, "kB": 10**3, "KB": 10**3, "MB": 10**6, "GB": 10**9, "KiB": 2**10, "MiB": 2**20, "GiB": 2**30, "TiB": 2**40}


def in_bytes(text: Column) -> Column:
    """1.5MiB as a number of bytes; null where it can't be read."""
    number = F.regexp_extract(text, r"^\s*([0-9.]+)", 1).try_cast("double")
    unit = F.regexp_extract(text, r"([A-Za-z]+)\s*$", 1)
    scale = F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in (kv[0], float(kv[1]))]), unit)
    return number * scale


def metrics_rollup(lines: DataFrame, text: str = "value") -> DataFrame:
    """name, metric, samples, low, mean, high of resource lines such as `db cpu=1.5% mem=20MiB / 1GiB pids=3`; other lines are noise."""
    row = F.col(text)
    part = lambda pattern: F.regexp_extract(row, pattern, 1)
    found = lines.where(row.rlike(r"^\S+\s+cpu=[0-9.]+%")).select(
        part(r"^(\S+)").alias("name"),
        part(r"cpu=([0-9.]+)%").try_cast("double").alias("cpu_percent"),
        in_bytes(part(r"mem=([^/\s]+)")).alias("mem_bytes"),
        part(r"mem%=([0-9.]+)").try_cast("double").alias("mem_percent"),
        part(r"pids=([0-9]+)").try_cast("double").alias("pids"),
        in_bytes(part(r"net=([^/\s]+)")).alias("net_in_bytes"),
        in_bytes(part(r"net=[^/]+/\s*(\S+)")).alias("net_out_bytes"),
        in_bytes(part(r"block=([^/\s]+)")).alias("block_in_bytes"),
        in_bytes(part(r"block=[^/]+/\s*(\S+)")).alias("block_out_bytes"),
    )
    rows = found.unpivot(["name"], [n for n in found.columns if n != "name"], "metric", "v").where("v IS NOT NULL")
    return rows.groupBy("name", "metric").agg(F.count("*").alias("samples"), F.min("v").alias("low"), F.avg("v").alias("mean"), F.max("v").alias("high"))


def sectioned_metrics(files: DataFrame, file: str = "file", text: str = "value") -> DataFrame:
    """device, name, samples, low, mean, high of `name: +12.3°C` lines under the device headers above them. files: whole texts."""
    lines = files.select(F.col(file).alias("file"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    measured = F.regexp_extract("line", r"^([^:]+):\s*[+-]?[0-9.]+", 1)
    header = F.when((F.trim("line") != "") & ~F.col("line").contains(":"), F.trim("line"))
    order = Window.partitionBy("file").orderBy("line_no")
    rows = lines.withColumn("device", F.last(header, True).over(order)).withColumn("name", F.trim(measured))
    rows = rows.withColumn("v", F.regexp_extract("line", r"^[^:]+:\s*\+?(-?[0-9.]+)", 1).try_cast("double")).where("name <> '' AND v IS NOT NULL")
    return rows.groupBy("device", "name").agg(F.count("*").alias("samples"), F.min("v").alias("low"), F.avg("v").alias("mean"), F.max("v").alias("high"))
