"""Pages of an ordering: a top-k for the first rows, and a page index for any page of any table.

A page index is the table written once in ranges of its order. Each range is a folder, sorted, and every row has its
place there; the rows of each range are counted from file footers. Page p then is cut out of the one or two ranges it
lies in: other folders aren't opened, and within a range the places are sorted, so row groups are passed over by their
statistics. No task sorts or keeps more than a range, whatever the number of the page.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_right
from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import delete, listed, shared_folder

#: Rows up to the end of a page that a top-k may keep in each task; pages beyond take an index.
SHALLOW = 2000
#: Rows of a page at most.
MOST = 100
_PLACE = f"place {uuid.uuid4().hex}"  # beside the user's columns


def page_bounds(total: int, page: int, size: int, most: int = MOST, clamp: bool = True) -> tuple[int, int, int]:
    """Page, size and offset; with clamp, a page past the end is the last one."""
    size = max(1, min(most, size))
    last = max(1, math.ceil(total / size))
    page = max(1, page)
    page = min(page, last) if clamp else page
    return page, size, (page - 1) * size


def _row(names: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")


class PageIndex:
    """A table in the order of its pages. `build` writes it; the object only reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.rows = spark.read.parquet(f"{self.path}/rows")
        sizes = {r["range"]: r["n"] for r in self.rows.groupBy("range").agg(F.count("*").alias("n")).collect()}  # one row a range
        self.ranges = sorted(r for r in sizes if r is not None and r >= 0)
        self.ends = list(accumulate(sizes[r] for r in self.ranges))

    @classmethod
    def build(cls, df: DataFrame, order: Sequence[Column], path: str, ranges: int | None = None) -> PageIndex:
        """Write the index. Rows that are alike in the order go by a hash of the whole row, so one key can fill many ranges."""
        spark = df.sparkSession
        n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        hashed = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        by = [*order, F.xxhash64(*hashed)]
        # The number of a row in its sorted partition says both: range in the upper bits, place in the lower 33.
        dealt = df.repartitionByRange(n, *by).sortWithinPartitions(*by).select(_row(df.columns), F.monotonically_increasing_id().alias("number"))
        rows = dealt.select("row", F.shiftright("number", 33).cast("int").alias("range"), F.col("number").bitwiseAND((1 << 33) - 1).alias("at"))
        empty = spark.createDataFrame([], rows.schema).withColumn("range", F.lit(-1))
        rows.write.partitionBy("range").parquet(f"{path}/rows")
        if not any(n.startswith("range=") for n in listed(spark, f"{path}/rows")):  # an empty table: a schema to read
            empty.coalesce(1).drop("range").write.mode("overwrite").parquet(f"{path}/rows/range=-1")
        return cls(spark, path)

    @property
    def total(self) -> int:
        return self.ends[-1] if self.ends else 0

    def pages(self, size: int, most: int = MOST) -> int:
        return max(1, math.ceil(self.total / max(1, min(most, size))))

    def slice(self, offset: int, size: int) -> DataFrame:
        """Rows offset + 1, ..., offset + size, in order."""
        stop, conditions = min(offset + size, self.total), []
        i = bisect_right(self.ends, offset)
        while i < len(self.ranges) and (before := self.ends[i - 1] if i else 0) < stop:
            conditions.append((F.col("range") == self.ranges[i]) & F.col("at").between(max(0, offset - before), stop - before - 1))
            i += 1
        found = self.rows.where(reduce(Column.__or__, conditions) if conditions else F.lit(False))
        return found.orderBy("range", "at").select("row.*")

    def page(self, page: int, size: int, most: int = MOST, clamp: bool = True) -> DataFrame:
        """With clamp, a page past the end is the last one; without, it is empty."""
        _, size, offset = page_bounds(self.total, page, size, most, clamp)
        return self.slice(offset, size)

    def drop(self) -> None:
        """Delete the files."""
        delete(self.spark, self.path)


def _indexed(df: DataFrame, order: Sequence[Column]) -> PageIndex:
    return PageIndex.build(df, order, f"{shared_folder(df.sparkSession)}/pages-{uuid.uuid4().hex}")


def _top_page(df: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """row, total, page, pages of a page near the start: a top-k, cut once the total, which the same plan counts, is known."""
    place = F.row_number().over(Window.orderBy(*order))  # over page * size rows, at most SHALLOW
    top = df.orderBy(*order).limit(page * size).withColumns({_PLACE: place}).select(_row(df.columns), F.col(_PLACE).alias("place"))
    told = top.crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))
    told = told.withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("int")).withColumn("page", F.least(F.lit(page), F.col("pages")))
    return told.where((F.col("place") > (F.col("page") - 1) * size) & (F.col("place") <= F.col("page") * size)).drop("place")


def page_with_total(df: DataFrame, order: Sequence[Column], page: int, size: int, most: int = MOST, names: tuple[str, str, str] = ("total", "page", "pages")) -> DataFrame:
    """One page of an ordering, with total (rows in all), page and pages; a page past the end is the last one.

    `names` renames the three where the table has such columns. Pages near the start are a top-k, deeper ones take a page index.
    """
    if clash := set(names) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are there already: pass other names")
    page, size, offset = page_bounds(0, page, size, most, clamp=False)
    if offset + size > SHALLOW:
        index = _indexed(df, order)
        page, size, offset = page_bounds(index.total, page, size, most)
        told = [F.lit(index.total).cast("long"), F.lit(page), F.lit(index.pages(size))]
        return index.slice(offset, size).select("*", *[c.alias(n) for c, n in zip(told, names, strict=True)])
    return _top_page(df, order, page, size).select("row.*", *[F.col(c).alias(n) for c, n in zip(("total", "page", "pages"), names, strict=True)])


def paginate(df: DataFrame, order: Sequence[Column], page: int, size: int, most: int = MOST, clamp: bool = True) -> DataFrame:
    """One page of an ordering, never a full sort in one task. With clamp, a page past the end is the last one."""
    page, size, offset = page_bounds(0, page, size, most, clamp=False)
    if offset + size > SHALLOW:
        return _indexed(df, order).page(page, size, most, clamp)
    if page == 1 or not clamp:
        return df.orderBy(*order).offset(offset).limit(size)
    return _top_page(df, order, page, size).select("row.*")
