"""Places of regular-expression matches in a text, with SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

_BLOCK = 256
SPAN = "array<struct<kind:string,start:int,end:int>>"


def running(x: Column) -> Column:
    """Prefix sums of an array of whole numbers, by blocks, so that long arrays stay cheap."""

    def sums(a: Column) -> Column:
        none = F.array().cast("array<int>")
        return F.aggregate(a, none, lambda acc, v: F.concat(acc, F.array(v + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)))))

    total = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)
    starts = lambda v: F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(_BLOCK))
    blocks = let(x, lambda v: F.transform(starts(v), lambda at: F.slice(v, at + 1, F.lit(_BLOCK))))

    def lifted(b: Column) -> Column:
        ends = sums(F.transform(b, total))
        return let(ends, lambda e: F.transform(b, lambda own, i: let(F.coalesce(F.get(e, i - 1), F.lit(0)), lambda add: F.transform(sums(own), lambda v: v + add))))

    return F.flatten(let(blocks, lifted))


def matches(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches: array of struct(kind, start, end, value, part); part: that group of the pattern.

    Positions count code points. The gaps between matches are what split() leaves, so ends are
    the running sum of gap and match lengths. The pattern must not match the empty string.
    """
    regex = F.lit(pattern)
    extract = lambda g: F.regexp_extract_all(text, regex, F.lit(g))

    def placed(found: Column, gaps: Column, parts: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))

        def rows(ends: Column) -> Column:
            end = lambda i: F.get(ends, i)
            return F.transform(
                found,
                lambda m, i: F.struct(F.lit(kind).alias("kind"), (end(i) - F.length(m)).alias("start"), end(i).alias("end"), m.alias("value"), F.get(parts, i).alias("part")),
            )

        return let(running(steps), rows)

    return let(extract(0), lambda found: let(F.split(text, pattern, -1), lambda gaps: let(extract(group), lambda parts: placed(found, gaps, parts)) if group else placed(found, gaps, found)))


def spans(text: Column, may: Column, pattern: str, kind: str, good: Callable[[Column], Column] = lambda m: F.lit(True), group: int = 0) -> Column:
    """The matches whose struct passes `good`, as kind, start, end, value. may: a cheap condition without which nothing matches."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    kept = F.filter(matches(text, pattern, kind, group), good)
    out = F.transform(kept, lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    return F.when(may, out).otherwise(none)


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def as_text(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def row_hash(text: Column) -> Column:
    """Tells texts of rows with the same id apart."""
    return F.xxhash64(text)
