"""Range joins of points with spans by bins: an equi-join in which no pair of a point and a span is ever made.

A span is cut into the bins that fill it, each as wide as can be: at most two on a level, whose bins are 2^level wide. What is asked of
the spans over a bin (the shortest, or whether there is one) is kept a bin, and a place is looked up once a level. Rows thus grow with
spans, places and levels, however many spans lie over a place. Points of one place are looked up once and share its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HELD = ("__level", "__bin")


def _level(start: Column, end: Column) -> Column:
    """The bits of a span's length: its bins are 2^level wide."""
    return F.length(F.bin(end - start)).cast("int")


def _bin(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at.cast("long"), level)


def binned_spans(spans: DataFrame, start: str, end: str) -> DataFrame:
    """spans with __level and __bin, a row for each of the one or two bins that they cross; empty spans and ones with a null bound are left out."""
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    rows = spans.where(s <= e).withColumn("__level", _level(s, e))
    return rows.withColumn("__bin", F.explode(F.sequence(_bin(s, F.col("__level")), _bin(e, F.col("__level")))))


def binned_points(points: DataFrame, at: str, levels: list[int]) -> DataFrame:
    """points with __level and __bin, a row a level; points without place have none."""
    rows = points.where(F.col(at).isNotNull()).withColumn("__level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    return rows.withColumn("__bin", _bin(F.col(at), F.col("__level")))


def levels_of(spans: DataFrame, start: str, end: str) -> list[int]:
    """The levels that spans lie on, 64 at most."""
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    return sorted(r["level"] for r in spans.where(s <= e).select(_level(s, e).alias("level")).distinct().collect())


def filling_bins(spans: DataFrame, start: str, end: str) -> DataFrame:
    """spans with __level and __bin, a row for each of the bins that fill them without overlap; ones that are empty or lack a bound are left out."""
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    half = lambda x: F.call_function("shiftright", x, F.lit(1)) + x.bitwiseAND(1)  # noqa: E731  rounded up, and no overflow

    def at(level: Column) -> Column:
        """The bins at both ends that no bin of the next level takes in: an odd first and an even last one."""
        up = F.greatest(level - 1, F.lit(0))
        first = F.when(level == 0, s).otherwise(_bin(half(s) - 1, up) + 1)
        last = F.when(level == 0, e).otherwise(_bin(half(e), up) - 1)
        ends = F.array(F.when(first.bitwiseAND(1) == 1, first), F.when(last.bitwiseAND(1) == 0, last))
        return F.transform(F.when(first <= last, F.array_compact(ends)).otherwise(F.array().cast("array<bigint>")), lambda b: F.struct(level.alias("level"), b.alias("bin")))

    rows = spans.where(s <= e)
    rows = rows.withColumn("__at", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), _level(s, e)), at))))
    return rows.withColumns({"__level": F.col("__at.level"), "__bin": F.col("__at.bin")}).drop("__at")


def _looked_up(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, best: Column, found: Column, name: str) -> DataFrame:
    """by, at and name of the places of points that lie in spans: best is an aggregate of the spans over a bin, found one of the bins over a place."""
    bins = filling_bins(spans, start, end).groupBy(*by, *_HELD).agg(best.alias("__best"))
    places = points.select(*by, at).distinct().dropna()
    levels = levels_of(spans, start, end)
    return binned_points(places, at, list(range(max(levels, default=-1) + 1))).join(bins, [*by, *_HELD]).groupBy(*by, at).agg(found.alias(name))


def tightest(points: DataFrame, spans: DataFrame, by: list[str], key: str, at: str, start: str, end: str, value: str, order: str) -> DataFrame:
    """points with value of the span (start and end included) around each that is shortest, then first in order; null if none.

    Points without place, or with a null in by, lie in no span. key names a point; each row has the result of its own place.
    """
    length = F.col(end).cast("long") - F.col(start).cast("long")
    best = F.min(F.struct(length.alias("length"), F.col(order).alias("order"), F.col(value).alias("value")))
    found = _looked_up(points, spans, by, at, start, end, best, F.min("__best")["value"], value)
    return points.join(found, [*by, at], "left").select(*points.columns, value)


def marked(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, name: str) -> DataFrame:
    """points with whether each lies in any span, under name; false without place or with a null in by."""
    found = _looked_up(points, spans, by, at, start, end, F.lit(True), F.lit(True), name)
    return points.join(found, [*by, at], "left").select(*points.columns, F.coalesce(name, F.lit(False)).alias(name))


def inside_any(points: DataFrame, spans: DataFrame, by: list[str], key: str, at: str, start: str, end: str, inside: bool = True) -> DataFrame:
    """The points that lie in any span, or with inside=False in none."""
    found = marked(points, spans, by, at, start, end, "__inside")
    return found.where(F.col("__inside") == inside).drop("__inside")
