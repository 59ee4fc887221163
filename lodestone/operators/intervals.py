"""Points in intervals by an index of dyadic bins.

An interval is the union of at most two bins a level of a binary hierarchy; a
point lies in one bin of each level.  So a point and an interval that holds it
share exactly one bin, and meet by an equi-join of bins.  Each bin keeps only
the best of its intervals before the join, so that a point meets one row a
level at most, however many intervals hold it; a file or line with most of the
rows spreads over its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import by_few, keep


def _bins(levels: int) -> Column:
    """Array of (level, bin) whose union is the interval from _start to _end, both included."""
    low, high = "(-shiftright(-_start, l))", "shiftright(_end + 1, l)"
    left = f"if({low} < {high} and {low} % 2 <> 0, struct(l as _level, {low} as _bin), null)"
    right = f"if({low} < {high} and {high} % 2 <> 0, struct(l as _level, {high} - 1 as _bin), null)"
    return F.expr(f"array_compact(flatten(transform(sequence(0, {levels}), l -> array({left}, {right}))))")


def best(points: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, end: str, rank: Column) -> DataFrame:
    """The points that an interval with the same `on` holds (both ends included), with a column _best: the least rank struct of those.

    Bounds and points are whole numbers; rows with a null among them or in `on` hold and are held by nothing, and so
    do intervals that end before they start.  Points that repeat make one row.
    """
    bounds = [F.col(start).cast("long").alias("_start"), F.col(end).cast("long").alias("_end")]
    spans = intervals.select(*on, *bounds, rank.alias("_best")).where("_start <= _end")
    longest = spans.agg(F.max(F.expr("_end - _start"))).first()[0]
    levels = 0 if longest is None else (longest + 1).bit_length()
    bins = spans.select(*on, "_best", F.inline(_bins(levels))).groupBy(*on, "_level", "_bin").agg(F.min("_best").alias("_best"))
    kept = keep(bins, "bins")
    used = sorted(r[0] for r in kept.select("_level").distinct().collect())  # 64 at most
    level = F.explode(F.array(*[F.lit(x) for x in used]).cast("array<int>"))
    probes = points.withColumn("_level", level).withColumn("_bin", F.expr(f"shiftright(cast({at} as bigint), _level)"))
    met = by_few(probes, kept, [*on, "_level", "_bin"], "inner")
    return met.groupBy(*points.columns).agg(F.min("_best").alias("_best"))
