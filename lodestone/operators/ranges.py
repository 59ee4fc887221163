"""Work along one long order in parallel: ranges of rows, their summaries, and what carries over from range to range.

Rows are dealt to ranges by their order, so no key and no single order has to
fit into one task.  What a range needs to know of the rows before it is told by
short summaries.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import keep

#: Rows of a range in the mean, and ranges at most.
ROWS, MOST = 1 << 16, 1 << 14


def ranges_of(rows: DataFrame, parts: int | None = None) -> int:
    return parts or min(MOST, max(1, math.ceil(rows.count() / ROWS)))


def in_ranges(rows: DataFrame, by: list, parts: int) -> DataFrame:
    """The rows, sorted, in ranges of their order; equal rows share a range. _range numbers the ranges and may skip some."""
    return rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id())


def ordinal(rows: DataFrame, by: list[Column | str], start: int = 0, name: str = "ord", parts: int | None = None) -> DataFrame:
    """The rows numbered from `start` in the order of `by`, whatever their number of partitions; rows that `by` leaves equal are numbered in any order.

    Each range numbers its own rows and starts after those of the ranges before it, whose counts (MOST at most) add up on the driver.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kept = keep(in_ranges(rows, by, ranges_of(rows, parts)).withColumn("_place", place).drop(name), "ordinal")
    counts = sorted(kept.groupBy("_range").count().collect())
    offsets = list(zip([r[0] for r in counts], accumulate([r[1] for r in counts], initial=start)))
    before = kept.sparkSession.createDataFrame(offsets, "_range int, _before long")
    return kept.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")
