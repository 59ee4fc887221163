"""Dashboard over findings: counters, buckets, tabs, top lists and hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import escape_html, file_name, filled, function_label, metrics_cell, rule_label

TEST_FILE = "_test.dart"
TOP, HOTSPOTS = 8, 15

#: Bucket name to lower (excluded) and upper (included) bound; complexity counts from 1.
COMPLEXITY = {"low": (0, 5), "medium": (5, 10), "high": (10, None)}
DEPTH = {"shallow": (None, 2), "medium": (2, 4), "deep": (4, None)}
SIZE = {"small": (None, 20), "medium": (20, 50), "large": (50, None)}


def within(value: Column, bounds: tuple[int | None, int | None]) -> Column:
    low, high = bounds
    out = value.isNotNull()
    if low is not None:
        out &= value > low
    return out & (value <= high) if high is not None else out


def in_tests(file: Column) -> Column:
    return F.coalesce(F.endswith(file, F.lit(TEST_FILE)), F.lit(False))


def _counts() -> dict[str, Column]:
    out = {}
    for name, column, parts in (("cx", "complexity", COMPLEXITY), ("depth", "nesting_depth", DEPTH), ("size", "function_loc", SIZE)):
        out |= {f"{name}_{k}": F.count_if(within(F.col(column), b)) for k, b in parts.items()}
    return out


def counters(findings: DataFrame) -> DataFrame:
    """One row with all counters and buckets, from one pass; zeros for no findings."""
    error = F.coalesce(F.lower("severity") == "error", F.lit(False))
    total = [F.count("*").alias("total"), F.count_if(error).alias("errors"), F.count_if(~error).alias("warnings"), F.count_if(in_tests(F.col("file"))).alias("test_findings")]
    return findings.agg(*total, *[c.alias(k) for k, c in _counts().items()])


def buckets(findings: DataFrame, which: str) -> DataFrame:
    """One row with the three counts of cx, depth or size."""
    return findings.agg(*[c.alias(k) for k, c in _counts().items() if k.startswith(f"{which}_")])


def tab(findings: DataFrame, name: str) -> DataFrame:
    """Rows of a tab: all, highCx, mediumCx, lowCx or tests."""
    if name == "all":
        return findings
    if name == "tests":
        return findings.where(F.endswith("file", F.lit(TEST_FILE)))
    return findings.where(within(F.col("complexity"), COMPLEXITY[name.removesuffix("Cx")]))


def table(findings: DataFrame) -> DataFrame:
    """The table's cells, escaped."""
    text = lambda c: escape_html(F.coalesce(c, F.lit("")))
    name = F.col("rule_name") if "rule_name" in findings.columns else F.lit(None).cast("string")
    return findings.select(
        "ord", text(F.col("severity")).alias("severity"), text(rule_label(name, F.col("rule_id"))).alias("rule"), text(F.col("message")).alias("message"),
        text(file_name(F.coalesce("file", F.lit("")))).alias("file"), F.nullif("line", F.lit(0)).alias("line"), text(F.col("function_name")).alias("function"),
        escape_html(metrics_cell(F.col("complexity"), F.col("nesting_depth"), F.col("function_loc"))).alias("metrics"),
    )


def top_counts(findings: DataFrame, key: Column, label=lambda c: c, n: int = TOP) -> DataFrame:
    """(label, n) of the n most frequent keys; ties in order of first appearance. A null or empty key is 'unknown'."""
    groups = findings.groupBy(filled(key, "unknown").alias("key")).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return groups.orderBy(F.desc("n"), "first").limit(n).select(label(F.col("key")).alias("label"), "n")


def hotspots(findings: DataFrame, n: int = HOTSPOTS) -> DataFrame:
    """The n findings of greatest complexity, then depth, then first."""
    top = findings.where("complexity > 0").orderBy(F.desc("complexity"), F.desc(F.coalesce("nesting_depth", F.lit(0))), "ord").limit(n)
    return top.select("ord", function_label(F.col("function_name")).alias("function"), file_name(F.coalesce("file", F.lit(""))).alias("file"), F.nullif("line", F.lit(0)).alias("line"), "complexity", "nesting_depth", "function_loc")


def bars(counts: DataFrame, height: int) -> DataFrame:
    """Chart bars of a top list (label, n): heights scaled to the greatest."""
    from ..functions.labels import bar_height

    most = counts.agg(F.coalesce(F.max("n"), F.lit(1)).alias("most"))
    return counts.crossJoin(F.broadcast(most)).select("label", "n", bar_height(F.col("n"), F.col("most"), height).alias("height"))
