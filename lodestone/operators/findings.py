"""The findings table: projections, diagnostics and replacement by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals
from ..schemas import JSON_NAMES
from ..functions.labels import (
    context_of,
    diagnostic_message,
    filled,
    fingerprint,
    metric_suffix,
    node_kind_of,
    rule_name_of,
    severity_level,
    stored_range,
    SOURCE,
)
from .lines import snippet as line_snippet

MINIMAL = ["file", "rule_id", "severity", "message", "line", "column", "function_name", "complexity", "nesting_depth", "function_loc"]


def minimal(issues: DataFrame) -> DataFrame:
    """The ten columns of the scan's own output."""
    return issues.select(*MINIMAL)


def for_json(rows: DataFrame) -> DataFrame:
    """The same columns under the names they have in JSON."""
    return rows.select(*[F.col(c).alias(JSON_NAMES.get(c, c)) for c in rows.columns])


def json_by_file(issues: DataFrame) -> DataFrame:
    """(file, json): each file's issues as one compact JSON list with nulls kept, in the order of ord.

    A file's findings are gathered in one row, which its own size bounds.
    """
    item = F.struct("ord", F.to_json(F.struct(*[F.col(c).alias(JSON_NAMES.get(c, c)) for c in MINIMAL]), {"ignoreNullFields": "false"}).alias("j"))
    return issues.groupBy("file").agg(F.array_sort(F.collect_list(item)).alias("_i")).select("file", F.concat(F.lit("["), F.array_join(F.transform("_i", lambda x: x["j"]), ","), F.lit("]")).alias("json"))


def rich(issues: DataFrame, snippet: Column) -> DataFrame:
    """The minimal columns with what the message tells, the snippet and the fingerprint."""
    message = F.col("message")
    return issues.select(
        *([c for c in ("ord",) if c in issues.columns]),
        *MINIMAL,
        F.coalesce(rule_name_of(message), F.col("rule_id")).alias("rule_name"),
        F.coalesce(node_kind_of(message), F.lit("")).alias("node_kind"),
        F.coalesce(context_of(message), F.lit("")).alias("context"),
        snippet.alias("snippet"),
        fingerprint(F.col("file"), F.col("line"), F.col("column"), F.col("rule_id"), snippet).alias("fingerprint"),
    )


def with_snippets(issues: DataFrame, sources: DataFrame) -> DataFrame:
    """Issues with the trimmed text of their line, joined by file; empty out of range."""
    text = sources.select(F.col("path").alias("file"), "content")
    return issues.join(text, "file", "left").withColumn("snippet", line_snippet(F.coalesce("content", F.lit("")), F.col("line"))).drop("content")


def to_findings(issues: DataFrame, line_length: Column | None = None) -> DataFrame:
    """Rows of the store: severity defaults to warning, end_column is the length of the line (null if there is none)."""
    end = F.lit(None).cast("int") if line_length is None else line_length.cast("int")
    return issues.select("ord", "file", "line", "column", end.alias("end_column"), "rule_id", "message", filled(F.col("severity"), "warning").alias("severity"), "function_name", "complexity", "nesting_depth", "function_loc")


def upsert(store: DataFrame, new: DataFrame, scanned: DataFrame) -> DataFrame:
    """The store with the findings of all scanned files (file) replaced; a file scanned clean loses its rows.

    Rows of the store without a file stay.
    """
    return store.join(scanned.select("file").where("file is not null").distinct(), "file", "left_anti").unionByName(new)


def diagnostics(findings: DataFrame) -> DataFrame:
    """One row a finding that has a file: range from 0, message, severity, source and code."""
    rows = findings.where(F.coalesce("file", F.lit("")) != "")
    line, start, end = stored_range(F.col("line"), F.col("column"))
    suffix = metric_suffix(F.col("complexity"), F.col("nesting_depth"), F.col("function_loc"))
    return rows.select(
        "ord", "file", line.alias("line0"), start.alias("start_col"), end.alias("end_col"), diagnostic_message(F.col("rule_id"), F.col("message"), suffix).alias("message"),
        severity_level(filled(F.col("severity"), "warning")).alias("severity"), F.lit(SOURCE).alias("source"), F.col("rule_id").alias("code"),
    )


def by_file(diags: DataFrame) -> DataFrame:
    """(file, diagnostics): a file's diagnostics in order of ord."""
    cols = [c for c in diags.columns if c != "file"]
    return diags.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ord", *[c for c in cols if c != "ord"]))).alias("diagnostics"))


def lookup(positions: DataFrame, diags: DataFrame) -> DataFrame:
    """For each position (pos_id, file, at_line, at_col): the first diagnostic, by ord, whose range holds it (both ends included)."""
    spots = positions.select("pos_id", "file", F.col("at_line").alias("line0"), "at_col")
    hit = intervals.best(spots, diags, ["file", "line0"], "at_col", "start_col", "end_col", F.struct("ord", "message", "code"))
    return hit.groupBy("pos_id").agg(F.min("_best").alias("d")).select("pos_id", "d.*")
