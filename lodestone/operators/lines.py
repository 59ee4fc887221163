"""Lines of texts, snippets and context windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAK = "\r\n|\n|\r"


def split_lines(text: Column) -> Column:
    """Lines without their breaks; a last line break opens no further line."""
    ends = lambda s: F.endswith(text, F.lit(s))
    open_ = F.when(ends("\r\n"), F.expr("2")).when(ends("\n") | ends("\r"), F.expr("1")).otherwise(F.expr("0"))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.left(text, F.length(text) - open_), BREAK))


def lines(df: DataFrame, text: str = "content") -> DataFrame:
    """A row for each line, numbered from 1; the text itself is not carried along."""
    return df.select(*[c for c in df.columns if c != text], F.posexplode(split_lines(F.col(text))).alias("line", "line_text")).withColumn("line", F.col("line") + 1)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def snippet(text: Column, line: Column) -> Column:
    """The trimmed line, or an empty text out of range."""
    return F.coalesce(F.when(line > 0, trimmed(F.try_element_at(split_lines(text), line.cast("int")))), F.lit(""))


def context(text: Column, first: Column, last: Column | None = None, around: int = 2) -> Column:
    """Lines from `around` before to `around` after (from 1, cut to the file), joined by line breaks.

    One slice of the file's own array: no window over all lines and no shuffle.
    """
    last, start = first if last is None else last, F.greatest(F.lit(1), first - around)

    def cut(rows: Column) -> Column:
        stop = F.least(F.size(rows), last + around)
        return F.when(stop >= start, F.array_join(F.slice(rows, start, stop - start + 1), "\n"))

    return F.transform(F.array(split_lines(text)), cut)[0]  # so that the text is split once
