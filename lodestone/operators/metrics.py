"""Code metrics of the executable around each string literal.

The one place where sources go through Python: a parser can't be an expression.
Files are parsed one by one in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import intervals
from ..functions.dart import parse
from ..session import ship

BREAK = re.compile("\r\n|\n|\r")
SCHEMA = "path string, literal_no int, value string, line int, column int, function_name string, complexity int, nesting_depth int, function_loc int, context string, line_length int, snippet string"


def _rows(path: str, text: str) -> list[tuple]:
    starts = [0] + [m.end() for m in BREAK.finditer(text)]
    ends = [m.start() for m in BREAK.finditer(text)] + [len(text)]
    place = lambda at: bisect_right(starts, at)
    found, out = parse(text), []
    for k, x in enumerate(sorted(found.literals, key=lambda x: x.start)):
        line = place(x.start)
        row = (path, k, x.value, line, x.start - starts[line - 1] + 1)
        written = text[starts[line - 1] : ends[line - 1]]
        tail = (x.context, len(written), written.strip())
        if x.executable is None:
            out.append((*row, None, None, None, None, *tail))
        else:
            e = found.executables[x.executable]
            out.append((*row, e.name, e.complexity, e.depth, max(1, place(max(e.start, e.end - 1)) - place(e.start) + 1), *tail))
    return out


def literal_metrics(sources: DataFrame) -> DataFrame:
    """Literals of Dart sources (path, content) with name, complexity, nesting depth and lines of the executable that holds them,
    the name they are given to, and the length and trimmed text of their line.

    Nulls where a literal stands outside of executables; a null or empty source has no literals.
    """
    ship(sources.sparkSession)
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = _rows(path, text or "")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return sources.select("path", "content").mapInArrow(run, SCHEMA)


def enclosing(points: DataFrame, executables: DataFrame) -> DataFrame:
    """Points (file, point_id, offset) with the smallest executable (file, name, start, end) that holds them, if any."""
    spans = executables.select("file", "name", "start", "end")
    rank = F.struct((F.col("end") - F.col("start")).alias("size"), "start", "name", "end")
    held = intervals.best(points.select("file", "point_id", "offset"), spans, ["file"], "offset", "start", "end", rank)
    return points.join(held, ["file", "point_id", "offset"], "left").select("file", "point_id", "offset", "_best.name", "_best.start", "_best.end")
