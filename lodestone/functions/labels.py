"""Labels, levels and ranges of findings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship

DEFAULT_WIDTH = 80
SOURCE = "lodestone"


def filled(value: Column, default: str | Column) -> Column:
    """The value, or the default where it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def severity_level(severity: Column) -> Column:
    return F.when(F.lower(severity) == "error", F.lit("Error")).otherwise(F.lit("Warning"))


def metric_suffix(complexity: Column, depth: Column, loc: Column) -> Column:
    """' [Cx=a, Depth=b, Size=c LOC]' of the metrics that are known, empty without any."""
    parts = F.concat_ws(", ", F.concat(F.lit("Cx="), complexity), F.concat(F.lit("Depth="), depth), F.concat(F.lit("Size="), loc, F.lit(" LOC")))
    return F.when(parts == "", F.lit("")).otherwise(F.concat(F.lit(" ["), parts, F.lit("]")))


def metrics_cell(complexity: Column, depth: Column, loc: Column) -> Column:
    """The table's cell; without a complexity it starts with a comma."""
    part = lambda head, c, tail="": F.coalesce(F.concat(F.lit(head), c, F.lit(tail)), F.lit(""))
    return F.concat(part("Cx=", complexity), part(",Depth=", depth), part(",Size=", loc, " LOC"))


def stored_range(line: Column, column: Column, snippet: Column | None = None) -> tuple[Column, Column, Column]:
    """Line, start and end column from 0, on one line; the width is the snippet's, or DEFAULT_WIDTH without one."""
    at = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(1)) - 1)
    width = F.lit(DEFAULT_WIDTH) if snippet is None else F.coalesce(F.length(snippet), F.lit(DEFAULT_WIDTH))
    return at(line), at(column), at(column) + F.greatest(F.lit(1), width)


def whole_line_range(line_text: Column) -> tuple[Column, Column]:
    """The whole line; zero width where there is none."""
    return F.lit(0), F.coalesce(F.length(line_text), F.lit(0))


def diagnostic_message(rule_id: Column, message: Column, suffix: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(rule_id, F.lit("undefined")), F.lit("] "), F.coalesce(message, F.lit("")), suffix)


def file_name(path: Column) -> Column:
    """Last segment of a path with either slash, or the whole path where that is empty."""
    return F.coalesce(F.nullif(F.element_at(F.split(path, r"[/\\]"), -1), F.lit("")), path)


def shorten(text: Column, n: int = 60) -> Column:
    """Of a longer text an ellipsis and the last n characters."""
    return F.when(F.length(text) > n, F.concat(F.lit("…"), F.right(text, F.lit(n)))).otherwise(text)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def rule_label(rule_name: Column, rule_id: Column) -> Column:
    return filled(rule_name, rule_id)


def function_label(name: Column, default: str = "<anonymous>") -> Column:
    return filled(name, default)


HARDCODED, POSSIBLE, WITHIN = " hardcoded in ", "Possible hardcoded secret", ' in "'


def finding_message(rule_name: Column, node_kind: Column, context: Column) -> Column:
    return F.concat(rule_name, F.lit(HARDCODED), node_kind, F.lit(WITHIN), context, F.lit('"'))


def heuristic_message(node_kind: Column) -> Column:
    return F.concat(F.lit(f"{POSSIBLE} in "), node_kind)


def rule_name_of(message: Column) -> Column:
    at = F.instr(message, F.lit(HARDCODED))
    return F.when(at > 1, F.substring(message, F.lit(1), at - 1)).when(F.startswith(message, F.lit(POSSIBLE)), F.lit("Secret"))


def node_kind_of(message: Column) -> Column:
    def cut(rest: Column) -> Column:
        end = F.instr(rest, F.lit(WITHIN))
        return F.when(end > 1, F.substring(rest, F.lit(1), end - 1)).otherwise(rest)

    at, head = F.instr(message, F.lit(HARDCODED)), f"{POSSIBLE} in "
    after = lambda n: F.substring(message, n, F.length(message))
    return F.when(at > 0, cut(after(at + len(HARDCODED)))).when(F.startswith(message, F.lit(head)), cut(after(F.lit(len(head) + 1))))


def context_of(message: Column) -> Column:
    """What stands in the last quotes; null where the quotes are one and the same."""
    pattern = '(?s)^.* in "(.*)"\\z'
    return F.when(F.rlike(message, F.lit(pattern)), F.regexp_extract(message, pattern, 1))


def hashes(texts: list[str]) -> list[str]:
    """One-at-a-time hash of 29 bits over UTF-16 code units, as eight hexadecimal digits.

    All texts advance together, one code unit a step; the longest come first, so that those at their end drop out.
    """
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2") for t in texts]
    sizes = np.array([len(u) for u in units], np.int64)
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    flat = np.concatenate(units).astype(np.int64) if len(units) else np.zeros(0, np.int64)
    alive = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), "left")
    # The masks and shifts of the hash.
    h = np.zeros(len(texts), np.int64)
    for step, n in enumerate(alive.tolist()):
        x = (h[:n] + flat[first[:n] + step]) & 0x1FFFFFFF
        x = (x + ((x & 0x7FFFF) << 10)) & 0x1FFFFFFF
        h[:n] = x ^ (x >> 6)
    h = (h + ((h & 0x3FFFFFF) << 3)) & 0x1FFFFFFF
    h ^= h >> 11
    out = np.empty(len(texts), np.int64)
    out[order] = (h + ((h & 0x3FFF) << 15)) & 0x1FFFFFFF
    return [f"{x:08x}" for x in out.tolist()]


def fingerprint(file: Column, line: Column, column: Column, rule_id: Column, snippet: Column) -> Column:
    """The hash of the parts joined by bars; null parts are left out. One Arrow pass: a chain of steps per character has no fast expression."""
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def hashed(text: pd.Series) -> pd.Series:
        return pd.Series(hashes(text.tolist()))

    return hashed(F.concat_ws("|", file, line.cast("string"), column.cast("string"), rule_id, snippet))


def level(value: Column, low: int, medium: int, names: tuple[str, str, str]) -> Column:
    return F.when(value <= low, F.lit(names[0])).when(value <= medium, F.lit(names[1])).when(value.isNotNull(), F.lit(names[2]))


def complexity_level(value: Column) -> Column:
    return level(value, 5, 10, ("low", "medium", "high"))


def nesting_level(value: Column) -> Column:
    return level(value, 1, 3, ("low", "medium", "high"))


def size_level(value: Column) -> Column:
    return level(value, 30, 80, ("small", "medium", "large"))


def bar_height(value: Column, most: Column, height: int) -> Column:
    """Height of a chart's bar, rounded half up."""
    return F.floor(F.lit(height) * (value / F.greatest(F.lit(1), most)) + 0.5).cast("int")
