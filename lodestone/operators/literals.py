"""String literals and their entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import lines

#: A literal is what stands in quotes on one line, with the name assigned to it as its context (our own reconstruction).
LITERAL = r"""(?:([A-Za-z_][A-Za-z0-9_]*)\s*[:=]\s*)?(?:"([^"\n]*)"|'([^'\n]*)')"""


def literals(sources: DataFrame, text: str = "content") -> DataFrame:
    """A row for each literal: line, column, lit_no in the line, context, value."""
    rows = lines(sources, text).where(F.rlike("line_text", F.lit("[\"']")))
    keys = [c for c in rows.columns if c != "line_text"]
    # a match begins where its text first stands after the match before it
    starts = "aggregate(_all, struct(1 as next, array() as at), (s, m) -> struct(locate(m, line_text, s.next) + length(m) as next, concat(s.at, array(locate(m, line_text, s.next))) as at), s -> s.at)"
    starts = starts.replace("array() as at", "cast(array() as array<int>) as at")
    rows = rows.withColumn("_all", F.regexp_extract_all("line_text", F.lit(LITERAL), F.lit(0)))
    found = rows.select(*keys, "_all", F.expr(starts).alias("_at")).select(*keys, F.posexplode(F.arrays_zip("_all", "_at")).alias("lit_no", "_z")).select(*keys, "lit_no", F.col("_z._all").alias("_m"), F.col("_z._at").alias("column"))
    value = F.concat(F.regexp_extract("_m", LITERAL, 2), F.regexp_extract("_m", LITERAL, 3))
    return found.select(*keys, "column", "lit_no", F.regexp_extract("_m", LITERAL, 1).alias("context"), value.alias("value"))


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits; 0 for an empty text."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    term = lambda s, c: s - share(c) * F.log2(share(c))
    chars = F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    return F.when(n > 0, F.aggregate(chars, F.lit(0.0), term)).otherwise(F.lit(0.0))
