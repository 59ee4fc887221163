"""Many patterns over many values: an index of the texts that a match must hold.

A pattern is read for literal texts of which every match holds at least one.
All tasks get these texts, and look up every place of a value in them, in place
of trying each pattern on each value: `functions.search`.  The pattern itself has
the last word.  Patterns without such a text are tried one by one.  Rules stay a
table, and those that share a pattern meet the values that it matches by its
number.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ranges
from ..functions.patterns import at_the_end, lean, required
from ..functions.search import Search, Texts
from ..session import ship
from ..shared import by_few, keep
from ..sources.rules import in_use

TOGETHER, UNROLLED = 200, 64
#: Bytes of values that are searched at once, and patterns that go back to Spark in one batch; a value is never split.
SEARCHED, SENT = 1 << 20, 1 << 17
#: Bytes of the patterns that go to all tasks at once, of which each counts ENTRY beside itself and its texts, and patterns without a text that are one pass over the values.
WAVE, ENTRY, TRIED = 1 << 26, 40, 20_000
HIT = ["rule_id", "rule_name", "severity", "rank"]
HIT_TYPE = "struct<rule_id:string,rule_name:string,severity:string,rank:bigint>"
PATTERN = T.StructType([T.StructField("no", T.LongType()), T.StructField("pattern", T.StringType())])


def any_of(patterns: list[str]) -> Column:
    """Whether a value matches one of the patterns: those that can share an expression are tried TOGETHER at a time."""
    alone = [p for p in patterns if re.search(r"\\[1-9k]|\(\?<[A-Za-z]|\\Q", p)]
    rest = [p for p in patterns if p not in set(alone)]
    whole = [*alone, *("|".join(f"(?:{p})" for p in rest[i : i + TOGETHER]) for i in range(0, len(rest), TOGETHER))]
    return F.exists(F.array(*[F.rlike("value", F.lit(p)) for p in whole]), lambda x: x)


def _hit(r: dict) -> Column:
    return F.struct(*[F.lit(r[c]).cast("long" if c == "rank" else "string").alias(c) for c in HIT])


def unrolled(rules: list[dict]) -> Column:
    """The hits of few rules, in their order: patterns are constants of the plan, compiled once."""
    return F.array_compact(F.array(*[F.when(F.rlike("value", F.lit(r["pattern"])), _hit(r)) for r in rules]))


def _tried(patterns: list[tuple[int, str]]) -> Column:
    """The numbers of the patterns that match, of those without a required text: many are tried one by one on values that any of them matches."""
    if len(patterns) <= UNROLLED:
        return F.array_compact(F.array(*[F.when(F.rlike("value", F.lit(p)), F.lit(k).cast("long")) for k, p in patterns]))
    # one constant of the plan, however many patterns
    each = F.from_json(F.lit(json.dumps([{"no": k, "pattern": p} for k, p in patterns])), f"array<{PATTERN.simpleString()}>")
    return F.when(any_of([p for _, p in patterns]), _matching(each))


def _matching(patterns: Column) -> Column:
    """Of an array of patterns the numbers of those that match the value."""
    return F.transform(F.filter(patterns, lambda x: F.rlike(F.col("value"), x["pattern"])), lambda x: x["no"])


@dataclass
class Wave:
    """Patterns that go to all tasks: the texts that they require, their numbers and themselves."""

    texts: Texts
    no: pa.Array
    pattern: pa.Array

    @classmethod
    def of(cls, rows: pa.Table) -> Wave:
        rows = rows.combine_chunks()
        texts = rows.column("texts").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.string()))
        owner = np.repeat(np.arange(len(texts)), np.diff(texts.offsets.to_numpy()))
        one = lambda c: rows.column(c).combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(c).type)
        return cls(Texts.of(texts.flatten(), owner), one("no"), one("pattern"))


def _cuts(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of entries that hold `most` at most together, or are one entry."""
    total, out, at = np.cumsum(sizes), [], 0
    while at < len(sizes):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + most, "right")))
        out.append((at, to))
        at = to
    return out


def _candidates(found: DataFrame, wave: Wave) -> DataFrame:
    """found with an array _may of the patterns one of whose texts stands in the value."""
    sent = found.sparkSession.sparkContext.broadcast(wave)
    at = found.columns.index("value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Wave = sent.value
        search, names = Search(w.texts), None
        for batch in batches:
            names = names or [*batch.schema.names, "_may"]
            for a, b in _cuts(pc.binary_length(batch.column(at)).fill_null(0).to_numpy(), SEARCHED):
                part = batch.slice(a, b - a)
                value, owner = search.pairs(part.column(at))
                counts = np.bincount(value, minlength=b - a)
                bounds = np.append(0, np.cumsum(counts))
                for c, d in _cuts(counts, SENT):
                    own = pa.array(owner[bounds[c] : bounds[d]])
                    may = pa.StructArray.from_arrays([w.no.take(own), w.pattern.take(own)], ["no", "pattern"])
                    lists = pa.ListArray.from_arrays(pa.array(bounds[c : d + 1] - bounds[c], pa.int32()), may)
                    yield pa.RecordBatch.from_arrays([*part.slice(c, d - c).columns, lists], names)

    return found.mapInArrow(run, T.StructType([*found.schema.fields, T.StructField("_may", T.ArrayType(PATTERN))]))


def matched(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """found with an array _matched of the numbers of the patterns that match its value, in no order; empty without any.

    patterns: no, pattern and texts, of which every match holds one; null where none are known.  A null value matches nothing.
    Patterns go over the values in waves, so none are too many; between two waves the values are written.
    """
    ship(found.sparkSession)
    indexed, none = F.col("texts").isNotNull(), F.array().cast("array<bigint>")
    size = F.octet_length("pattern") + F.octet_length(F.array_join("texts", "")) + ENTRY
    held, alone = patterns.agg(F.sum(F.when(indexed, size)), F.count_if(~indexed)).first()
    waves, tries = math.ceil((held or 0) / WAVE), math.ceil(alone / TRIED)
    out = found.withColumn("_matched", none)
    for k in range(max(waves, tries)):
        part = lambda c, n: patterns.where(c & (F.pmod(F.xxhash64("no"), F.lit(n)) == k))  # noqa: B023, E731
        more = []
        if k:
            out = keep(out, "matched")
        if k < tries and (rest := [(r["no"], r["pattern"]) for r in part(~indexed, tries).select("no", "pattern").collect()]):
            more.append(_tried(rest))
        if k < waves:
            out = _candidates(out, Wave.of(part(indexed, waves).select("no", "pattern", "texts").toArrow()))
            more.append(_matching(F.col("_may")))
        out = out.withColumn("_matched", F.concat("_matched", *[F.coalesce(m, none) for m in more])).drop("_may")
    return out


def read_patterns(raw: DataFrame) -> DataFrame:
    """raw, no, pattern, texts: patterns (a column of them) that compile, numbered, as they are tried and with the texts that they require."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(0).to_pylist()
            whole = [at_the_end(p) for p in given]
            texts = [sorted(t) if t else None for t in map(required, whole)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in (given, whole, [lean(p) for p in whole])), pa.array(texts, pa.list_(pa.string()))], ["raw", "whole", "pattern", "texts"])

    ship(raw.sparkSession)
    read = raw.mapInArrow(run, "raw string, whole string, pattern string, texts array<string>")
    sound = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("whole")).isNotNull()
    return keep(read.where(sound).select("raw", F.monotonically_increasing_id().alias("no"), "pattern", "texts"), "patterns")


def told(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rules in use whose patterns compile (_no of the pattern and the struct _hit), and the patterns (no, pattern, texts)."""
    by = [c for c in ("priority", "ord") if c in rules.columns]
    text = lambda c, other: F.when(F.col(c) != "", F.col(c)).otherwise(other)
    used = in_use(rules).select(F.col("id").alias("rule_id"), text("name", F.col("id")).alias("rule_name"), text("severity", F.lit("warning")).alias("severity"), F.coalesce("pattern", F.lit("")).alias("raw"), *by)
    used = keep(used.withColumn("_at", F.monotonically_increasing_id()), "rules")
    patterns = read_patterns(used.select("raw").distinct())
    ranked = ranges.ordinal(used, [*by, "_at"], name="rank")
    hits = by_few(ranked, patterns.select("raw", F.col("no").alias("_no")), "raw", "inner").select("_no", F.struct(*HIT).alias("_hit"))
    return keep(hits, "rule-hits"), patterns.drop("raw")


def met(found: DataFrame, rules: DataFrame, outer: bool = True) -> DataFrame:
    """found with a struct _hit for each rule in use that matches its value; outer: one row with a null _hit where none does."""
    hits, patterns = told(rules)
    out = matched(found, patterns).withColumn("_no", F.explode_outer("_matched") if outer else F.explode("_matched")).drop("_matched")
    if outer:  # rows that match nothing are no common key
        out = out.withColumn("_no", F.coalesce("_no", -1 - F.monotonically_increasing_id()))
    return by_few(out, hits, "_no", "left" if outer else "inner").select(*found.columns, "_hit")


def hits(found: DataFrame, rules: list[dict], unroll: int) -> DataFrame:
    """found with an array _hits of the rules that match its value, in the order of the rules; null or empty without any.

    rules: rule_id, rule_name, severity, rank and a valid pattern each.  A null value matches nothing.
    """
    if len(rules) <= unroll:
        return found.withColumn("_hits", unrolled(rules))
    rows = [(k, lean(r["pattern"]), sorted(t) if (t := required(r["pattern"])) else None) for k, r in enumerate(rules)]
    patterns = found.sparkSession.createDataFrame(rows, "no long, pattern string, texts array<string>")
    each = F.from_json(F.lit(json.dumps([{c: r[c] for c in HIT} for r in rules])), f"array<{HIT_TYPE}>")
    of_value = F.transform("_matched", lambda k: F.get(each, k.cast("int")))
    return matched(found, patterns).withColumn("_hits", F.array_sort(of_value, lambda a, b: (a["rank"] - b["rank"]).cast("int"))).drop("_matched")
