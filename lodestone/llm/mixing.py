"""Mixing sources to target weights, with DataFrame operations only.

Token totals are aggregated per source (partial sums, so one source may hold
any share of the rows), target shares become repetition rates, and each
document is emitted floor(rate) times plus one more copy by a Bernoulli draw
seeded by a hash of its id, with the rate's fraction as probability.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import by_keys
from .text import WORD

HASH_DIGITS = 13


def n_words(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target tokens of each source.

    sizes: (source, source_size), one row a source.  Sources in code point order, null last, get the weights
    in turn and share `share` times all tokens.  No target exceeds `most` times its source's size; what is cut
    goes to the others by weight, until none exceeds (solved in closed form: sources in the order in which a
    growing common level reaches their caps).  Rows here are sources, not documents; they are ordered in one task,
    40 bytes each, which fits for some 10**7 sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    caps = sizes.select("source", "source_size", w.cast("long").alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    level = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    steps = caps.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cut"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("gone"),
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("all_tokens"),
        F.sum("w").over(everything).alias("all_w"),
    ).select("*", ((F.col("all_tokens") - F.col("cut")) / (F.col("all_w") - F.col("gone"))).alias("lam"))
    free = F.max("lam").over(everything)  # the level falls again once a source is cut that need not be
    return steps.select("source", "source_size", F.least(F.col("cap"), free * F.col("w")).alias("target"))


def draw(doc_id: str, seed: int) -> Column:
    """A number in [0, 1) from an id and a seed; a null id counts as empty."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("double") / F.lit(float(16**HASH_DIGITS))


def rates(sized: DataFrame, scratch, **options) -> DataFrame:
    """The kept table of sources: _source, source_size, target."""
    per = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **options)
    return scratch.keep(per.select(F.col("source").alias("_source"), "source_size", "target"), "rates")


def copies(sized: DataFrame, per: DataFrame, doc_id: str = "doc_id", seed: int = 17) -> DataFrame:
    """sized (doc_id, source, size) with source_size, target and copies, by a kept table of `rates`.

    The sources join by null-safe equality: broadcast where their counted rows are few, so that no document moves;
    else Spark splits the hot ones.  A source without tokens has target 0 and no copies.  Rows that share an id
    share the draw.  Nulls in source are a source of their own.
    """
    joined = by_keys(sized, per, sized["source"].eqNullSafe(per["_source"]), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (draw(doc_id, seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("copies", F.floor(rate) + extra)


def mix(docs: DataFrame, scratch, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 17, **options) -> DataFrame:
    """The documents of the mix: every input column, a row for each copy that the mix takes.

    A null or empty text has size 0: it takes part in the draw of its source but adds no words.  A null source is
    a source, a null id draws as an empty one, rows that repeat draw alike; long texts stay whole; an empty table
    gives no rows; columns may have any names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    sized = docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("source"), n_words(text).alias("size"), row)
    taken = copies(sized, rates(sized, scratch, **options), "_id", seed).where("copies > 0")
    taken = taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return taken.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def digest(docs: DataFrame, scratch, **options) -> DataFrame:
    """The mix as numbers: doc_id, size, source_size, target, taken (size times copies).

    A null or empty text has size 0; a long text counts whole, as one string of the JVM; an empty table gives no rows;
    extra columns of docs are ignored.  The sizes are kept once, so texts are read a single time.
    """
    sized = scratch.keep(docs.select("doc_id", "source", n_words("text").alias("size")), "sizes")
    out = copies(sized, rates(sized, scratch, **options))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def sql(seed: int = 17) -> str:
    """The digest with the default options, in DuckDB's SQL."""
    return rf"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
per as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (select *, [5, 2, 1][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int]::bigint as w, source_size * 2.0::double as cap from per),
steps as (select *, coalesce(sum(cap) over (order by cap / w, source asc nulls last rows between unbounded preceding and 1 preceding), 0.0::double) as cut,
  coalesce(sum(w) over (order by cap / w, source asc nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as gone,
  (sum(source_size) over ())::double * 1.5::double as all_tokens, (sum(w) over ())::bigint as all_w from weighed),
lams as (select *, (all_tokens - cut) / (all_w - gone)::double as lam from steps),
free as (select max(lam) as lam from lams),
t as (select source, source_size, least(cap, (select lam from free) * w) as target from lams),
rates as (select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size::double else 0.0::double end as rate
  from sized d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, size * (floor(rate)::bigint + case when ('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double / {16**HASH_DIGITS}.0::double < rate - floor(rate) then 1 else 0 end) as taken from rates"""
