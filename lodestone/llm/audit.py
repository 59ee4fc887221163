"""Interaction audit of quality filters: what each removes, repeats or saves under every order of application.

A document that fails several filters is removed by the first of them, so what
a filter does depends on the order.  The documents that pass a set of filters
are the same in whatever order it is applied, so the survivors of all 32 sets
tell everything: they are the rows of an SQL CUBE over the five failure flags
and the part whose grouped flags are all false.  A step of an order is a pair of
sets that differ by one filter, and all orders are read off those pairs.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch, by_keys
from .text import WORD

FILTERS = "ABCDE"
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
FULL = (1 << len(FILTERS)) - 1
WORDS, DISTINCT, CAPITALS, SYMBOLS = 200, 50, 3, "[#$%&*|]"
COUNTS = ["n", "good", "toxic"]


def failures(text: Column) -> dict[str, Column]:
    """Whether a text (never null) fails the filters that look at it alone.

    A: fewer than WORDS words.  B: fewer than DISTINCT per cent of the words are distinct.  C: more than CAPITALS per
    cent of the code points are of A to Z.  D: it holds any of the SYMBOLS.  Whole texts count; an empty one fails A only.
    """
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < WORDS, "B": 100 * F.size(F.array_distinct(words)) < DISTINCT * F.size(words),
        "C": 100 * capitals > CAPITALS * F.length(text), "D": F.rlike(text, F.lit(SYMBOLS)),
    }


def classes(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Numbers of documents (n) by part, the five failure flags, good and toxic.

    E holds where a row with a smaller id has the very same text, equal by its SHA-256.  Rows meet by their text's
    digest in narrow form and are counted before every exchange, so a text that a third of all rows share makes a few
    rows a task.  Null texts are empty ones, a null part is an empty string; rows with a null id have no label, are
    never smaller and never repeat; rows that repeat count each.  Labels of one id that disagree: any 1 counts.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole.alias("_whole"))
    flags = failures(F.col("_whole"))
    rows = rows.select("_id", "part", *[c.alias(k) for k, c in flags.items()], F.unhex(F.sha2("_whole", 256)).alias("_text"))
    marked = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("_id is not null and (good or toxic)")
    # rows without an id are dealt out by their text, as they would all meet otherwise
    spread = rows.withColumn("_salt", F.when(F.col("_id").isNull(), F.xxhash64("_text").bitwiseOR(F.lit(1).cast("long"))).otherwise(F.lit(0))).withColumn("_key", F.coalesce("_id", F.lit(0)))
    known = by_keys(spread, marked.select(F.col("_id").alias("_key"), F.lit(0).cast("long").alias("_salt"), "good", "toxic"), ["_key", "_salt"], "left").drop("_key", "_salt")
    known = known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kind = ["_text", "part", *flags, "good", "toxic"]
    by_id = known.groupBy(*kind, "_id").agg(F.count("*").alias("n"))
    by_text = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.min("_id").alias("least"), F.min_by("n", "_id").alias("at_least"), F.sum(F.when(F.col("_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    first = F.when(F.col("least") == F.min("least").over(Window.partitionBy("_text")), F.col("at_least")).otherwise(0) + F.col("nameless")
    told = by_text.withColumn("first", first)
    both = F.array(F.struct(F.lit(False).alias("E"), F.col("first").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("first")).alias("n")))
    split = told.select("part", *flags, "good", "toxic", F.inline(both)).where("n > 0")
    return split.groupBy("part", *FILTERS, "good", "toxic").agg(F.sum("n").alias("n"))


def survivors(counted: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of each part pass every filter of each of the 32 sets, zeros included."""
    weight = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    cube = counted.cube("part", *FILTERS).agg(F.sum("n").alias("_n"), weight("good").alias("_good"), weight("toxic").alias("_toxic"), F.grouping("part").alias("_all"), *[F.grouping(f).alias(f"_{f}") for f in FILTERS])
    passes = F.lit(True)
    for f in FILTERS:
        passes &= (F.col(f"_{f}") == 1) | ~F.col(f)
    mask = sum((F.when(F.col(f"_{f}") == 0, b).otherwise(0) for f, b in BIT.items()), F.lit(0))
    found = cube.where(F.col("_all") == 0).where(passes).select("part", mask.alias("mask"), F.col("_n").alias("n"), F.col("_good").alias("good"), F.col("_toxic").alias("toxic"))
    grid = counted.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(FULL))).alias("mask"))
    return grid.join(found, ["part", "mask"], "left").select("part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])


def steps(passed: DataFrame) -> DataFrame:
    """One row for each part, set and filter outside of it: what the filter removes where the set was applied before."""
    letter = F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(b).alias("bit")) for f, b in BIT.items()]))
    before = passed.select("part", F.col("mask").alias("before"), *COUNTS, letter.alias("_f")).select("part", "before", *COUNTS, "_f.*").where(F.col("before").bitwiseAND(F.col("bit")) == 0)
    after = passed.select("part", F.col("mask").alias("_mask"), *[F.col(c).alias(f"_{c}") for c in COUNTS])
    pairs = before.withColumn("_mask", F.col("before").bitwiseOR(F.col("bit"))).join(after, ["part", "_mask"])
    lost = pairs.select("part", "filter", "before", "bit", F.col("_n").alias("kept"), (F.col("n") - F.col("_n")).alias("removed"), (F.col("good") - F.col("_good")).alias("good_lost"), (F.col("toxic") - F.col("_toxic")).alias("toxic_lost"))
    of = Window.partitionBy("part", "filter")
    where = lambda mask: F.max(F.when(F.col("before") == mask, F.col("removed"))).over(of)
    last = len(FILTERS) - 1
    orders = F.lit(0)  # in how many orders exactly this set stands before the filter
    for size in range(last + 1):
        orders = F.when(F.bit_count("before") == size, factorial(size) * factorial(last - size)).otherwise(orders)
    return lost.select(
        "part", "filter", "before", "kept", "removed", (where(0) - F.col("removed")).alias("redundant"), where(F.lit(FULL) - F.col("bit")).alias("unique_fails"), "good_lost", "toxic_lost",
        F.sum(F.col("removed") * orders).over(of).alias("shapley"),
    )


def digest(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each part, order of the five filters and step, with counts within the part.

    kept after the step, removed by it, redundant (failing its filter, removed earlier), unique_fails (failing its
    filter only), good_lost and toxic_lost (removed here), shapley (its filter's removed over all orders).  An empty
    table has no parts and gives no rows; texts are read whole, a few times their size in memory; further columns are
    ignored.
    """
    plan = [("".join(order), k + 1, f, sum(BIT[g] for g in order[:k])) for order in permutations(FILTERS) for k, f in enumerate(order)]
    orders = docs.sparkSession.createDataFrame(plan, "filter_order string, step int, filter string, before int")  # 600 rows
    # few rows, so no more files than the cluster has cores: where Hadoop's native library is missing, each file costs processes that count like their executor
    cores = docs.sparkSession.sparkContext.defaultParallelism
    counted = scratch.keep(classes(docs, labels).coalesce(cores), "classes")  # 128 rows a part at most; texts are read once
    found = steps(survivors(counted)).join(F.broadcast(orders), ["filter", "before"])
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").coalesce(cores)


def sql() -> str:
    """The same by going through every document at every step of every order."""
    flags = f"""d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
    w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws, min(doc_id) over (partition by t) as least from d),
    f as (select doc_id, part, len(ws) < {WORDS} as A, 100 * len(list_distinct(ws)) < {DISTINCT} * len(ws) as B,
     100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITALS} * length(t) as C, regexp_matches(t, '{SYMBOLS}') as D, coalesce(least < doc_id, false) as E from w),
    l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
    g as (select part, A::int + 2 * B::int + 4 * C::int + 8 * D::int + 16 * E::int as fails, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from f left join l using (doc_id))"""
    return f"""with recursive {flags},
    o as (select '' as filter_order, 0 as step, 0 as before, 0 as bit union all
     select o.filter_order || x.f, o.step + 1, o.before | o.bit, x.b from o, (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(f, b) where not contains(o.filter_order, x.f)),
    whole as (select filter_order from o where step = 5),
    s as (select w.filter_order, o.step, o.before, o.bit from whole w join o on starts_with(w.filter_order, o.filter_order) and o.step > 0),
    r as (select part, filter_order, step, bit, count(*) filter (where fails & (before | bit) = 0) as kept, count(*) filter (where fails & before = 0 and fails & bit > 0) as removed,
     count(*) filter (where fails & before > 0 and fails & bit > 0) as redundant, count(*) filter (where fails = bit) as unique_fails,
     count(*) filter (where fails & before = 0 and fails & bit > 0 and good = 1) as good_lost, count(*) filter (where fails & before = 0 and fails & bit > 0 and toxic = 1) as toxic_lost
     from g, s group by all)
    select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from r"""
