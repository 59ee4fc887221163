"""Bursts and throttled polls of tables of any length, range by range.

A burst or a chain of polls may run on through many ranges of its order.  Each
range is read once and tells in a short summary how it begins and ends; the
summaries are joined up, and the ranges filled in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranges import in_ranges, ranges_of
from ..session import ship
from ..shared import keep

FIRST, LAST = 1, 2


def micros(spark: SparkSession, gap: str) -> int:
    return spark.sql(f"select unix_micros(timestamp_micros(0) + interval {gap})").first()[0]


def runs_of(column: pa.Array) -> list[int]:
    """Where runs of equal values begin, and the length."""
    values = column.to_pylist()
    return [*(i for i, v in enumerate(values) if not i or v != values[i - 1]), len(values)]


def bursts(rows: DataFrame, gap: str, parts: int | None = None) -> DataFrame:
    """Bursts of (workspace, ts, doc): first_ts, last_ts, the last row's doc and how many edits there are.

    Rows within the gap of the one before belong together.  Every range finds its own bursts; its first and last
    one are stitched to those of the ranges around it, of which the driver sees two rows a range.
    """
    spark, limit = rows.sparkSession, micros(rows.sparkSession, gap)
    ship(spark)
    n = ranges_of(rows, parts)
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType().add("workspace", kinds["workspace"]).add("first", "long").add("last", "long").add("doc", kinds["doc"]).add("edits", "long").add("_range", "integer").add("edge", "integer")
    sorted_ = in_ranges(rows.select("workspace", F.unix_micros("ts").alias("t"), "doc"), ["workspace", "t", "doc"], n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, edge, out, where = None, FIRST, [], 0

        def send():
            columns = list(zip(*out)) or [()] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

        target = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if target is None:
                s = batch.schema
                target = pa.schema([s.field("workspace"), pa.field("first", pa.int64()), pa.field("last", pa.int64()), s.field("doc"), pa.field("edits", pa.int64()), pa.field("_range", pa.int32()), pa.field("edge", pa.int32())])
            where = batch.column("_range")[0].as_py()
            t, docs, names = batch.column("t").to_numpy(), batch.column("doc"), batch.column("workspace")
            starts = runs_of(names)
            opens = np.zeros(len(t), bool)
            opens[starts[:-1]] = True
            opens[1:] |= np.diff(t) > limit
            if open_ and names[0].as_py() == open_[0] and t[0] - open_[2] <= limit:
                opens[0] = False
            cuts = np.flatnonzero(opens).tolist()
            head = cuts[0] if cuts else len(t)
            if head:
                open_ = [open_[0], open_[1], int(t[head - 1]), docs[head - 1].as_py(), open_[4] + head]
            for a, b in zip(cuts, [*cuts[1:], len(t)]):
                if open_:
                    out.append((*open_, where, edge))
                    edge = 0
                open_ = [names[a].as_py(), int(t[a]), int(t[b - 1]), docs[b - 1].as_py(), b - a]
            if len(out) >= 10_000:
                yield send()
        if open_:
            out.append((*open_, where, edge | LAST))
        if out:
            yield send()

    found = keep(sorted_.mapInArrow(run, schema), "bursts")
    edges, joined = found.where("edge > 0").collect(), []
    for e in sorted(edges, key=lambda e: (e["_range"], e["edge"])):
        before = joined[-1] if joined else None
        # the last burst of a range is the one before the first of the next; within a range they are apart already
        if before and before[5] != e["_range"] and before[0] == e["workspace"] and e["first"] - before[2] <= limit:
            joined[-1] = [before[0], before[1], e["last"], e["doc"], before[4] + e["edits"], e["_range"]]
        else:
            joined.append(list(e)[:6])
    whole = found.where("edge = 0").drop("edge").unionByName(spark.createDataFrame([tuple(j) for j in joined], T.StructType(schema.fields[:6])))
    return whole.select("workspace", F.timestamp_micros("first").alias("first_ts"), F.timestamp_micros("last").alias("last_ts"), "doc", "edits")


def steps_of(t: np.ndarray, age: int) -> tuple[np.ndarray, np.ndarray]:
    """What a range does to a timer, as a step function of the time from which a poll is let through.

    For a time up to until[k], and beyond until[k - 1], the last poll that goes through is at last[k].
    """
    follow = np.searchsorted(t, t + age)
    last = t.copy()
    for i in range(len(t) - 1, -1, -1):
        if follow[i] < len(t):
            last[i] = last[follow[i]]
    return merged(t, last)


def merged(until: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep_ = np.append(last[1:] != last[:-1], True)[: len(last)]
    return until[keep_], last[keep_]


def composed(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], age: int) -> tuple[np.ndarray, np.ndarray]:
    """The step function of one range followed by another."""
    (u1, l1), (u2, l2) = one, two
    at = np.searchsorted(u2, l1 + age)
    through = np.where(at < len(u2), np.append(l2, 0)[np.minimum(at, len(u2))], l1)
    later = u2 > (u1[-1] if len(u1) else np.iinfo(np.int64).min)
    return merged(np.concatenate([u1, u2[later]]), np.concatenate([through, l2[later]]))


def _packed(f: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    return [x.astype(np.int64).tobytes() for x in f]


def _columns(functions: list[list[bytes]]) -> list[pa.Array]:
    """until, last and head: where a timer that has not let a poll through yet is led."""
    head = [np.frombuffer(f[1], np.int64)[0] for f in functions]
    return [pa.array([f[0] for f in functions], pa.binary()), pa.array([f[1] for f in functions], pa.binary()), pa.array(head, pa.int64())]


def carried(pieces: DataFrame, age: int, count: int) -> DataFrame:
    """(key, d, last): the last poll let through before piece d of a key, for every piece but its first.

    pieces: key, d (consecutive within a key), until and last of its step function.  Functions are composed by
    doubling: after k rounds each is that of its own and the 2^k - 1 pieces before it.
    """
    now, step = pieces, 1
    schema = pieces.schema

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for u1, l1, u2, l2 in zip(*(b.column(c).to_pylist() for c in ("u1", "l1", "until", "last"))):
                f = [np.frombuffer(x, np.int64) for x in (u2, l2)]
                out.append(_packed(composed([np.frombuffer(x, np.int64) for x in (u1, l1)], f, age)) if u1 is not None else [u2, l2])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("d"), *_columns(out)], schema.names)

    while step < count:
        ahead = now.select(F.col("key").alias("_key"), (F.col("d") + step).alias("_d"), F.col("until").alias("u1"), F.col("last").alias("l1"))
        both = now.join(ahead, now["key"].eqNullSafe(ahead["_key"]) & (now["d"] == ahead["_d"]), "left").select("key", "d", "until", "last", "u1", "l1")
        now, step = keep(both.mapInArrow(compose, schema), "composed"), step * 2
    return now.select("key", (F.col("d") + 1).alias("d"), F.col("head").alias("_last"))


def throttled(polls: DataFrame, age: int, parts: int | None = None) -> DataFrame:
    """Which polls (key, t) go through: the first of a key, and each that comes `age` or more after the last that did; one of equal polls.

    A key's time line may cover many ranges.  Each tells what it does to the last poll let through before it; these
    functions are composed, and every range is filled in from what reaches it.  Any number of tasks shares a key.
    """
    spark = polls.sparkSession
    ship(spark)
    if age <= 0:
        return polls.select("key", "t", F.lit(True).alias("passed"))
    n = ranges_of(polls, parts)
    kept = keep(in_ranges(polls.select("key", "t"), ["key", "t"], n), "polls")
    dealt = kept.repartition(n, "_range").sortWithinPartitions("_range", "key", "t")
    entry = None
    if n > 1:
        ends = kept.groupBy("_range").agg(F.min(F.struct(F.col("key").isNotNull().alias("known"), "key")).alias("a"), F.max(F.struct(F.col("key").isNotNull().alias("known"), "key")).alias("b"))
        ends = ends.select("_range", F.col("a.key").alias("a"), F.col("b.key").alias("b")).orderBy("_range").collect()  # a row a range
        number = {r["_range"]: d for d, r in enumerate(ends)}
        open_ = [(r["_range"], number[r["_range"]], k) for r, before, after in zip(ends, [None, *ends], [*ends[1:], None]) for k in {r["a"], r["b"]} if before and before["b"] == k or after and after["a"] == k]
        if open_:
            entry = _entries(kept, open_, age, len(ends))
    if entry is None:
        rows = dealt.withColumn("_last", F.lit(None).cast("long"))
    else:
        joined = kept.join(F.broadcast(entry), kept["key"].eqNullSafe(entry["_key"]) & (kept["_range"] == entry["_r"]), "left").select("key", "t", "_range", "_last")
        rows = joined.repartition(n, "_range").sortWithinPartitions("_range", "key", "t")
    return rows.mapInArrow(_filler(age), T.StructType([polls.schema["key"], T.StructField("t", T.LongType())]).add("passed", "boolean"))


def _entries(kept: DataFrame, open_: list[tuple], age: int, count: int) -> DataFrame:
    """(_r, _key, _last) of the ranges that a key runs on into; open_ names the pieces (range, its number, key) of such keys."""
    spark, kind = kept.sparkSession, kept.schema["key"].dataType
    named = F.broadcast(spark.createDataFrame(open_, T.StructType().add("_r", "integer").add("d", "integer").add("_key", kind)))  # two rows a range at most
    inside = kept.join(named, kept["key"].eqNullSafe(named["_key"]) & (kept["_range"] == named["_r"])).select("key", "d", "t")
    dealt = inside.repartition(max(1, len(open_)), "d", "key").sortWithinPartitions("d", "key", "t")
    schema = T.StructType().add("key", kind).add("d", "integer").add("until", "binary").add("last", "binary").add("head", "long")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, times, field = None, [], None

        def send():
            f = _packed(steps_of(np.unique(np.concatenate(times)), age))
            return pa.RecordBatch.from_arrays([pa.array([now[1]], field), pa.array([now[0]], pa.int32()), *_columns([f])], schema.names)

        for b in batches:
            field = b.schema.field("key").type
            names, t = list(zip(b.column("d").to_pylist(), b.column("key").to_pylist())), b.column("t").to_numpy()
            cuts = [*(i for i, v in enumerate(names) if not i or v != names[i - 1]), len(names)]
            for a, z in zip(cuts, cuts[1:]):
                if now is not None and names[a] != now:
                    yield send()
                    times = []
                now = names[a]
                times.append(np.unique(t[a:z]))
        if times:
            yield send()

    pieces = keep(dealt.mapInArrow(summarise, schema), "steps")
    reached = carried(pieces, age, count)
    ranges = F.broadcast(spark.createDataFrame([(r, d) for r, d, _ in open_], "_r int, d int").distinct())
    return keep(reached.join(ranges, "d").select("_r", F.col("key").alias("_key"), "_last"), "entries")


def _filler(age: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            names = list(zip(batch.column("_range").to_pylist(), batch.column("key").to_pylist()))
            t, passed, entry = batch.column("t").to_numpy(), np.zeros(batch.num_rows, bool), batch.column("_last")
            cuts = [*(i for i, v in enumerate(names) if not i or v != names[i - 1]), len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if now != names[a]:
                    now, last = names[a], entry[a].as_py()
                at = a if last is None else a + int(np.searchsorted(t[a:b], last + age))
                while at < b:
                    passed[at], last = True, int(t[at])
                    at = max(at + 1, a + int(np.searchsorted(t[a:b], last + age)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("t"), pa.array(passed)], ["key", "t", "passed"])

    return run
