"""Exact top-k search by histogram selection.

Vectors are turned into integers, so that scores are exact.  Every query is
scored against every row, several times over: each round counts the scores of a
query in equal bins of its present range, adds up the counts of all tasks, finds
the bin that holds the k-th greatest score and makes it the next range, until
few rows reach that bin or it is one score wide.  A last pass keeps the rows
that reach it, and ties at the k-th score go to the smaller ids.  Queries go to
the tasks in waves of bounded size, so the table is read in place and never
copied or shuffled for them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .neighbours import dimension
from .packed import steady
from .store import Scratch

K, EVERY, SCALE = 10, 100, 1024
BINS, KEEP = 256, 64
#: Components of the queries of a wave at most, of 8 bytes each, and rows and queries that are scored at once.
WAVE, ROWS, QUERIES = 1 << 20, 2048, 256
EXACT = 1 << 53
LARGEST = 1 << 62
NONE = np.iinfo(np.int64).min


def quantised(column: pa.Array, dim: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the rows that take part and floor(scale * x) of their components, cut to 62 bits."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.flatnonzero(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False) == dim)
    if not len(rows) or not dim:
        return np.zeros(0, np.int64), np.zeros((0, dim), np.int64)
    flat = column.take(pa.array(rows)).flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls become NaN
    ok = np.isfinite(x).all(1)
    with np.errstate(over="ignore"):
        return rows[ok], np.clip(np.floor(x[ok] * scale), -LARGEST, LARGEST).astype(np.int64)


@dataclass
class Wave:
    """Some queries: id, vector, lower end and width of the bins, and how many rows are still looked for in them."""

    ids: np.ndarray
    x: np.ndarray
    low: np.ndarray
    width: np.ndarray
    want: np.ndarray

    def open(self, still: np.ndarray) -> Wave:
        return Wave(self.ids[still], self.x[still], self.low[still], self.width[still], self.want[still])


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of queries (rows of the result) and rows: in double precision where that is exact, else in whole numbers cut to 62 bits."""
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1]
    if reach < EXACT:
        return q.astype(np.float64) @ x.astype(np.float64).T
    product = q.astype(object) @ x.astype(object).T
    return np.clip(product, 1 - LARGEST, LARGEST - 1).astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], wave: Wave, dim: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First query, ids and scores (queries, rows) of ROWS rows and QUERIES queries at a time; a query's own rows have the least score."""
    for batch in batches:
        for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
            ids = part.column("vec_id").to_numpy()
            x = np.frombuffer(b"".join(part.column("code").to_pylist()), np.int64).reshape(len(ids), dim)
            for a in range(0, len(wave.ids), QUERIES):
                s = scores(x, wave.x[a : a + QUERIES])
                own = np.flatnonzero(np.isin(wave.ids[a : a + QUERIES], ids))
                for j in own.tolist():
                    s[j, ids == wave.ids[a + j]] = NONE
                yield a, ids, s


def histogram(kept: DataFrame, wave, dim: int) -> DataFrame:
    """query, bin, n: counts of the scores by bin, from the top down to the bin in which a task alone has all that is looked for.

    The bin of the k-th score over all tasks is never below that of any one task, so what lies further down can't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Wave = wave.value
        count = np.zeros((len(w.ids), BINS), np.int64)
        floor = w.low.copy()
        for a, _, s in blocks(batches, w, dim):
            b = slice(a, a + len(s))
            q, r = np.nonzero(s >= floor[b, None])
            bins = (s[q, r].astype(np.int64) - w.low[b][q]) // w.width[b][q]
            inside = bins < BINS  # what lies above was counted in an earlier round
            count[b] += np.bincount(q[inside] * BINS + bins[inside], minlength=len(s) * BINS).reshape(-1, BINS)
            enough = np.cumsum(count[b, ::-1], 1) >= w.want[b, None]
            top = np.where(enough.any(1), BINS - 1 - enough.argmax(1), 0)
            floor[b] = w.low[b] + top * w.width[b]
        q, bins = np.nonzero(count)
        seen = bins >= ((floor - w.low) // w.width)[q]
        q, bins = q[seen], bins[seen]
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(bins, pa.int32()), pa.array(count[q, bins])], ["query", "bin", "n"])

    return kept.select("vec_id", "code").mapInArrow(steady(run), "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))


def located(counts: DataFrame, want: DataFrame) -> DataFrame:
    """query, bin, above, n: the bin that holds the score looked for, how many are above it and in it."""
    above = F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("bin"))) - F.col("n")
    return counts.join(F.broadcast(want), "query").withColumn("above", above).where("above < want and above + n >= want").select("query", "bin", "above", "n")


def narrowed(kept: DataFrame, wave: Wave, dim: int) -> Wave:
    """The wave with the k-th scores located: each query's low end is so that few rows, or only ties, reach it."""
    spark = kept.sparkSession
    still = np.arange(len(wave.ids))
    while len(still):
        open_ = wave.open(still)
        sent = spark.sparkContext.broadcast(open_)
        want = spark.createDataFrame(pa.table({"query": pa.array(np.arange(len(still)), pa.int32()), "want": pa.array(open_.want)}))
        t = located(histogram(kept, sent, dim), want).toArrow()  # a row a query of the wave at most
        sent.destroy()
        q, bins, above, n = (t.column(c).to_numpy() for c in ("query", "bin", "above", "n"))
        at = still[q]
        wave.low[at] += bins * wave.width[at]
        last = (wave.width[at] == 1) | (n <= KEEP)
        wave.want[at] -= above
        wave.width[at] = np.maximum(1, -(-wave.width[at] // BINS))
        still = at[~last]  # queries without a bin have fewer rows than they look for: all of them are kept
    return wave


def selected(kept: DataFrame, wave, dim: int, k: int) -> DataFrame:
    """query, query_id, vec_id, score of the rows that reach their query's low end, a task's k best at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Wave = wave.value
        held, n = [], 0

        def best():
            q, ids, s = (np.concatenate([h[c] for h in held]) for c in range(3))
            order = np.lexsort((ids, -s, q))
            q, ids, s = q[order], ids[order], s[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            return q[rank < k], ids[rank < k], s[rank < k]

        limit = max(1 << 18, 4 * k * len(w.ids))
        for a, ids, s in blocks(batches, w, dim):
            q, r = np.nonzero((s >= w.low[a : a + len(s), None]) & (s > NONE))
            held.append((q + a, ids[r], s[q, r].astype(np.int64)))
            n += len(q)
            if n > limit:
                held = [best()]
                n = len(held[0][0])
        if n:
            q, ids, s = best()
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(w.ids[q]), pa.array(ids), pa.array(s)], ["query", "query_id", "vec_id", "score"])

    return kept.select("vec_id", "code").mapInArrow(steady(run), "query int, query_id long, vec_id long, score long")


def search(rows: DataFrame, scratch: Scratch, k: int = K, every: int = EVERY, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding", wave_size: int = WAVE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k rows of greatest integer inner product.

    All rows but those of the query's own id are candidates; with fewer than k, all of them are given; ties go to the
    smaller id.  Vectors that are null, of an unusual dimension or hold null or non-finite components take no part,
    nor do rows without an id; zero vectors do.  Rows that repeat id and vector count once; an id with several vectors
    asks once for each of them and each is a candidate.  Components and scores beyond 62 bits are cut.  An
    empty table gives no rows; further columns are ignored.  A wave holds wave_size / dimension queries at most.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("embedding")).where("vec_id is not null")
    dim = dimension(rows, "embedding")
    result = "query_id long, rank int, vec_id long, score long"
    if not dim:
        return spark.createDataFrame([], result)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                keep, x = quantised(part.column("embedding"), dim, scale)
                size = np.sqrt((x.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9) + 1
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(pa.array(keep)), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(size)], ["vec_id", "code", "size"])

    kept = scratch.keep(rows.mapInArrow(steady(code), "vec_id long, code binary, size double").dropDuplicates(["vec_id", "code"]), "coded")
    asks = scratch.keep(kept.where(F.col("vec_id") % every == 0), "queries")
    number, longest = asks.count(), kept.agg(F.max("size")).first()[0]
    if not number:
        return spark.createDataFrame([], result)
    waves = max(1, math.ceil(1.25 * number * dim / wave_size)) if number * dim > wave_size else 1
    for n in range(waves):
        t = asks.where(F.pmod(F.xxhash64("vec_id", "code"), F.lit(waves)) == n).toArrow()  # of wave_size components at most, but for chance
        ids = t.column("vec_id").to_numpy()
        x = np.frombuffer(b"".join(t.column("code").to_pylist()), np.int64).reshape(len(ids), dim)
        reach = np.minimum(t.column("size").to_numpy() * longest, float(LARGEST)).astype(np.int64)
        wave = narrowed(kept, Wave(ids, x, -reach, reach // (BINS // 2) + 1, np.full(len(ids), k, np.int64)), dim)
        sent = spark.sparkContext.broadcast(wave)
        best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        found = selected(kept, sent, dim, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        scratch.keep(found.select("query_id", "rank", "vec_id", "score"), f"found/wave={n}")
        sent.destroy()
    return spark.read.schema(result).parquet(*[scratch.path(f"found/wave={n}") for n in range(waves)])


def sql(k: int = K, every: int = EVERY, scale: int = SCALE) -> str:
    return f"""with v as (select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as c from embeddings
     where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    p as (select q.vec_id as query_id, x.vec_id, list_sum(list_transform(list_zip(q.c, x.c), lambda z: z[1] * z[2]))::bigint as score from v q join v x on q.vec_id % {every} = 0 and q.vec_id <> x.vec_id),
    r as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from p)
    select query_id, rank, vec_id, score from r where rank <= {k}"""
