"""Approximate nearest neighbours by additive quantisation.

A vector is its norm times a direction; the direction is coded as a sum of one
codeword from each of BOOKS full-dimensional codebooks, fitted to residuals of
a bounded sample and searched with a beam.  Every row is encoded once, into a
kept index that is read in place: queries go to its tasks in waves of bounded
size.  A query's inner products with all codewords form a lookup table, and a
code's score is a sum of table entries times the stored norm.  The first pass
counts these scores by bin and so finds, over all tasks, the score that a short
list of the best rows reaches; the second ranks those rows again, where they
are, on their original vectors in double precision.
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
from pyspark.sql import types as T

from .packed import steady
from .store import Scratch

BOOKS, WORDS, BEAM, ROUNDS = 16, 256, 2, 6
K, EVERY = 20, 20
#: Vectors that codebooks are fitted on, queries of a wave, and rows and queries that are scored at once.
SAMPLE, WAVE, ROWS, QUERIES = 16_384, 4096, 8192, 256
#: A query ranks again so many rows, or this share of all rows if that is more.
SHORT, SHARE = 1024, 0.02
#: Bins of a query's scores, and queries whose counts travel as one row.
BINS, TOGETHER = 256, 32


def vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and double-precision vectors of the rows that take part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dim)
    if not len(rows) or not dim:
        return np.zeros(0, np.int64), np.zeros((0, dim))
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        ok = np.isfinite(x).all(1) & x.any(1)
    return rows[ok], x[ok]


def dimension(rows: DataFrame, vector: str = "embedding") -> int:
    """The most frequent vector length (0 without vectors); vectors of any other length take no part."""
    found = rows.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found["d"] if found else 0


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), 1)
        count = np.bincount(near, minlength=len(centres))
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(count)
        sums = np.add.reduceat(x[order], (np.cumsum(count) - count)[full], axis=0)
        centres[full] = sums / count[full, None]
        empty = np.flatnonzero(count == 0)
        centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 5) -> np.ndarray:
    """Codebooks (books, words, dimension) of unit directions: each is fitted to what the ones before leave over."""
    rng, rest, out = np.random.default_rng(seed), x.astype(np.float32), []
    for _ in range(books):
        c = _kmeans(rest, words, ROUNDS, rng).astype(np.float32)
        if len(c) < words:
            c = np.concatenate([c, np.zeros((words - len(c), x.shape[1]), np.float32)])
        out.append(c)
        rest = rest - c[np.argmax(rest @ c.T - 0.5 * (c**2).sum(1), 1)]
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows, books) by beam search: the `beam` best partial sums go on from book to book."""
    n, m = len(x), len(books)
    rest, every = x.astype(np.float32)[:, None, :], np.arange(n)
    codes = np.zeros((n, 1, 0), np.uint8)
    for c in books:
        error = rest.reshape(-1, rest.shape[2]) @ c.T
        error *= -2
        error += (c**2).sum(1)
        error += (rest**2).sum(2).reshape(-1, 1)
        flat, best = error.reshape(n, -1), []
        for _ in range(beam):
            best.append(flat.argmin(1))
            flat[every, best[-1]] = np.inf
        best = np.stack(best, 1)
        parent, word = best // len(c), best % len(c)
        rest = np.take_along_axis(rest, parent[:, :, None], 1) - c[word]
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
    best = np.argmin((rest**2).sum(2), 1)
    return codes[np.arange(n), best].reshape(n, m)


def tables(queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Inner products of all codewords and queries: (books, words, queries)."""
    return np.einsum("mwd,qd->mwq", books, queries.astype(np.float32))


def scored(codes: np.ndarray, norms: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Scores (rows, queries) of coded rows by table lookup."""
    total = table[0][codes[:, 0]]
    for m in range(1, len(table)):
        total += table[m][codes[:, m]]
    total *= norms[:, None]
    return total


def codebooks(rows: DataFrame, dim: int, sample: int) -> np.ndarray:
    """Codebooks of the directions of at most `sample` vectors, those whose ids have the least hashes."""
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    _, x = vectors(picked.column("embedding"), dim)
    return fit(x / np.linalg.norm(x, axis=1, keepdims=True)) if len(x) else np.zeros((BOOKS, WORDS, max(dim, 1)), np.float32)


def index(rows: DataFrame, books, dim: int, scratch: Scratch, k: int = K) -> DataFrame:
    """The kept index: vec_id, codes, norm and vector of every row that takes part.

    Of the rows of one and the same vector those with the k + 1 smallest ids are kept; no other can be in a result.
    """
    kind = rows.schema["embedding"].dataType
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.select("vec_id", "embedding", rank.alias("rank")).where(F.col("rank") <= k + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                keep, x = vectors(part.column("embedding"), dim)
                norms = np.linalg.norm(x, axis=1)
                codes = encode(x / norms[:, None], books.value) if len(x) else np.zeros((0, BOOKS), np.uint8)
                part = part.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), part.column("embedding")], ["vec_id", "codes", "norm", "vector"])

    schema = T.StructType().add("vec_id", "long").add("codes", "binary").add("norm", "double").add("vector", kind)
    return scratch.keep(few.select("vec_id", "embedding").mapInArrow(steady(run), schema), "index")


@dataclass
class Wave:
    """Some queries: ids, vectors, the ends of their scores' range, and the bin from which rows are ranked again."""

    ids: np.ndarray
    x: np.ndarray
    reach: np.ndarray
    low: np.ndarray

    def bins(self, at: slice, score: np.ndarray) -> np.ndarray:
        """Bins (rows, queries) of scores; what is beyond the range, by the codes' error, goes to the first or last one."""
        with np.errstate(over="ignore", invalid="ignore"):
            place = (score / self.reach[at].astype(np.float32) + np.float32(1)) * np.float32(BINS / 2)
        return np.clip(np.nan_to_num(place, nan=0.0), 0, BINS - 1).astype(np.int32)


def blocks(batches: Iterator[pa.RecordBatch], wave: Wave, books: np.ndarray) -> Iterator[tuple[slice, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Queries, rows, ids and bins (rows, queries) of some rows and queries at a time; -1 at a query's own row."""
    for batch in batches:
        for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
            ids = part.column("vec_id").to_numpy()
            codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            norms = part.column("norm").to_numpy().astype(np.float32)
            for a in range(0, len(wave.ids), QUERIES):
                at = slice(a, min(a + QUERIES, len(wave.ids)))
                bins = wave.bins(at, scored(codes, norms, tables(wave.x[at], books)))
                own = np.flatnonzero(np.isin(wave.ids[at], ids))
                for j in own.tolist():
                    bins[ids == wave.ids[a + j], j] = -1
                yield at, part, ids, bins


def shortlisted(kept: DataFrame, wave, books, short: int) -> DataFrame:
    """query, bin: the bin that the best `short` rows of a query reach down to; none for a query with fewer rows.

    Counts go from the top down to where a task alone fills the short list, since lower bins can't matter then.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Wave = wave.value
        count, floor = np.zeros((len(w.ids), BINS), np.int32), np.zeros(len(w.ids), np.int32)
        for at, _, _, bins in blocks(batches, w, books.value):
            r, q = np.nonzero(bins >= floor[at])
            n = at.stop - at.start
            count[at] += np.bincount(q * BINS + bins[r, q], minlength=n * BINS).reshape(n, BINS)
            full = np.cumsum(count[at, ::-1], 1) >= short
            floor[at] = np.where(full.any(1), BINS - 1 - full.argmax(1), 0)
        count *= np.arange(BINS) >= floor[:, None]
        parts = [count[a : a + TOGETHER].tobytes() for a in range(0, len(count), TOGETHER)] if count.any() else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["block", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int32).reshape(-1, BINS).astype(np.int64) for x in t.column("counts"))
        full = np.cumsum(total[:, ::-1], 1) >= short
        q = np.flatnonzero(full.any(1))
        return pa.table({"query": pa.array(q + t.column("block")[0].as_py() * TOGETHER, pa.int32()), "bin": pa.array(BINS - 1 - full[q].argmax(1), pa.int32())})

    counts = kept.select("vec_id", "codes", "norm").mapInArrow(steady(run), "block int, counts binary")
    return counts.groupBy("block").applyInArrow(add, "query int, bin int")


def reranked(kept: DataFrame, wave, books, dim: int, k: int) -> DataFrame:
    """query_id, vec_id, score: of the rows on a query's short list a task's k best by exact inner product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Wave = wave.value
        held, n = [], 0
        for at, part, ids, bins in blocks(batches, w, books.value):
            r, q = np.nonzero(bins >= w.low[at])
            if not len(r):
                continue
            x = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), dim)
            for a in range(0, len(r), 1 << 16):
                b = slice(a, a + (1 << 16))
                held.append((w.ids[at][q[b]], ids[r[b]], np.einsum("nd,nd->n", x[r[b]], w.x[at][q[b]])))
            n += len(r)
            if n > 1 << 20:
                held, n = [_top(held, k)], 0
        if held:
            query, ids, score = _top(held, k)
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(score)], ["query_id", "vec_id", "score"])

    return kept.mapInArrow(steady(run), "query_id long, vec_id long, score double")


def search(rows: DataFrame, scratch: Scratch, k: int = K, every: int = EVERY, short: int | None = None, sample: int = SAMPLE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k rows of largest inner product.

    The codebooks are fitted on `sample` vectors at most, those whose ids have the least hashes; every row is
    encoded and scored.  Vectors that are null, zero, of an unusual dimension or hold null or non-finite
    components take no part, and rows without an id neither.  Ties go to the smaller id.  Rows that repeat an id
    count once, with the smallest of their vectors that take part, so a query has one list of distinct ids.
    An empty table gives no rows; extra columns are ignored.  A query ranks again `short` rows over all tasks, or the
    few more that share the last bin of scores.  The number of partitions changes no result.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("embedding")).where("vec_id is not null")
    dim = dimension(rows, "embedding")
    result = "query_id long, rank int, vec_id long, score double"
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    once = rows.where(F.size("embedding") == dim).where(usable).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = scratch.keep(once, "vectors")
    number = rows.where(F.col("vec_id") % every == 0).count()
    if not dim or not number:
        return spark.createDataFrame([], result)
    books = spark.sparkContext.broadcast(codebooks(rows, dim, sample))
    kept = index(rows, books, dim, scratch, k)
    size, longest = kept.agg(F.count("*"), F.max("norm")).first()
    short = max(k, short or max(SHORT, math.ceil(SHARE * size)))
    waves = math.ceil(1.25 * number / WAVE) if number > WAVE else 1
    for n in range(waves):
        t = rows.where((F.col("vec_id") % every == 0) & (F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == n)).toArrow()  # WAVE rows, but for chance
        _, x = vectors(t.column("embedding"), dim)
        wave = Wave(t.column("vec_id").to_numpy(), x, np.linalg.norm(x, axis=1) * longest, np.zeros(len(x), np.int32))
        sent = spark.sparkContext.broadcast(wave)
        found = shortlisted(kept, sent, books, short).toArrow()  # a row a query; those without one rank all rows again
        wave.low[found.column("query").to_numpy()] = found.column("bin").to_numpy()
        sent.destroy()
        sent = spark.sparkContext.broadcast(wave)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best = reranked(kept, sent, books, dim, k).select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
        scratch.keep(best, f"found/wave={n}")
        sent.destroy()
    return spark.read.schema(result).parquet(*[scratch.path(f"found/wave={n}") for n in range(waves)])


def _top(parts: list, k: int) -> list[np.ndarray]:
    """The k best of each query."""
    query, ids, score = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return [query[rank < k].astype(np.int64), ids[rank < k].astype(np.int64), score[rank < k]]
