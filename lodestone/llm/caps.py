"""Embedding near-duplicates by spherical-cap filters.

Filters are the directions of a structured random product code: a rotated
vector is cut into blocks, and a filter is one random codeword for each block.
List decoding finds all filters whose inner product with a vector exceeds a
threshold without looking at the rest: a branch is left as soon as the best of
the later blocks can't lift it over the threshold.  A filter holds about FILL
vectors whatever their number, so the work for a vector grows only with the
number of filters it needs, that is with the logarithm.  Vectors that share a
filter are compared: first by 128-bit sign sketches to see which memberships
can have a partner, then exactly.  Equal vectors are one row.  A filter with
many members is cut into chunks that meet pairwise, and a pair that shares
several filters counts in the first, which the vectors' own lists tell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Forest, components
from .neighbours import dimension, vectors
from .packed import groups_of, steady
from .store import Scratch, parts_for

COSINE, FILL, CHUNK = 0.9, 256, 1024
#: Filters that a pair at the threshold is expected to share, and the least share of a vector's wanted filters.
EXPECTED, LEAST, STEPS = 14, 2 / 3, 12
SKETCH, NEAR = 128, 36
SEED = 23


def together(share: float, cosine: float) -> float:
    """Chance that a vector at that cosine lies in a cap, given that the other does; caps hold a share of all directions."""
    n = NormalDist()
    t = n.inv_cdf(1 - share)
    x = np.linspace(t, t + 6, 2001)
    weight = np.exp(-x * x / 2)
    return float((weight * [n.cdf((cosine * v - t) / math.sqrt(1 - cosine * cosine)) for v in x]).sum() / weight.sum())


class ProductCode:
    """Filters for that many vectors, and a threshold that each vector exceeds for `wanted` of them in the mean."""

    def __init__(self, dim: int, rows: int, cosine: float = COSINE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        share = min(0.05, FILL / max(rows, 1))
        self.wanted = math.ceil(EXPECTED / together(share, min(cosine, 0.999)))
        self.least = math.ceil(self.wanted * LEAST)
        self.parts = min(3 if self.wanted / share <= 1 << 24 else 4, dim)
        self.words = max(4, math.ceil((self.wanted / share) ** (1 / self.parts)))
        self.cuts = np.linspace(0, dim, self.parts + 1).astype(int)
        self.books = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:]):
            c = rng.standard_normal((self.words, b - a))
            self.books.append(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(self.parts))
        self.signs = rng.standard_normal((dim, SKETCH))
        total = self.words**self.parts
        if total <= 1 << 17:
            probe = rng.standard_normal((64, dim))
            every = self._sums(probe / np.linalg.norm(probe, axis=1, keepdims=True))
            self.threshold = float(np.sort(every, 1)[:, -min(self.wanted, total)].mean())
        else:  # the inner products spread as a normal variable of variance 1 / dim
            self.threshold = NormalDist().inv_cdf(1 - self.wanted / total) / math.sqrt(dim)

    def _sums(self, x: np.ndarray) -> np.ndarray:
        """Inner products with all filters."""
        y = [(x @ self.turn)[:, a:b] @ c.T for (a, b), c in zip(zip(self.cuts[:-1], self.cuts[1:]), self.books)]
        out = y[0]
        for z in y[1:]:
            out = (out[:, :, None] + z[:, None, :]).reshape(len(x), -1)
        return out

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters whose inner product with a row exceeds the threshold.

        Where fewer than the least number do, the row's threshold is lowered step by step until they do.
        """
        y = [(x @ self.turn)[:, a:b] @ c.T for (a, b), c in zip(zip(self.cuts[:-1], self.cuts[1:]), self.books)]
        best = np.zeros((len(x), self.parts + 1))
        for p in range(self.parts - 1, -1, -1):
            best[:, p] = best[:, p + 1] + y[p].max(1)
        rows, names, todo, threshold = [], [], np.arange(len(x)), self.threshold
        for step in range(STEPS):
            row, name, total = todo, np.zeros(len(todo), np.int64), np.zeros(len(todo))
            for p in range(self.parts):
                reach = total[:, None] + y[p][row] + best[row, p + 1][:, None] > threshold
                i, w = np.nonzero(reach)
                row, name, total = row[i], name[i] * self.words + w, total[i] + y[p][row[i], w]
            few = np.bincount(row, minlength=len(x)) < self.least if step < STEPS - 1 else np.zeros(len(x), bool)
            rows.append(row[~few[row]])
            names.append(name[~few[row]])
            todo = todo[few[todo]]
            if not len(todo):
                break
            threshold -= abs(self.threshold) * 0.08
        row, name = np.concatenate(rows), np.concatenate(names)
        order = np.lexsort((name, row))
        return row[order], name[order]

    def sketch(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x @ self.signs) > 0, axis=1).view(np.int64)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Memberships that can have a partner in their job, by sketch."""
    for t in groups_of(batches, ["filter", "i", "j"]):
        if t.num_rows < 2:
            continue
        s = [t.column(c).to_numpy().view(np.uint64) for c in ("s0", "s1")]
        chunk, i, j = t.column("chunk").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
        a = np.flatnonzero(chunk == i)
        b = np.flatnonzero(chunk == j)
        hit = np.zeros(t.num_rows, bool)
        for k in range(0, len(a), 256):
            p, q = a[k : k + 256], b[k:] if i == j else b  # of a chunk with itself each pair once
            close = np.bitwise_count(s[0][p, None] ^ s[0][None, q]) + np.bitwise_count(s[1][p, None] ^ s[1][None, q]) <= NEAR
            if i == j:
                close[np.arange(len(p)), np.arange(len(p))] = False
            hit[p] |= close.any(1)
            hit[q] |= close.any(0)
        if hit.any():
            yield from t.select(["filter", "i", "j", "chunk", "key"]).filter(pa.array(hit)).combine_chunks().to_batches()


def _earlier(lists: pa.ListArray, f: int) -> np.ndarray:
    """A bit set a row: which filters before f it is in, of those that several rows are in."""
    name, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    name, row = name[name < f], row[name < f]
    names, at, count = np.unique(name, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    bits = np.zeros((len(lists), -(-max(1, int((count > 1).sum())) // 64) * 64), np.uint8)
    many = count[at] > 1
    bits[row[many], shared[at[many]]] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def _pairs(cosine: float):
    """Links of each job: a vertex's number of linked rows, and a spanning forest of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, ["filter", "i", "j"]):
            if t.num_rows < 2:
                continue
            t = t.combine_chunks()
            x = t.column("vector").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(t.num_rows, -1)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            key, copies, chunk = (t.column(c).to_numpy() for c in ("key", "copies", "chunk"))
            f, i, j = (t.column(c)[0].as_py() for c in ("filter", "i", "j"))
            a, b = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
            close = x[a] @ x[b].T >= cosine
            if i == j:
                np.fill_diagonal(close, False)
            if not close.any():
                continue
            p, q = np.nonzero(np.triu(close, 1) if i == j else close)
            p, q = a[p], b[q]
            # a pair counts in the first filter that both are in
            earlier = _earlier(t.column("filters").combine_chunks(), f)
            first = np.concatenate([~(earlier[p[k : k + 65536]] & earlier[q[k : k + 65536]]).any(1) for k in range(0, len(p), 65536)])
            p, q = p[first], q[first]
            degree = np.bincount(p, copies[q], len(x)).astype(np.int64) + np.bincount(q, copies[p], len(x)).astype(np.int64)
            forest, u, v = Forest(len(x)), [], []
            for m, n in zip(p.tolist(), q.tolist()):
                if forest.union(m, n):
                    u.append(key[m])
                    v.append(key[n])
            k = np.flatnonzero(degree)
            n, m = len(k), len(u)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(key[k], np.array(u, np.int64))), pa.array(np.append(np.zeros(n, np.int64), np.array(v, np.int64)), mask=np.arange(n + m) < n), pa.array(np.append(degree[k], np.zeros(m, np.int64)))], ["u", "v", "n"])

    return run


def digest(rows: DataFrame, scratch: Scratch, cosine: float = COSINE) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, zero, of an unusual dimension or hold null or non-finite components link with
    nothing, not even with equal ones.  Rows that repeat a vector link with each other; rows that repeat an id
    too.  Vectors with one 64-bit hash are taken for equal: of n different ones about n^2 / 2^65 pairs are.
    Labels and other columns are ignored; an empty table gives no rows.
    """
    rows = rows.select("vec_id", "embedding")
    dim = dimension(rows)
    ok = (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    # 0.0 and -0.0 are equal components
    kind = rows.schema["embedding"].dataType.elementType
    plain = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x))
    named = rows.withColumn("vector", F.when(F.coalesce(ok, F.lit(False)), plain)).select("vec_id", "vector", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")).alias("key"))
    named = scratch.keep(named, "named")
    whole = scratch.keep(named.where("key is not null").groupBy("key").agg(F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("least")), "vectors")
    code = rows.sparkSession.sparkContext.broadcast(ProductCode(max(dim, 1), whole.count(), cosine))
    parts = parts_for(rows, 2 << 20)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                _, x = vectors(part.column("vector"), dim)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                row, name = code.value.decode(x)
                s = code.value.sketch(x)
                lists = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32), pa.array(name))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("vector"), part.column("copies"), lists, pa.array(s[:, 0]), pa.array(s[:, 1])], ["key", "vector", "copies", "filters", "s0", "s1"])

    vector = f"vector array<{kind.simpleString()}>"
    coded = scratch.keep(whole.select("key", "vector", "copies").mapInArrow(steady(decode), f"key long, {vector}, copies long, filters array<long>, s0 long, s1 long"), "coded")
    of = coded.select(F.explode("filters").alias("filter"), "key", "s0", "s1")
    large = of.groupBy("filter").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select("filter", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    dealt = of.join(scratch.keep(large, "large"), "filter", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(7)), F.col("chunks")).cast("int"))
    jobs = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select("filter", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "key", "s0", "s1")
    order = ["filter", "i", "j"]
    near = jobs.repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(steady(_near), "filter long, i int, j int, chunk int, key long")
    near = scratch.keep(near, "near")
    full = near.join(coded.select("key", "vector", "copies", "filters"), "key")
    links = full.repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(steady(_pairs(cosine)), "u long, v long, n long")
    links = scratch.keep(links, "links")
    degree = links.where("v is null").groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("n"))
    joined = components(links.where("v is not null").select("u", "v"), scratch, "joined").select(F.col("id").alias("key"), F.col("component").alias("label"))
    marked = scratch.keep(whole.select("key", "copies", "least").join(degree, "key", "left").join(joined, "key", "left").withColumn("label", F.coalesce("label", "key")), "marked")
    scratch.drop("coded", "large", "near", "links")
    ids = marked.groupBy("label").agg(F.min("least").alias("component_id"))
    per = marked.join(ids, "label").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = named.select("vec_id", "key").join(per, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
