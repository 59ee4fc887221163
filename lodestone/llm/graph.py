"""Connected components by alternating large-star and small-star steps.

Both steps are a grouped minimum joined back to the edges, so no vertex's
neighbours are ever gathered in one place: partial aggregation takes the hot
vertices' minima, and adaptive execution splits their joins.  Every round is a
table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import steady
from .store import Scratch

SMALL = 1 << 20


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v, rewired to the least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


class Forest:
    """Union-find over 0..n-1 whose roots are the least members."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def labels(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))], np.int64)


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a small graph to (id, component)."""
    found = [np.stack([b.column("u").to_numpy(), b.column("v").to_numpy()], 1) for b in batches if b.num_rows]
    if not found:
        return
    names, back = np.unique(np.concatenate(found), return_inverse=True)
    forest = Forest(len(names))
    for a, b in back.reshape(-1, 2).tolist():
        forest.union(a, b)
    label = names[forest.labels()]
    for i in range(0, len(names), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 100_000]), pa.array(label[i : i + 100_000])], ["id", "component"])


def components(edges: DataFrame, scratch: Scratch, name: str, small: int = SMALL) -> DataFrame:
    """(id, component) of every vertex that has an edge; component is the least id reachable.

    edges: two long columns u and v in any order; loops and repeats are allowed, rows with a null are not edges.
    A graph of at most `small` edges takes one task with union-find, which that number bounds; larger ones take
    star rounds.  Both give the same rows.
    """
    now = scratch.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v"), f"{name}-0")
    if now.count() <= small:
        out = scratch.keep(now.coalesce(1).mapInArrow(steady(_least), "id long, component long"), name)
        scratch.drop(f"{name}-0")
        return out
    mark = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    now, k, seen = now.distinct(), 0, None
    while True:
        k += 1
        now = scratch.keep(_stars(_stars(now, True), False), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        before, seen = seen, mark(now)
        if before == seen:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
