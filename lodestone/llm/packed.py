"""Bulk data between tasks as packed arrays: one row carries the entries of a group of documents for one bucket."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not this C library
    _trim = None


def settle() -> None:
    """Gives freed memory back to the system; Python workers live on from task to task and would keep it."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def steady(run: Callable) -> Callable:
    """A function for mapInArrow that settles its worker's memory at its end."""

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        settle()

    return settled


def pack_row(**columns) -> dict:
    return {k: v if isinstance(v, int) else np.ascontiguousarray(v).tobytes() for k, v in columns.items()}


def to_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def bounds(order_by: np.ndarray, n: int) -> np.ndarray:
    """Bounds of 0..n-1 in an ascending array."""
    return np.searchsorted(order_by, np.arange(n + 1))


def runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run lengths of an array whose equal values stand together."""
    if not len(owner):
        return owner.astype(np.int64), np.zeros(0, np.int32)
    cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    return owner[cut].astype(np.int64), np.diff(np.append(cut, len(owner))).astype(np.int32)


def in_turn(dealt, split, subs: int):
    """A shuffled table of packed rows whose partitions are worked on part by part.

    split deals the rows of a partition to its parts (column sub); Spark's own sort, which spills, puts them in order.
    """
    return dealt.mapInArrow(steady(split), f"sub int, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in dealt.schema if f.dataType.simpleString() == 'binary')}").sortWithinPartitions("sub") if subs > 1 else dealt


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The packed rows of each part of a partition, of the whole partition where it has no parts."""
    rows: list[dict] = []
    now = None
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row.get("sub") != now:
                yield rows
                rows = []
            now = row.get("sub")
            rows.append(row)
    if rows:
        yield rows


def unpack(row: dict, name: str, kind) -> np.ndarray:
    return np.frombuffer(row[name], kind)


def groups_of(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """All rows of each key, as one table a key; batches are sorted by the key, which has no nulls."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and last != tuple(c[0] for c in columns)
        last = tuple(c[-1] for c in columns)
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if n and held:
                yield pa.Table.from_batches(held)
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
