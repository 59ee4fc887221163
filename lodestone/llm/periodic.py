"""Periodic runs of words: maximal stretches that repeat one root, found by Lyndon words.

Every run holds a root that is the longest Lyndon word at its place under one
of the two orders of words (an order and its reverse).  A scan from right to
left keeps, for each place, where the next smaller suffix begins: the Lyndon
word ends there.  Suffixes are compared by their longest common extension:
words first, then a binary search over rolling hashes, whose ends are compared
word by word again.  Where a Lyndon word is followed by itself, a run is
extended to both sides; every run is checked word by word before it counts.
There is no suffix array, and memory is some 30 bytes a word.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import steady
from .text import buffers, stream

LEAST, TIMES = 6, 4
#: Words that are compared one by one before hashes are asked, and remembered matches at most.
NEAR, REMEMBERED = 16, 1 << 16
PIECE = 1 << 20
PRIME, BASE = (1 << 61) - 1, 0x16A09E667F3BCC9
SPACES = b" \t\n\x0b\x0c\r"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def numbered(text: bytes) -> tuple[list[int], list[bytes]]:
    """The words of a text as numbers, equal for equal words only, and the word of each number."""
    ids, out, at = defaultdict(count().__next__), [], 0
    while at < len(text):
        stop = min(len(text), at + PIECE)
        while stop < len(text) and text[stop] not in SPACES:
            stop += 1
        out += map(ids.__getitem__, text[at:stop].split())
        at = stop
    return out, list(ids)


class Hashes:
    """Rolling hashes of a sequence, made when they are first asked for."""

    def __init__(self, w: list[int]):
        self.w, self.h, self.power = w, None, None

    def equal(self, i: int, j: int, n: int) -> bool:
        if self.h is None:
            self.h = array("Q", accumulate(self.w, lambda a, x: (a * BASE + x + 1) % PRIME, initial=0))
            self.power = array("Q", accumulate(range(len(self.w)), lambda a, _: a * BASE % PRIME, initial=1))
        h, p = self.h, self.power[n]
        return (h[i + n] - h[i] * p - h[j + n] + h[j] * p) % PRIME == 0

    def ahead(self, i: int, j: int, most: int) -> int:
        """How many words from i and from j on are equal, `most` at most."""
        w, n = self.w, 0
        near = min(most, NEAR)
        while n < near and w[i + n] == w[j + n]:
            n += 1
        if n < near or n == most:
            return n
        step = NEAR
        while n + step <= most and self.equal(i + n, j + n, step):
            n, step = n + step, step * 2
        low, high = 0, min(step, most - n)  # within the block that failed, or is cut by the end
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i + n, j + n, mid) else (low, mid - 1)
        n += low
        while n < most and w[i + n] == w[j + n]:
            n += 1
        return n

    def behind(self, i: int, j: int, most: int) -> int:
        """How many words before i and before j are equal, `most` at most."""
        w, n = self.w, 0
        near = min(most, NEAR)
        while n < near and w[i - n - 1] == w[j - n - 1]:
            n += 1
        if n < near or n == most:
            return n
        low, high = n, most
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i - mid, j - mid, mid) else (low, mid - 1)
        while low < most and w[i - low - 1] == w[j - low - 1]:
            low += 1
        return low


def _repeats(v: list[int], hashes: Hashes, found: dict[tuple[int, int], int]) -> None:
    """Lyndon words under the order of v that stand twice in a row, by (end of the match, length): the leftmost place."""
    n, follow, reach = len(v), array("q", bytes(8 * len(v))), {}
    for i in range(n - 1, -1, -1):
        x, j = v[i], i + 1
        while j < n:
            y = v[j]
            if x < y:
                j = follow[j]
                continue
            if x == y:
                period = j - i
                known = reach.get(period)  # words from known[0] on match those a period later up to known[1]
                if known and known[0] > i:
                    gap = known[0] - i
                    same = hashes.ahead(i, j, gap)
                    end = known[1] if same == gap else j + same
                else:
                    end = j + hashes.ahead(i, j, n - j)
                if end - j >= NEAR:
                    if len(reach) >= REMEMBERED:
                        reach.clear()
                    reach[period] = (i, end)
                if end < n and v[end - period] < v[end]:
                    j = follow[j]
                    continue
                if end - j >= period:
                    found[end, period] = i
            break
        follow[i] = j


def runs_of(w: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of at least `least` words and `times` periods (3 or more), by start and period.

    From three periods on, the first Lyndon root after a run's start is followed by itself within the run.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods are not looked for")
    hashes, found = Hashes(w), {}
    _repeats(w, hashes, found)
    down = list(range(0, -max(w, default=0) - 1, -1))
    _repeats([down[x] for x in w], hashes, found)
    out = []
    for (end, period), at in found.items():
        start = at - hashes.behind(at, at + period, at)
        while w[start : end - period] != w[start + period : end]:  # only if two hashes agreed by chance
            start, end = _around(w, at, period)
        if end - start >= max(least, times * period):
            out.append((start, end - start, period))
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def _around(w: list[int], at: int, period: int) -> tuple[int, int]:
    """The stretch of this period around a place, word by word."""
    start, end = at, at + period
    while start and w[start - 1] == w[start - 1 + period]:
        start -= 1
    while end < len(w) and w[end] == w[end - period]:
        end += 1
    return start, end


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Marks of the words that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def scan(docs: DataFrame, prepare: Callable[[int | None, list[int]], list[int]] | None = None, least: int = LEAST, times: int = TIMES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs and collapsed of every row: its runs by start and period, and its words without those that a run repeats.

    Words are maximal runs outside ASCII white space; places count words from 0.  `prepare` may change a row's
    sequence of word numbers before the search.  A null or empty text has no words, no runs and an empty collapsed
    text; null ids and repeated rows are rows like others, further columns are ignored, an empty table gives no rows.
    Each row is read by itself and whole, so nothing is shuffled; a text of b bytes takes about 10 b bytes.
    """
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream(batches):
            raw, off = buffers(batch.column("text"))
            sizes, flat, ends, texts = [], [], [0], []
            for key, a, b in zip(batch.column("doc_id").to_pylist(), off[:-1].tolist(), off[1:].tolist()):
                w, words = numbered(raw[a:b].tobytes())
                w = prepare(key, w) if prepare else w
                found = runs_of(w, least, times)
                kept = [words[w[i]] for i in np.flatnonzero(kept_words(len(w), found)).tolist()] if found else [words[x] for x in w]
                sizes.append(len(w))
                flat += found
                ends.append(len(flat))
                texts.append(b" ".join(kept))
            parts = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], ["start", "length", "period"])
            told = pc.cast(pa.array(texts, pa.binary()), options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts), told], names)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(steady(run), f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def planted(doc_id: int | None, w: list[int]) -> list[int]:
    """A tenth of the documents, by their ids' CRC-32, repeat a stretch of themselves to their end; a null id changes nothing."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + (w[a : a + p] * (1 + (n - a) // p))[: n - a]


def digest(docs: DataFrame) -> DataFrame:
    """Number of runs, the longest one and the hashes of all runs and of the collapsed text, for every document."""
    found = scan(docs, planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    period = -F.col("b.period")
    return out.select(
        "doc_id", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), period.alias("period"),
        F.expr("(1000 * b.length) div (-b.period)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
