"""Which of many short texts stand in each of many values.

A text is known by the window of its first eight bytes (all of them, where it is
shorter) and by a hash of its length and bytes.  Every place of a value is
looked up by its window; where one is known, the hashes of the lengths that go
with it tell the texts.  So a value costs a look a byte, however many texts
there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of a window, bytes of a text that are looked at, and places of a value that are looked up at once.
WINDOW, LONGEST, CHUNK = 8, 256, 1 << 16
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), 0xD1342543DE82EF95


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(CHUNK + LONGEST, base, np.uint64)))


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, one after the other and padded by a window, and where each begins and the last ends."""
    v = values.cast(pa.large_string())
    at = np.frombuffer(v.buffers()[1], np.int64)[v.offset : v.offset + len(v) + 1] if len(v) else np.zeros(1, np.int64)
    data = v.buffers()[2]
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return np.concatenate([held, np.zeros(WINDOW, np.uint8)]), at - at[0]


def _windows(data: np.ndarray) -> np.ndarray:
    """The windows of all places but the padding, as numbers."""
    return np.ndarray((len(data) - WINDOW,), "<u8", data, strides=(1,))


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << 8 * size) - 1)


def _spread(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists that stand one after the other from `first` on: the entries of the lists `which`, and of which each is."""
    n = first[which + 1] - first[which]
    of = np.repeat(np.arange(len(which)), n)
    return first[which][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), of


def _lists(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of sorted keys and where the entries of each begin."""
    found, first = np.unique(keys, return_index=True)
    return found, np.append(first, len(keys))


@dataclass
class Windows:
    """Windows of one size: the known ones, sorted, and the lengths of the texts of each."""

    size: int
    keys: np.ndarray
    first: np.ndarray
    lengths: np.ndarray

    def marks(self) -> tuple[np.ndarray, np.uint64]:
        """A table of bits by hash, of which few are set, and the shift that makes the hash."""
        bits = min(26, len(self.keys).bit_length() + 5)
        out, shift = np.zeros(1 << bits, bool), np.uint64(64 - bits)
        out[(self.keys * _MIX) >> shift] = True
        return out, shift


@dataclass
class Texts:
    """Texts to look for: their windows, their hashes, sorted, and the owners of each."""

    windows: list[Windows]
    hashes: np.ndarray
    first: np.ndarray
    owners: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, owners: np.ndarray) -> Texts:
        """Texts of a byte or more; of one that is longer than LONGEST, as much is looked for. owners: a whole number from 0 for each."""
        data, at = _bytes(texts)
        start, length = at[:-1], np.minimum(np.diff(at), LONGEST)
        hashed = np.zeros(len(start), np.uint64)
        for k in range(length.max(initial=0)):
            still = np.flatnonzero(length > k)
            hashed[still] += (data[start[still] + k].astype(np.uint64) + np.uint64(1)) * _UP[k]
        hashed ^= length.astype(np.uint64) * _MIX
        sizes, windows = np.minimum(length, WINDOW), []
        seen = _windows(data)[start] if len(start) else np.zeros(0, np.uint64)
        for size in np.unique(sizes).tolist():
            of = sizes == size
            pairs = np.unique(np.rec.fromarrays([seen[of] & _mask(size), length[of]], names="key,length"))
            keys, first = _lists(pairs["key"])
            windows.append(Windows(size, keys, first, np.ascontiguousarray(pairs["length"])))
        order = np.argsort(hashed, kind="stable")
        hashes, first = _lists(hashed[order])
        return cls(windows, hashes, first, owners[order])


class Search:
    """A search for texts, ready for values."""

    def __init__(self, texts: Texts):
        self.texts, self.marks = texts, [w.marks() for w in texts.windows]

    def _places(self, data: np.ndarray, ends: np.ndarray, s: int, e: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The values (numbers) and hashes' places that places s to e of the bytes begin."""
        here, sums = _windows(data)[s:e], None
        for w, (bits, shift) in zip(self.texts.windows, self.marks, strict=True):
            x = here if w.size == WINDOW else here & _mask(w.size)
            hit = np.flatnonzero(bits[(x * _MIX) >> shift])
            key = np.minimum(np.searchsorted(w.keys, x[hit]), len(w.keys) - 1)
            known = w.keys[key] == x[hit]
            hit, key = hit[known], key[known]
            if not len(hit):
                continue
            if sums is None:
                held = data[s : min(e + LONGEST, len(data) - WINDOW)].astype(np.uint64) + np.uint64(1)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(held * _UP[: len(held)])])
            value = np.searchsorted(ends, hit + s, "right")
            at, of = _spread(w.first, key)
            length = w.lengths[at]
            inside = hit[of] + s + length <= ends[value[of]]  # a text that goes on in the next value is none
            of, length = of[inside], length[inside]
            place = hit[of]
            hashed = ((sums[place + length] - sums[place]) * _DOWN[place]) ^ (length.astype(np.uint64) * _MIX)
            j = np.minimum(np.searchsorted(self.texts.hashes, hashed), len(self.texts.hashes) - 1)
            same = self.texts.hashes[j] == hashed
            yield value[of][same], j[same]

    def pairs(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of values and of owners one of whose texts stands in them, sorted; texts of one hash are taken for one another."""
        data, at = _bytes(values)
        ends, n = at[1:], len(self.texts.hashes)
        if not n or len(data) == WINDOW:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = [v * n + j for s in range(0, len(data) - WINDOW, CHUNK) for v, j in self._places(data, ends, s, min(s + CHUNK, len(data) - WINDOW))]
        met = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        at_, of = _spread(self.texts.first, met % n)
        value, owner = (met // n)[of], self.texts.owners[at_]
        order = np.lexsort((owner, value))
        value, owner = value[order], owner[order]
        new = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))[: len(value)]
        return value[new], owner[new]
