"""Vectorised word, shingle and window hashing over Arrow string columns.

Words are maximal runs of bytes outside ASCII white space, found and hashed
with numpy on the column's own UTF-8 buffer, so no Python string is made for
any word.  A word's hash is a polynomial over per-byte random values modulo
2**64 followed by a bit mixer; windows of k words are polynomials over the word
hashes.  All constants are fixed, so every executor and every retry agrees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .packed import settle

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 20
#: A text beyond this is read in pieces of about so many bytes.
PIECE_BYTES = 4 << 20

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Separators of words of letters and digits; bytes beyond ASCII belong to words.
PUNCTUATED = np.ones(256, bool)
PUNCTUATED[48:58] = PUNCTUATED[65:91] = PUNCTUATED[97:123] = PUNCTUATED[128:] = False
_P = 0x9E3779B97F4A7C15 | 1
_W = 0xD6E8FEB86659FD93 | 1


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 2**64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            self.up, self.down = (self._table(b, self.n) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_BYTE_POWERS, _WORD_POWERS = _Powers(_P), _Powers(_W)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective 64-bit mixer; different salts give independent-looking hashes."""
    h = h + np.uint64(salt)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its n + 1 offsets from 0; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def cuts(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """First row and number of rows of slices with about `limit` bytes of text, one row at least."""
    _, off = buffers(column)
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(off, off[start] + limit, "right")) - 1
        stop = min(len(column), max(start + 1, stop))
        yield start, stop - start
        start = stop


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text, one row at least."""
    for start, n in cuts(batch.column(batch.schema.get_field_index(text)), limit):
        yield batch.slice(start, n)


class Words:
    """Words of each text of a column: hashes, byte spans, and `first[d]:first[d + 1]` per document."""

    def __init__(self, column: pa.Array, lower: bool = False, separators: np.ndarray = _SPACE):
        self.raw, self.offsets = raw, off = buffers(column)
        n = len(raw)
        solid = ~separators[raw]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        start = solid.copy()
        start[1:] &= ~solid[:-1] | edge[1:n]
        end = solid.copy()
        end[:-1] &= ~solid[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        up, down = _BYTE_POWERS.upto(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[raw] * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])

    def __len__(self) -> int:
        return len(self.count)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they end in the same document."""
        n = len(self.hash)
        up, down = _WORD_POWERS.upto(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * up[:n], out=total[1:])
        ok = np.zeros(n, bool)
        out = np.zeros(n, np.uint64)
        if n >= k:
            out[: n - k + 1] = mix((total[k:] - total[: n - k + 1]) * down[: n - k + 1], k)
            ok[: n - k + 1] = np.arange(k, n + 1) <= np.repeat(self.first[1:], self.count)[: n - k + 1]
        return out, ok

    def shingles(self, k: int) -> list[np.ndarray]:
        """Each document's distinct k-word shingles, ascending; the whole sequence where it has fewer words."""
        full, _ = self.windows(k)
        out = []
        up, _ = _WORD_POWERS.upto(k + 1)
        for a, n in zip(self.first[:-1].tolist(), self.count.tolist()):
            if n >= k:
                out.append(np.unique(full[a : a + n - k + 1]))
            elif n:
                out.append(mix((self.hash[a : a + n] * up[:n]).sum(keepdims=True, dtype=np.uint64), n))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def pieces(column: pa.Array, overlap: int, limit: int | None = None) -> Iterator[pa.Array]:
    """The column itself, or a single long text in pieces that end between words.

    Each piece but the first begins with the `overlap` words that its predecessor ends with, so that every run of
    overlap + 1 words stands whole in exactly one piece.  Only a single word can make a piece much longer.
    """
    raw, off = buffers(column)
    size = limit or PIECE_BYTES
    if len(off) != 2 or len(raw) <= size:
        yield column
        return
    start, stop, n = 0, 0, len(raw)
    while True:
        stop = min(n, max(stop, start) + size)
        while stop < n and not _SPACE[raw[stop]]:  # to the end of a word
            ahead = np.flatnonzero(_SPACE[raw[stop : stop + 4096]])
            stop += int(ahead[0]) if len(ahead) else min(4096, n - stop)
        if stop >= n:
            yield pa.array([raw[start:].tobytes()], pa.binary())
            return
        solid = ~_SPACE[raw[start:stop]]
        first = np.flatnonzero(solid & np.append(True, ~solid[:-1]))
        if len(first) > overlap:  # else the piece grows
            yield pa.array([raw[start:stop].tobytes()], pa.binary())
            start = start + int(first[-overlap]) if overlap else stop


def windows_of(column: pa.Array, k: int, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document number and first word's number of every k-word window of a column, and each document's number of words."""
    parts, words, count = [], 0, None
    for piece in pieces(column, k - 1):
        w = Words(piece, lower)
        h, ok = w.windows(k)
        doc = np.repeat(np.arange(len(w)), w.count)
        place = np.arange(len(h)) - np.repeat(w.first[:-1], w.count) + words
        parts.append((h[ok], doc[ok], place[ok]))
        count = w.count
        words += len(h) - (k - 1)
    if len(parts) == 1:
        return *parts[0], count
    return *(np.concatenate([p[i] for p in parts]) for i in range(3)), np.array([words + k - 1])


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's distinct lower-cased k-word shingles, ascending; long texts in pieces."""
    if len(column) == 1 and len(buffers(column)[0]) > PIECE_BYTES:
        h = windows_of(column, k, True)[0]
        if len(h):
            return [np.unique(h)]
    return Words(column, lower=True).shingles(k)


def stream(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from chunks(batch, text, limit)
        settle()
