"""Best-fit packing of tokenised documents into fixed-length sequences.

Hierarchical residual packing.  Every task tokenises its documents, cuts those
that are too long and packs the pieces by best fit, longest first.  Nearly full
bins are final.  Underfull bins go up a tree as items of their own: nodes of
about NODE_ITEMS bins best-fit them again, then `FAN_IN` nodes merge to one, until
one node holds all that are left or a round at the same number of nodes makes
next to nothing of them.  A piece's place is its place in its bin
plus its bin's place in the bin above, so token ids never move.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import steady
from .store import Scratch
from .text import _BYTE_POWERS, _SPACE, _BYTE, PIECE_BYTES, buffers, mix, pieces, stream

CAPACITY, END, TOKENIZER = 2048, 0, "word_bpe_49k.json"
SLACK, FAN_IN, NODE_ITEMS, NODE_TOKENS = 8, 8, 1 << 16, 1 << 22
#: Bytes of text tokenised at once, whose hashes and sums take many times as much; rows with ids in a batch that goes back to Spark.
CHUNK_BYTES, OUT_ROWS = 1 << 18, 1024

_LETTER, _DIGIT, _MARK, _OTHER = 1, 2, 3, 4
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[39] = _OTHER  # contractions need the tokenizer's own rules
_CLASS[_SPACE] = 0
_LATIN = np.zeros(256, bool)  # second bytes of U+00C0..U+00FF that are letters
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


class Encoder:
    """Token ids of whole columns, equal to the tokenizer's own.

    The tokenizer lower-cases, drops white space and never merges across runs of letters, digits and marks, so
    runs of ASCII and Latin-1 letters, single digits and runs of marks are looked up by hash; only runs not seen
    before go through the model.  Words with other characters or an apostrophe go through the whole tokenizer.
    Its special tokens' strings count as ordinary text.  The cache has a fixed size.
    """

    SLOT_BITS, STORE = 20, 1 << 23

    def __init__(self, path: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
        self.tokenizer.encode_special_tokens = True
        self._chars = self._byte_chars()
        self._reset()

    @staticmethod
    def _byte_chars() -> list[str]:
        """The printable stand-in of each byte in byte-level vocabularies."""
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        return [chr(b if b in keep else next(rest)) for b in range(256)]

    def _reset(self) -> None:
        slots = 1 << self.SLOT_BITS
        self.key, self.at, self.size = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.store, self.used, self.over = np.zeros(1 << 20, np.uint32), 0, {}

    def _put(self, ids: list[int]) -> tuple[int, int]:
        a, n = self.used, len(ids)
        if a + n > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(max(n, len(self.store)), np.uint32)])
        self.store[a : a + n] = ids
        self.used += n
        return a, n

    def _runs(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lowered bytes, starts, ends and whether each run needs the whole tokenizer."""
        n = len(raw)
        kind, low = _CLASS[raw], raw.copy()
        low[(raw >= 65) & (raw <= 90)] += 32
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        lead = lead[_LATIN[raw[lead + 1]]]
        kind[lead] = kind[lead + 1] = _LETTER
        upper = lead[(raw[lead + 1] <= 0x9E)] + 1
        low[upper] += 32
        solid, edge = kind > 0, np.zeros(n + 1, bool)
        edge[off] = True
        word = solid.copy()
        word[1:] &= ~solid[:-1] | edge[1:n]
        words = np.flatnonzero(word)
        if not len(words):
            return low, words, words, np.zeros(0, bool)
        odd = np.logical_or.reduceat(kind == _OTHER, words)
        inside = np.zeros(n, bool)
        inside[words[0] :] = np.repeat(odd, np.diff(np.append(words, n)))
        start = solid & (kind == _DIGIT)
        start[1:] |= solid[1:] & (kind[1:] != kind[:-1])
        start = (start & ~inside) | word
        end = solid.copy()
        end[:-1] &= ~solid[1:] | start[1:] | edge[1:n]
        starts = np.flatnonzero(start)
        return low, starts, np.flatnonzero(end) + 1, inside[starts]

    def encode_pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """`encode`, of a long text in pieces: tokens never span white space."""
        if len(column) != 1 or len(buffers(column)[0]) <= PIECE_BYTES:
            return self.encode(column)
        parts = [self.encode(p)[0] for p in pieces(column, 0)]
        ids = np.concatenate(parts)
        return ids, np.array([0, len(ids)])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column, and the n + 1 places where its texts begin among them."""
        if self.used > self.STORE or len(self.over) > self.STORE // 16:
            self._reset()
        raw, off = buffers(column)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        low, start, end, odd = self._runs(raw, off)
        up, down = _BYTE_POWERS.upto(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[low] * up[: len(raw)], out=total[1:])
        h = mix((total[end] - total[start]) * down[start])
        slot = (h >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        at, size = self.at[slot].astype(np.int64), self.size[slot]
        miss = np.flatnonzero(self.key[slot] != h)
        if len(miss):
            new, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            got = np.empty((len(new), 2), np.int64)
            text, chars, model = low.tobytes(), self._chars, self.tokenizer.model
            for k, (x, i) in enumerate(zip(new.tolist(), miss[first].tolist())):
                found = self.over.get(x)
                if found is None:
                    run = text[start[i] : end[i]]
                    if odd[i]:
                        ids = self.tokenizer.encode(run.decode("utf-8", "replace"), add_special_tokens=False).ids
                    else:
                        ids = [t.id for t in model.tokenize("".join([chars[b] for b in run]) if max(run) > 126 else run.decode())]
                    found = self._put(ids)
                    s = x >> 64 - self.SLOT_BITS
                    if self.key[s]:
                        self.over[x] = found
                    else:
                        self.key[s], self.at[s], self.size[s] = x, *found
                got[k] = found
            at[miss], size[miss] = got[back, 0], got[back, 1]
        stop = np.cumsum(size, dtype=np.int64)
        ids = self.store[np.repeat(at - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        return ids, np.append(0, stop)[np.searchsorted(start, off)]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best fit, longest first: each item's bin and offset, and what each bin holds."""
    at, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, left = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        at[i], offset[i] = b, capacity - room
        left[b] = room = room - s
        if room:
            if not free[room]:
                mask |= 1 << room
            free[room].append(b)
    return at, offset, [capacity - x for x in left]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def _local(capacity: int, end: int | None, tokenizer: str | None, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, rows, ids_out, held = Encoder(tokenizer), [], bytearray(), 0
        bins = TaskContext.get().partitionId() << 40
        closing = b"" if end is None else np.uint32(end).tobytes()

        def emit():
            nonlocal bins, ids_out
            doc, piece, start, length, crc = (np.array(x, dtype=object if k == 0 else np.int64) for k, x in enumerate(zip(*rows)))
            at, offset, fill = best_fit(length, capacity)
            out = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array(at + bins), pa.array(offset), pa.array(np.array(fill, np.int64)[at])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"]
            whole, ends, held_ids = pa.RecordBatch.from_arrays(out, names), np.append(0, 4 * np.cumsum(length)), memoryview(ids_out)
            bins += len(fill)
            rows.clear()
            ids_out = bytearray()
            step = OUT_ROWS if keep_ids else 4096
            for i in range(0, whole.num_rows, step):
                part = whole.slice(i, step)
                if keep_ids:  # a batch's ids are a part of those bytes, not a copy
                    at = ends[i : i + step + 1]
                    found = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(held_ids[at[0] : at[-1]])])
                    part = pa.RecordBatch.from_arrays([*part.columns, found], [*names, "ids"])
                yield part

        for part in stream(batches, limit=CHUNK_BYTES):
            ids, first = encoder.encode_pieces(part.column("text"))
            view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            for doc, a, b in zip(part.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                n = b - a + (end is not None)
                for piece, s in enumerate(range(0, n, capacity)):
                    m = min(capacity, n - s)
                    body = view[4 * (a + s) : 4 * min(a + s + m, b)]
                    last = closing if a + s + m > b else b""
                    rows.append((doc, piece, s, m, zlib.crc32(last, zlib.crc32(body))))
                    if keep_ids:
                        ids_out += body
                        ids_out += last
            held += len(ids)
            if len(rows) >= NODE_ITEMS or keep_ids and held >= NODE_TOKENS:
                yield from emit()
                held = 0
        if rows:
            yield from emit()

    return run


def _merge(capacity: int):
    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("bin")
        at, offset, fill = best_fit(pdf["fill"].to_numpy(np.int64), capacity)
        ids = pdf["bin"].to_numpy(np.int64)
        name = np.full(len(fill), -1, np.int64)
        for b, i in zip(at.tolist(), ids.tolist()):  # a merged bin is named after its first member
            if name[b] < 0:
                name[b] = i
        return pd.DataFrame({"bin": ids, "up": name[at], "shift": offset, "fill": np.array(fill, np.int64)[at]})

    return run


def pack(docs: DataFrame, scratch: Scratch, capacity: int = CAPACITY, end: int | None = END, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with keep_ids the ids themselves
    (little-endian unsigned 32-bit).  Only documents of more than `capacity` tokens are cut, into pieces of
    exactly that many and a rest.  A null or empty text is the end token alone (nothing where end is None).
    Rows that repeat are packed each; null ids stay null; extra columns are ignored; an empty table gives none.
    """
    schema = PIECES + (", ids binary" if keep_ids else "")
    pieces = scratch.keep(docs.select("doc_id", "text").mapInArrow(steady(_local(capacity, end, tokenizer, keep_ids)), schema), "pieces")
    under = F.col("fill") < capacity - SLACK
    low = pieces.where(under).groupBy("bin").agg(F.first("fill").alias("fill"))
    tree = scratch.keep(low.select("bin", F.col("bin").alias("root"), F.lit(0).cast("long").alias("shift"), "fill"), "tree-0")
    left, k, nodes = tree.count(), 0, 0
    while left:
        # as many nodes as the bins need; each level has a FAN_IN-th of those below if the bins allow it
        before, nodes = nodes, max(1, -(-left // NODE_ITEMS), nodes // FAN_IN)
        items = tree.where(under).groupBy("root").agg(F.first("fill").alias("fill")).withColumnRenamed("root", "bin")
        merged = items.groupBy(F.pmod(F.xxhash64("bin", F.lit(k)), F.lit(nodes)).alias("node")).applyInPandas(_merge(capacity), "bin long, up long, shift long, fill long")
        merged = merged.select(F.col("bin").alias("root"), "up", F.col("shift").alias("more"), F.col("fill").alias("new"))
        joined = tree.join(merged, "root", "left")
        joined = joined.select("bin", F.coalesce("up", "root").alias("root"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"), F.coalesce("new", "fill").alias("fill"))
        k += 1
        tree = scratch.keep(joined, f"tree-{k}")
        scratch.drop(f"tree-{k - 1}")
        seen, left = left, tree.where(under).select("root").distinct().count()
        if nodes == 1 or nodes == before and left > 0.99 * seen:
            break
    up = tree.select("bin", "root", "shift")
    out = pieces.join(up, "bin", "left")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("root", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")]
    return out.select(*cols, *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of pieces packed with keep_ids: the real sequences; a group is one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    out = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("_p"))
    return out.select("sequence_id", "length", F.aggregate("_p", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"))
