"""Exact substring deduplication by fixed-block anchors.

A window of 35 words holds exactly one block of 18 words that starts at a
multiple of 18, so the non-overlapping blocks of all documents are indexed and
every rolling 18-word window probes them.  A block that is met anywhere else
anchors the 18 windows around it; these extend the hit on both sides and are
matched as wholes, and runs of matched windows are maximal exact repeats of 35
words or more.  Matching is by 64-bit hash of the words: of w windows about
w**2 / 2**65 pairs of different ones would be taken for equal, none in 10**9
windows, 3 in 10**10, and a share of 3e-7 of the windows of 100 TB.

Bulk data travel as packed arrays, one row per group of documents and bucket.
A group first settles what repeats inside itself and sends each hash once with
a mark for "more than once here", so a passage held by any share of all
documents costs each group one entry; no pair of places is ever formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import bounds, in_turn, pack_row, parts_of, runs, steady, to_batch, unpack
from .store import Scratch, by_keys, parts_for, subs_for
from .text import cuts, stream, windows_of

WINDOW = 35
GROUP_WORDS, BUCKET_BYTES = 1 << 20, 8 << 20

PACKED = "bucket int, probes binary, twice binary, keys binary, owners binary, counts binary, places binary, known binary"


_SCHEMA = pa.schema([("bucket", pa.int32()), *((x.split()[0], pa.binary()) for x in PACKED.split(", ")[1:])])
_HITS = pa.schema([("dest", pa.int32()), ("owners", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])


_SUB = pa.schema([("sub", pa.int32()), *list(_SCHEMA)[1:]])
_HITS_SUB = pa.schema([("sub", pa.int32()), *list(_HITS)[1:]])


def _packed(new, twice, ask, owner, place, known_owner, known_place, which, n: int, wide: bool, schema: pa.Schema) -> pa.RecordBatch:
    """Packed rows by bucket which(hash); places that are known to repeat go anywhere."""
    kind = np.uint64 if wide else np.uint32
    b = which(new)
    order = np.argsort(b, kind="stable")
    new, twice, cuts = new[order].astype(kind), twice[order], bounds(b[order], n)
    b = which(ask)
    order = np.argsort(b, kind="stable")
    ask, owner, place, mine = ask[order].astype(kind), owner[order], place[order].astype(np.int32), bounds(b[order], n)
    share, rows = np.linspace(0, len(known_owner), n + 1).astype(np.int64), []
    for k in range(n):
        (i, j), (p, q), (s, t) = cuts[k : k + 2], mine[k : k + 2], share[k : k + 2]
        if i == j and s == t and p == q:
            continue
        o, c = runs(owner[p:q])
        ko, kc = runs(known_owner[s:t])
        known = np.concatenate([np.array([len(ko)], np.int64).view(np.uint8), ko.view(np.uint8), kc.view(np.uint8), known_place[s:t].astype(np.int32).view(np.uint8)])
        rows.append({schema.names[0]: k} | pack_row(probes=new[i:j], twice=np.packbits(twice[i:j]), keys=ask[p:q], owners=o, counts=c, places=place[p:q], known=known))
    return to_batch(rows, schema)


def _requests(hashes: np.ndarray, ask: np.ndarray, owner: np.ndarray, place: np.ndarray, buckets: int, wide: bool) -> pa.RecordBatch:
    """Packed rows of one group.

    hashes: of all places of the group; ask: of those places that want to know whether their hash stands
    elsewhere, with their owner and place.  Hashes that repeat within the group are known at once.
    """
    new, count = np.unique(hashes, return_counts=True)
    many = count[np.searchsorted(new, ask)] > 1
    which = lambda h: ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    return _packed(new, count > 1, ask[~many], owner[~many], place[~many], owner[many], place[many], which, buckets, wide, _SCHEMA)


def _requested(rows: list[dict], wide: bool) -> tuple[np.ndarray, ...]:
    kind, out = np.uint64 if wide else np.uint32, []
    for row in rows:
        p, raw = unpack(row, "probes", kind), unpack(row, "known", np.uint8)
        n = int(raw[:8].view(np.int64)[0])
        c = raw[8 + 8 * n : 8 + 12 * n].view(np.int32)
        twice = np.unpackbits(unpack(row, "twice", np.uint8), count=len(p)).astype(bool)
        owner = np.repeat(unpack(row, "owners", np.int64), unpack(row, "counts", np.int32))
        out.append((p, twice, unpack(row, "keys", kind), owner, unpack(row, "places", np.int32), np.repeat(raw[8 : 8 + 8 * n].view(np.int64), c), raw[8 + 12 * n :].view(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _request_parts(subs: int, wide: bool):
    """Deals the requests of a partition to its parts, by the low bits of the hashes."""
    which = lambda h: ((h.astype(np.uint64) & np.uint64(0xFFFFFFFF)) % np.uint64(subs)).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for i in range(0, len(rows), 1000):
                yield _packed(*_requested(rows[i : i + 1000], wide), which, subs, wide, _SUB)

    return run


def _answers(buckets: int, wide: bool):
    """Of all rows of some buckets: the places whose hash stands somewhere else, packed by destination of the owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts_of(batches):
            probes, twice, keys, owner, place, known_owner, known_place = _requested(rows, wide)
            again = probes[twice]
            probes = np.sort(probes)
            again = np.unique(np.concatenate([again, probes[1:][probes[1:] == probes[:-1]]]))
            if len(again) and len(keys):
                hit = again[np.minimum(np.searchsorted(again, keys), len(again) - 1)] == keys
                owner, place = np.concatenate([known_owner, owner[hit]]), np.concatenate([known_place, place[hit]])
            else:
                owner, place = known_owner, known_place
            if len(owner):
                yield _hits(owner, place, (owner.view(np.uint64) % np.uint64(buckets)).astype(np.int32), buckets, _HITS)

    return run


def _hits(owner: np.ndarray, place: np.ndarray, to: np.ndarray, n: int, schema: pa.Schema) -> pa.RecordBatch:
    """Packed places by bucket."""
    order = np.lexsort((place, owner, to))
    to, owner, place = to[order], owner[order], place[order]
    cuts, rows = bounds(to, n), []
    for k in range(n):
        i, j = cuts[k], cuts[k + 1]
        if i < j:
            o, counts = runs(owner[i:j])
            rows.append({schema.names[0]: k} | pack_row(owners=o, counts=counts, places=place[i:j]))
    return to_batch(rows, schema)


def _hit_places(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.repeat(unpack(r, "owners", np.int64), unpack(r, "counts", np.int32)) for r in rows]), np.concatenate([unpack(r, "places", np.int32) for r in rows])


def _hit_parts(subs: int, buckets: int):
    """Deals the hits of a partition to its parts, by owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for i in range(0, len(rows), 1000):
                owner, place = _hit_places(rows[i : i + 1000])
                yield _hits(owner, place, (owner.view(np.uint64) // np.uint64(buckets) % np.uint64(subs)).astype(np.int32), subs, _HITS_SUB)

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed places to one row an owner: (_row, places), where places are the ends of runs of consecutive places (first, last, first, ...)."""
    for rows in parts_of(batches):
        yield from _runs_of(*_hit_places(rows))


def _runs_of(owner: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    opens = np.append(True, (owner[1:] != owner[:-1]) | (place[1:] > place[:-1] + 1))
    ends = np.append(opens[1:], True)
    both = np.stack([place[opens], place[ends]], 1)
    o, c = runs(owner[opens])
    stop = np.cumsum(c)
    for i in range(0, len(o), 5000):
        rows = [{"_row": int(k), "places": both[e - n : e].tobytes()} for k, n, e in zip(o[i : i + 5000], c[i : i + 5000], stop[i : i + 5000])]
        yield to_batch(rows, pa.schema([("_row", pa.int64()), ("places", pa.binary())]))


def _exchange(rows: DataFrame, buckets: int, subs: int, wide: bool) -> DataFrame:
    """Requests to answers, one row an owner."""
    asked = in_turn(rows.repartitionById(buckets, "bucket"), _request_parts(subs, wide), subs)
    answers = asked.mapInArrow(steady(_answers(buckets, wide)), "dest int, owners binary, counts binary, places binary").repartitionById(buckets, "dest")
    return in_turn(answers, _hit_parts(subs, buckets), subs).mapInArrow(steady(_gather), "_row long, places binary")


def _blocks(window: int, buckets: int):
    size = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_h, ask, owner, place, n = [], [], [], [], 0

        def send():
            given = [np.concatenate(x) for x in (all_h, ask, owner, place)]
            for x in (all_h, ask, owner, place):
                x.clear()
            return _requests(*given, buckets, False)

        for part in stream(batches):
            h, doc, at, count = windows_of(part.column("text"), size)
            ok = (count >= window)[doc]
            h, doc, at = h[ok], doc[ok], at[ok]
            block = at % size == 0
            all_h.append(h)
            ask.append(h[block])
            owner.append(part.column("_row").to_numpy()[doc[block]])
            place.append(at[block] // size)
            n += len(all_h[-1])
            if n >= GROUP_WORDS:
                yield send()
                n = 0
        if n:
            yield send()

    return run


def _windows(window: int, buckets: int):
    size = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_h, owner, place, held = [], [], [], 0

        def send():
            h = np.concatenate(all_h)
            given = np.concatenate(owner), np.concatenate(place)
            for x in (all_h, owner, place):
                x.clear()
            return _requests(h, h, *given, buckets, True)

        for part in stream(batches):
            h, doc, at, count = windows_of(part.column("text"), window)
            n = np.maximum(count - window + 1, 0)
            first = np.append(0, np.cumsum(n))
            mark = np.zeros(first[-1] + 1, np.int32)
            for start, m, places in zip(first.tolist(), n.tolist(), part.column("places").to_pylist()):
                k = np.frombuffer(places, np.int32).astype(np.int64).reshape(-1, 2) * size
                np.add.at(mark, start + np.clip(k[:, 0] - (window - size), 0, m), 1)
                np.add.at(mark, start + np.minimum(k[:, 1] + 1, m), -1)
            want = np.cumsum(mark[:-1]) > 0
            all_h.append(h[want])
            owner.append(part.column("_row").to_numpy()[doc[want]])
            place.append(at[want])
            held += len(all_h[-1])
            if held >= GROUP_WORDS // 2:
                yield send()
                held = 0
        if held:
            yield send()

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and _row, which names a row by its id and text."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.withColumn("_row", F.xxhash64("doc_id", "text"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose name by id and text is not among a kept table's (_gone); every column stays."""
    name = F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")))
    return by_keys(docs, gone, name == gone["_gone"], "left_anti")


def repeats(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """(_row, places): the starts of the windows of each keyed row that also start anywhere else, as packed int32 ends of runs (first, last, ...)."""
    buckets = parts_for(docs, BUCKET_BYTES)
    subs = subs_for(docs, BUCKET_BYTES, buckets)
    hits = scratch.keep(_exchange(docs.select("_row", "text").mapInArrow(steady(_blocks(window, buckets)), PACKED), buckets, subs, False), "anchors")
    near = by_keys(docs.select("_row", "text"), hits, "_row", "inner").select("_row", "text", "places")
    out = scratch.keep(_exchange(near.mapInArrow(steady(_windows(window, buckets)), PACKED), buckets, subs, True), "repeats")
    scratch.drop("anchors")
    return out


def kept_words(text: bytes, places: bytes | None, window: int) -> tuple[list[bytes], int]:
    """Words of a text outside the windows that start in the given runs, and the number of all words."""
    words = text.split()
    kept, done = [], 0
    for first, last in np.frombuffer(places or b"", np.int32).reshape(-1, 2).tolist():
        kept += words[done:first]
        done = max(done, last + window)
    return kept + words[done:], len(words)


def _with_places(docs: DataFrame, scratch: Scratch, window: int) -> DataFrame:
    return by_keys(docs, repeats(docs.select("doc_id", "text", "_row"), scratch, window), "_row", "left")


def digest(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256.

    Texts shorter than a window, null and empty texts lose nothing.  Rows that repeat an id and text repeat
    each other's windows, so both lose them.  Long texts are read in pieces; only writing what is kept holds a
    whole one.  Extra columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in stream(batches):
            rows = []
            for doc, text, places in zip(part.column("doc_id").to_pylist(), part.column("text"), part.column("places").to_pylist()):
                kept, n = kept_words(text.as_buffer().to_pybytes(), places, window)
                rows.append((doc, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_places(keyed(docs), scratch, window).select("doc_id", "text", "places").mapInArrow(steady(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, scratch: Scratch, window: int = WINDOW, length: str | None = "n_chars") -> DataFrame:
    """The documents without their repeated passages; every row and column stays.

    A text that loses words becomes its kept words joined by single spaces; others stay as they are, null
    included.  `length`, where docs has such a column, is set to the new number of characters.  Rows that repeat
    an id and text lose each other's windows; an empty table gives no rows; columns may have any names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all")
    text = F.coalesce(F.col("_all.text").cast("string"), F.lit(""))
    base = docs.select(row).select("_all", text.alias("text"), F.col("_all.doc_id").alias("doc_id")).withColumn("_row", F.xxhash64("doc_id", "text"))
    found = repeats(base.select("doc_id", "text", "_row"), scratch, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_, places in ((b.column(0).slice(i, n), b.column(1).slice(i, n)) for b in batches for i, n in cuts(pc.struct_field(b.column(0), "text").cast(pa.string()))):
            names = [f.name for f in all_.type]
            columns = dict(zip(names, all_.flatten()))
            old = columns["text"].cast(pa.string()).to_pylist()
            new = [b" ".join(kept_words(t.encode(), p, window)[0]).decode() if p else None for t, p in zip(old, places.to_pylist())]
            changed = pa.array([t is not None for t in new])
            columns["text"] = pc.if_else(changed, pa.array(new, pa.string()), columns["text"].cast(pa.string()))
            if length in columns:
                sizes = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(columns[length].type)
                columns[length] = pc.if_else(changed, sizes, columns[length])
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    joined = by_keys(base.drop("doc_id", "text"), found, "_row", "left").select("_all", "places")
    return joined.mapInArrow(steady(run), docs.schema)
