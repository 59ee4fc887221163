"""N-gram Jaccard self-join with signature trees.

Documents with equal shingle sets are one class; the join works on one row a
class.  A pair of sets with similarity 0.8 or more shares one of the first
n - ceil(0.8 n) + 1 shingles of each set under any order of all shingles.

1. Shingles that one document alone holds are ordered first.  A set with enough
   of them has nothing but them in its prefix and can have no partner; counting
   document frequencies in hash buckets settles most sets this way.
2. The rest are the leaves of the trees, in runs that share a least shingle hash
   (near copies mostly do, twice over).  In each run a signature tree holds
   OR-combined bitmaps and size ranges; a dual traversal compares node with node,
   prunes by the largest possible overlap, skips nodes already connected, and
   verifies sets on their full shingles.
3. What these links connect has one label.  The upper levels of the trees are
   tables: a node is the holders of one prefix shingle, and nodes whose holders
   all have one label are pruned.  Shingles are ordered by counted frequency, so
   what many texts share comes last, and a set that has less left from the
   node's shingle on than a link takes is pruned too: of two linked sets the
   first common shingle leaves at least the overlap to come.  Large nodes are
   cut by size range and label, and pairs of their children go on only if sizes
   and what is left allow a link and labels differ.  Nodes are traversed on bitmaps first, which leaves the sets that may
   have a partner of another label; these are traversed as in 2.  No candidate
   pair is written, and nothing depends on how far candidates chain up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Forest, components
from .packed import bounds, groups_of, in_turn, pack_row, parts_of, runs, steady, to_batch, unpack
from .store import Scratch, by_keys, parts_for, subs_for
from .substring import keyed, without
from .text import mix, shingle_sets, stream

SHINGLE, PERCENT = 5, 80
GROUP_TOKENS, BUCKET_BYTES = 1 << 20, 8 << 20
#: Shingles with this many holders are ordered by their number; so many of the most frequent go to all tasks, others travel with their sets.
FREQUENT_FROM, FREQUENT = 32, 1 << 20
CHUNK_SETS, CHUNK_TOKENS, TURNS = 1000, 2_000_000, 2
LEAF, WIDE = 8, 64
#: Bits of a signature: this many a shingle, rounded up to a power of 2, within these bounds.
BITS, LEAST_BITS, MOST_BITS = 8, 1 << 8, 1 << 17


def prefix_length(n, percent: int = PERCENT):
    """Shingles of a set of n of which a partner must hold one."""
    return n - (n * percent + 99) // 100 + 1


def linked(common: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * common >= percent * (a + b - common)


def enough(common, sizes, percent: int = PERCENT):
    """Whether sets whose sizes add up to `sizes` can link with `common` shingles in common."""
    return (100 + percent) * common >= percent * sizes


# 1. document frequencies

_POST = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary()), ("about", pa.binary())])
POST = "bucket int, tokens binary, owners binary, counts binary, about binary"
_ABOUT = np.dtype([("row", "<i8"), ("doc", "<i8"), ("null", "<i8"), ("n", "<i8"), ("f1", "<i8"), ("f2", "<i8")])
_ANSWER = pa.schema([("dest", pa.int32()), ("owners", pa.binary()), ("shared", pa.binary()), ("about", pa.binary()), ("tokens", pa.binary()), ("df", pa.binary())])
ANSWER = "dest int, owners binary, shared binary, about binary, tokens binary, df binary"
SETS = "kind int, _row long, doc_id long, n long, f1 long, f2 long, shared long"


_POST_SUB = pa.schema([("sub", pa.int32()), *list(_POST)[1:]])
_ANSWER_SUB = pa.schema([("sub", pa.int32()), *list(_ANSWER)[1:]])


def _deal(t: np.ndarray, o: np.ndarray, a: np.ndarray, b: np.ndarray, n: int, schema: pa.Schema) -> pa.RecordBatch:
    """Packed rows of shingles (low 32 bits) and owners by bucket b, with an even share of the documents in each."""
    order = np.argsort(b, kind="stable")
    t, o, cuts = t[order].astype(np.uint32), o[order], bounds(b[order], n)
    share, rows = np.linspace(0, len(a), n + 1).astype(np.int64), []
    for i in range(n):
        p, q = cuts[i], cuts[i + 1]
        if p < q or share[i] < share[i + 1]:
            who, counts = runs(o[p:q])
            rows.append({schema.names[0]: i} | pack_row(tokens=t[p:q], owners=who, counts=counts, about=a[share[i] : share[i + 1]]))
    return to_batch(rows, schema)


def _posts(k: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners, about, n = [], [], [], 0

        def send():
            t, o, a = (np.concatenate(x) for x in (tokens, owners, about))
            for x in (tokens, owners, about):
                x.clear()
            return _deal(t, o, a, ((t >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), buckets, _POST)

        for part in stream(batches):
            sets = shingle_sets(part.column("text"), k)
            row, doc = part.column("_row").to_numpy(), part.column("doc_id")
            sizes = np.array([len(s) for s in sets], np.int64)
            info = np.zeros(len(sets), _ABOUT)
            info["row"], info["doc"], info["null"], info["n"] = row, doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), sizes
            flat = np.concatenate(sets)
            if len(flat):
                full = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[full]
                info["f1"][full] = np.add.reduceat(mix(flat, 11), starts).view(np.int64)
                info["f2"][full] = np.bitwise_xor.reduceat(mix(flat, 12), starts).view(np.int64)
            tokens.append(flat)
            owners.append(np.repeat(row, sizes))
            about.append(info)
            n += len(flat)
            if n >= GROUP_TOKENS:
                yield send()
                n = 0
        if about:
            yield send()

    return run


def _post_parts(subs: int):
    """Deals the posts of a partition to its parts, by the low bits of the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def send():
            t, o, a = (np.concatenate(x) for x in zip(*held))
            held.clear()
            return _deal(t, o, a, (t % np.uint32(subs)).astype(np.int32), subs, _POST_SUB)

        for row in (r for b in batches for r in b.to_pylist()):
            held.append((unpack(row, "tokens", np.uint32), np.repeat(unpack(row, "owners", np.int64), unpack(row, "counts", np.int32)), unpack(row, "about", _ABOUT)))
            n += len(held[-1][0])
            if n >= GROUP_TOKENS:
                yield send()
                n = 0
        if held:
            yield send()

    return run


def _frequencies(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        for rows in parts_of(batches):
            t = np.concatenate([unpack(r, "tokens", np.uint32) for r in rows])
            o = np.concatenate([np.repeat(unpack(r, "owners", np.int64), unpack(r, "counts", np.int32)) for r in rows])
            about = np.concatenate([unpack(r, "about", _ABOUT) for r in rows])
            order = np.argsort(t, kind="stable")
            s = t[order]
            cut = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
            count = np.diff(np.append(cut, len(s)))
            many = np.zeros(len(s), bool)
            many[order] = np.repeat(count > 1, count)
            owners, shared = np.unique(o[many], return_counts=True)
            hot = count >= FREQUENT_FROM
            token, df = s[cut[hot]].astype(np.uint64) | np.uint64(here << 32), count[hot].astype(np.int64)
            yield _answer(about, owners, shared.astype(np.int32), token, df, lambda x: (x.view(np.uint64) % np.uint64(buckets)).astype(np.int32), buckets, _ANSWER)

    return run


def _answer(about, owners, shared, token, df, to, n: int, schema: pa.Schema) -> pa.RecordBatch:
    """Packed rows of documents and of how many shingles of an owner are shared, by to(row); frequent shingles go anywhere."""
    a, o = np.argsort(to(about["row"]), kind="stable"), np.argsort(to(owners), kind="stable")
    about, owners, shared = about[a], owners[o], shared[o]
    ca, co, ct = bounds(to(about["row"]), n), bounds(to(owners), n), np.linspace(0, len(token), n + 1).astype(np.int64)
    rows = []
    for i in range(n):
        (p, q), (r, s), (x, y) = ca[i : i + 2], co[i : i + 2], ct[i : i + 2]
        if p < q or r < s or x < y:
            rows.append({schema.names[0]: i} | pack_row(owners=owners[r:s], shared=shared[r:s], about=about[p:q], tokens=token[x:y], df=df[x:y]))
    return to_batch(rows, schema)


def _answered(rows: list[dict]) -> tuple[np.ndarray, ...]:
    kinds = (("about", _ABOUT), ("owners", np.int64), ("shared", np.int32), ("tokens", np.int64), ("df", np.int64))
    return tuple(np.concatenate([unpack(r, name, kind) for r in rows]) for name, kind in kinds)


def _answer_parts(subs: int, buckets: int):
    """Deals the answers of a partition to its parts, by row."""
    to = lambda x: (x.view(np.uint64) // np.uint64(buckets) % np.uint64(subs)).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for i in range(0, len(rows), 1000):
                yield _answer(*_answered(rows[i : i + 1000]), to, subs, _ANSWER_SUB)

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document (kind 0), with how many of its shingles others hold, and one a frequent shingle (kind 1: _row is the shingle, n its frequency)."""
    for rows in parts_of(batches):
        about, owners, shared, token, df = _answered(rows)
        who, back = np.unique(owners, return_inverse=True)
        total = np.bincount(back, shared, len(who)).astype(np.int64)
        at = np.minimum(np.searchsorted(who, about["row"]), max(len(who) - 1, 0))
        got = np.where(who[at] == about["row"], total[at], 0) if len(who) else np.zeros(len(about), np.int64)
        got = np.minimum(got, about["n"])  # rows that repeat count twice
        k, m = len(about), len(token)
        zeros = np.zeros(m, np.int64)
        columns = [np.append(np.zeros(k, np.int32), np.ones(m, np.int32)).astype(np.int32), np.append(about["row"], token), np.append(about["doc"], zeros), np.append(about["n"], df)]
        columns += [np.append(about["f1"], zeros), np.append(about["f2"], zeros), np.append(got, zeros)]
        arrays = [pa.array(c) for c in columns]
        arrays[2] = pa.array(columns[2], mask=np.append(about["null"] != 0, zeros != 0))
        yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in SETS.split(", ")])


# 2. leaves and prefixes


def bitmap(t: np.ndarray, bits: int) -> np.ndarray:
    mark = np.zeros(bits, np.uint8)
    mark[(t & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(mark, bitorder="little").view(np.uint64)


def signature(t: np.ndarray) -> np.ndarray:
    return bitmap(t, 1 << int(min(MOST_BITS, max(LEAST_BITS, BITS * len(t))) - 1).bit_length())


def _short(t: np.ndarray, of: int) -> np.ndarray:
    """Names under which frequencies are counted: the bucket and the low 32 bits."""
    return ((t >> np.uint64(32)) % np.uint64(of)) << np.uint64(32) | (t & np.uint64(0xFFFFFFFF))


class Frequent:
    """Frequencies of the most frequent shingles, by name; 0 of any other."""

    def __init__(self, names: np.ndarray, df: np.ndarray, of: int):
        order = np.argsort(names)
        self.names, self.df, self.of = names[order], df[order], of

    def __call__(self, t: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.zeros(len(t), np.int64)
        name = _short(t, self.of)
        at = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
        return np.where(self.names[at] == name, self.df[at], 0)


def _unknown(frequent: Frequent):
    """(_row, name, place) of the shingles of each set that are not among the most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                sets = [np.frombuffer(b, np.uint64) for b in part.column("tokens").to_pylist()]
                places = [np.flatnonzero(frequent(t) == 0) for t in sets]
                names = np.concatenate([_short(t[at], frequent.of) for t, at in zip(sets, places)]).view(np.int64)
                row = np.repeat(part.column("_row").to_numpy(), [len(x) for x in places])
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(names), pa.array(np.concatenate(places).astype(np.int32))], ["_row", "name", "place"])

    return run


def _keys(percent: int, frequent: Frequent):
    """Of each set its size, the shingles of which a partner must hold one, its leaves (the least shingle under TURNS hashes) and its bitmap.

    Shingles are ordered by frequency, then by hash; a column `told` has the frequencies (place, df) that `frequent` lacks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prefixes, leaves, maps = [], [], [], []
            told = batch.column("told").to_pylist() if "told" in batch.schema.names else [None] * batch.num_rows
            for blob, more in zip(batch.column("tokens").to_pylist(), told):
                t = np.frombuffer(blob, np.uint64)
                df = frequent(t)
                if more:
                    df[[x["place"] for x in more]] = [x["df"] for x in more]
                sizes.append(len(t))
                prefixes.append(t[np.argsort(df, kind="stable")[: prefix_length(len(t), percent)]].view(np.int64))
                leaves.append([int(mix(t, 21 + turn).min().view(np.int64)) for turn in range(TURNS)])
                maps.append(signature(t).tobytes())
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum([len(x) for x in prefixes])).astype(np.int32), pa.array(np.concatenate(prefixes))) if prefixes else pa.array([], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(sizes, pa.int32()), lists, pa.array(leaves, pa.list_(pa.int64())), pa.array(maps, pa.binary())], ["_row", "n", "prefix", "leaf", "map"])

    return run


# 3. signature trees


def _common(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(a, b)
    at[at == len(a)] = len(a) - 1
    return int((a[at] == b).sum())


class SignatureTree:
    """Sets in leaves, ordered by size class and a key; each node has the OR of its sets' bitmaps and its size range.

    visited counts the pairs of nodes that were opened, compared the pairs of sets whose shingles were compared.
    """

    def __init__(self, maps: np.ndarray, n: np.ndarray, key: np.ndarray, percent: int, leaf: int = LEAF):
        self.percent, self.leaf, self.visited, self.compared = percent, leaf, 0, 0
        self.order = np.lexsort((key, np.floor(np.log(n) / np.log(100 / percent))))
        self.maps, self.n = maps[self.order], n[self.order]
        self.clash = self.n - np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        self.levels = [self._level(self.maps, self.n, self.n, self.clash, np.arange(0, len(n), leaf))]
        while len(self.levels[-1][0]) > 1:
            self.levels.append(self._level(*self.levels[-1], np.arange(0, len(self.levels[-1][0]), 2)))

    @classmethod
    def of(cls, sets: list[np.ndarray], percent: int) -> SignatureTree:
        n = np.array([len(s) for s in sets], np.int64)
        bits = 1 << min(16, max(8, int(2 * n.max()).bit_length()))
        return cls(np.stack([bitmap(s, bits) for s in sets]), n, np.array([s[0] for s in sets], np.uint64), percent)

    @staticmethod
    def _level(maps, low, high, clash, starts):
        return np.bitwise_or.reduceat(maps, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(clash, starts)

    def members(self, level: int, node: int) -> np.ndarray:
        """Numbers of a node's sets as they were given."""
        return self.order[node * (self.leaf << level) : (node + 1) * (self.leaf << level)]

    def may_link(self, level: int, a: int, b: int) -> bool:
        """False if the largest possible overlap of the nodes' sets is too small for a link."""
        maps, low, high, clash = self.levels[level]
        if 100 * high[a] < self.percent * low[b] or 100 * high[b] < self.percent * low[a]:
            return False
        most = int(np.bitwise_count(maps[a] & maps[b]).sum()) + min(clash[a], clash[b])
        return (100 + self.percent) * most >= self.percent * (low[a] + low[b])

    def walk(self, wanted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The dual traversal, near pairs of nodes first: numbers of the two sets of each pair that may link, leaf by leaf.

        wanted(level, a, b) can close a pair of nodes; it is asked when the pair is reached.
        """
        pairs = [(len(self.levels) - 1, 0, 0)]
        while pairs:
            level, a, b = pairs.pop()
            self.visited += 1
            if level == 0:
                yield self._leaves(a, b)
                continue
            width = len(self.levels[level - 1][0])
            below = [(i, j) for i in (2 * a, 2 * a + 1) for j in (2 * b, 2 * b + 1) if i < width and j < width and (a != b or i <= j)]
            # a node with itself comes last on the stack, so first
            for i, j in sorted(below, key=lambda p: p[0] == p[1]):
                if i == j or self.may_link(level - 1, i, j) and wanted(level - 1, i, j):
                    pairs.append((level - 1, i, j))

    def _leaves(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        size = self.leaf
        x, y = slice(a * size, (a + 1) * size), slice(b * size, (b + 1) * size)
        most = np.bitwise_count(self.maps[x, None] & self.maps[None, y]).sum(2, dtype=np.int64) + np.minimum(self.clash[x, None], self.clash[None, y])
        may = (100 + self.percent) * most >= self.percent * (self.n[x, None] + self.n[None, y])
        i, j = np.nonzero(np.triu(may, 1) if a == b else may)
        return self.order[i + x.start], self.order[j + y.start]

    def join(self, sets: list[np.ndarray], forest: Forest, side: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that connect what was not connected yet, each verified on its sets; only between sides where given."""
        out = []

        def apart(level: int, a: int, b: int) -> bool:
            if level > 4:
                return True
            all_ = np.append(self.members(level, a), self.members(level, b)).tolist()
            first = forest.find(all_[0])
            return any(forest.find(i) != first for i in all_)

        for i, j in self.walk(apart):
            for p, q in zip(i.tolist(), j.tolist()):
                if (side is None or side[p] != side[q]) and forest.find(p) != forest.find(q):
                    self.compared += 1
                    if linked(_common(sets[p], sets[q]), len(sets[p]), len(sets[q]), self.percent):
                        forest.union(p, q)
                        out.append((p, q))
        return out

    def partnered(self, label: np.ndarray, rest: np.ndarray, may) -> np.ndarray:
        """Marks of the sets that may link with one of another label; rest bounds a set's overlap with any other, may(i, j) tells which pairs count."""
        low = [np.minimum.reduceat(label[self.order], np.arange(0, len(label), self.leaf))]
        high = [np.maximum.reduceat(label[self.order], np.arange(0, len(label), self.leaf))]
        most = [np.maximum.reduceat(rest[self.order], np.arange(0, len(label), self.leaf))]
        for maps, *_ in self.levels[:-1]:
            starts = np.arange(0, len(maps), 2)
            low.append(np.minimum.reduceat(low[-1], starts))
            high.append(np.maximum.reduceat(high[-1], starts))
            most.append(np.maximum.reduceat(most[-1], starts))

        def wanted(level: int, a: int, b: int) -> bool:
            n = self.levels[level][1]
            return min(low[level][a], low[level][b]) != max(high[level][a], high[level][b]) and enough(min(most[level][a], most[level][b]), n[a] + n[b], self.percent)

        out, n = np.zeros(len(label), bool), np.empty_like(self.n)
        n[self.order] = self.n
        for i, j in self.walk(wanted):
            ok = (label[i] != label[j]) & enough(np.minimum(rest[i], rest[j]), n[i] + n[j], self.percent) & may(i, j)
            out[i[ok]] = out[j[ok]] = True
        return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of each key, of batches sorted by the keys."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != now:
                if rows:
                    yield now, rows
                now, rows = key, []
            rows.append(row)
    if rows:
        yield now, rows


def _links(keys: list[str], percent: int):
    """Links within each node, of sets whose labels differ; where a node has two sides, of sets of different sides only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        for _, rows in _groups(batches, keys):
            if len(rows) < 2:
                continue
            forest, first = Forest(len(rows)), {}
            for i, r in enumerate(rows):
                forest.union(first.setdefault(r["label"], i), i)
            side = np.array([r["side"] for r in rows])
            sets = [np.frombuffer(r["tokens"], np.uint64) for r in rows]
            found = SignatureTree.of(sets, percent).join(sets, forest, side if side.any() else None) if len(first) > 1 else []
            u += [rows[a]["_row"] for a, _ in found]
            v += [rows[b]["_row"] for _, b in found]
            if len(u) > 50_000:
                yield batch()
                u, v = [], []
        if u:
            yield batch()

    return run


def _open(keys: list[str], percent: int):
    """Of each node those sets that by their bitmaps may link with one of another label (of the other side where a node has two).

    Bitmaps have 8 to 16 bits a shingle, so sets that can link have the same length or one is twice the other; the
    longer is folded to the shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, keys):
            label, n = t.column("label").to_numpy(), t.column("n").to_numpy().astype(np.int64)
            if label.min() == label.max():
                continue
            side, rest, maps = t.column("side").to_numpy(), t.column("rest").to_numpy().astype(np.int64), [np.frombuffer(m, np.uint64) for m in t.column("map").to_pylist()]
            words = np.array([len(m) for m in maps])
            across, hit = side.any(), np.zeros(len(n), bool)
            for w in np.unique(words).tolist():
                at = np.flatnonzero((words == w) | (words == 2 * w) & (percent * n <= 100 * n[words == w].max()))
                if len(at) < 2:
                    continue
                flat = np.stack([maps[i] if words[i] == w else maps[i][:w] | maps[i][w:] for i in at])
                own, s = words[at] == w, side[at]
                may = lambda i, j: (own[i] | own[j]) & (s[i] != s[j] if across else True)  # noqa: B023, E731
                hit[at] |= SignatureTree(flat, n[at], label[at], percent, WIDE).partnered(label[at], rest[at], may)
            if hit.any():
                yield from t.select(["_row", "label", *keys, "side"]).filter(pa.array(hit)).combine_chunks().to_batches()

    return run


def _chunks(sets: str = "sets", tokens: str = "tokens"):
    return F.greatest(F.ceil(F.col(sets) / CHUNK_SETS), F.ceil(F.col(tokens) / CHUNK_TOKENS)).cast("int")


def _children(held: DataFrame, percent: int) -> DataFrame:
    """Pairs of children of large nodes: (_row, n, label, token, rest, i, j, side) of held (_row, n, label, token, rest, chunks).

    A child has one size class, and either one label or a share of the small labels.  A pair goes on only if its
    size ranges and what is left from the node's shingle on allow a link and its labels are not all the same.
    """
    key = ["token", "class", "label"]
    rows = held.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int"))
    own = rows.groupBy(*key).agg(F.count("*").alias("sets"), F.sum("n").alias("tokens")).where((F.col("sets") > CHUNK_SETS // 2) | (F.col("tokens") > CHUNK_TOKENS // 2))
    rows = rows.join(own.select(*key, _chunks().alias("own")), key, "left")
    node = F.when(F.col("own").isNotNull(), F.xxhash64("class", "label", F.pmod(F.xxhash64("_row"), F.col("own")))).otherwise(F.xxhash64("class", F.pmod(F.xxhash64("label", F.lit(5)), F.col("chunks"))))
    rows = rows.select("_row", "n", "label", "token", "rest", "class", node.alias("node"))
    nodes = rows.groupBy("token", "class", "node").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("a"), F.max("label").alias("b"), F.max("rest").alias("rest"))
    named = lambda s: nodes.select("token", F.col("class").alias(f"class{s}"), *[F.col(c).alias(c + s) for c in ("node", "low", "high", "a", "b", "rest")])
    one = named("1").withColumn("class2", F.explode(F.array("class1", F.col("class1") + 1)))
    pairs = one.join(named("2"), ["token", "class2"]).where(f"(class1 < class2 or node1 <= node2) and 100 * least(high1, high2) >= {percent} * greatest(low1, low2) and {100 + percent} * least(rest1, rest2) >= {percent} * (low1 + low2) and not (a1 = b1 and a2 = b2 and a1 = a2)")
    ends = pairs.select("token", F.col("node1").alias("i"), F.col("node2").alias("j")).select("*", F.explode(F.array_distinct(F.array("i", "j"))).alias("node"))
    return rows.join(ends, ["token", "node"]).select("_row", "n", "label", "token", "rest", "i", "j", (F.col("node") != F.col("i")).cast("int").alias("side"))


def classes(docs: DataFrame, scratch: Scratch, k: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The near-duplicate classes of keyed documents (doc_id, text, _row).

    Returns all sets (_row, doc_id, n, f1, f2) and, for the sets that have a partner or an equal set, their
    (n, f1, f2, component_id).
    """
    buckets = parts_for(docs, BUCKET_BYTES)
    subs = subs_for(docs, BUCKET_BYTES, buckets)
    posts = in_turn(docs.mapInArrow(steady(_posts(k, buckets)), POST).repartitionById(buckets, "bucket"), _post_parts(subs), subs)
    answers = in_turn(posts.mapInArrow(steady(_frequencies(buckets)), ANSWER).repartitionById(buckets, "dest"), _answer_parts(subs, buckets), subs)
    both = scratch.keep(answers.mapInArrow(steady(_gather), SETS), "sets")
    sets = both.where("kind = 0").drop("kind")
    counted = both.where("kind = 1").select(F.col("_row").alias("name"), F.col("n").alias("df"))
    top = counted.orderBy(F.desc("df"), "name").limit(FREQUENT).toArrow()  # FREQUENT at most
    frequent = Frequent(top.column("name").to_numpy().view(np.uint64), top.column("df").to_numpy(), buckets)
    rep = sets.where("n > 0").groupBy("n", "f1", "f2").agg(F.min_by(F.struct("_row", "shared"), F.struct("doc_id", "_row")).alias("r"), F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    rep = scratch.keep(rep.select("n", "f1", "f2", "r._row", "r.shared", "first", "copies"), "classes")
    # fewer shingles of its own than the prefix is long
    open_ = scratch.keep(rep.where(100 * F.col("shared") >= percent * F.col("n")).select("_row"), "open")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in stream(batches):
            found = shingle_sets(part.column("text"), k)
            yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array([s.tobytes() for s in found], pa.binary())], ["_row", "tokens"])

    def tokenised(names: DataFrame) -> DataFrame:
        return by_keys(docs.select("_row", "text"), names, "_row", "left_semi").mapInArrow(steady(tokens), "_row long, tokens binary")

    # rows that repeat have one name: one of them goes on, and only those few that do repeat are shuffled to find it
    twice = scratch.keep(sets.groupBy("_row").agg(F.count("*").alias("times")).where("times > 1").select("_row"), "twice")
    if twice.limit(1).count():
        once, again = (scratch.keep(open_.join(twice, "_row", how), f"open-{how}") for how in ("left_anti", "left_semi"))
        full = tokenised(once).unionByName(tokenised(again).dropDuplicates(["_row"]))
    else:
        full = tokenised(open_)
    full = scratch.keep(full, "tokens")
    asking = full
    if top.num_rows == FREQUENT:
        # each of these has less than a FREQUENT-th of all places, so none is a hot key
        others = counted
        if top.num_rows:
            df, name = (int(top.column(c)[-1].as_py()) for c in ("df", "name"))
            others = counted.where((F.col("df") < df) | (F.col("df") == df) & (F.col("name") > name))
        told = full.mapInArrow(steady(_unknown(frequent)), "_row long, name long, place int").join(others, "name")
        asking = full.join(told.groupBy("_row").agg(F.collect_list(F.struct("place", "df")).alias("told")), "_row", "left")
    near = scratch.keep(asking.mapInArrow(steady(_keys(percent, frequent)), "_row long, n int, prefix array<long>, leaf array<long>, map binary"), "keys")

    def traverse(work: DataFrame, keys: list[str], name: str) -> DataFrame:
        dealt = work.join(full, "_row").repartition(buckets, *keys).sortWithinPartitions(*keys)
        return scratch.keep(dealt.mapInArrow(steady(_links(keys, percent)), "u long, v long"), name)

    leaves = near.select("_row", "n", F.posexplode("leaf").alias("turn", "leaf"))
    shared = leaves.groupBy("turn", "leaf").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens")).where("sets > 1").select("turn", "leaf", _chunks().alias("chunks"))
    work = leaves.join(shared, ["turn", "leaf"]).select("_row", F.col("_row").alias("label"), F.lit(0).alias("side"), "turn", "leaf", F.pmod(F.xxhash64("_row"), F.col("chunks")).alias("run"))
    links = traverse(work, ["turn", "leaf", "run"], "links")
    joined = components(links, scratch, "near").select(F.col("id").alias("_row"), F.col("component").alias("label"))

    held = near.select("_row", "n", "prefix").join(joined, "_row", "left")
    held = held.select("_row", "n", F.coalesce("label", "_row").alias("label"), F.posexplode("prefix").alias("place", "token"))
    held = scratch.keep(held.select("_row", "n", "label", "token", (F.col("n") - F.col("place")).alias("rest")), "held")
    measures = [f.alias(a) for f, a in ((F.min("label"), "a"), (F.max("label"), "b"), (F.min("n"), "low"), (F.max("n"), "high"), (F.max("rest"), "most"), (F.count("*"), "sets"), (F.sum("n"), "tokens"))]
    open_node = f"a < b and (sets > 2 or 100 * low >= {percent} * high) and {100 + percent} * most >= {2 * percent} * low"
    open_set = f"{100 + percent} * least(rest, most) >= {percent} * (n + low)"
    nodes = held.groupBy("token").agg(*measures, F.sum("rest").alias("reach"), F.bit_xor(F.xxhash64("_row")).alias("x"), F.bit_xor(F.xxhash64("_row", F.lit(1))).alias("y")).where(open_node)
    # shingles with the same holders are one node: the first of them in order, of which most is left
    nodes = nodes.groupBy("x", "y", "sets", "tokens", "low").agg(F.max_by(F.struct("token", "most"), F.col("reach")).alias("s"))
    nodes = scratch.keep(nodes.select("s.*", "low", _chunks().alias("chunks")), "nodes")
    if nodes.limit(1).count():
        inside = held.join(nodes, "token").where(open_set).select(*held.columns, "chunks")
        one = [F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side")]
        small = inside.where("chunks = 1").select(*held.columns, *one)
        if nodes.where("chunks > 1").limit(1).count():
            # of large nodes the sets that are left are measured again
            large = scratch.keep(inside.where("chunks > 1").select(*held.columns), "large")
            again = scratch.keep(large.groupBy("token").agg(*measures).where(open_node).select("token", "low", "most", _chunks().alias("chunks")), "again")
            large = large.join(again, "token").where(open_set).select(*held.columns, "chunks")
            small = small.unionByName(large.where("chunks = 1").select(*held.columns, *one)).unionByName(_children(large.where("chunks > 1"), percent))
        keys = ["token", "i", "j"]
        bits = small.join(near.select("_row", "map"), "_row").repartition(buckets, *keys).sortWithinPartitions(*keys)
        work = scratch.keep(bits.mapInArrow(steady(_open(keys, percent)), "_row long, label long, token long, i long, j long, side int"), "left")
        more = traverse(work, keys, "links2")
        joined = components(links.unionByName(more), scratch, "final").select(F.col("id").alias("_row"), F.col("component").alias("label"))
    named = rep.join(joined, "_row", "left").withColumn("label", F.coalesce("label", "_row"))
    ids = named.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("sets"), F.max("copies").alias("copies")).where("sets > 1 or copies > 1")
    ids = scratch.keep(ids.select("label", "component_id"), "ids")
    found = scratch.keep(by_keys(named, ids, "label", "inner").select("n", "f1", "f2", "component_id"), "found")
    scratch.drop("tokens", "keys", "held", "nodes", "large", "again", "left", "links", "links2", "open")
    return sets.select("_row", "doc_id", "n", "f1", "f2"), found


def digest(docs: DataFrame, scratch: Scratch, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id.

    Without words (null and empty texts) a document has no shingles and is its own component.  Rows that repeat
    are linked like any copies.  A null id is never a component's id unless all ids in it are null.  Long texts are
    read whole, in pieces.  Extra columns are ignored; an empty table gives no rows.
    """
    sets, found = classes(keyed(docs), scratch, k, percent)
    out = sets.join(found, ["n", "f1", "f2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, scratch: Scratch, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents with one of each near-duplicate group: that with the smallest id; every column stays.

    Rows that repeat the id that stays all stay; documents without words are no near duplicates and stay.  Long
    texts are read in pieces.  Only the names of the rows that go travel; an empty table gives no rows.
    """
    sets, found = classes(keyed(docs), scratch, k, percent)
    lost = sets.join(found, ["n", "f1", "f2"]).where("doc_id != component_id or (doc_id is null and component_id is not null)").select(F.col("_row").alias("_gone")).distinct()
    return without(docs, scratch.keep(lost, "lost"))
