"""Exact top-k search, filter audit and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from lodestone.llm import audit, exact, periodic
from lodestone.llm.store import Scratch

DOCS = "doc_id long, text string, lang string, n long, E boolean, bit int, start long"


# exact top-k


def top(rows: list[tuple], k: int, every: int) -> list[tuple]:
    dims = [len(v) for _, v in rows if v]
    dim = max(sorted(set(dims)), key=dims.count) if dims else 0
    whole = {(i, tuple(int(np.floor(1024 * float(x))) for x in v)) for i, v in rows if i is not None and v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, q in whole:
        if i % every == 0:
            found = sorted(((max(1 - 2**62, min(2**62 - 1, sum(a * b for a, b in zip(q, c)))), j) for j, c in whole if j != i), key=lambda t: (-t[0], t[1]))[:k]
            out += [(i, n + 1, j, s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def vectors(n: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [1.0] * 5), (n + 3, [None] + [1.0] * 5), (n + 4, [float("nan")] + [1.0] * 5), (n + 5, [float("inf")] * 6), (n + 6, [0.0] * 6), (None, [1.0] * 6)]
    return rows + [rows[0], rows[3], (10, [2.0] * 6), (-10, [0.5] * 6)]


@pytest.mark.parametrize("kind", ["plain", "ties", "large", "cut", "waves"])
def test_exact_search(spark, kind, monkeypatch):
    rows = vectors(300, 4)
    if kind == "ties":  # a third of all rows are one vector, and all scores are few
        rows = [(i, [float(i % 3 == 0), 1.0]) for i in range(400)]
    if kind in ("large", "cut"):
        rows = [(i, [x * (3e5 if kind == "large" else 1e12) for x in v]) if v and None not in v else (i, v) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, query string").repartition(7)
    got = exact.search(df, Scratch(spark, "test"), every=10, wave_size=20 if kind == "waves" else exact.WAVE)
    assert sorted(map(tuple, got.collect())) == sorted(top(rows, exact.K, 10))


def test_exact_search_refines(spark, monkeypatch):
    """With few rows allowed in the last bin, ranges are narrowed down to one score."""
    monkeypatch.setattr(exact, "KEEP", 1)
    rows = [(i, [float(i // 40), float(i % 2)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    assert sorted(map(tuple, exact.search(df, Scratch(spark, "test")).collect())) == sorted(top(rows, exact.K, exact.EVERY))


def test_exact_search_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in exact.search(df, Scratch(spark, "test")).collect()] == [(0, 1, 1, 2 * 1024 * 1024)]
    assert exact.search(df.limit(0), Scratch(spark, "test")).count() == 0
    assert exact.search(df.where("vec_id = 1"), Scratch(spark, "test")).count() == 0


# filter audit


def audited(docs: list[tuple], labels: list[tuple]) -> dict:
    least: dict[str, int] = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    rows = []
    for i, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        rows.append((lang or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out: dict = {}
    for order in itertools.permutations("ABCDE"):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            total = left
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in total if f in r[1]]
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in total), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    shapley: dict = {}
    for (part, order, k), v in out.items():
        shapley[part, order[k - 1]] = shapley.get((part, order[k - 1]), 0) + v[1]
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def audit_corpus() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(6)
    docs = []
    for i in range(150):
        n = rng.choice([0, 3, 150, 199, 200, 201, 260])
        words = [rng.choice(["a", "B", "ccc", "été", f"w{rng.randrange(400)}"]) if rng.random() < rng.choice([0.1, 0.6]) else f"v{rng.randrange(900)}" for _ in range(n)]
        docs.append((i, rng.choice([" ", "\n", "  "]).join(words) + rng.choice(["", "", " |", "$"]), rng.choice(["en", "de", "", None])))
    docs += [(200 + i, docs[i % 9][1], "en") for i in range(80)]  # copies
    docs += [(None, docs[3][1], "en"), (None, None, None), (500, None, "fr"), (501, "", "fr"), docs[5], docs[5], (-1, docs[7][1], "de"), (600, "word " * 60_000, "de")]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 260, 2)] + [(4, 1, 1), (None, 1, 1), (900, 1, 1), (6, None, None)]
    return docs, labels


def test_filter_audit(spark):
    docs, labels = audit_corpus()
    df = spark.createDataFrame([(*d, 1, True, 2, 3) for d in docs], DOCS).repartition(5)
    got = audit.digest(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), Scratch(spark, "test")).collect()
    want = audited(docs, labels)
    assert len(got) == len(want)
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == want


def test_filter_audit_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit.digest(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"), Scratch(spark, "test")).count() == 0


# periodic runs


def runs_by_period(w: list, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - start + q
            if i > start and n >= max(least, times * q):
                part = w[start : start + n]
                if not any(part[r:] == part[:-r] for r in range(1, q)):
                    out.append((start, n, q))
            i = max(i, start + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences() -> list[list[int]]:
    rng, out = random.Random(8), [[], [0], [0] * 5, [0] * 6, [0, 1] * 40 + [0], list(range(50))]
    for _ in range(500):
        n = rng.randrange(1, 140)
        w = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(n)]
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randrange(3, 11)
        out.append(w[:a] + (w[a : a + p] * n)[: n - a] if rng.random() < 0.7 else w)
    return out


@pytest.mark.parametrize("near", [1, 2, periodic.NEAR])
def test_runs(monkeypatch, near):
    monkeypatch.setattr(periodic, "NEAR", near)
    for w in sequences():
        for least, times in ((6, 4), (2, 3)):
            assert periodic.runs_of(w, least, times) == runs_by_period(w, least, times), w


def test_runs_survive_hashes_that_agree_by_chance(monkeypatch):
    """Hashes of no worth: what they claim is refuted word by word, and no false run comes out."""
    monkeypatch.setattr(periodic, "PRIME", 3)
    monkeypatch.setattr(periodic, "NEAR", 1)
    for w in sequences():
        assert set(periodic.runs_of(w)) <= set(runs_by_period(w))


def test_runs_of_long_sequences():
    rng = random.Random(2)
    root = [rng.randrange(1000) for _ in range(40_000)]
    assert periodic.runs_of(root * 5 + [-0] * 9)[0] == (0, 200_000 + (root[0] == 0), 40_000)
    assert periodic.runs_of([7] * 300_000) == [(0, 300_000, 1)]
    with pytest.raises(ValueError):
        periodic.runs_of([1, 1], times=2)


def test_periodic_digest(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "a a a a a a", "x y " * 9, "one two\tthree\x0b" * 700]
    texts += [" ".join(rng.choice("abc") + str(rng.randrange(rng.choice([1, 2, 60]))) for _ in range(rng.randrange(1, 220))) for _ in range(200)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "b b b b b b b"), (3, "a a a a a a"), (-7, "q " * 30)]
    df = spark.createDataFrame([(i, t, "en", 1, True, 2, 3) for i, t in docs], DOCS).repartition(4)
    want = []
    for i, t in docs:
        w = [x.decode() for x in (t or "").encode().split()]
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g, n, was = h // 10, len(w), list(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [was[a + (k - a) % p] if k >= a else x for k, x in enumerate(w)]
        runs = runs_by_period(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        milli = 1000 * best[1] // best[2] if runs else None
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert sum(r[1] > 0 for r in want) > 20
    key = repr
    assert sorted(map(tuple, periodic.digest(df).collect()), key=key) == sorted(want, key=key)
    assert periodic.digest(df.limit(0)).count() == 0


def test_audit_writes_no_more_files_than_cores(spark, tmp_path):
    """A file of a local folder costs a process, so few rows must not go to a file for each shuffle partition."""
    docs = spark.createDataFrame([(i, "Word " * (i % 7), f"l{i % 40}") for i in range(400)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, i % 3) for i in range(0, 400, 5)], "doc_id long, quality int, toxic int")
    keys = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        scratch = Scratch(spark, "audit-files")
        out = audit.digest(docs, labels, scratch)
        out.write.parquet(str(tmp_path / "out"))
        kept = spark.read.parquet(scratch.path("classes"))
        assert len(kept.inputFiles()) <= spark.sparkContext.defaultParallelism
        assert len(list((tmp_path / "out").glob("part-*"))) <= spark.sparkContext.defaultParallelism
        assert kept.agg({"n": "sum"}).first()[0] == 400 and spark.read.parquet(str(tmp_path / "out")).count() == 40 * 600
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
