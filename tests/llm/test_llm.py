"""Operators of lodestone.llm against brute force on small tables with nulls, empty texts, repeated rows and clashing columns."""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import archives, caps, graph, jaccard, language, licenses, mixing, neighbours, packing, store, substring, text, toxicity
from lodestone.llm.store import Scratch

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, bucket string, label long"


def corpus() -> list[tuple]:
    rng = random.Random(3)
    words = [f"w{i}" for i in range(900)] + ["Ärger", "naïve", "日本", "don't", "UPPER", "x.", "idiot"]
    text_ = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [None, "", "   \n\t", "one", "one two three four", "ONE two three four"]
    base = text_(120)
    out += [base, base, base.upper(), base + " tail"]
    for _ in range(12):  # near copies
        w = base.split()
        for _ in range(3):
            w[rng.randrange(len(w))] = text_(1)
        out.append(" ".join(w))
    passage = text_(50)
    for _ in range(8):
        out.append(text_(rng.randrange(5, 60)) + " " + passage + "\n" + text_(rng.randrange(5, 60)))
    out += ["same " * 90, "same " * 60, text_(6000)]
    out += [text_(rng.randrange(1, 300)) for _ in range(40)]
    rows = [(i * 3 % 1000, t, "en", None if i % 7 == 0 else f"s{i % 4}", len(t or ""), 1, "b", i % 2) for i, t in enumerate(out)]
    return [*rows, rows[6], (None, "null id here with some words", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def scratch(spark):
    return Scratch(spark, "test")


def words(t):
    return WORD.findall((t or "").encode())


def lower(t: bytes) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in t)


# words


def test_words_match_regex(rows):
    w = text.Words(pa.array([r[1] for r in rows]))
    assert w.count.tolist() == [len(words(r[1])) for r in rows]
    spans = [bytes(w.raw[a:b]) for a, b in zip(w.start, w.end)]
    assert spans == [x for r in rows for x in words(r[1])]
    by = {}
    for h, s in zip(w.hash.tolist(), spans):
        assert by.setdefault(h, s) == s
    assert len(set(spans)) == len(by)


@pytest.mark.parametrize("limit", [1, 7, 30])
def test_pieces_of_long_texts(limit, monkeypatch):
    rng = random.Random(limit)
    for _ in range(60):
        parts = ["".join(rng.choice("abcdé") for _ in range(rng.choice([1, 2, 3, 40]))) for _ in range(rng.randrange(0, 60))]
        column = pa.array([rng.choice(["", " ", "\n\n"]) + rng.choice([" ", "  ", "\n "]).join(parts) + rng.choice(["", " "])])
        for k in (1, 2, 5, 35):
            monkeypatch.setattr(text, "PIECE_BYTES", 1 << 30)
            whole, sets = text.windows_of(column, k, True), text.shingle_sets(column, k)
            monkeypatch.setattr(text, "PIECE_BYTES", limit)
            cut = text.windows_of(column, k, True)
            assert all(a.tolist() == b.tolist() for a, b in zip(whole, cut)) and cut[3][0] == len(parts)
            assert text.shingle_sets(column, k)[0].tolist() == sets[0].tolist()


def test_windows_do_not_depend_on_place():
    w = text.Words(pa.array(["a b c d e", "x a b c", "b c d"]))
    h, ok = w.windows(3)
    assert h[0] == h[6] and h[1] == h[9] and ok.tolist() == [True, True, True, False, False, True, True, False, False, True, False, False]


# 1


def test_packing(spark, docs, rows):
    tokenizer = packing.Encoder().tokenizer
    got = packing.pack(docs, scratch(spark), capacity=256).toPandas()
    want = collections.Counter()
    for r in rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for p, s in enumerate(range(0, len(ids), 256)):
            want[r[0], p, s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes())] += 1
    have = collections.Counter((None if x.doc_id != x.doc_id else int(x.doc_id), x.piece, x.start, x.length, x.ids_crc32) for x in got.itertuples())
    assert have == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 256 and g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
    assert got.sequence_id.nunique() <= 1.03 * len(packing.best_fit(got.length.to_numpy(), 256)[2]) + 1


def test_packing_keeps_ids(spark, docs):
    s = packing.sequences(packing.pack(docs.where("doc_id is not null"), scratch(spark), capacity=512, keep_ids=True)).collect()
    assert all(len(r["ids"]) == 4 * r["length"] <= 2048 for r in s)


def test_encoder_equals_tokenizer():
    odd = ["", " ", "it's DON'T we'll", "naïve Café ÉCOLE ß ÿ × ÷", "éa x́", "日本語 123 4.5", "<|endoftext|> a", "a b c \x1c d\x1ee", "😀😀 ok!!??", "İst ΣΑΣ", "don''t 's", "½ ² 1²", "́ a"]
    e = packing.Encoder()
    ids, first = e.encode(pa.array([*odd, None]))
    for k, t in enumerate(odd):
        assert ids[first[k] : first[k + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_best_fit_is_best_fit():
    at, offset, fill = packing.best_fit(np.array([5, 4, 3, 3, 2, 1]), 6)
    assert len(fill) == 3 and sum(fill) == 18 and all(o + s <= 6 for o, s in zip(offset, [5, 4, 3, 3, 2, 1]))


# 2


def brute_components(rows):
    sets = []
    for r in rows:
        w = [lower(x) for x in words(r[1])]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    forest = graph.Forest(len(rows))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            forest.union(i, j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[forest.find(i)] = min(least.get(forest.find(i), 1 << 60), r[0])
    return collections.Counter((r[0], len(sets[i]), least.get(forest.find(i), r[0])) for i, r in enumerate(rows))


@pytest.mark.parametrize("chunk", [1000, 3])
def test_jaccard(spark, docs, rows, chunk, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_SETS", chunk)
    got = collections.Counter(map(tuple, jaccard.digest(docs, scratch(spark)).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute_components(rows)


def chained(rng, groups, size, step):
    """Texts of families whose members drift away from the first, so that many are near and few linked."""
    out = []
    for g in range(groups):
        w = [f"g{g}w{i}" for i in range(30)]
        for _ in range(size):
            w = [x if rng.random() > step else f"r{rng.randrange(10**9)}" for x in w]
            out.append(" ".join(w + ["common tail of all the families here"]))
    return out


@pytest.mark.parametrize("chunk, frequent", [(1000, 1 << 17), (4, 0)])
def test_jaccard_of_drifting_families(spark, chunk, frequent, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_SETS", chunk)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", 4)
    rng = random.Random(11)
    texts = chained(rng, 6, 40, 0.01) + [" ".join(f"s{rng.randrange(9)}" for _ in range(rng.randrange(5, 30))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = collections.Counter(map(tuple, jaccard.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), scratch(spark)).collect()))
    assert got == brute_components(rows)


@pytest.mark.parametrize("chunk, frequent, short", [(1000, 1 << 20, ()), (20, 8, (2, 3, 4, 9))])
def test_a_passage_that_unlinked_texts_share(spark, chunk, frequent, short, monkeypatch):
    """Texts of one long passage and some words of their own, which link from 15 such words together on down."""
    monkeypatch.setattr(jaccard, "CHUNK_SETS", chunk)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "TURNS", 0)  # nodes of shingles alone
    rng = random.Random(3)
    own = [rng.randrange(10, 16) for _ in range(400)] + [*short]
    rows = [(i, " ".join([f"p{j}" for j in range(64)] + [f"o{rng.randrange(10**9)}" for _ in range(n)])) for i, n in enumerate(own)]
    sizes, real = {}, Scratch.keep

    def keep(self, df, name):
        out = real(self, df, name)
        if name in ("held", "left"):
            sizes[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "keep", keep)
    got = collections.Counter(map(tuple, jaccard.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), scratch(spark)).collect()))
    assert got == brute_components(rows)
    assert sizes["held"] >= 400
    if not short:  # nothing links: no set is left to compare with another, though all hold one shingle of their prefix
        assert sizes.get("left", 0) == 0


def test_repeated_rows_are_compared_once(spark, monkeypatch):
    """Thousands of rows with one id and text, and a near copy of them: one set of tokens each."""
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "other"])
    rows = [(7, " ".join(words))] * 3000 + [(9, near), (9, near), (3, "quite another text of some words here")]
    kept = {}
    real = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: kept.setdefault(name, real(self, df, name)))
    counts = {}
    drop = Scratch.drop
    monkeypatch.setattr(Scratch, "drop", lambda self, *names: (counts.update({n: kept[n].count() for n in ("tokens", "keys") if n in kept and n in names}), drop(self, *names)))
    got = jaccard.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), scratch(spark)).collect()
    assert collections.Counter(map(tuple, got)) == {(7, 56, 7): 3000, (9, 56, 7): 2, (3, 3, 3): 1}
    assert counts == {"tokens": 2, "keys": 2}


def test_signature_tree_prunes_near_sets_that_are_not_linked():
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(80) < 0.8], draw(14)])) for base in (draw(80) for _ in range(60)) for _ in range(20)]
    tree = jaccard.SignatureTree.of(sets, 80)
    assert tree.join(sets, graph.Forest(len(sets))) == []
    assert tree.compared < 0.001 * len(sets) ** 2 / 2
    lone = [np.unique(draw(n)) for n in range(8, 1208)]  # of all sizes: most pairs of nodes are out of reach
    tree = jaccard.SignatureTree.of(lone, 80)
    assert tree.join(lone, graph.Forest(len(lone))) == [] and tree.compared == 0
    assert tree.visited < 0.4 * sum(len(n) * (len(n) + 1) / 2 for _, n, _, _ in tree.levels)


def test_keep_one(spark, docs, rows):
    docs = docs.withColumn("_row", F.lit(7)).withColumn("_gone", F.lit("x"))
    kept = jaccard.keep_one(docs, scratch(spark))
    assert kept.columns == docs.columns
    want = collections.Counter({k: n for k, n in brute_components(rows).items() if k[0] == k[2]})
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter({k[0]: n for k, n in want.items()})


def test_signature_tree_equals_all_pairs():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**63, 100).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(100) < 0.93], rng.integers(0, 2**63, 4).astype(np.uint64)])) for _ in range(40)]
    sets += [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in rng.integers(1, 200, 40)]
    a, b = graph.Forest(80), graph.Forest(80)
    jaccard.SignatureTree.of(sets, 80).join(sets, a)
    for i, j in itertools.combinations(range(80), 2):
        if jaccard.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
            b.union(i, j)
    assert a.labels().tolist() == b.labels().tolist()


def test_components_both_ways(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(500, 530)] + [(5, None), (7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    one, two = (sorted(map(tuple, graph.components(df, scratch(spark), "x", n).collect())) for n in (1 << 20, 0))
    assert one == two and dict(one)[530] == 500


# 3


def test_mixing(spark, docs, rows):
    got = mixing.digest(docs, scratch(spark)).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    assert collections.Counter(got["size"]) == collections.Counter(len(words(r[1])) for r in rows)
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(size.values())
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2.0 * size[s] for s in over)
        open_ -= over
    target |= {s: left * weight[s] / total for s in open_}
    assert sorted(round(x, 6) for x in got.target.unique()) == sorted({round(x, 6) for x in target.values()})
    again = mixing.digest(docs, scratch(spark)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(repr, got[key].itertuples(index=False))) == sorted(map(repr, again[key].itertuples(index=False)))
    for _, g in got.groupby("target"):  # a source's words come within what its largest documents and chance allow
        if g.target.iloc[0]:
            assert abs(g.taken.sum() - g.target.iloc[0]) <= 4 * np.sqrt((g["size"] ** 2).sum() * 0.25) + 1
    mixed = mixing.mix(docs, scratch(spark))
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(mixing.n_words("text"))).first()[0] == got.taken.sum()


# 4


def test_toxicity(spark):
    rng = random.Random(2)
    plain, bad = [f"p{i}" for i in range(300)], ["nasty", "vile thing"]
    rows, marks = [], []
    for i in range(1500):
        w = [rng.choice(plain) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            w[rng.randrange(30)] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(toxic)))
    rows += [(5000, None), (5001, ""), (5001, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*marks, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.digest(docs, labels).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out & (got.doc_id < 5000)]
    assert ((held.doc_id % 5 == 0) == (held.predicted == 1)).mean() > 0.98
    assert got[got.doc_id >= 5000].score.nunique() == 1
    none = toxicity.digest(docs, labels.limit(0)).toPandas()
    assert (none.score == 0.5).all()


def test_ftrl_equals_plain_python():
    rng = random.Random(6)
    rows = [(np.array(sorted(rng.sample(range(40), rng.randrange(1, 9)))), int(rng.random() < 0.4)) for _ in range(300)]
    z, n, w = collections.defaultdict(float), collections.defaultdict(float), {}

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - (toxicity.L1 if z[i] > 0 else -toxicity.L1)) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for at, y in rows:
            at = [*at.tolist(), toxicity.DIMENSIONS]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in at:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * w[i]
                n[i] += g * g
    got = toxicity.fit(rows, 3)
    assert np.flatnonzero(got).tolist() == sorted(i for i in z if weight(i)) and 0 < len(np.flatnonzero(got)) < 41
    assert all(abs(got[i] - weight(i)) < 1e-9 for i in z)


def test_features_of_texts():
    texts = ["One two-three  FOUR", "", None, "one two", "x"]
    doc, at = toxicity.features(pa.array(texts))
    n = [4, 0, 0, 2, 1]
    assert np.bincount(doc, minlength=5).tolist() == [max(0, k) + max(0, k - 1) + max(0, k - 2) for k in n]
    assert set(at[doc == 3]) <= set(at[doc == 0])


def test_toxicity_on_odd_tables(spark):
    docs = spark.createDataFrame([(1, "nasty"), (1, "nasty"), (1, "else"), (2, None), (None, "x")], "doc_id long, text string").withColumn("toxic", F.lit("t")).withColumn("score", F.lit(1)).withColumn("at", F.lit(2))
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 1, 0), (9, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("label"))
    got = toxicity.digest(docs, labels).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter({1: 3, 2: 1, None: 1}) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.digest(docs.limit(0), labels).count() == 0


# 5


def cut_words(texts):
    """Kept words of each text."""
    split = [words(t) for t in texts]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        out.append([x for x, g in zip(w, gone) if not g])
    return out


def brute_cut(rows):
    return collections.Counter((d, t if len(kept) == len(words(t)) else b" ".join(kept).decode()) for (d, t), kept in zip(rows, cut_words(t for _, t in rows)))


@pytest.mark.parametrize("piece", [4 << 20, 300])
def test_substring(spark, docs, rows, piece, monkeypatch):
    monkeypatch.setattr(text, "PIECE_BYTES", piece)
    want = collections.Counter()
    for r, kept in zip(rows, cut_words(r[1] for r in rows)):
        n = len(words(r[1]))
        want[r[0], n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()] += 1
    got = collections.Counter(map(tuple, substring.digest(docs, scratch(spark)).collect()))
    assert got == want
    odd = docs.withColumn("_all", F.lit(1)).withColumn("places", F.lit(b"x")).withColumn("_row", F.lit("r"))
    cleaned = substring.remove(odd, scratch(spark))
    assert cleaned.columns == odd.columns and cleaned.count() == len(rows)
    assert collections.Counter((r["doc_id"], r["text"]) for r in cleaned.collect()) == brute_cut([(r[0], r[1]) for r in rows])
    assert cleaned.where("text is not null and n_chars != length(text)").count() == 0


def test_parts_of_a_partition_change_nothing(spark, docs, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_PARTS", 4)
    for module in (jaccard, substring):
        monkeypatch.setattr(module, "BUCKET_BYTES", 300)
        monkeypatch.setattr(module, "GROUP_TOKENS" if module is jaccard else "GROUP_WORDS", 500)
    docs.write.parquet(str(tmp_path / "docs"))
    kept = spark.read.parquet(str(tmp_path / "docs"))
    assert store.parts_for(kept, 300) == 4 and store.subs_for(kept, 300, 4) > 3
    got = collections.Counter(map(tuple, jaccard.digest(kept, scratch(spark)).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute_components(rows)
    cleaned = substring.remove(kept, scratch(spark))
    assert collections.Counter((r["doc_id"], r["text"]) for r in cleaned.collect()) == brute_cut([(r[0], r[1]) for r in rows])


# 6


def test_language(spark):
    rng = random.Random(4)
    parts = {"aa": ["the", "ing", "tion", "and"], "bb": ["der", "sch", "ung", "ein"], "cc": ["que", "eau", "ment", "ais"]}
    say = lambda x, n: " ".join("".join(rng.choice(parts[x]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    docs = spark.createDataFrame([(i, say(x, 80), x) for i, x in enumerate(list(parts) * 30)] + [(900, None, "aa"), (901, "x", None)], "doc_id long, text string, lang string")
    pages, truth = [], {}
    for i in range(150):
        x = list(parts)[i % 3]
        truth[i] = x
        declared = x if i % 10 else "bb"
        pages.append((i, f"https://www.site{i % 6}.example.{x}/p", f'<!doctype html><html lang="{declared}-X"><head><script>var der="sch";</script></head><body><p>{say(x, 40)}</p></body></html>'))
    pages += [(500, None, None), (501, "nonsense", ""), (502, "http://h/", "<p>123</p>"), (0, *pages[0][1:])]
    got = language.digest(spark.createDataFrame(pages, "page_id long, url string, html string"), docs, scratch(spark)).toPandas()
    assert len(got) == len(pages) and got.confidence.between(0, 1).all()
    known = got[got.page_id < 500]
    assert (known.lang == known.page_id.map(truth)).mean() > 0.97 and known.accepted.mean() > 0.97
    assert not got[got.page_id >= 500].accepted.any()
    rows = docs.withColumn("source", F.lit("s")).withColumn("id", F.lit(1)).withColumn("host", F.lit(2))
    kept = language.accept(rows, scratch(spark))
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.collect()} >= set(range(90)) and 900 not in {r["doc_id"] for r in kept.collect()}
    empty = language.digest(spark.createDataFrame(pages, "page_id long, url string, html string"), docs.limit(0), scratch(spark))
    assert empty.where("lang is not null").count() == 0


def test_language_posterior_equals_plain_python(spark):
    rng = random.Random(8)
    names = ["aa", "bb", "cc"]
    say = lambda x, n: " ".join(x + rng.choice("aeiou") + x[0] for _ in range(n))
    docs = [(i, say(names[i % 3], 30), names[i % 3], "e") for i in range(30)] + [(0, None, "aa", "e")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, _lang string")
    languages, table = language.fit(frame)
    assert languages == names
    for x, row in zip(languages, table):
        counts = np.full(language.PLACES, 0.5)
        for _, t, lang, _ in docs:
            if lang == x and t:
                np.add.at(counts, language.trigrams(pa.array([t]))[1], 1)
        assert np.allclose(row, np.log(counts / counts.sum()), atol=1e-5)
    rows = []
    for i in range(200):
        x = rng.choice(names)
        said = x if rng.random() < 0.8 else rng.choice(names)
        rows.append((i, say(x, rng.choice([1, 2, 20])) if i % 9 else "", rng.choice([None, said, said.upper() + "-X", "zz"]), rng.choice([None, x, "org"]), h := rng.choice([None, "h1.d", "h2.d", "h3.e"]), h and h[3:]))
    got = {r["id"]: r for r in language.identify(spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string, domain string"), languages, table, scratch(spark)).collect()}
    fold = lambda d: d and d.split("-")[0].lower()
    lik, best = {}, {}
    for i, t, *_ in rows:
        at = language.trigrams(pa.array([t]))[1]
        lik[i] = [float(row[at].astype(float).sum()) for row in table]
        best[i] = names[int(np.argmax(lik[i]))] if len(at) else None
    count = lambda of: collections.Counter(best[r[0]] for r in rows if best[r[0]] and of(r))
    whole = count(lambda r: True)
    prior = {x: (whole[x] + 1) / (sum(whole.values()) + 3) for x in names}
    smooth = lambda c, p: {x: (c[x] + language.STRENGTH * p[x]) / (sum(c.values()) + language.STRENGTH) for x in names}

    def clue(k, value, of):
        mine, all_ = count(lambda r: of(r) == value), count(lambda r: of(r) is not None)
        return {x: (mine[x] + language.SMOOTH * sum(mine.values()) / max(1, sum(all_.values()))) / (all_[x] + language.SMOOTH) for x in names} if value is not None and sum(mine.values()) else dict.fromkeys(names, 1.0)

    for i, t, declared, suffix, host, domain in rows:
        base = prior if domain is None else smooth(count(lambda r: r[5] == domain), prior)
        p = base if host is None else smooth(count(lambda r: r[4] == host), base)
        d, s = clue(2, fold(declared), lambda r: fold(r[2])), clue(3, suffix, lambda r: r[3])
        logs = np.array([(v - max(lik[i])) * language.TEMPER + np.log(p[x]) + np.log(d[x]) + np.log(s[x]) for x, v in zip(names, lik[i])])
        post = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        assert got[i]["text_lang"] == best[i] and abs(got[i]["confidence"] - post.max()) < 1e-4
        assert got[i]["lang"] == names[int(post.argmax())] or np.sort(post)[-2] > post.max() - 1e-6
        assert got[i]["accepted"] == (best[i] is not None and got[i]["confidence"] >= language.ACCEPT)


def test_many_languages(spark):
    """The plan holds no expression a language, so two hundred of them take no longer to plan than three."""
    rng, lengths = random.Random(12), []
    for n in (3, 200):
        words = {f"l{k}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzàéîõüßñ") for _ in range(rng.randrange(3, 8))) for _ in range(12)] for k in range(n)}
        text_ = lambda name: " ".join(rng.choice(words[name]) for _ in range(60))
        docs = spark.createDataFrame([(3 * k + j, text_(name), name, None, 0) for k, name in enumerate(words) for j in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
        pages = spark.createDataFrame([(k, f"http://h{k % 5}.{name}.org/x", f"<html lang='{name}'><p>{text_(name)}</p></html>") for k, name in enumerate(words)], "page_id long, url string, html string")
        out = language.digest(pages, docs, scratch(spark))
        lengths.append(len(out._jdf.queryExecution().analyzed().toString()))
        got = {r["page_id"]: r["text_lang"] for r in out.collect()}
        assert np.mean([got[k] == name for k, name in enumerate(words)]) > 0.95
    assert lengths[1] < 6 * lengths[0]  # constants grow, expressions don't


def test_languages_on_odd_tables(spark):
    docs = spark.createDataFrame([(i, f"wort{i % 90} text", f"l{i % 90}") for i in range(180)] + [(7, "copy", "l1")] * 30, "doc_id long, text string, lang string")
    languages, table = language.fit(docs, sample=5)
    assert len(languages) == 90 and table.shape == (90, language.PLACES)  # no language is left out
    assert language.places_for(5000) * 5000 <= 2 * language.ENTRIES
    pages = spark.createDataFrame([], "page_id long, url string, html string").withColumn("lang", F.lit("x"))
    assert language.digest(pages, docs, scratch(spark)).count() == 0
    clash = spark.createDataFrame([(1, "http://a.b.l1/", "<html lang=l1>wort1 text</html>")], "page_id long, url string, html string")
    for c in ("id", "text", "declared", "grams", "loglik", "_m"):
        clash = clash.withColumn(c, F.lit(3))
    assert language.digest(clash, docs, scratch(spark)).columns == ["page_id", "text_lang", "lang", "confidence", "grams", "accepted"]


# 7 and 8


def vectors(spark, n=400, dim=16):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((n, dim))
    x[50:70] = x[50] + 0.05 * rng.standard_normal((20, dim))
    x[70:75] = x[70]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    bad = [(1000, None, 0), (1020, [0.0] * dim, 0), (1040, [float("nan")] + [1.0] * (dim - 1), 0), (1060, [None] + [1.0] * (dim - 1), 0), (1080, [1.0], 0), (1100, [float("inf")] * dim, 0)]
    return x, rows, spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").repartition(3)


def recall(x, got, k=20):
    found = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        score = x @ x[q]
        assert np.allclose(g.score, score[g.vec_id], rtol=0, atol=1e-12) and g["rank"].tolist() == list(range(1, k + 1))
        assert list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id)) and q not in set(g.vec_id)
        score[q] = -np.inf
        found += len(set(g.vec_id) & set(np.argsort(-score)[:k].tolist()))
    return found / (k * got.query_id.nunique())


def test_neighbours(spark):
    x, _, df = vectors(spark)
    got = neighbours.search(df, scratch(spark)).toPandas()
    assert set(got.query_id) == set(range(0, 400, 20))
    assert recall(x, got) >= 0.9
    assert neighbours.search(df.limit(0), scratch(spark)).count() == 0
    few = neighbours.search(df.where("vec_id < 5"), scratch(spark)).toPandas()
    assert sorted(few.vec_id) == [1, 2, 3, 4]


def test_neighbours_by_short_lists(spark, monkeypatch):
    """Short lists of half a per cent of the rows, several waves and blocks; without the codes nothing would be found."""
    monkeypatch.setattr(neighbours, "WAVE", 250)
    monkeypatch.setattr(neighbours, "ROWS", 1500)
    monkeypatch.setattr(neighbours, "QUERIES", 90)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((10_000, 24))
    x[7000:7030] = x[7000]
    df = spark.createDataFrame([(i, [float(v) for v in r], "c") for i, r in enumerate(x)], "vec_id long, embedding array<double>, list string").repartition(4)
    got = neighbours.search(df, scratch(spark), short=50).toPandas()
    assert got.query_id.nunique() == 500 and recall(x, got[got.query_id != 7000]) >= 0.9
    assert got[got.query_id == 7000].sort_values("rank").vec_id.tolist() == list(range(7001, 7021))  # of 29 equal ones the smallest ids
    real = neighbours.encode
    monkeypatch.setattr(neighbours, "encode", lambda v, books, beam=4: rng.permutation(real(v, books, beam)))
    books = neighbours.fit(x / np.linalg.norm(x, axis=1, keepdims=True))
    norms = np.linalg.norm(x, axis=1)
    for encode, least, most in ((real, 0.9, 1.0), (neighbours.encode, 0.0, 0.3)):
        codes = encode(x / norms[:, None], books)
        score = neighbours.scored(codes, norms.astype(np.float32), neighbours.tables(x[:100], books))
        score[np.arange(100), np.arange(100)] = -np.inf
        best = [sorted(np.argsort(-score[:, q])[:100].tolist(), key=lambda i, q=q: (-(x[i] @ x[q]), i))[:20] for q in range(100)]
        hits = [len(set(best[q]) & set(np.argsort(-np.where(np.arange(len(x)) == q, -np.inf, x @ x[q]))[:20].tolist())) for q in range(100)]
        assert least <= np.mean(hits) / 20 <= most


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_neighbours_do_not_depend_on_partitions_or_repeated_ids(spark, parts):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.standard_normal(8)]) for i in range(200)]
    rows += [rows[20], rows[20], rows[33], (40, [9.0] * 8), (60, [None] * 8), (60, [float("nan")] * 8)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        got = sorted(map(tuple, neighbours.search(df, scratch(spark), short=60).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    x = np.array([min(v for i, v in rows if i == k and None not in v and v[0] == v[0]) for k in range(200)])
    want = [(q, n + 1, c) for q in range(0, 200, 20) for n, c in enumerate(sorted((c for c in range(200) if c != q), key=lambda c, q=q: (-(x[c] @ x[q]), c))[:20])]
    assert [t[:3] for t in got] == want


@pytest.mark.parametrize("chunk", [1024, 4])
def test_caps(spark, chunk, monkeypatch):
    monkeypatch.setattr(caps, "CHUNK", chunk)
    x, rows, df = vectors(spark)
    got = {r["vec_id"]: r for r in caps.digest(df, scratch(spark)).collect()}
    assert len(got) == 406
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    near[70:75, 70:75] = ~np.eye(5, dtype=bool)
    forest = graph.Forest(400)
    for i, j in zip(*np.nonzero(near)):
        forest.union(int(i), int(j))
    assert all(got[i]["n_links"] == near[i].sum() and got[i]["component_id"] == forest.find(i) and got[i]["kept"] == (forest.find(i) == i) for i in range(400))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (1000, 1020, 1040, 1060, 1080, 1100))


def test_caps_of_repeated_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0], "a"), (1, [1.0, 0.0, 0.0], "a"), (1, [0.0, 1.0, 0.0], "b"), (2, [0.0, 1.0, 0.01], "b"), (3, [0.0, -0.0, 1.0], "c"), (4, [0.0, 0.0, 2.0], "c"), (None, [0.0, 1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, vector string").repartition(3)
    got = collections.Counter(map(tuple, caps.digest(df, scratch(spark)).select("vec_id", "n_links", "component_id").collect()))
    assert got == collections.Counter([(1, 1, 1), (1, 1, 1), (1, 2, 1), (2, 2, 1), (None, 2, 1), (3, 1, 3), (4, 1, 3)])


def test_caps_recall_at_the_threshold():
    rng, dim = np.random.default_rng(9), 64
    a, b = (rng.standard_normal((400, dim)) for _ in range(2))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    for n in (500, 50_000, 1_000_000):
        code = caps.ProductCode(dim, n)
        one, two = (set(zip(*(z.tolist() for z in code.decode(x)))) for x in (a, b))
        assert len({row for row, _ in one & two}) >= 396
        assert len(one) / 400 * n / code.words**code.parts < 4 * caps.FILL


# 9


def test_licenses(spark):
    texts = {
        1: "Licensed under CC BY-NC 4.0. and cc  by again", 2: "This work is licensed under the GNU General Public License, version 3.", 3: "nothing here", 4: None, 5: "",
        6: "All rights reserved\nReleased under the MIT license.", 7: "xcc by ccby CC\nBY", 8: "all-rights-reserved all rights", 9: "Under Apache License: licensed the version 2.0!",
    }
    docs = spark.createDataFrame([(k, v, 1, "l") for k, v in texts.items()] + [(3, "nothing here", 1, "l")], "doc_id long, text string, block int, label string")
    got = {r["doc_id"]: r for r in licenses.scan(docs, scratch(spark)).collect()}
    for k, t in texts.items():
        w = [x.decode() for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower((t or "").encode()))]
        places, labels = [], set()
        for p, name in licenses.PHRASES.items():
            p = p.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            labels |= {name} if at else set()
        r = got[k]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted(labels)))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
    assert got[1]["labels"] == "cc-by,cc-by-nc-4.0" and got[2]["labels"] == "gpl,gpl-3.0" and got[6]["labels"] == "mit,reserved" and got[9]["labels"] == "apache-2.0"
    assert got[3]["score"] == 0 and got[1]["score"] == 1


def test_licenses_across_lines(spark):
    wrap = lambda t, n: "\n# ".join(textwrap.wrap(t, n))
    notices = [x for x in licenses.NOTICES]
    texts = {
        0: ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that", {"bsd"}),
        1: (" * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not", {"mpl-2.0"}),
        2: ("released under\n\n the MIT\nlicense", {"mit"}),
        3: ("released x " + "y " * 40 + "\n under the mit license", set()),
        4: (wrap(notices[2][1], 30) + "\n\n" + wrap(notices[6][1], 25), {"cc-by-4.0", "cc-by-sa-4.0"}),
        5: ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0\nInternational License", set()),
        7: (wrap(notices[10][1], 50).replace("version 3", "version 2"), {"gpl-2.0"}),
        6: ("released " + "y " * 40 + " under the mit license", {"mit"}),
    }
    texts |= {100 + i: ("Aa bb\n" * 30 + wrap(t, 40) + "\nzz dd" * 30, {label}) for i, (label, t, *_) in enumerate(notices)}
    docs = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: set(r["labels"].split(",")) - set(r["base_labels"].split(",")) - {""} for r in licenses.scan(docs, scratch(spark)).collect()}
    assert got == {k: want for k, (_, want) in texts.items()}


def test_license_blocks_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = sorted({w for t in licenses.TEMPLATES.values() for w in t.split()})
    docs = [(i, "\n".join(" ".join(rng.sample(vocab, rng.randrange(3, len(vocab)))) for _ in range(4))) for i in range(40)]
    got = {(r["doc_id"], r["block"], r["label"], r["overlap"]) for r in licenses.blocks_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = set()
    for i, t in docs:
        for b, line in enumerate(t.split("\n")):
            for name, template in licenses.TEMPLATES.items():
                t_words = set(template.split())
                n = len(t_words & set(line.split()))
                if n >= licenses.THRESHOLD * len(t_words):
                    want.add((i, b, name, n))
    assert got == want and want


# 10


def test_archives(spark):
    pages = [(5, "http://a/", "<p>x</p>"), (2, "http://b/\r\nX: y", "<p>x</p>"), (9, None, None), (7, "u", ""), (3, "http://ü/", "ä" * 70000), (3, "http://ü/", "ä" * 70000), (None, "n", "<p>x</p>")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, sha int").repartition(3)
    got = collections.Counter(map(tuple, archives.round_trip(df, scratch(spark)).collect()))
    want, first = collections.Counter(), {5: 2, 2: 2, 9: 7, 7: 7, 3: 3, None: 2}
    for k, _, html in pages:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        same = first[k] == k
        want[k, len(data), digest, "response" if same else "revisit", None if same else first[k]] += 1
    assert got == want
    assert archives.round_trip(df.limit(0), scratch(spark)).count() == 0


def test_archives_reject_damage():
    import io

    data = archives.record(1, "u", b"payload", None)
    assert next(archives.read(io.BytesIO(data)))[0] == 1
    with pytest.raises(archives.WarcError):
        list(archives.read(io.BytesIO(data[:-9])))
    big = archives.record(2, "u", b"x" * 3_000_000, None)
    both = list(archives.read(io.BytesIO(big + data)))
    assert [(r[0], len(r[2]), r[3]) for r in both] == [(2, 3_000_000, 3_000_000), (1, 7, 7)]
    assert [r[2] for r in archives.read(io.BytesIO(big + data), payloads=False)] == [None, None]
    member = archives.Inflater(io.BytesIO(big))
    assert member.open() and max(iter(lambda: len(member.some()), 0)) <= archives.BLOCK
    raw = zlib.decompress(data, 31)
    z = zlib.compressobj(wbits=31)
    with pytest.raises(archives.WarcError):
        list(archives.read(io.BytesIO(z.compress(raw.replace(b"payload\r", b"paylaod\r")) + z.flush())))
    for wrong in (raw.replace(b"Length: 7", b"Length: 8"), raw + b"x", raw[:-4], b"HTTP" + raw[4:]):
        z = zlib.compressobj(wbits=31)
        with pytest.raises(archives.WarcError):
            list(archives.read(io.BytesIO(z.compress(wrong) + z.flush())))


# the pipeline


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    kept = docs.withColumn("_row", F.lit(5)).withColumn("_gone", F.lit("g")).withColumn("_all", F.lit(1)).withColumn("places", F.lit(2))
    kept.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    steps = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        steps.append(now := spark.read.parquet(str(tmp_path / str(k))))
        assert k == 4 or now.columns == kept.columns
    rows = [[(r["doc_id"], r["text"]) for r in d.collect()] for d in steps[:4]]
    # language: only texts without letters or in no known language go
    assert collections.Counter(rows[0]) <= collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) and all(t and t.strip() for _, t in rows[0])
    # near copies: one of each group
    assert collections.Counter(d for d, _ in rows[1]) == collections.Counter({k[0]: n for k, n in brute_components(rows[0]).items() if k[0] == k[2]})
    # passages
    assert collections.Counter(rows[2]) == brute_cut(rows[1])
    # the mix: whole copies only, as many words as the digest says
    taken = collections.Counter(rows[3])
    assert set(taken) <= set(rows[2]) and max(taken.values()) <= 2
    assert sum(len(words(t)) * n for (_, t), n in taken.items()) == mixing.digest(steps[2], scratch(spark)).agg(F.sum("taken")).first()[0]
    # packing: every copy's ids, whole
    tokenizer = packing.Encoder().tokenizer
    want = collections.Counter({(d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()): 0 for d, t in taken})
    for (d, t), n in taken.items():
        want[d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()] += n
    pieces = sorted(((repr(r["doc_id"]), r["sequence_id"], r["offset"], r["start"], r["ids"]) for r in now.collect()), key=lambda r: r[:4])
    assert sum(len(p[4]) for p in pieces) == sum(len(b) * n for (_, b), n in want.items())
    assert collections.Counter(p[4] for p in pieces if p[3] == 0) == sum((collections.Counter({b[: 4 * 2048]: n}) for (_, b), n in want.items()), collections.Counter())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count() > 0
    assert now.where("ids is null or length(ids) != 4 * length").count() == 0
    (tmp_path / "none").mkdir()
    kept.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_pieces_of_encoder_and_features(monkeypatch):
    rng = random.Random(12)
    column = pa.array([" ".join(rng.choice(["naïve", "idiot", "don't", "x.y", "日本語", "abc"]) for _ in range(400))])
    e = packing.Encoder()
    whole, (doc, at) = e.encode(column), toxicity.features(column)
    for module in (text, packing):
        monkeypatch.setattr(module, "PIECE_BYTES", 100)
    cut = e.encode_pieces(column)
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()
    assert toxicity.features(column)[1].tolist() == np.unique(at).tolist() and not doc.any()


def test_a_very_long_text(spark):
    rng = random.Random(13)
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(600_000)) + " all rights reserved"
    assert len(long) > text.PIECE_BYTES
    given = [(1, long), (2, long + " end"), (3, "short text of seven words in all"), (4, " ".join(long.split()[300_000:300_040]))]
    docs = spark.createDataFrame(given, "doc_id long, text string").withColumn("source", F.lit("s")).withColumn("lang", F.lit("en")).repartition(2)
    got = {r["doc_id"]: r for r in jaccard.digest(docs, scratch(spark)).collect()}
    n = len(long.split())
    assert [got[i]["component_id"] for i in (1, 2, 3, 4)] == [1, 1, 3, 4] and got[1]["n_shingles"] == n - 4 and got[2]["n_shingles"] == n - 3
    cut = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.digest(docs, scratch(spark)).collect()}
    assert cut == {1: (n, n), 2: (n + 1, n), 3: (7, 0), 4: (40, 40)}
    packed = packing.pack(docs, scratch(spark)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.max("piece").alias("p")).collect()
    ids = packing.Encoder().encode(pa.array([t for _, t in given]))[1]
    assert {r["doc_id"]: (r["n"], r["k"], r["p"]) for r in packed} == {i + 1: (b - a + 1, -(-(b - a + 1) // 2048), -(-(b - a + 1) // 2048) - 1) for i, (a, b) in enumerate(zip(ids[:-1].tolist(), ids[1:].tolist()))}
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 5)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.digest(docs, labels).collect())
    scan = {r["doc_id"]: r for r in licenses.scan(docs, scratch(spark)).collect()}
    assert (scan[1]["n_words"], scan[1]["n_base"], scan[1]["first_word"], scan[1]["labels"]) == (n, 1, n - 3, "reserved") and scan[3]["n_base"] == 0
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b/").alias("url"), F.col("text").alias("html"))
    back = {r["page_id"]: r for r in archives.round_trip(pages, scratch(spark)).collect()}
    assert back[1]["payload_bytes"] == len(long) and back[1]["payload_digest"] == base64.b32encode(hashlib.sha1(long.encode()).digest()).decode()
    assert language.digest(pages, docs, scratch(spark)).count() == 4
    assert mixing.digest(docs, scratch(spark)).where("doc_id = 1").first()["size"] == n


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for f in (packing.pack, jaccard.digest, mixing.digest, substring.digest, licenses.scan):
        assert f(none, scratch(spark)).count() == 0
    assert caps.digest(spark.createDataFrame([], "vec_id long, embedding array<float>"), scratch(spark)).count() == 0
