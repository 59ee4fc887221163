"""Operators that work range by range, bucket by bucket or by an index, against brute force."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from cases import BROKEN, EXPECTED, FILES, ISSUES, PACK, SAMPLES, SOURCES
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import commands
from lodestone.functions import feedback, search
from lodestone.functions.patterns import lean, required, sound
from lodestone.operators import dashboard, detect, findings, intervals, metrics, ranges, rule_index
from lodestone.plans import catalogue
from lodestone.schemas import FEEDBACK, FINDING, RULE
from lodestone.sources import elements, files, rules
from lodestone.sources.store import Conflict, Manifest, Store
from lodestone.streaming import sessions, triggers

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# fixed cases


def test_fixed_values_and_sources(spark):
    base = rules.base_rules(spark)
    got = detect.match_rules(spark.createDataFrame(SAMPLES, "id int, value string"), base).select("id", "rule_id").collect()
    assert {tuple(r) for r in got} == {(k, r[0]) for k, v in SAMPLES for r in rules.BASE_RULES if re.search(re.sub(r"\$$", r"\\Z", r[2]), v)}
    issues = detect.scan_sources(spark.createDataFrame(FILES, "path string, content string"), base)
    named = issues.select("file", "line", "column", "rule_id", "context", "function_name", "complexity", "nesting_depth", "function_loc")
    assert sorted(map(repr, map(tuple, named.collect()))) == sorted(map(repr, ISSUES))
    out = metrics.literal_metrics(spark.createDataFrame(SOURCES, "path string, content string"))
    assert sorted(map(repr, map(tuple, out.select("path", "value", "function_name", "complexity", "nesting_depth", "function_loc").collect()))) == sorted(map(repr, EXPECTED))


def test_fixed_packs(spark):
    texts = spark.createDataFrame([(f"p{k}", t) for k, t in enumerate([PACK, *BROKEN])], "path string, content string")
    got = [tuple(r) for r in rules.rules_from_text(texts, "user").orderBy("ord").select("id", "pattern", "enabled", "ord", "origin").collect()]
    assert got == [("A", "x", False, 0, "user"), ("B", "y", None, 3, "user"), ("A", "z", None, 4, "user")]
    why = {(r["path"], r["ord"]): r["reason"] for r in rules.pack_elements(texts).where("reason is not null").collect()}
    assert why == {("p0", 1): "not an object", ("p0", 2): "not an object", ("p2", -1): "not a list", ("p3", -1): "not JSON"}


# rules by an index


PATTERNS = [
    ("abcd", {"abcd"}), ("^abc$", {"abc"}), ("a.cd", None), ("ab+cde", {"cde"}), ("abcx?de", {"abc"}), ("(?:in|re)?word", {"word"}), ("(abc|defg)x", {"abc", "defg"}), ("(abc|d)xyz", {"xyz"}), ("(abc|d)", None),
    (r"ab\.cd", {"ab.cd"}), (r"a\dbcd", {"bcd"}), (r"abc\bdef", {"abcdef"}), ("a{2}bcd", {"bcd"}), ("(?:abcd){0,3}efg", {"efg"}), ("[abc]defg", {"defg"}), ("(?i)abcd", None), (r"\Qabcd\E", None), ("(?=abcd)", None), (r"abc\1", None), ("abc|", None), ("", None), ("[a[b]]cde", None), (r"\x41bcd", None), ("ab(cd", None),
]


@pytest.mark.parametrize("pattern, texts", PATTERNS)
def test_required_texts(pattern, texts):
    assert required(pattern) == (None if texts is None else frozenset(texts))


@pytest.mark.parametrize("pattern, good", [("abc[.,]?$", True), ("[a-z]+x", True), ("[z-a]", False), ("abc)", False), ("*a", False), ("a{5,2}", False), (r"\p{Foo}", False), ("[a&&b]", False), ("[]a]", False), ("a]", False)])
def test_sound_patterns(pattern, good):
    assert sound(pattern) == good


def test_many_rules_by_index(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé😀") for _ in range(rng.randrange(3, 7)))
    shapes = ["^{}", "{}$", "(?:{}|{})x?", "[ab]{}", "{}.*{}", "{}", "(?i){}", "[0-9]{{2}}", "{}+", "({})?a"]
    made = [(f"R{k}", None, rng.choice(shapes).format(word(), word()), None, None, True) for k in range(5000)] + [("bad", None, "(", None, None, True), ("off", None, "abc", None, None, False)]
    values = [" ".join(word() for _ in range(rng.randrange(0, 5))) for _ in range(150)] + [None, "", "ab", "abc" * 400, "aaa", "aaa"]
    found = spark.createDataFrame([(k, v, 1) for k, v in enumerate(values)], "id int, value string, rank int").repartition(3)
    good, bad = rules.compiled(spark.createDataFrame(made, RULE))
    assert [b["rule_id"] for b in bad] == ["bad"] and len(good) == 5000
    hit = rule_index.hits(found, good, detect.UNROLLED)
    assert "NestedLoop" not in plan(hit) and "Cartesian" not in plan(hit)
    got = {(r["id"], h["rule_id"]) for r in hit.collect() for h in r["_hits"] or []}
    parts = [found.withColumn("_h", rule_index.unrolled(good[i : i + 250])) for i in range(0, 5000, 250)]
    want = {(r["id"], h["rule_id"]) for p in parts for r in p.collect() for h in r["_h"] or []}
    assert got == want and len(want) > 500
    assert hit.count() == len(values)
    order = [h["rank"] for h in hit.where("id = 153").first()["_hits"]]
    assert order == sorted(order)


def test_too_many_rules_are_counted_first(spark, monkeypatch):
    monkeypatch.setattr(rules, "RULES", 5)
    with pytest.raises(ValueError):
        rules.compiled(spark.range(6).select(*[F.col("id").cast("string").alias(c) for c in ("id", "name", "pattern", "severity", "description")], F.lit(True).alias("enabled")))


@pytest.mark.parametrize("letters, chunk", [("ab", 64), ("abcdeé😀", 1 << 16), ("abcdefghij", 5)])
def test_search_for_texts(letters, chunk, monkeypatch):
    monkeypatch.setattr(search, "CHUNK", chunk)
    rng = random.Random(chunk)
    word = lambda a, b: "".join(rng.choice(letters) for _ in range(rng.randrange(a, b)))
    for most in (5, 9, 20):
        texts = [word(3, most) for _ in range(30)] + ["ab" * 200, "ab" * 128 + "x"]
        values = [None, "", *[word(0, 60) for _ in range(60)], "ab" * 300, "c" + "ab" * 199, None]
        owners = np.array([rng.randrange(20) for _ in texts])
        value, owner = search.Search(search.Texts.of(pa.array(texts), owners)).pairs(pa.array(values).slice(2))
        held = lambda v, t: v is not None and t.encode()[: search.LONGEST] in v.encode()
        assert list(zip(value.tolist(), owner.tolist())) == sorted({(k, o) for k, v in enumerate(values[2:]) for t, o in zip(texts, owners.tolist()) if held(v, t)})
    assert not len(search.Search(search.Texts.of(pa.array([], pa.string()), np.zeros(0, np.int64))).pairs(pa.array(["abc"]))[0])


LEANER = [("(?:in|re)?word", "word"), (r"[a-z]*word(?:s|ed)?[.,]?\z", r"word(?:s|ed)?[.,]?\z"), ("^a?bc", "^a?bc"), ("a*+bcd", "a*+bcd"), ("x{0,3}?abc.{0}", "abc"), ("x{1,3}abc", "x{1,3}abc"), ("a?b|c", "a?b|c"), ("a?", "a?"), ("(?i)a?bc", "(?i)a?bc")]


@pytest.mark.parametrize("pattern, leaner", LEANER)
def test_lean_patterns_are_found_in_the_same_values(spark, pattern, leaner):
    assert lean(pattern) == leaner
    rng = random.Random(6)
    values = spark.createDataFrame([("".join(rng.choice(["a", "b", "bc", "d", "x", "abc", "in", "word", "s", ".", "Z", " "]) for _ in range(rng.randrange(5))),) for _ in range(300)], "value string")
    assert values.where(F.rlike("value", F.lit(pattern)) != F.rlike("value", F.lit(leaner))).count() == 0


def test_only_patterns_whose_text_stands_in_a_value_are_tried(spark):
    """Words of four syllables share their trigrams, so all rules met all values by these."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice(["the", "ti", "on", "er", "ing", "an", "ed"]) for _ in range(n))
    words, values = sorted({word(4) for _ in range(1500)}), [" ".join(word(rng.randrange(1, 9)) for _ in range(20)) for _ in range(200)]
    found = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, value string")
    patterns = spark.createDataFrame([(k, f"{w}$", [w]) for k, w in enumerate(words)], "no long, pattern string, texts array<string>")
    tried = rule_index._candidates(found, rule_index.Wave.of(patterns.toArrow()))
    assert {(r["id"], m["no"]) for r in tried.collect() for m in r["_may"]} == {(k, n) for k, v in enumerate(values) for n, w in enumerate(words) if w in v}
    out = detect.match_rules(found, spark.createDataFrame([(w, None, f"(?:re)?{w}(?:s|ed)?$", None, None, True) for w in words], RULE))
    assert sorted(map(tuple, out.select("id", "rule_id").collect())) == sorted((k, w) for k, v in enumerate(values) for w in words if re.search(f"{w}(?:s|ed)?$", v))
    assert "Exchange hashpartitioning" not in plan(out) and "NestedLoop" not in plan(out)


def test_rules_stay_a_table_and_share_their_patterns(spark, monkeypatch):
    """More rules than may reach the driver as a list: each pattern is tried once, and every rule in use that has it is found."""
    monkeypatch.setattr(rules, "RULES", 5)
    patterns = [r"key: 1\d*", "^none$", "(", "(?i)KEY", "", None]
    made = [(f"R{k}", f"n{k}" if k % 3 else "", patterns[k % 6], "error" if k % 2 else None, None, None if k % 5 else False, k // 7, k % 2) for k in range(300)]
    table = spark.createDataFrame(made, T.StructType([*RULE.fields]).add("ord", T.IntegerType()).add("priority", T.IntegerType())).repartition(5)
    found = spark.createDataFrame([(0, "a key: 17"), (1, "none"), (2, "other"), (3, None), (4, "none\n"), (5, "none")], "id int, value string")
    holds = {r"key: 1\d*": {0}, "^none$": {1, 5}, "(": set(), "(?i)KEY": {0}, "": {0, 1, 2, 4, 5}, None: {0, 1, 2, 4, 5}}
    got = [tuple(r) for r in detect.match_rules(found, table).select("id", "rule_id", "rule_name", "severity", "rank").collect()]
    used = [r for r in made if r[5] is None]
    want = {(i, r[0], r[1] or r[0], r[3] or "warning") for r in used for i in holds[r[2]]}
    assert {g[:4] for g in got} == want and len(got) == len(want)
    place = {r[0]: (r[7], r[6]) for r in made}
    by_rank = [place[r] for _, r in sorted({(g[4], g[1]) for g in got})]
    assert by_rank == sorted(by_rank) and 0 <= min(g[4] for g in got) and max(g[4] for g in got) < len(used)
    first = detect.match_rules(found, table, first_only=True).select("id", "rule_id").collect()
    assert {tuple(r) for r in first} == {min((g[4], (g[0], g[1])) for g in got if g[0] == i)[1] for i in (0, 1, 2, 4, 5)}
    none = detect.detected(found.withColumn("context", F.lit("")), table.where("pattern = '^none$'"), unrolled=3).select("id", "rule_id").collect()
    assert {r["id"] for r in none} == {1, 5} and len(none) == 2 * sum(r[2] == "^none$" for r in used)
    odd = [r for r in made if r[2] in ("^none$", "(")]
    some = spark.createDataFrame(odd, table.schema)
    tokens = spark.createDataFrame([(0, "apiToken", "q8Zr2LmX0pVw7Tn"), (1, "", "none"), (2, "", "q")], "id int, context string, value string")
    assert {(r["id"], r["rule_id"]) for r in detect.detected(tokens, some, unrolled=3).collect()} == {(0, detect.HEURISTIC_ID)} | {(1, r[0]) for r in odd if r[2] == "^none$" and r[5] is None}


def test_patterns_go_over_the_values_in_waves(spark, monkeypatch):
    """More patterns than go to all tasks at once, with and without a text: every wave is small, and no match is lost."""
    waves, of = [], rule_index.Wave.of
    for name, value in (("WAVE", 4000), ("TRIED", 60), ("UNROLLED", 20), ("SEARCHED", 40), ("SENT", 3)):
        monkeypatch.setattr(rule_index, name, value)
    monkeypatch.setattr(rules, "RULES", 5)
    monkeypatch.setattr(rule_index.Wave, "of", lambda rows: waves.append(rows.num_rows) or of(rows))
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(3, 6)))
    patterns = sorted({rng.choice(["^{}", "{}$", "[ab]?{}", "(?:{}|{})x?", "(?i){}"]).format(word(), word()) for _ in range(500)})
    values = [" ".join(word() for _ in range(rng.randrange(5))) for _ in range(80)] + [None, ""]
    found = spark.createDataFrame(list(enumerate(values)), "id int, value string").repartition(2)
    got = detect.match_rules(found, spark.createDataFrame([(p, None, p, None, None, True) for p in patterns], RULE)).select("id", "rule_id").collect()
    assert sorted(map(tuple, got)) == sorted((k, p) for k, v in enumerate(values) for p in patterns if v is not None and re.search(p, v))
    assert len(waves) > 3 and max(waves) < 120 and sum(waves) == sum(p[:4] != "(?i)" for p in patterns)


# intervals


@pytest.mark.parametrize("hot", [False, True])
def test_best_interval(spark, hot):
    rng = random.Random(5)
    file = lambda: "f0" if hot or rng.random() < 0.5 else rng.choice(["f1", "f2", None])
    spans = [(file(), s, s + rng.choice([-1, 0, 1, 3, 17, 64, 300]), k) for k, s in enumerate(rng.randrange(-200, 900) for _ in range(250))] + [("f0", None, 5, 900), ("f1", -5000, 5000, 901)]
    points = [(file(), k, rng.choice([None, *range(-300, 1000)])) for k in range(400)] + [("f0", 1000, 17), ("f0", 1000, 17)]
    x = spark.createDataFrame(spans, "file string, start int, end int, name int")
    p = spark.createDataFrame(points, "file string, point_id int, offset int")
    rank = F.struct((F.col("end") - F.col("start")).alias("size"), "start", "name")
    got = {(r["file"], r["point_id"], r["offset"]): tuple(r["_best"]) for r in intervals.best(p, x, ["file"], "offset", "start", "end", rank).collect()}
    want = {}
    for f, k, at in points:
        held = [(e - s, s, n) for g, s, e, n in spans if f is not None and g == f and at is not None and s is not None and s <= at <= e]
        if held:
            want[f, k, at] = min(held)
    assert got == want
    assert intervals.best(p, x.limit(0), ["file"], "offset", "start", "end", rank).count() == 0


def test_a_point_meets_one_row_a_level(spark):
    """A thousand nested intervals around every point: bins keep their best one, so points don't meet them all."""
    x = spark.range(1000).select(F.lit("f").alias("file"), F.col("id").alias("start"), (4000 - F.col("id")).alias("end"), F.col("id").alias("name"))
    p = spark.range(1000, 3000).select(F.lit("f").alias("file"), F.col("id").alias("point_id"), F.col("id").alias("offset"))
    out = metrics.enclosing(p, x)
    assert {r["name"] for r in out.collect()} == {999} and out.count() == 2000


# ranges


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_ordinal(spark, parts):
    rows = [(f"f{k % 17}", k * 7919 % 1000, k) for k in range(1000)]
    df = spark.createDataFrame(rows, "file string, line int, id int").repartition(parts + 2)
    got = {r["id"]: r["ord"] for r in ranges.ordinal(df, ["file", "line"], 50, parts=parts).collect()}
    assert got == {i: 50 + k for k, (_, _, i) in enumerate(sorted(rows))}
    assert ranges.ordinal(df.limit(0), ["file"]).count() == 0


@pytest.mark.parametrize("keys, span, age, parts", [(1, 60_000, 300, 7), (3, 5000, 37, 9), (1, 200, 50, 6), (40, 1000, 10, 5), (2, 90_000, 80_000, 8), (1, 50, 1, 4), (1, 50, 0, 4)])
def test_throttle_and_bursts_over_many_ranges(spark, keys, span, age, parts):
    rng = random.Random(keys * span + age)
    polls = [(rng.randrange(keys) if rng.random() > 0.1 or keys == 1 else None, rng.randrange(-span, span)) for _ in range(1500)] + [(0, 5)] * 300
    df = spark.createDataFrame(polls, "key int, t long").repartition(5)
    want, last = collections.Counter(), {}
    for k, t in sorted(polls, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        passed = k not in last or t - last[k] >= age
        last[k] = t if passed else last[k]
        want[k, t, passed] += 1
    assert collections.Counter(map(tuple, triggers.throttle(df, age, parts).collect())) == want
    edits = [(None if k is None else f"w{k}", t, rng.choice(["d1", "d2", None])) for k, t in polls]
    e = spark.createDataFrame(edits, "workspace string, us long, doc string").select("workspace", F.timestamp_micros("us").alias("ts"), "doc").repartition(3)
    found = sessions.bursts(e, f"{age} microseconds", parts)
    assert "Window" not in plan(found)
    bursts: list[tuple] = []
    for w, t, d in sorted(edits, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2] is not None, r[2] or "")):
        if bursts and bursts[-1][0] == w and t - bursts[-1][2] <= age:
            bursts[-1] = (w, bursts[-1][1], t, d, bursts[-1][4] + 1)
        else:
            bursts.append((w, t, t, d, 1))
    got = found.select("workspace", F.unix_micros("first_ts"), F.unix_micros("last_ts"), "doc", "edits").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(bursts)


def test_one_timer_is_shared_out(spark):
    """All events as polls of one timer: several tasks have rows, and the result is that of one pass."""
    e = spark.read.parquet(f"{DATA}/events.parquet").select(F.lit("t").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    out = triggers.throttle(e, parts=6)
    sizes = [len(p) for p in out.rdd.glom().collect()]
    assert sum(n > 0 for n in sizes) >= 3
    times, last = sorted(r["t"] for r in e.collect()), None
    want = set()
    for t in times:
        if last is None or t - last >= triggers.THROTTLE_MS:
            want.add(t)
            last = t
    assert {r["t"] for r in out.where("passed").collect()} == want


def test_empty_ranges(spark):
    none = spark.createDataFrame([], "key string, t long")
    assert triggers.throttle(none, 5, 3).count() == 0
    edits = spark.createDataFrame([], "ts timestamp, doc string")
    assert triggers.debounce(edits).count() == 0


# streaming state


def test_throttle_stream_goes_on_after_a_restart(spark, tmp_path):
    age, hours = triggers.THROTTLE_MS, 3_600_000
    polls = [(f"k{k % 3}", h * hours + k) for k, h in enumerate([0, 1, 2, 13, 15, 16, 30, 26, 40, 43, 52, 70])]
    for half in (polls[:6], polls[6:]):
        spark.createDataFrame(half, "key string, t long").coalesce(1).write.mode("append").parquet(str(tmp_path / "polls"))
        live = spark.readStream.schema("key string, t long").parquet(str(tmp_path / "polls"))
        out = triggers.throttle_stream(live, age).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out"))
        assert out.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = {(r["key"], r["t"], r["passed"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in triggers.throttle(spark.createDataFrame(polls, "key string, t long"), age).collect()}


def test_throttle_stream_polls_by_its_own_timer(spark, tmp_path):
    """A key that polled once is polled again by the clock, and let through when its age has passed."""
    spark.createDataFrame([("k", 0)], "key string, t long").write.parquet(str(tmp_path / "polls"))
    live = spark.readStream.schema("key string, t long").parquet(str(tmp_path / "polls"))
    out = triggers.throttle_stream(live, 1000, ttl_ms=60_000, every_ms=500).writeStream.format("memory").queryName("timed").outputMode("append")
    q = out.option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(60):
            q.awaitTermination(1)
            kinds = {(r["kind"], r["passed"]) for r in spark.table("timed").collect()}
            if ("timer", True) in kinds and ("timer", False) in kinds:
                break
    finally:
        q.stop()
    assert {("poll", True), ("timer", True), ("timer", False)} <= kinds


# the store


def finding(file, k, rule="R"):
    return (k, file, k, 1, None, rule, "m", "warning", None, None, None, None)


def rows_of(store):
    return sorted((r["file"], r["rule_id"], r["ord"]) for r in store.read().collect())


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"), FINDING, buckets=8)
    first = spark.createDataFrame([finding(f"f{k % 20}", k) for k in range(60)], FINDING)
    s.upsert(first, first.select("file"), commands.ORDER)
    return s


def test_store_touches_only_its_buckets(spark, store):
    before = store.manifest()
    new = spark.createDataFrame([finding("f3", 0, "N")], FINDING)
    assert store.upsert(new, spark.createDataFrame([("f3",), ("f4",)], "file string"), commands.ORDER)
    after = store.manifest()
    touched = {r[0] for r in spark.createDataFrame([("f3",), ("f4",)], "file string").select(store._bucket(8)).collect()}
    assert {b for b in set(before.live) | set(after.live) if before.live.get(b) != after.live.get(b)} <= touched
    got = rows_of(store)
    assert [r for r in got if r[0] == "f3"] == [("f3", "N", 60)] and not [r for r in got if r[0] == "f4"] and len(got) == 60 - 6 + 1
    assert after.next == 61


@pytest.mark.parametrize("stop", ["_stage", "_commit", "_sweep", "half"])
def test_store_survives_a_stop_at_any_step(spark, store, stop, monkeypatch):
    old = rows_of(store)
    new, scanned = spark.createDataFrame([finding("f3", 0, "N")], FINDING), spark.createDataFrame([("f3",)], "file string")

    def stopped(*args):
        if stop == "half":  # the manifest's file was opened, not finished
            out = store._fs.create(store._at("manifest", f"{args[0].version:012d}.json"), False)
            out.write(args[0].text()[:20].encode())
            out.close()
        if stop == "_stage":
            Store._stage(store, *args)
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, "_commit" if stop == "half" else stop, stopped)
        with pytest.raises(KeyboardInterrupt):
            store.upsert(new, scanned, commands.ORDER)
    changed = [r for r in old if r[0] != "f3"] + [("f3", "N", 60)]
    assert rows_of(store) == (sorted(changed) if stop == "_sweep" else old)
    assert store.upsert(new, scanned, commands.ORDER)
    assert [r[:2] for r in rows_of(store)] == [r[:2] for r in sorted(changed)]


def test_store_takes_a_batch_once_and_refuses_a_second_writer(spark, store, monkeypatch):
    new, scanned = spark.createDataFrame([finding("f3", 0, "N")], FINDING), spark.createDataFrame([("f3",)], "file string")
    assert store.upsert(new, scanned, commands.ORDER, ("watch", 4))
    now = rows_of(store)
    assert not store.upsert(new, scanned, commands.ORDER, ("watch", 4)) and not store.upsert(new, scanned, commands.ORDER, ("watch", 3))
    assert rows_of(store) == now
    m = store.manifest()
    with pytest.raises(Conflict):
        store._commit(Manifest(m.version, 8, m.live, m.next, m.batches))
    store.replace(store.read().where("file = 'f3'"))
    assert [r[0] for r in rows_of(store)] == ["f3"] and store.manifest().batches == {"watch": 4}


def test_watch_equals_scan_and_replays_change_nothing(spark, tmp_path):
    ws, src = str(tmp_path / "ws"), tmp_path / "s r%c"
    src.mkdir()
    for name, text in FILES[:2]:
        (src / name.replace("lib/", "")).write_text(text)
    (src / "a b+c%20.dart").write_text(FILES[0][1])
    commands.update(spark, ws, *[rules.Pack(rules.base_rules(spark), rules.Heuristics())] * 2, remote=None, now_ms=0)
    commands.watch(spark, ws, str(src), str(tmp_path / "cp"), read={"maxFilesPerTrigger": 1}).awaitTermination(120)
    columns = ["file", "line", "column", "rule_id"]
    live = sorted(map(tuple, files.read_findings(spark, f"{ws}/findings").select(*columns).collect()))
    version = files.findings_store(spark, f"{ws}/findings").manifest().version
    commands.watch(spark, ws, str(src), str(tmp_path / "cp")).awaitTermination(120)
    assert files.findings_store(spark, f"{ws}/findings").manifest().version == version
    again = files.read_sources(spark, str(src))  # a batch that is run again
    commands.scanned(ws, again, ("watch", 0))
    assert files.findings_store(spark, f"{ws}/findings").manifest().version == version
    other = str(tmp_path / "other")
    commands.update(spark, other, *[rules.Pack(rules.base_rules(spark), rules.Heuristics())] * 2, remote=None, now_ms=0)
    commands.scan(spark, other, str(src))
    assert live == sorted(map(tuple, files.read_findings(spark, f"{other}/findings").select(*columns).collect()))
    assert {r[0] for r in live} == {str(src / n) for n in ("a.dart", "b.dart", "a b+c%20.dart")}
    assert commands.start(spark, other) and files.read_findings(spark, f"{other}/findings").count() == 0 and not commands.start(spark, other)


def test_top_lists_do_not_depend_on_partitions(spark):
    sources = catalogue._dart(spark, DATA)
    got = []
    for n in (2, 7):
        issues = detect.scan_sources(sources.repartition(n), rules.base_rules(spark))
        ranked = ranges.ordinal(findings.to_findings(issues), commands.ORDER, parts=n)
        got.append([dashboard.top_counts(ranked, F.col("file")).collect(), dashboard.hotspots(ranked).collect()])
    assert got[0] == got[1]


# JSON and the cache


def test_elements(spark):
    long_ = '[{"id":"' + "x" * 200_000 + '"}]'
    texts = [("a", '[{"id":"A","enabled":false},3,"s",null,{"id":5,"pattern":"y"},{"id":null},[1]]'), ("b", "[]"), ("c", "{}"), ("d", "[1"), ("e", None), ("f", ""), ("g", long_)]
    df = spark.createDataFrame([(*t, 1) for t in texts], "path string, content string, ord2 int")
    strict = {(r["path"], r["ord"]): (r["value"] and r["value"]["id"], r["reason"]) for r in elements.lists(df, RULE).collect()}
    assert strict == {
        ("a", 0): ("A", None), ("a", 1): (None, "not an object"), ("a", 2): (None, "not an object"), ("a", 3): (None, "not an object"), ("a", 4): (None, "field id is not string"),
        ("a", 5): (None, None), ("a", 6): (None, "not an object"), ("c", -1): (None, "not a list"), ("d", -1): (None, "not JSON"), ("f", -1): (None, "not JSON"), ("g", 0): ("x" * 200_000, None),
    }
    loose = {(r["path"], r["ord"]): r["value"] for r in elements.lists(df, RULE, strict=False).collect()}
    assert loose["a", 4]["id"] is None and loose["a", 4]["pattern"] == "y"
    replies = spark.createDataFrame([(1, '{"why":"w","fix":["a","b"]}'), (2, '{"fix":"no"}'), (3, "x"), (4, None)], "id int, content string")
    got = {r["id"]: (r["value"] and (r["value"]["why"], r["value"]["fix"]), r["reason"]) for r in elements.objects(replies, FEEDBACK, strict=True).collect()}
    assert got == {1: (("w", ["a", "b"]), None), 2: (None, "field fix is not array<string>"), 3: (None, "not JSON")}
    assert elements.lists(df.limit(0), RULE).count() == 0


def test_invalidate_all(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abé/") for _ in range(n))
    keys, gone = [text(rng.randrange(0, 7)) for _ in range(300)] + [None], [text(rng.randrange(1, 5)) for _ in range(25)] + [None]
    cache = spark.createDataFrame([(k, "f", 1) for k in keys], "key string, feedback string, uri int")
    for known in (gone, [], [""]):
        out = feedback.invalidate_all(cache, spark.createDataFrame([(g,) for g in known], "uri string"))
        want = [k for k in keys if k is None or not any(g is not None and k.startswith(g) for g in known)]
        assert collections.Counter(r["key"] for r in out.collect()) == collections.Counter(want)
    assert "NestedLoop" not in plan(out)
