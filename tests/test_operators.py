"""Properties and fixed cases of the operators."""

from __future__ import annotations

import collections
import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import commands
from lodestone.functions import dart, feedback, labels
from lodestone.operators import dashboard, detect, findings, lines, literals, metrics
from lodestone.plans import catalogue
from cases import BROKEN, EXPECTED, FILES, ISSUES, PACK, SAMPLES, SOURCES
from lodestone.schemas import FINDING
from lodestone.sources import files, rules
from lodestone.streaming import triggers


def value(spark, column, **given):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]).select(column).first()[0]


def reference_hash(text: str) -> str:
    h = 0
    data = text.encode("utf-16-be")
    for i in range(0, len(data), 2):
        h = (h + int.from_bytes(data[i : i + 2])) & 0x1FFFFFFF
        h = (h + ((h & 0x7FFFF) << 10)) & 0x1FFFFFFF
        h ^= h >> 6
    h = (h + ((h & 0x3FFFFFF) << 3)) & 0x1FFFFFFF
    h ^= h >> 11
    return f"{(h + ((h & 0x3FFF) << 15)) & 0x1FFFFFFF:08x}"


@pytest.mark.parametrize("snippet", ["", "x", "é", "😀 key", "a" * 500])
def test_fingerprint(spark, snippet):
    got = value(spark, labels.fingerprint(F.col("f"), F.col("l"), F.col("c"), F.col("r"), F.col("s")), f="a.dart", l=3, c=7, r="R", s=snippet)
    assert got == reference_hash(f"a.dart|3|7|R|{snippet}")


@pytest.mark.parametrize("path,name", [("a/b.dart", "b.dart"), ("a\\b.dart", "b.dart"), ("a/b/", "a/b/"), ("", "")])
def test_file_name(spark, path, name):
    assert value(spark, labels.file_name(F.col("p")), p=path) == name


def test_labels(spark):
    none = F.lit(None).cast("int")
    assert value(spark, labels.metrics_cell(none, F.lit(2), none)) == ",Depth=2"
    assert value(spark, labels.metric_suffix(none, none, none)) == ""
    assert value(spark, labels.metric_suffix(F.lit(1), none, F.lit(3))) == " [Cx=1, Size=3 LOC]"
    assert value(spark, labels.shorten(F.lit("abcdef"), 3)) == "…def"
    assert value(spark, labels.escape_html(F.lit("<a href='x'>&\""))) == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"
    assert value(spark, labels.severity_level(F.lit("ERROR"))) == "Error" and value(spark, labels.severity_level(F.lit(None).cast("string"))) == "Warning"


def finding(ord_, file, severity="warning", cx=None, depth=None, loc=None):
    return (ord_, file, 1, 1, None, "R", "m", severity, None, cx, depth, loc)


def test_counters_add_up(spark):
    rows = [finding(i, f"f{i % 3}_test.dart", "Error" if i % 4 == 0 else None, i - 2 if i % 5 else None, i % 7, i * 9) for i in range(40)]
    r = dashboard.counters(spark.createDataFrame(rows, FINDING)).first()
    assert r["errors"] + r["warnings"] == r["total"] == 40 == r["test_findings"]
    assert r["cx_low"] + r["cx_medium"] + r["cx_high"] == sum(1 for x in rows if (x[9] or 0) > 0)
    empty = dashboard.counters(spark.createDataFrame([], FINDING)).first()
    assert set(empty.asDict().values()) == {0}


def test_top_counts_keep_first_appearance(spark):
    rows = [finding(i, f) for i, f in enumerate(["b", "a", None, "a", "b", "", "c"])]
    got = [tuple(r) for r in dashboard.top_counts(spark.createDataFrame(rows, FINDING), F.col("file"), n=3).collect()]
    assert got == [("b", 2), ("a", 2), ("unknown", 2)]


def test_upsert_replaces_by_file(spark):
    old = spark.createDataFrame([finding(1, "f1"), finding(2, "f1"), finding(3, "f2"), finding(4, None)], FINDING)
    none = spark.createDataFrame([], FINDING)
    scanned = spark.createDataFrame([("f1",)], "file string")
    once = findings.upsert(old, none, scanned)
    assert sorted(r["ord"] for r in once.collect()) == [3, 4]
    assert sorted(map(repr, findings.upsert(once, none, scanned).collect())) == sorted(map(repr, once.collect()))


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    assert files.read_findings(spark, path).count() == 0
    rows = spark.createDataFrame([finding(1, "f1", cx=3)], FINDING)
    files.write_findings(rows, path)
    assert files.read_findings(spark, path).collect() == rows.collect()
    files.reset(spark, path)
    assert files.read_findings(spark, path).count() == 0
    files.write_json(rows, str(tmp_path / "json"))
    lines_ = [json.loads(x) for p in (tmp_path / "json").glob("part-*.json") for x in p.read_text().splitlines()]
    assert [x["ruleId"] for x in lines_] == ["R"] and lines_[0]["functionName"] is None and lines_[0]["nestingDepth"] is None
    assert files.read_findings_json(spark, str(tmp_path / "json")).collect() == rows.collect()
    (tmp_path / "list.json").write_text('[{"file": "a", "line": 2, "endColumn": 9, "ruleId": "X", "functionLoc": 4}, {"file": "b"}]')
    got = files.read_findings_json(spark, str(tmp_path / "list.json")).collect()
    assert [(r["ord"], r["file"], r["end_column"], r["rule_id"], r["function_loc"]) for r in got] == [(0, "a", 9, "X", 4), (1, "b", None, None, None)]
    (tmp_path / "bad.json").write_text('[{"file": ')
    assert files.read_findings_json(spark, str(tmp_path / "bad.json")).where("file is not null").count() == 0
    assert files.read_findings_json(spark, str(tmp_path / "none.json")).count() == 0


def test_rules_from_files(spark, tmp_path):
    assert rules.load_rules(spark, str(tmp_path / "missing.json")).count() == 0
    (tmp_path / "h.json").write_text('{"minLength": 4}')
    h = rules.load_heuristics(spark, str(tmp_path / "h.json"))
    assert (h.min_length, h.min_entropy) == (4, 3.3)
    assert rules.found_heuristics(spark, str(tmp_path / "h.json")).min_length == 4
    (tmp_path / "void.json").write_text("{}")
    assert rules.found_heuristics(spark, str(tmp_path / "void.json")) is None and rules.found_heuristics(spark, str(tmp_path / "no.json")) is None
    (tmp_path / "bad.json").write_text("{")
    assert rules.load_heuristics(spark, str(tmp_path / "bad.json")) == rules.Heuristics()
    strings = T.ArrayType(T.StringType())
    (tmp_path / "l.json").write_text('["a", null, "b"]')
    assert rules.read_json(spark, str(tmp_path / "l.json"), strings).first()["v"] == ["a", None, "b"]
    for name in ("bad.json", "h.json", "missing.json"):
        assert rules.read_json(spark, str(tmp_path / name), strings).count() == 0
    assert rules.read_json(spark, str(tmp_path / "h.json"), rules.HEURISTICS).first()["v"]["minLength"] == 4
    (tmp_path / "m.json").write_text('{"component": "hsd", "version": "1", "files": {"baseRules": "b"}}')
    assert rules.load_manifest(spark, str(tmp_path / "m.json")).first()["files"]["baseRules"] == "b"
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "r.json").write_text("[]")
    assert rules.resolve("r.json", str(tmp_path), "/opt/bin") == str(tmp_path / "data" / "r.json")
    assert rules.resolve("q.json", str(tmp_path), "/opt/bin") == "/opt/data/q.json"
    assert rules.base_url("  https://x/y// ") == "https://x/y"


def test_sync_throttles_and_keeps_time(spark):
    r, h = rules.base_rules(spark), rules.Heuristics()
    hour = 3_600_000
    now = rules.Pack(r, h, "1", 0)
    assert rules.sync(now, rules.Pack(r, h, "2"), 6 * hour) is now
    assert rules.sync(now, rules.Pack(r, h, "1"), 12 * hour).last == 0
    assert rules.sync(now, rules.Pack(r, h, "2"), 18 * hour).last == 18 * hour
    assert rules.sync(now, rules.Pack(r, h, "1"), hour, force=True).last == hour
    assert rules.bootstrap(rules.Pack(r.limit(0), h), rules.Pack(r, h)).rules.count() == 6
    own = rules.Heuristics(min_length=3)
    assert rules.bootstrap(rules.Pack(r, None), rules.Pack(r, own)).heuristics is own and rules.bootstrap(rules.Pack(r, h), rules.Pack(r, own)).heuristics is h


def test_invalid_patterns_are_set_aside(spark):
    rows = spark.createDataFrame([("OK", "n", "a$", "error", None, True), ("BAD", "n", "(", "error", None, None), ("OFF", "n", "a", "error", None, False)], rules.RULE)
    good, bad = rules.compiled(rows)
    assert [r["rule_id"] for r in good] == ["OK"] and [r["rule_id"] for r in bad] == ["BAD"]
    found = spark.createDataFrame([(1, "xa"), (2, "xa\n")], "id int, value string")
    assert [r["id"] for r in detect.match_rules(found, rows).collect()] == [1]


def test_both_rule_plans_agree(spark):
    found = spark.createDataFrame([(i, v) for i, v in enumerate(["AKIA" + "B" * 16, "none", "ghp_" + "c" * 36])], "id int, value string")
    one = detect.match_rules(found, rules.base_rules(spark))
    two = detect.match_rules(found, rules.base_rules(spark), unrolled=0)
    key = lambda df: sorted((r["id"], r["rule_id"]) for r in df.collect())
    assert key(one) == key(two) == [(0, "AWS_ACCESS_KEY"), (2, "GITHUB_TOKEN")]


def test_scan_falls_back_to_heuristics(spark):
    text = "final apiToken = 'q8Zr2LmX0pVw7Tn';\nfinal testToken = 'q8Zr2LmX0pVw7Tn';\nfinal key = 'short';\nx = \"AKIA" + "C" * 16 + '";\n'
    got = detect.scan(spark.createDataFrame([("a", text)], "path string, content string"), rules.base_rules(spark)).collect()
    assert sorted((r["line"], r["rule_id"]) for r in got) == [(1, "HEUR.SECRET"), (4, "AWS_ACCESS_KEY")]


def test_many_rules_in_one_pass(spark):
    rows = [(f"R{i}", f"n{i}", rf"^k{i}(x)?$" if i % 2 else rf"(k{i})\1", "error", None, True) for i in range(5000)] + [("BAD", "b", "(", "error", None, True)]
    many = spark.createDataFrame(rows, rules.RULE)
    text = "a = 'k7';\nb = 'k8k8';\nc = 'k4999x';\napiToken = 'q8Zr2LmX0pVw7Tn';\nd = 'none';\n"
    df = spark.createDataFrame([("a", text)], "path string, content string")
    got = detect.scan(df, many).collect()
    assert sorted((r["line"], r["rule_id"]) for r in got) == [(1, "R7"), (2, "R8"), (3, "R4999"), (4, "HEUR.SECRET")]


def test_both_plans_of_a_scan_agree(spark):
    df = spark.createDataFrame(FILES, "path string, content string")
    lexed = metrics.literal_metrics(df)
    one, two = (detect.detected(lexed, rules.base_rules(spark), unrolled=n).drop("rank") for n in (64, 0))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect())) and one.count() == len(ISSUES)


def test_equal_literals_have_their_own_columns(spark):
    df = spark.createDataFrame([("a", "x = 'a'; y = 'a'; 'a' 'a'")], "path string, content string")
    assert [(r["column"], r["lit_no"], r["context"]) for r in literals.literals(df).orderBy("lit_no").collect()] == [(1, 0, "x"), (10, 1, "y"), (19, 2, ""), (23, 3, "")]


def test_commands(spark, tmp_path):
    ws, src = str(tmp_path / "ws"), tmp_path / "src"
    src.mkdir()
    for name, text in FILES[:2]:
        (src / name.split("/")[1]).write_text(text)
    pack = rules.Pack(rules.base_rules(spark), None)
    commands.update(spark, ws, rules.Pack(rules.base_rules(spark).limit(0), None), pack, None, 0)
    assert commands.scan(spark, ws, f"{src}/*.dart").count() == len(ISSUES)
    assert commands.dashboard(spark, ws)["counters"].first()["total"] == len(ISSUES)
    commands.manage(spark, ws, "add", {"id": "DOC", "name": "Doc", "pattern": "it's", "severity": "error"})
    assert commands.manage(spark, ws, "add", {"id": " ", "pattern": "x"}).count() == 1
    commands.update(spark, ws, pack, pack, None, 0)
    (src / "a.dart").write_text("// clean now")
    commands.scan(spark, ws, str(src / "*.dart"))
    got = files.read_findings(spark, f"{ws}/findings").collect()
    assert sorted(r["rule_id"] for r in got) == ["DOC", "GITHUB_TOKEN"] and {r["file"].rsplit("/", 1)[1] for r in got} == {"b.dart"}
    assert commands.manage(spark, ws, "delete", rule_id="DOC").count() == 0
    with pytest.raises(Exception):
        commands.scan(spark, ws, str(src / "none.dart"))
    assert files.reset_once(spark, f"{ws}/findings") and not files.reset_once(spark, f"{ws}/findings")
    assert files.read_findings(spark, f"{ws}/findings").count() == 0


def test_bursts_join_across_hours(spark):
    rng, now, edits = random.Random(4), 0, []
    for i in range(400):
        now += rng.choice([1, 60, 299, 300, 301, 2000])
        edits.append((now, f"d{i % 7}"))
    df = spark.createDataFrame(edits, "s long, doc string").select(F.timestamp_seconds("s").alias("ts"), "doc").repartition(3)
    whole = df.groupBy(F.session_window("ts", "5 minutes").alias("s")).agg(F.max(F.struct("ts", "doc")).alias("l"), F.count("*").alias("n")).select(F.col("s.start"), "l.ts", "l.doc", "n")
    got = triggers.debounce(df, "5 minutes").select("first_ts", "last_ts", "doc", "edits")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab\r\n \t", max_size=12), min_size=1, max_size=6))
def test_lines(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    got = {}
    for r in lines.lines(df).collect():
        got.setdefault(r["id"], []).append(r["line_text"])
    import re

    for i, t in enumerate(texts):
        want = re.split("\r\n|\n|\r", re.sub("(\r\n|\n|\r)\\Z", "", t)) if t else []
        assert got.get(i, []) == want


def test_snippet_and_context(spark):
    text = "a\n  b \nc\nd\ne\nf"
    assert [value(spark, lines.snippet(F.lit(text), F.lit(k))) for k in (0, 2, 7)] == ["", "b", ""]
    assert value(spark, lines.context(F.lit(text), F.lit(2))) == "a\n  b \nc\nd"
    assert value(spark, lines.context(F.lit(text), F.lit(6))) == "d\ne\nf"


def test_entropy(spark):
    assert value(spark, literals.entropy(F.lit(""))) == 0
    assert abs(value(spark, literals.entropy(F.lit("aabb"))) - 1) < 1e-12


def test_metrics_fixtures(spark):
    got = metrics.literal_metrics(spark.createDataFrame(SOURCES, "path string, content string"))
    assert sorted(map(repr, (tuple(r) for r in got.select("path", "value", "function_name", "complexity", "nesting_depth", "function_loc").collect()))) == sorted(map(repr, EXPECTED))


def test_parser_details():
    text = """String? f(String? a, {int b = 1}) async => a == null ? 'n${b > 1 && b < 3 ? "i" : 2}' : 'm';
class B extends A<int> {
  /// doc
  @override
  Map<String, int> m(int x) {
    int g(int y) { return y > 0 ? 1 : 2; }
    if (x > 1) return {'k': 1};
    else for (var i = 0; i < 2; i++) print('p');
    return {};
  }
  static const s = "cc";
  operator ==(o) => o is B && 'q' == 'r';
  factory B.of() { return B('w'); }
}
"""
    p = dart.parse(text)
    by = {x.value: p.executables[x.executable] if x.executable is not None else None for x in p.literals}
    assert (by["m"].name, by["m"].complexity) == ("f", 4)
    assert (by["k"].name, by["k"].complexity, by["k"].depth) == ("m", 3, 2)
    assert by["cc"] is None and by["q"].name == "==" and by["w"].name == "B.of"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abif(){}[]<>?:;,=>'\"\\$ \n/*@.&|", max_size=60))
def test_parser_never_fails(text):
    dart.parse(text)


def test_feedback(spark):
    raw = json.dumps({"why": "w", "fix": ["1. a", "2.b", "c", "d"], "maintainability": "", "example": " "})
    assert value(spark, feedback.markdown(F.lit(raw))) == feedback.TITLE + "**Why**: w\n\n**Fix**:\n- a\n- b\n- c\n\n"
    assert value(spark, feedback.markdown(F.lit("oops"))) == feedback.TITLE + "oops"
    assert feedback.NO_SNIPPET in value(spark, feedback.prompt(F.lit("issue"), F.lit("")))
    assert value(spark, feedback.json_object(F.lit("} {"))) is None


def test_debounce_fixture(spark):
    rows = [("2024-01-01 00:00:00", "A"), ("2024-01-01 00:00:01", "B"), ("2024-01-01 00:00:05", "A")]
    edits = spark.createDataFrame(rows, "ts string, doc string").withColumn("ts", F.to_timestamp("ts"))
    assert [r["doc"] for r in triggers.debounce(edits).orderBy("first_ts").collect()] == ["B", "A"]
    assert triggers.last_document(edits).first()["doc"] == "A"


def test_debounce_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", f"d{m}") for m in (0, 1, 9, 10, 30, 59)]
    edits = spark.createDataFrame(rows, "ts string, doc string").withColumn("ts", F.to_timestamp("ts"))
    edits.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(edits.schema).parquet(str(tmp_path / "in"))
    q = triggers.debounce(stream, "5 minutes", lateness="1 minute").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["doc"] for r in spark.table("bursts").collect()}
    want = [r["doc"] for r in triggers.debounce(edits, "5 minutes").orderBy("first_ts").collect()]
    assert got == set(want[:-1])  # the last burst of a stream stays open


def test_save_trigger_and_throttle_stream(spark, tmp_path):
    events = spark.createDataFrame([("save", "a", 1), ("edit", "b", 2), ("save", "c", 3)], "kind string, doc string, t long").withColumn("ts", F.timestamp_seconds("t"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    seen = []
    triggers.on_save(stream, lambda df, k: seen.extend(r["doc"] for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == ["a", "c"]
    polls = spark.createDataFrame([("k", h * 3_600_000) for h in (0, 6, 12, 18, 24)], "key string, t long")
    want = [(0, True), (6, False), (12, True), (18, False), (24, True)]
    assert [(r["t"] // 3_600_000, r["passed"]) for r in triggers.throttle(polls).orderBy("t").collect()] == want
    polls.write.parquet(str(tmp_path / "polls"))
    live = spark.readStream.schema(polls.schema).parquet(str(tmp_path / "polls"))
    q = triggers.throttle_stream(live).writeStream.format("memory").queryName("passed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["t"] // 3_600_000, r["passed"]) for r in spark.table("passed").orderBy("t").collect()] == want


@pytest.mark.parametrize("name, counted", [("poll_throttle", "events"), ("enclosing_executable", "events")])
def test_every_event_is_used(spark, name, counted):
    data = "/root/testdata/sf0.001"
    assert catalogue.QUERIES[name](spark, data).count() == spark.read.parquet(f"{data}/{counted}.parquet").count()


def test_throttle_equals_one_by_one(spark):
    rng = random.Random(3)
    polls = [(rng.choice(["a", "b", None]), rng.randrange(10_000)) for _ in range(3000)] + [("a", None)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = triggers.throttle(spark.createDataFrame(polls, "key string, t long"), 40)
        assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = collections.Counter(map(tuple, found.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = collections.Counter()
    for key in ("a", "b", None):
        last = None
        for t in sorted(t for k, t in polls if k == key and t is not None):
            passed = last is None or t - last >= 40
            last = t if passed else last
            want[key, t, passed] += 1
    assert got == want
