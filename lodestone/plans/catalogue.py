"""Queries over the driver's tables and small inline tables, each with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import commands
from ..commands import ORDER
from ..functions import feedback, labels
from ..operators import dashboard, detect, findings, lines, literals, metrics
from ..schemas import FEEDBACK
from ..shared import keep, new_folder
from ..sources import elements, files, rules
from ..streaming import triggers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_as_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A findings-shaped view of events."""
    k, view = F.get_json_object("props", "$.k").cast("int"), F.col("event_type") == "view"
    test = F.col("user_id") % 5 == 0
    file = F.concat(F.when(test, "test/").otherwise("lib/"), F.lit("u"), F.col("user_id") % 40, F.when(test, "_test").otherwise(""), F.lit(".dart"))
    known = lambda c: F.when(~view, c)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"), file.alias("file"), (F.col("event_id") % 200).cast("int").alias("line"), (F.col("event_id") % 60).cast("int").alias("column"),
        F.concat(F.lit("R."), F.upper("event_type")).alias("rule_id"), F.concat(F.initcap("event_type"), F.lit(' hardcoded in string literal in "k"')).alias("message"),
        F.when(F.col("event_type") == "error", "error").otherwise("warning").alias("severity"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("f"), F.col("event_id") % 7)).alias("function_name"),
        known(k % 16).alias("complexity"), known(k % 7).alias("nesting_depth"), known(F.floor("value").cast("int")).alias("function_loc"),
    )


FINDINGS = """findings as (select event_id as ord,
 concat(case when user_id%5=0 then 'test/' else 'lib/' end,'u',user_id%40, case when user_id%5=0 then '_test' else '' end,'.dart') as file,
 (event_id%200)::int as line, (event_id%60)::int as "column", concat('R.',upper(event_type)) as rule_id,
 concat(upper(event_type[1]), lower(event_type[2:]), ' hardcoded in string literal in "k"') as message,
 case when event_type='error' then 'error' else 'warning' end as severity,
 case when event_id%3>0 then concat('f', event_id%7) end as function_name,
 case when event_type<>'view' then json_extract_string(props,'$.k')::int%16 end as complexity,
 case when event_type<>'view' then json_extract_string(props,'$.k')::int%7 end as nesting_depth,
 case when event_type<>'view' then floor(value)::int end as function_loc from events)"""
CX = "count(*) filter (where complexity>0 and complexity<=5) as cx_low, count(*) filter (where complexity>5 and complexity<=10) as cx_medium, count(*) filter (where complexity>10) as cx_high"
DEPTH = "count(*) filter (where nesting_depth<=2) as depth_shallow, count(*) filter (where nesting_depth>2 and nesting_depth<=4) as depth_medium, count(*) filter (where nesting_depth>4) as depth_deep"
SIZE = "count(*) filter (where function_loc<=20) as size_small, count(*) filter (where function_loc>20 and function_loc<=50) as size_medium, count(*) filter (where function_loc>50) as size_large"
NAME = "case when split_part(file,'/',-1)='' then file else split_part(file,'/',-1) end"


# dashboard


@query(f"with {FINDINGS} select count(*) as total, count(*) filter (where severity='error') as errors, count(*) filter (where severity<>'error') as warnings, count(*) filter (where ends_with(file,'_test.dart')) as test_findings, {CX}, {DEPTH}, {SIZE} from findings")
def dashboard_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.counters(events_as_findings(spark, sf_dir))


@query(f"with {FINDINGS} select {CX} from findings")
def bucket_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.buckets(events_as_findings(spark, sf_dir), "cx")


@query(f"with {FINDINGS} select {DEPTH} from findings")
def bucket_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.buckets(events_as_findings(spark, sf_dir), "depth")


@query(f"with {FINDINGS} select {SIZE} from findings")
def bucket_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.buckets(events_as_findings(spark, sf_dir), "size")


@query(f"with {FINDINGS} select * from findings")
def filter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.tab(events_as_findings(spark, sf_dir), "all")


@query(f"with {FINDINGS} select ord, file, complexity from findings where complexity>10")
def filter_high_cx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.tab(events_as_findings(spark, sf_dir), "highCx").select("ord", "file", "complexity")


@query(f"with {FINDINGS} select ord, file, complexity from findings where complexity>5 and complexity<=10")
def filter_medium_cx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.tab(events_as_findings(spark, sf_dir), "mediumCx").select("ord", "file", "complexity")


@query(f"with {FINDINGS} select ord, file, complexity from findings where complexity>0 and complexity<=5")
def filter_low_cx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.tab(events_as_findings(spark, sf_dir), "lowCx").select("ord", "file", "complexity")


@query(f"with {FINDINGS} select ord, file, complexity from findings where ends_with(file, '_test.dart')")
def filter_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.tab(events_as_findings(spark, sf_dir), "tests").select("ord", "file", "complexity")


@query(f"""with {FINDINGS} select ord, coalesce(function_name,'<anonymous>') as function, {NAME} as file, nullif(line,0) as line, complexity, nesting_depth, function_loc
from findings where complexity>0 order by complexity desc, coalesce(nesting_depth,0) desc, ord limit 15""")
def hotspots_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.hotspots(events_as_findings(spark, sf_dir))


@query(f"with {FINDINGS} select case when length(rule_id)>20 then concat('…', right(rule_id,20)) else rule_id end as label, n from (select rule_id, count(*) as n, min(ord) as f from findings group by 1 order by n desc, f limit 8)")
def top_rules_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.top_counts(events_as_findings(spark, sf_dir), F.col("rule_id"), lambda c: labels.shorten(c, 20))


@query(f"with {FINDINGS} select {NAME} as label, n from (select file, count(*) as n, min(ord) as f from findings group by 1 order by n desc, f limit 8)")
def top_files_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.top_counts(events_as_findings(spark, sf_dir), F.col("file"), lambda c: labels.shorten(labels.file_name(c), 28))


@query(f"""with {FINDINGS}, t as (select rule_id, count(*) as n, min(ord) as f from findings group by 1 order by n desc, f limit 8)
select rule_id as label, n, floor(100 * (n / greatest(1, (select max(n) from t))) + 0.5)::int as height from t""")
def rule_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.bars(dashboard.top_counts(events_as_findings(spark, sf_dir), F.col("rule_id")), 100)


CELL = "concat(case when complexity is not null then concat('Cx=',complexity) else '' end, case when nesting_depth is not null then concat(',Depth=',nesting_depth) else '' end, case when function_loc is not null then concat(',Size=',function_loc,' LOC') else '' end)"


@query(f"""with {FINDINGS} select ord, severity, rule_id as rule, replace(replace(replace(replace(replace(concat(message, ' it''s <a> & '),'&','&amp;'),'<','&lt;'),'>','&gt;'),'"','&quot;'),'''','&#39;') as message, {NAME} as file, nullif(line,0) as line, coalesce(function_name,'') as function, {CELL} as metrics from findings""")
def findings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = events_as_findings(spark, sf_dir)
    return dashboard.table(f.withColumn("message", F.concat("message", F.lit(" it's <a> & "))))


# findings


SUFFIX = "case when complexity is null and nesting_depth is null and function_loc is null then '' else concat(' [', concat_ws(', ', 'Cx='||complexity, 'Depth='||nesting_depth, 'Size='||function_loc||' LOC'), ']') end"
DIAGNOSTICS = f"""diagnostics as (select ord, file, greatest(0,line-1) as line0, greatest(0,"column"-1) as start_col, greatest(0,"column"-1)+80 as end_col,
 concat('[',rule_id,'] ',message,{SUFFIX}) as message, case when severity='error' then 'Error' else 'Warning' end as severity, 'lodestone' as source, rule_id as code from findings)"""


@query(f"with {FINDINGS}, {DIAGNOSTICS} select * from diagnostics")
def diagnostics_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.diagnostics(events_as_findings(spark, sf_dir))


@query(f"with {FINDINGS}, {DIAGNOSTICS} select file, count(*) as n, arg_min(message, ord) as first_message, arg_max(message, ord) as last_message, string_agg(concat(line0, ':', start_col, '-', end_col, ' ', severity, ' ', code), '|' order by ord) as entries from diagnostics group by file")
def diagnostics_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = findings.by_file(findings.diagnostics(events_as_findings(spark, sf_dir)))
    d, entry = F.col("diagnostics"), lambda x: F.concat(x["line0"], F.lit(":"), x["start_col"], F.lit("-"), x["end_col"], F.lit(" "), x["severity"], F.lit(" "), x["code"])
    return grouped.select("file", F.size(d).cast("long").alias("n"), F.element_at(d, 1)["message"].alias("first_message"), F.element_at(d, -1)["message"].alias("last_message"), F.array_join(F.transform(d, entry), "|").alias("entries"))


MESSAGES = """messages as (select event_id as id, case event_id%6 when 0 then concat('Key ',event_id,' hardcoded in literal in "ctx"') when 1 then 'Possible hardcoded secret in literal in "a" in "b"'
 when 2 then 'Possible hardcoded secret' when 3 then ' hardcoded in x' when 4 then concat('plain ', event_type) else 'A hardcoded in B hardcoded in C in "' end as message from events)"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("event_id") % 6, [F.concat(F.lit("Key "), F.col("event_id"), F.lit(' hardcoded in literal in "ctx"')), F.lit('Possible hardcoded secret in literal in "a" in "b"')]
    text += [F.lit("Possible hardcoded secret"), F.lit(" hardcoded in x"), F.concat(F.lit("plain "), F.col("event_type")), F.lit('A hardcoded in B hardcoded in C in "')]
    value = text[-1]
    for i in range(4, -1, -1):
        value = F.when(k == i, text[i]).otherwise(value)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), value.alias("message"))


@query(rf"""with {MESSAGES}, r as (select *, case when strpos(message,' hardcoded in ')>0 then substr(message, strpos(message,' hardcoded in ')+14) when starts_with(message,'Possible hardcoded secret in ') then substr(message,30) end as rest from messages)
select id, case when strpos(message,' hardcoded in ')>1 then substr(message,1,strpos(message,' hardcoded in ')-1) when starts_with(message,'Possible hardcoded secret') then 'Secret' end as rule_name,
case when strpos(rest,' in "')>1 then substr(rest,1,strpos(rest,' in "')-1) else rest end as node_kind,
case when regexp_matches(message,'(?s)^.* in "(.*)"$') then regexp_extract(message,'(?s)^.* in "(.*)"$',1) end as context from r""")
def message_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("message")
    return _messages(spark, sf_dir).select("id", labels.rule_name_of(m).alias("rule_name"), labels.node_kind_of(m).alias("node_kind"), labels.context_of(m).alias("context"))


# h' = spread(h + x, 19, 10) ^ itself >> 6, within 29 bits; each inner value is written out
A = "((h + x) & 536870911)"
B = f"(({A} + (({A} & 524287) << 10)) & 536870911)"
H1 = "((h + ((h & 67108863) << 3)) & 536870911)"
H2 = f"xor({H1}, {H1} >> 11)"
H3 = f"(({H2} + (({H2} & 16383) << 15)) & 536870911)"


@query(f"""with {FINDINGS}, s as (select ord, concat_ws('|', file, line, "column", rule_id, 'x '||ord) as s from findings),
h as (select ord, list_reduce(list_transform(range(1, length(s)+1), lambda i: unicode(s[i])::bigint), lambda h, x: xor({B}, {B} >> 6), 0::bigint) as h from s)
select ord, lpad(lower(to_hex({H3})), 8, '0') as fingerprint from h""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = events_as_findings(spark, sf_dir)
    return f.select("ord", labels.fingerprint(F.col("file"), F.col("line"), F.col("column"), F.col("rule_id"), F.concat(F.lit("x "), F.col("ord"))).alias("fingerprint"))


@query(f"""with {FINDINGS} select ord, case when complexity<=5 then 'low' when complexity<=10 then 'medium' when complexity is not null then 'high' end as complexity_level,
case when nesting_depth<=1 then 'low' when nesting_depth<=3 then 'medium' when nesting_depth is not null then 'high' end as nesting_level,
case when function_loc<=30 then 'small' when function_loc<=80 then 'medium' when function_loc is not null then 'large' end as size_level from findings""")
def metric_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = events_as_findings(spark, sf_dir)
    return f.select("ord", labels.complexity_level(F.col("complexity")).alias("complexity_level"), labels.nesting_level(F.col("nesting_depth")).alias("nesting_level"), labels.size_level(F.col("function_loc")).alias("size_level"))


@query(f"""with {FINDINGS}, s as (select *, concat_ws('|', file, line, "column", rule_id, 'x '||ord) as s from findings),
h as (select *, list_reduce(list_transform(range(1, length(s)+1), lambda i: unicode(s[i])::bigint), lambda h, x: xor({B}, {B} >> 6), 0::bigint) as h from s)
select ord, file, rule_id, severity, message, line, "column", function_name, complexity, nesting_depth, function_loc, regexp_extract(message,'^(.*?) hardcoded in ',1) as rule_name, 'string literal' as node_kind, 'k' as context, concat('x ',ord) as snippet,
lpad(lower(to_hex({H3})), 8, '0') as fingerprint from h""")
def rich_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.rich(events_as_findings(spark, sf_dir), F.concat(F.lit("x "), F.col("ord")))


@query(f"""with {FINDINGS}, e as (select *, case when ord%3=0 then 'long line of '||ord else null end as text from findings)
select ord, (case when ord%3=0 then length(text) end)::int as end_column, 0 as start_col, (case when ord%3=0 then length(text) else 0 end)::int as end_col from e""")
def line_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with their line's text, which two of three don't have: end column of the store, and the whole line as range."""
    f = events_as_findings(spark, sf_dir)
    text = f.where("ord % 3 = 0").select("ord", F.concat(F.lit("long line of "), F.col("ord")).alias("text"))
    joined = f.join(text, "ord", "left")
    start, end = labels.whole_line_range(F.col("text"))
    stored = findings.to_findings(joined.withColumn("_end", end), F.length("text"))
    return stored.select("ord", "end_column").join(joined.select("ord", start.alias("start_col"), end.alias("end_col")), "ord")


@query(f"""with {FINDINGS}, j as (select file, ord, json_object('file',file,'ruleId',rule_id,'severity',severity,'message',message,'line',line,'column',"column",'functionName',function_name,'complexity',complexity,'nestingDepth',nesting_depth,'functionLoc',function_loc)::varchar as j from findings)
select file, concat('[', string_agg(j, ',' order by ord), ']') as json from j group by file""")
def stdout_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.json_by_file(events_as_findings(spark, sf_dir))


@query(f"""with {FINDINGS}, half as (select (max(ord)/2)::bigint as m from findings)
select ord, file, rule_id, 'old' as state from findings, half where ord < m and file <> 'lib/u1.dart' and file <> 'lib/u2.dart'
union all select ord, file, rule_id, 'new' as state from findings, half where ord >= m and file = 'lib/u1.dart'""")
def upsert_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans of two files, one of which has become clean, replace their rows in the store."""
    f = events_as_findings(spark, sf_dir).select("ord", "file", "rule_id")
    half = f.agg(F.round(F.max("ord") / 2).cast("long").alias("m"))
    f = f.crossJoin(F.broadcast(half))  # one row
    old, new = f.where("ord < m").drop("m").withColumn("state", F.lit("old")), f.where("ord >= m and file = 'lib/u1.dart'").drop("m").withColumn("state", F.lit("new"))
    return findings.upsert(old, new, spark.createDataFrame([("lib/u1.dart",), ("lib/u2.dart",)], "file string"))


@query(f"""with {FINDINGS}, {DIAGNOSTICS}, p as (select event_id as pos_id, concat('lib/u', event_id%40, '.dart') as file, (event_id%199)::int as at_line, (event_id%90)::int as at_col from events)
select pos_id, arg_min(d.ord, d.ord) as ord, arg_min(d.message, d.ord) as message, arg_min(d.code, d.ord) as code from p join diagnostics d on p.file=d.file and at_line=line0 and at_col between start_col and end_col group by pos_id""")
def hover_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position for every event."""
    p = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pos_id"), F.concat(F.lit("lib/u"), F.col("event_id") % 40, F.lit(".dart")).alias("file"), (F.col("event_id") % 199).cast("int").alias("at_line"), (F.col("event_id") % 90).cast("int").alias("at_col")
    )
    return findings.lookup(p, findings.diagnostics(events_as_findings(spark, sf_dir)))


# lines and literals


LINES = r"""split_lines as (select doc_id, text, case when text='' then []::varchar[] else string_split_regex(regexp_replace(text, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r') end as l from documents)"""


@query(rf"""with {LINES} select doc_id, (doc_id%8)::int as line, case when doc_id%8 between 1 and len(l) then regexp_replace(l[doc_id%8], '^\s+|\s+$', '', 'g') else '' end as snippet from split_lines""")
def line_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("line", (F.col("doc_id") % 8).cast("int"))
    return d.select("doc_id", "line", lines.snippet(F.col("text"), F.col("line")).alias("snippet"))


@query(rf"""with {LINES} select doc_id, case when least(len(l), doc_id%6+2) >= greatest(1, doc_id%6-2) then array_to_string(l[greatest(1, doc_id%6-2) : least(len(l), doc_id%6+2)], chr(10)) end as context from split_lines""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", lines.context(F.col("text"), (F.col("doc_id") % 6).cast("int")).alias("context"))


def _literal_sql(source: str, key: str, text: str) -> str:
    q = literals.LITERAL.replace("'", "''")
    return rf"""raw_lines as (select {key}, unnest(l) as line_text, generate_subscripts(l, 1)::int as line from (select {key}, case when {text}='' then []::varchar[] else string_split_regex(regexp_replace({text}, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r') end as l from {source})),
found as (select {key}, line, ms, gaps, unnest(ms) as m, (generate_subscripts(ms, 1) - 1)::int as lit_no from (select *, regexp_extract_all(line_text, '{q}') as ms, string_split_regex(line_text, '{q}') as gaps from raw_lines) where len(ms) > 0),
literals as (select {key}, line, (1 + list_sum(list_transform(gaps[1:lit_no + 1], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:lit_no], lambda g: length(g))), 0))::int as "column", lit_no, regexp_extract(m, '{q}', 1) as context, concat(regexp_extract(m, '{q}', 2), regexp_extract(m, '{q}', 3)) as value from found)"""


ENTROPY = "case when length(value)=0 then 0.0 else list_sum(list_transform(list_distinct(string_split(value,'')), lambda c: -((length(value)-length(replace(value,c,'')))/length(value)) * log2((length(value)-length(replace(value,c,'')))/length(value)))) end"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content"))


@query(f"with {_literal_sql('pages', 'page_id', 'html')} select * from literals")
def literal_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literals.literals(_pages(spark, sf_dir))


@query(f"with {_literal_sql('pages', 'page_id', 'html')} select page_id, line, lit_no, round({ENTROPY}, 4)::double as entropy from literals")
def literal_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = literals.literals(_pages(spark, sf_dir))
    return found.select("page_id", "line", "lit_no", F.round(literals.entropy(F.col("value")), 4).alias("entropy"))


@query(f"with {_literal_sql('documents', 'doc_id', 'text')} select doc_id, line, lit_no, round({ENTROPY}, 4)::double as entropy from literals")
def literal_entropy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = literals.literals(_documents(spark, sf_dir))
    return found.select("doc_id", "line", "lit_no", F.round(literals.entropy(F.col("value")), 4).alias("entropy"))


def _has(column: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


_H = rules.Heuristics()
HEURISTIC = f"{_has('context', _H.sensitive)} and length(value) >= {_H.min_length} and not {_has('value', _H.benign)} and not {_has('context', _H.benign)} and {ENTROPY} >= {_H.min_entropy}"


@query(f"with {_literal_sql('documents', 'doc_id', 'text')} select doc_id, line, lit_no, context, value, round({ENTROPY}, 4)::double as entropy from literals where {HEURISTIC}")
def heuristic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = detect.match_heuristics(literals.literals(_documents(spark, sf_dir)), _H)
    return hit.select("doc_id", "line", "lit_no", "context", "value", F.round("entropy", 4).alias("entropy"))


KEYED = """(select page_id, concat(html, chr(10), 'apiToken = ''q8Zr2LmX0p', page_id, ''' testKey="q8Zr2LmX0pVw7Tn"') as html from pages) p"""


@query(f"with {_literal_sql(KEYED, 'page_id', 'html')} select page_id, line, lit_no, context, value, round({ENTROPY}, 4)::double as entropy from literals where {HEURISTIC}")
def heuristic_scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a line of two literals put below each, one named like a secret, the other marked as harmless."""
    line = F.concat("content", F.lit("\napiToken = 'q8Zr2LmX0p"), F.col("page_id"), F.lit("' testKey=\"q8Zr2LmX0pVw7Tn\""))
    hit = detect.match_heuristics(literals.literals(_pages(spark, sf_dir).withColumn("content", line)), _H)
    return hit.select("page_id", "line", "lit_no", "context", "value", F.round("entropy", 4).alias("entropy"))


def _user_rule(spark: SparkSession) -> DataFrame:
    return rules.base_rules(spark).limit(0).unionByName(spark.createDataFrame([("USER.HEX40", "Hex token", "^[0-9a-f]{40}$", "error", None, None)], rules.RULE))


USER_HIT = "select doc_id, line, lit_no, 'USER.HEX40' as rule_id, 'error' as severity, value from literals where regexp_matches(value, '^[0-9a-f]{40}$')"


@query(f"with {_literal_sql('documents', 'doc_id', 'text')} {USER_HIT}")
def user_rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = detect.match_rules(literals.literals(_documents(spark, sf_dir)), _user_rule(spark))
    return hit.select("doc_id", "line", "lit_no", "rule_id", "severity", "value")


@query(f"with {_literal_sql('documents', 'doc_id', 'text')} {USER_HIT}")
def user_rule_scan_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same the way that rule sets take which are too large to unroll."""
    hit = detect.match_rules(literals.literals(_documents(spark, sf_dir)), _user_rule(spark), unrolled=0)
    return hit.select("doc_id", "line", "lit_no", "rule_id", "severity", "value")


@query(f"""with {_literal_sql('documents', 'doc_id', 'text')} select doc_id, line, lit_no, 'USER.HEX40' as rule_id, 'error' as severity, concat('Hex token hardcoded in string literal in "', context, '"') as message from literals where regexp_matches(value, '^[0-9a-f]{{40}}$')
union all select doc_id, line, lit_no, 'HEUR.SECRET', 'warning', 'Possible hardcoded secret in string literal' from literals where not regexp_matches(value, '^[0-9a-f]{{40}}$') and {HEURISTIC}""")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan: rules in effect, then heuristics."""
    effective = rules.effective(_user_rule(spark).withColumn("ord", F.lit(0)), rules.base_rules(spark).withColumn("ord", F.monotonically_increasing_id()))
    return detect.scan(_documents(spark, sf_dir), effective).select("doc_id", "line", "lit_no", "rule_id", "severity", "message")


#: Values shaped like keys, some a character short or long: a head, how many hexadecimal digits follow, in which case, and a tail.
SHAPES = [
    ("AIza", 35, False, ""), ("AIza", 34, False, ""), ("AKIA", 16, True, ""), ("AKIA", 16, False, ""), ("AKIA", 16, True, "\n"), ("sk_live_", 16, False, ""), ("sk_live_", 15, False, ""),
    ("x eyJ", 8, False, ".b.c"), ("eyJ", 8, False, ".b"), ("ghp_", 36, False, ""), (" ghp_", 36, False, ""), ("glpat-", 20, False, ""), ("glpat-", 19, False, ""),
]
_SHAPE_SQL = " ".join("when {} then '{}' || {}(substr(h, 1, {})) || {}".format(k, head, "upper" if up else "lower", n, "chr(10)" if tail == "\n" else f"'{tail}'") for k, (head, n, up, tail) in enumerate(SHAPES))
BASE_SQL = "(values " + ", ".join("('{}', '{}')".format(r[0], r[2]) for r in rules.BASE_RULES) + ") r(rule_id, pattern)"


@query(f"""with h as (select event_id, md5(event_id::varchar) || md5(props) as h from events), v as (select event_id as id, case event_id % {len(SHAPES)} {_SHAPE_SQL} end as value from h)
select id, rule_id from v join {BASE_SQL} on regexp_matches(value, pattern)""")
def base_rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value shaped like one of the keys for every event."""
    value = F.lit(None).cast("string")
    for k, (head, n, up, tail) in enumerate(SHAPES):
        digits = F.substring("h", 1, n)
        value = F.when(F.col("event_id") % len(SHAPES) == k, F.concat(F.lit(head), F.upper(digits) if up else digits, F.lit(tail))).otherwise(value)
    h = table(spark, sf_dir, "events").select("event_id", F.concat(F.md5(F.col("event_id").cast("string")), F.md5("props")).alias("h"))
    return detect.match_rules(h.select(F.col("event_id").alias("id"), value.alias("value")), rules.base_rules(spark)).select("id", "rule_id")


def _dart(spark: SparkSession, sf_dir: str, whole: bool = True) -> DataFrame:
    """A Dart source for every document: keys made from its text, and the text itself as a literal."""
    d, n, h = table(spark, sf_dir, "documents"), F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))
    path = F.concat(F.lit("lib/"), F.col("lang"), F.lit("/d"), n, F.when(n % 5 == 0, "_test").otherwise(""), F.lit(".dart"))
    parts = [
        F.lit("// final key = 'AKIA"), F.upper(F.substring(h, 1, 16)), F.lit("';\nint f"), n, F.lit("(bool a, bool b) {\n  if (a && b) { final first = r\"AKIA"), F.upper(F.substring(h, 1, 16)),
        F.lit("\"; }\n  send(apiToken: '"), F.substring(h, 1, 24), F.lit("');\n  return 1;\n}\nfinal gh"), n, F.lit(" = \""), F.when(n % 3 == 0, F.concat(F.lit("ghp_"), h, F.lit("0000"))).otherwise("none"), F.lit("\";\n"),
    ]
    body = [F.lit("final body = r\"\"\""), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit("'")), F.lit("\"\"\";\n")] if whole else []
    return d.select(n, path.alias("path"), F.concat(*parts, *body).alias("content"))


FOUND = f"""m as (select doc_id, 'lib/' || lang || '/d' || doc_id || case when doc_id % 5 = 0 then '_test' else '' end || '.dart' as file, md5(coalesce(text, '')) as h, replace(coalesce(text, ''), chr(34), chr(39)) as body from documents),
lits as (select doc_id, file, 3 as line, 31 as "column", 'first' as context, 'AKIA' || upper(h[1:16]) as value, 'f' || doc_id as function_name, 3 as complexity, 1 as nesting_depth, 5 as function_loc from m
 union all select doc_id, file, 4, 18, 'apiToken', h[1:24], 'f' || doc_id, 3, 1, 5 from m
 union all select doc_id, file, 7, 12 + length(doc_id::varchar), 'gh' || doc_id, case when doc_id % 3 = 0 then 'ghp_' || h || '0000' else 'none' end, null, null, null, null from m
 union all select doc_id, file, 8, 14, 'body', body, null, null, null, null from m),
ruled as (select lits.*, r.rule_id from lits join {BASE_SQL} on regexp_matches(value, pattern)),
found as (select * from ruled union all select lits.*, 'HEUR.SECRET' from lits where (doc_id, line) not in (select (doc_id, line) from ruled) and {HEURISTIC})"""


@query(f'with {FOUND} select file, line, "column", rule_id, context, function_name, complexity, nesting_depth, function_loc from found')
def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources made of whole documents to findings with metrics: commented literals don't count, raw and triple-quoted ones do."""
    issues = detect.scan_sources(_dart(spark, sf_dir), rules.base_rules(spark))
    return issues.select("file", "line", "column", "rule_id", "context", "function_name", "complexity", "nesting_depth", "function_loc")


@query(f"""with {FOUND}, kept as (select file, line, rule_id, row_number() over (order by file, line, "column", rule_id) - 1 as ord from found),
again as (select file, line, rule_id, row_number() over (order by file, line, "column", rule_id) - 1 + (select count(*) from kept) as ord from found where doc_id % 4 = 0 and line < 7)
select * from kept where file not in (select file from m where doc_id % 4 in (0, 1)) union all select * from again""")
def scan_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those findings in a store on disk, then a quarter of the files scanned again without their key, and a quarter scanned clean: numbers go on."""
    store, issues = files.findings_store(spark, new_folder(spark, "store")), keep(detect.scan_sources(_dart(spark, sf_dir), rules.base_rules(spark)), "issues")
    rows, sources = findings.to_findings(issues, F.col("line_length")), _dart(spark, sf_dir, False).select("doc_id", F.col("path").alias("file"))
    store.upsert(rows, sources, ORDER)
    quarter = sources.where("doc_id % 4 in (0, 1)")
    store.upsert(rows.join(quarter.where("doc_id % 4 = 0").select("file"), "file", "left_semi").where("line < 7"), quarter, ORDER)
    return store.read().select("file", "line", "rule_id", F.col("ord").cast("long").alias("ord"))


TOP_FOUND = f"""numbered as (select *, row_number() over (order by file, line, "column", rule_id) - 1 as ord from found)"""


@query(f"with {FOUND}, {TOP_FOUND} select {NAME} as label, n from (select file, count(*) as n, min(ord) as f from numbered group by 1 order by n desc, f limit 8)")
def scanned_top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top list over the engine's own findings: ties by the place in the store, whatever the partitions."""
    return dashboard.top_counts(_stored(spark, sf_dir), F.col("file"), lambda c: labels.shorten(labels.file_name(c), 28))


@query(f"""with {FOUND}, {TOP_FOUND} select ord, coalesce(function_name,'<anonymous>') as function, {NAME} as file, nullif(line,0) as line, complexity, nesting_depth, function_loc
from numbered where complexity>0 order by complexity desc, coalesce(nesting_depth,0) desc, ord limit 15""")
def scanned_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.hotspots(_stored(spark, sf_dir))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = files.findings_store(spark, new_folder(spark, "store"))
    sources = _dart(spark, sf_dir)
    store.upsert(findings.to_findings(detect.scan_sources(sources, rules.base_rules(spark)), F.col("line_length")), sources.select(F.col("path").alias("file")), ORDER)
    return store.read()


@query(f"""with {FOUND}, first as (select doc_id, doc_id % 8 as p, (row_number() over (partition by doc_id % 8 order by doc_id) - 1) * 8 as lines_before from m)
select p, (line + lines_before)::int as line, rule_id from found join first using (doc_id) where line < 8""")
def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight source files, made of all documents, that arrive in a folder and are scanned as a stream, three at a time, into the store; a second run finds nothing new."""
    root = new_folder(spark, "watched")
    sources = _dart(spark, sf_dir, False).withColumn("p", F.col("doc_id") % 8)
    sources.repartition(8, "p").sortWithinPartitions("p", "doc_id").select("p", "content").write.partitionBy("p").text(f"{root}/in")
    commands.update(spark, f"{root}/ws", *[rules.Pack(rules.base_rules(spark), rules.Heuristics())] * 2, remote=None, now_ms=0)
    for _ in range(2):
        commands.watch(spark, f"{root}/ws", f"{root}/in/*", f"{root}/checkpoint", read={"maxFilesPerTrigger": 3}).awaitTermination()
    return files.read_findings(spark, f"{root}/ws/findings").select(F.regexp_extract("file", "/p=([0-9]+)/", 1).cast("long").alias("p"), "line", "rule_id")


# rules by the thousand


_WORD_RULES = r"""w as (select distinct unnest(regexp_extract_all(text, '[a-z]{8,}')) as w from conversations),
r as (select w, case length(w) % 4 when 0 then '^/' || w || '[.,]?$' when 1 then '(?:in|re)?' || w when 2 then '[a-z]*' || w || '(?:s|ed)?[.,]?$' else '^' || w || '|/' || w || '\b' end as pattern from w)"""


def _word_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for every word of eight letters or more of the conversations, of four shapes."""
    w = table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{8,}"), F.lit(0))).alias("w")).distinct()
    of, shape = F.col("w"), F.length("w") % 4
    pattern = F.when(shape == 0, F.concat(F.lit("^/"), of, F.lit("[.,]?$"))).when(shape == 1, F.concat(F.lit("(?:in|re)?"), of)).when(shape == 2, F.concat(F.lit("[a-z]*"), of, F.lit("(?:s|ed)?[.,]?$")))
    pattern = pattern.otherwise(F.concat(F.lit("^"), of, F.lit("|/"), of, F.lit("\\b")))
    none = F.lit(None).cast("string")
    return w.select(of.alias("id"), none.alias("name"), pattern.alias("pattern"), none.alias("severity"), none.alias("description"), F.lit(True).alias("enabled"))


@query(rf"""with {_WORD_RULES}, {_literal_sql('pages', 'page_id', 'html')} select page_id, line, lit_no, w as rule_id from literals join r on regexp_matches(value, pattern)""")
def rule_index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of patterns over all literals of the pages, by the index of the texts that they require."""
    return detect.match_rules(literals.literals(_pages(spark, sf_dir)), _word_rules(spark, sf_dir)).select("page_id", "line", "lit_no", "rule_id")


@query(rf"""with {_WORD_RULES}, v as (select doc_id, unnest(string_split_regex(text, '\r\n|\n|\r')) as value from documents), few as (select doc_id, value, w, pattern from v join r on contains(value, w))
select distinct doc_id, w as rule_id from few where regexp_matches(value, pattern)""")
def rule_index_scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same patterns over all lines of the documents."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\r\n|\n|\r")).alias("value"))
    return detect.match_rules(found, _word_rules(spark, sf_dir)).select("doc_id", "rule_id").distinct()


# rules


_ITEM = """case event_id % 4 when 0 then '{"id":"E' || event_id || '","name":"' || event_type || '","pattern":"\\"k\\": ' || k || '\\\\}","enabled":' || (event_id % 8 = 0) || '}' when 1 then props when 2 then k else '"' || event_type || '"' end"""
PACKS = """k as (select *, json_extract_string(props, '$.k') as k, event_id // 100 as pack, (event_id % 100)::int as ord from events),
pack as (select case when event_id % 4 = 0 then 'E' || event_id end as id, case when event_id % 4 = 0 then event_type end as name, case when event_id % 4 = 0 then '"k": ' || k || '\\}' end as pattern, case when event_id % 4 = 0 then event_id % 8 = 0 end as enabled, ord, 'user' as origin from k where event_id % 4 < 2 and pack % 10 < 8)"""


def _packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule packs of a hundred events each: objects with and without the fields of a rule, numbers and texts; two of ten are broken or no list."""
    k, n = F.get_json_object("props", "$.k"), F.col("event_id")
    rule = F.concat(F.lit('{"id":"E'), n, F.lit('","name":"'), F.col("event_type"), F.lit('","pattern":"\\"k\\": '), k, F.lit('\\\\}","enabled":'), (n % 8 == 0).cast("string"), F.lit("}"))
    item = F.when(n % 4 == 0, rule).when(n % 4 == 1, F.col("props")).when(n % 4 == 2, k).otherwise(F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
    pack = F.expr("event_id div 100")
    items = table(spark, sf_dir, "events").groupBy(pack.alias("pack")).agg(F.array_sort(F.collect_list(F.struct("event_id", item.alias("item")))).alias("i"))
    body = F.array_join(F.transform("i", lambda x: x["item"]), ",")
    text = F.when(F.col("pack") % 10 == 8, F.concat(F.lit("["), body)).when(F.col("pack") % 10 == 9, F.concat(F.lit('{"rules":['), body, F.lit("]}"))).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    return items.select(F.concat(F.lit("p"), "pack").alias("path"), text.alias("content"))


def _pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rules_from_text(_packs(spark, sf_dir), "user")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for every part; every third is switched off."""
    none = F.lit(None).cast("string")
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("P"), n).alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("pattern"), none.alias("severity"), none.alias("description"), (n % 3 > 0).alias("enabled"), n.alias("ord"))


@query(f"with {PACKS} select id, pattern, enabled, ord, origin from pack")
def rule_pack_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pack(spark, sf_dir).select("id", "pattern", "enabled", F.col("ord").cast("int").alias("ord"), "origin")


@query(f"""with {PACKS} select case when pack % 10 = 8 then 'not JSON' when pack % 10 = 9 then 'not a list' when event_id % 4 >= 2 then 'not an object' end as reason, count(distinct case when pack % 10 >= 8 then pack * 100 else event_id end) as n from k group by 1""")
def rule_pack_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements of the packs are rules, and how many are refused for what."""
    return elements.counts(rules.pack_elements(_packs(spark, sf_dir)))


@query(f"with {PACKS} select id, 'user' as origin, 0 as priority from pack union all select 'P' || p_partkey, 'base', 1 from part")
def effective_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.effective(_pack(spark, sf_dir), _parts(spark, sf_dir)).select("id", "origin", "priority")


@query(f"with {PACKS} select 'user' as origin, count(*) as rules, count(*) filter (where enabled is not false) as enabled from pack union all select 'base', count(*), count(*) filter (where p_partkey % 3 > 0) from part")
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.counts(rules.effective(_pack(spark, sf_dir), _parts(spark, sf_dir)))


@query(f"with {PACKS}, v as (select distinct props as value from events) select value, id as rule_id from v join pack on enabled is not false and regexp_matches(value, pattern)")
def enabled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the packs' rules those in use and their matches: not the ones that are switched off, nor those without a pattern."""
    values = table(spark, sf_dir, "events").select(F.col("props").alias("value")).distinct()
    return detect.match_rules(values, _pack(spark, sf_dir).where("pattern is not null")).select("value", "rule_id")


@query("select 'E' || event_id as id, event_type as pattern from events where event_id % 5 in (0, 3)")
def rule_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of which some lack an id or a pattern."""
    n, none = F.col("event_id"), F.lit(None).cast("string")
    id_ = F.when(n % 5 == 1, "  ").when(n % 5 == 2, none).otherwise(F.concat(F.lit(" E"), n, F.lit(" ")))
    pattern = F.when(n % 5 == 4, "   ").otherwise(F.concat(F.col("event_type"), F.lit("  ")))
    forms = table(spark, sf_dir, "events").select(id_.alias("id"), none.alias("name"), pattern.alias("pattern"), none.alias("severity"), F.lit("").alias("description"), F.lit(True).alias("enabled"))
    return rules.validate(forms).select("id", "pattern")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a rule; ids repeat."""
    return table(spark, sf_dir, "events").select(F.concat(F.lit("U"), "user_id").alias("id"), F.col("event_type").alias("pattern"), (F.col("event_id") % 3 > 0).alias("enabled"), F.col("event_id").cast("int").alias("ord"))


@query("""with first as (select min(event_id) as gone from events where user_id = 7), how as (select 'by_id' as how, gone from first union all select 'by_place', 11 union all select 'neither', null)
select how, 'U' || user_id as id, (event_id - case when event_id > gone then 1 else 0 end)::int as ord from events, how where gone is null or event_id <> gone""")
def rule_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _numbered(spark, sf_dir)
    out = [rules.delete(r, *args).select(F.lit(how).alias("how"), "id", "ord") for how, args in (("by_id", ("U7", None)), ("by_place", ("none", 11)), ("neither", ("none", -9)))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""select case when event_id = 5 then 'N' else 'U' || user_id end as id, case when event_id = 5 then 'n' else event_type end as pattern, case when event_id <> 5 then event_id % 3 > 0 end as enabled, event_id::int as ord from events
union all select 'D' || p_partkey, p_brand, null, (p_partkey + 1 + (select max(event_id) from events))::int from part""")
def rule_edit_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the rules edited, and every part added as a further one."""
    changed = rules.edit(_numbered(spark, sf_dir), 5, {"id": "N", "pattern": "n"})
    more = table(spark, sf_dir, "part").select(F.concat(F.lit("D"), "p_partkey").alias("id"), F.col("p_brand").alias("pattern"), F.col("p_partkey").cast("int").alias("ord"))
    return rules.add(changed, more).select("id", "pattern", "enabled", "ord")


@query("select event_id, '1.' || user_id as version, '1.' || user_id is distinct from (select '1.' || min(user_id) from events) as needs from events")
def manifest_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A remote manifest for every event against one local version."""
    e = table(spark, sf_dir, "events")
    version = lambda c: F.concat(F.lit("1."), c).alias("version")
    return rules.needs_update(e.agg(F.min("user_id").alias("u")).select(version("u")), e.select("event_id", version("user_id"))).select("event_id", "version", "needs")


# streams, in batch


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("ts", F.concat(F.lit("d"), F.col("user_id")).alias("doc"))


@query("""with e as (select ts, concat('d', user_id) as doc from events), g as (select *, case when ts - lag(ts) over (order by ts, doc) <= interval 5 minutes then 0 else 1 end as opens from e),
s as (select *, sum(opens) over (order by ts, doc rows unbounded preceding) as s from g) select min(ts)::timestamp as first_ts, max(ts)::timestamp as last_ts, arg_max(doc, (ts, doc)) as doc, count(*) as edits from s group by s""")
def debounce_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = triggers.debounce(_edits(spark, sf_dir), "5 minutes")
    return out.select(F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "doc", "edits")


@query("select event_type, arg_max(concat('d', user_id), (ts, concat('d', user_id))) as doc from events group by event_type")
def last_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "ts", F.concat(F.lit("d"), F.col("user_id")).alias("doc"))
    return triggers.last_document(e, "event_type")


@query("""select event_id, coalesce(case when event_id%2=0 then concat('active', user_id) end, case when event_id%3=0 then concat('last', user_id) end, case when event_id%5=0 then concat('open', user_id) end) as doc from events""")
def scan_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document to scan: the active one, else the last, else the first open one, else none."""
    said = lambda k, name: F.when(F.col("event_id") % k == 0, F.concat(F.lit(name), F.col("user_id")))
    return table(spark, sf_dir, "events").select("event_id", triggers.target(said(2, "active"), said(3, "last"), said(5, "open")).alias("doc"))


@query("select time_bucket(interval 6 hours, ts, timestamp '1970-01-01') as start, count(*) as events from events group by 1")
def poll_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.polls(table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "events")


@query("""with recursive p as (select user_id % 4 as key, epoch_us(ts) // 1000 as t, row_number() over (partition by user_id % 4, epoch_us(ts) // 1000) as k from events),
r as (select key, min(t) as t from p group by key union all select r.key, min(p.t) from r join p on p.key = r.key and p.t >= r.t + 43200000 group by r.key)
select p.key, p.t, p.k = 1 and r.t is not null as passed from p left join r on p.key = r.key and p.t = r.t""")
def poll_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a poll of one of four timers."""
    e = table(spark, sf_dir, "events")
    return triggers.throttle(e.select((F.col("user_id") % 4).alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t")))


# feedback


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.get_json_object("props", "$.k")
    fix = F.array(*[F.concat(F.lit(f"{i}. step "), n) for i in range(1, 5)])
    reply = F.to_json(F.struct(F.concat(F.lit("why "), n).alias("why"), fix.alias("fix"), F.lit("plain").alias("maintainability"), F.when(F.col("event_id") % 2 == 0, F.lit("final k = env;")).alias("example")))
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 == 3, F.concat(F.lit("no json "), n)).otherwise(reply).alias("raw"))


@query("""with n as (select event_id, json_extract_string(props,'$.k') as n from events)
select event_id, concat('### 💡 Educational feedback' || chr(10) || chr(10), case when event_id%4=3 then concat('no json ', n) else concat('**Why**: why ', n, chr(10), chr(10), '**Fix**:', chr(10), '- step ', n, chr(10), '- step ', n, chr(10), '- step ', n, chr(10), chr(10), '**Maintainability**: plain', chr(10), chr(10),
 case when event_id%2=0 then '**Example**:' || chr(10) || chr(10) || chr(10) || '```dart' || chr(10) || 'final k = env;' || chr(10) || '```' || chr(10) else '' end) end) as markdown from n""")
def feedback_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("event_id", feedback.markdown(F.col("raw")).alias("markdown"))


@query("""select event_id, case when event_id%3=0 then props end as object from events""")
def json_isolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done"))).when(F.col("event_id") % 3 == 1, F.lit("} {")).otherwise(F.lit("none"))
    return table(spark, sf_dir, "events").select("event_id", feedback.json_object(raw).alias("object"))


@query("select concat('lib/u', user_id, ':', event_id%50, ':', event_id%9) as key, event_type as feedback from events where not starts_with(concat('lib/u', user_id, ':', event_id%50, ':', event_id%9), 'lib/u1')")
def cache_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cache = e.select(feedback.cache_key(F.concat(F.lit("lib/u"), F.col("user_id")), F.col("event_id") % 50, F.col("event_id") % 9).alias("key"), F.col("event_type").alias("feedback"))
    return feedback.invalidate(cache, "lib/u1")


@query("""with cache as (select concat(url, ':', page_id % 50, ':', page_id % 9) as key, page_id from pages union all select concat('lib/u', event_id, ':', user_id, ':1'), event_id from events),
gone as (select distinct url[1:12 + page_id % 20] as uri from pages where page_id % 3 = 0 union select distinct 'lib/u' || event_id || case when event_id % 2 = 0 then ':' else '' end from events where event_id % 7 = 0)
select key, page_id::varchar as feedback from cache where not exists (select 1 from gone where starts_with(key, uri))""")
def cache_invalidate_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache over all pages and events without the keys that start with any of thousands of addresses."""
    pages, events = table(spark, sf_dir, "pages"), table(spark, sf_dir, "events")
    n, e = F.col("page_id"), F.col("event_id")
    cache = pages.select(feedback.cache_key(F.col("url"), n % 50, n % 9).alias("key"), n.cast("string").alias("feedback"))
    cache = cache.unionByName(events.select(feedback.cache_key(F.concat(F.lit("lib/u"), e), F.col("user_id"), F.lit(1)).alias("key"), e.cast("string").alias("feedback")))
    gone = pages.where("page_id % 3 = 0").select(F.expr("left(url, cast(12 + page_id % 20 as int))").alias("uri"))
    gone = gone.unionByName(events.where("event_id % 7 = 0").select(F.concat(F.lit("lib/u"), e, F.when(e % 2 == 0, ":").otherwise("")).alias("uri")))
    return feedback.invalidate_all(cache, gone)


@query("""with r as (select event_id, event_id % 4 as kind, json_extract_string(props, '$.k')::int as k from events)
select event_id, case kind when 0 then 'why ' || k end as why, case when kind < 1 then 'plain' end as maintainability, case kind when 1 then 'field why is not string' when 2 then 'not JSON' when 3 then 'not an object' end as reason from r""")
def reply_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made of all events, field by field: good ones, one with a field of another type, broken ones and lists."""
    n, k = F.col("event_id"), F.get_json_object("props", "$.k")
    raw = F.when(n % 4 == 0, F.concat(F.lit('{"why":"why '), k, F.lit('","maintainability":"plain"}'))).when(n % 4 == 1, F.concat(F.lit('{"why":'), k, F.lit("}")))
    raw = raw.when(n % 4 == 2, F.concat(F.lit('{"why":'), "props")).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    read = elements.objects(table(spark, sf_dir, "events").select("event_id", raw.alias("content")), FEEDBACK, strict=True)
    return read.select("event_id", "value.why", "value.maintainability", "reason")


_PARTS = ["'" + part.replace("'", "''") + "'" for part in feedback.PROMPT.split("%s")]


@query(f"select event_id, concat({_PARTS[0]}, event_type, {_PARTS[1]}, case when event_id%2=0 then props else '{feedback.NO_SNIPPET}' end, {_PARTS[2]}) as prompt from events")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of every event, half of which have no snippet."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", feedback.prompt(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("")).alias("prompt"))


# code metrics


@query("""with k as (select event_id, json_extract_string(props, '$.k')::int as k from events)
select 'e' || event_id as path, 'v' || event_id as value, 'f' || event_id as function_name, 1 + k % 5 + k % 3 as complexity, greatest(k % 3, least(k % 5, 1)) as nesting_depth, 3 + k % 5 as function_loc from k""")
def code_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function for every event, with as many branches and as deep as its k says."""
    n, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    times = lambda text, m: F.repeat(F.lit(text), m)
    body = F.concat(F.lit("void f"), n, F.lit("(bool a) {\n"), times("  if (a) { x(); }\n", k % 5), times("while (a) { ", k % 3), F.lit('final s = "v'), n, F.lit('";'), times(" }", k % 3), F.lit("\n}\n"))
    sources = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), n).alias("path"), body.alias("content"))
    return metrics.literal_metrics(sources).select("path", "value", "function_name", "complexity", "nesting_depth", "function_loc")


@query("""with x as (select distinct user_id % 40 as f, event_id % 50 as s, event_id % 50 + event_id % 17 as e from events), p as (select event_id, user_id % 40 as f, event_id % 60 as at from events)
select p.event_id as point_id, arg_min(concat('x', x.e - x.s, '-', x.s), (x.e - x.s, x.s)) filter (where x.s is not null) as name from p left join x on p.f = x.f and p.at between x.s and x.e group by 1""")
def enclosing_executable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest of the file's intervals that holds each point; an interval and a point for every event."""
    e = table(spark, sf_dir, "events").withColumn("file", F.col("user_id") % 40)
    x = e.select("file", (F.col("event_id") % 50).alias("start"), (F.col("event_id") % 50 + F.col("event_id") % 17).alias("end")).distinct()
    x = x.withColumn("name", F.concat(F.lit("x"), F.col("end") - F.col("start"), F.lit("-"), F.col("start")))
    return metrics.enclosing(e.select("file", F.col("event_id").alias("point_id"), (F.col("event_id") % 60).alias("offset")), x).select("point_id", "name")
