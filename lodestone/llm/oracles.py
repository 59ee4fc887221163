"""DuckDB SQL with the rows of those operators that SQL can express, for tables of a few thousand documents."""

from __future__ import annotations

from .jaccard import PERCENT, SHINGLE
from .licenses import LOWER, PHRASES, TEMPLATES, UPPER, library
from .substring import WINDOW

WORDS = r"'[^\x20\x09-\x0D]+'"


def jaccard() -> str:
    """Shingle sets, their overlaps by a self-join, and the least id that links reach."""
    k = SHINGLE
    return rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORDS}) as w from documents),
x as (select doc_id, pos, string_agg(word, ' ') over (partition by doc_id order by pos rows between current row and {k - 1} following) as g, n
  from (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos, len(w) as n from w)),
s as (select distinct doc_id, g from x where pos <= greatest(1, n - {k - 1})),
c as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select a, b from p join c x on x.doc_id = a join c y on y.doc_id = b where 100 * c >= {PERCENT} * (x.n + y.n - c)),
r as (select doc_id as v, doc_id as m from c union select e.b, r.m from r join e on e.a = r.v where r.m < e.b),
l as (select v, min(m) as m from r group by v)
select d.doc_id, coalesce(c.n, 0)::bigint as n_shingles, coalesce(l.m, d.doc_id) as component_id from documents d left join c on c.doc_id = d.doc_id left join l on l.v = d.doc_id"""


def substring() -> str:
    """Every window as a string; words under a window that is met twice go."""
    k = WINDOW
    return rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) as w from documents),
x as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos, len(w) as n from w),
t as (select doc_id, word, pos, case when pos <= n - {k - 1} then md5(string_agg(word, ' ') over (partition by doc_id order by pos rows between current row and {k - 1} following)) end as t from x),
m as (select *, t is not null and count(*) over (partition by t) > 1 as again from t),
g as (select *, max(again::int) over (partition by doc_id order by pos rows between {k - 1} preceding and current row) = 1 as gone from m),
o as (select doc_id, count(*) as n, count(*) filter (where gone) as r, string_agg(word, ' ' order by pos) filter (where not gone) as kept from g group by doc_id)
select d.doc_id, coalesce(o.n, 0)::bigint as n_words, coalesce(o.r, 0)::bigint as n_removed, sha256(coalesce(o.kept, '')) as kept_sha256 from documents d left join o on o.doc_id = d.doc_id"""


def licenses() -> str:
    """Phrase places, lines that hold enough of a template, and windows of words that hold enough of a template or notice."""
    quote = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]::varchar[]"
    known = library()
    lib = ", ".join(f"({t[0]}, '{t[1]}', {quote(t[2])}, {t[3]}, {t[4]}, {quote(t[5])}, {quote(t[6])})" for t in known)
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return rf"""
with low as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as l from documents),
d as (select doc_id, regexp_extract_all(l, {word}) as w, l from low),
lib(k, label, words, need, span, shut, must) as (values {lib}),
x as (select doc_id, unnest(w) as token, generate_subscripts(w, 1) as pos from d),
t as (select x.doc_id, x.pos, list_value(x.token, lead(x.token, 1) over o, lead(x.token, 2) over o) as w0, x.token from x window o as (partition by x.doc_id order by x.pos)),
hits as ({_phrases()}),
base as (select doc_id, count(*) as n, min(place) as a, max(place) as b, list(distinct label) as labels from hits group by doc_id),
lines as (select doc_id, line, list_distinct(regexp_extract_all(line, {word})) as w from (select doc_id, unnest(string_split(l, chr(10))) as line from d)),
by_line as (select doc_id, label, len(list_intersect(w, words)) / len(words) as share from lines, lib where k < {len(TEMPLATES)} and len(w) >= need and len(list_intersect(w, words)) >= need),
y as (select doc_id, k, pos, token, list_contains(shut, token) as shut, span from x join (select k, span, shut, unnest(list_distinct(list_concat(words, shut))) as token from lib) using (token)),
z as (select doc_id, k, list_distinct(list(case when not shut then token end) over f) as held, max(shut::int) over f as other from y window f as (partition by doc_id, k order by pos range between current row and span - 1 following)),
by_window as (select doc_id, label, len(list_filter(held, lambda h: h is not null)) / len(words) as share from z join lib using (k) where other = 0 and len(list_filter(held, lambda h: h is not null)) >= need and list_has_all(held, must)),
more as (select doc_id, list(distinct label) as labels, max(share) as best from (select * from by_line union all select * from by_window) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(base.n, 0)::bigint as n_base, base.a::bigint as first_word, base.b::bigint as last_word,
 coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, more.labels))), ','), '') as labels,
 case when base.n > 0 then 1.0::double else coalesce(more.best, 0.0)::double end as score from d left join base using (doc_id) left join more using (doc_id)"""


def _phrases() -> str:
    """Places of the phrases, which have three words at most."""
    out = []
    for p, label in PHRASES.items():
        words = p.split()
        out.append(f"select doc_id, pos - 1 as place, '{label}' as label from t where " + " and ".join(f"w0[{i + 1}] = '{w}'" for i, w in enumerate(words)))
    return " union all ".join(out)


def archives() -> str:
    """Lengths and digests of payloads; of equal ones all but the least id's are revisits."""
    five = lambda i: f"('0x' || substr(h, {5 * i + 1}, 5))::bigint"
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({five(i)} >> {15 - 5 * j}) & 31)::int + 1, 1)" for i in range(8) for j in range(4))
    return f"""
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as h from pages),
f as (select *, min(page_id) over (partition by h) as first from p)
select page_id, payload_bytes, {letters} as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from f"""


def caps(cosine: float = 0.9) -> str:
    """All pairs of vectors by cosine, and the least id that links reach."""
    return f"""
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
u as (select vec_id, e, sqrt(list_inner_product(e, e)) as n from v where list_inner_product(e, e) > 0),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_inner_product(a.e, b.e) / (a.n * b.n) >= {cosine}),
r as (select vec_id as v, vec_id as m from u union select l.b, r.m from r join l on l.a = r.v where r.m < l.b),
c as (select v, min(m) as m from r group by v),
n as (select a, count(*) as n from l group by a)
select s.vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(c.m, s.vec_id) as component_id, coalesce(c.m, s.vec_id) = s.vec_id as kept from embeddings s left join c on c.v = s.vec_id left join n on n.a = s.vec_id"""
