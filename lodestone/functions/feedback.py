"""Educational feedback: prompts, replies and the cache. The model call itself is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FEEDBACK

# The prompt's wording is our own; what it asks for and the fields of the reply are fixed.
NO_SNIPPET = "// (no code snippet provided)"
TITLE = "### 💡 Educational feedback\n\n"
PROMPT = """You help Dart developers with secrets written into client code. Reply with one JSON object:
{"why": "the risk in two or three short sentences", "fix": ["up to three short steps"], "maintainability": "one sentence on complexity, nesting and size", "example": "a short safe alternative in Dart"}
Secrets belong on a server; whatever ships in an app can be extracted. Never move a secret to another file, and do not offer encryption in the client as the way out.
The maintainability sentence takes its words from the issue details and begins: Because complexity is X, nesting is Y, and size is Z,

Issue details:
%s

Code (Dart):
%s"""


def prompt(issue: Column, snippet: Column) -> Column:
    return F.format_string(PROMPT.replace("%", "%%").replace("%%s", "%s"), issue, F.coalesce(F.nullif(snippet, F.lit("")), F.lit(NO_SNIPPET)))


def json_object(raw: Column) -> Column:
    """From the first opening to the last closing brace, or null."""
    return F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))


def parsed(raw: Column) -> Column:
    """The reply's fields; null where it isn't a JSON object."""
    return F.when(F.rlike(raw, F.lit(r"(?s)^\s*\{.*\}\s*\z")), F.from_json(raw, FEEDBACK, {"mode": "PERMISSIVE"}))


def markdown(raw: Column) -> Column:
    """A reply as Markdown; what isn't JSON is shown as it is."""
    reply = parsed(raw)
    part = lambda c, *around: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(around[0]), c, F.lit(around[1]))).otherwise(F.lit(""))
    steps = F.transform(F.slice(reply["fix"], 1, 3), lambda s: F.concat(F.lit("- "), F.regexp_replace(s, r"^\d+\.\s*", ""), F.lit("\n")))
    fix = F.when(F.size(reply["fix"]) > 0, F.concat(F.lit("**Fix**:\n"), F.concat_ws("", steps), F.lit("\n"))).otherwise(F.lit(""))
    example = F.when(F.trim(F.coalesce(reply["example"], F.lit(""))) != "", F.concat(F.lit("**Example**:\n\n\n```dart\n"), reply["example"], F.lit("\n```\n"))).otherwise(F.lit(""))
    body = F.concat(part(reply["why"], "**Why**: ", "\n\n"), fix, part(reply["maintainability"], "**Maintainability**: ", "\n\n"), example)
    return F.concat(F.lit(TITLE), F.when(reply.isNull(), raw).otherwise(body))


def cache_key(uri: Column, line: Column, character: Column) -> Column:
    return F.concat_ws(":", uri, line.cast("string"), character.cast("string"))


def invalidate(cache: DataFrame, uri: Column | str) -> DataFrame:
    """The cache (key, feedback) without the keys that start with the address; longer addresses with that start go too."""
    return cache.where(~F.startswith(F.col("key"), F.lit(uri) if isinstance(uri, str) else uri))


def invalidate_all(cache: DataFrame, addresses: DataFrame) -> DataFrame:
    """The cache without the keys that start with any of many addresses (uri).

    A key is looked up by its beginnings of the lengths that addresses have, so all joins are by equal texts.  An
    empty address starts every key; null addresses start none, and a null key starts with none.
    """
    known = addresses.select("uri").where("uri is not null").distinct()
    lengths = sorted(r[0] for r in known.select(F.length("uri")).distinct().collect())  # bounded by the longest address
    each = F.explode(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("key")))
    starts = cache.select("key").where("key is not null").select("key", each.alias("n")).select("key", F.expr("left(key, n)").alias("uri"))
    return cache.join(starts.join(known, "uri", "left_semi").select("key").distinct(), "key", "left_anti").select(*cache.columns)
