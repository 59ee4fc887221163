"""Rule packs: resilient readers, effective rules, edits and synchronisation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import elements
from ..functions.patterns import at_the_end, sound
from ..schemas import HEURISTICS, MANIFEST, RULE

#: Rules in use at most that are read as a list; more stay a table (operators.rule_index).
RULES = 500_000
THROTTLE_MS = 12 * 60 * 60 * 1000
POLL = "6 hours"

# The patterns of the base rules.
BASE_RULES = [
    ("GOOGLE_API_KEY", "Google API Key", r"^AIza[0-9A-Za-z\-_]{35}$", "warning"),
    ("AWS_ACCESS_KEY", "AWS Access Key ID", r"^AKIA[0-9A-Z]{16}$", "warning"),
    ("STRIPE_LIVE_KEY", "Stripe Live Secret Key", r"^sk_live_[0-9A-Za-z]{16,}$", "warning"),
    ("JWT", "JWT-like Token", r"eyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+", "warning"),
    ("GITHUB_TOKEN", "GitHub Token (classic)", r"^ghp_[A-Za-z0-9]{36}$", "warning"),
    ("GITLAB_PAT", "GitLab Personal Access Token", r"^glpat-[A-Za-z0-9\-_]{20,}$", "warning"),
]


@dataclass(frozen=True)
class Heuristics:
    """Parameters of the heuristic detector; the defaults are fixed values."""

    min_length: int = 10
    min_entropy: float = 3.3
    sensitive: tuple[str, ...] = field(default=("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "auth", "authorization", "bearer", "private", "key"))
    benign: tuple[str, ...] = field(default=("test", "dummy", "sample", "example", "fake", "placeholder", "changeme"))


def base_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, None, True) for r in BASE_RULES], RULE)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows (path, content); no rows where there is no file."""
    try:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    except AnalysisException:
        return spark.createDataFrame([], "path string, content string")


def read_json(spark: SparkSession, path: str, schema: T.StructType | T.ArrayType) -> DataFrame:
    """The value of each JSON file in a column v; no row where the file is missing, malformed or of another kind."""
    opens = "[" if isinstance(schema, T.ArrayType) else "{"
    parsed = F.from_json("content", schema, {"mode": "PERMISSIVE"})
    found = read_text(spark, path).where(F.startswith(F.ltrim("content"), F.lit(opens)) & (F.get_json_object("content", "$").isNotNull()))
    return found.select(parsed.alias("v")).where("v is not null")


def pack_elements(texts: DataFrame) -> DataFrame:
    """All elements of packs (path, content): path, ord, value (a rule, or null), raw and the reason for which one is refused."""
    return elements.lists(texts, RULE, strict=False)


def rules_from_text(texts: DataFrame, origin: str = "base") -> DataFrame:
    """Rules of JSON texts, in order: elements that aren't objects are dropped, the others stay; a text that isn't a list has none."""
    return pack_elements(texts).where("reason is null").select("value.*", F.lit(origin).alias("origin"), "ord")


def load_rules(spark: SparkSession, path: str, origin: str = "base") -> DataFrame:
    return rules_from_text(read_text(spark, path), origin)


def load_heuristics(spark: SparkSession, path: str) -> Heuristics:
    """Parameters of a JSON object; what is missing or malformed has its default. One row reaches the driver."""
    found = read_text(spark, path).select(F.from_json("content", HEURISTICS).alias("h")).select("h.*").first()
    d, h = Heuristics(), found.asDict() if found else {}
    pick = lambda k, default: default if h.get(k) is None else h[k]
    return Heuristics(pick("minLength", d.min_length), pick("minEntropy", d.min_entropy), tuple(pick("sensitiveKeywords", d.sensitive)), tuple(pick("benignMarkers", d.benign)))


def found_heuristics(spark: SparkSession, path: str) -> Heuristics | None:
    """Parameters of a JSON object; nothing where the file is missing, malformed or empty."""
    said = read_text(spark, path).where(F.size(F.json_object_keys("content")) > 0).limit(1).count()
    return load_heuristics(spark, path) if said else None


def materialise(effective_rules: DataFrame, heuristics: Heuristics, folder: str) -> None:
    """Writes the rules in effect, in order, and the heuristics below a folder, where a scan finds them."""
    spark = effective_rules.sparkSession
    # rules are a small table by nature: one file keeps their order
    numbered = _in_order(effective_rules).select(*RULE.names, "origin").withColumn("ord", F.monotonically_increasing_id())
    numbered.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/rules")
    row = [(heuristics.min_length, heuristics.min_entropy, list(heuristics.sensitive), list(heuristics.benign))]
    spark.createDataFrame(row, HEURISTICS).coalesce(1).write.mode("overwrite").json(f"{folder}/heuristics")


def materialised(spark: SparkSession, folder: str) -> tuple[DataFrame, Heuristics]:
    """Rules in effect and heuristics of a folder that `materialise` wrote; none and the defaults where there are none."""
    try:
        found = spark.read.schema(T.StructType([*RULE.fields]).add("origin", "string").add("ord", "long")).json(f"{folder}/rules")
    except AnalysisException:
        found = spark.createDataFrame([], T.StructType([*RULE.fields]).add("origin", "string").add("ord", "long"))
    return found, load_heuristics(spark, f"{folder}/heuristics")


def counts(rules: DataFrame) -> DataFrame:
    """(origin, rules, enabled): how many rules there are of each origin."""
    return rules.groupBy("origin").agg(F.count("*").alias("rules"), F.count_if(F.coalesce("enabled", F.lit(True))).alias("enabled"))


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as a row, or none."""
    return read_text(spark, path).select(F.from_json("content", MANIFEST).alias("m")).where("m is not null and (m.component is not null or m.version is not null)").select("m.*")


def resolve(name: str, working: str, installed: str) -> str:
    """A rule file's place: below the working folder's data if it is there, else beside the installation."""
    local = Path(working) / "data" / name
    return str(local if local.exists() else Path(installed).parent / "data" / name)


def base_url(value: str | None) -> str:
    """A configured address without white space and closing slashes; empty means no download."""
    return re.sub(r"/+$", "", (value or "").strip())


def effective(user: DataFrame, base: DataFrame) -> DataFrame:
    """User rules, then base rules, without removing repeated ids; priority numbers them in that order."""
    tagged = lambda df, k: df.drop("origin").withColumn("origin", F.lit(k))
    both = tagged(user, "user").unionByName(tagged(base, "base"), allowMissingColumns=True)
    return both.withColumn("priority", F.when(F.col("origin") == "user", 0).otherwise(1))


def valid() -> Column:
    """Whether a rule form is complete: id and pattern are not blank."""
    return (F.coalesce(F.trim("id"), F.lit("")) != "") & (F.coalesce(F.trim("pattern"), F.lit("")) != "")


def validate(rules: DataFrame) -> DataFrame:
    """Complete rules with their fields trimmed; the form has no enabled flag, so it is lost."""
    return rules.where(valid()).select(*[F.trim(c).alias(c) for c in ("id", "name", "pattern", "severity", "description")])


def add(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Appends rules; `ord` goes on from the greatest."""
    last = rules.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    return rules.unionByName(new.crossJoin(F.broadcast(last)).withColumn("ord", F.col("ord") + F.col("last") + 1).drop("last"), allowMissingColumns=True)


def edit(rules: DataFrame, at: int, values: dict[str, str]) -> DataFrame:
    """Replaces the rule at a place; fields that aren't given become null, as does enabled."""
    cols = [F.when(F.col("ord") == at, F.lit(values.get(c)).cast(rules.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in RULE.names else F.col(c) for c in rules.columns]
    return rules.select(*cols)


def delete(rules: DataFrame, rule_id: str | None, at: int | None = None) -> DataFrame:
    """Removes the first rule with the id; without such a rule, the one at the place; else nothing. `ord` closes up."""
    by_id = F.min(F.when(F.col("id") == rule_id, F.col("ord"))) if rule_id else F.lit(None).cast("int")
    by_place = F.max(F.when(F.col("ord") == at, F.col("ord"))) if at is not None else F.lit(None).cast("int")
    gone = rules.agg(F.coalesce(by_id, by_place).alias("gone"))
    kept = rules.crossJoin(F.broadcast(gone)).where("gone is null or ord != gone")
    return kept.withColumn("ord", F.col("ord") - F.when(F.col("ord") > F.col("gone"), 1).otherwise(0)).drop("gone")


def is_due(now_ms: Column, last_ms: Column, force: bool = False) -> Column:
    return F.lit(True) if force else (now_ms - F.coalesce(last_ms, F.lit(0))) >= THROTTLE_MS


def needs_update(local: DataFrame, remote: DataFrame, force: bool = False) -> DataFrame:
    """One row a remote manifest: whether its version differs from the local one's, or there is none."""
    mine = local.select(F.col("version").alias("_local")).limit(1)
    return remote.join(mine, how="left").select("*", (F.lit(force) | F.col("_local").isNull() | ~F.col("version").eqNullSafe(F.col("_local"))).alias("needs")).drop("_local")


@dataclass
class Pack:
    """Cached rules, heuristics, manifest version and time of the last download (epoch ms)."""

    rules: DataFrame
    heuristics: Heuristics | None
    version: str | None = None
    last: int = 0


def bootstrap(cached: Pack, bundled: Pack) -> Pack:
    """The cache, with the bundled rules and heuristics where it has none."""
    heuristics = bundled.heuristics if cached.heuristics is None else cached.heuristics
    return Pack(cached.rules if cached.rules.limit(1).count() else bundled.rules, heuristics, cached.version, cached.last)


def sync(cached: Pack, remote: Pack | None, now_ms: int, force: bool = False) -> Pack:
    """The pack after a poll. The time changes with a download only, not when versions already agree."""
    if remote is None or not force and now_ms - cached.last < THROTTLE_MS:
        return cached
    if not force and cached.version is not None and cached.version == remote.version:
        return cached
    return Pack(remote.rules, remote.heuristics, remote.version, now_ms)


def _in_order(rules: DataFrame) -> DataFrame:
    by = [c for c in ("priority", "ord") if c in rules.columns]
    return rules.orderBy(*by) if by else rules


def in_use(rules: DataFrame) -> DataFrame:
    return rules.where(F.coalesce("enabled", F.lit(True)))


def compiled(rules: DataFrame) -> tuple[list[dict], list[dict]]:
    """Enabled rules in order as a list on the driver, and those whose patterns don't compile.

    A closing $ becomes \\z, as the patterns' own dialect doesn't let it match before a final line break.
    """
    jvm = rules.sparkSession.sparkContext._jvm
    good, bad, used = [], [], in_use(rules)
    if used.limit(RULES + 1).count() > RULES:
        raise ValueError(f"more than {RULES} rules can't be sent to every task")
    for k, row in enumerate(_in_order(used).collect()):
        pattern = at_the_end(row["pattern"] or "")
        rule = {"rule_id": row["id"], "rule_name": row["name"] or row["id"], "pattern": pattern, "severity": row["severity"] or "warning", "rank": k}
        try:
            if not sound(pattern):
                jvm.java.util.regex.Pattern.compile(pattern)
            good.append(rule)
        except Exception:  # py4j raises its own error for a pattern that Java rejects
            bad.append(rule)
    return good, bad
