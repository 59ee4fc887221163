"""Detection of hardcoded secrets in literals.

How rules and heuristics apply is our own reconstruction: a finding for each
literal and matching rule in rule order, and the heuristics where no rule
matches.  Up to UNROLLED patterns become one array of hits whose patterns
compile once; more stay a table and go through an index of the texts that their
matches must hold.  Both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import finding_message, heuristic_message
from ..sources.rules import Heuristics, compiled, in_use
from . import rule_index
from .literals import entropy, literals
from .metrics import literal_metrics

UNROLLED = rule_index.UNROLLED
#: Places for the rules of a literal in the order of a file's findings.
RANKS = 1 << 32
HEURISTIC_ID = "HEUR.SECRET"
NODE_KIND = "string literal"


def _hits(found: DataFrame, rules: DataFrame, unrolled: int = UNROLLED, outer: bool = True) -> DataFrame:
    """found with a struct _hit for each matching rule; outer: one row with a null _hit where none matches."""
    if len(in_use(rules).select(F.lit(1)).take(unrolled + 1)) > unrolled:
        return rule_index.met(found, rules, outer)
    good = compiled(rules)[0]
    if not good:
        out = found.withColumn("_hit", F.lit(None).cast(rule_index.HIT_TYPE))
        return out if outer else out.where("false")
    all_ = rule_index.hits(found, good, unrolled)
    return all_.select(*found.columns, (F.explode_outer if outer else F.explode)("_hits").alias("_hit"))


def match_rules(found: DataFrame, rules: DataFrame, unrolled: int = UNROLLED, first_only: bool = False) -> DataFrame:
    """Literals with each enabled rule whose pattern is found in their value; invalid patterns are left out."""
    out = _hits(found, rules, unrolled, outer=False)
    keys = [*found.columns]
    if first_only:
        out = out.groupBy(*keys).agg(F.min_by("_hit", F.col("_hit.rank")).alias("_hit"))
    return out.select(*keys, "_hit.*")


def suspicious(h: Heuristics) -> Column:
    """Whether a literal (context, value) is long, random, named like a secret and not marked as harmless."""
    context, value = F.lower("context"), F.lower("value")
    has = lambda c, words: F.greatest(F.lit(False), F.lit(False), *[F.contains(c, F.lit(w.lower())) for w in words])
    named = has(context, h.sensitive) & (F.length("value") >= h.min_length) & ~has(value, h.benign) & ~has(context, h.benign)
    return F.coalesce(F.when(named, entropy(F.col("value")) >= h.min_entropy), F.lit(False))


def match_heuristics(found: DataFrame, h: Heuristics) -> DataFrame:
    """Suspicious literals with their entropy."""
    return found.where(suspicious(h)).withColumn("entropy", entropy(F.col("value")))


def detected(found: DataFrame, rules: DataFrame, h: Heuristics | None = None, node_kind: str = NODE_KIND, unrolled: int = UNROLLED) -> DataFrame:
    """Findings of literals: their columns, rule_id, rule_name, severity, message and rank (null for the heuristics)."""
    hits = _hits(found, rules, unrolled)
    kept = hits.where(F.col("_hit").isNotNull() | suspicious(h or Heuristics()))
    by_rule, kind = F.col("_hit").isNotNull(), F.lit(node_kind)
    pick = lambda c, other: F.when(by_rule, F.col(f"_hit.{c}")).otherwise(F.lit(other))
    message = F.when(by_rule, finding_message(F.col("_hit.rule_name"), kind, F.col("context"))).otherwise(heuristic_message(kind))
    return kept.select(*found.columns, pick("rule_id", HEURISTIC_ID).alias("rule_id"), pick("rule_name", "Secret").alias("rule_name"), pick("severity", "warning").alias("severity"), message.alias("message"), F.col("_hit.rank").alias("rank"))


def scan(sources: DataFrame, rules: DataFrame, h: Heuristics | None = None, text: str = "content", node_kind: str = NODE_KIND) -> DataFrame:
    """Findings of texts of any kind, whose literals are what stands in quotes on a line: the sources' other columns, line, column, lit_no, context, value, rule_id, rule_name, severity, message."""
    return detected(literals(sources, text), rules, h, node_kind).drop("rank")


def scan_sources(sources: DataFrame, rules: DataFrame, h: Heuristics | None = None, node_kind: str = NODE_KIND) -> DataFrame:
    """Issues of Dart sources (path, content), ready for the store: file, line, column, rule_id, rule_name, severity, message, metrics, line_length and ord.

    Literals are the parser's, so those in comments don't count and raw, triple-quoted and escaped ones do.  ord
    numbers the findings of a file in the order of their literals and rules.
    """
    found = literal_metrics(sources)
    out = detected(found, rules, h, node_kind)
    order = F.col("literal_no").cast("long") * RANKS + F.coalesce("rank", F.lit(RANKS - 1))
    return out.select(
        order.alias("ord"), F.col("path").alias("file"), "line", "column", "rule_id", "rule_name", "severity", "message", "context", "value",
        "function_name", "complexity", "nesting_depth", "function_loc", "line_length", "snippet",
    )
