"""The four things a user does: scan files, manage rules, open the dashboard, update rule packs.

A workspace is a folder that all machines can reach: `data/` holds the rules in
effect, `findings/` the store, `user_rules/` the user's own rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .operators import dashboard as board
from .operators import detect, findings
from .schemas import RULE
from .shared import keep
from .sources import files, rules
from .sources.store import Store

USER_RULES = T.StructType([*RULE.fields]).add("ord", "long")


def _own_rules(spark: SparkSession, workspace: str) -> Store:
    return Store(spark, f"{workspace}/user_rules", T.StructType([*USER_RULES.fields]).add("file", "string"), buckets=1)


def user_rules(spark: SparkSession, workspace: str) -> DataFrame:
    """The user's own rules, numbered from 0; none where there are none yet."""
    return _own_rules(spark, workspace).read().select(*USER_RULES.names)


def update(spark: SparkSession, workspace: str, cached: rules.Pack, bundled: rules.Pack, remote: rules.Pack | None, now_ms: int, force: bool = False) -> rules.Pack:
    """Polls the pack, falls back on what is bundled, and writes the rules in effect into the workspace."""
    pack = rules.sync(cached, remote, now_ms, force)
    whole = rules.bootstrap(pack, bundled)
    numbered = whole.rules if "ord" in whole.rules.columns else whole.rules.withColumn("ord", F.monotonically_increasing_id())
    rules.materialise(rules.effective(user_rules(spark, workspace), numbered), whole.heuristics or rules.Heuristics(), f"{workspace}/data")
    return pack


def manage(spark: SparkSession, workspace: str, action: str, rule: dict | None = None, rule_id: str | None = None, at: int | None = None) -> DataFrame:
    """Adds, edits or deletes a user rule and returns all of them; an incomplete rule changes nothing."""
    now = user_rules(spark, workspace)
    if action in ("add", "edit"):
        new = rules.validate(spark.createDataFrame([tuple((rule or {}).get(c) for c in RULE.names)], RULE))
        if not new.limit(1).count():
            return now
        if action == "add":
            now = rules.add(now, new.withColumn("enabled", F.lit(None).cast("boolean")).withColumn("ord", F.lit(0).cast("long")))
        else:
            now = rules.edit(now, at, new.first().asDict())
    elif action == "delete":
        now = rules.delete(now, rule_id, at)
    elif action != "list":
        raise ValueError(f"no action {action}")
    if action != "list":
        _own_rules(spark, workspace).replace(now.select(*USER_RULES.names, F.lit("user_rules").alias("file")))
    return user_rules(spark, workspace)


#: The order in which a scan's findings come: files by their paths, a file's findings as `detect` numbers them.
ORDER = ["file", "ord", "line", "column", "rule_id", "message"]


def scan(spark: SparkSession, workspace: str, paths: str | list[str]) -> DataFrame:
    """Scans files by the rules in effect, replaces their findings in the store and returns the issues. A missing path raises.

    Files are read and parsed once: the issues come from a kept table.
    """
    return scanned(workspace, files.read_sources(spark, paths))


def scanned(workspace: str, sources: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame:
    """`scan` of sources (path, content); a batch that the store has already changes nothing."""
    spark = sources.sparkSession
    known, h = rules.materialised(spark, f"{workspace}/data")
    issues = keep(detect.scan_sources(sources, known, h), "issues")
    store = files.findings_store(spark, f"{workspace}/findings")
    store.upsert(findings.to_findings(issues, F.col("line_length")), sources.select(F.col("path").alias("file")), ORDER, batch)
    return issues


def watch(spark: SparkSession, workspace: str, folder: str, checkpoint: str, name: str = "watch", read: dict | None = None, **trigger) -> StreamingQuery:
    """Scans files as they arrive in a folder, micro-batch by micro-batch, into the store.

    The store records each batch with its findings in one commit, so a batch that is run again after a stop changes
    nothing: the store ends up as a scan of all files at once would leave it, but for the numbers' order.
    """
    stream = files.stream_sources(spark, folder, **(read or {}))
    write = stream.writeStream.foreachBatch(lambda df, k: scanned(workspace, df, (name, k)) and None)
    return write.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start(spark: SparkSession, workspace: str) -> bool:
    """The first use of a workspace in a session empties its findings, and folders of it that hold nothing go; whether this was the first."""
    if not files.reset_once(spark, f"{workspace}/findings"):
        return False
    files.reset_folders(spark, f"{workspace}/out", f"{workspace}/data/rules", f"{workspace}/data/heuristics", f"{workspace}/data")
    return True


def dashboard(spark: SparkSession, workspace: str) -> dict[str, DataFrame]:
    """Counters, table, top lists and hotspots of the store; all of an empty one where there is none."""
    found = files.read_findings(spark, f"{workspace}/findings")
    return {"counters": board.counters(found), "table": board.table(found), "rules": board.top_counts(found, F.col("rule_id")), "files": board.top_counts(found, F.col("file")), "hotspots": board.hotspots(found)}
