"""Source files in, findings in and out."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.findings import for_json
from ..schemas import FINDING, JSON_NAMES
from .store import Store


def plain_path(uri: Column, given: str | list[str]) -> Column:
    """A file's address as a path: percent signs decoded, and without the scheme of local files unless one was given."""
    path = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    schemes = any(re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", p) for p in ([given] if isinstance(given, str) else given))
    return path if schemes else F.regexp_replace(path, "^file:/+", "/")


def read_sources(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files of any folders or patterns, one row each: path, as it was given, and content. A missing path raises, as a scan without its file must."""
    return spark.read.text(paths, wholetext=True).select(plain_path(F.col("_metadata.file_path"), paths).alias("path"), F.col("value").alias("content"))


def stream_sources(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The same for files that arrive in a folder: a stream of path and content."""
    read = spark.readStream.options(**options).text(folder, wholetext=True)
    return read.select(plain_path(F.col("_metadata.file_path"), folder).alias("path"), F.col("value").alias("content"))


def findings_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, FINDING)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """The findings store; empty where there is none yet."""
    return findings_store(spark, path).read()


def read_findings_json(spark: SparkSession, path: str) -> DataFrame:
    """Findings of JSON files, each of one list or of one object; malformed input gives none.

    Fields have the names of JSON_NAMES; ord, where it is not there, numbers the findings in the order of the list.
    """
    schema = T.StructType([T.StructField(JSON_NAMES.get(f.name, f.name), f.dataType) for f in FINDING])
    try:
        found = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)
    except AnalysisException:
        return spark.createDataFrame([], FINDING)
    named = found.select(*[F.col(JSON_NAMES.get(f.name, f.name)).alias(f.name) for f in FINDING])
    return named.withColumn("ord", F.coalesce("ord", F.monotonically_increasing_id()))


def write_findings(findings: DataFrame, path: str) -> None:
    """Replaces the store."""
    findings_store(findings.sparkSession, path).replace(findings)


def write_json(findings: DataFrame, path: str) -> None:
    """One object a line with nulls kept, under the fields' JSON names."""
    for_json(findings).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def reset(spark: SparkSession, path: str) -> None:
    """Starts a session with an empty store."""
    write_findings(spark.createDataFrame([], FINDING), path)


def reset_folders(spark: SparkSession, *folders: str) -> list[str]:
    """Removes those of the folders, and of the folders within them, that hold nothing; which of the given ones went."""
    conf, paths = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    gone = []
    for folder in folders:
        where = paths(folder)
        fs = where.getFileSystem(conf)
        if fs.exists(where) and not fs.listStatus(where):
            fs.delete(where, False)
            gone.append(folder)
    return gone


_cleared: set[tuple[str, str]] = set()


def reset_once(spark: SparkSession, path: str) -> bool:
    """Empties the store at its first use in an application, and only then; whether it did."""
    key = (spark.sparkContext.applicationId, path)
    if key in _cleared:
        return False
    reset(spark, path)
    _cleared.add(key)
    return True
