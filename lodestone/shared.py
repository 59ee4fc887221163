"""Tables between the steps of an operator, in the folder that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of narrow keys that may go to all tasks.
FEW = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session may leave it unset and gets one beside its warehouse."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """The table, written once and read again: what follows starts from files, and a lost executor costs the running step only."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_few(rows: DataFrame, keys: DataFrame, on, how: str) -> DataFrame:
    """A join with a kept table of narrow keys: broadcast where its counted rows are few, else as Spark plans it."""
    return rows.join(F.broadcast(keys) if keys.count() <= FEW else keys, on, how)
