"""Tables between the steps of an operator, kept where every executor can read them.

Lineage is cut with Parquet tables under the folder the session names in
spark.checkpoint.dir.  A lost executor then costs the running step only.  Where
the setting is empty (a local session, as in tests) a folder under the
warehouse is used.
"""

from __future__ import annotations

import math
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Rows of narrow keys (16 to 80 bytes each in memory) that may go to all tasks.
BROADCAST_ROWS = 1 << 20
#: Partitions of a shuffle at most; larger tables have several parts to a partition, worked on one after the other.
MOST_PARTS = 1 << 16
RECORDS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
#: A reader's batch of whole texts is one array on the heap for each column.
SCANNED, SCAN_ROWS = "spark.sql.parquet.columnarReaderBatchSize", 1024
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
    return found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


class Scratch:
    """One call's tables. `keep` writes a table and reads it again; `drop` deletes those no later step needs.

    A result that is read lazily needs its tables, so a query's last ones stay; a caller that has written the result
    deletes them with `close`, or those of all calls in between with `mark` and `close_since`.
    """

    _made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        Scratch._made.append(self)
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}", {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        conf = self.spark.conf
        # a written step's shuffle files are of no more use; batches of whole texts are held twice, so they stay small
        rows = int(conf.get(RECORDS))
        now = {CLEAN: "true", RECORDS: str(min(BATCH_ROWS, rows) if rows > 0 else BATCH_ROWS), SCANNED: str(min(SCAN_ROWS, int(conf.get(SCANNED))))}
        before = {k: conf.get(k, None) for k in now}
        try:
            for k, v in now.items():
                conf.set(k, v)
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)

    def close(self) -> None:
        """Deletes all tables of the call. For callers whose result does not read them any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(conf).delete(path, True)

    @classmethod
    def mark(cls) -> int:
        return len(cls._made)

    @classmethod
    def close_since(cls, mark: int) -> None:
        """Deletes the tables of the calls made since the mark."""
        while len(cls._made) > mark:
            cls._made.pop().close()

    @property
    def local(self) -> bool:
        return urlparse(self.root).scheme in ("", "file")


def bytes_of(df: DataFrame) -> int:
    """Bytes that a table's sources hold by Spark's own statistics (file sizes of a scan); sources of unknown size count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def by_keys(rows: DataFrame, keys: DataFrame, on, how: str, known: int | None = None) -> DataFrame:
    """A join of wide rows with a kept table of narrow keys: broadcast where its counted rows are few, else as Spark plans it."""
    n = keys.count() if known is None else known
    return rows.join(F.broadcast(keys) if n <= BROADCAST_ROWS else keys, on, how)


def parts_for(df: DataFrame, per: int) -> int:
    """Partitions so that each holds about `per` bytes of the table, the session's number at least and MOST_PARTS at most."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(MOST_PARTS, math.ceil(bytes_of(df) / per)))


def subs_for(df: DataFrame, per: int, parts: int) -> int:
    """Parts of a partition so that each holds about `per` bytes of the table."""
    return max(1, math.ceil(bytes_of(df) / per / parts))
