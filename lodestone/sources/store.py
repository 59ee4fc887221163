"""A table on disk that is replaced file by file and is never seen half done.

Rows live in buckets by the hash of their file.  A change writes the buckets it
touches into a new folder and then commits a manifest, which names the folder
of every live bucket; readers take the newest manifest that is whole.  A stop
before the commit leaves the old rows, a stop after it the new ones.  Folders
that no kept manifest names are removed by the next change.

    <path>/manifest/<version>.json      {"version", "buckets", "live": {bucket: folder}, "next", "batches": {stream: batch}}
    <path>/data/<folder>/b=<bucket>/    Parquet
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranges import ordinal
from ..shared import keep

BUCKETS, KEPT = 256, 2


class Conflict(Exception):
    """Another change was committed at the same time."""


@dataclass
class Manifest:
    version: int = 0
    buckets: int = BUCKETS
    live: dict[int, str] = field(default_factory=dict)
    next: int = 0
    batches: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"version": self.version, "buckets": self.buckets, "live": self.live, "next": self.next, "batches": self.batches})

    @staticmethod
    def of(text: str) -> Manifest | None:
        try:
            m = json.loads(text)
            return Manifest(m["version"], m["buckets"], {int(k): v for k, v in m["live"].items()}, m["next"], m["batches"])
        except (ValueError, KeyError, AttributeError, TypeError):
            return None


class Store:
    """Rows of one schema with a column `file`; the number of buckets is fixed by the first change."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop
        where = self._hadoop.fs.Path(self.path)
        self._fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self._hadoop.fs.Path("/".join([self.path, *names]))

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._at(folder)):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))]

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifest") if n.removesuffix(".json").isdigit() and n.endswith(".json"))

    def _read(self, version: int) -> Manifest | None:
        stream = self._fs.open(self._at("manifest", f"{version:012d}.json"))
        try:
            return Manifest.of(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> Manifest:
        """The newest manifest that is whole; an empty one where there is none."""
        for version in reversed(self._versions()):
            found = self._read(version)
            if found:
                return found
        return Manifest(buckets=self.buckets)

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.coalesce("file", F.lit(""))), F.lit(buckets)).cast("int")

    def _rows(self, m: Manifest, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/b={b}" for b, folder in sorted(m.live.items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The live rows."""
        return self._rows(self.manifest())

    def _stage(self, rows: DataFrame, buckets: int) -> tuple[str, set[int]]:
        """Writes rows into a new folder, by bucket, and returns it with the buckets that have rows."""
        folder = uuid.uuid4().hex
        dealt = rows.select(*self.schema.names, self._bucket(buckets).alias("b")).hint("rebalance", "b")  # a large bucket is split, small ones share a task
        dealt.write.partitionBy("b").parquet(f"{self.path}/data/{folder}")
        return folder, {int(n.removeprefix("b=")) for n in self._names(f"data/{folder}") if n.startswith("b=")}

    def _commit(self, m: Manifest) -> None:
        """Makes a manifest the newest; whoever creates its file first wins."""
        place = self._at("manifest", f"{m.version:012d}.json")
        try:
            out = self._fs.create(place, False)
        except Exception as e:  # py4j raises its own error
            if self._fs.exists(place):
                raise Conflict(f"version {m.version} of {self.path} exists") from e
            raise
        out.write(m.text().encode())
        out.close()

    def _sweep(self) -> None:
        """Removes manifests but the newest KEPT whole ones, and folders that none of them names. Runs after a commit and may stop at any point."""
        kept: list[Manifest] = []
        for version in reversed(self._versions()):
            found = self._read(version) if len(kept) < KEPT else None
            if found:
                kept.append(found)
            elif kept:
                self._fs.delete(self._at("manifest", f"{version:012d}.json"), False)
        named = {folder for m in kept for folder in m.live.values()}
        for folder in self._names("data"):
            if folder not in named:
                self._fs.delete(self._at("data", folder), True)

    def _next(self, now: Manifest, live: dict[int, str], after: int, batch: tuple[str, int] | None) -> Manifest:
        newest = max(self._versions(), default=0)
        return Manifest(newest + 1, now.buckets, live, after, now.batches | ({batch[0]: batch[1]} if batch else {}))

    def upsert(self, new: DataFrame, scanned: DataFrame, order: list[str] | None = None, batch: tuple[str, int] | None = None) -> bool:
        """Replaces the rows of all scanned files (file) by the new ones; a file scanned clean loses its rows. Whether it did anything.

        Only the buckets of those files are written anew.  With `order` the new rows are numbered in that order, in a
        column ord that goes on from the greatest given so far, so that older rows keep their numbers and places.
        A batch (stream, number) that is recorded already, or an older one of that stream, changes nothing.  Rows
        without a file stay.
        """
        now = self.manifest()
        if batch and now.batches.get(batch[0], -1) >= batch[1]:
            return False
        files = keep(scanned.select("file").where("file is not null").distinct(), "scanned")
        touched = {r[0] for r in files.select(self._bucket(now.buckets)).distinct().collect()}  # a number a bucket at most
        after = now.next
        if order:
            new = ordinal(new, order, now.next)
        new = keep(new.select(*self.schema.names), "new-rows")
        if order:
            after += new.count()
        touched |= {r[0] for r in new.select(self._bucket(now.buckets)).distinct().collect()}
        old = self._rows(now, touched).join(files, "file", "left_anti").select(*self.schema.names)
        folder, filled = self._stage(old.unionByName(new), now.buckets)
        live = {b: f for b, f in now.live.items() if b not in touched} | {b: folder for b in filled}
        self._commit(self._next(now, live, after, batch))
        self._sweep()
        return True

    def replace(self, rows: DataFrame) -> None:
        """Replaces everything; the rows may be computed from the old ones."""
        now = self.manifest()
        folder, filled = self._stage(rows, now.buckets)
        after = 0
        if "ord" in self.schema.names:
            after = (rows.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]) + 1
        self._commit(self._next(now, {b: folder for b in filled}, after, None))
        self._sweep()
