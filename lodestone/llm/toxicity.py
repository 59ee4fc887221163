"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between
them of a text, lower-cased and hashed into DIMENSIONS places.  The model is
fitted on at most SAMPLE labelled rows, so the fit's cost and the weights' size
have a bound that does not depend on the corpus; L1 leaves few weights, which
go to all tasks.  Scoring reads every whole text once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import steady
from .text import PUNCTUATED, Words, mix, pieces, stream

SAMPLE, EPOCHS, DIMENSIONS = 20_000, 4, 1 << 20
ALPHA, BETA, L1, L2 = 4.0, 1.0, 4.0, 0.1
CUT = 0.7


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Document number and place of each feature occurrence of a column; long texts in pieces, whose seams count again what they share."""
    parts = [_features(p) for p in pieces(column, 2)]
    if len(parts) == 1:
        return parts[0]
    at = np.unique(np.concatenate([np.unique(a) for _, a in parts]))  # only which features there are counts
    return np.zeros(len(at), np.int64), at


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = Words(column, lower=True, separators=PUNCTUATED)
    doc = np.repeat(np.arange(len(w)), w.count)
    out, docs = [w.hash], [doc]
    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap] if len(doc) > gap else np.zeros(0, bool)
        h = w.hash[:-gap] * np.uint64(2 * gap + 1) + mix(w.hash[gap:], gap) if len(doc) > gap else np.zeros(0, np.uint64)
        out.append(mix(h[same], gap))
        docs.append(doc[:-gap][same] if len(doc) > gap else np.zeros(0, np.int64))
    return np.concatenate(docs), (np.concatenate(out) >> np.uint64(64 - DIMENSIONS.bit_length() + 1)).astype(np.int64)


class Ftrl:
    """Per-coordinate rates and L1: weights follow from z and n when they are needed."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)  # the last place is the intercept

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, label: int) -> None:
        """at: distinct places, the intercept's included."""
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(rows: Iterator[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    model, rows = Ftrl(), [(np.append(at, DIMENSIONS), y) for at, y in rows]
    for _ in range(epochs):
        for at, y in rows:
            model.update(at, y)
    return model.weights()


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; 1 is held out. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(3))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from at most `sample` labelled rows that aren't held out: those whose ids have the least hashes.

    A document with several labels counts as toxic if one says so; null labels and ids count for nothing; of rows
    that repeat an id one is read.  With no labelled rows all weights are 0 and every score 0.5.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(remainder() != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")  # `sample` rows of two numbers
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in stream(batches):
            doc, at = features(part.column("text"))
            order = np.lexsort((at, doc))
            doc, at = doc[order], at[order]
            first = np.ones(len(at), bool)
            first[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
            doc, at = doc[first], at[first].astype(np.int32)
            cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
            blobs = [at[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic").cast(pa.int32()), pa.array(blobs, pa.binary())], ["doc_id", "toxic", "at"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(x, np.int32).astype(np.int64), y) for b in batches for x, y in zip(b.column("at").to_pylist(), b.column("toxic").to_pylist())]
        w = fit(rows).astype(np.float32)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()]), pa.array([w[at].tobytes()])], ["at", "w"])

    found = rows.mapInArrow(steady(extract), "doc_id long, toxic int, at binary")
    found = found.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(steady(learn), "at binary, w binary").first()
    w = np.zeros(DIMENSIONS + 1, np.float32)
    if found:
        w[np.frombuffer(found["at"], np.int32)] = np.frombuffer(found["w"], np.float32)
    return w


def score(column: pa.Array, w: np.ndarray) -> np.ndarray:
    """Probabilities of label 1."""
    doc, at = features(column)
    live = w[at] != 0
    keys = np.unique(doc[live] * (DIMENSIONS + 1) + at[live])
    total = np.bincount(keys // (DIMENSIONS + 1), w[keys % (DIMENSIONS + 1)].astype(np.float64), len(column)) if len(keys) else np.zeros(len(column))
    return 1 / (1 + np.exp(-np.clip(total + float(w[DIMENSIONS]), -30, 30)))


def digest(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Only texts are inputs of a score; null and empty texts get the intercept's.  Long texts are read whole, in
    pieces.  Rows that repeat are scored alike; extra columns are ignored; an empty table gives no rows.
    """
    w = train(docs, labels, sample)
    at = np.flatnonzero(w)
    sparse = docs.sparkSession.sparkContext.broadcast((at, w[at]))  # DIMENSIONS weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(DIMENSIONS + 1, np.float32)
        w[sparse.value[0]] = sparse.value[1]
        for part in stream(batches):
            yield part.select(["doc_id", "held_out"]).append_column("score", pa.array(score(part.column("text"), w)))

    rows = docs.select("doc_id", (remainder() == 1).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInArrow(steady(run), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
