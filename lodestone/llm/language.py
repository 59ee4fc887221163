"""Language identification by Bayesian evidence fusion.

The posterior of a language given a page is its prior at the page's host times
the likelihoods of the text, of the language declared in the markup and of the
address suffix.  Text likelihoods are byte trigram models; how far declared
languages and suffixes can be trusted, and how languages spread over hosts, is
counted in grouped aggregates over all pages by what their texts say.  A host's
prior is smoothed towards its domain's, a domain's towards the whole corpus.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packed import steady
from .store import Scratch
from .substring import without
from .text import buffers, stream

SAMPLE, PLACES, CHUNK = 1000, 1 << 15, 1 << 19
#: Entries of all languages' tables together, which bounds what goes to all tasks: 64 MB.
ENTRIES, LEAST_PLACES = 1 << 24, 1 << 10
STRENGTH, SMOOTH, TEMPER, ACCEPT = 20.0, 2.0, 0.25, 0.6

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def places_for(languages: int) -> int:
    """Places of a language's table: fewer where there are more than 512 languages."""
    places = PLACES
    while places * languages > ENTRIES and places > LEAST_PLACES:
        places //= 2
    return places


def trigrams(column: pa.Array, places: int = PLACES) -> tuple[np.ndarray, np.ndarray]:
    """Document number and place of each byte trigram that holds a letter; runs of other bytes read as one space."""
    raw, off = buffers(column)
    low = _FOLD[raw]
    letter = _LETTER[low]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first byte after a word
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[keep]
    low = np.where(letter, low, 32)[keep].astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok = doc[2:] == doc[:-2]
    h = (low[:-2] * np.uint32(0x9E3779B1)) ^ (low[1:-1] * np.uint32(0x85EBCA77)) ^ (low[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return doc[2:][ok], (h[ok] >> np.uint32(32 - places.bit_length() + 1)).astype(np.int64)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """All labelled languages and log probabilities of trigrams, from at most `sample` texts of each.

    The texts are those whose rows have the least hashes by id and text; rows that repeat count once.  They are
    read whole, a language's by one task that holds its counts only.
    """
    row = F.xxhash64(F.col(doc_id), F.coalesce(F.col(text).cast("string"), F.lit("")))
    known = docs.select(row.alias("_r"), F.col(lang).alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("_lang is not null and _lang != ''")
    sizes = known.groupBy("_lang").agg(F.count("*").alias("n"))
    # of a large language only rows with small hashes come into question: four times the sample in the mean
    share = F.least(F.lit(1.0), F.lit(4.0 * sample) / F.col("n"))
    small = (F.shiftrightunsigned(F.xxhash64("_r", F.lit(9)), 11) / float(1 << 53)) < share
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_r"))
    some = known.select("_r", "_lang").join(F.broadcast(sizes), "_lang").where(small)  # a row a language
    picked = some.select("_r", "_lang", F.xxhash64("_r", F.lit(9)).alias("_h")).distinct().withColumn("_k", rank).where(F.col("_k") <= sample).select("_r", "_lang")
    texts = known.join(F.broadcast(picked), ["_r", "_lang"])  # `sample` narrow rows a language
    texts = texts.groupBy("_r", "_lang").agg(F.first("text").alias("text"))
    places = places_for(sizes.count())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part in stream(batches, limit=CHUNK):
            doc, at = trigrams(part.column("text"), places)
            names = np.array(part.column("_lang").to_pylist(), object)
            for name in sorted(set(names)):
                total.setdefault(name, np.zeros(places, np.int64))
                total[name] += np.bincount(at[(names == name)[doc]], minlength=places)
        for name, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([c.tobytes()], pa.binary())], ["lang", "counts"])

    rows = sorted(texts.select("_lang", "text").repartition("_lang").mapInArrow(steady(count), "lang string, counts binary").collect())  # ENTRIES numbers
    if not rows:
        return [], np.zeros((0, PLACES), np.float32)
    counts = np.array([np.frombuffer(r["counts"], np.int64) for r in rows]) + 0.5
    return [r["lang"] for r in rows], np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def read_texts(rows: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """Every column of rows but text, with grams (number of trigrams) and loglik (array, one entry a language)."""
    shared = rows.sparkSession.sparkContext.broadcast(table)  # ENTRIES numbers at most
    places = table.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in stream(batches, limit=CHUNK):
            doc, at = trigrams(part.column("text"), places)
            n = part.num_rows
            sums = [np.bincount(doc, row[at], n) if len(doc) else np.zeros(n) for row in shared.value]
            flat = np.stack(sums, 1).ravel() if sums else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(sums)), pa.array(flat))
            out = part.select([c for c in part.schema.names if c != "text"])
            yield out.append_column("grams", pa.array(np.bincount(doc, minlength=n).astype(np.int64))).append_column("loglik", lists)

    schema = rows.drop("text").schema.add("grams", "long").add("loglik", T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(steady(run), schema)


def identify(rows: DataFrame, languages: list[str], table: np.ndarray, scratch: Scratch) -> DataFrame:
    """rows: id, text, declared, suffix, host, domain (any but text may be null).

    Returns id, text_lang, lang, confidence, grams and accepted.  Without letters a text says nothing: text_lang is null, lang and confidence
    follow from the other evidence, and the row is not accepted.  Accepted rows have a confidence of ACCEPT or more.
    """
    if not languages:
        return rows.select("id", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("grams"), F.lit(False).alias("accepted"))
    size = len(languages)
    constant = lambda values, kind: F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")  # noqa: E731  one constant, however many languages
    names, ones = constant(languages, "string"), constant([1.0] * size, "double")
    seen = read_texts(rows, languages, table)
    best = F.when(F.col("grams") > 0, F.array_position("loglik", F.array_max("loglik")).cast("int") - 1)
    fold = lambda c: F.lower(F.split(c, "[-_]")[0])
    seen = seen.select("id", fold(F.col("declared")).alias("declared"), F.lower("suffix").alias("suffix"), "host", "domain", "grams", "loglik", best.alias("ix"))
    seen = scratch.keep(seen.withColumn("text_lang", F.try_element_at(names, F.col("ix") + 1)), "texts")
    # how often each clue goes with each language, by what the texts say: one pass, a row a host, clue and language
    cells = seen.where("ix is not null").groupBy("declared", "suffix", "host", "domain", "ix").agg(F.count("*").alias("n"))
    cells = scratch.keep(cells, "cells")
    whole = {r["ix"]: r["n"] for r in cells.groupBy("ix").agg(F.sum("n").alias("n")).collect()}  # a row a language
    total = sum(whole.values())
    base = constant([(whole.get(i, 0) + 1.0) / (total + size) for i in range(size)], "double")

    def table_of(of: DataFrame, key: str, name: str, *more: str) -> DataFrame:
        """Counts by language of each value of a clue, as one array; only languages that occur travel."""
        some = of.where(F.col(key).isNotNull()).groupBy(key, *more, "ix").agg(F.sum("n").cast("double").alias("n"))
        found = some.groupBy(key, *more).agg(F.map_from_entries(F.collect_list(F.struct("ix", "n"))).alias("_c"))
        return found.select(key, *more, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("_c", i), F.lit(0.0))).alias(name))

    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)

    # likelihood of a clue: smoothed by all clues' spread
    def clue(key: str) -> DataFrame:
        counted = table_of(cells, key, "_n").withColumn("_s", add("_n"))
        kinds = cells.where(F.col(key).isNotNull()).groupBy("ix").agg(F.sum("n").alias("n"))
        known = {r["ix"]: r["n"] for r in kinds.collect()}
        all_ = max(sum(known.values()), 1)
        held = constant([float(known.get(i, 0)) for i in range(size)], "double")
        part = F.zip_with("_n", held, lambda n, k: (n + SMOOTH * F.col("_s") / all_) / (k + SMOOTH))
        return counted.select(key, part.alias(f"p_{key}"))

    def smooth(of: DataFrame, counts: str, below: Column, name: str) -> DataFrame:
        return of.withColumn("_s", add(counts)).withColumn(name, F.zip_with(counts, below, lambda n, p: (n + STRENGTH * p) / (F.col("_s") + STRENGTH)))

    domains = smooth(table_of(cells, "domain", "_d"), "_d", base, "p_domain").select("domain", "p_domain")
    hosts = table_of(cells, "host", "_h", "domain").join(domains, "domain", "left")
    hosts = smooth(hosts, "_h", F.coalesce("p_domain", base), "p_host").select("host", F.col("domain").alias("_domain"), "p_host")
    joined = seen.join(hosts, (seen["host"] == hosts["host"]) & seen["domain"].eqNullSafe(hosts["_domain"]), "left").drop(hosts["host"]).drop("_domain")
    for key in ("declared", "suffix"):
        joined = joined.join(clue(key), key, "left")
    # trigrams of a text depend on each other, so their evidence is tempered
    out = joined.select("*", F.array_max("loglik").alias("_top"))
    logs = F.transform("loglik", lambda v: (v - F.col("_top")) * TEMPER)
    for p in (F.coalesce("p_host", base), F.coalesce("p_declared", ones), F.coalesce("p_suffix", ones)):
        logs = F.zip_with(logs, p, lambda a, b: a + F.log(b))
    out = out.select("id", "text_lang", "grams", logs.alias("_l"))
    out = out.select("*", F.array_max("_l").alias("_m"))
    out = out.select("id", "text_lang", F.element_at(names, F.array_position("_l", F.col("_m")).cast("int")).alias("lang"), (1 / F.aggregate("_l", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("_m")))).alias("confidence"), "grams")
    return out.withColumn("accepted", (F.col("grams") > 0) & (F.col("confidence") >= ACCEPT))


def page_evidence(pages: DataFrame) -> DataFrame:
    """id, text, declared, suffix, host and domain of web pages (page_id, url, html)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = F.nullif(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z][A-Za-z0-9_-]*)", 1), F.lit(""))
    host = F.nullif(F.lower(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").alias("id"), text.alias("text"), declared.alias("declared"), host.alias("host"))
    domain = F.nullif(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.lit(""))
    suffix = F.nullif(F.regexp_extract("host", r"\.([^.]+)$", 1), F.lit(""))
    return rows.select("id", "text", "declared", suffix.alias("suffix"), "host", domain.alias("domain"))


def digest(pages: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Per page: page_id, text_lang, lang, confidence (0 to 1), grams, accepted.

    docs (doc_id, text, lang) teach the text model.  Null or empty html has no letters and is not accepted.
    Rows that repeat are each identified; extra columns are ignored; an empty table gives no rows; without any
    labelled document lang is null.  A long text is held whole, at about 30 bytes a byte.
    """
    languages, table = fit(docs)
    return identify(page_evidence(pages), languages, table, scratch).withColumnRenamed("id", "page_id")


def accept(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents whose language is identified; every column stays, whatever its name.

    lang is the declared language and source the host.  A document without letters (null and empty ones too), or
    without a language of ACCEPT posterior probability, is rejected.  Rows that share an id and text share the
    decision; an empty table gives no rows.  Only the names of the rejected rows travel.
    """
    languages, table = fit(docs)
    text, void = F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(None).cast("string")
    rows = docs.select(F.xxhash64("doc_id", text).alias("id"), text.alias("text"), F.col("lang").alias("declared"), void.alias("suffix"), F.col("source").alias("host"), void.alias("domain"))
    lost = scratch.keep(identify(rows, languages, table, scratch).where("not accepted").select(F.col("id").alias("_gone")).distinct(), "rejected")
    return without(docs, lost)
