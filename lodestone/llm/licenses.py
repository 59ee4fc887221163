"""License scans with DataFrame operations only.

Two results.  Base places: where a phrase's words stand consecutively.  The
method: an exact set-similarity join between text blocks and license templates,
by one index of all templates.  Template words are ordered by how many texts of
the corpus hold them, rarest first; a block that holds a share `threshold` of a
template's words holds one of its first |T| - ceil(threshold |T|) + 1 words
(prefix filter), has that many words itself (length filter), and, where their
first common word stands late in either order, too few can follow (positional
filter).  Blocks are met from large to small: whole texts first, then the lines
and the windows of words of those that pass; what passes is verified by counting.

The template library is a parameter of the query, not data: its size is fixed
by its author, so it is inlined and broadcast.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import by_keys

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-4.0": "licensed under a creative commons attribution cc by 4 0 license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc0-1.0": "dedicated to the public domain under cc0 1 0",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "mit": "released under the mit license",
    "mpl-2.0": "subject to the terms of the mozilla public license version 2 0",
}
#: Notices as licenses word them, found in windows of words: label, text, words that only notices of other licenses have,
#: words that must be there whatever the threshold.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", (), ("apache", "2")),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", (), ()),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("sharealike", "noncommercial", "noderivatives"), ("attribution", "4")),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International Public License", ("sharealike", "noncommercial", "noderivatives"), ("attribution", "4")),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("sharealike", "noderivatives"), ("noncommercial", "4")),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License", ("sharealike", "noderivatives"), ("noncommercial", "4")),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("noncommercial",), ("sharealike", "4")),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License", ("noncommercial",), ("sharealike", "4")),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", (), ()),
    ("cc0-1.0", "Creative Commons Legal Code CC0 1.0 Universal", (), ()),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("lesser", "affero"), ("gnu", "3")),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", ("lesser", "affero"), ("gnu", "3")),
    ("gpl-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works.", ("lesser", "affero"), ("gnu",)),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("lesser", "affero"), ("gnu", "2")),
    ("gpl-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", ("lesser", "affero"), ("gnu", "2", "1991")),
    ("lgpl-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", (), ("lesser", "3")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", (), ("fee",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", (), ()),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", (), ("mozilla", "2")),
)
THRESHOLD = 0.9


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def spaced(low: Column) -> Column:
    """The words of a lowered text, one space before and after each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, SEPARATORS, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def base(docs: DataFrame, phrases: dict[str, str] | None = None, text: str = "text", also: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `also`, n_words, n_base, first_word, last_word, base_array: phrase places of each text.

    Places of different phrases all count.  Null or empty texts have no words and null places.
    """
    phrases = phrases or PHRASES
    w = docs.select(*also, spaced(lowered(F.col(text))).alias("_w"))
    w = w.withColumn("n_words", F.when(F.col("_w") == "  ", F.lit(0)).otherwise(_spaces(F.col("_w")) - 1).cast("long"))
    found = []
    for p, label in phrases.items():
        has = F.contains(F.col("_w"), F.lit(f" {p} "))
        first = _spaces(F.substring(F.col("_w"), F.lit(1), F.locate(f" {p} ", F.col("_w")))) - 1
        last = _spaces(F.regexp_extract(F.col("_w"), f"(?s)^(.*) {p} ", 1))
        found.append(F.when(has, F.struct(F.regexp_count(F.col("_w"), F.lit(f" {p}(?= )")).cast("long").alias("n"), first.cast("long").alias("a"), last.cast("long").alias("b"), F.lit(label).alias("l"))))
    w = w.withColumn("_f", F.array_compact(F.array(*found))).drop("_w")
    return w.select(
        *also, "n_words", F.aggregate("_f", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_base"), F.array_min(F.transform("_f", lambda x: x["a"])).alias("first_word"),
        F.array_max(F.transform("_f", lambda x: x["b"])).alias("last_word"), F.array_sort(F.array_distinct(F.transform("_f", lambda x: x["l"]))).alias("base_array"),
    )


def vocabulary(docs: DataFrame, words: set[str], text: str = "text", also: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `also`, _n, _v of each text: its number of words, and the distinct ones that templates have."""
    all_ = F.split(F.trim(F.regexp_replace(lowered(F.col(text)), SEPARATORS, " ")), " ")
    return docs.select(*also, F.size(all_).alias("_n"), F.array_intersect(all_, F.array(*[F.lit(w) for w in sorted(words)])).alias("_v"))


def word_order(texts: DataFrame, words: set[str]) -> dict[str, int]:
    """Rank of each template word by the number of texts (_v) that hold it, rarest first; at most a row a word comes to the driver."""
    counts = dict(texts.select(F.explode("_v").alias("w")).groupBy("w").count().collect())
    return {w: k for k, w in enumerate(sorted(words, key=lambda w: (counts.get(w, 0), w)))}


def met(blocks: DataFrame, known: list[tuple], rank: dict[str, int], also: list[str]) -> DataFrame:
    """Columns `also`, _t, t_size, overlap: every template of the library of whose words a block (_n, _v) holds enough."""
    rows = []
    for number, _, words, need, *_ in known:
        ordered = sorted(words, key=rank.get)
        rows += [(w, number, i, len(ordered), need, ordered) for i, w in enumerate(ordered[: len(ordered) - need + 1])]
    index = blocks.sparkSession.createDataFrame(rows, "token string, _t int, t_pos int, t_size int, need int, t_words array<string>")
    order = F.create_map(*[x for w, k in rank.items() for x in (F.lit(w), F.lit(k))])
    ranked = F.array_sort(F.transform("_v", lambda w: F.struct(order[w].alias("r"), w.alias("w"))))
    some = blocks.where(F.arrays_overlap("_v", F.array(*[F.lit(w) for w in sorted({r[0] for r in rows})])))
    probe = some.select(*also, "_n", F.transform(ranked, lambda x: x["w"]).alias("_b")).select("*", F.posexplode("_b").alias("b_pos", "token"))
    near = probe.join(F.broadcast(index), "token")  # the library, fixed by the caller
    near = near.where("_n >= need and 1 + least(t_size - t_pos - 1, size(_b) - b_pos - 1) >= need")
    return near.select(*also, "_t", "t_size", "need", F.size(F.array_intersect("_b", "t_words")).alias("overlap")).where("overlap >= need").drop("need").distinct()


def blocks_join(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, text: str = "text", also: tuple[str, ...] = ("doc_id",), rank: dict[str, int] | None = None) -> DataFrame:
    """Every text block (line) that holds a share `threshold` or more of a template's distinct words.

    Columns: `also`, block (number from 0), label, overlap, containment.  Null and empty texts have no blocks.  Words
    are ordered by `rank`, or by the given texts.
    """
    known = library(templates or TEMPLATES, threshold)
    words = {w for t in known for w in t[2]}
    rank = rank or word_order(vocabulary(docs, words, text, ()), words)
    lines = docs.where(F.col(text).isNotNull()).select(*also, F.posexplode(F.split(lowered(F.col(text)), "\n")).alias("block", "_line"))
    found = met(vocabulary(lines, words, "_line", (*also, "block")), known, {w: rank[w] for w in words}, [*also, "block"])
    names = F.create_map(*[x for t in known for x in (F.lit(t[0]), F.lit(t[1]))])
    return found.select(*also, "block", names[F.col("_t")].alias("label"), "overlap", (F.col("overlap") / F.col("t_size")).alias("containment"))


def library(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> list[tuple[int, str, list[str], int, int, list[str], list[str]]]:
    """Number, label, distinct words, needed words, window, shut-out and indispensable words of each template; of TEMPLATES and NOTICES where none are given.

    A window has twice a template's words, so that others may stand between; where shut-out words tell licenses
    apart it has as many as the template, so that a neighbour's words stay out.
    """
    rows = [(label, t, (), ()) for label, t in (templates or TEMPLATES).items()] + ([] if templates else list(NOTICES))
    out = []
    for i, (label, t, shut, must) in enumerate(rows):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        distinct = sorted(set(words))
        out.append((i, label, distinct, math.ceil(threshold * len(distinct) - 1e-9), len(words) * (1 if shut else 2), list(shut), list(must)))
    return out


def windows_join(found: DataFrame, known: list[tuple], also: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every template that a window of consecutive words of a candidate text holds a share `threshold` or more of.

    Columns: `also`, label, containment (the best).  Windows do not end with lines.
    """
    spark = found.sparkSession
    index = [(w, t[0], w in t[5]) for t in known for w in sorted({*t[2], *t[5]})]
    index = spark.createDataFrame(index, "token string, _t int, shut boolean")
    names = spark.createDataFrame([(t[0], t[1], len(t[2]), t[3], t[4], t[6]) for t in known], "_t int, label string, t_size int, need int, span int, must array<string>")
    words = found.select(*also, "_in", F.posexplode(F.split(F.trim(F.regexp_replace(lowered(F.col("text")), SEPARATORS, " ")), " ")).alias("pos", "token"))
    at = words.join(F.broadcast(index), "token").where(F.array_contains("_in", F.col("_t"))).join(F.broadcast(names), "_t")  # the library, fixed by the caller
    # places in units of the template's window, so that one frame serves windows of all lengths
    reach = 1 - 0.5 / max(t[4] for t in known)
    over = f"over (partition by {', '.join(also)}, _t order by pos / double(span) range between current row and {reach!r}D following)"
    at = at.select("*", F.expr(f"collect_set(if(shut, null, token)) {over}").alias("_held"), F.expr(f"max(shut) {over}").alias("_other"))
    sure = at.withColumn("overlap", F.size("_held")).where("overlap >= need and not _other and size(array_except(must, _held)) = 0")
    return sure.groupBy(*also, "label").agg(F.max(F.col("overlap") / F.col("t_size")).alias("containment"))


def scan(docs: DataFrame, scratch, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Labels are of templates found in a line or in a window of words that spans lines.  score is 1 where a base phrase stands, else the best containment of a template found, else 0.  Labels are
    strings of distinct sorted labels joined by commas, empty where there are none.  Rows that repeat an id and
    text each get their own result; null and empty texts have no words and no labels; long texts are read whole, a
    few times their size in memory; an empty table gives no rows; extra columns are ignored.
    """
    docs = docs.select("doc_id", "text").withColumn("_key", F.xxhash64("text"))
    key = ("doc_id", "_key")
    known = library(templates, threshold)
    words = {w for t in known for w in t[2]}
    texts = scratch.keep(vocabulary(docs, words, also=key), "texts")
    rank = word_order(texts, words)
    inside = scratch.keep(met(texts, known, rank, [*key]).groupBy(*key).agg(F.collect_set("_t").alias("_in")).select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), "_in"), "inside")
    same = docs["doc_id"].eqNullSafe(inside["_id"]) & (docs["_key"] == inside["_k"])
    held = scratch.keep(by_keys(docs, inside, same, "inner").select(*key, "text", "_in"), "held")
    lines = blocks_join(held, templates, threshold, also=key, rank=rank).select(*key, "label", "containment")
    hits = lines.unionByName(windows_join(held, known, key)).groupBy(*key).agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best"))
    hits = scratch.keep(hits, "hits").select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), "_more", "_best")
    found = base(docs, phrases, also=key)
    out = found.join(hits, found["doc_id"].eqNullSafe(hits["_id"]) & (found["_key"] == hits["_k"]), "left")
    labels = F.array_sort(F.array_union("base_array", F.coalesce("_more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_array").alias("base_labels"), F.concat_ws(",", labels).alias("labels"), score.alias("score"))
