"""License scan: MinHash bands over text windows retrieve templates, shingles verify.

A template is its set of word shingles (five words, fewer for a shorter
notice).  Templates of nearly the same size form a class; its windows are long
enough, and overlap enough, that a passage of that size lies whole in one of
them, so the Jaccard similarity of a window that holds the required share of a
template has a lower bound J.  Single-row bands collide with probability J each,
and a class takes as many as make a collision certain to ``GUARANTEE``.  A
collision is verified by the exact share of the template's shingles in the
window, at least ``CONTAINED``.

Only DataFrame functions run.  Most texts end at the first test: the anchor
words are chosen so that a text with the required share of any template must
hold one of them.  Of the other texts only windows with a shingle of the
class's templates are built, since others cannot share a MinHash value.  The
templates are an argument on the driver; everything that grows is a row-local
scan followed by one join with the (template x band) rows.  Of templates that mostly contain each other (two
versions of a license) a text reports those it contains best.

Edge rows: null and empty texts match nothing; rows that repeat a doc_id are
reported once per template with the best window, ties at the first; rows
without doc_id are reported together under null; further columns are not read;
empty tables and templates without words give no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINED = 0.8
GUARANTEE = 0.999
# Largest to smallest template size within a class.
CLASS_RATIO = 1.25
# Shingles a window moves on by, as a share of the class's size.
STRIDE = 0.25

# Public license notices.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
            "of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
                   "See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
            "option) any later version."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
            "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
            "for more details."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met:"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
                "this work."),
    ("proprietary", "All rights reserved."),
]


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def anchors(templates: list[list[str]], k: int, share: float) -> list[str]:
    """Words one of which every text with ``share`` of a template's shingles must hold, longest words first.

    A template is covered once the shingles without an anchor are less than that share.
    """
    chosen: set[str] = set()

    def open_templates():
        for words in templates:
            size = min(k, len(words))
            grams = [set(words[i:i + size]) for i in range(len(words) - size + 1)]
            free = [g for g in grams if not g & chosen]
            if len(free) >= share * len(grams):
                yield free

    while left := list(open_templates()):
        gain: dict[str, int] = {}
        for grams in left:
            for w in {w for g in grams for w in g}:
                gain[w] = gain.get(w, 0) + sum(w in g for g in grams) * (1 if len(w) >= 7 else 0)
        best = max(gain, key=lambda w: (gain[w], len(w), w))
        chosen.add(best)
    return sorted(chosen)


def size_classes(sizes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(words a shingle, least and largest number of shingles) of the classes of template sizes (k, m)."""
    out: list[tuple[int, int, int]] = []
    for k, m in sorted(set(sizes), reverse=True):
        if out and out[-1][0] == k and m * CLASS_RATIO >= out[-1][2]:
            out[-1] = (k, m, out[-1][2])
        else:
            out.append((k, m, m))
    return out


def shingle_hashes(words: Column, k: int) -> Column:
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - k + 1),
                                                  lambda i: F.xxhash64(F.slice(words, i, k)))).otherwise(F.array().cast("array<bigint>"))


def min_hashes(shingles: Column, n: int) -> Column:
    """``n`` MinHash values of an array of shingle hashes."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda j: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, j))))


def template_rows(spark: SparkSession, notices: list[tuple[str, str]]) -> list[dict]:
    """template_id, license, k, shingles of the notices that have words (hashed by the same functions as the texts)."""
    rows = [(i, lic, words_of(t)) for i, (lic, t) in enumerate(notices)]
    rows = [(i, lic, w, min(SHINGLE, len(w))) for i, lic, w in rows if w]
    if not rows:
        return []
    df = spark.createDataFrame(rows, "template_id int, license string, words array<string>, k int")
    hashed = F.coalesce(*[F.when(F.col("k") == k, F.array_distinct(shingle_hashes(F.col("words"), k)))
                          for k in range(1, SHINGLE + 1)])
    return [r.asDict() for r in df.select("template_id", "license", "words", "k", hashed.alias("shingles")).collect()]


def families(templates: list[dict], share: float) -> dict[int, int]:
    """template_id -> least template_id among those that contain ``share`` of it or that it contains so."""
    root = {t["template_id"]: t["template_id"] for t in templates}
    for a in templates:
        for b in templates:
            both = set(a["shingles"]) & set(b["shingles"])
            if a["k"] == b["k"] and len(both) >= share * len(a["shingles"]):
                x, y = sorted((root[a["template_id"]], root[b["template_id"]]))
                root = {t: x if r == y else r for t, r in root.items()}
    return root


def scan_licenses(docs: DataFrame, notices: list[tuple[str, str]] | None = None, share: float = CONTAINED) -> DataFrame:
    """doc_id, template_id, license, containment and first_word of the best window of every matching template."""
    spark = docs.sparkSession
    fields = "doc_id long, template_id int, license string, containment double, first_word int"
    templates = template_rows(spark, NOTICES if notices is None else notices)
    if not templates:
        return spark.createDataFrame([], fields)
    classes = []
    for c, (k, low, high) in enumerate(size_classes([(t["k"], len(t["shingles"])) for t in templates])):
        mine = [t for t in templates if t["k"] == k and low <= len(t["shingles"]) <= high]
        step = max(1, int(high * STRIDE))
        window = high + step - 1
        j = share * low / (window + (1 - share) * low)
        bands = 1 if j >= 1 else max(1, math.ceil(math.log(1 - GUARANTEE) / math.log(1 - j)))
        classes.append({"c": c, "k": k, "window": window, "step": step, "bands": bands, "templates": mine})
    most = max(c["bands"] for c in classes)

    # Texts that may hold a template, and their shingles.
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    some = F.lower("text").rlike("|".join(anchors([t["words"] for t in templates], SHINGLE, share)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(some)
    hashed = texts.select("doc_id", words.alias("words")).select(
        "doc_id", *[shingle_hashes(F.col("words"), k).alias(f"s{k}") for k in sorted({c["k"] for c in classes})])

    def windows(c: dict) -> Column:
        """Windows of the class that hold a shingle of its templates."""
        s, w, step = F.col(f"s{c['k']}"), c["window"], c["step"]
        known = sorted({x for t in c["templates"] for x in t["shingles"]})
        at = F.filter(F.transform(s, lambda x, i: F.when(x.isin(known), i)), lambda i: i.isNotNull())
        starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(
            F.greatest(F.lit(0), F.ceil((i - (w - 1)) / step).cast("int")), F.floor(i / step).cast("int")))))
        return F.transform(starts, lambda n: F.struct(F.lit(c["c"]).alias("c"), (n * step).alias("start"),
                                                      F.slice(s, n * step + 1, w).alias("shingles")))

    built = (hashed.select("doc_id", F.explode(F.concat(*[windows(c) for c in classes])).alias("w"))
             .select("doc_id", "w.c", "w.start", "w.shingles"))
    banded = built.select("*", F.posexplode(min_hashes(F.col("shingles"), most)).alias("band", "value"))

    # One row per template and band of its class: bounded by the argument.
    family = families(templates, share)
    rows = spark.createDataFrame([(c["c"], c["bands"], t["template_id"], family[t["template_id"]], t["license"], t["shingles"])
                                  for c in classes for t in c["templates"]],
                                 "c int, bands int, template_id int, family int, license string, template array<long>")
    keys = rows.select("*", F.posexplode(min_hashes(F.col("template"), most)).alias("band", "value")).where("band < bands").drop("bands")
    hits = banded.join(F.broadcast(keys), ["c", "band", "value"])
    contained = (F.size(F.array_intersect("template", "shingles")) / F.size("template"))
    found = (hits.withColumn("containment", contained).where(F.col("containment") >= share)
             .groupBy("doc_id", "family", "template_id", "license")
             .agg(F.max(F.struct("containment", (-F.col("start")).alias("back"))).alias("best"))
             .select("doc_id", "family", "template_id", "license", "best.containment", (-F.col("best.back")).alias("first_word")))
    best = F.max("containment").over(Window.partitionBy("doc_id", "family"))
    return found.withColumn("most", best).where("containment = most").drop("most", "family")
