"""License scans: MinHash bands over overlapping text windows retrieve templates, containment verifies; DataFrame expressions only.

A text's normalised words are cut into overlapping windows whose length follows the template's: with n words and a stride of s, windows of n + s - 1 words
hold every passage of n words whole. The stride is at most half the template's shingles, so a window that holds a template has a Jaccard
similarity of about two thirds to it, and half if a fifth of the template's shingles are missing. Signatures have ``BANDS`` minima in bands of one row, so such a
window meets its template in some band with a probability of 1 - (1 - J) ** BANDS, 0.99998 at J = 0.5. What meets is
verified on the shingles themselves: the share of the template's five-word shingles in the window, 0.8 or more.

Texts without any word of a hitting set are skipped at the start. The set is chosen so that less than the required share of each template's shingles
lack its words; a text without them cannot hold 0.8 of any template. Templates are a parameter, so their band table is small.

Result: a row for each document and template found in it, with the best containment and the first word of the first window that holds
it. Defined results: null and empty texts hold none; templates and windows shorter than a shingle are one shingle; rows with equal ids are one document, null ids included; an empty table
or no templates give an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 16
WORDS = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"

#: Wordings of public licences' notices.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        'you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed '
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "MIT": "Released under the MIT License",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        'to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies '
        'of the Software, and to permit persons to whom the Software is furnished to do so'
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version."
    ),
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def normal_words(text: str) -> list[str]:
    return re.findall(WORDS, text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def shingles_of(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]


def window_shape(n: int) -> tuple[int, int]:
    """(length, stride) in words of the windows for a template of n words."""
    stride = max(1, (n - SHINGLE + 1) // 2)
    return n + stride - 1, stride


def hitting_words(templates: dict[str, str]) -> list[str]:
    """Words of which every text that holds enough of some template has one; long words first, which are rarer."""
    chosen: set[str] = set()
    for text in templates.values():
        words = normal_words(text)
        open_ = list(dict.fromkeys(shingles_of(words)))
        need = math.ceil(CONTAINMENT * len(open_))
        while len(left := [s for s in open_ if not chosen & set(s.split())]) >= need:
            chosen.add(max({w for s in left for w in s.split()}, key=lambda w: (len(w), w)))
    return sorted(chosen)


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _hashes(words: Column) -> Column:
    """A hash of each shingle of an array of words; of fewer words than a shingle, of all of them."""
    window = lambda i: F.array_join(F.slice(words, i + 1, SHINGLE), " ")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0))), lambda i: F.xxhash64(window(i)))


def _signature(hashes: Column) -> Column:
    """BANDS minima. Shingles' hashes are uniform, so each point of their space has any of them nearest by XOR with equal chance: one minimum for each of BANDS points."""
    least = lambda seed: F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(F.xxhash64(F.lit(seed)))))
    return F.array(*map(least, range(BANDS)))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, containment, first_word) for each document and template it holds."""
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    if not templates:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("first_word")).limit(0)
    body = F.coalesce(F.col(text), F.lit(""))
    # Plain searches, in a lower case that is quicker to make and equal for ASCII letters.
    hit = F.lit(False)
    for w in hitting_words(templates):
        hit = hit | F.contains(F.col("low"), F.lit(w))
    lower = F.translate("body", string.ascii_uppercase, string.ascii_lowercase)
    # Bound to a column of its own, so that it is split once and not for each window.
    # The generator keeps the filter above the lower case, which would else be made once for each word.
    low = docs.select(F.col(id_col).alias("doc_id"), body.alias("body"), F.explode(F.array(F.lower(body))).alias("low"))
    some = low.where(hit).select("doc_id", lower.alias("lower"))
    words = some.select("doc_id", F.regexp_extract_all("lower", F.lit(WORDS), F.lit(0)).alias("words"))
    words = words.select("doc_id", "words", _hashes(F.col("words")).alias("hashes"))  # each shingle is hashed once, not once a window
    by_shape: dict[tuple[int, int], list[str]] = {}
    for name, body in templates.items():
        by_shape.setdefault(window_shape(len(normal_words(body))), []).append(name)
    shapes = F.explode(F.array(*[F.struct(F.lit(n).alias("length"), F.lit(s).alias("stride")) for n, s in by_shape]))
    last = F.greatest(F.size("words") - F.col("length"), F.lit(0))
    starts = F.array_union(F.sequence(F.lit(0), last, F.col("stride")), F.array(last))
    # Windows are cut before they become rows: no row carries the whole text.
    cut_ = F.transform(starts, lambda at: F.struct(at.alias("first_word"), F.slice("words", at + 1, F.col("length")).alias("own"), F.slice("hashes", at + 1, F.greatest(F.col("length") - SHINGLE + 1, F.lit(1))).alias("hashes")))
    shaped = words.select("doc_id", "words", "hashes", shapes.alias("shape")).select("doc_id", "words", "hashes", "shape.*")
    windows = shaped.select("doc_id", "length", F.explode(cut_).alias("w")).select("doc_id", "length", "w.first_word", "w.own", "w.hashes")
    bands = windows.select("doc_id", "length", "first_word", "own", F.posexplode(_signature(F.col("hashes"))).alias("band", "least"))
    rows = [
        F.struct(F.lit(name).alias("license"), F.lit(shape[0]).alias("length"), _strings(normal_words(templates[name])).alias("words"), _strings(list(dict.fromkeys(shingles_of(normal_words(templates[name]))))).alias("template"))
        for shape, names in by_shape.items() for name in names
    ]
    table = spark.range(1).select(F.inline(F.array(*rows)))
    table = table.select("license", "length", "template", F.posexplode(_signature(_hashes(F.col("words")))).alias("band", "least"))
    met = bands.join(F.broadcast(table), ["length", "band", "least"])
    shingle = lambda i: F.array_join(F.slice("own", i + 1, SHINGLE), " ")
    met = met.withColumn("shingles", F.transform(F.sequence(F.lit(0), F.greatest(F.size("own") - SHINGLE, F.lit(0))), shingle))
    share = F.size(F.array_intersect("template", "shingles")) / F.size("template")
    found = met.withColumn("containment", share.cast("double")).where(F.col("containment") >= CONTAINMENT)
    best = found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min(F.col("first_word").cast("long")).alias("first_word"))
    return best.select(F.col("doc_id").cast(kind).alias("doc_id"), "license", "containment", "first_word")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the licences that every document names or quotes."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _oracle() -> str:
    """All windows of all texts against all templates, without signatures."""
    rows = []
    for name, body in TEMPLATES.items():
        words = normal_words(body)
        length, stride = window_shape(len(words))
        values = ", ".join("'" + s + "'" for s in dict.fromkeys(shingles_of(words)))
        rows.append(f"('{name}', {length}, {stride}, [{values}])")
    return f"""
WITH t(license, length, stride, template) AS (VALUES {', '.join(rows)}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORDS}') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(0, greatest(len(words) - {SHINGLE}, 0) + 1)) AS pos FROM w),
g AS (SELECT doc_id, pos, array_to_string(words[pos + 1 : pos + {SHINGLE}], ' ') AS shingle FROM s),
u AS (SELECT license, length, stride, len(template) AS n, unnest(template) AS shingle FROM t),
h AS (SELECT g.doc_id, g.pos, u.license, u.length, u.stride, u.n, g.shingle, greatest(len(w.words) - u.length, 0) AS last FROM g JOIN u USING (shingle) JOIN w USING (doc_id)),
c AS (SELECT doc_id, license, n, shingle, first_word FROM (
        SELECT *, unnest(list_distinct(list_append(range(0, last + 1, stride), last))) AS first_word FROM h)
      WHERE pos >= first_word AND pos <= first_word + greatest(length - {SHINGLE}, 0))
SELECT doc_id, license, max(k) AS containment, min(first_word)::BIGINT AS first_word
FROM (SELECT doc_id, license, first_word, count(DISTINCT shingle)::DOUBLE / max(n) AS k FROM c GROUP BY doc_id, license, first_word HAVING k >= {CONTAINMENT})
GROUP BY doc_id, license
"""


ORACLE = _oracle()
