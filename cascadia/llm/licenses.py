"""License scan: MinHash bands over overlapping text windows find templates, exact shingle containment verifies them.

Words are runs of letters and digits, lower-cased; a shingle is five words. A template of m shingles belongs to the class c, the smallest power of two that is at least m.
For each class a text is cut into windows of 2c shingles, each starting c after the last, so every passage of c shingles lies whole in a window. A window and a template whose
containment is 0.8 or more have a Jaccard similarity of 0.19 at least; of 64 bands of one MinHash each they share one with a chance over 1 - 2e-6. A match has containment >=
``threshold``: that share of the template's distinct shingles lies in the window. A window without any shingle of a template can share no band
with one, so texts and windows without one are set aside before any MinHash is computed; nothing else is. A window and a template are verified once, in the first band they share.

Built-in functions only. A library of up to ``MOST_SHINGLES`` shingles is written into the plan and broadcast; a larger one is joined like any table, with the same rows. Null and short texts match nothing. Rows with
a null id are reported under a null id, repeated rows are counted together. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import doc_columns

WORDS, BANDS, MOST_SHINGLES = 5, 64, 20_000
_BSD_END = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed"
)
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-3-clause-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd": _BSD_END,
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def _shingles(text: Column) -> Column:
    """Hashes of the shingles of an array of words."""
    last = F.size(text) - WORDS
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(text, i + k) for k in range(WORDS)]))


def shingled(rows: DataFrame) -> DataFrame:
    """The rows with the array ``h`` of their text's shingle hashes.

    Explode of a one-element array keeps an expression from being copied into the ones that read it, where it
    would be computed anew for every element.
    """
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = rows.withColumn("words", F.explode(F.array(words))).drop("text")
    return rows.withColumn("h", F.explode(F.array(_shingles(F.col("words"))))).drop("words")


def _templates(spark: SparkSession, templates: dict[str, str]) -> list[tuple[str, int, list[int]]]:
    """(name, class, distinct shingle hashes) of each template."""
    rows = shingled(spark.createDataFrame(sorted(templates.items()), "name string, text string")).collect()
    out = []
    for r in rows:
        h = sorted(set(r["h"]))
        if not h:
            raise ValueError(f"template {r['name']!r} has fewer than {WORDS} words")
        out.append((r["name"], 1 << (len(h) - 1).bit_length(), h))
    return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """doc_id, license, containment (the best window's, to 6 digits) and n_windows that match."""
    spark = docs.sparkSession
    known = _templates(spark, templates)
    library = spark.createDataFrame(known, "license string, class int, t array<long>")
    small = sum(len(h) for _, _, h in known) <= most_shingles
    every = F.lit(sorted({x for _, _, h in known for x in h})) if small else None

    def near(rows: DataFrame, column: str) -> DataFrame:
        return rows.where(F.arrays_overlap(column, every)) if small else rows

    texts = near(shingled(doc_columns(docs)).where(F.size("h") > 0), "h")
    classes = sorted({c for _, c, _ in known})
    windows = F.explode(F.array(*[F.struct(F.lit(c).alias("class")) for c in classes])).alias("k")
    cut = texts.select("doc_id", "h", windows).select("doc_id", "h", F.col("k.class").alias("class"))
    cut = cut.select("doc_id", "class", "h", F.posexplode(F.sequence(F.lit(0), F.size("h") - 1, F.col("class"))).alias("n", "start"))
    cut = near(cut.select("doc_id", "class", "n", F.explode(F.array(F.slice("h", F.col("start") + 1, 2 * F.col("class")))).alias("w")), "w")

    def banded(rows: DataFrame, column: str, lows: str) -> DataFrame:
        seeds = F.sequence(F.lit(1), F.lit(BANDS))
        minima = F.transform(seeds, lambda s: F.array_min(F.transform(F.col(column), lambda x: F.xxhash64(x, s))))
        rows = rows.withColumn(lows, F.explode(F.array(minima)))
        return rows.select(*rows.columns, F.posexplode(lows).alias("band", "low"))

    table = banded(library, "t", "t_lows")
    hits = banded(cut, "w", "w_lows").join(F.broadcast(table) if small else table, ["class", "band", "low"])
    first = F.array_position(F.zip_with("w_lows", "t_lows", lambda a, b: a == b), True) - 1
    hits = hits.where(F.col("band") == first)
    share = F.size(F.array_intersect("w", "t")) / F.size("t")
    hits = hits.select("doc_id", "license", "class", "n", share.alias("containment")).where(F.col("containment") >= threshold)
    # a window of a repeated row is one window; the same number of it in every band counts once
    found = hits.groupBy("doc_id", "license", "n").agg(F.max("containment").alias("containment"))
    return found.groupBy("doc_id", "license").agg(F.round(F.max("containment"), 6).alias("containment"), F.count("*").alias("n_windows"))


def _values(templates: dict[str, str]) -> str:
    return ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(templates.items()))


_SPLIT = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
#: Every window of every class against every template of the class.
ORACLE_SQL = f"""
WITH tw AS (SELECT name, {_SPLIT.format('body')} AS w FROM (VALUES {_values(TEMPLATES)}) AS v(name, body)),
ts AS (SELECT name, list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i+{WORDS - 1}], ' '))) AS t FROM tw),
tc AS (SELECT name, t, CAST(power(2, ceil(log2(len(t)))) AS BIGINT) AS c FROM ts),
dw AS (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS w FROM documents),
sh AS (SELECT doc_id, list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i+{WORDS - 1}], ' ')) AS h FROM dw WHERE len(w) >= {WORDS}),
near AS (SELECT * FROM sh WHERE list_has_any(h, (SELECT list(x) FROM (SELECT unnest(t) AS x FROM tc)))),
wins AS (SELECT doc_id, c, n, h[n*c+1:n*c+2*c] AS win FROM (
  SELECT doc_id, h, c, unnest(range(0, CAST(ceil(len(h) / c) AS BIGINT))) AS n FROM near, (SELECT DISTINCT c FROM tc))),
hits AS (SELECT doc_id, name, n, len(list_intersect(list_distinct(win), t)) / len(t) AS containment FROM wins JOIN tc USING (c))
SELECT doc_id, name AS license, round(max(containment), 6) AS containment, count(DISTINCT n) AS n_windows
FROM hits WHERE containment >= 0.8 GROUP BY doc_id, name
"""
