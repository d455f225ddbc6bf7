"""License scans: sparse TF-IDF cosine of headers and license files to templates, then inheritance by directory.

Terms are runs of the letters and digits a-z0-9 of the lower-cased text; a term that a unit holds n times weighs 1 + ln n times
its inverse document frequency, counted over all files for every term. A unit is a whole file, a block (lines up to one
without letters and digits, so a paragraph also of a comment), or one to four lines in a row; its
cosine to a template is the product of their TF-IDF vectors over the product of their lengths. Templates are headers by
which files declare a license, the title blocks of long licenses and the full texts of short ones; ``with_texts`` adds the full
texts of a folder. A file's own license is the template nearest to the whole file, or else to any other of its units, at
``threshold`` or above. A file whose whole text reaches the threshold, or that is named as license files are and has a license,
is a license file, and its license holds for its directory: a file without its own inherits from the nearest directory
above it that has one.

All of it is DataFrame functions. Only units that hold a *key term* are exploded into terms: a template's terms are
cut down, from the rarest, to those without which no unit reaches the threshold (by the Cauchy-Schwarz
inequality a unit without them has at most the cosine that the remaining terms' weight allows). That filter loses
nothing, and few units pass it. Units that come often are weighed once.

Edge cases: null and empty texts have no unit and no own license, but inherit; equal cosines go to the smaller
template name; rows that repeat a path or an id are all returned; a null path has no directory and inherits
nothing; several license files in a directory: the nearest cosine, then the smaller name, wins; very long lines are
exploded by term after they pass the filter; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

THRESHOLD = 0.8

#: Lines of the units that are runs of lines.
WINDOWS = (1, 2, 3, 4)

# Paragraphs of the short licenses.
_MIT = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,'
    " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
    " subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF'
    " MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR"
    " ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH"
    " THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
]
_BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
    " documentation and/or other materials provided with the distribution.",
]
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this"
    " software without specific prior written permission."
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT'
    " LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE"
    " COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
    " (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
    " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)"
    " ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the"
    " above copyright notice and this permission notice appear in all copies.",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF'
    " MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY"
    " DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,"
    " ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
]

#: Headers by which files declare a license, title blocks, and texts of short licenses, by SPDX name.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", *_MIT[:1], " ".join(_MIT)],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by"
        " the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by"
        " the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", " ".join([*_BSD, _BSD_WARRANTY])],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", *_BSD[:1], _BSD_NAMES, " ".join([*_BSD, _BSD_NAMES, _BSD_WARRANTY])],
    "ISC": ["Licensed under the ISC License.", *_ISC[:1], " ".join(_ISC)],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "Creative Commons Legal Code CC0 1.0 Universal"],
    "LicenseRef-all-rights-reserved": ["All rights reserved."],
}

#: Names of license files, as both Spark and DuckDB read the pattern.
FILE_NAME = "(?i)(^|/)((un)?licen[cs]e|copying)[^/]*$"
#: What parts blocks.
_GAP = "\\n([^A-Za-z0-9\\n]*\\n)+"


def with_texts(folder: str, templates: dict[str, list[str]] = TEMPLATES) -> dict[str, list[str]]:
    """The templates with the full texts of a local folder, whose files are named as licenses."""
    out = {name: list(texts) for name, texts in templates.items()}
    for file in sorted(Path(folder).iterdir()):
        out.setdefault(file.name, []).append(file.read_text(encoding="utf-8", errors="replace"))
    return out


def terms_of(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if c in "abcdefghijklmnopqrstuvwxyz0123456789":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def template_table(templates: dict[str, list[str]]) -> list[tuple[str, int, dict[str, int]]]:
    """(license, number, counts of terms) of every template text, in the order of the names."""
    out = []
    for name in sorted(templates):
        for text in templates[name]:
            counts: dict[str, int] = {}
            for t in terms_of(text):
                counts[t] = counts.get(t, 0) + 1
            out.append((name, len(out), counts))
    return out


#: What ends a term.
_SPLIT = "[^a-z0-9]+"


def _terms(col):
    return F.filter(F.split(F.lower(col), _SPLIT), lambda t: t != "")


def corpus_frequencies(files: DataFrame) -> DataFrame:
    """term -> number of files that hold it; the empty term stands for every file."""
    held = files.select(F.explode(F.array_union(F.array(F.lit("")), _terms(F.coalesce("text", F.lit(""))))).alias("term"))
    return held.groupBy("term").count()


def weigh(n: int, idf: float) -> float:
    return (1 + math.log(n)) * idf


def key_terms(counts: dict[str, int], idf: dict[str, float], threshold: float) -> set[str]:
    """Terms of a template one of which every unit at the threshold must hold: the rarest that suffice."""
    terms = sorted(counts, key=lambda t: (-idf[t], -counts[t], t))
    rest = total = sum(weigh(counts[t], idf[t]) ** 2 for t in terms)
    out = set()
    for t in terms:
        # without the terms so far the cosine is at most sqrt(rest / total)
        if math.sqrt(max(0.0, rest) / total) < threshold - 1e-9:
            break
        out.add(t)
        rest -= weigh(counts[t], idf[t]) ** 2
    return out


def windows_of(lines):
    """Arrays of the runs of lines of a column of lines; a run that would pass the end is left to the shorter ones."""

    def run(w: int):
        joined = lambda x, k: F.concat_ws("\n", x, *[F.get(lines, k + j) for j in range(1, w)])
        return F.filter(F.transform(lines, lambda x, k: F.when((k + w <= F.size(lines)) | (k == 0), joined(x, k))), F.isnotnull)

    return [run(w) for w in WINDOWS]


def own_licenses(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files(doc_id, path, text) -> doc_id, path, license, score, license_file, for files with a license."""
    spark = files.sparkSession
    every = template_table(templates)
    vocabulary = sorted({t for _, _, c in every for t in c})
    counted = written(corpus_frequencies(files), "license-frequencies")
    df = {r["term"]: r["count"] for r in counted.filter(F.col("term").isin("", *vocabulary)).collect()}
    n = df.get("", 0)
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocabulary}
    # the templates are a parameter of fixed size, so these tables are too
    norms = {k: math.sqrt(sum(weigh(c, idf[t]) ** 2 for t, c in counts.items())) for _, k, counts in every}
    template = [(name, k, t, weigh(c, idf[t]) / norms[k]) for name, k, counts in every for t, c in counts.items()]
    template = spark.createDataFrame(template, "license string, number int, term string, weight double")
    idfs = counted.select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("count"))) + 1).alias("idf"))
    keys = F.array(*[F.lit(t) for t in sorted(set().union(*(key_terms(c, idf, threshold) for _, _, c in every)))])
    holds = lambda text: F.arrays_overlap(_terms(text), keys)

    # written, so that a text is split into lines once
    held = written(files.select("doc_id", "path", "text").filter(holds(F.col("text"))).withColumn("lines", F.split("text", "\n")), "license-held")
    parts = F.array_distinct(F.concat(F.split("text", _GAP), *windows_of(F.col("lines"))))
    units = held.select("doc_id", "path", F.lit(1).alias("whole"), F.col("text").alias("unit"))
    units = units.unionByName(held.select("doc_id", "path", F.lit(0).alias("whole"), F.explode(parts).alias("unit")))
    units = units.select("doc_id", "path", "whole", F.xxhash64("unit").alias("h1"), F.hash("unit").alias("h2"), _terms(F.col("unit")).alias("terms")).filter(F.arrays_overlap("terms", keys))
    units = written(units, "license-units")
    # equal units are weighed once
    terms = units.groupBy("h1", "h2").agg(F.first("terms").alias("terms")).select("h1", "h2", F.explode("terms").alias("term"))
    terms = terms.groupBy("h1", "h2", "term").count().join(idfs, "term")
    terms = written(terms.select("h1", "h2", "term", ((1 + F.log("count")) * F.col("idf")).alias("w")), "license-terms")
    length = terms.groupBy("h1", "h2").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = terms.join(F.broadcast(template), "term").groupBy("h1", "h2", "number", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(length, ["h1", "h2"]).withColumn("score", F.round(F.col("dot") / F.col("length"), 6)).filter(F.col("score") >= threshold)
    best = written(scored.groupBy("h1", "h2").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("best")), "license-best")
    hits = units.drop("terms").join(best, ["h1", "h2"])
    own = hits.groupBy("doc_id", "path").agg(F.min(F.struct((-F.col("whole")).alias("part"), "best")).alias("x"))
    whole = (F.col("x.part") == -1) | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    return own.select("doc_id", "path", "x.best.license", (-F.col("x.best.minus")).alias("score"), whole.alias("license_file"))


def directory(path):
    """All of a path before its last slash; empty if there is none, null for a null path."""
    return F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "/+$", "")


def inherited_licenses(files: DataFrame, own: DataFrame) -> DataFrame:
    """dir -> inherited, inherited_from: the license of the nearest directory at or above it that has a license file."""
    holders = own.filter("license_file AND path IS NOT NULL").groupBy(directory(F.col("path")).alias("above")).agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("best"))
    holders = written(holders.select("above", F.col("best.license").alias("inherited")), "license-directories")
    # directories first, so a directory with very many files is one row
    dirs = files.filter("path IS NOT NULL").select(directory(F.col("path")).alias("dir")).distinct()
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, 1, k), "/").alias("above")))
    climbed = dirs.select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.above").join(holders, "above")
    near = climbed.groupBy("dir").agg(F.max(F.struct("depth", "above", "inherited")).alias("near"))
    return near.select("dir", "near.inherited", F.col("near.above").alias("inherited_from"))


def scan(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files(doc_id, path, text) -> doc_id, path, license, score, license_file, inherited, inherited_from."""
    own = written(own_licenses(files, templates, threshold), "license-own")
    near = written(inherited_licenses(files, own), "license-near")
    o = own.select(F.col("doc_id").alias("own_id"), F.col("path").alias("own_path"), "license", "score", "license_file")
    f = files.select("doc_id", "path", directory(F.col("path")).alias("own_dir"))
    f = f.join(o, F.col("doc_id").eqNullSafe(F.col("own_id")) & F.col("path").eqNullSafe(F.col("own_path")), "left")
    f = f.join(near, F.col("own_dir") == F.col("dir"), "left")
    lacks = F.col("license").isNull()
    return f.select(
        "doc_id", "path", "license", "score", F.coalesce("license_file", F.lit(False)).alias("license_file"),
        F.when(lacks, F.col("inherited")).alias("inherited"), F.when(lacks, F.col("inherited_from")).alias("inherited_from"),
    )


def _files(spark, sf_dir) -> DataFrame:
    """Documents have no paths, so each gets one: its source, a shard of 1024 ids, its own name."""
    docs = table(spark, sf_dir, "documents")
    shard = F.floor(F.col("doc_id") / 1024).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), shard, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")


def op9_licenses(spark, sf_dir) -> DataFrame:
    return scan(_files(spark, sf_dir))


def _oracle() -> str:
    rows = ", ".join(f"('{name}', {k}, '{t}', {c})" for name, k, counts in template_table(TEMPLATES) for t, c in counts.items())
    windows = "\n        ".join(
        f"UNION ALL SELECT doc_id, path, unnest([array_to_string(lines[k:k + {w - 1}], chr(10)) FOR k IN range(1, greatest(len(lines) - {w - 1}, 1) + 1)]), 0 FROM p" for w in WINDOWS
    )
    return f"""
WITH t(license, number, term, tf) AS (VALUES {rows}),
f AS (SELECT doc_id, coalesce(source, 'none') AS s, coalesce(source, 'none') || '/' || floor(doc_id / 1024)::BIGINT AS dir,
             coalesce(source, 'none') || '/' || floor(doc_id / 1024)::BIGINT || '/' || doc_id || '.txt' AS path, text FROM documents),
n AS (SELECT count(*) AS n FROM f),
w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS term FROM f),
df AS (SELECT v.term, count(w.doc_id) AS df FROM (SELECT term FROM t UNION SELECT term FROM w) v LEFT JOIN w USING (term) GROUP BY 1),
idf AS (SELECT term, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM df CROSS JOIN n),
tx AS (SELECT license, number, term, (1 + ln(tf)) * idf AS w FROM t JOIN idf USING (term)),
tw AS (SELECT license, number, term, w / sqrt(sum(w * w) OVER (PARTITION BY number)) AS weight FROM tx),
p AS (SELECT doc_id, path, text, string_split(text, chr(10)) AS lines FROM f WHERE text IS NOT NULL),
u AS (SELECT DISTINCT doc_id, path, unit, whole FROM (
        SELECT doc_id, path, text AS unit, 1 AS whole FROM p
        UNION ALL SELECT doc_id, path, unnest(regexp_split_to_array(text, '{_GAP}')), 0 FROM p
        {windows})),
c AS (SELECT unit, term, count(*) AS tf FROM (SELECT unit, unnest(regexp_extract_all(lower(unit), '[a-z0-9]+')) AS term FROM (SELECT DISTINCT unit FROM u)) GROUP BY 1, 2),
x AS (SELECT unit, term, (1 + ln(tf)) * idf AS w FROM c JOIN idf USING (term)),
l AS (SELECT unit, sqrt(sum(w * w)) AS length FROM x GROUP BY 1),
d AS (SELECT unit, number, license, sum(w * weight) AS dot FROM x JOIN tw USING (term) GROUP BY ALL),
b AS (SELECT unit, license, round(dot / length, 6) AS score FROM d JOIN l USING (unit)),
h AS (SELECT doc_id, path, whole, license, score FROM u JOIN b USING (unit) WHERE score >= {THRESHOLD}),
o AS (SELECT doc_id, path, arg_min(license, (-whole, -score, license)) AS license, arg_min(score, (-whole, -score, license)) AS score,
             max(whole) = 1 OR regexp_matches(path, '{FILE_NAME}') AS license_file FROM h GROUP BY doc_id, path),
g AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, arg_min(license, (-score, license)) AS inherited FROM o WHERE license_file GROUP BY 1)
SELECT f.doc_id, f.path, o.license, o.score, coalesce(o.license_file, FALSE) AS license_file,
       CASE WHEN o.license IS NULL THEN g.inherited END AS inherited, CASE WHEN o.license IS NULL THEN g.dir END AS inherited_from
FROM f LEFT JOIN o USING (doc_id, path) LEFT JOIN g ON f.dir = g.dir
"""


#: The result of op9_licenses in DuckDB's SQL.
ORACLE = _oracle()
