"""License scan by sparse TF-IDF cosine and directory inheritance (operator 1), DataFrame functions only.

A file's candidate headers are its sentences and lines that hold a license word; the same of its
blocks (adjacent lines joined, comment marks off), and these blocks whole; and its whole text if
its name is that of a license file.  An SPDX line names its licenses itself, with score 1; unknown
names there give none.  Equal headers are scored once: term frequencies times inverse document frequencies, counted over
the headers of the whole corpus and the templates, and the cosine with each template through
an equi-join on terms (the templates are a fixed list, the only broadcast side).  A file's own
license is its best header's template from ``LEAST`` on, and ``licenses`` lists with it all that SPDX
lines or headers from ``SURE`` on name; that all rights are reserved counts only if no license is named.  A file is a license file if its name says so or if at least half of its
words stand in headers of one kind that match; the best license file of a
directory speaks for it.  Files without a license of their own take that of the nearest ancestor
directory: distinct directories are exploded into their ancestors, joined on the path, and the
longest one wins; files of one large directory are salted in the join back.

Rows are known by 128 bits of id, path and text, so rows without id or of one id stay apart.

Defined cases: null text has no header; null path: no directory, nothing inherited; ties go to the
license first in alphabetical order; repeated rows are returned each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.llm.common import save

LEAST, SURE, SALTS = 0.6, 0.9, 16

_PERMIT = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
           "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
           "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
           "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
           "with the distribution. ")
_NAMES_OF = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
             "products derived from this software without specific prior written permission. ")
_AS_IS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
          "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
          "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
          "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
          "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
          "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
          "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:")
_MIT_REST = (" The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
             "the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
             "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
             "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
             "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
             "THE SOFTWARE.")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.")
_ISC_REST = (" THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
             "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
             "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
             "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
             "OR PERFORMANCE OF THIS SOFTWARE.")
_GNU = ("This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License "
        "as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version.")

# Common short forms of license notices, standard headers and whole texts of short licenses.
TEMPLATES = [
    ("AGPL-3.0", _GNU.format("program", "Affero ", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", _PERMIT + _AS_IS),
    ("BSD-3-Clause", _PERMIT + _NAMES_OF + _AS_IS),
    ("GPL-2.0", _GNU.format("program", "", "2")),
    ("GPL-3.0", _GNU.format("program", "", "3")),
    ("ISC", _ISC),
    ("ISC", _ISC + _ISC_REST),
    ("LGPL-2.1", _GNU.format("library", "Lesser ", "2.1")),
    ("LGPL-3.0", _GNU.format("library", "Lesser ", "3")),
    ("MIT", _MIT),
    ("MIT", _MIT + _MIT_REST),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause license."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD 3-Clause license."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, all copyright and related rights are waived under the Creative Commons Zero license, CC0 1.0."),
    ("EPL-2.0", "Made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify and distribute this software is granted under the ISC License."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain, the Unlicense."),
]

_MARK = r"(?i)licen[cs]e|copyright|public domain|rights reserved|spdx|permission (is hereby granted|to use)|redistribution and use"
_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"
_SPDX = r"(?i)spdx-license-identifier:[ \t]*([^\n]*)"
_LEAD = r"(?m)^[ \t]*(//+|#+|/?\*+/?|--+|;+|%+|rem\b)?[ \t]*"  # comment marks before a line
_BARE = "Proprietary"


def _terms(col):
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _weights(rows: DataFrame, key: str, idf: DataFrame, unseen) -> DataFrame:
    """(key, term, w): TF-IDF weights of unit length of ``rows(key, terms)``."""
    tf = rows.select(key, F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    w = tf.join(idf, "term", "left").select(key, "term", (F.col("tf") * F.coalesce("idf", unseen)).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def headers(files: DataFrame) -> DataFrame:
    """``files(key, path, text)`` -> ``(key, kind, header, words)``: kind 0 sentences and lines, 1 sentences of blocks,
    2 blocks, 3 whole license files, all but the last with a license word."""
    some = files.where(F.col("text").rlike(_MARK) | F.col("path").rlike(_NAME) & (F.trim("text") != "")).select(
        "key", F.coalesce(F.col("path").rlike(_NAME), F.lit(False)).alias("named"),
        F.regexp_replace(F.regexp_replace("text", "\r", ""), _SPDX, "").alias("text"))
    blocks = F.filter(F.transform(F.split(F.regexp_replace("text", _LEAD, ""), r"\n\s*\n"), lambda b: F.trim(
        F.regexp_replace(b, r"\s+", " "))), lambda b: b.rlike(_MARK))
    marked = lambda parts: F.filter(parts, lambda h: h.rlike(_MARK))
    some = some.withColumn("blocks", blocks)
    kinds = F.array(marked(F.split("text", r"(?<=[.!?])\s+|\n")),
                    marked(F.flatten(F.transform("blocks", lambda b: F.split(b, r"(?<=[.!?])\s+")))), F.col("blocks"),
                    F.when(F.col("named"), F.array(F.regexp_replace("text", r"\s+", " "))).otherwise(
                        F.array().cast("array<string>")))
    return (some.select("key", F.posexplode(kinds).alias("kind", "header"))
            .select("key", "kind", F.explode(F.array_distinct("header")).alias("header"))
            .select("key", "kind", F.trim("header").alias("header"), F.size(_terms(F.col("header"))).alias("words")))


def spdx(files: DataFrame) -> DataFrame:
    """``files(key, text)`` -> ``(key, kind, header, words, license, score)``: the known licenses that SPDX lines name."""
    known = sorted({name for name, _ in TEMPLATES if name != _BARE})
    line = F.explode(F.regexp_extract_all("text", F.lit(_SPDX), F.lit(1)))
    name = F.explode(F.transform(F.split("names", r"[^A-Za-z0-9.+-]+"), lambda w: F.regexp_replace(
        F.lower(w), r"(-only|-or-later|\+)$", "")))
    names = F.map_from_arrays(F.array(*(F.lit(k.lower()) for k in known)), F.array(*map(F.lit, known)))
    return (files.where(F.col("text").rlike(_SPDX)).select("key", line.alias("names")).select("key", "names", name.alias("name"))
            .select("key", F.lit(4).alias("kind"), F.col("names").alias("header"), (F.size(_terms(F.col("names"))) + 3).alias("words"),
                    names[F.col("name")].alias("license"), F.lit(1.0).alias("score")).where("license is not null"))


def score_headers(found: DataFrame, least: float = LEAST) -> DataFrame:
    """Distinct headers with their best template: ``(header, license, score)`` from ``least`` on."""
    spark = found.sparkSession
    plates = spark.createDataFrame([(k, *t) for k, t in enumerate(TEMPLATES)], "tid int, license string, header string")
    names, plates = plates.select("tid", "license"), plates.select("tid", _terms(F.col("header")).alias("terms"))
    each = save(found.groupBy("header").agg(F.count(F.lit(1)).alias("n")).select(
        F.xxhash64("header").alias("hid"), "header", "n", _terms(F.col("header")).alias("terms")), "license-headers")
    seen = each.select("n", F.explode(F.array_distinct("terms")).alias("term")).unionByName(
        plates.select(F.lit(1).cast("long").alias("n"), F.explode(F.array_distinct("terms")).alias("term")))
    total = (each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]) + len(TEMPLATES)
    idf = seen.groupBy("term").agg(F.sum("n").alias("df")).select(
        "term", (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    plate = _weights(plates, "tid", idf, F.lit(1.0)).withColumnRenamed("w", "pw")
    cos = (_weights(each, "hid", idf, F.lit(1.0)).join(F.broadcast(plate), "term")
           .groupBy("hid", "tid").agg(F.sum(F.col("w") * F.col("pw")).alias("score")).join(F.broadcast(names), "tid")
           .select("hid", "license", F.round("score", 6).alias("score")).where(F.col("score") >= least))
    best = cos.groupBy("hid").agg(F.max("score").alias("score")).join(cos, ["hid", "score"]).groupBy("hid").agg(
        F.max("score").alias("score"), F.min("license").alias("license"))
    return each.join(best, "hid").select("header", "license", "score")


def scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """``files(id, path, text)`` -> ``(id, path, own_license, own_score, license, licenses, inherited_from)``, each row once.

    ``licenses``: every license named by the file, else by the license file inherited from, in alphabetical order.
    """
    files = files.select("id", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    given = F.to_json(F.struct("id", "path", F.col("text").isNull()))  # a null isn't an empty text
    files = files.withColumn("key", F.struct(F.xxhash64(given, "text").alias("a"), F.xxhash64("text", given).alias("b")))
    found = save(headers(files), "license-found")
    matched = found.join(score_headers(found, least), "header").select(
        "key", "kind", "header", "words", "license", "score").unionByName(spdx(files))
    # a named license comes before a bare reservation of rights, then the best score
    rank = F.struct((F.col("license") != _BARE).alias("named"), F.col("score").alias("score"))
    matched = save(matched.withColumn("rank", rank).distinct(), "license-matched")  # equal rows have equal headers
    headed = matched.groupBy("key", "kind", "header").agg(F.max("words").alias("words"))
    share = headed.groupBy("key", "kind").agg(F.sum("words").alias("words")).groupBy("key").agg(F.max("words").alias("words"))
    best = matched.groupBy("key").agg(F.max("rank").alias("best"))
    ranked = matched.join(best, "key")
    top = F.col("rank") == F.col("best")
    sure = top | (F.col("score") >= SURE) & F.col("rank.named")
    own = save(ranked.where(sure).groupBy("key").agg(
        F.max("best.score").alias("own_score"), F.min(F.when(top, F.col("license"))).alias("own_license"),
        F.array_sort(F.collect_set("license")).alias("own_licenses")).join(share, "key"), "license-own")
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(
        F.when(F.col("path").isNotNull(), F.lit("")))
    rows = files.select("key", "id", "path", folder.alias("dir"), F.when(F.col("text").rlike(_MARK), F.size(
        _terms(F.col("text")))).alias("all_words"))
    known = rows.join(own, "key", "left")
    speaks = known.where("own_license is not null and dir is not null").where(
        F.col("path").rlike(_NAME) | (F.col("words") * 2 >= F.col("all_words")))
    spoken = speaks.groupBy("dir").agg(F.min(F.struct(
        (-F.col("own_score")).alias("s"), F.col("own_license").alias("one"), F.col("own_licenses").alias("every"))).alias("said"))
    parts = F.split("dir", "/")
    above = rows.select("dir").where("dir is not null").distinct().select("dir", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("up"))
    near = above.join(spoken.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(
        F.max_by(F.struct("up", "said"), F.length("up")).alias("from"))
    salted = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return known.withColumn("salt", F.pmod(F.col("key.a"), F.lit(SALTS)).cast("int")).join(
        salted, ["dir", "salt"], "left").select(
        "id", "path", "own_license", "own_score", F.coalesce("own_license", "from.said.one").alias("license"),
        F.coalesce("own_licenses", "from.said.every").alias("licenses"),
        F.when(F.col("own_license").isNull(), F.col("from.up")).alias("inherited_from"))
