"""Licence scan: passages against templates by sparse TF-IDF cosine, then inheritance by directory.

Lines and paragraphs with signs of a licence, and the whole of such a file, are its candidate
passages. Their terms are weighted by inverse document frequency and compared with the texts,
notices and headings of known licences. A file without a match of its own takes the licence of the nearest directory above it that holds a licence file.
All steps are DataFrame operations.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.joins import attach_by_key
from millrace.plans.spread import rows_of
from millrace.plans.staging import stage

# Short notices by which licences are granted, several for one licence where usual.
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Redistribution and use is governed by the BSD 2-Clause License."),
    ("BSD-3-Clause", "Redistribution and use is governed by the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 license."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense license."),
]
# The texts of short licences, and the notices and headings of long ones.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, "
    "either version {} of the License, or (at your option) any later version."
)
TEMPLATES += [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in "
     "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
     "notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
     "and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
     "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
     "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
     "THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
     "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright "
     "laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
     "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future "
     "rights to this software under copyright law. " + _AS_IS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the "
     "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
     "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations "
     "under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one "
     "at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("GPL-2.0", _GNU.format("General Public License", 2)),
    ("GPL-3.0", _GNU.format("General Public License", 3)),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", 3)),
    ("AGPL-3.0", _GNU.format("Affero General Public License", 3)),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
]
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in sorted({name for name, _ in TEMPLATES})]
# A file is looked at if one of these occurs in it, and a passage if it holds one or shares some long terms with the templates.
CUE = "(?i)licen[sc]e|copyright|spdx|warrant|permission|redistribut|unencumbered"
TELLING_LETTERS, TELLING_TERMS = 7, 3
WHOLE_FILE = 1 << 30
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
FILE_NAME = "(?i)^(un)?licen[sc]e([.-].*)?$|^copying([.-].*)?$|^notice([.-].*)?$"
THRESHOLD = 0.6
# A file of other name is a licence file if a matching passage holds this share of its terms.
FILE_SHARE = 0.5


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    return spark.createDataFrame(rows, "template int, licence string, text string")


def telling_terms(templates: list[tuple[str, str]] = TEMPLATES) -> list[str]:
    """The long terms of templates."""
    return sorted({t for _, text in templates for t in re.findall(TERM, text.lower()) if len(t) >= TELLING_LETTERS})


def passages(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, unit, terms``: lines, paragraphs and whole texts that have a cue or share ``TELLING_TERMS``
    long terms with the templates; ``unit`` counts lines from 0 and paragraphs from -1 down, and is
    ``WHOLE_FILE`` for the text."""
    text = F.col(text_col)
    rows = files.filter(text.rlike(CUE)).select(F.col(id_col).alias("id"), text.alias("t"))
    lines = F.transform(F.split("t", "\n"), lambda x, i: F.struct(i.alias("unit"), x.alias("p")))
    paragraphs = F.transform(F.split("t", "\n[ \t\r]*\n"), lambda x, i: F.struct((-1 - i).alias("unit"), x.alias("p")))
    whole = F.array(F.struct(F.lit(WHOLE_FILE).alias("unit"), F.col("t").alias("p")))
    units = rows.select("id", rows_of(F.concat(lines, paragraphs, whole)).alias("u")).select("id", "u.unit", "u.p", terms_of(F.col("u.p")).alias("terms"))
    shared = F.size(F.array_intersect("terms", F.array(*map(F.lit, telling_terms()))))
    return units.filter((F.size("terms") > 0) & (F.col("p").rlike(CUE) | (shared >= TELLING_TERMS))).drop("p")


def matches(files: DataFrame, id_col: str, text_col: str, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``id, unit, licence, score, n_terms``: for each passage the most similar template of at least ``threshold``.

    The document frequency of a term counts all passages. Terms that no template has only lengthen
    a passage, with the weight of a term never seen. Only terms of templates are broadcast, whose
    number does not depend on the data.
    """
    found = stage(passages(files, id_col, text_col), "licences-passages")
    total = found.count()
    known = templates.select("template", "licence", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))
    counts = found.select("id", "unit", F.explode("terms").alias("term")).groupBy("id", "unit", "term").agg(F.count("*").alias("tf"))
    counts = stage(counts, "licences-terms")
    vocabulary = F.broadcast(known.select("term").distinct())
    df = counts.join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("df"))
    weigh = lambda tf, df: (1 + F.log(tf)) * F.log((1 + F.lit(float(total))) / (1 + df))
    idf = stage(known.select("term").distinct().join(df, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df")), "licences-idf")
    weighed = known.join(F.broadcast(idf), "term").withColumn("tw", weigh(F.col("tf"), F.col("df")) + 1)
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") ** 2)).alias("t_norm"))
    slots = weighed.join(norms, "template").groupBy("term", "df").agg(F.collect_list(F.struct("template", "licence", (F.col("tw") / F.col("t_norm")).alias("tw"))).alias("slots"))

    terms = counts.join(F.broadcast(slots), "term", "left").withColumn("w", weigh(F.col("tf"), F.coalesce("df", F.lit(0))) + 1)
    sums = terms.groupBy("id", "unit").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"), F.sum("tf").alias("n_terms"))
    dots = terms.select("id", "unit", "w", F.explode("slots").alias("s")).groupBy("id", "unit", "s.template", "s.licence").agg(F.sum(F.col("w") * F.col("s.tw")).alias("dot"))
    scored = dots.join(sums, ["id", "unit"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).filter(F.col("score") >= threshold)
    best = F.max_by(F.struct("licence", "score", "n_terms"), F.struct("score", -F.col("template")))
    return scored.groupBy("id", "unit").agg(best.alias("b")).select("id", "unit", "b.*")


def scan(files: DataFrame, id_col: str, path: Column, text_col: str, templates: DataFrame, threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """``id, path, licence, score, basis, from_dir`` for each row.

    ``basis`` is ``header`` for a match of the file's own, ``inherited`` for that of the nearest
    directory at or above the file's (``from_dir``) with a licence file, else null. A licence file has
    a licence's name, or consists of the notice for the most part; of several in a directory the
    best match counts, then the first licence by name. Null texts match nothing and null paths
    inherit nothing; equal rows give equal results, an id that repeats gets the best match of all its
    rows; an empty table gives no rows; other columns are ignored. A directory above very many files
    is joined in parts.
    """
    rows = stage(
        files.select(F.col(id_col).alias("id"), path.alias("path"), F.when(F.col(text_col).rlike(CUE), F.size(terms_of(F.col(text_col)))).alias("all_terms")),
        "licences-files",
    )
    found = stage(matches(files, id_col, text_col, templates, threshold), "licences-matches")
    own = found.groupBy("id").agg(F.max_by(F.struct("licence", "score", "n_terms"), F.struct("score", "n_terms", -F.col("unit"))).alias("own"))
    marked = stage(rows.join(own, "id", "left"), "licences-own")

    parts = F.split("path", "/")
    is_file = F.element_at(parts, -1).rlike(FILE_NAME) | (F.col("own.n_terms") >= file_share * F.col("all_terms"))
    folder = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    granted = (
        marked.filter(F.col("own").isNotNull() & F.col("path").isNotNull() & is_file)
        .groupBy(folder.alias("dir")).agg(F.min_by(F.struct("own.licence", "own.score"), F.struct(-F.col("own.score"), F.col("own.licence"))).alias("grant"))
    )
    depth = F.size(parts)
    above = marked.filter(F.col("own").isNull() & F.col("path").isNotNull()).select(
        "path", F.explode(F.transform(F.sequence(F.lit(0), depth - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir")
    )
    above = stage(above.distinct(), "licences-above")
    uses = stage(above.groupBy("dir").agg(F.count("*").alias("n")).join(granted, "dir"), "licences-granted")
    nearest = attach_by_key(above, uses, "dir", "n", "grant", F.col("path")).groupBy("path").agg(F.max_by(F.struct("dir", "grant"), F.length("dir")).alias("up"))
    taken = marked.join(nearest, "path", "left")
    has_own = F.col("own").isNotNull()
    return taken.select(
        "id", "path",
        F.when(has_own, F.col("own.licence")).otherwise(F.col("up.grant.licence")).alias("licence"),
        F.when(has_own, F.col("own.score")).otherwise(F.col("up.grant.score")).alias("score"),
        F.when(has_own, "header").when(F.col("up").isNotNull(), "inherited").alias("basis"),
        F.when(~has_own, F.col("up.dir")).alias("from_dir"),
    )
