"""Licence scan by sparse TF-IDF cosine, with directory inheritance; DataFrame functions only.

The templates are a fixed list: short notices as they stand in headers, and whole licence texts. Each template is a
sparse TF-IDF vector, with idf counted over the templates; a term that no template has weighs as one that a
single template has, so foreign words pull a cosine down. A text is cut into statements (lines, and sentences
within lines), which are compared with the notices. Most are ruled out before, by two bounds that no statement at the
threshold fails: it holds one of the terms without which a notice keeps too little of its weight, and foreign terms take
too little of its own. A text that holds a cue word, which every licence text does, is compared with those as a whole.
The best match at or above its threshold is the text's own licence.

Texts are also searched for standard headers and whole texts (STANDARD) at any
place and in any wrapping: windows of a template's number of terms, an eighth of it apart, are compared with those
templates whose phrase (name and version, or first words) they hold. The better score of the two searches counts, the
first search's if they are equal. The SQL states the scan without this search.

A file without an own licence takes that of the nearest directory above it that has a notice: a licence file by its name,
or a text that is a licence as a whole, or with notice="any" every file with an own licence. Ancestors
are listed once per directory, not per file, and found by an equi-join on paths.

A null or empty text has no licence of its own but may inherit one; a null path inherits nothing. Of equal
scores the first licence by name wins, of equal notices of a directory the first path. Repeated rows are judged alike;
rows of one id should have one text. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER_LEAST = 0.6
FILE_LEAST = 0.8
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
CUE = "licen[cs]e|copyright|spdx|public domain|permission|warrant"
FILE_NAME = "(?i)(^|/)(un)?(licen[cs]e|copying|notice)[^/]*$"

#: Notices (one statement each) and whole licence texts, as published.
NOTICES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
]
_DISCLAIMER = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
TEXTS = [
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _DISCLAIMER),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _DISCLAIMER),
    ("MIT", 'MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause", 'Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."),
]
TEMPLATES = [(f"{n:02d}", name, "header", body) for n, (name, body) in enumerate(NOTICES)] + [(f"{n:02d}", name, "file", body) for n, (name, body) in enumerate(TEXTS, len(NOTICES))]

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU{0} General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU{0} General Public License for more details. You should have received a copy of the GNU{0} General Public License along with this program. If not, "
_SEE = "see <https://www.gnu.org/licenses/>."
_WRITE = "write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_CC = 'This work is licensed under the Creative Commons {0} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{1}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.'
_HEADERS = [(name, _GNU.format(word, version) + end) for name, word, version in (("AGPL-3.0", " Affero", 3), ("GPL-2.0", "", 2), ("GPL-3.0", "", 3), ("LGPL-3.0", " Lesser", 3)) for end in (_SEE, _WRITE)] + [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("CC-BY-4.0", _CC.format("Attribution", "by")),
    ("CC-BY-NC-4.0", _CC.format("Attribution-NonCommercial", "by-nc")),
    ("CC-BY-SA-4.0", _CC.format("Attribution-ShareAlike", "by-sa")),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
_GPL = r"\bgnu{} general public license (as published by the free software foundation )?(either )?v(ersion )?{}\b"
#: What a window must hold, in terms with single spaces between, to be compared with the templates of a licence.
PHRASES = {
    "0BSD": r"\bpermission to use copy modify and or distribute this software\b", "AGPL-3.0": _GPL.format(" affero", 3), "Apache-2.0": r"\bapache license version 2\.0\b",
    "BSD-2-Clause": r"\bredistribution and use in source and binary forms\b", "BSD-3-Clause": r"\bneither the names? of\b", "CC-BY-4.0": r"\bcreative commons attribution 4\.0\b",
    "CC-BY-NC-4.0": r"\bcreative commons attribution-noncommercial 4\.0\b", "CC-BY-SA-4.0": r"\bcreative commons attribution-sharealike 4\.0\b", "CC0-1.0": r"\bcc0\b", "GPL-2.0": _GPL.format("", 2),
    "GPL-3.0": _GPL.format("", 3), "ISC": r"\bpermission to use copy modify and or distribute this software\b", "LGPL-3.0": _GPL.format(" lesser", 3), "MIT": r"\bpermission is hereby granted free of charge\b",
    "MPL-2.0": r"\bmozilla public license v(ersion)? ?2\.0\b", "Unlicense": r"\bfree and unencumbered software\b",
}


#: Each phrase holds one of these.
PHRASE_WORDS = "permission|general public|apache|redistribution and|neither the|creative commons|cc0|mozilla public|unencumbered"


def _standard() -> list[tuple[str, str, str, str]]:
    whole = [(f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]
    rows = [(n, "header", b) for n, b in _HEADERS] + [(n, "file", b) for n, b in TEXTS + whole]
    return [(f"s{i:02d}", *r) for i, r in enumerate(rows)]


STANDARD = _standard()


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(c: Column) -> Column:
    return F.regexp_extract_all(_lower(c), F.lit(TERM), F.lit(0))


def template_vectors(spark: SparkSession, templates: list = TEMPLATES) -> DataFrame:
    """(template, license, kind, term, weight, idf, norm) of fixed templates: the same few rows at any input size."""
    rows = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("template", "license", "kind", "body"), t, strict=True)]) for t in templates]))
    t = spark.range(1).select(rows.alias("t")).select("t.*")
    t = t.select("template", "license", "kind", F.explode(_terms(F.col("body"))).alias("term")).groupBy("template", "license", "kind", "term").agg(F.count("*").alias("tf"))
    idf = t.groupBy("term").agg((F.log((1.0 + len(templates)) / (1 + F.count("*"))) + 1).alias("idf"))
    t = t.join(F.broadcast(idf), "term").withColumn("weight", F.col("tf") * F.col("idf"))
    norm = t.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return t.join(F.broadcast(norm), "template").select("template", "license", "kind", "term", "weight", "idf", "norm")


def _weights() -> tuple[dict[str, float], float]:
    """(idf of each template term, idf of any other)."""
    df = Counter(t for *_, body in TEMPLATES for t in set(re.findall(TERM, body.lower())))
    return {t: math.log((1 + len(TEMPLATES)) / (1 + n)) + 1 for t, n in df.items()}, math.log((1 + len(TEMPLATES)) / 2) + 1


#: Words of the notices that many texts hold, and those that nearly all do; rarer ones are asked for first, but any order
#: gives the same result.
COMMON = frozenset("all been can code copyright file form found has may on or rights source under use used version will with work".split())
EVERYWHERE = frozenset("a and are as be by in is of that the this to 2 3 v".split())


def needed_terms(least: float = HEADER_LEAST) -> list[str]:
    """Terms of which a statement must hold one to reach a cosine of `least` with a notice.

    The cosine is at most the root of the share of the notice's squared weight that falls on common terms. So of each
    notice the heaviest terms are taken until what is left is below that share; one of them must be there.
    """
    idf, _ = _weights()
    out: set[str] = set()
    for _, _, kind, body in TEMPLATES:
        if kind == "header":
            mass = {t: (n * idf[t]) ** 2 for t, n in Counter(re.findall(TERM, body.lower())).items()}
            left, short = sum(mass.values()), least**2 * sum(mass.values()) * 0.999
            for t in sorted(mass, key=lambda t: ((t in COMMON) + 2 * (t in EVERYWHERE), -mass[t], t)):
                if left < short:
                    break
                out.add(t)
                left -= mass[t]
    return sorted(out)


def _own_enough(terms: Column, least: float = HEADER_LEAST) -> Column:
    """False only where foreign terms take so much of a statement's weight that no cosine reaches `least`.

    At least the root of the number of distinct foreign terms times their weight is foreign, and the sum of the others'
    weights, each time one occurs, is at least the length of their part.
    """
    idf, foreign = _weights()
    weight = F.create_map(*[F.lit(x) for t, w in idf.items() for x in (t, w)])
    own = F.aggregate(terms, F.lit(0.0), lambda total, t: total + F.coalesce(F.try_element_at(weight, t), F.lit(0.0)))
    others = F.size(F.array_except(terms, F.array(*map(F.lit, idf))))
    return others * F.lit((1 - least**2) * foreign**2) <= own * own * F.lit(least**2 * 1.001)


def own_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, own_license, own_kind, own_score) of the (doc_id, text) rows that have a licence of their own."""
    cue, needed = "(?i)" + CUE, "(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, needed_terms())) + ")(?![a-z0-9])"
    t = template_vectors(docs.sparkSession)
    statements = F.filter(F.split(F.regexp_replace("text", "([.!?;]) +", "$1\n"), "\n", -1), lambda s: s.rlike(needed))
    each = F.transform(statements, lambda s, i: F.struct(i.alias("pos"), F.lit("header").alias("kind"), _terms(s).alias("terms")))
    whole = F.when(F.col("text").rlike(cue), F.array(F.struct(F.lit(-1).alias("pos"), F.lit("file").alias("kind"), _terms(F.col("text")).alias("terms"))))
    none = F.array().cast("array<struct<pos:int,kind:string,terms:array<string>>>")
    parts = docs.filter(F.col("text").rlike(needed)).select("doc_id", F.filter(each, lambda p: _own_enough(p["terms"])).alias("parts"))
    parts = parts.unionByName(docs.select("doc_id", F.coalesce(whole, none).alias("parts"))).select("doc_id", F.explode("parts").alias("p")).select("doc_id", "p.pos", "p.kind", F.explode("p.terms").alias("term"))
    tf = parts.groupBy("doc_id", "pos", "kind", "term").agg(F.count("*").alias("tf"))
    unseen = F.log(F.lit(1.0 + len(TEMPLATES)) / 2) + 1
    idf = t.select("term", "idf").distinct()
    tf = tf.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", unseen))
    hits = F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "w")))
    vectors = tf.groupBy("doc_id", "pos", "kind").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"), hits.alias("hits"))
    match = vectors.select("doc_id", "pos", "kind", "size", F.explode("hits").alias("h")).select("doc_id", "pos", "kind", "size", F.col("h.term").alias("term"), F.col("h.w").alias("w"))
    match = match.join(F.broadcast(t.select("template", "license", "kind", "term", "weight", "norm")), ["kind", "term"])
    dots = match.groupBy("doc_id", "pos", "kind", "size", "template", "license", "norm").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.withColumn("score", F.round(F.col("dot") / (F.col("size") * F.col("norm")), 6)).filter(F.col("score") >= F.when(F.col("kind") == "file", FILE_LEAST).otherwise(HEADER_LEAST))
    best = scored.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "license", "kind")).alias("b"))
    return best.select(F.col("doc_id").alias("own_id"), F.col("b.license").alias("own_license"), F.col("b.kind").alias("own_kind"), (-F.col("b.s")).alias("own_score"))


def standard_licenses(docs: DataFrame) -> DataFrame:
    """As own_licenses, for texts that hold a standard header or whole licence at any place, however wrapped."""
    t = template_vectors(docs.sparkSession, STANDARD)
    count = lambda body: len(re.findall(TERM, body.lower()))
    shapes = F.explode(F.array(*[F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(kind).alias("form"), F.lit(count(body)).alias("length"), F.lit(PHRASES[name]).alias("phrase")) for i, name, kind, body in STANDARD]))
    d = docs.filter(F.col("text").rlike("(?i)" + PHRASE_WORDS)).select("doc_id", _terms(F.col("text")).alias("terms"))
    d = d.filter(F.array_join("terms", " ").rlike("|".join(sorted(set(PHRASES.values()))))).select("doc_id", "terms", shapes.alias("s")).select("doc_id", "terms", "s.*")
    d = d.filter(F.rlike(F.array_join("terms", " "), F.col("phrase")))
    last = F.greatest(F.size("terms") - F.col("length"), F.lit(0))
    step = F.greatest(F.floor(F.col("length") / 8), F.lit(1)).cast("int")
    d = d.withColumn("pos", F.explode(F.array_union(F.sequence(F.lit(0), last, step), F.array(last))))
    kind = F.when((F.col("form") == "file") & (F.size("terms") <= 1.25 * F.col("length")), "file").otherwise("header")
    d = d.select("doc_id", "template", "license", "form", kind.alias("kind"), "pos", "phrase", F.slice("terms", F.col("pos") + 1, F.col("length")).alias("window"))
    d = d.filter(F.rlike(F.array_join("window", " "), F.col("phrase"))).select("doc_id", "template", "license", "form", "kind", "pos", F.explode("window").alias("term"))
    tf = d.groupBy("doc_id", "template", "license", "form", "kind", "pos", "term").agg(F.count("*").alias("tf"))
    unseen = F.log(F.lit(1.0 + len(STANDARD)) / 2) + 1
    tf = tf.join(F.broadcast(t.select("term", "idf").distinct()), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", unseen))
    tf = tf.join(F.broadcast(t.select("template", "term", "weight")), ["template", "term"], "left")
    dots = tf.groupBy("doc_id", "template", "license", "form", "kind", "pos").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"), F.sum(F.col("w") * F.coalesce("weight", F.lit(0.0))).alias("dot"))
    dots = dots.join(F.broadcast(t.select("template", "norm").distinct()), "template")
    scored = dots.withColumn("score", F.round(F.col("dot") / (F.col("size") * F.col("norm")), 6)).filter(F.col("score") >= F.when(F.col("form") == "file", FILE_LEAST).otherwise(HEADER_LEAST))
    best = scored.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "license", "kind")).alias("b"))
    return best.select(F.col("doc_id").alias("own_id"), F.col("b.license").alias("own_license"), F.col("b.kind").alias("own_kind"), (-F.col("b.s")).alias("own_score"))


def inherited(files: DataFrame, notice: str = "files") -> DataFrame:
    """Adds `dir`, inherited_license and inherited_from to rows of (path, own_license, own_kind, own_score)."""
    files = files.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    mark = F.col("own_license").isNotNull() & F.col("path").isNotNull()
    if notice != "any":
        mark &= F.col("path").rlike(FILE_NAME) | (F.col("own_kind") == "file")
    first = F.min(F.struct((-F.col("own_score")).alias("s"), "path", F.col("own_license").alias("license")))
    notices = files.filter(mark).groupBy("dir").agg(first.alias("n")).select(F.col("dir").alias("above"), "n.license")
    dirs = files.filter(F.col("own_license").isNull() & F.col("dir").isNotNull()).select("dir").distinct()
    cut = F.split("dir", "/", -1)
    above = F.transform(F.sequence(F.lit(0), F.size(cut)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(cut, F.lit(1), i), "/").alias("above")))
    near = dirs.select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.above").join(notices, "above")
    near = near.groupBy("dir").agg(F.max(F.struct("depth", "above", "license")).alias("x"))
    near = near.select(F.col("dir").alias("of"), F.col("x.license").alias("inherited_license"), F.col("x.above").alias("inherited_from"))
    return files.join(near, files.dir == near.of, "left").drop("of")


def scan(df: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", notice: str = "files") -> DataFrame:
    """(doc_id, path, own_license, own_score, own_kind, inherited_license, inherited_from, license, basis) of each row."""
    from . import common

    docs = common.id_text(df, id_col, text_col)
    found = own_licenses(docs).withColumn("search", F.lit(0)).unionByName(standard_licenses(docs).withColumn("search", F.lit(1)))
    found = found.groupBy("own_id").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "search", "own_license", "own_kind")).alias("b"))
    own = common.materialize(found.select("own_id", "b.own_license", "b.own_kind", (-F.col("b.s")).alias("own_score")), "licenses")
    files = df.select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"))
    files = files.join(own, F.col("doc_id").eqNullSafe(F.col("own_id")), "left").drop("own_id")
    out = inherited(files, notice)
    mine = F.col("own_license").isNotNull()
    inherit = [F.when(~mine, F.col(c)).alias(c) for c in ("inherited_license", "inherited_from")]
    basis = F.when(mine, F.concat(F.lit("own "), F.col("own_kind"))).when(F.col("inherited_license").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", "own_license", "own_score", "own_kind", *inherit, F.coalesce("own_license", "inherited_license").alias("license"), basis.alias("basis"))


def oracle(table: str, path_sql: str) -> str:
    """The scan with notice="any" as DuckDB SQL."""
    values = ",\n".join("('" + "','".join(x.replace("'", "''") for x in t) + "')" for t in TEMPLATES)
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH templates(template, license, kind, body) AS (VALUES {values}),
ttf AS (SELECT template, license, kind, term, count(*) AS tf FROM (SELECT template, license, kind, unnest(regexp_extract_all({lower('body')}, '{TERM}')) AS term FROM templates) GROUP BY ALL),
idf AS (SELECT term, ln({1.0 + len(TEMPLATES)} / (1 + count(*))) + 1 AS idf FROM ttf GROUP BY term),
tw AS (SELECT template, license, kind, term, tf * idf AS weight FROM ttf JOIN idf USING (term)),
norms AS (SELECT template, sqrt(sum(weight * weight)) AS norm FROM tw GROUP BY template),
docs AS (SELECT doc_id, {path_sql} AS path, coalesce(text, '') AS text FROM {table}),
parts AS (
  SELECT doc_id, 'header' AS kind, i AS pos, s[i + 1] AS part FROM (SELECT doc_id, s, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?;]) +', '\\1' || chr(10), 'g'), chr(10)) AS s FROM docs))
  UNION ALL SELECT doc_id, 'file', -1, text FROM docs WHERE regexp_matches(text, '(?i){CUE}')),
tf AS (SELECT doc_id, kind, pos, term, count(*) AS tf FROM (SELECT doc_id, kind, pos, unnest(regexp_extract_all({lower('part')}, '{TERM}')) AS term FROM parts) GROUP BY ALL),
w AS (SELECT tf.*, tf * coalesce(idf, ln({1.0 + len(TEMPLATES)} / 2) + 1) AS w FROM tf LEFT JOIN idf USING (term)),
sizes AS (SELECT doc_id, kind, pos, sqrt(sum(w * w)) AS size FROM w GROUP BY ALL),
dots AS (SELECT w.doc_id, w.kind, w.pos, template, license, sum(w.w * weight) AS dot FROM w JOIN tw ON w.kind = tw.kind AND w.term = tw.term GROUP BY ALL),
scored AS (SELECT doc_id, kind, license, round(dot / (size * norm), 6) AS score FROM dots JOIN sizes USING (doc_id, kind, pos) JOIN norms USING (template)),
own AS (SELECT doc_id, license AS own_license, score AS own_score, kind AS own_kind FROM scored WHERE score >= CASE kind WHEN 'file' THEN {FILE_LEAST} ELSE {HEADER_LEAST} END QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license, kind) = 1),
files AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, own_license, own_score, own_kind FROM docs LEFT JOIN own USING (doc_id)),
notices AS (SELECT dir AS above, own_license AS lic FROM files WHERE own_license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, path) = 1),
levels AS (SELECT dir, d AS depth, array_to_string(list_slice(string_split(dir, '/'), 1, d), '/') AS above FROM (SELECT dir, unnest(range(len(string_split(dir, '/')) + 1)) AS d FROM (SELECT DISTINCT dir FROM files))),
near AS (SELECT dir, lic, levels.above AS above FROM levels JOIN notices USING (above) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY depth DESC, levels.above DESC) = 1)
SELECT doc_id, path, own_license, own_score, own_kind,
  CASE WHEN own_license IS NULL THEN lic END AS inherited_license, CASE WHEN own_license IS NULL THEN above END AS inherited_from,
  coalesce(own_license, lic) AS license, CASE WHEN own_license IS NOT NULL THEN 'own ' || own_kind WHEN lic IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis
FROM files LEFT JOIN near USING (dir)"""
