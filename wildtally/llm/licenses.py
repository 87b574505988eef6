"""Licences of documents: notices by TF-IDF cosine to templates, then inheritance from directories.

What is scored is what mentions a licence at all (a cue word): single lines, headers (lines in a row,
without their comment marks, up to an empty line) and whole texts. Equal ones, by their terms, are scored
once: their terms are joined with the templates' terms, products and squares are summed, and the best
template above a threshold is the licence. A text that is alike a template as a whole is the licence file of
its directory, and so is a file of such a name that holds a notice; a document without a notice of its own
takes the licence of the nearest directory above it that has one, found by joining the distinct
directories with their ancestors.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wildtally.llm.tables import settings, written
from wildtally.operators.sizes import measured, small_side

# Licences and what licensors write for them, as short notices, titles and whole texts.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT = f"""MIT License. Copyright (c) year holder. {_GRANT}
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Copyright (c) year holder. All rights reserved.
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_NO_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_ISC = """Copyright (c) year holder. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", _APACHE),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD.format(_NO_NAME)),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Released into the public domain under the CC0 1.0 licence."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", _GNU.format("", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", _GNU.format("", "3")),
    ("ISC", _ISC),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", _GNU.format("Lesser ", "3")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, under the MIT License."),
    ("MIT", _GRANT),
    ("MIT", _MIT),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# Every licence may be named by its identifier.
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in sorted({name for name, _ in TEMPLATES})]
# Every notice holds one of these (in lower case); templates have to.
CUES = ("licens", "licence", "copyright", "public domain")
THRESHOLD = 0.6
# Names of licence files, in lower case; an ending may follow.
NAMED = "(^|/)(licen[cs]e|unlicense|copying|copyright)([.-][^/]*)?\\z"

_TERMS = "array_join(filter(split(lower({}), '[^a-z0-9]+'), t -> t != ''), ' ')"
# Marks of comments at the ends of a line.
_LEFT, _RIGHT = "^[ \\t#/*;%<!>-]+", "[ \\t\\r#/*;%<!>-]+\\z"


def _bare(text: str) -> str:
    return f"array_join(transform(split({text}, '\\n'), l -> regexp_replace(regexp_replace(l, r'{_LEFT}', ''), r'{_RIGHT}', '')), '\\n')"


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys, term, tf`` of a column ``terms``; rows that lie together by a key stay where they are."""
    return rows.select(*keys, F.explode(F.split("terms", " ")).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def notices(texts: DataFrame, templates: DataFrame) -> DataFrame:
    """``key, license, score`` of the ``texts`` (key, terms: joined by spaces) that are alike a template (license, line).

    ``key`` stands for ``terms``. One shuffle by ``key`` brings equal texts together, and all sums are made there.
    """
    known = templates.select("license", "line").distinct()
    if not known.filter(~_cued("line")).isEmpty():
        raise ValueError("each template needs a cue word")
    known = known.select("license", F.col("line").alias("template"), F.expr(_TERMS.format("line")).alias("terms"))
    vectors = written(_counted(known, "license", "template"), "templates")
    many = known.count()
    idf = vectors.groupBy("term").agg((F.log((F.lit(many) + 1.0) / (F.countDistinct("license", "template") + 1.0)) + 1.0).alias("idf"))
    vectors = vectors.join(idf, "term").withColumn("weight", F.col("tf") * F.col("idf"))
    norms = vectors.groupBy("license", "template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    part = F.struct("license", "template", F.expr("weight / norm").alias("unit"))
    uses = vectors.join(norms, ["license", "template"]).groupBy("term", "idf").agg(F.collect_list(part).alias("uses"))
    uses = written(uses.withColumn("bytes", F.expr("aggregate(uses, 0, (n, u) -> n + 64 + octet_length(u.license) + octet_length(u.template))")), "uses")
    size = uses.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    distinct = texts.groupBy("key").agg(F.first("terms").alias("terms"))
    weighed = _counted(distinct, "key").join(small_side(uses.drop("bytes"), size.n, size.bytes), "term", "left")
    weighed = weighed.withColumn("weight", F.expr(f"tf * coalesce(idf, ln({many} + 1.0D) + 1.0D)"))
    # One more entry, without a template, adds up the squares.
    entries = "concat(array(named_struct('license', CAST(NULL AS STRING), 'template', CAST(NULL AS STRING), 'unit', weight)), coalesce(uses, array()))"
    sums = weighed.select("key", "weight", F.explode(F.expr(entries)).alias("e")).groupBy("key", "e.license", "e.template").agg(F.sum(F.expr("weight * e.unit")).alias("dot"))
    scored = sums.groupBy("key").agg(F.sqrt(F.max(F.expr("IF(template IS NULL, dot, NULL)"))).alias("size"), F.collect_list(F.expr("IF(template IS NULL, NULL, struct(license, dot))")).alias("dots"))
    best = scored.select("key", F.expr("array_min(transform(dots, d -> struct(-round(d.dot / size, 6) AS s, d.license AS license)))").alias("b"))
    return best.filter(F.col("b.s") <= -THRESHOLD).select("key", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def _cued(column: str):
    low = F.lower(column)
    found = [F.contains(low, F.lit(c)) for c in CUES]
    return found[0] | found[1] | found[2] | found[3]


def _units(files: DataFrame) -> DataFrame:
    """``doc_id, dir, gives`` and the ``key`` and ``terms`` of each line, header and whole text that may hold a notice.

    ``gives``: whether a notice there makes the file its directory's licence file.
    """
    cued = files.filter(_cued("text"))
    of = lambda unit, gives: f"struct({unit} AS unit, {gives} AS gives)"
    lines = f"transform(split(text, '\\n'), l -> {of('l', 'named')})"
    headers = f"transform(filter(split({_bare('text')}, '\\n\\n+'), p -> contains(p, '\\n')), p -> {of('p', 'named')})"
    rows = cued.select("doc_id", "dir", F.explode(F.expr(f"concat({lines}, {headers}, array({of('text', 'true')}))")).alias("u"))
    rows = rows.select("doc_id", "dir", "u.unit", "u.gives").filter(_cued("unit"))
    return rows.select("doc_id", "dir", "gives", F.expr(_TERMS.format("unit")).alias("terms")).withColumn("key", F.md5("terms"))


def with_paths(docs: DataFrame) -> DataFrame:
    """``doc_id, path, text`` of the table ``documents``: a source is a tree with a directory for each hundred ids."""
    path = "concat_ws('/', coalesce(source, 'unknown'), CAST(doc_id DIV 1000 AS STRING), CAST(doc_id DIV 100 % 10 AS STRING), concat(CAST(doc_id AS STRING), '.txt'))"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(path).alias("path"), "text")


def scan(files: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """The licence of every row of ``files`` (doc_id, path, text).

    ``doc_id, path, own_license, own_score, license, license_dir``: ``license`` is the own one or that of
    the nearest directory with a licence file, which ``license_dir`` names then. Several notices: the
    best score wins, then the first licence by name. A licence file is one that as a whole is alike a template,
    or one of such a name (``NAMED``) with any notice; texts are of any length. Null or empty texts have no notice; a path that is
    null, or without a directory, inherits nothing. Rows that share a doc_id share their notices; rows
    without one have none of their own. An empty table gives no rows; other columns are not looked at.

    Runs jobs while it is called: notices and directories are written to the shared folder.
    """
    spark = settings(files.sparkSession)
    if templates is None:
        templates = spark.createDataFrame(TEMPLATES, "license string, line string")
    dir_of = F.expr("IF(path LIKE '%/%', regexp_replace(path, '/[^/]*$', ''), NULL)")
    files = files.select("doc_id", "path", "text", dir_of.alias("dir"), F.coalesce(F.lower("path").rlike(NAMED), F.lit(False)).alias("named"))
    units = _units(files)
    told = measured(written(notices(units.select("key", "terms"), templates), "notices"), "key", "license")
    held = units.groupBy("key", "doc_id", "dir").agg(F.max("gives").alias("gives"))
    found = written(held.join(told, "key").select("doc_id", "dir", "gives", "license", "score"), "found")
    first = F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")
    own = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(first).selectExpr("doc_id", "b.license AS own_license", "-b.s AS own_score")
    given = found.filter("gives AND dir IS NOT NULL").groupBy("dir").agg(first).selectExpr("dir AS license_dir", "b.license AS dir_license")
    dirs = files.select("dir").filter("dir IS NOT NULL").distinct()
    above = dirs.select("dir", F.explode(F.expr("transform(sequence(1, size(split(dir, '/'))), n -> concat_ws('/', slice(split(dir, '/'), 1, n)))")).alias("license_dir"))
    nearest = above.join(given, "license_dir").groupBy("dir").agg(F.max(F.struct(F.length("license_dir").alias("depth"), "license_dir", "dir_license")).alias("b"))
    nearest = measured(written(nearest.selectExpr("dir", "b.license_dir", "b.dir_license"), "nearest"), "dir", "license_dir", "dir_license")
    out = files.select("doc_id", "path", "dir").join(measured(written(own, "own")), "doc_id", "left").join(nearest, "dir", "left")
    return out.select(
        "doc_id",
        "path",
        "own_license",
        "own_score",
        F.coalesce("own_license", "dir_license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("license_dir")).alias("license_dir"),
    )


def _scan_sql() -> str:
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in TEMPLATES)
    cue = lambda c: "(" + " OR ".join(f"contains(lower({c}), '{x}')" for x in CUES) + ")"
    terms = "array_to_string(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda t: t != ''), ' ')"
    bare = f"array_to_string(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(regexp_replace(l, '{_LEFT}', ''), '{_RIGHT}', '')), chr(10))"
    many = len(TEMPLATES)
    return f"""
WITH templates(license, template) AS (VALUES {values}),
tv AS (SELECT license, template, term, count(*) AS tf FROM (SELECT license, template, unnest(string_split({terms.format("template")}, ' ')) AS term FROM templates) GROUP BY ALL),
idf AS (SELECT term, ln(({many} + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM tv GROUP BY term),
tw AS (SELECT license, template, term, tf * idf AS w FROM tv JOIN idf USING (term)),
tn AS (SELECT license, template, sqrt(sum(w * w)) AS norm FROM tw GROUP BY ALL),
files AS (SELECT doc_id, text, concat_ws('/', coalesce(source, 'unknown'), doc_id // 1000, doc_id // 100 % 10) AS dir,
    concat_ws('/', coalesce(source, 'unknown'), doc_id // 1000, doc_id // 100 % 10, concat(doc_id, '.txt')) AS path FROM documents),
noted AS (SELECT doc_id, dir, text, regexp_matches(lower(path), '{NAMED}') AS named FROM files WHERE {cue("text")}),
units AS (SELECT doc_id, dir, named AS gives, unnest(string_split(text, chr(10))) AS unit FROM noted
    UNION ALL SELECT doc_id, dir, named, unit FROM (SELECT doc_id, dir, named, unnest(string_split_regex({bare}, '\\n\\n+')) AS unit FROM noted) WHERE contains(unit, chr(10))
    UNION ALL SELECT doc_id, dir, true, text FROM noted),
cued AS (SELECT doc_id, dir, gives, {terms.format("unit")} AS line FROM units WHERE {cue("unit")}),
lt AS (SELECT line, term, count(*) AS tf FROM (SELECT line, unnest(string_split(line, ' ')) AS term FROM (SELECT DISTINCT line FROM cued)) GROUP BY ALL),
lw AS (SELECT line, term, tf * coalesce(idf, ln({many} + 1.0) + 1.0) AS w FROM lt LEFT JOIN idf USING (term)),
ln_ AS (SELECT line, sqrt(sum(w * w)) AS norm FROM lw GROUP BY line),
dots AS (SELECT line, license, template, sum(lw.w * tw.w) AS dot FROM lw JOIN tw USING (term) GROUP BY ALL),
scored AS (SELECT line, license, round(dot / ln_.norm / tn.norm, 6) AS score FROM dots JOIN ln_ USING (line) JOIN tn USING (license, template)),
best AS (SELECT * FROM scored WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, license) = 1),
found AS (SELECT doc_id, dir, gives, license, score FROM cued JOIN best USING (line)),
own AS (SELECT doc_id, license AS own_license, score AS own_score FROM found QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
given AS (SELECT dir AS license_dir, license AS dir_license FROM found WHERE gives QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1),
nearest AS (SELECT dir, license_dir, dir_license FROM (SELECT DISTINCT dir FROM files) d JOIN given ON d.dir = license_dir OR starts_with(d.dir, concat(license_dir, '/'))
    QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(license_dir) DESC) = 1)
SELECT doc_id, path, own_license, own_score, coalesce(own_license, dir_license) AS license, CASE WHEN own_license IS NULL THEN license_dir END AS license_dir
FROM files LEFT JOIN own USING (doc_id) LEFT JOIN nearest USING (dir)"""


SCAN_SQL = _scan_sql()
