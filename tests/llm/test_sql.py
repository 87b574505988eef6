"""Fingerprints and licences against their SQL, over given tables and over odd rows."""

import textwrap

import duckdb
import pytest
from llm_helpers import frame, odd_rows, tuples

from wildtally.llm import fingerprints, licenses, registry

FOLDER = "/root/testdata/sf0.001"
NOTICE = "Released under the MIT License."


def rows_of(spark):
    rows = odd_rows()[:30] + [(None, "no id"), (10, "one id, two texts"), (90, "a. b! c? d\n\n\ne.f"), (91, "x" * 1000), (92, "x" * 1000), (93, "日本語。" * 40), (94, "ab")]
    rows += [(1100 + i, f"{i}\n{NOTICE}\nend") for i in range(4)] + [(1150, "long " * 200 + "\n" + NOTICE), (1151, "plain"), (2250, "licensed under the apache license version 2.0"), (-5, NOTICE)]
    return frame(spark, rows)


def sql(query, docs):
    db = duckdb.connect()
    if docs is None:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    else:
        given = docs.toArrow()  # noqa: F841
        db.execute("CREATE TABLE documents AS SELECT * FROM given")
    out = db.execute(query)
    names = [c[0] for c in out.description]
    return names, sorted(map(repr, out.fetchall()))


@pytest.mark.parametrize("small", [False, True])
def test_fingerprints(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(fingerprints, "RANGE_ROWS", 3)
    docs = rows_of(spark)
    names, expected = sql(fingerprints.EDITS_SQL, docs)
    assert sorted(map(repr, tuples(fingerprints.edits(docs), *names))) == expected
    for given in (frame(spark, []), frame(spark, [(5, "alone. here")])):
        names, expected = sql(fingerprints.EDITS_SQL, given)
        assert sorted(map(repr, tuples(fingerprints.edits(given), *names))) == expected


def test_edits_are_found_in_their_section(spark):
    lines = [f"line {i} of the text. It has two sentences." for i in range(200)]
    changed = lines[:150] + ["another line"] + lines[151:]
    rows = fingerprints.fingerprint(fingerprints.fingerprint(frame(spark, [(1, "\n".join(lines))]).selectExpr("text AS a", f"'{chr(92) + 'n'}' AS nl"), "a", "fa"), "nl", "x")
    rows = rows.crossJoin(fingerprints.fingerprint(frame(spark, [(1, "\n".join(changed))]).selectExpr("text AS b"), "b", "fb"))
    row = rows.select(fingerprints.likeness("fa", "fb").alias("near"), fingerprints.likeness("fa", "fa").alias("same"), fingerprints.edited_sections("fa", "fb").alias("edits"), "fa").first()
    sections = row.fa.count("/")
    assert row.same == 1.0 and 0.9 < row.near < 1.0 and 1 <= len(row.edits) <= 2 < sections


def test_licenses(spark):
    docs = rows_of(spark)
    names, expected = sql(licenses.SCAN_SQL, docs.filter("doc_id IS NOT NULL"))
    found = licenses.scan(licenses.with_paths(docs.filter("doc_id IS NOT NULL")))
    assert sorted(map(repr, tuples(found, *names))) == expected
    got = {d: (o, g, p) for d, o, g, p in tuples(found, "doc_id", "own_license", "license", "license_dir")}
    assert got[1150] == ("MIT", "MIT", None) and got[1151] == (None, "MIT", "unknown/1/1") and got[2250][1] == "Apache-2.0" and got[90] == (None, "MIT", "unknown/0/0")
    assert licenses.scan(licenses.with_paths(frame(spark, []))).collect() == []


def test_nearest_directory(spark):
    rows = [(1, "a/LICENSE", NOTICE), (2, "a/b/c/x", "none"), (3, "a/b/LICENSE", "Licensed under CC BY 4.0."), (4, "a/d/x", None), (5, "ab/x", ""), (6, None, "x"), (7, "x", NOTICE), (8, "a/b/c/d/e", "word"), (None, "a/z", NOTICE)]
    got = {d: (g, p) for d, g, p in tuples(licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")), "doc_id", "license", "license_dir")}
    assert got == {1: ("MIT", None), 2: ("CC-BY-4.0", "a/b"), 3: ("CC-BY-4.0", None), 4: ("MIT", "a"), 5: (None, None), 6: (None, None), 7: ("MIT", None), 8: ("CC-BY-4.0", "a/b"), None: ("MIT", "a")}


def test_whole_texts_headers_and_identifiers(spark):
    full = dict(reversed([(name, text) for name, text in licenses.TEMPLATES if len(text) > 600]))
    mit = full["MIT"].replace("year holder", "2019 Some One").replace(". Permission", "\n\nPermission").replace("conditions:\n", "conditions:\n\n")
    apache = dict((name, text) for name, text in licenses.TEMPLATES if "Unless required" in text)["Apache-2.0"]
    header = "#!/bin/sh\n#\n" + "".join(f"# {line}\n" for line in textwrap.wrap(apache, 60)) + "\necho done\n" + "do_something\n" * 300
    rows = [
        (1, "r/LICENSE", mit),
        (2, "r/src/a.c", "int x;"),
        (3, "s/licence.txt", "Some words of our own first.\n" * 50 + "\n" + "GNU GENERAL PUBLIC LICENSE\n    Version 3, 29 June 2007\n\n" + "Further words of no meaning.\n" * 900),
        (4, "s/b", "x"),
        (5, "t/1", "// SPDX-License-Identifier: MIT\nint y;\n" * 1),
        (6, "t/2", "/* SPDX-License-Identifier: Apache-2.0 */\n" + "int y;\n" * 500),
        (7, "t/3", "Mozilla Public License Version 2.0"),
        (8, "t2/4", header),
        (9, "t2/5", "x"),
        (10, "u/any name", full["BSD-3-Clause"]),
        (11, "u/v/w", ""),
        (12, "u2/any name", full["BSD-2-Clause"] + "\n"),
        (13, "u2/x", None),
        (14, "v/1", "Copyright 2020 by Some One. All rights reserved.\nA licence to print money, as they say."),
        (15, "v/2", "none"),
        (16, "w/1", full["ISC"]),
    ]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"))
    got = {d: (o, g) for d, o, g in tuples(found, "doc_id", "own_license", "license")}
    assert got[1] == ("MIT", "MIT") and got[2] == (None, "MIT")
    assert got[3] == ("GPL-3.0", "GPL-3.0") and got[4] == (None, "GPL-3.0")
    assert got[5][0] == "MIT" and got[6][0] == "Apache-2.0" and got[7][0] == "MPL-2.0"
    assert got[8][0] == "Apache-2.0" and got[9] == (None, None)
    assert got[10][0] == "BSD-3-Clause" and got[11] == (None, "BSD-3-Clause") and got[12][0] == "BSD-2-Clause" and got[13] == (None, "BSD-2-Clause")
    assert got[14] == (None, None) and got[15] == (None, None) and got[16][0] == "ISC"


@pytest.mark.parametrize("name", ["op1_license_scan", "op5_document_fingerprints"])
def test_queries(spark, name):
    names, expected = sql(registry.oracle_sql()[name], None)
    found = registry.queries()[name](spark, FOLDER)
    assert sorted(names) == sorted(found.columns) and sorted(map(repr, tuples(found, *names))) == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Nested" not in plan and "Cartesian" not in plan
