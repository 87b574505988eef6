import pytest
from pyspark.sql import functions as F

from wildtally.functions import lines
from wildtally.functions import selectors as S
from wildtally.operators import filters
from wildtally.functions.dates import day_partitions, iso_millis, parse_utc
from wildtally.functions.links import QUOTED, occurrence_url, quote_query
from wildtally.functions.shapes import bbox_wkt
from wildtally.functions.taxa import last_taxon, path_elements, rank_path, taxon_name
from wildtally.selector import InvalidSelector, normalized, resolve, selectors_frame, with_uuid


def evaluate(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_taxon_names(spark):
    cases = {
        "|some|none|empty|": ("empty", "empty"),
        "||||": ("", ""),
        "a||": ("a", "a"),
        "a| ": ("a", ""),
        "a | b ": (" b ", "b"),
        "Cartoona | mickey": (" mickey", "mickey"),
        "bla|": ("bla", "bla"),
        "a|\tb\n": ("\tb\n", "b"),
        "a|\x01": ("a", ""),
        "": ("", ""),
        None: ("", ""),
    }
    got = evaluate(spark, [(k,) for k in cases], "t string", taxon_name(F.col("t")), last_taxon(F.col("t")))
    assert got == list(cases.values())


def test_path_elements(spark):
    cases = {" a |b||a|\tc d\n": ["a", "b", "c d"], "": [], "| |": [], None: [], "a|b": ["a", "b"], "x | y": ["x", "y"]}
    got = evaluate(spark, [(k,) for k in cases], "t string", path_elements(F.col("t")))
    assert [g[0] for g in got] == list(cases.values())


def test_path_elements_with_blanks_inside(spark):
    cases = {"a b|a b": ["a b"], "a\x01b|c": ["a\x01b", "c"], "\x1fa|b": ["a", "b"], "a|\x00b\r|a": ["a", "b"], " a": ["a"], "a ": ["a"], "a||": ["a"], "| a": ["a"], "\u00a0a|\u00e9 |b": ["\u00a0a", "\u00e9", "b"]}
    got = evaluate(spark, [(k,) for k in cases], "t string", path_elements(F.col("t")))
    assert [g[0] for g in got] == list(cases.values())


def test_rank_path_skips_absent_ranks(spark):
    got = evaluate(spark, [("a", None, "c")], "x string, y string, z string", rank_path(*map(F.col, "xyz")))
    assert got == [("a|c",)]


def test_urls(spark):
    rows = [("gbif", "10030"), ("idigbio", "10030"), ("gbif", "some,, "), ("a source", "x"), ("gbif", None), (None, "x")]
    got = [u for (u,) in evaluate(spark, rows, "s string, i string", occurrence_url(F.col("s"), F.col("i")))]
    assert got == [
        "http://www.gbif.org/occurrence/search?OCCURRENCE_ID=10030",
        "http://portal.idigbio.org/search?rq=%7B%22occurrenceid%22:%2210030%22%7D",
        "http://www.gbif.org/occurrence/search?OCCURRENCE_ID=some,,%20",
        None,
        None,
        None,
    ]


def test_query_quoting(spark):
    cases = {
        "100%25": "100%2525",
        ",:;/?@&=+$[]-_.!~*'()": ",:;/?@&=+$[]-_.!~*'()",
        '"<>#\\^`{|}': "%22%3C%3E%23%5C%5E%60%7B%7C%7D",
        "é日": "é日",
        "a b \u0085": "a%C2%A0b%E2%80%A8%C2%85",
        "\x7f\t\n\x00": "%7F%09%0A%00",
    }
    got = evaluate(spark, [(k,) for k in cases], "t string", quote_query(F.col("t")))
    assert [g[0] for g in got] == list(cases.values())
    assert QUOTED[0] == "%"


def test_dates(spark):
    got = evaluate(spark, [(123,), (-3176841600000,), (1433203200000,)], "m bigint", iso_millis(F.col("m")))
    assert [g[0] for g in got] == ["1970-01-01T00:00:00.123Z", "1869-05-01T00:00:00.000Z", "2015-06-02T00:00:00.000Z"]
    texts = [("2016",), ("2016-06",), ("2016-06-01",), ("2016-06-01T12:00",), ("2016-06-01T12:00:00+02:00",)]
    got = evaluate(spark, texts, "t string", F.date_format(parse_utc(F.col("t")), "yyyy-MM-dd HH:mm"))
    assert [g[0] for g in got] == ["2016-01-01 00:00", "2016-06-01 00:00", "2016-06-01 00:00", "2016-06-01 12:00", "2016-06-01 10:00"]
    got = evaluate(spark, [(-1,), (0,), (1433203200000 + 86399999,)], "m bigint", *day_partitions(F.col("m")).values())
    assert got == [("1969", "12", "31"), ("1970", "01", "01"), ("2015", "06", "02")]


def test_bad_date_fails(spark):
    for text in ("2016-W05", "today", "now", "epoch", "06:30", "T06:30", " 2016 ", "2016-06-01 12:00", "20160601", ""):
        with pytest.raises(Exception, match="not an ISO date"):
            spark.createDataFrame([(text,)], "t string").select(parse_utc(F.col("t"))).collect()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("2016-13-01",)], "t string").select(parse_utc(F.col("t"))).collect()


def test_times_without_a_day(spark):
    first, last = -62167219200000, 253402300799999
    times = [first - 1, first, last, last + 1, 10**16, -(10**17)]
    got = evaluate(spark, [(t,) for t in times], "added bigint", *day_partitions(F.col("added")).values())
    none = (None, None, None)
    assert got == [none, ("0000", "01", "01"), ("9999", "12", "31"), none, none, none]
    assert evaluate(spark, [(last + 1,)], "m bigint", iso_millis(F.col("m"))) == [("10000-01-01T00:00:00.000Z",)]
    rows = spark.createDataFrame([(t,) for t in times], "added bigint").withColumns(day_partitions(F.col("added")))
    for after, before in [("0000-01-01", None), (None, "9999-12-31T12:00"), ("2000-01-01", "2001-01-01")]:
        plain = filters.added_filter(rows, after, before).select("added").collect()
        assert sorted(plain) == sorted(filters.added_partition_filter(rows, after, before).select("added").collect())
        assert {r.added for r in plain} <= {first, last}


def test_tsv_lines(spark):
    schema = "taxon string, lat double, lng double, start bigint, id string, added bigint, source string"
    rest = "\t-3.5\t40.25\t1970-01-01T00:00:00.007Z\tspecimen 8\t1970-01-02T00:00:00.000Z\tmuseum\t"
    cases = {"a taxon": "a taxon\ta taxon", "bla|": "bla\tbla|", "|": "\t|", "a||": "a\ta||", None: "\t"}
    rows = [(t, -3.5, 40.25, 7, "specimen 8", 86400000, "museum") for t in cases]
    got = evaluate(spark, rows, schema, lines.occurrence_tsv_line())
    assert [g[0] for g in got] == [start + rest for start in cases.values()]
    got = evaluate(spark, [("donald", 1)], "taxonPath string, recordCount bigint", lines.checklist_tsv_line())
    assert got == [("donald\tdonald\t1",)]
    rows = [("some id", None), ("another id", "someUUID")]
    got = evaluate(spark, rows, "occurrenceId string, monitorUUID string", lines.monitored_tsv_line())
    assert [g[0] for g in got] == ["some id\t", "another id\tsomeUUID"]


# Selectors and their identifiers.
DUCKS_AND_FROGS = (
    "Anas|Anura",
    "POLYGON ((-72.147216796875 41.492120839687786, -72.147216796875 43.11702412135048, "
    "-69.949951171875 43.11702412135048, -69.949951171875 41.492120839687786, -72.147216796875 41.492120839687786))",
    "",
)
UUIDS = {
    ("Animalia|Insecta", "ENVELOPE(-150,-50,40,10)", ""): "55e4b0a0-bcd9-566f-99bc-357439011d85",
    ("Aves|Mammalia", "some wkt", "some trait"): "16c62920-81fa-5216-aab1-bfda5cdfacde",
    ("Animalia|Insecta", "POLYGON ((-150 10, -150 40, -50 40, -50 10, -150 10))", ""): "5ffd7bae-5fe0-5692-b914-bf90e921fa1b",
    ("Cartoona | mickey", "some wkt string", "some trait selector"): "cd459078-feb1-5b84-b21e-fead00792c7d",
    DUCKS_AND_FROGS: "06ac07ec-7d99-521b-a768-04ab6013ab27",
}


def test_selector_uuids(spark):
    rows = with_uuid(selectors_frame(spark, UUIDS)).collect()
    assert [r.uuid for r in rows] == list(UUIDS.values())


def test_selector_path(spark):
    uuid = "16c62920-81fa-5216-aab1-bfda5cdfacde"
    got = evaluate(spark, [(uuid,)], "u string", S.selector_path(F.col("u")))
    assert got == [(f"u0=16/u1=c6/u2=29/uuid={uuid}",)]


def test_normalized_selectors_are_distinct(spark):
    rows = normalized(selectors_frame(spark, [("Animalia,Insecta", "ENVELOPE(-150,-50,40,10)", None), next(iter(UUIDS))]))
    assert [(r.taxonSelector, r.uuid) for r in rows.collect()] == [("Animalia|Insecta", "55e4b0a0-bcd9-566f-99bc-357439011d85")]


def test_pick_uuid(spark):
    wkt, uuid = "ENVELOPE(-150,-50,40,10)", "55E4B0A0-bcd9-566f-99bc-357439011d85"
    rows = [
        (uuid, "other", "other", None),
        ("55e4b0a0", "Animalia,Insecta", wkt, ""),
        (None, "Animalia,Insecta", wkt, None),
        (None, "Animalia", None, ""),
    ]
    got = evaluate(spark, rows, "u string, t string, w string, r string", S.pick_uuid(*map(F.col, "utwr")))
    assert [g[0] for g in got] == [uuid.lower(), None, uuid.lower(), None]


def test_valid_taxa(spark):
    cases = {"": True, "Animalia|Insecta": True, "a b,c\n": True, "/etc/passwd": False, "Brand#2": False, "é": False, None: False}
    got = evaluate(spark, [(k,) for k in cases], "t string", S.valid_taxa(F.col("t")))
    assert [g[0] for g in got] == list(cases.values())


def test_resolve_checks(spark):
    assert resolve(spark, ("Animalia,Insecta", "ENVELOPE(-150,-50,40,10)", "")).uuid == "55e4b0a0-bcd9-566f-99bc-357439011d85"
    assert resolve(spark, uuid="55E4B0A0-bcd9-566f-99bc-357439011d85").uuid == "55e4b0a0-bcd9-566f-99bc-357439011d85"
    for bad in [("/etc/passwd", "ENVELOPE(-150,-50,40,10)", ""), ("Aves", "DUCK(-150,-50,40,10)", "")]:
        with pytest.raises(InvalidSelector):
            resolve(spark, bad)
    with pytest.raises(InvalidSelector):
        resolve(spark, uuid="55e4")


def test_bbox(spark):
    got = evaluate(spark, [(40.5, -50.0, 10.0, -150.25)], "n double, e double, s double, w double", bbox_wkt(*map(F.col, "nesw")))
    assert got == [("POLYGON((-50.0 40.5,-50.0 10.0,-150.25 10.0,-150.25 40.5,-50.0 40.5))",)]
