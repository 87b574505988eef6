import pytest
from pyspark.sql import functions as F

from conftest import DAY, MILLIS_2017_04_04, column
from wildtally import schemas
from wildtally.functions import cells
from wildtally.operators import aggregates, filters, limits
from wildtally.operators import matching
from wildtally.operators.matching import count_taxa, match_selectors, prepared, selector_index
from wildtally.operators.traits import parsed_terms, trait_filter
from wildtally.plans import generate
from wildtally.plans.queries import search
from wildtally.selector import InvalidSelector, selectors_frame


def days(spark, *dates):
    rows = [tuple(d.split("-")) if d else (None, None, None) for d in dates]
    return spark.createDataFrame(rows, "y string, m string, d string")


@pytest.mark.parametrize(
    "after, before, kept",
    [
        ("2016-02-03", "2017-05-01", ["2017"]),
        (None, None, ["2015", "2017", "2018", None]),
        (None, "2017-06-01", ["2015", "2017"]),
        ("2016-06-01", None, ["2017", "2018"]),
        ("2017-04-04", None, ["2018"]),
        (None, "2017-04-04", ["2015"]),
        ("2017-04-03T23:59:59", "2017-04-04T00:00:01", ["2017"]),
        ("2017-04-04T12:00", None, ["2018"]),
        (None, "2017-04-04T12:00", ["2015", "2017"]),
        ("2017-04-04T01:00+02:00", None, ["2017", "2018"]),
    ],
)
def test_day_partitions_between(spark, after, before, kept):
    rows = days(spark, "2015-04-04", "2017-04-04", "2018-04-04", None)
    assert column(filters.added_partition_filter(rows, after, before), "y") == kept
    # The same by the day of a time at noon.
    noon = rows.filter("y IS NOT NULL").select(
        "y", (F.unix_millis(F.make_date(*[F.col(c).cast("int") for c in "ymd"]).cast("timestamp")) + DAY // 2).alias("added")
    )
    assert column(filters.added_filter(noon, after, before), "y") == [k for k in kept if k]


def test_taxon_filter(spark, records):
    assert filters.taxon_filter(records, []).count() == 9
    assert column(filters.taxon_filter(records, ["Anas", "Anura"]), "id") == ["a1", "a1", "a2", "b1", "b2"]
    assert column(filters.taxon_filter(records, ["Musca"]), "id") == ["c1", "c2", None]
    assert column(filters.taxon_filter(records, ["anas", "Mus", "Insecta|"]), "id") == []
    # A term with a bar means the same however many there are: no element is equal to it.
    for others in ([], [f"other {i}" for i in range(20)]):
        assert column(filters.taxon_filter(records, ["Animalia|Insecta", *others]), "id") == []
    many = [f"x{i}" for i in range(30)] + ["Musca"]
    assert column(filters.taxon_filter(records, many), "id") == ["c1", "c2", None]


def test_trait_terms(spark):
    rows = parsed_terms(spark.createDataFrame([("mass <= 3.5| winged ,a b>=-1e3",)], "traitSelector string")).collect()
    assert sorted((r.trait, r.op, r.number) for r in rows) == [("a b", ">=", -1000.0), ("mass", "<=", 3.5), ("winged", "", None)]


@pytest.mark.parametrize(
    "selector, ids",
    [
        ("mass", ["a1", "a1", "a2", "b1", "b2"]),
        ("mass > 100", ["b1", "b2"]),
        ("mass = 40|winged", [None, "a1", "a1", "a2", "c1", "c2"]),
        ("mass < 30", []),
        ("unknown", []),
        (" , |", [None, "a1", "a1", "a2", "b1", "b2", "c1", "c2", "d1"]),
    ],
)
@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_trait_filter(records, traits, selector, ids, limit):
    kept = column(trait_filter(records, traits, selector, limit), "id")
    assert sorted(kept, key=str) == sorted(ids, key=str)


AREA = "ENVELOPE(-72,-70,43,42)"


def test_one_selector(records, traits):
    kept = generate.select_occurrences(records, ("Anura,Insecta", AREA, ""), traits)
    assert column(kept, "id") == ["a1", "a1", "a2", "c1"]
    kept = generate.select_occurrences(records, ("", AREA, "mass"), traits)
    assert column(kept, "id") == ["a1", "a1", "a2", "b1"]
    with pytest.raises(InvalidSelector):
        generate.select_occurrences(records, ("", AREA, "mass"))
    counts = generate.generate_checklist(records, ("", AREA, ""))
    assert {(r.taxonPath or "")[-4:]: r.recordCount for r in counts.collect()} == {"Rana": 3, "cuta": 1, "sca ": 1, "": 1}


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_many_selectors(spark, records, traits, limit):
    """A record is found once per selector, however many terms, cells or traits fit it."""
    cases = {
        ("Anura,Chordata,Animalia", AREA, ""): ["a1", "a1", "a2", "b1", "c1"],
        ("Anura|Chordata|Animalia", AREA, ""): None,
        ("", "ENVELOPE(-180,180,90,-90)", ""): ["a1", "a1", "a2", "b1", "b2", "c1", "d1"],
        ("Musca", "POLYGON ((-73 41, -69 41, -69 44, -73 44, -73 41))", ""): ["c1"],
        ("Animalia", AREA, "mass,mass > 1"): ["a1", "a1", "a2", "b1"],
        ("Brand#2", AREA, ""): None,
        ("Aves", "POINT (1 2)", ""): None,
        ("Aves", "ENVELOPE(0,1,1,0)", ""): None,
    }
    matched = match_selectors(records, selectors_frame(spark, cases), traits, limit)
    groups = matched.groupBy("uuid").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    assert sorted(column(groups, "ids")) == sorted(ids for ids in cases.values() if ids)
    counted = count_taxa(records, selector_index(prepared(selectors_frame(spark, cases)), limit), traits)
    by_taxon = {(r.uuid, r.taxon): r.n for r in counted.collect()}
    assert by_taxon == {(r.uuid, r.taxon): r["count"] for r in matched.groupBy("uuid", "taxon").count().collect()}
    with pytest.raises(InvalidSelector, match="trait list"):
        match_selectors(records, selectors_frame(spark, cases), None, limit)
    plain = match_selectors(records, selectors_frame(spark, [c for c in cases if not c[2]]), None, limit)
    assert plain.select("uuid").distinct().count() == 3


def test_hot_key_is_split(spark):
    """Half of all records in one cell, under one term: the shuffled match splits that partition."""
    hot = spark.range(40000).selectExpr("'A|B' AS taxon", "1 + id / 40001D AS lat", "3 - id / 40001D AS lng", "id AS start", "CAST(id AS STRING) AS id", "0L AS added", "'s' AS source")
    other = hot.selectExpr("concat('A|', id % 50) AS taxon", "CAST(id % 60 AS DOUBLE) AS lat", "CAST(id % 170 AS DOUBLE) AS lng", "start", "concat('o', id) AS id", "added", "source")
    records = hot.unionByName(other).repartition(8)
    selectors = selectors_frame(spark, [("B", "ENVELOPE(2,3,2,1)", ""), ("A", "ENVELOPE(-1,30,30,-1)", "")] + [(str(i % 50), f"ENVELOPE({i},{i + 2},{i % 50 + 2},{i % 50})", "") for i in range(150)])
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    broadcast = match_selectors(records, selectors).groupBy("uuid").count().collect()
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        matched = match_selectors(records, selectors, broadcast_limit=0).groupBy("uuid").count()
        shuffled = matched.collect()
        plan = matched._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan
    assert sorted(shuffled) == sorted(broadcast)


def test_thin_and_scattered_areas_have_no_world_cell(spark):
    areas = ["ENVELOPE(-180,180,1,0)", "ENVELOPE(0,160,1,0)", "MULTIPOLYGON (((-90 0, -89 0, -89 1, -90 0)), ((90 0, 91 0, 91 1, 90 0)))"]
    chosen = prepared(selectors_frame(spark, [("", wkt, "") for wkt in areas]))
    assert chosen.rdd.getNumPartitions() > 1
    found = {}
    for row in selector_index(chosen).keys.collect():
        found.setdefault(row.uuid, []).append(row.level)
    assert len(found) == 3
    for levels in found.values():
        assert len(levels) <= cells.MAX_CELLS and max(levels) < cells.WORLD
    # The two triangles of a degree each lie in a few cells of a degree.
    assert any(set(levels) == {0} and len(levels) <= 12 for levels in found.values())


def test_first_added(records):
    rows = {(r.source, r.id): r.added for r in aggregates.first_added(records).collect()}
    assert rows[("gbif", "a1")] == MILLIS_2017_04_04 and len(rows) == 8
    assert aggregates.first_record(records).count() == len(rows)


def test_limits(spark):
    rows = spark.range(30000).selectExpr("CAST(id % 7000 AS STRING) AS occurrenceId", "CAST(id AS STRING) AS monitorUUID")
    expected = sorted((r.occurrenceId, r.monitorUUID) for r in rows.collect())
    for limit in (0, 3, 20000, 29999, 50000):
        got = limits.first_rows(rows.repartition(5), "monitored", limit).collect()
        assert sorted((r.occurrenceId, r.monitorUUID) for r in got) == expected[:limit], limit
    assert limits.first_rows(rows, "monitored", None).count() == 30000
    with pytest.raises(ValueError):
        limits.first_rows(rows, "monitored", -1)


def test_search(spark):
    schema = "kingdom string, phylum string, class string, order string, family string, genus string, species string, decimalLatitude double, decimalLongitude double, hasSpatialIssue boolean"
    rows = [
        ("Animalia", None, "Aves", None, None, "Anas", "A. acuta", 5.0, 5.0, False),
        ("Animalia", None, "Aves", None, None, "Anas", "A. acuta", 5.0, 5.0, True),
        ("Animalia", None, "Aves", None, None, "Anas", "A. acuta", 5.0, 175.0, None),
        ("Plantae", None, None, None, None, None, None, 5.0, 5.0, None),
    ]
    ranked = spark.createDataFrame(rows, schema)
    assert search(ranked).count() == 3
    assert column(search(ranked, " Anas ", (10.0, 10.0, 0.0, 0.0)), "taxonPath") == ["Animalia|Aves|Anas|A. acuta"]
    assert column(search(ranked, "", (10.0, -170.0, 0.0, 170.0)), "lng") == [175.0]
    assert schemas.OCCURRENCE.names[0] == "taxon"


def _conditions(rows):
    """The joins and filters of a plan, one text each."""
    lines = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [line for line in lines if "Join Inner" in line or "Filter" in line]


def test_pairs_are_matched_by_compiled_code(spark, records, traits, monkeypatch):
    """No condition on pairs of record and selector calls a function for each element, apart from rims of polygons."""
    monkeypatch.setattr(matching, "_MANY_KEYS", 1)
    boxes = selectors_frame(spark, [("", f"ENVELOPE(-72,{n},43,42)", f"mass > {n + 100}|winged") for n in range(-71, -61)])
    matched = match_selectors(records, boxes, traits)
    assert not [line for line in _conditions(matched) if "lambda" in line]
    shape = selectors_frame(spark, [("", "POLYGON ((-73 41, -69 41.5, -69 44, -73 41))", "")])
    joined = [line for line in _conditions(match_selectors(records, boxes.unionByName(shape), traits)) if "Join Inner" in line]
    assert len([line for line in joined if "lambda" in line]) == 1 < len(joined)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_traits_before_and_after_the_match(spark, records, traits, limit, monkeypatch):
    lists = ["mass", "mass > 100", "mass = 40|winged", "mass < 30", "unknown", " , |", "", "mass >= 900,mass <= 30", "winged = 1"]
    chosen = selectors_frame(spark, [("", f"ENVELOPE(-180,180,{80 + i},-80)", text) for i, text in enumerate(lists)])
    found = []
    for many in (1, 1_000_000):
        monkeypatch.setattr(matching, "_MANY_KEYS", many)
        found.append(sorted(map(repr, match_selectors(records, chosen, traits, limit).collect())))
    assert found[0] == found[1] and len(found[0]) == 5 + 2 + 4 + 7 + 7 + 5


@pytest.mark.parametrize("hot", [100_000, 0])
def test_counts_by_taxon(spark, records, traits, hot, monkeypatch):
    """Records go to their taxon's task, apart from hot taxa: pairs are counted where they are matched."""
    monkeypatch.setattr(matching, "_MANY_KEYS", 1)
    monkeypatch.setattr(matching, "_HOT_RECORDS", hot)
    records = records.unionByName(records.withColumn("taxon", F.lit(None).cast("string")))
    chosen = [("", "ENVELOPE(-180,180,90,-90)", ""), ("Anura,Aves", AREA, "mass"), ("", "POLYGON ((-73 41, -69 41.5, -69 44, -73 41))", "")]
    counted = count_taxa(records, selector_index(prepared(selectors_frame(spark, chosen))), traits)
    matched = match_selectors(records, selectors_frame(spark, chosen), traits)
    assert {(r.uuid, r.taxon): r.n for r in counted.collect()} == {(r.uuid, r.taxon): r["count"] for r in matched.groupBy("uuid", "taxon").count().collect()}
    if hot:
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(taxon" in plan and "hashpartitioning(uuid" not in plan


def test_counts_in_blocks_of_selectors(spark, records, traits, monkeypatch):
    """Selectors beyond one broadcast come to the records in blocks: neither points nor pairs are shuffled."""
    monkeypatch.setattr(matching, "_MANY_KEYS", 1)
    records = records.unionByName(records.withColumn("taxon", F.lit(None).cast("string")))
    records = records.unionByName(records.withColumn("lng", F.col("lng") - 0.25))
    hole = "POLYGON ((-73 41, -69 41.5, -69 44, -73 44, -73 41), (-71.3 42.05, -70.6 42.3, -70.7 42.7, -71.3 42.05))"
    chosen = [
        ("", "ENVELOPE(-180,180,90,-90)", ""),
        ("Anura,Aves", AREA, "mass"),
        ("Rana,Chordata,Anas,Amphibia,Unknown", AREA, ""),
        ("Chordata,Rana", "ENVELOPE(-72,-70,43,42)", "mass > 100,winged"),
        ("", "POLYGON ((-73 41, -69 41.5, -69 44, -73 41))", "unknown"),
        ("", "POLYGON ((-73 41, -69 41.5, -69 44, -73 41))", ""),
        ("Animalia,Insecta", hole, ""),
    ]
    rows = prepared(selectors_frame(spark, chosen))
    index = selector_index(rows, 100 * selector_index(rows).keys.count())
    counted = count_taxa(records, index, traits)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(taxon" in plan and "hashpartitioning(uuid" not in plan
    assert "keys=[taxon" in plan and ", lat" not in "".join(line for line in plan.splitlines() if "keys=[" in line)
    assert not index.small and index.blocks > 1
    matched = match_selectors(records, selectors_frame(spark, chosen), traits).groupBy("uuid", "taxon").count()
    found = counted.collect()
    assert {(r.uuid, r.taxon): r.n for r in found} == {(r.uuid, r.taxon): r["count"] for r in matched.collect()}
    assert len({(r.uuid, r.taxon) for r in found}) == len(found) > 12 and len({r.uuid for r in found}) == 6
