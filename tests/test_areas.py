import math
import random

import pytest
from pyspark.sql import functions as F

from wildtally import schemas
from wildtally.functions.shapes import area, valid_wkt
from wildtally.operators import filters
from wildtally.operators.matching import match_index, match_selectors, prepared, selector_index
from wildtally.selector import InvalidSelector, selectors_frame
from tests_helpers import inside, star, wkt_of


def test_valid_wkt(spark):
    square = "((0 0, 0 9, 9 9, 9 0, 0 0))"
    cases = {
        "ENVELOPE(-150,-50,40,10)": True,
        "envelope ( -150 , -50,4e1, 10. ) ": True,
        "ENVELOPE(170,-170,10,-10)": True,
        "ENVELOPE(-150,-50,10,40)": False,
        "ENVELOPE(-190,-50,40,10)": False,
        "ENVELOPE(-150,-50,40)": False,
        "DUCK(-150,-50,40,10)": False,
        f"POLYGON {square}": True,
        f"POLYGON{square} x": False,
        "POLYGON ((0 0, 0 9, 9 9, 9 0))": False,
        "POLYGON ((0 0, 0 9, 0 0))": False,
        "POLYGON ((0 0, 0 99, 9 9, 0 0))": False,
        "POLYGON ((0 0 5, 0 9 5, 9 9 5, 0 0 5))": True,
        f"MULTIPOLYGON ({square}, {square})": True,
        f"MULTIPOLYGON {square}": False,
        "POINT (3 4)": True,
        "POINT (3 400)": False,
        "POINT EMPTY": True,
        "MULTIPOINT ((1 2), (3 4))": True,
        "LINESTRING (1 2, 3 4)": True,
        "LINESTRING (1 2, 3)": False,
        "MULTILINESTRING ((1 2, 3 4), (5 6, 7 8))": True,
        "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (1 2, 3 4))": True,
        "BUFFER (POINT (1 2), 5)": True,
        "some wkt": False,
        "": False,
        None: False,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "w string").select("w", valid_wkt("w").alias("v")).collect()
    assert {r.w: r.v for r in rows} == cases


def test_long_polygons_are_parsed(spark):
    points = [(90 * math.cos(i / 20000 * math.tau), 45 * math.sin(i / 20000 * math.tau)) for i in range(20000)]
    points.append(points[0])
    row = spark.createDataFrame([(wkt_of([points]),)], "w string").select(area("w").alias("a")).first()
    assert row.a.valid and len(row.a.edges) == 20000


SHAPES = {
    "ENVELOPE(-10,10,5,-5)": None,
    "triangle": [[(-7, -3), (8, -4), (2, 9), (-7, -3)]],
    "hole": [[(-9, -9), (9, -9), (9, 9), (-9, 9), (-9, -9)], [(-4, -4), (4, -3), (0, 5), (-4, -4)]],
    "star": [star(41, 9, 3)],
    "many": [star(301, 9.5, 2)],
    "huge": [star(101, 80, 30)],
}


def points(count=600, spread=11):
    rng = random.Random(7)
    grid = [(x, y) for x in range(-10, 11) for y in range(-10, 11)]
    return grid + [(rng.uniform(-spread, spread), rng.uniform(-spread, spread)) for _ in range(count)] + [
        (rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(count)
    ]


@pytest.fixture(scope="module")
def scattered(spark):
    rows = [("A|B", float(y), float(x), 0, str(i), 0, "gbif") for i, (x, y) in enumerate(points())]
    return spark.createDataFrame(rows, schemas.OCCURRENCE).cache()


def test_areas_against_brute_force(spark, scattered):
    """Single filter, broadcast match and shuffled match all agree with a plain loop."""
    wkts = {name: name if rings is None else wkt_of(rings) for name, rings in SHAPES.items()}
    selectors = selectors_frame(spark, [("", w, "") for w in wkts.values()])
    matches = {}
    for limit in (64 << 20, 0):
        rows = match_selectors(scattered, selectors, broadcast_limit=limit).groupBy("uuid").agg(F.collect_set("id").alias("ids"))
        matches[limit] = sorted(map(frozenset, (r.ids for r in rows.collect())), key=sorted)
    expected = []
    for name, rings in SHAPES.items():
        box = (-10, 10, -5, 5) if rings is None else None
        ids = frozenset(str(i) for i, (x, y) in enumerate(points()) if inside(x, y, rings, box))
        assert frozenset(r.id for r in filters.area_filter(scattered, wkts[name]).collect()) == ids, name
        expected.append(ids)
    assert sorted(expected, key=sorted) == matches[64 << 20] == matches[0]


def test_edges_of_a_polygon(spark):
    """Left and lower edges are inside, right and upper ones are not."""
    rows = [("A", y, x, 0, "i", 0, "s") for x, y in [(0.0, 1.0), (1.0, 0.0), (2.0, 1.0), (1.0, 2.0), (0.0, 0.0), (2.0, 2.0)]]
    frame = spark.createDataFrame(rows, schemas.OCCURRENCE)
    kept = filters.area_filter(frame, "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))").collect()
    assert [(r.lng, r.lat) for r in kept] == [(0.0, 1.0), (1.0, 0.0), (0.0, 0.0)]


def test_envelope_edges_date_line_and_off_the_map(spark):
    xs = [-180.0, -170.0, -169.9, 0.0, 170.0, 180.0, 190.0, float("nan"), None]
    frame = spark.createDataFrame([("A", 10.0, x, 0, "i", 0, "s") for x in xs], schemas.OCCURRENCE)
    wkt = "ENVELOPE(170,-170,10,-10)"
    kept = [r.lng for r in filters.area_filter(frame, wkt).collect()]
    assert kept == [-180.0, -170.0, 170.0, 180.0]
    matched = match_selectors(frame, selectors_frame(spark, [("", wkt, "")])).collect()
    assert sorted(r.lng for r in matched) == kept


def test_area_without_inside(spark, records):
    with pytest.raises(InvalidSelector, match="unsupported"):
        filters.area_filter(records, "POINT (1 2)")


def test_cells_of_many_edges_are_looked_up_at_their_sizes_only(spark):
    """Records look for rim cells of many edges at the sizes these have, not at those of all other cells."""
    rings = [star(40, 30.0, 25.0)]
    selectors = selectors_frame(spark, [("", wkt_of(rings), ""), ("", "ENVELOPE(-180,180,90,-90)", "")])
    index = selector_index(prepared(selectors))
    sizes = {r.level for r in index.keys.filter("size(edges) > 3").collect()}
    assert set(index.many_edges) == sizes and sizes and sizes < set(index.levels)
    points = [("A|B", y / 2, x / 2) for x in range(-64, 65, 5) for y in range(-64, 65, 5)]
    found = match_index(spark.createDataFrame(points, "taxon string, lat double, lng double"), index).collect()
    assert len(found) == len(points) + sum(inside(x, y, rings) for _, y, x in points)
