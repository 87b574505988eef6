"""Filters with literal arguments; all of them are plain column predicates."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wildtally.functions import cells, shapes
from wildtally.functions.dates import DAY_MILLIS, FIRST_MILLIS, LAST_MILLIS, parse_utc
from wildtally.functions.taxa import path_elements
from wildtally.functions.text import BLANK
from wildtally.operators.sizes import small_side
from wildtally.selector import InvalidSelector, Resolved, resolve
from wildtally.session import checkpoint

# Up to this many terms one regular expression beats a look at each path element.
_MANY_TERMS = 16
# Up to this many edges a polygon is written out as one compiled expression.
_MANY_EDGES = 128


def taxon_condition(taxon: Column, terms: list[str]) -> Column:
    """Any of the terms is an element of the taxon path, stripped, letter case as it is.

    No terms select everything. A term that holds a bar is no element of any path and selects nothing.
    """
    if not terms:
        return F.lit(True)
    terms = [t for t in terms if "|" not in t]
    if not terms:
        return F.lit(False)
    if len(terms) > _MANY_TERMS:
        return F.arrays_overlap(path_elements(taxon), F.array(*[F.lit(t) for t in terms]))
    listed = "|".join(_quoted(t) for t in terms)
    return taxon.rlike(rf"(?:^|\|){BLANK}*(?:{listed}){BLANK}*(?:\||\z)")


def _quoted(term: str) -> str:
    return re.sub(r"([^A-Za-z0-9 ])", r"\\\1", term)


def taxon_filter(occurrences: DataFrame, terms: list[str]) -> DataFrame:
    return occurrences.filter(taxon_condition(F.col("taxon"), terms))


def _number(value: float) -> str:
    return f"{float(value)!r}D"


def area_condition(boxes: list, edges: list, lat: str = "lat", lng: str = "lng") -> Column:
    """Inside one of the boxes and, for a polygon, inside its edges.

    The box comparisons are with plain numbers and reach the Parquet scan.
    """
    def span(name, box, axis):
        return f"{name} >= {_number(box[axis + '0'])} AND {name} <= {_number(box[axis + '1'])}"

    inside = " OR ".join(f"({span(lng, box, 'x')} AND {span(lat, box, 'y')})" for box in boxes) or "false"
    if not edges:
        return F.expr(inside)
    # Level edges are never crossed.
    corners = [[_number(e[k]) for k in ("x1", "y1", "x2", "y2")] for e in edges if e["y1"] != e["y2"]]
    if len(corners) > _MANY_EDGES:
        listed = ", ".join("named_struct('x1', {}, 'y1', {}, 'x2', {}, 'y2', {})".format(*c) for c in corners)
        return F.expr(f"({inside}) AND {shapes.inside_edges(lat, lng, f'array({listed})')}")
    if not corners:
        return F.lit(False)
    # Odd or even by pairs, so that the expression stays flat.
    crossed = [shapes.crosses(lat, lng, *c) for c in corners]
    while len(crossed) > 1:
        pairs = [f"({a} != {b})" for a, b in zip(crossed[::2], crossed[1::2])]
        crossed = pairs + crossed[len(pairs) * 2 :]
    return F.expr(f"({inside}) AND {crossed[0]}")


def area_filter(occurrences: DataFrame, wkt: str) -> DataFrame:
    return selector_area_filter(occurrences, resolve(occurrences.sparkSession, ("", wkt, "")))


def _within_cells(occurrences: DataFrame, selector: Resolved) -> DataFrame:
    """Inside a polygon of many edges: a join with its cells, where a point sees the edges that matter for its cell."""
    spark = occurrences.sparkSession
    area = spark.createDataFrame([(selector.selector.wktString,)], "wkt string").select(shapes.area("wkt").alias("a"))
    area = area.select("a.edges", F.explode("a.boxes").alias("box"))
    cover = area.select(F.explode_outer(F.expr(cells.cover("box", "edges"))).alias("c")).filter("c IS NOT NULL")
    sloped = shapes.sloped("c.edges")
    keys = checkpoint(cover.selectExpr("c.level AS level", "c.cell AS _cell", "c.whole AS _whole", f"CASE WHEN NOT c.whole THEN {sloped} END AS _edges"))
    levels = [row.level for row in keys.select("level").distinct().collect()]
    size = keys.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("_edges")), F.lit(0)).alias("edges")).first()
    keys = small_side(keys.drop("level"), size.n, 56 * size.edges)
    columns = occurrences.columns
    rows = occurrences.filter(area_condition(selector.boxes, []))
    rows = rows.select("*", F.explode(F.array(*[F.expr(cells.cell_of("lat", "lng", n)) for n in levels])).alias("_cell"))
    # The cells of a cover do not overlap, so a point is in one of them at most.
    return rows.join(keys, "_cell").filter(f"_whole OR {shapes.inside_edges('lat', 'lng', '_edges')}").select(*columns)


def selector_area_filter(occurrences: DataFrame, selector: Resolved) -> DataFrame:
    if not selector.supported:
        raise InvalidSelector(f"unsupported area: {selector.selector.wktString!r}")
    if selector.selector is not None and len(selector.edges) > _MANY_EDGES:
        return _within_cells(occurrences, selector)
    return occurrences.filter(area_condition(selector.boxes, selector.edges))


def added_partition_filter(rows: DataFrame, after: str | None = None, before: str | None = None) -> DataFrame:
    """Rows of the day partitions strictly between two times.

    A day counts by its midnight (UTC), so a bound at noon leaves out its own day when it is
    the lower one and keeps it when it is the upper one. Without bounds all rows are kept; with
    a bound, rows outside a day partition are dropped.
    """
    midnight = F.make_date(*[F.col(c).cast("int") for c in ("y", "m", "d")]).cast("timestamp")
    if after is not None:
        rows = rows.filter(midnight > parse_utc(F.lit(after)))
    if before is not None:
        rows = rows.filter(midnight < parse_utc(F.lit(before)))
    return rows


def added_filter(rows: DataFrame, after: str | None = None, before: str | None = None) -> DataFrame:
    """The same by the day of ``added``, for tables without day partitions.

    Written as a plain range of ``added`` with constant bounds, which reaches the Parquet scan. With a
    bound, times outside the years 0000 to 9999 are dropped, as they are in no day partition.
    """
    if after is not None or before is not None:
        rows = rows.filter((F.col("added") >= FIRST_MILLIS) & (F.col("added") <= LAST_MILLIS))
    if after is not None:
        day = F.floor(F.unix_millis(parse_utc(F.lit(after))) / DAY_MILLIS) + 1
        rows = rows.filter(F.col("added") >= day * DAY_MILLIS)
    if before is not None:
        day = F.ceil(F.unix_millis(parse_utc(F.lit(before))) / DAY_MILLIS)
        rows = rows.filter(F.col("added") < day * DAY_MILLIS)
    return rows


def source_filter(rows: DataFrame, source: str) -> DataFrame:
    return rows.filter(F.col("source") == source)


def without_spatial_issue(rows: DataFrame, flag: str = "hasSpatialIssue") -> DataFrame:
    return rows.filter(~F.coalesce(F.col(flag), F.lit(False)))
