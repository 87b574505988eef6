"""Areas in WKT, as expressions over a column of WKT text.

The longer ones are SQL text: arguments are column names or SQL expressions.

Decisions, in one place:

* x is the longitude and y the latitude, in degrees, on a plane.
* ``ENVELOPE(minX, maxX, maxY, minY)`` includes its edges; with minX > maxX it crosses the
  date line.
* POLYGON and MULTIPOLYGON follow the even-odd rule over all rings. A ray runs from the point
  to larger x; an edge counts from its lower end up to, not including, its upper end. So points
  on left and lower edges are inside, points on right and upper edges are outside.
* Other shapes may be valid WKT but have no inside here: ``supported_area`` is false.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wildtally.functions.text import BLANK

_N = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_POINT = rf"{_N}(?:\s+{_N}){{1,3}}"


def _list(item: str) -> str:
    # Possessive, so that lists of many thousand points do not recurse in the regex engine.
    return rf"\(\s*{item}(?:\s*,\s*{item})*+\s*\)"


_RING = _list(_POINT)
_RINGS = _list(_RING)
_BODIES = {
    "POINT": rf"\(\s*{_POINT}\s*\)",
    "MULTIPOINT": _list(rf"(?:{_POINT}|\(\s*{_POINT}\s*\))"),
    "LINESTRING": _RING,
    "MULTILINESTRING": _RINGS,
    "POLYGON": _RINGS,
    "MULTIPOLYGON": _list(_RINGS),
    "ENVELOPE": rf"\(\s*{_N}\s*,\s*{_N}\s*,\s*{_N}\s*,\s*{_N}\s*\)",
}
_SHAPE = "(?:" + "|".join(rf"{k}\s*(?:EMPTY|{v})" for k, v in _BODIES.items()) + ")"
_WKT = rf"(?i)^\s*(?:{_SHAPE}|GEOMETRYCOLLECTION\s*(?:EMPTY|{_list(_SHAPE)})|BUFFER\s*\(\s*{_SHAPE}\s*,\s*{_N}\s*\))\s*\z"
_ENVELOPE = rf"(?i)^\s*ENVELOPE\s*{_BODIES['ENVELOPE']}\s*\z"
_POLYGON = rf"(?i)^\s*(?:POLYGON\s*{_BODIES['POLYGON']}|MULTIPOLYGON\s*{_BODIES['MULTIPOLYGON']})\s*\z"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for the value, worked out once however often the body uses it."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _numbers(text: str) -> str:
    return f"transform(regexp_extract_all({text}, r'{_N}', 0), n -> CAST(n AS DOUBLE))"


def _rings(wkt: str) -> str:
    """Point lists, as array<array<struct<x,y>>>: whatever stands between innermost brackets."""
    parts = rf"split(regexp_replace(p, r'^{BLANK}+|{BLANK}+\z', ''), r'\s+')"
    point = let(parts, "c", "named_struct('x', CAST(get(c, 0) AS DOUBLE), 'y', CAST(get(c, 1) AS DOUBLE))")
    return rf"transform(regexp_extract_all({wkt}, r'\(([^()]*)\)', 1), r -> transform(split(r, ','), p -> {point}))"


def _form(wkt: str) -> str:
    return (
        f"CASE WHEN {wkt} RLIKE r'{_ENVELOPE}' THEN 'envelope' WHEN {wkt} RLIKE r'{_POLYGON}' THEN 'polygon' "
        f"WHEN {wkt} RLIKE r'{_WKT}' THEN 'other' ELSE 'none' END"
    )


def _parsed(wkt: str) -> str:
    """Form, and the numbers of an envelope or the rings of another shape."""
    # The points of other shapes, without the numbers of envelopes and buffers in them.
    extra = rf"(?i)ENVELOPE\s*{_BODIES['ENVELOPE']}|^\s*BUFFER\s*\(|,\s*{_N}\s*\)\s*\z"
    points = f"regexp_replace({wkt}, r'{extra}', '')"
    rings = f"CASE form WHEN 'polygon' THEN {_rings(wkt)} WHEN 'other' THEN {_rings(points)} END"
    numbers = f"CASE WHEN form = 'envelope' THEN {_numbers(wkt)} END"
    return let(_form(wkt), "form", f"named_struct('form', form, 'numbers', {numbers}, 'rings', {rings})")


# Corners of an envelope, in their order in the text.
_X0, _X1, _Y1, _Y0 = (f"get(s.numbers, {i})" for i in range(4))
_VALID = f"""coalesce(CASE s.form
  WHEN 'envelope' THEN {_X0} BETWEEN -180 AND 180 AND {_X1} BETWEEN -180 AND 180
                       AND {_Y0} >= -90 AND {_Y1} <= 90 AND {_Y0} <= {_Y1}
  WHEN 'none' THEN false
  ELSE forall(flatten(s.rings), q -> q.x BETWEEN -180 AND 180 AND q.y BETWEEN -90 AND 90)
       AND (s.form = 'other' OR forall(s.rings, r -> size(r) >= 4 AND get(r, 0) = element_at(r, -1)))
  END, false)"""


def valid_wkt(wkt: str) -> Column:
    """Well-formed, within the world, and with closed rings of four points or more.

    Envelopes and distances inside other shapes are checked by their form only.
    """
    return F.expr(let(_parsed(f"coalesce({wkt}, '')"), "s", _VALID))


def _box(x0: str, x1: str, y0: str, y1: str) -> str:
    return f"named_struct('x0', {x0}, 'x1', {x1}, 'y0', {y0}, 'y1', {y1})"


def _ends(axis: str):
    values = f"transform(ps, q -> q.{axis})"
    return f"array_min({values})", f"array_max({values})"


_ENVELOPE_BOXES = f"""CASE WHEN {_X0} > {_X1}
  THEN array({_box(_X0, '180D', _Y0, _Y1)}, {_box('-180D', _X1, _Y0, _Y1)})
  ELSE array({_box(_X0, _X1, _Y0, _Y1)}) END"""
_POLYGON_BOXES = f"array({let('flatten(s.rings)', 'ps', _box(*_ends('x'), *_ends('y')))})"
_POLYGON_EDGES = """flatten(transform(s.rings, r ->
  zip_with(slice(r, 1, size(r) - 1), slice(r, 2, size(r) - 1), (a, b) ->
    named_struct('x1', a.x, 'y1', a.y, 'x2', b.x, 'y2', b.y))))"""


def area(wkt: str) -> Column:
    """struct<valid, supported, boxes, edges>.

    ``supported`` is an area that points can be inside of. ``boxes`` are its bounding box, or
    two across the date line; ``edges`` those of all rings, null for an envelope.
    """
    fields = f"""named_struct(
      'valid', valid,
      'supported', valid AND s.form IN ('envelope', 'polygon'),
      'boxes', CASE WHEN valid AND s.form = 'envelope' THEN {_ENVELOPE_BOXES}
                    WHEN valid AND s.form = 'polygon' THEN {_POLYGON_BOXES} END,
      'edges', CASE WHEN valid AND s.form = 'polygon' THEN {_POLYGON_EDGES} END)"""
    return F.expr(let(_parsed(f"coalesce({wkt}, '')"), "s", let(_VALID, "valid", fields)))


def supported_area(wkt: str) -> Column:
    return area(wkt)["supported"]


def corners(box: str) -> str:
    """A box as a list of its numbers, null for none."""
    return f"CASE WHEN {box} IS NOT NULL THEN array({box}.x0, {box}.x1, {box}.y0, {box}.y1) END"


def ends(edges: str) -> str:
    """Edges as a list of their numbers, four for each; null for none."""
    return f"flatten(transform({edges}, e -> array(e.x1, e.y1, e.x2, e.y2)))"


def in_corners(lat: str, lng: str, numbers: str) -> str:
    """Is the point in the box of these numbers, edges and all?"""
    return f"({lng} BETWEEN get({numbers}, 0) AND get({numbers}, 1) AND {lat} BETWEEN get({numbers}, 2) AND get({numbers}, 3))"


def crosses(lat: str, lng: str, x1, y1, x2, y2) -> str:
    """Does the ray from the point to larger x cross this edge?"""
    return f"((({y1}) > {lat}) != (({y2}) > {lat}) AND {lng} < (({x2}) - ({x1})) * ({lat} - ({y1})) / (({y2}) - ({y1})) + ({x1}))"


def sloped(edges: str) -> str:
    """A level edge never lies between two heights, so it is never crossed and can be left out."""
    return f"filter({edges}, e -> e.y1 != e.y2)"


def inside_edges(lat: str, lng: str, edges: str) -> str:
    """Even-odd rule: an odd number of (sloped) edges is crossed."""
    crossed = crosses(lat, lng, "e.x1", "e.y1", "e.x2", "e.y2")
    return f"aggregate({edges}, false, (odd, e) -> odd != {crossed})"


def inside_few_edges(lat: str, lng: str, numbers: str, most: int) -> str:
    """The same for the numbers of at most so many edges, written out: without a function of each edge it is compiled."""
    at = [[f"get({numbers}, {4 * i + j})" for j in range(4)] for i in range(most)]
    return reduce(lambda odd, ends: f"({odd} != coalesce({crosses(lat, lng, *ends)}, false))", at, "false")


def bbox_wkt(north: Column, east: Column, south: Column, west: Column) -> Column:
    """A bounding box as a POLYGON: NE, SE, SW, NW and NE again, longitude first."""
    corners = [(east, north), (east, south), (west, south), (west, north), (east, north)]
    points = [F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in corners]
    return F.concat(F.lit("POLYGON(("), F.concat_ws(",", *points), F.lit("))"))
