"""A fixed hierarchy of square cells, used as join key between points and areas.

An area is covered from the world down: cells that lie inside it stay as large as they are, cells that its
rim passes through are cut into smaller ones as long as the whole cover has few cells. So the number of
cells is bounded whatever the shape, and thin or scattered areas have small cells where they are.

The number of cells there are is fixed (about 68,000 over all sizes), whatever the data. All functions give
SQL text; their arguments are column names or SQL expressions.
"""

from wildtally.functions import shapes

# Cell sizes in degrees, each a multiple of the one before; the last one takes in the whole world.
SIZES = [1, 4, 16, 64, 1024]
WORLD = len(SIZES) - 1
# Cells of one area (a box, or all rings of a polygon) at most; a polygon of more edges has one for each edge
# at most, so that a point in a rim cell sees few of them.
MAX_CELLS = 64
# Rounding never moves a point further than this from the cell it falls in.
_MARGIN = "0.000001D"


def _index(degrees: str, offset: int, size) -> str:
    return f"floor(({degrees} + {offset}) / {size})"


def _id(level, cx: str, cy: str) -> str:
    return f"CAST({cy} * 1000 + {cx} + {level} * 1000000 AS INT)"


def cell_of(lat: str, lng: str, level: int) -> str:
    """The cell of a point; null where a coordinate is null or off the map."""
    cell = _id(level, _index(lng, 180, SIZES[level]), _index(lat, 90, SIZES[level]))
    return f"CASE WHEN {lng} BETWEEN -180 AND 180 AND {lat} BETWEEN -90 AND 90 THEN {cell} END"


def _cell(level: int, cx: str, cy: str) -> str:
    size = SIZES[level]
    return f"""named_struct('level', {level}, 'cx', {cx}, 'cy', {cy}, 'cell', {_id(level, cx, cy)},
      'x0', {cx} * {size} - 180 - {_MARGIN}, 'x1', ({cx} + 1) * {size} - 180 + {_MARGIN},
      'y0', {cy} * {size} - 90 - {_MARGIN}, 'y1', ({cy} + 1) * {size} - 90 + {_MARGIN})"""


def _with(cell: str, whole: str, edges: str) -> str:
    fields = ", ".join(f"'{f}', {cell}.{f}" for f in ("level", "cx", "cy", "cell", "x0", "x1", "y0", "y1"))
    return f"named_struct({fields}, 'whole', {whole}, 'edges', {edges})"


def cover(box: str, edges: str) -> str:
    """The cells of a box, or of a polygon with these edges (null for a box): finer along the rim while they are few."""
    first = f"array({shapes.let(_cell(WORLD, '0L', '0L'), 'w', _with('w', 'false', edges))})"
    state, steps = f"named_struct('done', filter({first}, c -> false), 'open', {first})", []
    for level in range(WORLD, 0, -1):
        now = f"s{level}"
        steps.append((state, now))
        # Cells that were too many to be cut once stay as they are.
        few = f"forall({now}.open, c -> c.level = {level}) AND size({now}.done) + size(kids) <= greatest({MAX_CELLS}, coalesce(size({edges}), 0))"
        cut = f"named_struct('done', concat({now}.done, filter(kids, k -> k.whole)), 'open', filter(kids, k -> NOT k.whole))"
        state = shapes.let(_refined(f"{now}.open", box, level), "kids", f"CASE WHEN {few} THEN {cut} ELSE {now} END")
    covered = shapes.let(state, "s", "concat(s.done, s.open)")
    for value, name in reversed(steps):
        covered = shapes.let(value, name, covered)
    return covered


def _refined(cells: str, box: str, level: int) -> str:
    """The cells (of ``level``) cut into those of the next finer one that touch the area.

    Each has the edges that a ray from one of its points can cross, taken from those of the cell around it,
    so a rim of many edges is looked through once a level. Of a cell that no edge passes through, the
    middle tells whether it is inside.
    """
    size, ratio = SIZES[level - 1], SIZES[level] // SIZES[level - 1]

    def span(at: str, low: str, high: str, offset: int) -> str:
        first = f"greatest({at} * {ratio}, {_index(low, offset, size)})"
        return f"sequence({first}, greatest({first}, least({at} * {ratio} + {ratio - 1}, {_index(high, offset, size)})))"

    xs, ys = span("c.cx", f"{box}.x0", f"{box}.x1", 180), span("c.cy", f"{box}.y0", f"{box}.y1", 90)
    inside = shapes.inside_edges("(k.y0 + k.y1) / 2", "(k.x0 + k.x1) / 2", shapes.sloped("es"))
    whole = f"CASE WHEN es IS NULL THEN {within_box('k', box)} ELSE NOT hit END"
    judged = shapes.let(
        f"filter(c.edges, e -> {_beside('k')})",
        "es",
        shapes.let(
            f"exists(es, e -> {_through('k')})",
            "hit",
            f"CASE WHEN es IS NULL OR hit OR {inside} THEN {_with('k', whole, 'es')} END",
        ),
    )
    kids = f"transform({xs}, cx -> transform({ys}, cy -> {shapes.let(_cell(level - 1, 'cx', 'cy'), 'k', judged)}))"
    return f"filter(flatten(flatten(transform({cells}, c -> {kids}))), k -> k IS NOT NULL)"


def _beside(cell: str) -> str:
    """An edge at the height of the cell that does not end to the left of it."""
    return (
        f"least(e.y1, e.y2) <= {cell}.y1 AND greatest(e.y1, e.y2) >= {cell}.y0 AND greatest(e.x1, e.x2) >= {cell}.x0"
    )


def _through(cell: str) -> str:
    """Does an edge that is beside the cell pass through it? Not where all corners are on one side of its line."""
    corners = [f"(e.x2 - e.x1) * ({cell}.{y} - e.y1) - (e.y2 - e.y1) * ({cell}.{x} - e.x1)" for x in ("x0", "x1") for y in ("y0", "y1")]
    sides = ", ".join(corners)
    return f"least(e.x1, e.x2) <= {cell}.x1 AND least({sides}) <= 0 AND greatest({sides}) >= 0"


def within_box(cell: str, box: str) -> str:
    """Is the whole cell inside the box?"""
    return f"({box}.x0 <= {cell}.x0 AND {box}.x1 >= {cell}.x1 AND {box}.y0 <= {cell}.y0 AND {box}.y1 >= {cell}.y1)"
