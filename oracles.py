"""The registered queries in SQL for DuckDB, over the same tables.

The areas are written out as boxes and edges here; no WKT is parsed, except for its form where
the validity of selectors is the question.
"""

from wildtally import derived

# Fixed value: the name space of selector identifiers.
NAMESPACE = "40d05094803d5bfab1e148975d2035fc"
DAY = 86400000

OCC = """occ AS (
  SELECT concat_ws('|', r_name, p_type, p_brand, p_name) AS taxon,
         CAST(l_orderkey % 181 - 90 AS DOUBLE) AS lat,
         CAST(l_partkey % 361 - 180 AS DOUBLE) AS lng,
         epoch_ms(o_orderdate) AS start,
         concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS id,
         epoch_ms(l_shipdate) AS added,
         CASE l_returnflag WHEN 'A' THEN 'gbif' WHEN 'N' THEN 'idigbio' ELSE 'inaturalist' END AS source,
         r_name, n_name, p_type, p_brand, p_name, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey)"""
COLUMNS = "taxon, lat, lng, start, id, added, source"

TRAITS = """traits AS (
  SELECT DISTINCT p_name AS taxon, 'nameLength' AS trait, CAST(length(p_name) AS DOUBLE) AS value FROM part
  UNION ALL
  SELECT DISTINCT p_name, 'longName', CAST(NULL AS DOUBLE) FROM part WHERE length(p_name) > 9)"""

# The trait selectors in use, as conditions on the traits.
TRAIT_CONDITIONS = {
    "longName": "trait = 'longName'",
    "nameLength <= 8|nameLength > 10": "trait = 'nameLength' AND (value <= 8 OR value > 10)",
    "nameLength > 8": "trait = 'nameLength' AND value > 8",
}
QUALIFIED = "qualified AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS t, list(DISTINCT taxon) AS taxa FROM traits WHERE {c}" for t, c in TRAIT_CONDITIONS.items()
) + ")"


def edges_of(*rings):
    """Rings of points as a list of edges."""
    pairs = [(p, q) for ring in rings for p, q in zip(ring, ring[1:])]
    return "[" + ", ".join(
        f"{{'x1': CAST({a} AS DOUBLE), 'y1': CAST({b} AS DOUBLE), 'x2': CAST({c} AS DOUBLE), 'y2': CAST({d} AS DOUBLE)}}"
        for (a, b), (c, d) in pairs
    ) + "]"


NO_EDGES = "CAST([] AS STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[])"

TRIANGLE = [(-72.5, -40.5), (-12.25, 63.5), (69.5, 3.25), (-72.5, -40.5)]
OUTER = [(-100.5, -50.5), (100.5, -50.5), (100.5, 50.5), (-100.5, 50.5), (-100.5, -50.5)]
HOLE = [(-30.5, -20.5), (30.5, -20.5), (0.5, 40.5), (-30.5, -20.5)]
PARTS = (
    [(10.5, 10.5), (14.5, 10.5), (14.5, 16.5), (10.5, 10.5)],
    [(-14.5, 1.5), (-9.5, 1.5), (-9.5, 6.5), (-14.5, 1.5)],
)
SMALL = [(-2.5, -0.5), (4.25, 8.5), (9.5, 3.25), (-2.5, -0.5)]

SCATTERED = (
    [(-90.5, 0.5), (-88.5, 0.5), (-88.5, 2.5), (-90.5, 0.5)],
    [(89.5, 0.5), (91.5, 0.5), (91.5, 2.5), (89.5, 0.5)],
)

# x0, x1, y0, y1 and edges of the literal selectors, by their WKT.
SHAPES = {
    "ENVELOPE(-150,-50,40,10)": ((-150, -50, 10, 40), NO_EDGES),
    "ENVELOPE(-180,180,90,-90)": ((-180, 180, -90, 90), NO_EDGES),
    "ENVELOPE(-20.5,30.5,20.5,-10.5)": ((-20.5, 30.5, -10.5, 20.5), NO_EDGES),
    derived.CASES[3][1]: ((-72.5, 69.5, -40.5, 63.5), edges_of(TRIANGLE)),
    derived.CASES[4][1]: ((-100.5, 100.5, -50.5, 50.5), edges_of(OUTER, HOLE)),
    derived.CASES[5][1]: ((-14.5, 14.5, 1.5, 16.5), edges_of(*PARTS)),
    "ENVELOPE(170,-170,10,-10)": ((170, -170, -10, 10), NO_EDGES),
    "ENVELOPE(-60,60,30,-30)": ((-60, 60, -30, 30), NO_EDGES),
    "ENVELOPE(-90,90,60,-60)": ((-90, 90, -60, 60), NO_EDGES),
    "ENVELOPE(-90,-75,30,20)": ((-90, -75, 20, 30), NO_EDGES),
    derived.SAVED[1][1]: ((-2.5, 9.5, -0.5, 8.5), edges_of(SMALL)),
    "ENVELOPE(178,-178,4,-4)": ((178, -178, -4, 4), NO_EDGES),
    "ENVELOPE(-10,0,10,0)": ((-10, 0, 0, 10), NO_EDGES),
    derived.RIM_WKT: ((-124, 124, -62, 62), edges_of(derived.RIM)),
    "ENVELOPE(-180,180,1,0)": ((-180, 180, 0, 1), NO_EDGES),
    "ENVELOPE(0,160,1,0)": ((0, 160, 0, 1), NO_EDGES),
    derived.THIN[2][1]: ((-90.5, 91.5, 0.5, 2.5), edges_of(*SCATTERED)),
    "ENVELOPE(20,-20,-30,-31)": ((20, -20, -31, -30), NO_EDGES),
}


def inside(o="", s=""):
    """Is (lng, lat) in the box x0..x1, y0..y1 and inside the edges?"""
    lng, lat = f"{o}lng", f"{o}lat"
    crossed = (
        f"len(list_filter({s}edges, lambda e: ((e.y1 > {lat}) <> (e.y2 > {lat})) AND "
        f"{lng} < (e.x2 - e.x1) * ({lat} - e.y1) / (e.y2 - e.y1) + e.x1))"
    )
    return (
        f"{lat} BETWEEN {s}y0 AND {s}y1 AND CASE WHEN {s}x0 <= {s}x1 THEN {lng} BETWEEN {s}x0 AND {s}x1 "
        f"ELSE {lng} >= {s}x0 OR {lng} <= {s}x1 END AND (len({s}edges) = 0 OR {crossed} % 2 = 1)"
    )


def text(value):
    return "'" + value.replace("'", "''") + "'"


def shape_row(wkt):
    (x0, x1, y0, y1), edges = SHAPES[wkt]
    return f"CAST({x0} AS DOUBLE) AS x0, CAST({x1} AS DOUBLE) AS x1, CAST({y0} AS DOUBLE) AS y0, CAST({y1} AS DOUBLE) AS y1, {edges} AS edges"


def uuid_of(taxa, wkt, traits):
    def encoded(c):
        return f"replace(replace(replace(url_encode({c}), '%20', '+'), '%2A', '*'), '~', '%7E')"

    name = f"concat('taxonSelector=', {encoded(taxa)}, '&wktString=', {encoded(wkt)}, '&traitSelector=', {encoded(traits)})"
    h = f"sha1(from_hex('{NAMESPACE}') || encode({name}))"
    variant = f"substr('89ab', (strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1, 1)"
    return (
        f"concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-5', substr({h}, 14, 3), '-', {variant}, "
        f"substr({h}, 18, 3), '-', substr({h}, 21, 12))"
    )


def literal_selectors(selectors):
    rows = [
        f"SELECT {text(t.replace(',', '|'))} AS taxonSelector, {text(w)} AS wktString, "
        f"{text(r.replace(',', '|'))} AS traitSelector, {shape_row(w)}"
        for t, w, r in selectors
    ]
    return " UNION ALL ".join(rows)


VALID_CASES = [c for c in derived.CASES if c[0] != "Brand#2" and not c[1].startswith("DUCK")]


def _d(whole, fraction):
    return f"CAST(concat(CAST({whole} AS VARCHAR), '{fraction}') AS DOUBLE)"


SUPPLIERS = f"""keyed AS (
  SELECT s_suppkey AS k, r_name, s_suppkey * 37 % 330 - 180 AS x, s_suppkey * 53 % 160 - 90 AS y
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cornered AS (
  SELECT *, {_d('x', '.5')} AS ax, {_d('y', '.25')} AS ay, {_d('x + 29', '.5')} AS bx, {_d('y + 5', '.25')} AS byy,
         {_d('x + 11', '.5')} AS cx, {_d('y + 23', '.25')} AS cy FROM keyed),
suppliers AS (
  SELECT CASE k % 4 WHEN 0 THEN r_name WHEN 1 THEN r_name || '|PROMO' WHEN 2 THEN 'STANDARD' ELSE '' END AS taxonSelector,
         CASE WHEN k % 5 = 0 THEN concat('POLYGON ((', x, '.5 ', y, '.25, ', x + 29, '.5 ', y + 5, '.25, ',
                                         x + 11, '.5 ', y + 23, '.25, ', x, '.5 ', y, '.25))')
              ELSE concat('ENVELOPE(', x, ',', x + 4 + k % 20, ',', y + 3 + k % 11, ',', y, ')') END AS wktString,
         CASE WHEN k % 6 = 0 THEN 'nameLength > 8' ELSE '' END AS traitSelector,
         CASE WHEN k % 5 = 0 THEN least(ax, bx, cx) ELSE x END AS x0,
         CASE WHEN k % 5 = 0 THEN greatest(ax, bx, cx) ELSE x + 4 + k % 20 END AS x1,
         CASE WHEN k % 5 = 0 THEN least(ay, byy, cy) ELSE y END AS y0,
         CASE WHEN k % 5 = 0 THEN greatest(ay, byy, cy) ELSE y + 3 + k % 11 END AS y1,
         CASE WHEN k % 5 = 0 THEN {edges_of([('ax', 'ay'), ('bx', 'byy'), ('cx', 'cy'), ('ax', 'ay')])} ELSE {NO_EDGES} END AS edges
  FROM cornered)"""
ALL_ROWS = "SELECT DISTINCT * FROM suppliers WHERE x0 >= -180 AND x1 <= 180 AND y0 >= -90 AND y1 <= 90 UNION ALL "
MATCH = f"""FROM occ o JOIN sel s ON {inside('o.', 's.')}
  AND (s.taxonSelector = '' OR list_has_any(string_split(o.taxon, '|'), string_split(s.taxonSelector, '|')))
  LEFT JOIN qualified q ON q.t = s.traitSelector
WHERE s.traitSelector = '' OR list_has_any(string_split(o.taxon, '|'), q.taxa)"""


def matching(select, selectors=None, tail=""):
    """All occurrences matched with the suppliers' selectors and the cases, or with the given ones."""
    rows = literal_selectors(selectors or VALID_CASES)
    parts = [OCC, TRAITS, QUALIFIED]
    if selectors is None:
        parts.append(SUPPLIERS)
        rows = ALL_ROWS + rows
    parts.append(f"sel AS (SELECT *, {uuid_of('taxonSelector', 'wktString', 'traitSelector')} AS uuid FROM ({rows}))")
    parts.append(f"matched AS (SELECT o.{COLUMNS.replace(', ', ', o.')}, s.uuid {MATCH})")
    return f"WITH {', '.join(parts)} {select} {tail}"


def of_occ(select, where="true", tail=""):
    return f"WITH {OCC} SELECT {select} FROM occ WHERE {where} {tail}"


def area(wkt):
    return f"WITH {OCC}, shape AS (SELECT {shape_row(wkt)}) SELECT {COLUMNS} FROM occ, shape WHERE {inside()}"


def selected(select, selector, tail="", where="true"):
    """The records of one selector."""
    return matching(f"SELECT {select} FROM matched WHERE {where}", [selector], tail)


def with_trait(t):
    return (
        f"WITH {OCC}, {TRAITS}, {QUALIFIED} SELECT {COLUMNS} FROM occ, qualified "
        f"WHERE t = {text(t)} AND list_has_any(string_split(taxon, '|'), taxa)"
    )


# Numbers as the other side writes them: 0.0, 0.25, ...
HOT_TRAIT = f"""WITH {OCC}, {TRAITS}, wanted AS (
  SELECT DISTINCT '' AS taxa, concat('ENVELOPE(', k * 37 % 300 - 180, ',', k * 37 % 300 - 177, ',40,0)') AS wkt,
    CASE WHEN k % 3 = 0 THEN concat('nameLength = ', k % 23) ELSE concat('nameLength > ', CAST(k % 97 / 4 AS DOUBLE)) END AS trait,
    k * 37 % 300 - 180 AS x, k % 3 = 0 AS equal, CASE WHEN k % 3 = 0 THEN k % 23 ELSE k % 97 / 4 END AS number
  FROM (SELECT s_suppkey AS k FROM supplier)
), sized AS (SELECT taxon AS name, value FROM traits WHERE trait = 'nameLength'),
named AS (SELECT *, {uuid_of('taxa', 'wkt', 'trait')} AS uuid FROM wanted)
SELECT o.{COLUMNS.replace(', ', ', o.')}, s.uuid FROM occ o JOIN named s ON o.lat BETWEEN 0 AND 40 AND o.lng BETWEEN s.x AND s.x + 3
WHERE EXISTS (SELECT 1 FROM sized t WHERE list_contains(string_split(o.taxon, '|'), t.name)
  AND CASE WHEN s.equal THEN t.value = s.number ELSE t.value > s.number END)"""

AFTER = f"added // {DAY} * {DAY} > epoch_ms(TIMESTAMP '1997-01-01')"
BEFORE = f"added // {DAY} * {DAY} < epoch_ms(TIMESTAMP '1997-02-01 12:00:00')"
TO_2000 = f"{AFTER} AND added // {DAY} * {DAY} < epoch_ms(TIMESTAMP '2000-01-01')"

FLAGSHIP = derived.CASES[0]
SAVED = derived.SAVED[0]
ISO = "%Y-%m-%dT%H:%M:%S.%gZ"


def iso(c):
    return f"strftime(make_timestamp({c} * 1000), '{ISO}')"


def url(source, key):
    quoted = key
    for char, code in [("%", "%25"), (" ", "%20"), ("{", "%7B"), ("}", "%7D")]:
        quoted = f"replace({quoted}, '{char}', '{code}')"
    return (
        f"CASE {source} WHEN 'gbif' THEN concat('http://www.gbif.org/occurrence/search?OCCURRENCE_ID=', {quoted}) "
        f"WHEN 'idigbio' THEN concat('http://portal.idigbio.org/search?rq=%7B%22occurrenceid%22:%22', {quoted}, '%22%7D') END"
    )


CHECKLIST = "taxon AS taxonPath, count(*) AS recordCount"
TOP = "GROUP BY taxon ORDER BY recordCount DESC, taxonPath LIMIT 20"
LAST = "string_split(taxon, '|')[-1]"
TSV = (
    f"concat_ws(chr(9), {LAST}, taxon, lat, lng, {iso('start')}, id, {iso('added')}, source, "
    f"coalesce({url('source', 'id')}, '')) AS line"
)
END = f"{COLUMNS}, start AS \"end\""
ORDER = "ORDER BY added, source, id, taxon, lat, lng, start LIMIT"
TSV_HEADER = "taxonName taxonPath lat lng eventStartDate occurrenceId firstAddedDate source occurrenceUrl"


def header(names):
    return "'" + names.replace(" ", "' || chr(9) || '") + "'"


def json_selector(selector):
    t, w, r = (s.replace(",", "|") if i != 1 else s for i, s in enumerate(selector))
    uuid = uuid_of(text(t), text(w), text(r))
    return f"""'{{"uuid":"' || {uuid} || '","taxonSelector":"{t}","wktString":"{w}","traitSelector":"{r}"}}'"""


MONITOR_ROWS = """SELECT s.uuid, s.taxonSelector, s.wktString, s.traitSelector, 'ready' AS status, count(m.uuid) AS recordCount
FROM sel s LEFT JOIN matched m ON s.uuid = m.uuid GROUP BY ALL"""
MONITORS = matching(MONITOR_ROWS, derived.SAVED)

ENDS = "['', '|', '| ', '||', ' '][CAST((lat % 5 + 5) AS INTEGER) % 5 + 1]"
ODD = "CASE WHEN lat > 0 THEN id || ' {%,}é' ELSE id END"
DATE_TEXT = (
    "CASE WHEN lat > 0 THEN strftime(make_timestamp(added * 1000), '%Y-%m-%d') "
    "ELSE strftime(make_timestamp(added * 1000), '%Y-%m-%d') || 'T06:30:00.250+02:00' END"
)
MILLIS = "start - CAST(lat * 100000000007 AS BIGINT)"

SQUARE = (
    "concat('POLYGON ((', x, '.5 ', y, '.25, ', x + 9, '.5 ', y, '.25, ', x + 9, '.5 ', y + 7, '.5, ', x, '.5 ', y, '.25))')"
)
IN_WORLD = " AND ".join(
    f"{_d(v, f)} BETWEEN {-lim} AND {lim}"
    for v, f, lim in [("x", ".5", 180), ("x + 9", ".5", 180), ("y", ".25", 90), ("y + 7", ".5", 90)]
)
VARIED = f"""keys AS (SELECT *, p_partkey AS key, p_partkey * 37 % 380 - 190 AS x, p_partkey * 53 % 190 - 95 AS y FROM part),
varied AS (
  SELECT key,
    CASE key % 4 WHEN 0 THEN p_type || ',' || p_name WHEN 1 THEN p_type || '|' || p_brand
                 WHEN 2 THEN ' *~+' || p_name || 'é' ELSE '' END AS taxonSelector,
    CASE key % 7 WHEN 0 THEN concat('ENVELOPE(', x, ',', x + 11, ',', y + 7, ',', y, ')')
                 WHEN 1 THEN concat(' envelope ( ', x, '.5, ', x + 11, ', ', y - 7, ', ', y, ' ) ')
                 WHEN 2 THEN {SQUARE}
                 WHEN 3 THEN replace({SQUARE}, '.5 ', '.75 ')
                 WHEN 4 THEN 'DUCK' || substr({SQUARE}, 8)
                 WHEN 5 THEN concat('POINT (', x, ' ', y, ')')
                 ELSE replace({SQUARE}, '))', ', 1 1))') END AS wktString,
    p_name || ',longName' AS traitSelector,
    CASE key % 9 WHEN 0 THEN printf('%08X-0000-5000-8000-00000000ABCD', key)
                 WHEN 1 THEN substr(printf('%08X-0000-5000-8000-00000000ABCD', key), 1, 35) END AS givenUuid,
    key % 4 <> 1 AND key % 4 <> 2 AS validTaxa,
    CASE key % 7 WHEN 0 THEN x >= -180 AND x + 11 <= 180 AND y >= -90 AND y + 7 <= 90
                 WHEN 2 THEN {IN_WORLD}
                 WHEN 3 THEN {IN_WORLD.replace("'.5')", "'.75')", 2)}
                 WHEN 5 THEN x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90
                 ELSE false END AS validWkt
  FROM keys)"""
NORM_T, NORM_R = "replace(taxonSelector, ',', '|')", "replace(traitSelector, ',', '|')"
PATH = "concat('u0=', substr(u, 1, 2), '/u1=', substr(u, 3, 2), '/u2=', substr(u, 5, 2), '/uuid=', u)"


def varied(select):
    return f"WITH {VARIED} SELECT key, {select} FROM varied"


def corner(x, y):
    return f"CAST({x} AS VARCHAR) || ' ' || CAST({y} AS VARCHAR)"


BOX = ", ".join(
    corner(x, y)
    for x, y in [
        ("lng + 3.0::DOUBLE", "lat + 1.5::DOUBLE"),
        ("lng + 3.0::DOUBLE", "lat - 2.25::DOUBLE"),
        ("lng - 0.5::DOUBLE", "lat - 2.25::DOUBLE"),
        ("lng - 0.5::DOUBLE", "lat + 1.5::DOUBLE"),
        ("lng + 3.0::DOUBLE", "lat + 1.5::DOUBLE"),
    ]
)

CASE_STATUS = """SELECT w.taxonSelector, w.wktString, w.traitSelector, w.uuid, {columns}
FROM (SELECT *, {uuid} AS uuid FROM wanted) w LEFT JOIN ({saved}) m ON w.uuid = m.uuid"""


def status_query(columns, saved, selectors=derived.SAVED):
    wanted = " UNION ALL ".join(
        f"SELECT {text(t)} AS taxonSelector, {text(w)} AS wktString, {text(r)} AS traitSelector" for t, w, r in derived.CASES
    )
    uuid = uuid_of(NORM_T, "wktString", NORM_R)
    select = CASE_STATUS.format(columns=columns, uuid=uuid, saved=saved)
    base = matching(select, selectors)
    extra = f"{SUPPLIERS}, wanted AS (SELECT taxonSelector, wktString, traitSelector FROM suppliers UNION ALL {wanted}), "
    return base.replace("WITH ", f"WITH {extra}", 1)


ORACLES = {
    "occurrence_scan": of_occ(END),
    "taxon_filter": of_occ(COLUMNS, "list_has_any(string_split(taxon, '|'), ['ASIA', 'PROMO'])"),
    "envelope_filter": of_occ(COLUMNS, "lng BETWEEN -150 AND -50 AND lat BETWEEN 10 AND 40"),
    "polygon_filter": area(derived.CASES[3][1]),
    "polygon_hole_filter": area(derived.CASES[4][1]),
    "multipolygon_filter": area(derived.CASES[5][1]),
    "many_edges_filter": area(derived.RIM_WKT),
    "date_line_filter": of_occ(COLUMNS, "(lng >= 170 OR lng <= -170) AND lat BETWEEN -10 AND 10"),
    "trait_presence_filter": with_trait("longName"),
    "trait_value_filter": with_trait("nameLength <= 8|nameLength > 10"),
    "source_filter": of_occ(COLUMNS, "source = 'idigbio'"),
    "added_after": of_occ(COLUMNS, AFTER),
    "added_before": of_occ(COLUMNS, BEFORE),
    "added_between": of_occ(COLUMNS, f"{AFTER} AND {BEFORE}"),
    "added_unbounded": of_occ(COLUMNS),
    "archive_union": of_occ(
        "CASE WHEN source <> 'inaturalist' THEN taxon END AS taxon, lat, lng, start, id, added, source"
    ),
    "merged_archive_input": of_occ(COLUMNS),
    "trait_csv_input": f"WITH {TRAITS} SELECT * FROM traits",
    "taxon_names": of_occ(
        f"id, taxon || {ENDS} AS taxonPath, "
        f"CASE WHEN {ENDS} = ' ' THEN p_name || ' ' ELSE p_name END AS taxonName, "
        f"CASE WHEN {ENDS} = '| ' THEN '' ELSE p_name END AS lastTaxon"
    ),
    "occurrence_urls": of_occ(f"{ODD} AS id, source, {url('source', f'({ODD})')} AS occurrenceUrl"),
    "iso_dates": of_occ(f"id, {MILLIS} AS millis, {iso(f'({MILLIS})')} AS iso"),
    "parsed_dates": of_occ(
        f"id, {DATE_TEXT} AS text, added // {DAY} * {DAY} + CASE WHEN lat > 0 THEN 0 ELSE 16200250 END AS millis"
    ),
    "days_added": of_occ(
        "id, " + ", ".join(f"strftime(make_timestamp(added * 1000), '%{c}') AS {n}" for c, n in [("Y", "y"), ("m", "m"), ("d", "d")])
    ),
    "normalized_selectors": varied(f"{NORM_T} AS taxonSelector, wktString, {NORM_R} AS traitSelector"),
    "selector_uuid": varied(f"{uuid_of('taxonSelector', 'wktString', 'traitSelector')} AS uuid"),
    "selector_path": f"WITH {VARIED}, named AS (SELECT key, {uuid_of('taxonSelector', 'wktString', 'traitSelector')} AS u FROM varied) "
    f"SELECT key, {PATH} AS path FROM named",
    "selector_pick": varied(
        f"CASE WHEN givenUuid IS NULL THEN {uuid_of(NORM_T, 'wktString', NORM_R)} "
        "WHEN length(givenUuid) = 36 THEN lower(givenUuid) END AS uuid"
    ),
    "selector_statuses": f"WITH {VARIED} SELECT {uuid_of(NORM_T, 'wktString', NORM_R)} AS uuid, taxonSelector, wktString, traitSelector, "
    "CASE WHEN NOT validTaxa THEN 'invalid taxon list' WHEN NOT validWkt THEN 'invalid area' "
    "WHEN key % 7 = 5 THEN 'unsupported area' ELSE 'ready' END AS status FROM varied",
    "selector_valid": varied("validTaxa, validTaxa AND validWkt AS valid"),
    "rank_path": of_occ("id, concat_ws('|', r_name, n_name, p_type, p_brand, p_name) AS taxonPath"),
    "bbox_polygon": of_occ(f"id, concat('POLYGON((', concat_ws(',', {BOX}), '))') AS wkt"),
    "generate_checklist": selected(CHECKLIST, FLAGSHIP, "GROUP BY taxon"),
    "checklist_topk": selected(CHECKLIST, FLAGSHIP, TOP),
    "large_limit": of_occ(COLUMNS, tail=f"{ORDER} (SELECT greatest(count(*) // 2, 10001) FROM occ)"),
    "generate_occurrences": selected(COLUMNS, derived.CASES[9]),
    "generate_in_polygon": selected(COLUMNS, derived.CASES[4]),
    "first_added": of_occ("source, id, min(added) AS added", tail="GROUP BY source, id"),
    "first_record": of_occ(
        COLUMNS, tail="QUALIFY row_number() OVER (PARTITION BY source, id ORDER BY added, taxon, lat, lng, start) = 1"
    ),
    "search": of_occ(
        "concat_ws('|', r_name, n_name, p_type, p_brand, p_name) AS taxonPath, lat, lng",
        "l_linenumber <> 7 AND p_type = 'PROMO' AND lat BETWEEN 10 AND 40 AND lng BETWEEN -150 AND -50",
    ),
    "match_all_selectors": matching("SELECT * FROM matched"),
    "match_by_shuffle": matching("SELECT * FROM matched"),
    "match_thin_areas": matching("SELECT * FROM matched", derived.THIN),
    "match_hot_trait": HOT_TRAIT,
    "generate_checklists": matching("SELECT uuid, taxon AS taxonPath, count(*) AS recordCount FROM matched GROUP BY ALL"),
    "monitor_summary": matching(f"SELECT * EXCLUDE recordCount, recordCount AS itemCount FROM ({MONITOR_ROWS})"),
    "refresh_all": MONITORS,
    "stream_refresh": MONITORS,
    "refresh_after_stream": MONITORS,
    "compact_loads": selected(END, SAVED),
    "monitors": MONITORS,
    "save_one_selector": selected(END, SAVED),
    "save_one_checklist": selected(f"{LAST} AS taxonName, {CHECKLIST}", derived.CASES[4], "GROUP BY taxon"),
    "monitor_of": matching(MONITOR_ROWS, [derived.SAVED[1]]),
    "monitors_of": status_query("m.status, m.recordCount", MONITOR_ROWS),
    "status_of": matching(f"SELECT status FROM ({MONITOR_ROWS})", [SAVED]),
    "checklists_status": status_query(
        "m.status", "SELECT DISTINCT uuid, 'ready' AS status FROM matched", VALID_CASES
    ),
    "saved_checklist": selected(CHECKLIST, FLAGSHIP, "GROUP BY taxon"),
    "checklist": selected(CHECKLIST, FLAGSHIP, TOP),
    "checklist_tsv": selected(f"concat_ws(chr(9), {LAST}, taxon, count(*)) AS line", FLAGSHIP, "GROUP BY taxon"),
    "checklist_tsv_file": selected(f"concat_ws(chr(9), {LAST}, taxon, count(*)) AS line", FLAGSHIP, "GROUP BY taxon")
    + f" UNION ALL SELECT {header('taxonName taxonPath recordCount')}",
    "checklist_json": matching(
        f"SELECT '{{\"selector\":' || {json_selector(FLAGSHIP)} || ',\"status\":\"ready\",\"items\":[' || "
        "string_agg('{\"taxon\":\"' || taxonPath || '\",\"recordcount\":' || recordCount || '}', ',' "
        "ORDER BY recordCount DESC, taxonPath) || ']}' AS json "
        f"FROM (SELECT {CHECKLIST} FROM matched {TOP})",
        [FLAGSHIP],
    ),
    "occurrences": selected(END, SAVED, f"{ORDER} 20", TO_2000),
    "saved_occurrences": selected(END, derived.SAVED[4]),
    "occurrences_tsv": selected(TSV, SAVED, where=AFTER),
    "occurrences_tsv_file": selected(TSV, SAVED) + f" UNION ALL SELECT {header(TSV_HEADER)}",
    "occurrences_json": matching(
        f"SELECT '{{\"selector\":' || {json_selector(SAVED)} || ',\"status\":\"ready\",\"items\":[' || coalesce("
        "string_agg(concat('{\"taxon\":\"', taxon, '\",\"lat\":', lat, ',\"lng\":', lng, ',\"start\":', start, ',\"end\":', start, "
        "',\"id\":\"', id, '\",\"added\":', added, ',\"source\":\"', source, '\"}'), ',' "
        "ORDER BY added, source, id, taxon, lat, lng, start), '') || ']}' AS json "
        f"FROM (SELECT * FROM matched WHERE {BEFORE} {ORDER} 20)",
        [SAVED],
    ),
    "monitors_json": matching(
        "SELECT concat('{\"selector\":{\"uuid\":\"', uuid, '\",\"taxonSelector\":\"', taxonSelector, '\",\"wktString\":\"', "
        "wktString, '\",\"traitSelector\":\"', traitSelector, '\"},\"status\":\"ready\",\"recordCount\":', recordCount, '}') AS json "
        f"FROM ({MONITOR_ROWS})",
        derived.SAVED,
    ),
    "monitored_occurrences": matching(
        "SELECT id AS occurrenceId, uuid AS monitorUUID FROM matched WHERE source = 'gbif'", derived.SAVED
    ),
    "monitored_tsv": matching(
        f"SELECT id || chr(9) || uuid AS line FROM matched WHERE source = 'idigbio' AND {AFTER} AND {BEFORE}", derived.SAVED
    ),
    "monitored_tsv_file": matching(
        "SELECT id || chr(9) || uuid AS line FROM matched WHERE source = 'inaturalist'", derived.SAVED
    )
    + f" UNION ALL SELECT {header('occurrenceId monitorUUID')}",
    "id_list_input": of_occ("id AS occurrenceId, CAST(NULL AS VARCHAR) AS monitorUUID, source"),
    "checklist_on_the_spot": selected(CHECKLIST, derived.CASES[9], "GROUP BY taxon"),
    "occurrences_on_the_spot": selected(END, derived.CASES[9], where=f"{AFTER} AND {BEFORE}"),
}
ORACLES["monitors_json_file"] = ORACLES["monitors_json"]
ORACLES["occurrences_tsv_plan"] = ORACLES["occurrences_tsv"]
ORACLES["occurrences_by_uuid"] = selected(END, SAVED)
ORACLES["occurrences_none"] = selected(END, SAVED, "LIMIT 0")
ORACLES["checklist_exists"] = selected("count(*) > 0 AS saved, false AS never", FLAGSHIP)
ORACLES["days_added_extremes"] = (
    f"WITH {OCC}, days AS (SELECT CASE (start // {DAY}) % 5 WHEN 0 THEN '9999-12-31' WHEN 2 THEN '0000-01-01' "
    "WHEN 4 THEN strftime(epoch_ms(added), '%Y-%m-%d') END AS day FROM occ) "
    "SELECT day[1:4] AS y, day[6:7] AS m, day[9:10] AS d, count(*) AS n FROM days WHERE day IS NOT NULL GROUP BY ALL"
)
