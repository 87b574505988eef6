"""Occurrences, traits, ranks and selectors derived from the order tables in ``TESTDATA.md``."""

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wildtally.functions.taxa import rank_path
from wildtally.operators.sizes import measured
from wildtally.selector import selectors_frame
from wildtally.session import scratch_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _millis(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


# Rows of one task from the source tables, beyond four tasks per core.
_SPREAD_ROWS = 1_000_000


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The order tables joined: records are shuffled by order before they have any text, and places broadcast if small."""
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_shipdate")
    # The source is one file of one row group: without a spread all later work on it is one task.
    parts = max(4 * spark.sparkContext.defaultParallelism, -(-items.count() // _SPREAD_ROWS))
    items = items.filter("l_orderkey IS NOT NULL").repartition(parts, "l_orderkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    names = table(spark, folder, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    places = (
        table(spark, folder, "supplier")
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "n_name", "r_name")
    )
    return (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(measured(names, "p_name", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .join(measured(places, "n_name", "r_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    )


def _columns():
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    source = F.when(F.col("l_returnflag") == "A", "gbif").when(F.col("l_returnflag") == "N", "idigbio")
    return {
        "taxon": F.concat_ws("|", "r_name", "p_type", "p_brand", "p_name"),
        "lat": (F.col("l_orderkey") % 181 - 90).cast("double"),
        "lng": (F.col("l_partkey") % 361 - 180).cast("double"),
        "start": _millis("o_orderdate"),
        "id": key,
        "added": _millis("l_shipdate"),
        "source": source.otherwise("inaturalist"),
    }


_written: dict[tuple, str] = {}


def _once(spark: SparkSession, folder: str, name: str, rows) -> DataFrame:
    """Derived records as an archive: written by the first query of a session that needs them, by the tasks that join them."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _written:
        path = scratch_dir(spark, name)
        rows.write.parquet(path)
        _written[key] = path
    return spark.read.schema(rows.schema).parquet(_written[key])


def occurrences(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "archive", _ranked(spark, folder).select(*[c.alias(n) for n, c in _columns().items()]))


def ranked_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences with one column per rank (some absent) and a flag for spatial issues."""
    columns = _columns()
    issue = F.when(F.col("l_linenumber") == 7, True).when(F.col("l_linenumber") != 6, False)
    rows = _ranked(spark, folder).select(
        F.col("r_name").alias("kingdom"),
        F.col("n_name").alias("phylum"),
        F.col("p_type").alias("class"),
        F.col("p_brand").alias("order"),
        F.lit(None).cast("string").alias("family"),
        F.lit(None).cast("string").alias("genus"),
        F.col("p_name").alias("species"),
        columns["lat"].alias("decimalLatitude"),
        columns["lng"].alias("decimalLongitude"),
        columns["id"].alias("id"),
        issue.alias("hasSpatialIssue"),
    )
    return _once(spark, folder, "ranked", rows)


def traits(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "part").select(F.col("p_name").alias("taxon")).distinct()
    size = F.length("taxon")
    sized = names.select("taxon", F.lit("nameLength").alias("trait"), size.cast("double").alias("value"))
    long = names.filter(size > 9).select(
        "taxon", F.lit("longName").alias("trait"), F.lit(None).cast("double").alias("value")
    )
    return sized.unionByName(long)


# One selector per case.
CASES = [
    ("ASIA|PROMO", "ENVELOPE(-150,-50,40,10)", ""),
    ("PROMO", "ENVELOPE(-180,180,90,-90)", ""),
    ("", "ENVELOPE(-20.5,30.5,20.5,-10.5)", ""),
    ("EUROPE,ECONOMY", "POLYGON ((-72.5 -40.5, -12.25 63.5, 69.5 3.25, -72.5 -40.5))", ""),
    (
        "MIDDLE EAST",
        "POLYGON ((-100.5 -50.5, 100.5 -50.5, 100.5 50.5, -100.5 50.5, -100.5 -50.5), "
        "(-30.5 -20.5, 30.5 -20.5, 0.5 40.5, -30.5 -20.5))",
        "",
    ),
    (
        "",
        "MULTIPOLYGON (((10.5 10.5, 14.5 10.5, 14.5 16.5, 10.5 10.5)), ((-14.5 1.5, -9.5 1.5, -9.5 6.5, -14.5 1.5)))",
        "",
    ),
    ("AFRICA", "ENVELOPE(170,-170,10,-10)", ""),
    ("ATLANTIS", "ENVELOPE(-180,180,90,-90)", ""),
    ("", "ENVELOPE(-60,60,30,-30)", "longName"),
    ("AMERICA", "ENVELOPE(-90,90,60,-60)", "nameLength <= 8,nameLength > 10"),
    ("Brand#2", "ENVELOPE(-180,180,90,-90)", ""),
    ("ASIA", "DUCK(-150,-50,40,10)", ""),
]


# A few selectors of small areas, to save and read back.
SAVED = [
    ("ASIA|PROMO", "ENVELOPE(-90,-75,30,20)", ""),
    ("EUROPE,ECONOMY", "POLYGON ((-2.5 -0.5, 4.25 8.5, 9.5 3.25, -2.5 -0.5))", ""),
    ("", CASES[5][1], ""),
    ("AFRICA", "ENVELOPE(178,-178,4,-4)", ""),
    ("AMERICA", "ENVELOPE(-10,0,10,0)", "nameLength <= 8,nameLength > 10"),
    ("ATLANTIS", "ENVELOPE(-180,180,90,-90)", ""),
]


def _rim(points: int) -> list:
    """A closed ring around the origin with as many points, near and far in turn."""
    ring = []
    for i in range(points):
        radius, angle = (62 if i % 2 else 57), 2 * math.pi * i / points
        ring.append((round(radius * 2 * math.cos(angle), 4), round(radius * math.sin(angle), 4)))
    return [*ring, ring[0]]


RIM = _rim(1200)
RIM_WKT = "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in RIM) + "))"


# Areas that a cover with one cell size could only take in with the cell that is the world.
THIN = [
    ("", "ENVELOPE(-180,180,1,0)", ""),
    ("ASIA", "ENVELOPE(0,160,1,0)", ""),
    ("", "MULTIPOLYGON (((-90.5 0.5, -88.5 0.5, -88.5 2.5, -90.5 0.5)), ((89.5 0.5, 91.5 0.5, 91.5 2.5, 89.5 0.5)))", ""),
    ("PROMO", "ENVELOPE(20,-20,-30,-31)", ""),
]


def trait_selectors(spark: SparkSession, folder: str) -> DataFrame:
    """One selector per supplier, all for the same trait: longer than, or just as long as, some number of letters."""
    key = F.col("s_suppkey")
    number = (key % 97 / 4).cast("string")
    trait = F.when(key % 3 == 0, F.concat(F.lit("nameLength = "), (key % 23).cast("string"))).otherwise(F.concat(F.lit("nameLength > "), number))
    x = key * 37 % 300 - 180
    wkt = F.concat(F.lit("ENVELOPE("), F.concat_ws(",", x.cast("string"), (x + 3).cast("string"), F.lit("40"), F.lit("0")), F.lit(")"))
    return table(spark, folder, "supplier").select(F.lit("").alias("taxonSelector"), wkt.alias("wktString"), trait.alias("traitSelector"))


def saved_selectors(spark: SparkSession, folder: str) -> DataFrame:
    """The cases, and one selector for each supplier."""
    key = F.col("s_suppkey")
    x, y = key * 37 % 330 - 180, key * 53 % 160 - 90
    text = lambda c: c.cast("string")
    envelope = F.concat(
        F.lit("ENVELOPE("),
        F.concat_ws(",", text(x), text(x + 4 + key % 20), text(y + 3 + key % 11), text(y)),
        F.lit(")"),
    )
    corners = [(x, y), (x + 29, y + 5), (x + 11, y + 23), (x, y)]
    triangle = F.concat(
        F.lit("POLYGON (("),
        F.concat_ws(", ", *[F.concat(text(a), F.lit(".5 "), text(b), F.lit(".25")) for a, b in corners]),
        F.lit("))"),
    )
    region = F.col("r_name")
    per_supplier = (
        table(spark, folder, "supplier")
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.when(key % 4 == 0, region)
            .when(key % 4 == 1, F.concat(region, F.lit("|PROMO")))
            .when(key % 4 == 2, "STANDARD")
            .otherwise("")
            .alias("taxonSelector"),
            F.when(key % 5 == 0, triangle).otherwise(envelope).alias("wktString"),
            F.when(key % 6 == 0, "nameLength > 8").otherwise("").alias("traitSelector"),
        )
    )
    return selectors_frame(spark, CASES).unionByName(per_supplier)


def rank_paths(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_occurrences(spark, folder).select("id", rank_path().alias("taxonPath"))


def varied_selectors(spark: SparkSession, folder: str) -> DataFrame:
    """One selector per part, valid and not, some with a UUID of its own."""
    key = F.col("p_partkey")
    x, y = key * 37 % 380 - 190, key * 53 % 190 - 95
    square = F.format_string(
        "POLYGON ((%d.5 %d.25, %d.5 %d.25, %d.5 %d.5, %d.5 %d.25))", x, y, x + 9, y, x + 9, y + 7, x, y
    )
    taxa = (
        F.when(key % 4 == 0, F.concat("p_type", F.lit(","), "p_name"))
        .when(key % 4 == 1, F.concat("p_type", F.lit("|"), "p_brand"))
        .when(key % 4 == 2, F.concat(F.lit(" *~+"), "p_name", F.lit("\u00e9")))
        .otherwise("")
    )
    wkt = (
        F.when(key % 7 == 0, F.format_string("ENVELOPE(%d,%d,%d,%d)", x, x + 11, y + 7, y))
        .when(key % 7 == 1, F.format_string(" envelope ( %d.5, %d, %d, %d ) ", x, x + 11, y - 7, y))
        .when(key % 7 == 2, square)
        .when(key % 7 == 3, F.replace(square, F.lit(".5 "), F.lit(".75 ")))
        .when(key % 7 == 4, F.concat(F.lit("DUCK"), F.substring(square, 8, 1000)))
        .when(key % 7 == 5, F.format_string("POINT (%d %d)", x, y))
        .otherwise(F.replace(square, F.lit("))"), F.lit(", 1 1))")))
    )
    full = F.format_string("%08X-0000-5000-8000-00000000ABCD", key)
    given = F.when(key % 9 == 0, full).when(key % 9 == 1, F.substring(full, 1, 35))
    return table(spark, folder, "part").select(
        key.alias("key"),
        taxa.alias("taxonSelector"),
        wkt.alias("wktString"),
        F.concat("p_name", F.lit(",longName")).alias("traitSelector"),
        given.alias("givenUuid"),
    )
