"""Every query and operator by name, over the derived tables of a data folder."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wildtally import derived
from wildtally.functions import lines
from wildtally.functions import selectors as S
from wildtally.functions.dates import day_partitions, iso_millis, parse_utc
from wildtally.functions.links import occurrence_url
from wildtally.functions.shapes import bbox_wkt
from wildtally.functions.taxa import last_taxon, taxon_name
from wildtally.operators import aggregates, filters
from wildtally.operators.limits import first_rows
from wildtally.operators.matching import match_selectors, prepared
from wildtally.operators.traits import trait_filter
from wildtally.plans import generate
from wildtally.plans import queries as Q
from wildtally.selector import selectors_frame
from wildtally.session import prepare, scratch_dir
from wildtally.sources import inputs, sinks, tables
from wildtally.streaming.refresh import refresh_stream

TERMS = ["ASIA", "PROMO"]
FLAGSHIP = derived.CASES[0]
SAVED = derived.SAVED[0]
TRIANGLE = derived.CASES[3][1]
HOLE = derived.CASES[4][1]
TWO_PARTS = derived.CASES[5][1]
DATE_LINE = derived.CASES[6][1]
TRAITS = derived.CASES[9][2]
AFTER, BEFORE = "1997-01-01", "1997-02-01T12:00:00"

_registered = {}
_stores = {}


def query(function):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(prepare(spark), folder)

    _registered[function.__name__] = run
    return run


def queries():
    return dict(_registered)


def store(spark: SparkSession, folder: str) -> str:
    """A base folder with the results of a few selectors, made once per session and data folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _stores:
        base = scratch_dir(spark, "store")
        records, traits = derived.occurrences(spark, folder), derived.traits(spark, folder)
        generate.save_all_occurrences(records, selectors_frame(spark, derived.SAVED), base, traits)
        generate.save_checklists(records, selectors_frame(spark, derived.CASES), base, traits)
        _stores[key] = base
    return _stores[key]


def _records(spark, folder, selector=FLAGSHIP):
    return generate.select_occurrences(derived.occurrences(spark, folder), selector, derived.traits(spark, folder))


# Scans and filters


@query
def occurrence_scan(spark, folder):
    return tables.occurrence_rows(derived.occurrences(spark, folder))


@query
def taxon_filter(spark, folder):
    return filters.taxon_filter(derived.occurrences(spark, folder), TERMS)


@query
def envelope_filter(spark, folder):
    return filters.area_filter(derived.occurrences(spark, folder), FLAGSHIP[1])


@query
def polygon_filter(spark, folder):
    return filters.area_filter(derived.occurrences(spark, folder), TRIANGLE)


@query
def polygon_hole_filter(spark, folder):
    return filters.area_filter(derived.occurrences(spark, folder), HOLE)


@query
def multipolygon_filter(spark, folder):
    return filters.area_filter(derived.occurrences(spark, folder), TWO_PARTS)


@query
def many_edges_filter(spark, folder):
    return filters.area_filter(derived.occurrences(spark, folder), derived.RIM_WKT)


@query
def date_line_filter(spark, folder):
    return filters.area_filter(derived.occurrences(spark, folder), DATE_LINE)


@query
def trait_presence_filter(spark, folder):
    return trait_filter(derived.occurrences(spark, folder), derived.traits(spark, folder), "longName")


@query
def trait_value_filter(spark, folder):
    return trait_filter(derived.occurrences(spark, folder), derived.traits(spark, folder), TRAITS)


@query
def source_filter(spark, folder):
    return filters.source_filter(derived.occurrences(spark, folder), "idigbio")


@query
def added_after(spark, folder):
    return filters.added_filter(derived.occurrences(spark, folder), after=AFTER)


@query
def added_before(spark, folder):
    return filters.added_filter(derived.occurrences(spark, folder), before=BEFORE)


@query
def added_between(spark, folder):
    return filters.added_filter(derived.occurrences(spark, folder), AFTER, BEFORE)


@query
def added_unbounded(spark, folder):
    return filters.added_filter(derived.occurrences(spark, folder))


@query
def archive_union(spark, folder):
    records = derived.occurrences(spark, folder)
    archives = {name: filters.source_filter(records, name).drop("source") for name in ("gbif", "idigbio")}
    # One archive without taxa.
    archives["inaturalist"] = filters.source_filter(records, "inaturalist").drop("source", "taxon")
    return inputs.union_archives(archives)


@query
def merged_archive_input(spark, folder):
    path = scratch_dir(spark, "archive")
    derived.occurrences(spark, folder).write.parquet(path)
    return inputs.read_occurrences(spark, path)


@query
def trait_csv_input(spark, folder):
    path = scratch_dir(spark, "traits")
    derived.traits(spark, folder).write.option("header", True).csv(path)
    return inputs.read_traits(spark, f"{path}/*.csv")


# Column functions


@query
def taxon_names(spark, folder):
    records = derived.occurrences(spark, folder)
    # Paths with blank and empty ends, where the two rules differ.
    ends = F.element_at(F.array(*[F.lit(e) for e in ("", "|", "| ", "||", " ")]), (F.col("lat") % 5 + 5).cast("int") % 5 + 1)
    path = F.concat(F.col("taxon"), ends)
    return records.select(
        "id", path.alias("taxonPath"), taxon_name(path).alias("taxonName"), last_taxon(path).alias("lastTaxon")
    )


@query
def occurrence_urls(spark, folder):
    odd = F.concat(F.col("id"), F.lit(" {%,}é"))
    key = F.when(F.col("lat") > 0, odd).otherwise(F.col("id"))
    records = derived.occurrences(spark, folder)
    return records.select(key.alias("id"), "source", occurrence_url(F.col("source"), key).alias("occurrenceUrl"))


@query
def iso_dates(spark, folder):
    millis = F.col("start") - (F.col("lat") * 100_000_000_007).cast("long")
    return derived.occurrences(spark, folder).select("id", millis.alias("millis"), iso_millis(millis).alias("iso"))


@query
def parsed_dates(spark, folder):
    day = F.date_format(F.timestamp_millis("added"), "yyyy-MM-dd")
    text = F.when(F.col("lat") > 0, day).otherwise(F.concat(day, F.lit("T06:30:00.250+02:00")))
    records = derived.occurrences(spark, folder)
    return records.select("id", text.alias("text"), F.unix_millis(parse_utc(text)).alias("millis"))


@query
def days_added(spark, folder):
    records = derived.occurrences(spark, folder)
    return records.select("id", *[c.alias(n) for n, c in day_partitions(F.col("added")).items()])


@query
def normalized_selectors(spark, folder):
    rows = derived.varied_selectors(spark, folder)
    return rows.select(
        "key",
        S.normalize_list(F.col("taxonSelector")).alias("taxonSelector"),
        "wktString",
        S.normalize_list(F.col("traitSelector")).alias("traitSelector"),
    )


@query
def selector_uuid(spark, folder):
    rows = derived.varied_selectors(spark, folder)
    uuid = S.selector_uuid(F.col("taxonSelector"), F.col("wktString"), F.col("traitSelector"))
    return rows.select("key", uuid.alias("uuid"))


@query
def selector_path(spark, folder):
    rows = derived.varied_selectors(spark, folder)
    uuid = S.selector_uuid(F.col("taxonSelector"), F.col("wktString"), F.col("traitSelector"))
    return rows.select("key", S.selector_path(uuid).alias("path"))


@query
def selector_pick(spark, folder):
    rows = derived.varied_selectors(spark, folder)
    strings = [F.col(c) for c in ("taxonSelector", "wktString", "traitSelector")]
    return rows.select("key", S.pick_uuid(F.col("givenUuid"), *strings).alias("uuid"))


@query
def selector_valid(spark, folder):
    rows = derived.varied_selectors(spark, folder)
    valid = S.valid_selector("taxonSelector", "wktString")
    return rows.select("key", S.valid_taxa(F.col("taxonSelector")).alias("validTaxa"), valid.alias("valid"))


@query
def selector_statuses(spark, folder):
    """Which of many selectors are refused, and why."""
    return generate.selector_statuses(derived.varied_selectors(spark, folder))


@query
def rank_path(spark, folder):
    return derived.rank_paths(spark, folder)


@query
def bbox_polygon(spark, folder):
    rows = derived.occurrences(spark, folder)
    north, south = F.col("lat") + 1.5, F.col("lat") - 2.25
    return rows.select("id", bbox_wkt(north, F.col("lng") + 3.0, south, F.col("lng") - 0.5).alias("wkt"))


# Results of one selector


@query
def generate_checklist(spark, folder):
    return generate.generate_checklist(derived.occurrences(spark, folder), FLAGSHIP)


@query
def checklist_topk(spark, folder):
    return first_rows(generate.generate_checklist(derived.occurrences(spark, folder), FLAGSHIP), "checklist", 20)


@query
def large_limit(spark, folder):
    # Beyond the size of a top-k: half of all records.
    records = derived.occurrences(spark, folder)
    return first_rows(records, "occurrence", max(records.count() // 2, 10_001))


@query
def generate_occurrences(spark, folder):
    return _records(spark, folder, derived.CASES[9])


@query
def generate_in_polygon(spark, folder):
    return _records(spark, folder, derived.CASES[4])


@query
def first_added(spark, folder):
    return aggregates.first_added(derived.occurrences(spark, folder))


@query
def first_record(spark, folder):
    return aggregates.first_record(derived.occurrences(spark, folder))


@query
def search(spark, folder):
    return Q.search(derived.ranked_occurrences(spark, folder), " PROMO ", (40.0, -50.0, 10.0, -150.0))


# Many selectors


@query
def match_all_selectors(spark, folder):
    selectors = derived.saved_selectors(spark, folder)
    return match_selectors(derived.occurrences(spark, folder), selectors, derived.traits(spark, folder))


@query
def match_by_shuffle(spark, folder):
    """The same beyond the broadcast limit."""
    selectors = derived.saved_selectors(spark, folder)
    return match_selectors(derived.occurrences(spark, folder), selectors, derived.traits(spark, folder), 0)


@query
def generate_checklists(spark, folder):
    selectors = derived.saved_selectors(spark, folder)
    return generate.generate_checklists(derived.occurrences(spark, folder), selectors, derived.traits(spark, folder))


@query
def match_thin_areas(spark, folder):
    """Bands around the world, scattered parts and a date-line band: no cover falls back to one cell for all."""
    return match_selectors(derived.occurrences(spark, folder), selectors_frame(spark, derived.THIN))


@query
def match_hot_trait(spark, folder):
    """Many selectors that ask for one trait, each with another number."""
    selectors = derived.trait_selectors(spark, folder)
    return match_selectors(derived.occurrences(spark, folder), selectors, derived.traits(spark, folder))


@query
def monitor_summary(spark, folder):
    selectors = prepared(derived.saved_selectors(spark, folder))
    matched = match_selectors(derived.occurrences(spark, folder), selectors, derived.traits(spark, folder))
    return generate.monitor_summary(selectors, aggregates.item_counts(matched))


# Saved and read back


@query
def refresh_all(spark, folder):
    base = scratch_dir(spark, "refresh")
    generate.register_monitors(selectors_frame(spark, derived.SAVED), base)
    generate.refresh_all(derived.occurrences(spark, folder), base, derived.traits(spark, folder))
    return Q.monitors(spark, base)


# Arriving files: a batch takes a number of files and has jobs of its own, so files grow before their number does.
_ARRIVAL_BYTES = 256 * 1024 * 1024
# Their row groups: a batch of few large files is still work for all cores.
_ROW_GROUP_BYTES = 8 * 1024 * 1024
_ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def _arrive(spark, years, path):
    """Write records as files that arrive, by year."""
    before = spark.conf.get(_ADVISORY, None)
    spark.conf.set(_ADVISORY, str(_ARRIVAL_BYTES))
    try:
        writer = years.hint("rebalance", "year").write.option("parquet.block.size", _ROW_GROUP_BYTES)
        writer.partitionBy("year").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_ADVISORY)
        else:
            spark.conf.set(_ADVISORY, before)


@query
def stream_refresh(spark, folder):
    base, traits = scratch_dir(spark, "stream"), derived.traits(spark, folder)
    records = derived.occurrences(spark, folder)
    years = records.withColumn("year", F.year(F.timestamp_millis("added")))
    _arrive(spark, years, f"{base}/arrivals")
    generate.register_monitors(selectors_frame(spark, derived.SAVED), base)
    running = refresh_stream(spark, f"{base}/arrivals", base, f"{base}/progress", "arrivals", traits, 4)
    running.awaitTermination()
    return Q.monitors(spark, base)


def _streamed(spark, folder, **options):
    """A base folder with one year saved in full and all others added as they arrive."""
    base, traits = scratch_dir(spark, "stream"), derived.traits(spark, folder)
    years = derived.occurrences(spark, folder).withColumn("year", F.year(F.timestamp_millis("added")))
    first = years.year == 1995
    _arrive(spark, years.filter(~first), f"{base}/arrivals")
    generate.save_all_occurrences(years.filter(first).drop("year"), selectors_frame(spark, derived.SAVED), base, traits)
    refresh_stream(spark, f"{base}/arrivals", base, f"{base}/progress", "arrivals", traits, 2, **options).awaitTermination()
    return base


@query
def refresh_after_stream(spark, folder):
    """Counts after a full save and batches on top of it: sums of what each load holds."""
    return Q.monitors(spark, _streamed(spark, folder))


@query
def compact_loads(spark, folder):
    """The records of one selector after its loads were made one."""
    base = _streamed(spark, folder)
    generate.compact_loads(spark, base)
    return Q.occurrences(spark, base, SAVED, limit=None)


@query
def save_one_selector(spark, folder):
    base = scratch_dir(spark, "one")
    generate.save_occurrences(derived.occurrences(spark, folder), SAVED, base, derived.traits(spark, folder))
    return Q.occurrences(spark, base, SAVED, limit=None)


@query
def save_one_checklist(spark, folder):
    base = scratch_dir(spark, "one")
    generate.save_checklist(derived.occurrences(spark, folder), derived.CASES[4], base)
    return Q.checklist_tsv(spark, base, derived.CASES[4])


@query
def monitors_json_file(spark, folder):
    path = scratch_dir(spark, "json")
    sinks.write_json(Q.monitors_json(Q.monitors(spark, store(spark, folder))), path)
    return spark.read.text(path).withColumnRenamed("value", "json")


@query
def monitors(spark, folder):
    return Q.monitors(spark, store(spark, folder))


@query
def monitor_of(spark, folder):
    return Q.monitor_of(spark, store(spark, folder), derived.SAVED[1])


@query
def monitors_of(spark, folder):
    return Q.monitors_of(spark, store(spark, folder), derived.saved_selectors(spark, folder))


@query
def status_of(spark, folder):
    return Q.status_of(spark, store(spark, folder), SAVED)


@query
def checklists_status(spark, folder):
    return Q.checklists_status(spark, store(spark, folder), derived.saved_selectors(spark, folder))


@query
def saved_checklist(spark, folder):
    return Q.checklist(spark, store(spark, folder), FLAGSHIP, limit=None)


@query
def checklist(spark, folder):
    return Q.checklist(spark, store(spark, folder), FLAGSHIP)


@query
def checklist_tsv(spark, folder):
    rows = Q.checklist(spark, store(spark, folder), FLAGSHIP, limit=None)
    return rows.select(lines.checklist_tsv_line().alias("line"))


@query
def checklist_tsv_file(spark, folder):
    path = scratch_dir(spark, "tsv")
    sinks.write_checklist_tsv(Q.checklist(spark, store(spark, folder), FLAGSHIP, limit=None), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query
def checklist_json(spark, folder):
    return Q.checklist_json(spark, store(spark, folder), FLAGSHIP)


@query
def occurrences(spark, folder):
    return Q.occurrences(spark, store(spark, folder), SAVED, added_after=AFTER, added_before="2000-01-01")


@query
def saved_occurrences(spark, folder):
    return Q.occurrences(spark, store(spark, folder), derived.SAVED[4], limit=None)


@query
def occurrences_tsv(spark, folder):
    rows = Q.occurrences(spark, store(spark, folder), SAVED, added_after=AFTER, limit=None)
    return rows.select(lines.occurrence_tsv_line().alias("line"))


@query
def occurrences_tsv_plan(spark, folder):
    """The plan's own columns, as one line for the comparison."""
    rows = Q.occurrences_tsv(spark, store(spark, folder), SAVED, added_after=AFTER)
    return rows.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]).alias("line"))


@query
def occurrences_by_uuid(spark, folder):
    uuid = Q.monitor_of(spark, store(spark, folder), SAVED).first().uuid
    return Q.occurrences(spark, store(spark, folder), uuid=uuid, limit=None)


@query
def occurrences_none(spark, folder):
    return Q.occurrences(spark, store(spark, folder), SAVED, limit=0)


@query
def checklist_exists(spark, folder):
    saved, never = [Q.checklist_exists(spark, store(spark, folder), s) for s in (FLAGSHIP, ("Nothing", "ENVELOPE(0,1,1,0)", ""))]
    return derived.saved_selectors(spark, folder).limit(1).select(F.lit(saved).alias("saved"), F.lit(never).alias("never"))


@query
def days_added_extremes(spark, folder):
    """Times in and beyond the years with a day, and how both date filters see them."""
    far = F.expr(
        "CASE start DIV 86400000 % 5 WHEN 0 THEN 253402300799999 WHEN 1 THEN 253402300800000 "
        "WHEN 2 THEN -62167219200000 WHEN 3 THEN -62167219200001 ELSE added END"
    )
    rows = derived.occurrences(spark, folder).withColumn("added", far)
    rows = filters.added_filter(rows.withColumns(day_partitions(F.col("added"))), before="9999-12-31T12:00")
    rows = filters.added_partition_filter(rows, before="9999-12-31T12:00")
    return rows.groupBy("y", "m", "d").agg(F.count("*").alias("n"))


@query
def occurrences_tsv_file(spark, folder):
    path = scratch_dir(spark, "tsv")
    sinks.write_occurrences_tsv(Q.occurrences(spark, store(spark, folder), SAVED, limit=None), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query
def occurrences_json(spark, folder):
    return Q.occurrences_json(spark, store(spark, folder), SAVED, added_before=BEFORE)


@query
def monitors_json(spark, folder):
    return Q.monitors_json(Q.monitors(spark, store(spark, folder)))


@query
def monitored_occurrences(spark, folder):
    return Q.monitored_occurrences(spark, store(spark, folder), "gbif")


@query
def monitored_tsv(spark, folder):
    rows = Q.monitored_occurrences(spark, store(spark, folder), "idigbio", AFTER, BEFORE)
    return rows.select(lines.monitored_tsv_line().alias("line"))


@query
def monitored_tsv_file(spark, folder):
    path = scratch_dir(spark, "tsv")
    sinks.write_monitored_tsv(Q.monitored_occurrences(spark, store(spark, folder), "inaturalist"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query
def id_list_input(spark, folder):
    root = scratch_dir(spark, "ids")
    records = derived.occurrences(spark, folder)
    for name in ("gbif", "idigbio", "inaturalist"):
        ids = filters.source_filter(records, name).select("id")
        ids.write.option("sep", "\t").csv(f"{root}/source={name}/all.tsv")
    return inputs.read_id_lists(spark, root)


@query
def checklist_on_the_spot(spark, folder):
    """Nothing is saved for this selector, so its answer is computed."""
    compute = derived.occurrences(spark, folder), derived.traits(spark, folder)
    return Q.checklist(spark, store(spark, folder), derived.CASES[9], limit=None, compute=compute)


@query
def occurrences_on_the_spot(spark, folder):
    compute = derived.occurrences(spark, folder), derived.traits(spark, folder)
    return Q.occurrences(
        spark, store(spark, folder), derived.CASES[9], added_after=AFTER, added_before=BEFORE, limit=None, compute=compute
    )
