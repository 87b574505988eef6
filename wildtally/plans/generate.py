"""Computing and saving the results of selectors."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wildtally import schemas
from wildtally.functions import selectors as S
from wildtally.functions import shapes
from wildtally.functions.shapes import supported_area
from wildtally.operators import aggregates, filters
from wildtally.operators.matching import count_taxa, match_index, prepared, selector_index
from wildtally.operators.sizes import measured
from wildtally.operators.traits import trait_filter
from wildtally.selector import InvalidSelector, Resolved, resolve, selectors_frame, with_uuid
from wildtally.session import checkpoint
from wildtally.sources import tables

READY = "ready"
NO_AREA = "unsupported area"
BAD_TAXA = "invalid taxon list"
BAD_AREA = "invalid area"


def select_occurrences(occurrences: DataFrame, selector, traits: DataFrame | None = None) -> DataFrame:
    """The occurrences of one selector: taxon and area as scan filters, then the traits."""
    found = selector if isinstance(selector, Resolved) else resolve(occurrences.sparkSession, selector)
    rows = filters.selector_area_filter(filters.taxon_filter(occurrences, found.taxa), found)
    if found.traits:
        if traits is None:
            raise InvalidSelector("a trait list needs a table of traits")
        rows = trait_filter(rows, traits, found.selector.traitSelector)
    return rows


def generate_checklist(occurrences: DataFrame, selector, traits: DataFrame | None = None) -> DataFrame:
    return aggregates.checklist(select_occurrences(occurrences, selector, traits))


def generate_checklists(occurrences: DataFrame, selectors: DataFrame, traits: DataFrame | None = None) -> DataFrame:
    return aggregates.checklists(count_taxa(occurrences, selector_index(prepared(selectors)), traits))


def _one(occurrences: DataFrame, selector, traits):
    spark = occurrences.sparkSession
    found = resolve(spark, selector)
    rows = select_occurrences(occurrences, found, traits).withColumn("uuid", F.lit(found.uuid))
    return rows, with_uuid(selectors_frame(spark, [found.selector])), found.uuid


def save_checklist(occurrences: DataFrame, selector, base: str, traits: DataFrame | None = None) -> None:
    """Compute and save the checklist of one selector."""
    rows, selectors, uuid = _one(occurrences, selector, traits)
    counted = rows.groupBy("uuid", "taxon").agg(F.count("*").alias("n"))
    tables.save_checklists(aggregates.checklists(counted), base, selectors, uuid)


def save_checklists(
    occurrences: DataFrame, selectors: DataFrame, base: str, traits: DataFrame | None = None
) -> None:
    """Compute and save the checklists of many selectors in one pass."""
    chosen = prepared(selectors)
    tables.save_checklists(aggregates.checklists(count_taxa(occurrences, selector_index(chosen), traits)), base, chosen)


def monitor_summary(selectors: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per selector (valid, with ``uuid``); selectors that match nothing count 0."""
    status = F.when(supported_area("wktString"), READY).otherwise(NO_AREA)
    rows = selectors.join(counts, "uuid", "left")
    count = F.coalesce("itemCount", F.lit(0).cast("long"))
    return rows.select("uuid", count.alias("itemCount"), status.alias("status"), *schemas.SELECTOR.names)


def _summary(selectors: DataFrame) -> DataFrame:
    """Summary rows of selectors (with ``loads``): the count is the sum of what the loads hold."""
    counted = selectors.withColumn("itemCount", F.aggregate("loads", F.lit(0).cast("long"), lambda n, entry: n + entry["n"]))
    rows = monitor_summary(selectors.select("uuid", *schemas.SELECTOR.names), counted.select("uuid", "itemCount"))
    return rows.join(selectors.select("uuid", "loads"), "uuid")


def selector_statuses(selectors: DataFrame) -> DataFrame:
    """What becomes of each selector, row by row: ``ready``, an area without an inside, or why it is refused.

    The trait list is not checked. One row per given row, nulls as empty text, in no order.
    """
    rows = selectors.select(*[S.or_empty(F.col(c)).alias(c) for c in schemas.SELECTOR.names])
    taxa, traits = (S.normalize_list(F.col(c)) for c in ("taxonSelector", "traitSelector"))
    status = (
        F.when(~S.valid_taxa(taxa), BAD_TAXA)
        .when(~shapes.valid_wkt("wktString"), BAD_AREA)
        .when(~supported_area("wktString"), NO_AREA)
        .otherwise(READY)
    )
    return rows.select(S.selector_uuid(taxa, F.col("wktString"), traits).alias("uuid"), *schemas.SELECTOR.names, status.alias("status"))


def register_monitors(selectors: DataFrame, base: str) -> None:
    """Save selectors before any record of them, for the next refresh or a stream to fill.

    Monitors that are there already stay as they are.
    """
    chosen = prepared(selectors)
    saved = measured(tables.read_table(chosen.sparkSession, base, tables.SUMMARY).select("uuid"), "uuid")
    new = checkpoint(chosen.join(saved, "uuid", "left_anti"))
    tables.save_summary(_summary(new.withColumn("loads", F.array().cast(schemas.LOADS))), base)


def add_load(rows: DataFrame, base: str, name: str) -> DataFrame:
    """Write the records (with ``uuid``) and their ids as a new load; returns its (uuid, entry).

    The match runs once; ids and counts come from the saved records. Nothing names the load yet.
    """
    load = tables.new_load(name)
    tables.write_occurrences(rows, base, load)
    tables.write_monitored(tables.read_loads(rows.sparkSession, base, tables.OCCURRENCE, [load]), base, load)
    return checkpoint(tables.load_entries(rows.sparkSession, base, load))


def point_to(selectors: DataFrame, base: str, replaced: DataFrame) -> None:
    """Make ``loads`` of these selectors current, and remove the loads of ``replaced`` (load) that nothing names then.

    ``replaced`` is read before: it may come from the summary. There are as many as saves since the last
    compaction, not as many as selectors.
    """
    old = [r.load for r in replaced.distinct().collect()]
    tables.save_summary(_summary(selectors), base)
    tables.drop_unnamed(selectors.sparkSession, base, old)


def _save(rows: DataFrame, selectors: DataFrame, base: str, uuid: str | None = None) -> None:
    spark = rows.sparkSession
    entries = add_load(rows, base, "full")
    now = F.when(F.col("entry").isNull(), F.array().cast(schemas.LOADS)).otherwise(F.array("entry"))
    chosen = checkpoint(selectors.join(measured(entries, "uuid"), "uuid", "left").withColumn("loads", now).drop("entry"))
    if uuid is not None:
        before = tables.read_selector(spark, base, tables.SUMMARY, uuid)
    else:
        before = tables.read_table(spark, base, tables.SUMMARY).join(measured(chosen.select("uuid"), "uuid"), "uuid", "left_semi")
    point_to(chosen, base, tables.named_loads(before).select(F.explode("loads.load").alias("load")))


def compact_loads(spark: SparkSession, base: str, more_than: int = 1) -> None:
    """Write the records of all selectors with more than so many loads as one load in place of them.

    Readers have the old loads until the summaries name the new one. A batch that is part of a compacted load
    cannot be replaced any more; a stream compacts before a batch, when all earlier ones are done.
    """
    summary = tables.named_loads(tables.read_table(spark, base, tables.SUMMARY)).filter(F.size("loads") > more_than)
    # Records without loads stay where they are.
    chosen = checkpoint(summary.filter(F.size(F.filter("loads", lambda x: x["load"] != tables.NO_LOAD)) > more_than))
    wanted = checkpoint(chosen.select("uuid", F.explode("loads.load").alias("load")).filter(F.col("load") != tables.NO_LOAD))
    loads = [r.load for r in wanted.select("load").distinct().collect()]
    if not loads:
        return
    rows = tables.read_loads(spark, base, tables.OCCURRENCE, loads).join(measured(wanted, "uuid", "load"), ["uuid", "load"], "left_semi")
    entries = add_load(rows, base, "compact")
    kept = F.filter("loads", lambda x: x["load"] == tables.NO_LOAD)
    moved = chosen.join(measured(entries, "uuid"), "uuid").withColumn("loads", F.concat(kept, F.array("entry"))).drop("entry")
    point_to(checkpoint(moved), base, wanted.select("load"))


def save_occurrences(occurrences: DataFrame, selector, base: str, traits: DataFrame | None = None) -> None:
    """Compute and save the occurrences, ids and summary of one selector."""
    rows, selectors, uuid = _one(occurrences, selector, traits)
    _save(rows, selectors, base, uuid)


def save_all_occurrences(
    occurrences: DataFrame, selectors: DataFrame, base: str, traits: DataFrame | None = None
) -> None:
    """The same for many selectors in one pass over the occurrences."""
    chosen = prepared(selectors)
    _save(match_index(occurrences, selector_index(chosen), traits), chosen, base)


def refresh_all(occurrences: DataFrame, base: str, traits: DataFrame | None = None) -> None:
    """Recompute every saved monitor from the occurrences."""
    spark = occurrences.sparkSession
    save_all_occurrences(occurrences, tables.read_table(spark, base, tables.SUMMARY), base, traits)
