"""Reading saved results: by selector or UUID, day first added, archive and limit.

A selector is given by its three strings or by its UUID; the UUID wins. Where nothing has been
saved, ``compute=(occurrences, traits)`` works the answer out on the spot; without it the answer
is empty.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wildtally import schemas
from wildtally.functions import lines
from wildtally.functions.selectors import pick_uuid, selector_uuid
from wildtally.functions.taxa import rank_path
from wildtally.operators import aggregates, filters
from wildtally.operators.limits import PREVIEW, first_rows
from wildtally.plans.generate import READY, select_occurrences
from wildtally.selector import InvalidSelector, Resolved, resolve
from wildtally.sources import tables


def _computed(found: Resolved, compute) -> DataFrame:
    if found.selector is None:
        raise InvalidSelector("nothing saved under this UUID, and it does not tell the selector")
    occurrences, traits = compute
    return select_occurrences(occurrences, found, traits)


def _named(rows: DataFrame, fields: dict) -> DataFrame:
    return rows.select(*[column.alias(name) for name, column in fields.items()])


def _checklist(spark, base, found, limit, compute):
    rows = tables.checklist_rows(spark, base, found.uuid)
    if compute is not None and rows.isEmpty():
        rows = aggregates.checklist(_computed(found, compute))
    return first_rows(rows, "checklist", limit)


def checklist(spark, base, selector=None, uuid=None, limit=PREVIEW, compute=None) -> DataFrame:
    """(taxonPath, recordCount); with a limit the most frequent first, without one in no order."""
    return _checklist(spark, base, resolve(spark, selector, uuid), limit, compute)


def checklist_tsv(spark, base, selector=None, uuid=None, limit=None, compute=None) -> DataFrame:
    """The same with the taxon name, under the column names of the TSV file (which is written in order)."""
    return _named(checklist(spark, base, selector, uuid, limit, compute), lines.checklist_fields())


def _saved_status(spark, base, found: Resolved) -> str | None:
    row = tables.read_selector(spark, base, tables.SUMMARY, found.uuid).select("status").first()
    return row.status if row else None


def _occurrences(spark, base, found, added_after, added_before, limit, compute):
    status = _saved_status(spark, base, found)
    if status is None and compute is not None:
        rows = filters.added_filter(_computed(found, compute), added_after, added_before)
    else:
        rows = tables.selector_occurrences(spark, base, found.uuid, added_after, added_before)
        if status != READY:
            rows = rows.limit(0)
    return first_rows(tables.occurrence_rows(rows), "occurrence", limit)


def occurrences(
    spark, base, selector=None, uuid=None, added_after=None, added_before=None, limit=PREVIEW, compute=None
) -> DataFrame:
    """The records of a monitor that is ready; records of any other status are not shown."""
    found = resolve(spark, selector, uuid)
    return _occurrences(spark, base, found, added_after, added_before, limit, compute)


def occurrences_tsv(
    spark, base, selector=None, uuid=None, added_after=None, added_before=None, limit=None, compute=None
) -> DataFrame:
    """The same under the column names of the TSV file, with dates and links as text."""
    rows = occurrences(spark, base, selector, uuid, added_after, added_before, limit, compute)
    return _named(rows, lines.occurrence_fields())


def monitored_occurrences(spark, base, source, added_after=None, added_before=None, limit=None) -> DataFrame:
    """Ids of one archive's records that are part of any monitor."""
    rows = tables.source_ids(spark, base, source, added_after, added_before)
    return first_rows(tables.monitored_rows(rows), "monitored", limit)


def monitors(spark: SparkSession, base: str) -> DataFrame:
    """All monitors; the UUID is that of the saved strings."""
    own = selector_uuid(*[F.col(c) for c in schemas.SELECTOR.names])
    count = F.col("itemCount").alias("recordCount")
    summary = tables.read_table(spark, base, tables.SUMMARY)
    return summary.select(own.alias("uuid"), *schemas.SELECTOR.names, "status", count)


def _selector_columns(found: Resolved):
    """By UUID the strings of a selector are unknown, so they are null."""
    strings = found.selector or (None, None, None)
    named = zip(schemas.SELECTOR.names, strings)
    return [F.lit(found.uuid).alias("uuid"), *[F.lit(s).cast("string").alias(n) for n, s in named]]


def monitor_of(spark, base, selector=None, uuid=None) -> DataFrame:
    """One monitor, or no row."""
    found = resolve(spark, selector, uuid)
    row = tables.read_selector(spark, base, tables.SUMMARY, found.uuid).limit(1)
    return row.select(*_selector_columns(found), "status", F.col("itemCount").alias("recordCount"))


def _with_picked_uuid(selectors: DataFrame) -> DataFrame:
    given = F.col("uuid") if "uuid" in selectors.columns else F.lit(None).cast("string")
    return selectors.withColumn("uuid", pick_uuid(given, *[F.col(c) for c in schemas.SELECTOR.names]))


def monitors_of(spark, base, selectors: DataFrame) -> DataFrame:
    """Status and count of many selectors: (taxonSelector, wktString, traitSelector[, uuid]).

    Selectors without a monitor keep a null status.
    """
    row = F.min(F.struct(*schemas.SELECTOR.names, "status", F.col("itemCount").alias("recordCount")))
    saved = tables.read_table(spark, base, tables.SUMMARY).groupBy("uuid").agg(row.alias("m"))
    saved = saved.select("uuid", "m.status", "m.recordCount")
    return _with_picked_uuid(selectors).join(saved, "uuid", "left")


def checklists_status(spark, base, selectors: DataFrame) -> DataFrame:
    """``ready`` for each selector that has a row in its checklist, else null."""
    saved = tables.read_table(spark, base, tables.CHECKLIST).filter("recordCount IS NOT NULL").select("uuid").distinct()
    return _with_picked_uuid(selectors).join(saved.withColumn("status", F.lit(READY)), "uuid", "left")


def status_of(spark, base, selector=None, uuid=None) -> DataFrame:
    """The status of a monitor, or no row."""
    return monitor_of(spark, base, selector, uuid).select("status")


def checklist_exists(spark, base, selector=None, uuid=None) -> bool:
    """Is there any row? Apart from any limit."""
    return aggregates.exists(tables.checklist_rows(spark, base, resolve(spark, selector, uuid).uuid))


def _document(rows: DataFrame, found: Resolved, status, item, order) -> DataFrame:
    """One JSON object with at most a preview of items, in order."""
    listed = F.array_sort(F.collect_list(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], item.alias("item"))))
    items = F.transform(listed, lambda entry: entry["item"])
    packed = rows.agg(items.alias("items"))
    selector = F.struct(*_selector_columns(found))
    return packed.select(F.to_json(F.struct(selector.alias("selector"), status.alias("status"), "items")).alias("json"))


def checklist_json(spark, base, selector=None, uuid=None, compute=None) -> DataFrame:
    found = resolve(spark, selector, uuid)
    rows = _checklist(spark, base, found, PREVIEW, compute)
    order = [-F.col("recordCount"), F.col("taxonPath")]
    status = F.when(F.size("items") > 0, READY)
    return _document(rows, found, status, lines.checklist_item(), order)


def occurrences_json(
    spark, base, selector=None, uuid=None, added_after=None, added_before=None, compute=None
) -> DataFrame:
    found = resolve(spark, selector, uuid)
    rows = _occurrences(spark, base, found, added_after, added_before, PREVIEW, compute)
    order = [F.col(c) for c in ("added", "source", "id", "taxon", "lat", "lng", "start")]
    status = _saved_status(spark, base, found)
    if status is None and compute is not None:
        status = READY
    return _document(rows, found, F.lit(status).cast("string"), lines.occurrence_item(), order)


def monitors_json(rows: DataFrame) -> DataFrame:
    """One JSON object per monitor."""
    selector = F.struct("uuid", *schemas.SELECTOR.names)
    return rows.select(F.to_json(F.struct(selector.alias("selector"), "status", "recordCount")).alias("json"))


def search(ranked: DataFrame, name: str = "", bbox=None) -> DataFrame:
    """Records without a spatial issue, of one taxon and in a (north, east, south, west) box."""
    rows = filters.without_spatial_issue(ranked).select(
        rank_path().alias("taxonPath"), F.col("decimalLatitude").alias("lat"), F.col("decimalLongitude").alias("lng")
    )
    if name.strip():
        rows = rows.filter(filters.taxon_condition(F.col("taxonPath"), [name.strip()]))
    if bbox is not None:
        north, east, south, west = bbox
        spans = [(west, east)] if west <= east else [(west, 180.0), (-180.0, east)]
        boxes = [{"x0": a, "x1": b, "y0": south, "y1": north} for a, b in spans]
        rows = rows.filter(filters.area_condition(boxes, []))
    return rows
