"""Order, limit and top-k."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wildtally.session import checkpoint

PREVIEW = 20

# Up to this many rows a limit is a top-k kept in memory by each task.
TOP_K = 10_000

_ORDERS = {
    "checklist": ["-recordCount", "taxonPath"],
    "occurrence": ["added", "source", "id", "taxon", "lat", "lng", "start"],
    "monitor": ["uuid"],
    "monitored": ["occurrenceId", "monitorUUID"],
}


def order_of(kind: str):
    return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in _ORDERS[kind]]


def first_rows(rows: DataFrame, kind: str, limit: int | None) -> DataFrame:
    """The first ``limit`` rows in the full order of the table, so that the answer repeats.

    No limit means all rows, without a sort. A small limit is a top-k. A large one is a range
    sort whose rows are counted per partition, so no task ever holds the whole answer; the sort
    runs here already, and its rows come in no order.
    """
    if limit is None:
        return rows
    if limit < 0:
        raise ValueError(f"limit must not be negative: {limit}")
    if limit <= TOP_K:
        return rows.orderBy(*order_of(kind)).limit(limit)
    return _first_of_sorted(rows.orderBy(*order_of(kind)), limit)


def _first_of_sorted(rows: DataFrame, limit: int) -> DataFrame:
    # The id holds the partition in its upper bits and the row's place in it below. The
    # checkpoint fixes the ids: they are read twice. No partition can give more than ``limit`` rows.
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    ids = checkpoint(rows.withColumn("_id", F.monotonically_increasing_id()).filter(place < limit))
    sizes = ids.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    # One row per partition of the sort: bounded by the number of shuffle partitions.
    before = F.coalesce(
        F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    starts = sizes.select("_part", before.alias("_before"))
    placed = ids.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.filter(F.col("_before") + place < limit).select(*rows.columns)
