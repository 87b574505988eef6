"""Places of rows within their groups, for groups of any size."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wildtally.llm.tables import written
from wildtally.operators.sizes import measured


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx`` (from 0, in order) and ``n`` (rows of the group), written out.

    A range sort cuts large groups across tasks; the rows of a group before each range are summed up from
    one count per range and group. ``group`` must not be null; nulls in ``order`` come first. Equal rows
    get their places in any order.
    """
    columns = rows.columns
    spread = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = written(spread.withColumn("_id", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_id", 33).alias("_part")
    runs = placed.groupBy(part, group).agg(F.count("*").alias("_n"), F.min("_id").alias("_low"))
    # One row per range of a group.
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_part", group, (before - F.col("_low")).alias("_shift"), F.sum("_n").over(whole).alias("n"))
    joined = placed.withColumn("_part", F.shiftright("_id", 33)).join(measured(runs, group), ["_part", group])
    return written(joined.select(*columns, (F.col("_id") + F.col("_shift")).alias("idx"), "n"), "ranked")
