"""Broadcast only what has been measured."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Larger tables are joined by a shuffle, where AQE splits hot partitions.
BROADCAST_BYTES = 64 * 1024 * 1024


def small_side(rows: DataFrame, count: int, text_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` marked for broadcast if a measured size is below the limit, else as they are."""
    # Each column has a word of its own and rounds its text up to words.
    return F.broadcast(rows) if fits(count, text_bytes, limit, 48 + 16 * len(rows.columns)) else rows


def fits(count: int, text_bytes: int, limit: int = BROADCAST_BYTES, row_bytes: int = 64) -> bool:
    """``row_bytes``: the row's header, its fixed-size parts and its entry in the hash table."""
    return row_bytes * count + text_bytes <= limit


def measured(rows: DataFrame, *texts: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Measure ``rows`` (an aggregate over them) and mark them accordingly."""
    total = F.lit(0).cast("long")
    for text in texts:
        total = total + F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))
    size = rows.agg(F.count("*").alias("n"), total.alias("bytes")).first()
    return small_side(rows, size.n, size.bytes, limit)
