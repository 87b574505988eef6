"""Aggregations; all have a map-side part, so a hot key costs no task more than another."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checklist(occurrences: DataFrame) -> DataFrame:
    """Records per taxon path."""
    return occurrences.groupBy(F.col("taxon").alias("taxonPath")).agg(F.count("*").alias("recordCount"))


def checklists(counted: DataFrame) -> DataFrame:
    """Records per selector and taxon path, under the names of the checklist table."""
    return counted.select("uuid", F.col("taxon").alias("taxonPath"), F.col("n").alias("recordCount"))


def item_counts(matched: DataFrame) -> DataFrame:
    return matched.groupBy("uuid").agg(F.count("*").alias("itemCount"))


def first_added(occurrences: DataFrame) -> DataFrame:
    """When each record was first seen in its archive."""
    return occurrences.groupBy("source", "id").agg(F.min("added").alias("added"))


def first_record(occurrences: DataFrame) -> DataFrame:
    """One whole record per archive and id: the one first added; all columns break ties."""
    rest = ["added", *[c for c in occurrences.columns if c not in ("source", "id", "added")]]
    picked = occurrences.groupBy("source", "id").agg(F.min(F.struct(*rest)).alias("first"))
    return picked.select("source", "id", "first.*").select(*occurrences.columns)


def exists(rows: DataFrame) -> bool:
    return not rows.isEmpty()
