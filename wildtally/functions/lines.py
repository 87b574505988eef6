"""Rows as TSV lines and JSON objects."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from wildtally.functions.dates import iso_millis
from wildtally.functions.links import occurrence_url
from wildtally.functions.taxa import last_taxon, taxon_name
from wildtally.functions.text import or_empty, tabbed


# The column names of the TSV files, below, and the keys of the JSON items.


def checklist_fields(path=None, count=None) -> dict[str, Column]:
    path = F.col("taxonPath") if path is None else path
    count = F.col("recordCount") if count is None else count
    return {"taxonName": taxon_name(path), "taxonPath": path, "recordCount": count}


def occurrence_fields() -> dict[str, Column]:
    c = F.col
    return {
        "taxonName": last_taxon(c("taxon")),
        "taxonPath": c("taxon"),
        "lat": c("lat"),
        "lng": c("lng"),
        "eventStartDate": iso_millis(c("start")),
        "occurrenceId": c("id"),
        "firstAddedDate": iso_millis(c("added")),
        "source": c("source"),
        "occurrenceUrl": occurrence_url(c("source"), c("id")),
    }


def monitored_fields() -> dict[str, Column]:
    return {"occurrenceId": F.col("occurrenceId"), "monitorUUID": or_empty(F.col("monitorUUID"))}


def tsv_line(fields: dict[str, Column]) -> Column:
    return tabbed(*fields.values())


def checklist_tsv_line(path=None, count=None) -> Column:
    return tsv_line(checklist_fields(path, count))


def occurrence_tsv_line() -> Column:
    return tsv_line(occurrence_fields())


def monitored_tsv_line() -> Column:
    return tsv_line(monitored_fields())


def checklist_item() -> Column:
    return F.struct(F.col("taxonPath").alias("taxon"), F.col("recordCount").alias("recordcount"))


def occurrence_item() -> Column:
    return F.struct("taxon", "lat", "lng", "start", "end", "id", "added", "source")
