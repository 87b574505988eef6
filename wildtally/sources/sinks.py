"""Results as TSV and JSON files.

A TSV result is a folder of parts in order: the first line of the first part is the header, and the
rows follow in the full order of their table, however many parts there are.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wildtally.functions.lines import checklist_fields, monitored_fields, occurrence_fields
from wildtally.functions.text import tabbed
from wildtally.operators.limits import order_of


def _one_line(value: Column) -> Column:
    """A line or field break inside a value becomes one space."""
    return F.translate(value.cast("string"), "\t\r\n", "   ")


def _write_tsv(rows: DataFrame, fields: dict[str, Column], path: str, kind: str) -> None:
    """A range sort of all lines, the header's key before all others, so no task holds the whole file."""
    line = tabbed(*[_one_line(c) for c in fields.values()])
    lines = rows.select("*", line.alias("_line"), F.lit(1).alias("_place"))
    header = rows.sparkSession.range(1).select(F.lit("\t".join(fields)).alias("_line"), F.lit(0).alias("_place"))
    every = lines.unionByName(header, allowMissingColumns=True)
    every.orderBy("_place", *order_of(kind)).select("_line").write.text(path)


def write_checklist_tsv(rows: DataFrame, path: str) -> None:
    _write_tsv(rows, checklist_fields(), path, "checklist")


def write_occurrences_tsv(rows: DataFrame, path: str) -> None:
    _write_tsv(rows, occurrence_fields(), path, "occurrence")


def write_monitored_tsv(rows: DataFrame, path: str) -> None:
    _write_tsv(rows, monitored_fields(), path, "monitored")


def write_json(documents: DataFrame, path: str) -> None:
    """One document per line, from a DataFrame with the text in ``json``."""
    documents.select("json").write.text(path)
