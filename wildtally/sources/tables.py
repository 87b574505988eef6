"""The saved tables: layout, reads and writes.

All tables live below one base folder. Records are saved in *loads*: a save, a batch of a stream or a
compaction writes one new folder for all its selectors, spread by the first digits of their UUIDs and sorted by
selector and time, so that the number of files goes by the size of the data and a read of one selector or
some days skips the rest by the statistics of the files. Ids are saved in the same loads by archive.

The summary of a selector says in which loads its records are, with their number and times, so it is a ledger
as well: counts are sums of it, and no load is counted twice. A load counts from the moment that the summary
names it; until then, and if a save is broken off, readers see what was there before. Loads that no
summary names any more are removed, one folder each.

Checklists and summaries are overwritten by selector. Tables of records by selector and day (or archive and
day) without loads are read as well: they hold the records of selectors whose summary names no loads.
"""

import re
import uuid as _uuid
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wildtally import schemas
from wildtally.functions.selectors import selector_partitions
from wildtally.functions.text import or_empty
from wildtally.operators.filters import added_filter, added_partition_filter, source_filter
from wildtally.operators.sizes import measured
from wildtally.schemas import DAY_PARTITION, SELECTOR_PARTITION
from wildtally.session import checkpoint

# The names of the tables.
CHECKLIST = "checklist"
OCCURRENCE = "occurrence"
SUMMARY = "occurrence-summary"
MONITORED = "source-of-monitored-occurrence"
# Loads of each table, and the folders within one.
LOADS = {OCCURRENCE: "occurrence-load", MONITORED: "monitored-load"}
_LOAD_SCHEMAS = {OCCURRENCE: schemas.LOADED_OCCURRENCE, MONITORED: schemas.LOADED_MONITORED}
_LOAD_PARTITION = {OCCURRENCE: "u0", MONITORED: "source"}
# Stands for the tables without loads.
NO_LOAD = ""

_SCHEMAS = {CHECKLIST: schemas.CHECKLIST, OCCURRENCE: schemas.OCCURRENCE, SUMMARY: schemas.SUMMARY, MONITORED: schemas.MONITORED}
PARTITIONS = {
    CHECKLIST: SELECTOR_PARTITION,
    OCCURRENCE: [*SELECTOR_PARTITION, *DAY_PARTITION, "load"],
    SUMMARY: SELECTOR_PARTITION,
    MONITORED: ["source", *DAY_PARTITION, "load"],
}


def _open(spark: SparkSession, base: str, name: str, folder: str = "") -> DataFrame | None:
    declared = schemas.with_partitions(_SCHEMAS[name], PARTITIONS[name])
    reader = spark.read.schema(declared).option("basePath", f"{base}/{name}")
    try:
        return reader.parquet(f"{base}/{name}{folder}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_table(spark: SparkSession, base: str, name: str, folder: str = "") -> DataFrame:
    """A saved table with its partition columns, as text; empty if nothing has been saved.

    Of a table with many folders, ``folder`` names the one to list; partition columns stay.
    """
    rows = _open(spark, base, name, folder)
    if rows is None:
        return spark.createDataFrame([], schemas.with_partitions(_SCHEMAS[name], PARTITIONS[name]))
    return rows


def read_selector(spark: SparkSession, base: str, name: str, uuid: str) -> DataFrame:
    """The rows of one selector; only its own folder is listed."""
    return read_table(spark, base, name, _selector_folder(uuid)).filter(F.col("uuid") == uuid)


def _selector_folder(uuid: str) -> str:
    return f"/u0={uuid[0:2]}/u1={uuid[2:4]}/u2={uuid[4:6]}/uuid={uuid}"


def read_source(spark: SparkSession, base: str, source: str) -> DataFrame:
    """The ids of one archive; names that need quoting in a path are looked up in the whole table."""
    plain = source.replace("-", "").replace("_", "").isalnum() and source.isascii()
    folder = f"/source={source}" if plain else ""
    return source_filter(read_table(spark, base, MONITORED, folder), source)


def _write(rows: DataFrame, base: str, name: str) -> None:
    columns = PARTITIONS[name]
    (
        # Partitions that got too much are split and small ones merged, per size at run time.
        rows.hint("rebalance", *columns)
        .write.partitionBy(*columns)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(f"{base}/{name}")
    )


def _among(rows: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose values in the columns of ``keys`` are in ``keys``; null counts as a value."""
    renamed = measured(keys.toDF(*[f"_key_{c}" for c in keys.columns]), *[f"_key_{c}" for c in keys.columns])
    conditions = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys.columns]
    return rows.join(renamed, reduce(and_, conditions), how)


def _delete(spark: SparkSession, folder: str) -> None:
    # Spark has no call to drop a folder, so the file system is asked for it.
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def save_checklists(checklists: DataFrame, base: str, selectors: DataFrame, uuid: str | None = None) -> None:
    """(uuid, taxonPath, recordCount) of these selectors; ``uuid`` if it is one only.

    A selector that had rows and has none now gets one without a count, which readers leave out: so its old
    rows are overwritten like all others.
    """
    before = _open(checklists.sparkSession, base, CHECKLIST, _selector_folder(uuid) if uuid else "")
    if before is not None:
        checklists = checkpoint(checklists)
        empty = selectors.select("uuid").join(measured(checklists.select("uuid").distinct(), "uuid"), "uuid", "left_anti")
        held = _among(before.select("uuid").distinct(), empty)
        checklists = checklists.unionByName(held, allowMissingColumns=True)
    rows = checklists.withColumns(selector_partitions(F.col("uuid")))
    _write(rows.select("taxonPath", "recordCount", *PARTITIONS[CHECKLIST]), base, CHECKLIST)


def new_load(name: str) -> str:
    """A load that is not there yet; all loads of one name stand for the same records."""
    if not re.fullmatch(r"[\w-]+", name):
        raise ValueError(f"not the name of a load: {name!r}")
    return f"{name}.{_uuid.uuid4().hex}"


def _write_load(rows: DataFrame, base: str, name: str, load: str, order: list[str]) -> None:
    part = _LOAD_PARTITION[name]
    columns = [*_LOAD_SCHEMAS[name].names, part]
    # Folders that got too much are split and small ones written by one task, per size at run time.
    spread = rows.select(*columns).hint("rebalance", part).sortWithinPartitions(part, *order)
    spread.write.partitionBy(part).parquet(f"{base}/{LOADS[name]}/load={load}")


def write_occurrences(matched: DataFrame, base: str, load: str) -> None:
    """Occurrences with the ``uuid`` of the selector they belong to, as a load that nothing names yet."""
    rows = matched.withColumn("u0", selector_partitions(F.col("uuid"))["u0"])
    _write_load(rows, base, OCCURRENCE, load, ["uuid", "added"])


def write_monitored(matched: DataFrame, base: str, load: str) -> None:
    """The ids of the same occurrences, by archive."""
    rows = matched.withColumn("monitorUUID", F.col("uuid")).withColumn("occurrenceId", F.col("id"))
    _write_load(rows, base, MONITORED, load, ["added"])


def read_loads(spark: SparkSession, base: str, name: str, loads: list[str] | None = None, part: str | None = None) -> DataFrame:
    """The rows of some loads, or of all there are; of their folders ``part``, if given."""
    root, declared = f"{base}/{LOADS[name]}", schemas.with_partitions(_LOAD_SCHEMAS[name], ["load", _LOAD_PARTITION[name]])
    within = f"/{_LOAD_PARTITION[name]}={part}" if part else ""
    paths = [root] if loads is None else [f"{root}/load={load}{within}" for load in loads]
    try:
        if paths:
            return spark.read.schema(declared).option("basePath", root).parquet(*paths)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND" or loads is not None:
            raise
    return spark.createDataFrame([], declared)


def load_entries(spark: SparkSession, base: str, load: str) -> DataFrame:
    """(uuid, entry): how many records of each selector a load holds, and from when; reads that load alone."""
    counted = read_loads(spark, base, OCCURRENCE, [load]).groupBy("uuid").agg(
        F.count("*").alias("n"), F.min("added").alias("first"), F.max("added").alias("last")
    )
    return counted.select("uuid", F.struct(F.lit(load).alias("load"), "n", "first", "last").alias("entry"))


def named_loads(summary: DataFrame) -> DataFrame:
    """The summary with ``loads`` that are never null: records saved without loads are an entry of their own."""
    without = F.struct(F.lit(NO_LOAD).alias("load"), F.col("itemCount").alias("n"), *[F.lit(None).cast("long").alias(c) for c in ("first", "last")])
    none = F.array().cast(schemas.LOADS)
    return summary.withColumn("loads", F.coalesce("loads", F.when(F.col("itemCount") > 0, F.array(without)).otherwise(none)))


def current_loads(spark: SparkSession, base: str) -> DataFrame:
    """(uuid, load, n, first, last): where the records of each selector are."""
    summary = named_loads(read_table(spark, base, SUMMARY))
    return summary.select("uuid", F.explode("loads").alias("l")).select("uuid", "l.*")


def drop_unnamed(spark: SparkSession, base: str, loads: list[str]) -> None:
    """Remove those of these loads that no summary names."""
    loads = [load for load in loads if load != NO_LOAD]
    if not loads:
        return
    named = {r.load for r in current_loads(spark, base).filter(F.col("load").isin(loads)).select("load").distinct().collect()}
    for load in set(loads) - named:
        for name in LOADS.values():
            _delete(spark, f"{base}/{name}/load={load}")


def selector_occurrences(spark: SparkSession, base: str, uuid: str, after: str | None = None, before: str | None = None) -> DataFrame:
    """The current records of one selector, from the loads that its summary names and its days allow."""
    columns = schemas.OCCURRENCE.names
    row = named_loads(read_selector(spark, base, SUMMARY, uuid)).select("loads").first()
    loads = row.loads if row else []
    names = [entry.load for entry in loads if entry.load != NO_LOAD]
    rows = read_loads(spark, base, OCCURRENCE, names, uuid[0:2]).filter(F.col("uuid") == uuid)
    rows = added_filter(rows, after, before).select(columns)
    if len(names) < len(loads):
        old = added_partition_filter(read_selector(spark, base, OCCURRENCE, uuid), after, before)
        rows = rows.unionByName(old.select(columns))
    return rows


def source_ids(spark: SparkSession, base: str, source: str, after: str | None = None, before: str | None = None) -> DataFrame:
    """(occurrenceId, monitorUUID) of one archive, as the summaries have them now."""
    columns = schemas.MONITORED.names
    current = checkpoint(current_loads(spark, base).select(F.col("uuid").alias("monitorUUID"), "load"))
    rows = added_filter(source_filter(read_loads(spark, base, MONITORED), source), after, before)
    rows = rows.join(measured(current, "monitorUUID", "load"), ["monitorUUID", "load"], "left_semi").select(columns)
    old = added_partition_filter(read_source(spark, base, source), after, before).select(columns)
    moved = current.groupBy("monitorUUID").agg(F.max(F.col("load") == NO_LOAD).alias("old")).filter("NOT old").select("monitorUUID")
    # Ids without a monitor stay.
    return rows.unionByName(old.join(measured(moved, "monitorUUID"), "monitorUUID", "left_anti").select(columns))


def save_summary(summary: DataFrame, base: str) -> None:
    """(uuid, itemCount, status, selector strings), one row per selector."""
    rows = summary.withColumns(selector_partitions(F.col("uuid")))
    _write(rows.select(*schemas.SUMMARY.names, *PARTITIONS[SUMMARY]), base, SUMMARY)


def checklist_rows(spark: SparkSession, base: str, uuid: str) -> DataFrame:
    return read_selector(spark, base, CHECKLIST, uuid).filter("recordCount IS NOT NULL").select(*schemas.CHECKLIST.names)


def occurrence_rows(rows: DataFrame) -> DataFrame:
    """The columns of an occurrence; the end of the event is its start."""
    return rows.select("taxon", "lat", "lng", "start", F.col("start").alias("end"), "id", "added", "source")


def monitored_rows(rows: DataFrame) -> DataFrame:
    return rows.select("occurrenceId", or_empty(F.col("monitorUUID")).alias("monitorUUID"))
