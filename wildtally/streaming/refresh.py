"""Keeping monitors up to date as new occurrence files arrive."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wildtally import schemas
from wildtally.operators.matching import index_traits, match_known, prepared, selector_index
from wildtally.operators.sizes import measured
from wildtally.plans.generate import add_load, compact_loads, point_to
from wildtally.session import checkpoint
from wildtally.sources import tables


class KnownMonitors:
    """The index of the saved monitors and what it asks of the traits, worked out again only when the monitors change."""

    def __init__(self, traits: DataFrame | None = None):
        self.traits = traits
        self._of, self._known = None, None

    def of(self, saved: DataFrame):
        # Selectors and their texts, whatever their order; two sums of different hashes.
        row = F.struct(*[F.col(c) for c in ("uuid", *schemas.SELECTOR.names)])
        sums = [F.sum(h.cast("decimal(38,0)")) for h in (F.xxhash64(row), F.xxhash64(F.lit(1), row))]
        now = tuple(saved.agg(F.count("*"), *sums).first())
        if now != self._of:
            index = selector_index(prepared(saved))
            self._known = index, index_traits(index, self.traits)
            self._of = now
        return self._known


def add_batch(
    occurrences: DataFrame, base: str, load: str, traits: DataFrame | None = None, monitors: KnownMonitors | None = None
) -> None:
    """Match new occurrences with all saved monitors and add them as a load; reads no older record.

    The same load again takes the place of the first, so a replayed batch changes nothing. Batches that share
    ``monitors`` (which then have the traits) share its index.
    """
    spark = occurrences.sparkSession
    # The summary is overwritten at the end; this copy of it stays.
    saved = checkpoint(tables.named_loads(tables.read_table(spark, base, tables.SUMMARY)))
    index, ranges = (monitors or KnownMonitors(traits)).of(saved)
    entries = add_load(match_known(occurrences, index, ranges), base, load)
    same = lambda entry: F.startswith(entry["load"], F.lit(f"{load}."))
    touched = saved.join(measured(entries, "uuid"), "uuid", "left").filter(F.col("entry").isNotNull() | F.exists("loads", same))
    others = F.filter("loads", lambda entry: ~same(entry))
    loads = F.when(F.col("entry").isNull(), others).otherwise(F.concat(others, F.array("entry")))
    replaced = saved.select(F.explode(F.filter("loads", same)).alias("l")).select("l.load")
    point_to(checkpoint(touched.withColumn("loads", loads).drop("entry")), base, replaced)


def refresh_stream(
    spark: SparkSession,
    folder: str,
    base: str,
    checkpoint_location: str,
    name: str,
    traits: DataFrame | None = None,
    files_per_batch: int | None = None,
    compact_every: int = 32,
) -> StreamingQuery:
    """Work through the occurrence files in ``folder`` that this stream has not seen yet.

    ``name`` belongs to the checkpoint location: the batches are saved under it, so another
    stream needs another name. ``traits`` are read again when the saved monitors have changed. Each ``compact_every`` batches their loads are made one, so that a selector is
    never in more than a few dozen.
    """
    reader = spark.readStream.schema(schemas.OCCURRENCE).option("recursiveFileLookup", True)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    known = KnownMonitors(traits)

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % compact_every == 0:
            # All batches before this one are done for good: only this one can come again.
            compact_loads(spark, base, compact_every // 2)
        add_batch(batch, base, f"{name}-{batch_id}", monitors=known)

    return (
        reader.parquet(folder)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint_location)
        .trigger(availableNow=True)
        .start()
    )
