"""Reading the text tables, and shared settings of the text operators."""

from pyspark.sql import DataFrame, SparkSession

from wildtally.session import prepare, scratch_dir

# Rows of one Arrow batch: texts are long, and a Python worker holds a batch at a time.
BATCH_ROWS = 256


def settings(spark: SparkSession) -> SparkSession:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return settings(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table in the shared folder, read back: cuts the lineage and survives lost executors."""
    path = scratch_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
