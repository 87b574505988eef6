"""Inputs of the generating jobs."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wildtally import schemas


def read_occurrences(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table of merged archives."""
    return spark.read.schema(schemas.OCCURRENCE).parquet(path)


def read_traits(spark: SparkSession, pattern: str) -> DataFrame:
    """CSV files of (taxon, trait, value) with a header line; a value that is no number fails the query."""
    reader = spark.read.schema(schemas.TRAIT).option("header", True).option("enforceSchema", False)
    return reader.option("mode", "FAILFAST").csv(pattern)


def read_id_lists(spark: SparkSession, root: str, name: str = "all.tsv") -> DataFrame:
    """Text files of occurrence ids, with or without a monitor UUID, in ``source=*/<name>`` folders.

    The folder names tell complete lists from previews; lists of one name are read together.
    """
    schema = schemas.with_partitions(schemas.MONITORED, ["source"])
    reader = spark.read.schema(schema).option("sep", "\t").option("quote", "").option("basePath", root)
    return reader.csv(f"{root}/source=*/{name}")


def union_archives(archives: dict[str, DataFrame]) -> DataFrame:
    """Several archives as one occurrence table, told apart by ``source``.

    Columns an archive does not have are null.
    """
    named = [rows.withColumn("source", F.lit(name)) for name, rows in archives.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
