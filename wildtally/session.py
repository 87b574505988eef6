"""Session settings the library relies on, and the shared scratch folder."""

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Dates are printed and parsed in UTC, and hot join partitions are split by AQE."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled", "true")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary one; on a cluster the folder has
    to be shared, so there the setting is required.
    """
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    shared = shared or context.getCheckpointDir()
    if shared is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):  # local-cluster has executors of its own
            raise RuntimeError("spark.checkpoint.dir has to name a shared folder")
        shared = tempfile.mkdtemp(prefix="wildtally-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared)
    return shared


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df):
    """``df`` written once to the shared folder and read back: its lineage ends there, and lost executors do no harm."""
    path = scratch_dir(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
