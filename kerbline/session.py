"""Session settings every operator relies on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import kerbline

# Runtime settings only: they are safe to apply to a session somebody else built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings; ship this package's task code by value, so workers need not have it installed."""
    cloudpickle.register_pickle_by_value(kerbline)
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Put small rows that are dear to process on every core.

    Adaptive execution sizes partitions by bytes and would leave such rows in one task; a stated number
    of partitions is left alone.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *columns)


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only for an unset local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="kerbline-checkpoint-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise through reliable storage, so a lost executor does not lose the result."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write once as Parquet in the shared folder and read back.

    For inputs that several steps read: they are computed once, and only the columns a step needs are
    read again. Unlike a checkpoint, the plan that reads them carries nothing over from the one before.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/kerbline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
