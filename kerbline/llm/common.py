"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.session import checkpoint_dir, prepare

#: Rows that go to a Python worker at a time. Texts are long and lists of tokens longer: Spark's own 10,000
#: rows are tens of megabytes several times over.
BATCH_ROWS = 1000
#: And bytes of them, so that a run of very long texts makes smaller batches.
BATCH_BYTES = 4 << 20

#: The characters that separate words, everywhere in this package.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"


def prepare_texts(spark: SparkSession) -> SparkSession:
    """The library's session settings, and small Arrow batches."""
    prepare(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Later steps start from files that every executor can reach, so a lost executor costs its running
    tasks only.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/kerbline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole(text: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
