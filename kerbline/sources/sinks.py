"""Sinks. A micro-batch writes its own folder, so replaying it replaces what it wrote and nothing else."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.operators.tracks import fold_signatures


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Idempotent append of one micro-batch."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Everything the batches of a log wrote, with the batch they came in."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch_id=*")


def write_by_day(df: DataFrame, path: str, ms: str = "recorded_ms", order: str = "camera_id") -> None:
    """Index tables at rest: a folder per day, each sorted so row groups can be skipped by camera and time."""
    day = F.date_format(F.timestamp_millis(F.col(ms).cast("bigint")), "yyyy-MM-dd")
    dated = df.withColumn("day", day)
    # Rebalancing splits a busy day over tasks and lets quiet days share one, by measured size.
    spread = dated.hint("rebalance", "day")
    spread.sortWithinPartitions("day", order, ms).write.mode("append").partitionBy("day").parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    """Lifecycle events (loops, reconnects): append only."""
    events.write.mode("append").parquet(path)


def append_snapshot(snapshot: DataFrame, path: str) -> None:
    """A roster snapshot: endpoint, time, count, digest, payload and what the sync changed."""
    snapshot.select("endpoint", "fetched_at_ms", "camera_count", "digest", "payload", "diff_summary").write.mode("append").parquet(path)


def current_signatures(log: DataFrame, order: str = "detected_at_ms") -> DataFrame:
    """The signature table behind a log of emissions: one row per track."""
    return fold_signatures(log.drop("batch_id"), order)


def current_alerts(log: DataFrame) -> DataFrame:
    """The alert table behind a log of alert states: the last state written per alert."""
    newest = log.groupBy("alert_id").agg(
        F.max_by(F.struct(*[c for c in log.columns if c != "alert_id"]), "batch_id").alias("s"))
    return newest.select("alert_id", "s.*")


def _newest_compaction(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    try:
        tables = spark.read.parquet(f"{path}/compacted")
        found = (tables if before is None else tables.where(F.col("upto") < before)).agg(F.max("upto").alias("upto")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found["upto"]


def read_alerts(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The alert table: the newest compaction and the batches after it, folded.

    With ``before``, the table as it was before that batch; None if there was none.
    """
    upto = _newest_compaction(spark, path, before)
    try:
        log = read_log(spark, path)
    except AnalysisException as e:
        if before is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if before is not None:
        log = log.where(F.col("batch_id") < before)
    if upto is None:
        return current_alerts(log)
    base = spark.read.parquet(f"{path}/compacted/upto={upto}").select(*log.columns)
    return current_alerts(log.where(F.col("batch_id") > upto).unionByName(base))


def compact_alerts(spark: SparkSession, path: str) -> None:
    """Fold a log of alert states so far into one table, named after the last batch in it.

    Reads need that table and later batches only; partition pruning skips the folders of earlier ones, which
    may be deleted once no replay can rewrite them. Replaying a batch and compacting again gives the same.
    """
    last = read_log(spark, path).agg(F.max("batch_id").alias("b")).first()["b"]
    if last is None or last == _newest_compaction(spark, path):
        return
    read_alerts(spark, path).write.mode("overwrite").parquet(f"{path}/compacted/upto={last}")


def write_delimited(df: DataFrame, path: str) -> None:
    """Chosen fields, tab-separated, no header: for tools that read lines."""
    df.write.mode("overwrite").option("sep", "\t").option("header", False).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def detection_keys(detections: DataFrame, tracks: DataFrame) -> DataFrame:
    """Detections with the key of the track they belong to; ones outside any track keep none."""
    keys = tracks.select("camera_id", "segment", "tracker_id", "session", "track_id")
    return detections.join(keys, ["camera_id", "segment", "tracker_id", "session"], "left")
