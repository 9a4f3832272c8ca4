"""What changed, who changed it, and whether anything changed that never may."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators.sequence import stitched

POSITION = ["lat", "lng", "location_status", "location_uncertainty_m"]


def position_changes(versions: DataFrame, chunk_ms: int = 30 * 86_400_000) -> DataFrame:
    """An audit row per version of a camera: the values before and after, who and when."""
    known = stitched(
        versions, keys=["camera_id"], order=["at_ms", "version_no"], chunk=F.floor(F.col("at_ms") / chunk_ms),
        previous={f"__{c}": c for c in POSITION})
    before = F.struct(*[F.col(f"__{c}").alias(c) for c in POSITION])
    after = F.struct(*POSITION)
    return known.select(
        "actor", F.when(F.col("lat").isNull(), "camera.position.cleared").otherwise("camera.position.set").alias("action"),
        F.lit("camera").alias("entity"), F.col("camera_id").alias("entity_id"), "at_ms", "version_no",
        F.to_json(F.struct(before.alias("from"), after.alias("to")), {"ignoreNullFields": "false"}).alias("meta"))


def append_only_violations(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Rows of an append-only table that changed or vanished between two snapshots of it."""
    fields = [c for c in before.columns if c not in key]
    a = after.select(*[F.col(k).alias(f"__{k}") for k in key], F.struct(*fields).alias("__after"))
    same = None
    for k in key:
        part = before[k].eqNullSafe(a[f"__{k}"])
        same = part if same is None else same & part
    joined = before.withColumn("__before", F.struct(*fields)).join(a, same, "left")
    changed = ~F.col("__before").eqNullSafe(F.col("__after"))
    return joined.where(changed).select(
        *key, F.when(F.col(f"__{key[0]}").isNull(), "vanished").otherwise("changed").alias("violation"))


def immutable_violations(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows whose identity columns differ between two snapshots; other columns may change."""
    a = after.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = before.join(a, before[key] == a["__key"])
    bad = [F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in columns]
    return joined.select(key, F.explode(F.array_compact(F.array(*bad))).alias("changed_column"))


def compare_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows two results do not share, with how many more times each side has them. Empty means equal."""
    columns = a.columns
    signed = a.withColumn("__n", F.lit(1)).unionByName(b.select(*columns).withColumn("__n", F.lit(-1)))
    net = signed.groupBy(*columns).agg(F.sum("__n").alias("surplus")).where("surplus <> 0")
    return net.withColumn("only_in", F.when(F.col("surplus") > 0, "left").otherwise("right")).withColumn(
        "surplus", F.abs("surplus"))
