"""Reading the index: signature search, summaries, filter values and the alert lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Alert priorities from most to least urgent.
PRIORITIES = ["critical", "high", "medium", "low"]
DEFAULT_PAGE, MAX_PAGE = 100, 500


def matching_signatures(
    signatures: DataFrame, tracks: DataFrame, cameras: DataFrame, *, cls: str = "", colour: str = "",
    camera_id: str = "", plate: str = "",
) -> DataFrame:
    """Every hit of a search, as the result list shows it. Empty filters mean no filter."""
    s, t = signatures, tracks
    if cls:
        s = s.where(F.col("cls") == cls)
    if colour:
        s = s.where(F.col("colour") == colour)
    if plate:
        s = s.where(F.col("partial_plate").contains("".join(plate.upper().split())))
    if camera_id:
        t = t.where(F.col("camera_id") == camera_id)
    size = F.col("embedding_size") if "embedding_size" in s.columns else F.size("embedding")
    hits = s.select("track_id", "cls", "colour", "colour_confidence", "colour_uncertain", "partial_plate",
                    (size > 0).alias("has_embedding"))
    seen = t.select("track_id", "camera_id", F.col("started_ms").alias("first_seen_ms"),
                    F.coalesce("ended_ms", "started_ms").alias("last_seen_ms"), "frame_count")
    where = cameras.select("camera_id", F.col("label").alias("camera_label"), "district")
    return hits.join(seen, "track_id").join(where, "camera_id")


def search_page(hits: DataFrame, limit: int | None = None) -> DataFrame:
    size = min(limit or DEFAULT_PAGE, MAX_PAGE)
    return hits.orderBy(F.desc("first_seen_ms"), "track_id").limit(size)


def search_total(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("total"))


def index_totals(detections: DataFrame, tracks: DataFrame, signatures: DataFrame) -> DataFrame:
    """One row. Each table is reduced to one partial row per task before anything moves."""
    none = F.lit(None).cast("bigint")
    d = detections.agg(F.count("*").alias("n")).select(F.lit("detections").alias("k"), "n", none.alias("lo"), none.alias("hi"))
    by_camera = tracks.groupBy("camera_id").agg(
        F.count("*").alias("n"), F.min("started_ms").alias("lo"), F.max("ended_ms").alias("hi")
    )
    t = by_camera.agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("camera_id").alias("c"))
    s = signatures.agg(F.count("*").alias("n")).select(F.lit("signatures").alias("k"), "n", none.alias("lo"), none.alias("hi"))
    t_row = t.select(F.lit("tracks").alias("k"), F.coalesce("n", F.lit(0)).alias("n"), "lo", "hi", "c")
    rows = t_row.unionByName(d, allowMissingColumns=True).unionByName(s, allowMissingColumns=True)
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("n")))
    return rows.agg(
        pick("detections").alias("detections"), pick("tracks").alias("tracks"), pick("signatures").alias("signatures"),
        F.max("c").alias("cameras"), F.max("lo").alias("earliest_ms"), F.max("hi").alias("latest_ms"),
    )


def tracks_by_class(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("cls").agg(F.count("*").alias("tracks")).orderBy(F.desc("tracks"), "cls")


def tracks_by_camera(tracks: DataFrame, cameras: DataFrame) -> DataFrame:
    counted = tracks.groupBy("camera_id").agg(F.count("*").alias("tracks"))
    named = counted.join(cameras.select("camera_id", "label", "name"), "camera_id", "left")
    return named.select(
        "camera_id", F.coalesce("label", "camera_id").alias("label"), F.coalesce("name", "camera_id").alias("name"), "tracks"
    ).orderBy(F.desc("tracks"), "camera_id")


def available_filters(signatures: DataFrame, tracks: DataFrame, cameras: DataFrame) -> DataFrame:
    """Values a search can filter by: (kind, value, label)."""
    values = lambda kind, col: (
        signatures.where(F.coalesce(F.col(col), F.lit("")) != "").select(F.lit(kind).alias("kind"), F.col(col).alias("value")).distinct()
        .withColumn("label", F.col("value"))
    )
    seen = cameras.join(tracks.select("camera_id").distinct(), "camera_id", "left_semi").select(
        F.lit("camera").alias("kind"), F.col("camera_id").alias("value"), "label"
    )
    return values("class", "cls").unionByName(values("colour", "colour")).unionByName(seen).orderBy("kind", "label")


def alerts_at_cameras(alerts: DataFrame, cameras: DataFrame) -> DataFrame:
    return alerts.join(
        cameras.select("camera_id", F.col("label").alias("camera_label"), F.col("name").alias("camera_name")), "camera_id"
    )


def recent_alerts(alerts: DataFrame, cameras: DataFrame, limit: int = 50) -> DataFrame:
    """Newest first. The limit applies before the camera names are looked up."""
    known = alerts.join(cameras.select("camera_id"), "camera_id", "left_semi")
    newest = known.orderBy(F.desc("created_ms"), "alert_id").limit(limit)
    return alerts_at_cameras(newest, cameras)


def triage_order(alerts: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority")) - 1
    return alerts.withColumn("priority_rank", rank.cast("int")).orderBy("status", "priority_rank", F.desc("recorded_ms"), "alert_id")


def alert_feed(messages: DataFrame, limit: int = 100) -> DataFrame:
    """Newest first, as many as the feed shows. A repeated alert id is ignored: its first message stays."""
    first = messages.groupBy("alert_id").agg(
        F.min_by(F.struct(*[c for c in messages.columns if c != "alert_id"]), F.col("created_ms")).alias("m")
    )
    return first.select("alert_id", "m.*").orderBy(F.desc("created_ms"), "alert_id").limit(limit)
