"""Detections to tracks: sessions per tracker, what each track amounts to, when it is identified."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.operators.sequence import stitched
from kerbline.session import cut_lineage

# Fixed values.
VEHICLE_CLASSES = ["car", "motorcycle", "bus", "truck", "bicycle"]
KEPT_CLASSES = [*VEHICLE_CLASSES, "person"]
IDLE_CLOSE_MS = 2_000
EARLY_SIGNATURE_FRAMES, RESIGNATURE_EVERY = 4, 12
MAX_CROPS = 8
CHUNK_MS = 3_600_000

TRACKER = ["camera_id", "segment", "tracker_id"]


def kept_detections(detections: DataFrame) -> DataFrame:
    return detections.where(F.col("cls").isin(KEPT_CLASSES))


def track_sessions(
    detections: DataFrame, frames: DataFrame | None = None, *, idle_ms: float = IDLE_CLOSE_MS, chunk_ms: int = CHUNK_MS
) -> DataFrame:
    """Add session, the detection's number within it, and the session's class (its first detection's).

    A track closes when some frame of its camera comes more than ``idle_ms`` after its last sight.
    The frame in which it reappears does not count: it is updated before it could be closed. So the
    test is on the camera's last frame before the reappearance. ``frames`` (camera_id, segment,
    frame_seq, recorded_ms) lists every frame; without it the detections' own frames are used.
    Detections without a tracker id belong to no track.
    """
    c = F.col
    # Recordings without breaks are one segment: a constant would only widen the keys.
    segment = ["segment"] if "segment" in detections.columns else []
    feed, tracker = ["camera_id", *segment], ["camera_id", *segment, "tracker_id"]
    if frames is None:
        frames = detections.groupBy(*feed, c("seq").alias("frame_seq")).agg(F.min("recorded_ms").alias("recorded_ms"))
    chunk = F.floor(c("recorded_ms") / chunk_ms)
    before = stitched(
        frames, keys=feed, order=["recorded_ms", "frame_seq"], chunk=chunk, previous={"prev_frame_ms": "recorded_ms"},
    ).select(*feed, c("frame_seq").alias("seq"), "prev_frame_ms")
    tracked = cut_lineage(detections.where(c("tracker_id").isNotNull()).join(before, [*feed, "seq"], "left"))
    seen = stitched(
        tracked, keys=tracker, order=["recorded_ms", "seq"], chunk=chunk,
        previous={"prev_ms": "recorded_ms"}, running_sum={"__n": F.lit(1).cast("bigint")},
    )
    opens = c("prev_ms").isNull() | (c("prev_frame_ms") - c("prev_ms") > idle_ms)
    marked = cut_lineage(seen.withColumn("opens_track", F.coalesce(opens, F.lit(False))))
    first = F.when(c("opens_track"), F.struct("__n", "cls"))
    numbered = stitched(
        marked, keys=tracker, order=["recorded_ms", "seq"], chunk=chunk,
        running_sum={"session": c("opens_track").cast("bigint")}, running_last={"__open": first},
    )
    opened = F.coalesce(F.when(c("opens_track"), F.struct("__n", "cls")), c("__open"))
    out = numbered.withColumns({
        "frame_no": c("__n") - opened["__n"] + 1, "track_cls": opened["cls"],
    }).drop("__n", "__open", "prev_frame_ms", "prev_ms")
    return out if segment else out.withColumn("segment", F.lit(0))


def track_id(camera, segment, tracker, session):
    """Deterministic, so a rerun writes the same tracks."""
    return F.concat(F.lit("c"), F.substring(F.sha2(F.concat_ws("|", camera, segment, tracker, session), 256), 1, 24))


def build_tracks(sessions: DataFrame) -> DataFrame:
    """One row per track; partial results merge before the shuffle."""
    out = sessions.groupBy(*TRACKER, "session").agg(
        F.min("recorded_ms").alias("started_ms"), F.max("recorded_ms").alias("ended_ms"),
        F.count("*").alias("frame_count"), F.max("track_cls").alias("cls"),
    )
    return out.withColumn("track_id", track_id("camera_id", "segment", "tracker_id", "session"))


def signature_moments(sessions: DataFrame, tracks: DataFrame) -> DataFrame:
    """When each vehicle is identified: at the 4th frame, every 12 after that, and once at close."""
    due = (F.col("frame_no") >= EARLY_SIGNATURE_FRAMES) & (
        (F.col("frame_no") - EARLY_SIGNATURE_FRAMES) % RESIGNATURE_EVERY == 0)
    provisional = sessions.where(F.col("track_cls").isin(VEHICLE_CLASSES) & due).select(
        *TRACKER, "session", F.col("frame_no").alias("frames_seen"), "recorded_ms", F.lit(True).alias("provisional"))
    closing = tracks.where(F.col("cls").isin(VEHICLE_CLASSES)).select(
        *TRACKER, "session", F.col("frame_count").alias("frames_seen"), F.col("ended_ms").alias("recorded_ms"),
        F.lit(False).alias("provisional"))
    return provisional.unionByName(closing)


def best_crops(crops: DataFrame, *, keys: list[str], area: str, order: str, keep: int = MAX_CROPS) -> DataFrame:
    """The largest crops of each track. Spark keeps only ``keep`` per track before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(area), order)
    return crops.withColumn("crop_rank", F.row_number().over(w)).where(F.col("crop_rank") <= keep)


def fold_signatures(emissions: DataFrame, order: str) -> DataFrame:
    """One signature per track: the last emission wins, but a plate once read is not lost."""
    kept = [c for c in emissions.columns if c not in ("track_id", "partial_plate", order)]
    return emissions.groupBy("track_id").agg(
        F.max_by(F.struct(*kept), order).alias("s"),
        F.max_by("partial_plate", F.when(F.col("partial_plate").isNotNull(), F.col(order))).alias("partial_plate"),
    ).select("track_id", "s.*", "partial_plate")
