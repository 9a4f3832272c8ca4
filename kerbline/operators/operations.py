"""Stream health, pacing drift, evidence windows and place lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions import clock
from kerbline.functions.text import normal_district

# Fixed values.
MAX_DRIFT_SECONDS = 2.0
PRE_ROLL_MS, POST_ROLL_MS = 30_000, 30_000
MIN_IMPORTANCE = 0.15


def stream_health(health: DataFrame, cameras: DataFrame) -> DataFrame:
    """Latest measurement per camera next to what the registry claims."""
    latest = health.groupBy("camera_id").agg(
        F.max_by(F.struct(F.col("status").alias("measured_status"), "fps", "latency_ms", "observed_at_ms"),
                 F.struct("observed_at_ms", "event_id")).alias("h"), F.count("*").alias("checks"))
    claim = cameras.select("camera_id", F.col("status").alias("registry_status"), "status_source")
    return claim.join(latest, "camera_id", "left").select(
        "camera_id", "registry_status", "status_source", "h.measured_status", "h.fps", "h.latency_ms", "h.observed_at_ms",
        F.coalesce("checks", F.lit(0)).alias("checks"),
        (F.col("registry_status") == F.col("h.measured_status")).alias("claim_holds"))


def pacing_drift(states: DataFrame, max_drift_s: float = MAX_DRIFT_SECONDS) -> DataFrame:
    """How far each stream is from where its slot says it should be, the short way round its loop."""
    c = F.col
    loops = F.coalesce(c("duration_s") > 0, F.lit(False))
    elapsed = F.greatest(F.lit(0.0), (c("now_ms") - c("started_at_ms")) / 1000.0)
    raw = c("seeked_to") + elapsed
    actual = F.when(loops, raw % c("duration_s")).otherwise(raw)
    expected = clock.playback_position(c("now_ms"), c("duration_s"))
    apart = c("actual_s") - c("expected_s")
    drift = (
        F.when(loops & (apart > c("duration_s") / 2), apart - c("duration_s"))
        .when(loops & (apart < -c("duration_s") / 2), apart + c("duration_s")).otherwise(apart)
    )
    reported = states.withColumns({"actual_s": actual, "expected_s": expected}).withColumn("drift_s", drift)
    finite = ~F.isnan("drift_s") & (F.abs("drift_s") != float("inf"))
    return reported.withColumn("reseek", F.coalesce(finite & (F.abs("drift_s") > max_drift_s), F.lit(False)))


def evidence_windows(requests: DataFrame) -> DataFrame:
    """The footage an incident needs: some seconds before and after it; an empty window is refused."""
    start, end = F.col("start_ms") - PRE_ROLL_MS, F.col("end_ms") + POST_ROLL_MS
    return requests.withColumns({
        "from_ms": start, "to_ms": end, "duration_s": (end - start) / 1000.0,
        "window_error": F.when(end - start <= 0, "empty window"),
    })


def needed_segments(requests: DataFrame, segments: DataFrame, bucket_ms: int = 300_000) -> DataFrame:
    """(request, segment) for every ring segment overlapping a request's window on the same path.

    Both sides are cut into time buckets; a pair is reported in the first bucket they share.
    """
    c = F.col
    cut = lambda lo, hi: F.explode(F.sequence(F.floor(c(lo) / bucket_ms), F.floor(c(hi) / bucket_ms)))
    wanted = evidence_windows(requests).where(c("window_error").isNull()).select(
        "request_id", "path_name", "from_ms", "to_ms").withColumn("b", cut("from_ms", "to_ms"))
    held = segments.select("path_name", "segment_id", "segment_start_ms", "segment_end_ms").withColumn(
        "b", cut("segment_start_ms", "segment_end_ms"))
    overlap = (c("segment_start_ms") < c("to_ms")) & (c("segment_end_ms") > c("from_ms"))
    first_shared = c("b") == F.floor(F.greatest("from_ms", "segment_start_ms") / bucket_ms)
    return wanted.join(held, ["path_name", "b"]).where(overlap & first_shared).drop("b")


def choose_places(candidates: DataFrame) -> DataFrame:
    """One place per camera, or why not.

    Each query offers its most important result, which must be in the right district and important
    enough. The first query with an acceptable result wins; without one the last query's reason stands.
    """
    c = F.col
    importance = F.coalesce("importance", F.lit(0.0))
    best = candidates.withColumn("importance", importance).groupBy("label", "query_pos").agg(F.max_by(
        F.struct("result_pos", "importance", "state_district", "expected_district"),
        F.struct("importance", -c("result_pos"))).alias("r"))
    got, want = normal_district(c("r.state_district")), normal_district(c("r.expected_district"))
    reason = (
        F.when((c("r.expected_district") != "") & (got != "") & (want != "") & (got != want), "district mismatch")
        .when(c("r.importance") < MIN_IMPORTANCE, "importance below threshold")
    )
    judged = best.withColumn("reason", reason)
    ok = c("reason").isNull()
    return judged.groupBy("label").agg(
        F.min_by(F.struct("query_pos", "r.result_pos", "r.importance"), F.when(ok, c("query_pos"))).alias("hit"),
        F.max_by("reason", "query_pos").alias("last_reason"),
    ).select("label", c("hit.query_pos").alias("query_pos"), c("hit.result_pos").alias("result_pos"),
             c("hit.importance").alias("importance"),
             F.when(c("hit").isNull(), c("last_reason")).alias("reason"))
