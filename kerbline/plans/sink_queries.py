"""Sinks and hooks, run over the given tables: written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.operators import frames, reconcile, signatures, tracks
from kerbline.plans.registry import query
from kerbline.plans.stream_queries import scratch, stream_of
from kerbline.plans.track_queries import SEGMENTS, SESSIONS, segments, sessions
from kerbline.sources import contracts, sinks
from kerbline.streaming import pipeline


@query("sink_index_by_day", """
select strftime(make_timestamp(recorded_ms * 1000), '%Y-%m-%d') as day, camera_id, count(*) as detections, max(confidence) as best
from {detections} group by 1, 2""")
def index_by_day(t):
    folder = scratch(t)
    sinks.write_by_day(t.detections, f"{folder}/detections")
    back = t.spark.read.parquet(f"{folder}/detections")
    return back.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "camera_id").agg(
        F.count("*").alias("detections"), F.max("confidence").alias("best"))


@query("sink_detection_track_keys", f"""
with {SESSIONS} select camera_id, tracker_id, cast(session as bigint) as session, count(*) as detections, 1 as tracks from dn group by 1, 2, 3""")
def detection_keys(t):
    s = sessions(t)
    keyed = sinks.detection_keys(s, tracks.build_tracks(s))
    per_track = keyed.groupBy("track_id").agg(
        F.count("*").alias("detections"), F.first("camera_id").alias("camera_id"), F.first("tracker_id").alias("tracker_id"),
        F.first("session").alias("session"), F.size(F.array_distinct(F.array(F.min("session"), F.max("session")))).alias("tracks"))
    return per_track.drop("track_id")


@query("sink_roster_snapshots", """
with r as (select endpoint, label, '{"codec":' || coalesce(to_json(codec)::varchar, 'null') || ',"label":' || to_json(label)::varchar || '}' as x
  from (select 'old' as endpoint, label, codec from {roster_old} union all select 'new', label, codec from {roster_new}) u),
b as (select endpoint, substr(sha256(label), 1, 3) as k, count(*) as n, sha256(array_to_string(list_sort(list(sha256(x))), ',')) as h from r group by 1, 2),
d as (select endpoint, cast(sum(n) as bigint) as camera_count, sha256(array_to_string(list_sort(list(h)), ',')) as digest from b group by 1)
select endpoint, nth as fetched_at_ms, camera_count, digest, false as roster_changed_again from d, (select unnest([1::bigint, 2::bigint]) as nth) x""")
def roster_snapshots(t):
    """Two syncs of an unchanged roster: the second is recognised as such."""
    folder = scratch(t)
    both = t.roster_old.select(F.lit("old").alias("endpoint"), "label", "codec").unionByName(
        t.roster_new.select(F.lit("new").alias("endpoint"), "label", "codec"))
    digests = reconcile.roster_digest(both, ["endpoint"])
    for at in (1, 2):
        sinks.append_snapshot(digests.withColumns({
            "fetched_at_ms": F.lit(at).cast("bigint"), "payload": F.lit("{}"), "diff_summary": F.lit("")}), f"{folder}/snapshots")
    changes = reconcile.snapshot_changes(t.spark.read.parquet(f"{folder}/snapshots"))
    return changes.select("endpoint", "fetched_at_ms", "camera_count", "digest",
                          ((F.col("fetched_at_ms") > 1) & F.col("roster_changed")).alias("roster_changed_again"))


@query("sink_delimited_export", """
select camera_id, label, coalesce(district, '') as district, cast(location_uncertainty_m as string) as uncertainty from {cameras}""")
def delimited_export(t):
    from kerbline.operators.registry import export_fields

    folder = scratch(t)
    rows = export_fields(t.cameras, ["camera_id", "label", "district", "location_uncertainty_m"])
    sinks.write_delimited(rows, f"{folder}/cameras")
    back = t.spark.read.schema("camera_id string, label string, district string, uncertainty string").option("sep", "\t").csv(f"{folder}/cameras")
    return back.fillna("", ["district"])


@query("sink_json_export", """
select camera_id, status, lat is null as unplaced from {cameras}""")
def json_export(t):
    folder = scratch(t)
    sinks.write_json(t.cameras, f"{folder}/cameras")
    return t.spark.read.schema(t.cameras.schema).json(f"{folder}/cameras").select("camera_id", "status", F.col("lat").isNull().alias("unplaced"))


@query("sink_loop_events", f"with {SEGMENTS} select 'camera.loop' as kind, camera_id, seq from segs where discontinuity")
def loop_events(t):
    folder = scratch(t)
    sinks.append_events(frames.loop_events(segments(t)), f"{folder}/events")
    return t.spark.read.parquet(f"{folder}/events").select("kind", "camera_id", "seq")


@query("signature_bus_fields", """
select track_id, track_id || ':' || cast(recorded_ms as string) as event_id, cls, colour, colour_uncertain, partial_plate,
  round_even(embedding[1], 5) as first_component, 64::int as dims from {signatures}""")
def bus_fields(t):
    rows = t.signatures.withColumns({
        "camera_label": F.lit("l"), "colour_confidence": F.lit(0.25), "recorded_at_ms": F.col("recorded_ms"), "detected_at_ms": F.col("recorded_ms")})
    back = contracts.parse_signature_fields(contracts.signature_fields(rows))
    return back.select("track_id", "event_id", "cls", "colour", "colour_uncertain", "partial_plate",
                       F.element_at("embedding", 1).alias("first_component"), F.size("embedding").alias("dims"))


@query("detections_kept_classes", """
select cls, count(*) as n, count(*) filter (where width_px * 0.25 >= 90) as plate_readable
from {detections} where cls in ('car', 'motorcycle', 'bus', 'truck', 'bicycle', 'person') group by 1""")
def kept_classes(t):
    readable = signatures.plate_worth_reading(F.col("width_px"))
    return tracks.kept_detections(t.detections).groupBy("cls").agg(
        F.count("*").alias("n"), F.count_if(readable).alias("plate_readable"))


@query("hook_plate_reader", """
select read_id, case when (100 + read_id * 31 % 600) * 0.25 >= 90 then upper(raw_ocr) end as partial_plate from {plate_reads}""")
def plate_reader(t):
    crops = t.plate_reads.select("read_id", F.col("raw_ocr").alias("image"), (100 + F.col("read_id") * 31 % 600).alias("width"))
    return signatures.read_plates(crops, upper_text).select("read_id", "partial_plate")


def upper_text(images):
    return images.str.upper()


@query("hook_embedder", "select read_id, [length(raw_ocr)::double, 1e0][1] as first_component from {plate_reads}")
def embedder(t):
    crops = t.plate_reads.select("read_id", F.col("raw_ocr").alias("image"))
    return signatures.embed_crops(crops, length_vector).select("read_id", F.element_at("embedding", 1).alias("first_component"))


def length_vector(images):
    return images.str.len().map(lambda n: [float(n), 1.0])


@query("stream_live_counters", """
with f as (select track_id, entry_id, arg_min(pipeline_latency_ms, seq) as v from {alert_sightings} group by 1, 2),
s as (select v, row_number() over (order by v) - 1 as i, count(*) over () as n from f)
select (select count(*) from {alert_sightings}) as processed, max(n) as raised,
  max(case when i = cast(floor(n * 0.5) as bigint) then v end) as p50, max(case when i = cast(floor(n * 0.95) as bigint) then v end) as p95 from s""")
def live_counters(t):
    folder = scratch(t)
    q = pipeline.fold_stream(stream_of(t, "orders", "alert_sightings"), out=f"{folder}/alerts", checkpoint=f"{folder}/checkpoint",
                             available_now=True)
    q.awaitTermination()
    processed = t.orders.agg(F.count("*").alias("processed"))
    return pipeline.live_counters(sinks.read_log(t.spark, f"{folder}/alerts"), processed)
