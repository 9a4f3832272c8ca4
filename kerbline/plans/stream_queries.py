"""Streaming jobs run to completion over the given tables, checked against the batch answer."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.plans.alert_queries import FOLD_SQL, MATCH_SQL
from kerbline.plans.fixtures import DERIVED, SparkDialect
from kerbline.plans.index_queries import VECTOR_DIM
from kerbline.plans.registry import query
from kerbline.plans.track_queries import GAP_MS, GUARD_MS, IDLE_MS, INTERVAL_MS, SEGMENTS, SETTLE_MS, SESSIONS
from kerbline.session import checkpoint_dir
from kerbline.sources import sinks
from kerbline.streaming import pipeline, processors, stateful


def scratch(t) -> str:
    """A new folder for one run, where the cluster keeps its checkpoints."""
    return f"{checkpoint_dir(t.spark)}/kerbline-{uuid.uuid4().hex}"


def stream_of(t, base: str, derived: str) -> DataFrame:
    """A derived table over one given table, read as a stream."""
    # Written as a pattern, the path may be one file or a folder of them.
    rows = t.spark.readStream.schema(getattr(t, base).schema).option("maxFilesPerTrigger", 1).parquet(f"{t.sf_dir}/{base}.parque[t]")
    return t.sql(DERIVED[derived](SparkDialect), **{base: rows})


def finish(stream: DataFrame, folder: str) -> DataFrame:
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option(
        "path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


LANDINGS = 4


def landed(t, rows: DataFrame, part: Column, path: str) -> DataFrame:
    """``rows`` as files that land one after the other, by ``part`` (0 to LANDINGS - 1), read as a stream of one file at a time."""
    dealt = rows.withColumn("part", part)
    for k in range(LANDINGS):
        dealt.where(F.col("part") == k).drop("part").coalesce(1).write.parquet(f"{path}/part={k}")
    return t.spark.readStream.schema(dealt.schema).option("maxFilesPerTrigger", 1).parquet(path).drop("part")


def quarter(rows: DataFrame, by: str) -> Column:
    """Which of LANDINGS even stretches of ``by`` a row is in."""
    top = rows.agg(F.max(by)).first()[0] or 0
    return F.floor(F.col(by) * LANDINGS / F.lit(top + 1)).cast("int")


@query("stream_alert_fold", FOLD_SQL.replace("with s as (select *,", f"with s as (select *, seq * {LANDINGS} // (max(seq) over () + 1) as part,").replace(
    "count(*) as sightings\n", "count(*) as sightings, case when min(part) = max(part) then 'alert' else 'alert.updated' end as change\n"))
def alert_fold(t):
    """Sightings land one quarter after the other; state expires at once, so every update finds its alert in the table."""
    folder, rows = scratch(t), t.alert_sightings
    dealt = rows.withColumn("part", quarter(rows, "seq"))
    stream = t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in/part=*")
    for k in range(LANDINGS):
        # Started again, the query takes what has landed since as one micro-batch, however many files that is.
        dealt.where(F.col("part") == k).drop("part").write.parquet(f"{folder}/in/part={k}")
        q = pipeline.alert_stream(stream, out=f"{folder}/alerts", checkpoint=f"{folder}/checkpoint", ttl_ms=1, available_now=True)
        q.awaitTermination()
    return sinks.current_alerts(sinks.read_log(t.spark, f"{folder}/alerts")).drop("alert_id", "batch_id", "last_order", "since_order", "before")


@query("stream_frame_sampling", f"""
with recursive {SEGMENTS},
walk as (
  select camera_id, connection_id, segment, n, p0 + {INTERVAL_MS} as due, null::double as held_pts, null::bigint as held_seq,
    seq as out_seq, pts_ms as out_pts, seq as at_seq from framed where n = 1
  union all
  select w.camera_id, w.connection_id, w.segment, f.n,
    case when g.out_pts is null then w.due else greatest(w.due + {INTERVAL_MS}, f.p0 + (floor((g.out_pts - f.p0) / {INTERVAL_MS}) + 1) * {INTERVAL_MS}) end,
    case when g.out_pts is null then f.pts_ms end, case when g.out_pts is null then f.seq end, g.out_seq, g.out_pts, f.seq
  from walk w join framed f on f.camera_id = w.camera_id and f.connection_id = w.connection_id and f.segment = w.segment and f.n = w.n + 1,
  lateral (select case when f.pts_ms < w.due then null
      when w.held_pts is not null and abs(w.held_pts - w.due) < abs(f.pts_ms - w.due) then w.held_pts else f.pts_ms end as out_pts,
    case when f.pts_ms < w.due then null
      when w.held_pts is not null and abs(w.held_pts - w.due) < abs(f.pts_ms - w.due) then w.held_seq else f.seq end as out_seq) g),
r as (select camera_id, seq, min(case when arrival_ms - a0 >= {GUARD_MS} then arrival_ms - pts_ms end) over w as anchor_ms,
    max(arrival_ms - a0) over w as longest from framed window w as (partition by camera_id, connection_id, segment order by seq))
select w.camera_id, w.connection_id, w.segment, out_seq as seq, out_pts as pts_ms, anchor_ms + out_pts as absolute_ms,
  anchor_ms is not null and longest >= {GUARD_MS + SETTLE_MS} as anchor_settled, n = 1 as starts_segment, at_seq as emitted_at_seq
from walk w join r on r.camera_id = w.camera_id and r.seq = w.at_seq where out_pts is not null""")
def frame_sampling(t):
    """Frames land in several files and out of order; none is later than its connection's watermark."""
    folder = scratch(t)
    run_feed(t, landing(t.frames, late_ms=0), folder)
    return sinks.read_log(t.spark, f"{folder}/frames").drop("arrival_ms", "batch_id")


#: Every tenth frame lands this much after its time, within the delay; some land far behind it.
DISORDER_MS, DELAY_MS, LATE_MS, OVER_MS = 50_000_000, 100_000_000, 400_000_000, 2_000_000_000
RULE = processors.Sampling(INTERVAL_MS, GAP_MS, SETTLE_MS, GUARD_MS, DELAY_MS, OVER_MS)


def landing(frames: DataFrame, late_ms: int) -> DataFrame:
    """``frames`` with when they land."""
    behind = F.when(F.col("seq") % 97 == 41, late_ms).when(F.col("seq") % 10 == 3, DISORDER_MS).otherwise(0)
    return frames.withColumns({"landed": F.col("arrival_ms") + behind, "closes": F.lit(False)})


def run_feed(t, rows: DataFrame, folder: str) -> None:
    first, last = rows.agg(F.min("landed"), F.max("landed")).first()
    part = F.lit(0) if first is None else F.floor((F.col("landed") - first) * LANDINGS / F.lit(last - first + 1)).cast("int")
    stream = landed(t, rows, part, f"{folder}/in")
    closing = {"landed": F.lit(1e300), "closes": F.lit(True)}
    pipeline.to_end(stream, lambda s, at: pipeline.feed_stream(s, RULE, out=folder, checkpoint=at, available_now=True), folder, "camera", closing)


@query("stream_feed_events", f"""
with landings as (select *, arrival_ms + case when seq % 97 = 41 then {LATE_MS} when seq % 10 = 3 then {DISORDER_MS} else 0 end as landed from {{frames}}),
judged as (select *, coalesce(max(arrival_ms) over (partition by camera_id, connection_id order by landed rows between unbounded preceding and 1 preceding)
  - {DELAY_MS} > arrival_ms, false) as late from landings),
in_time as (select * from judged where not late),
{SEGMENTS.replace("{frames}", "in_time")},
firsts as (select camera_id, connection_id, min(seq) as seq, row_number() over (partition by camera_id order by min(seq)) as n from segs group by 1, 2)
select 'camera.loop' as kind, camera_id, connection_id, segment, seq from segs where discontinuity
union all select 'camera.reconnect', camera_id, connection_id, 0, seq from firsts where n > 1
union all select 'late', camera_id, connection_id, null, seq from judged where late""")
def feed_events(t):
    """The lifecycle events and the late rows of one pass over a feed that lands out of order, some of it far too late."""
    folder = scratch(t)
    run_feed(t, landing(t.frames, LATE_MS), folder)
    events = sinks.read_log(t.spark, f"{folder}/events").select("kind", "camera_id", "connection_id", "segment", "seq")
    late = sinks.read_log(t.spark, f"{folder}/late")
    return events.unionByName(late.select(F.lit("late").alias("kind"), "camera_id", "connection_id", F.lit(None).cast("bigint").alias("segment"), "seq"))


@query("stream_signature_cadence", f"""
with {SESSIONS}, un as (select *, (x1 + 1) / sqrt((x1 + 1) * (x1 + 1) + width_px * width_px) as u, width_px / sqrt((x1 + 1) * (x1 + 1) + width_px * width_px) as v from dn),
rn as (select *, avg(u) over w as mu, avg(v) over w as mv, first_value(recorded_ms) over w as started_ms, count(*) over p as n, max(recorded_ms) over p as ended_ms,
    first_value(seq) over (partition by camera_id, tracker_id, session order by width_px desc, seq) as best_crop from un
  window w as (partition by camera_id, tracker_id, session order by recorded_ms, seq), p as (partition by camera_id, tracker_id, session))
select camera_id, tracker_id, track_cls as cls, started_ms, recorded_ms, frame_no as frames_seen, true as provisional, round(mu / sqrt(mu * mu + mv * mv), 6) as first_component,
  null::bigint as best_crop from rn where track_cls <> 'person' and frame_no >= 4 and (frame_no - 4) % 12 = 0
union all select camera_id, tracker_id, track_cls, started_ms, ended_ms, n, false, round(mu / sqrt(mu * mu + mv * mv), 6), best_crop
from rn where track_cls <> 'person' and frame_no = n""")
def live_signature_cadence(t):
    """Detections land in several files; vehicles are identified while in view and when their track closes."""
    folder = scratch(t)
    vector = F.array((F.col("x1") + 1).cast("double"), F.col("width_px").cast("double"))
    rows = t.detections.select(
        "camera_id", "seq", "recorded_ms", "tracker_id", "cls", F.lit(False).alias("starts_segment"), vector.alias("embedding"), F.col("width_px").cast("double").alias("area"))
    closing = {"seq": F.lit((1 << 63) - 1), "recorded_ms": F.lit(0), "starts_segment": F.lit(True)}
    rule = processors.Identification(idle_ms=IDLE_MS)
    pipeline.to_end(landed(t, rows, quarter(rows, "seq"), f"{folder}/in"), lambda s, at: pipeline.signature_stream(
        s, rule, out=folder, checkpoint=at, available_now=True), folder, "tracks", closing)
    return sinks.read_log(t.spark, f"{folder}/signatures").select(
        "camera_id", "tracker_id", "cls", "started_ms", "recorded_ms", "frames_seen", "provisional", F.round(F.get("embedding", F.lit(0)), 6).alias("first_component"),
        F.when(~F.col("provisional"), F.get("crops", F.lit(0))).alias("best_crop"))


@query("stream_track_sessions", f"""
with {SESSIONS}, tr as (select camera_id, tracker_id, session, min(recorded_ms) as started_ms, max(recorded_ms) as ended_ms, count(*) as frame_count,
    max(track_cls) as cls from dn group by 1, 2, 3),
cam as (select camera_id, max(recorded_ms) as last_ms from {{detections}} group by 1)
select tr.camera_id, tracker_id, cls, started_ms, ended_ms, frame_count, cls <> 'person' as is_vehicle
from tr join cam on cam.camera_id = tr.camera_id where last_ms - ended_ms > {IDLE_MS}""")
def track_sessions(t):
    rows = stream_of(t, "events", "detections").withColumn("starts_segment", F.lit(False))
    return finish(stateful.closed_tracks(rows, IDLE_MS), scratch(t))


@query("stream_track_sessions_to_end", f"""
with {SESSIONS} select camera_id, tracker_id, max(track_cls) as cls, min(recorded_ms) as started_ms, max(recorded_ms) as ended_ms, count(*) as frame_count,
  max(track_cls) <> 'person' as is_vehicle from dn group by camera_id, tracker_id, session""")
def track_sessions_to_end(t):
    """The same feed closed at its end: no track is left open."""
    rows = stream_of(t, "events", "detections").withColumn("starts_segment", F.lit(False))
    return stateful.tracks_to_end(rows, scratch(t), IDLE_MS)


@query("stream_watchlist_match", MATCH_SQL)
def watchlist_match(t):
    """Signature events are landed as JSON lines, read back as a stream, validated and matched."""
    from kerbline.operators import watchlist

    folder = scratch(t)
    events = t.signatures.select(
        F.lit("signature.created").alias("type"), F.col("track_id").alias("event_id"), "camera_id", F.lit("").alias("camera_label"),
        "track_id", "cls", "colour", F.lit(0.5).alias("colour_confidence"), "colour_uncertain", "partial_plate", "embedding",
        "embedding_model", F.col("recorded_ms").cast("double").alias("recorded_at_ms"), F.col("recorded_ms").cast("double").alias("detected_at_ms"))
    events.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(f"{folder}/events")
    live = pipeline.Watchlist(lambda: (watchlist.active_targets(t.watchlist_entries, t.watchlists), t.watchlist_views))
    q = pipeline.match_stream(pipeline.signature_files(t.spark, f"{folder}/events"), live, dim=VECTOR_DIM, out=folder,
                              checkpoint=f"{folder}/checkpoint", available_now=True)
    q.awaitTermination()
    return sinks.read_log(t.spark, f"{folder}/matches").select(
        "track_id", "entry_id", "priority", "matched_via", "repaired", "source", "confidence")


@query("stream_watchlist_match_bus", MATCH_SQL)
def watchlist_match_bus(t):
    """The same, with events as the producer writes them: every field text, in several files and batches."""
    from kerbline.operators import watchlist
    from kerbline.sources import contracts

    folder = scratch(t)
    ms = F.col("recorded_ms").cast("double")
    rows = t.signatures.withColumns({
        "camera_label": F.lit(""), "colour_confidence": F.lit(0.5), "recorded_at_ms": ms, "detected_at_ms": ms})
    fields = contracts.signature_fields(rows, decimals=15)
    fields.repartition(3, "track_id").select(F.to_json(F.struct("*")).alias("value")).write.text(f"{folder}/events")
    live = pipeline.Watchlist(lambda: (watchlist.active_targets(t.watchlist_entries, t.watchlists), t.watchlist_views))
    q = pipeline.match_stream(pipeline.signature_files(t.spark, f"{folder}/events"), live, dim=VECTOR_DIM, out=folder,
                              checkpoint=f"{folder}/checkpoint", available_now=True)
    q.awaitTermination()
    return sinks.read_log(t.spark, f"{folder}/matches").select(
        "track_id", "entry_id", "priority", "matched_via", "repaired", "source", "confidence")


@query("alert_log_compaction", FOLD_SQL)
def alert_log_compaction(t):
    """The alert table of a log that was compacted, replayed and compacted again."""
    folder = scratch(t)
    states = pipeline.fold_state(t.alert_sightings)
    for batch in (0, 1, 1):  # the second batch is replayed
        sinks.write_batch(states, f"{folder}/alerts", batch)
        sinks.compact_alerts(t.spark, f"{folder}/alerts")
    sinks.compact_alerts(t.spark, f"{folder}/alerts")
    return sinks.read_alerts(t.spark, f"{folder}/alerts").drop("alert_id", "batch_id", "change")
