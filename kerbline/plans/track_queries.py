"""Frames, clocks, tracks and signature cadence."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.operators import frames, tracks
from kerbline.plans.registry import query

# The derived feeds tick in hours, so limits are scaled to them.
GAP_MS, INTERVAL_MS, SETTLE_MS, GUARD_MS, CHUNK = 10_800_000, 3_600_000, 14_400_000, 3_600_000, 2_000

SEGMENTS = f"""
lagged as (select *, lag(pts_ms) over w as prev, lag(pts_ms, 2) over w as prev2 from {{frames}}
  window w as (partition by camera_id, connection_id order by seq)),
flagged as (select *, coalesce(pts_ms < prev or pts_ms - prev > {GAP_MS}, false) as pts_jump,
    prev is not null and (coalesce(pts_ms < prev or pts_ms - prev > {GAP_MS}, false) or scene_cut or clock_backwards) as discontinuity from lagged),
segs as (select *, cast(sum(case when discontinuity then 1 else 0 end) over (partition by camera_id, connection_id order by seq) as bigint) as segment
  from flagged),
framed as (select *, row_number() over w as n, first_value(pts_ms) over w as p0, first_value(arrival_ms) over w as a0 from segs
  window w as (partition by camera_id, connection_id, segment order by seq))"""


def segments(t):
    return frames.mark_segments(t.frames, max_forward_gap_ms=GAP_MS, chunk_seq=CHUNK)


@query("frame_segments", f"with {SEGMENTS} select camera_id, connection_id, seq, pts_jump, discontinuity, segment from segs")
def frame_segments(t):
    return segments(t).select("camera_id", "connection_id", "seq", "pts_jump", "discontinuity", "segment")


@query("frame_loop_events", f"""
with {SEGMENTS} select 'camera.loop' as kind, camera_id, seq, segment from segs where discontinuity""")
def loop_events(t):
    return frames.loop_events(segments(t)).select(
        "kind", "camera_id", "seq", F.get_json_object("payload", "$.segment").cast("bigint").alias("segment"))


@query("frame_running_anchor", f"""
with {SEGMENTS}, r as (select *, min(case when arrival_ms - a0 >= {GUARD_MS} then arrival_ms - pts_ms end) over w as anchor_ms,
    max(arrival_ms - a0) over w as longest from framed window w as (partition by camera_id, connection_id, segment order by seq))
select camera_id, seq, anchor_ms, anchor_ms + pts_ms as absolute_ms,
  anchor_ms is not null and longest >= {GUARD_MS + SETTLE_MS} as anchor_settled from r""")
def running_anchor(t):
    out = frames.anchor_clock(segments(t), settle_ms=SETTLE_MS, burst_guard_ms=GUARD_MS, chunk_seq=CHUNK)
    return out.select("camera_id", "seq", "anchor_ms", "absolute_ms", "anchor_settled")


@query("frame_segment_anchors", f"""
with {SEGMENTS} select camera_id, connection_id, segment, count(*) as frames,
  min(case when arrival_ms - a0 >= {GUARD_MS} then arrival_ms - pts_ms end) as anchor_ms,
  min(case when arrival_ms - a0 >= {GUARD_MS} then arrival_ms - pts_ms end) is not null
    and max(arrival_ms - a0) >= {GUARD_MS + SETTLE_MS} as anchor_settled
from framed group by 1, 2, 3""")
def segment_anchors(t):
    return frames.segment_anchors(segments(t), settle_ms=SETTLE_MS, burst_guard_ms=GUARD_MS)


@query("frame_grid_sampling", f"""
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
      when w.held_pts is not null and abs(w.held_pts - w.due) < abs(f.pts_ms - w.due) then w.held_seq else f.seq end as out_seq) g)
select camera_id, connection_id, segment, out_seq as seq, out_pts as pts_ms, at_seq as emitted_at_seq from walk where out_pts is not null""")
def grid_sampling(t):
    out = frames.sample_on_grid(segments(t), INTERVAL_MS, chunk_seq=CHUNK)
    return out.select("camera_id", "connection_id", "segment", "seq", "pts_ms", "emitted_at_seq")


OBSERVATIONS = """select camera_id, connection_id, segment, pts_ms, cast(seq % 1920 as double) as x, cast(seq * 7 % 1080 as double) as y, seq"""


@query("frame_rolling_velocity", f"""
with {SEGMENTS}, o as ({OBSERVATIONS} from segs),
w as (select *, count(*) over r as n, first_value(x) over r as fx, first_value(y) over r as fy, first_value(pts_ms) over r as ft,
    lag(x) over p as lx, lag(y) over p as ly, lag(pts_ms) over p as lt from o
  window r as (partition by camera_id, connection_id, segment order by pts_ms range between 7200000 preceding and current row),
    p as (partition by camera_id, connection_id, segment order by pts_ms)),
e as (select *, (pts_ms - case when n >= 2 then ft else lt end) / 1e3 as dt, x - case when n >= 2 then fx else lx end as dx,
  y - case when n >= 2 then fy else ly end as dy from w)
select seq, case when dt > 0 then round(dx / dt, 9) end as vx, case when dt > 0 then round(dy / dt, 9) end as vy,
  case when dt > 0 then round(sqrt(dx * dx + dy * dy) / dt, 9) end as speed, case when dt > 0 then greatest(n, 2) end as samples from e""")
def velocity(t):
    obs = segments(t).selectExpr(
        "camera_id", "connection_id", "segment", "pts_ms", "cast(seq % 1920 as double) x", "cast(seq * 7 % 1080 as double) y", "seq")
    out = frames.rolling_velocity(obs, keys=["camera_id", "connection_id", "segment"], window_ms=7_200_000, chunk_ms=28_800_000)
    r = lambda c: F.round(c, 9).alias(c)
    return out.select("seq", r("vx"), r("vy"), r("speed"), "samples")


DRIFT = """
f as (select camera_id, count(*) as anchor_count, max(position_s) - min(position_s) as span_s, regr_slope(offset_s, position_s) as b,
    regr_intercept(offset_s, position_s) as a, arg_min(offset_s, position_s * 1e6 + measured_seq) as o0, min(position_s) as p0
  from {time_sync} group by 1),
m as (select camera_id, anchor_count, span_s, case when anchor_count = 1 then 'single_anchor' when span_s < 20000 then 'global_default' else 'fitted' end as source,
    case when anchor_count = 1 or span_s < 20000 then 0.005139 else b end as drift_rate,
    case when anchor_count = 1 or span_s < 20000 then o0 - 0.005139 * p0 else a end as offset_s from f)"""


@query("clock_drift_models", f"""
with {DRIFT} select m.camera_id, anchor_count, span_s, source, round(drift_rate, 9) as drift_rate, round(m.offset_s, 6) as offset_s,
  case when source = 'fitted' then (select round(max(abs(t.offset_s - (m.offset_s + m.drift_rate * t.position_s))), 6)
    from {{time_sync}} t where t.camera_id = m.camera_id) end as max_residual_s from m""")
def drift_models(t):
    out = frames.fit_drift(t.time_sync)
    return out.select("camera_id", "anchor_count", "span_s", "source", F.round("drift_rate", 9).alias("drift_rate"),
                      F.round("offset_s", 6).alias("offset_s"), F.round("max_residual_s", 6).alias("max_residual_s"))


@query("clock_recorded_time", f"""
with {DRIFT} select fr.camera_id, fr.seq, 1781364600000 + fr.pts_ms as slot_time_ms, coalesce(m.source, 'global_default') as drift_source,
  round(1781364600000 + (fr.pts_ms / 1e3 + coalesce(m.offset_s, 0) + coalesce(m.drift_rate, 0.005139) * fr.pts_ms / 1e3) * 1000) as recorded_ms
from {{frames}} fr left join m on m.camera_id = fr.camera_id""")
def recorded_time(t):
    out = frames.apply_clock(t.frames, frames.fit_drift(t.time_sync), live=False)
    return out.select("camera_id", "seq", F.round("slot_time_ms", 2).alias("slot_time_ms"), "drift_source",
                      F.round("recorded_ms").alias("recorded_ms"))


@query("clock_live_recorded_time", f"""
with {SEGMENTS}, {DRIFT}, r as (select *, min(case when arrival_ms - a0 >= {GUARD_MS} then arrival_ms - pts_ms end) over w as anchor_ms from framed
  window w as (partition by camera_id, connection_id, segment order by seq)),
p as (select *, coalesce(((anchor_ms + pts_ms) / 1e3 + 19800 - 32400) % 43200, pts_ms / 1e3) as pos from r)
select p.camera_id, p.seq, anchor_ms is not null as anchored, round(pos, 3) as position_s, coalesce(m.source, 'global_default') as drift_source,
  round(1781364600000 + (pos + coalesce(m.offset_s, 0) + coalesce(m.drift_rate, 0.005139) * pos) * 1000) as recorded_ms
from p left join m on m.camera_id = p.camera_id""")
def live_recorded_time(t):
    anchored = frames.anchor_clock(segments(t), settle_ms=SETTLE_MS, burst_guard_ms=GUARD_MS, chunk_seq=CHUNK)
    out = frames.apply_clock(anchored, frames.fit_drift(t.time_sync), live=True)
    return out.select("camera_id", "seq", F.col("anchor_ms").isNotNull().alias("anchored"), "drift_source",
                      F.round("position_s", 3).alias("position_s"), F.round("recorded_ms").alias("recorded_ms"))


IDLE_MS, TRACK_CHUNK_MS = 21_600_000, 172_800_000
SESSIONS = f"""
fr as (select camera_id, seq, lag(recorded_ms) over (partition by camera_id order by recorded_ms, seq) as prev_frame from {{detections}}),
dl as (select d.*, prev_frame, lag(recorded_ms) over (partition by d.camera_id, tracker_id order by recorded_ms, d.seq) as prev_ms
  from {{detections}} d join fr on fr.camera_id = d.camera_id and fr.seq = d.seq),
ds as (select *, sum(case when prev_ms is null or prev_frame - prev_ms > {IDLE_MS} then 1 else 0 end)
  over (partition by camera_id, tracker_id order by recorded_ms, seq) as session from dl),
dn as (select *, row_number() over (partition by camera_id, tracker_id, session order by recorded_ms, seq) as frame_no,
  first_value(cls) over (partition by camera_id, tracker_id, session order by recorded_ms, seq) as track_cls from ds)"""


def sessions(t):
    return tracks.track_sessions(tracks.kept_detections(t.detections), idle_ms=IDLE_MS, chunk_ms=TRACK_CHUNK_MS)


@query("track_sessions", f"""
with {SESSIONS} select camera_id, tracker_id, seq, cast(session as bigint) as session, frame_no, track_cls from dn""")
def track_sessions(t):
    return sessions(t).select("camera_id", "tracker_id", "seq", "session", "frame_no", "track_cls")


@query("track_building", f"""
with {SESSIONS} select camera_id, tracker_id, cast(session as bigint) as session, min(recorded_ms) as started_ms, max(recorded_ms) as ended_ms,
  count(*) as frame_count, max(track_cls) as cls from dn group by 1, 2, 3""")
def track_building(t):
    return tracks.build_tracks(sessions(t)).drop("track_id", "segment")


@query("track_building_bulk", """
select camera_id, tracker_id, count(*) as frame_count, min(recorded_ms) as started_ms, max(recorded_ms) as ended_ms,
  arg_min(cls, recorded_ms * 10 + seq) as cls from {bulk_detections} group by 1, 2""")
def track_building_bulk(t):
    # One tracker of one camera here is one track, whatever the gaps: only the aggregation is at work.
    d = t.bulk_detections
    return d.groupBy("camera_id", "tracker_id").agg(
        F.count("*").alias("frame_count"), F.min("recorded_ms").alias("started_ms"), F.max("recorded_ms").alias("ended_ms"),
        F.min_by("cls", F.col("recorded_ms") * 10 + F.col("seq")).alias("cls"))


@query("signature_cadence", f"""
with {SESSIONS}, cl as (select camera_id, tracker_id, session, count(*) as n, max(recorded_ms) as at_ms, max(track_cls) as cls from dn group by 1, 2, 3)
select camera_id, tracker_id, cast(session as bigint) as session, frame_no as frames_seen, recorded_ms, true as provisional from dn
where track_cls <> 'person' and frame_no >= 4 and (frame_no - 4) % 12 = 0
union all select camera_id, tracker_id, cast(session as bigint), n, at_ms, false from cl where cls <> 'person'""")
def signature_cadence(t):
    s = sessions(t)
    return tracks.signature_moments(s, tracks.build_tracks(s)).drop("segment")


@query("track_best_crops", """
select tracker_id, camera_id, part_no, width_px, cast(n as int) as crop_rank from (
  select *, row_number() over (partition by camera_id order by width_px desc, tracker_id * 8 + seq) as n from {bulk_detections}) b where n <= 8""")
def best_crops(t):
    d = t.bulk_detections.withColumn("crop_no", F.col("tracker_id") * 8 + F.col("seq"))
    return tracks.best_crops(d, keys=["camera_id"], area="width_px", order="crop_no").select(
        "tracker_id", "camera_id", "part_no", "width_px", "crop_rank")


EMISSIONS = """select 'trk' || cast(o_custkey as string) as track_id, o_orderkey as emitted_seq, o_orderstatus as colour,
  round(o_totalprice / 1e6, 3) as colour_confidence,
  case when o_orderkey % 3 = 0 then 'GJ' || cast(o_orderkey as string) end as partial_plate from {orders}"""


@query("signature_fold", f"""
with e as ({EMISSIONS}) select track_id, arg_max(colour, emitted_seq) as colour, arg_max(colour_confidence, emitted_seq) as colour_confidence,
  arg_max(partial_plate, emitted_seq) filter (where partial_plate is not null) as partial_plate from e group by 1""")
def signature_fold(t):
    return tracks.fold_signatures(t.sql(EMISSIONS), "emitted_seq")
