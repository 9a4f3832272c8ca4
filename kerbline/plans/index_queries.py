"""Search over the index, summaries, alerts lists, and route reconstruction."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.operators import routes, search, similarity, spatial
from kerbline.plans.registry import query

VECTOR_DIM = 64

SEARCH_SQL = """
select s.track_id, t.camera_id, c.label as camera_label, c.district, s.cls, s.colour, s.colour_confidence, s.colour_uncertain,
  s.partial_plate, s.embedding_size > 0 as has_embedding, t.started_ms as first_seen_ms,
  coalesce(t.ended_ms, t.started_ms) as last_seen_ms, t.frame_count
from {index_signatures} s join {tracks} t on t.track_id = s.track_id join {cameras} c on c.camera_id = t.camera_id"""


def _hits(t, **filters):
    return search.matching_signatures(t.index_signatures, t.tracks, t.cameras, **filters)


@query("search_hits_by_class_and_plate", SEARCH_SQL + " where s.cls = 'car' and contains(s.partial_plate, 'GJ0')")
def hits_by_plate(t):
    return _hits(t, cls="car", plate=" gj 0 ")


@query("search_page_newest_first", SEARCH_SQL + " where s.colour = 'white' order by t.started_ms desc, s.track_id limit 100")
def page(t):
    return search.search_page(_hits(t, colour="white"))


@query("search_total", "select count(*) as total from (" + SEARCH_SQL + " where t.camera_id = 'cam7') x")
def total(t):
    return search.search_total(_hits(t, camera_id="cam7"))


@query("index_totals", """
select (select count(*) from {bulk_detections}) as detections, (select count(*) from {tracks}) as tracks,
  (select count(*) from {index_signatures}) as signatures, (select count(distinct camera_id) from {tracks}) as cameras,
  (select min(started_ms) from {tracks}) as earliest_ms, (select max(ended_ms) from {tracks}) as latest_ms""")
def totals(t):
    return search.index_totals(t.bulk_detections, t.tracks, t.index_signatures)


@query("index_tracks_by_class", "select cls, count(*) as tracks from {tracks} group by 1")
def by_class(t):
    return search.tracks_by_class(t.tracks)


@query("index_tracks_by_camera", """
select k.camera_id, coalesce(c.label, k.camera_id) as label, coalesce(c.name, k.camera_id) as name, k.tracks
from (select camera_id, count(*) as tracks from {tracks} group by 1) k left join {cameras} c on c.camera_id = k.camera_id""")
def by_camera(t):
    return search.tracks_by_camera(t.tracks, t.cameras)


@query("search_filter_values", """
select 'class' as kind, cls as value, cls as label from {index_signatures} group by all
union all select 'colour', colour, colour from {index_signatures} where colour is not null group by all
union all select 'camera', camera_id, label from {cameras} where camera_id in (select camera_id from {tracks})""")
def filter_values(t):
    return search.available_filters(t.index_signatures, t.tracks, t.cameras)


@query("alerts_recent", """
select a.*, c.label as camera_label, c.name as camera_name from {alerts} a join {cameras} c on c.camera_id = a.camera_id
order by a.created_ms desc, a.alert_id limit 50""")
def recent(t):
    return search.recent_alerts(t.alerts, t.cameras)


@query("alerts_at_cameras", """
select a.camera_id, c.label as camera_label, a.priority, count(*) as n, max(a.created_ms) as newest_ms
from {alerts} a join {cameras} c on c.camera_id = a.camera_id group by all""")
def at_cameras(t):
    return search.alerts_at_cameras(t.alerts, t.cameras).groupBy("camera_id", "camera_label", "priority").agg(
        F.count("*").alias("n"), F.max("created_ms").alias("newest_ms")
    )


@query("alerts_triage_order", """
select alert_id, status, priority, recorded_ms,
  cast(case priority when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end as int) as priority_rank
from {alerts}""")
def triage(t):
    return search.triage_order(t.alerts).select("alert_id", "status", "priority", "recorded_ms", "priority_rank")


FEED = "select 'al' || cast(o_custkey as string) as alert_id, o_orderkey * 1000 % 7919000 + o_orderkey as created_ms, o_orderpriority as priority from {orders}"


@query("alerts_live_feed", f"""
select alert_id, min(created_ms) as created_ms, arg_min(priority, created_ms) as priority from ({FEED}) m
group by 1 order by created_ms desc, alert_id limit 100""")
def feed(t):
    return search.alert_feed(t.sql(FEED))


LOCATED = """located as (select s.*, c.lat, c.lng, c.label as camera_label, c.location_status <> 'verified' as position_approximate
  from {signatures} s join {cameras} c on c.camera_id = s.camera_id),
looks as (select a.track_id as seed_id, b.track_id, b.camera_id, b.recorded_ms, b.lat, b.lng, list_dot_product(a.embedding, b.embedding) as sim
  from located a join located b on a.cls = b.cls and a.camera_id <> b.camera_id and a.track_id <> b.track_id
  where b.frame_count >= 3 and len(b.embedding) = 64 and list_dot_product(a.embedding, b.embedding) >= 0.82)"""


def located(t):
    sig = t.signatures
    tracks = sig.select("track_id", "camera_id", F.col("recorded_ms").alias("started_ms"), "frame_count")
    return routes.located_signatures(sig.drop("camera_id", "recorded_ms", "frame_count"), tracks, t.cameras)


@query("route_candidates", """
select s.track_id, s.camera_id, c.label as camera_label, s.cls, s.recorded_ms, s.frame_count, c.location_status <> 'verified' as position_approximate
from {signatures} s join {cameras} c on c.camera_id = s.camera_id where len(s.embedding) = 64 and s.frame_count >= 3""")
def candidates(t):
    return routes.candidate_signatures(located(t), VECTOR_DIM).select(
        "track_id", "camera_id", "camera_label", "cls", "recorded_ms", "frame_count", "position_approximate")


LOOKALIKES_SQL = f"with {LOCATED} select seed_id, track_id, camera_id, round(sim, 6) as similarity from looks"
#: Small enough for several cells and several blocks in each, on the smallest tables too.
FEW_ROWS = 25


@query("route_lookalikes", LOOKALIKES_SQL)
def lookalikes(t, **options):
    rows = located(t)
    found = routes.lookalikes(rows, routes.candidate_signatures(rows, VECTOR_DIM), dim=VECTOR_DIM, **options)
    return found.select(F.col("l_id").alias("seed_id"), F.col("r_id").alias("track_id"),
                        F.col("r_camera_id").alias("camera_id"), F.round("similarity", 6).alias("similarity"))


@query("route_lookalikes_blocks", LOOKALIKES_SQL)
def lookalikes_blocks(t):
    return lookalikes(t, block_rows=FEW_ROWS)


@query("route_lookalikes_same_model", f"""
with {LOCATED} select k.seed_id, k.track_id, round(k.sim, 6) as similarity from looks k join {{signatures}} a on a.track_id = k.seed_id
join {{signatures}} b on b.track_id = k.track_id where a.embedding_model = b.embedding_model""")
def lookalikes_same_model(t):
    rows = located(t)
    found = routes.lookalikes(rows, routes.candidate_signatures(rows, VECTOR_DIM), dim=VECTOR_DIM, same_model=True)
    return found.select(F.col("l_id").alias("seed_id"), F.col("r_id").alias("track_id"), F.round("similarity", 6).alias("similarity"))


@query("route_reconstruction", f"""
with recursive {LOCATED},
offered as (select track_id as seed_id, track_id, camera_id, recorded_ms, lat, lng, null::double as sim, 0 as late from located
  union all select seed_id, track_id, camera_id, recorded_ms, lat, lng, sim, 1 from looks),
numbered as (select *, row_number() over (partition by seed_id order by recorded_ms, late, track_id) as n from offered),
walk as (
  select seed_id, n, [camera_id] as cams, track_id, lat, lng, recorded_ms, sim, true as kept, false as refused,
    null::double as km, null::double as kmh, true as sure from numbered where n = 1
  union all
  select w.seed_id, x.n, case when j.keep then list_append(w.cams, x.camera_id) else w.cams end, x.track_id,
    case when j.keep then x.lat else w.lat end, case when j.keep then x.lng else w.lng end,
    case when j.keep then x.recorded_ms else w.recorded_ms end, x.sim, j.keep, not j.seen and not j.keep, j.km, j.kmh, j.km is not null
  from walk w join numbered x on x.seed_id = w.seed_id and x.n = w.n + 1,
  lateral (select 12742 * asin(sqrt(pow(sin(radians(x.lat - w.lat) / 2), 2)
      + cos(radians(w.lat)) * cos(radians(x.lat)) * pow(sin(radians(x.lng - w.lng) / 2), 2))) as d,
    abs(x.recorded_ms - w.recorded_ms) / 1e3 as s) g,
  lateral (select g.d as km, case when g.s >= 20 then g.d / (g.s / 3600e0) end as kmh, list_contains(w.cams, x.camera_id) as seen,
    not list_contains(w.cams, x.camera_id) and (g.d is null or case when g.s < 20 then g.d <= 1.5 else g.d / (g.s / 3600e0) <= 140 end) as keep) j),
totals as (select seed_id, sum(case when refused then 1 else 0 end) as rejected,
    sum(case when kept and not sure then 1 else 0 end) as unverifiable from walk group by 1)
select w.seed_id, cast(rejected as bigint) as rejected, cast(unverifiable as bigint) as unverifiable,
  cast(row_number() over (partition by w.seed_id order by n) as int) as step, w.track_id, round(sim, 3) as similarity,
  round(km, 2) as leg_km, round(kmh, 1) as leg_speed_kmh, sure as leg_verifiable
from walk w join totals t on t.seed_id = w.seed_id where kept""")
def route_reconstruction(t):
    rows = located(t)
    found = routes.reconstruct_routes(rows, routes.candidate_signatures(rows, VECTOR_DIM), dim=VECTOR_DIM)
    return routes.route_sightings(found).select(
        "seed_id", "rejected", "unverifiable", "step", "track_id", "similarity", "leg_km", "leg_speed_kmh", "leg_verifiable")


MATRIX_SQL = """
select least(a.camera_id, b.camera_id) as camera_a, greatest(a.camera_id, b.camera_id) as camera_b, count(*) as pairs,
  round(min(12742 * asin(sqrt(pow(sin(radians(d.lat - c.lat) / 2), 2)
      + cos(radians(c.lat)) * cos(radians(d.lat)) * pow(sin(radians(d.lng - c.lng) / 2), 2)))), 3) as separation_km
from {signatures} a join {signatures} b on a.track_id < b.track_id and a.cls = b.cls and a.camera_id <> b.camera_id
join {cameras} c on c.camera_id = a.camera_id join {cameras} d on d.camera_id = b.camera_id
where list_dot_product(a.embedding, b.embedding) >= 0.82 group by 1, 2"""


@query("camera_match_matrix", MATRIX_SQL)
def match_matrix(t, **options):
    from kerbline.functions.geo import haversine_km

    counted = similarity.camera_match_matrix(t.signatures, dim=VECTOR_DIM, threshold=routes.APPEARANCE_THRESHOLD, **options)
    at = lambda p: t.cameras.select(F.col("camera_id").alias(f"camera_{p}"), F.col("lat").alias(f"{p}_lat"), F.col("lng").alias(f"{p}_lng"))
    km = haversine_km(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"))
    return counted.join(at("a"), "camera_a").join(at("b"), "camera_b").select(
        "camera_a", "camera_b", "pairs", F.round(km, 3).alias("separation_km"))


@query("camera_match_matrix_blocks", MATRIX_SQL)
def match_matrix_blocks(t):
    return match_matrix(t, block_rows=FEW_ROWS)



NEAR_SQL = """select a.camera_id, b.camera_id as near_id, 12742 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
      + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))) * 1000 as d
  from {cameras} a join {cameras} b on a.camera_id <> b.camera_id where a.lat is not null and b.lat is not null"""


@query("cameras_within_radius", f"select camera_id, near_id, round(d, 2) as distance_m from ({NEAR_SQL}) x where d <= 60000")
def near(t):
    return spatial.cameras_near(t.cameras, 60_000).withColumn("distance_m", F.round("distance_m", 2))


@query("cameras_nearest_three", f"""
select camera_id, near_id, cast(n as int) as nearness from (select *, row_number() over (partition by camera_id order by d, near_id) as n
  from ({NEAR_SQL}) x where d <= 90000) y where n <= 3""")
def nearest(t):
    return spatial.nearest_cameras(spatial.cameras_near(t.cameras, 90_000, nearest=3), 3).select("camera_id", "near_id", "nearness")


HOPS = """select c.camera_id as from_camera, d.camera_id as to_camera, cast(c.camera_no * 7919 % 6000 - 60 as double) as elapsed_s
from {cameras} c join {cameras} d on d.camera_no = c.camera_no + 1"""


@query("camera_hop_plausibility", f"""
with h as (select h.*, 12742000 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
      + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))) as d
  from ({HOPS}) h join {{cameras}} a on a.camera_id = from_camera join {{cameras}} b on b.camera_id = to_camera),
s as (select *, d / greatest(elapsed_s + 15, 0.001) * 3.6 as v from h)
select from_camera, to_camera, elapsed_s, round(coalesce(d, 0), 2) as distance_m,
  case when d is not null and elapsed_s >= -15 then round(v, 3) end as implied_speed_kmh,
  case when d is null or elapsed_s < -15 then false else v <= 120 end as plausible,
  case when d is null then 'one or both cameras have no verified position'
    when elapsed_s < -15 then 'second sighting precedes the first by more than the clock tolerance'
    when v <= 120 then 'implies a plausible speed' else 'above the limit' end as verdict
from s""")
def hops(t):
    out = spatial.assess_hops(t.sql(HOPS), t.cameras)
    r = F.col("reason")
    verdict = F.when(r.contains("above the"), "above the limit").when(r.startswith("implies"), "implies a plausible speed").otherwise(r)
    return out.select("from_camera", "to_camera", "elapsed_s", F.round("distance_m", 2).alias("distance_m"),
                      F.round("implied_speed_kmh", 3).alias("implied_speed_kmh"), "plausible", verdict.alias("verdict"))


@query("co_sightings_per_moment", """
with m as (select camera_id, recorded_ms, count(*) as here from {detections} group by 1, 2)
select a.camera_id, a.recorded_ms, a.here, cast(coalesce(sum(case when b.camera_id <> a.camera_id then b.here end), 0) as bigint) as elsewhere
from m a join m b on b.recorded_ms between a.recorded_ms - 900000 and a.recorded_ms + 900000 group by 1, 2, 3""")
def co_counts(t):
    return spatial.co_sighting_counts(t.detections, tolerance_ms=900_000, chunk_ms=43_200_000)


@query("co_sightings_same_class", """
select a.camera_id as camera_a, b.camera_id as camera_b, count(*) as moments from {detections} a join {detections} b
  on a.cls = b.cls and a.camera_id < b.camera_id and abs(a.recorded_ms - b.recorded_ms) <= 15000 group by 1, 2""")
def co_pairs(t):
    d = t.detections
    left = d.select("cls", F.col("camera_id").alias("camera_a"), F.col("recorded_ms").alias("a_ms"))
    right = d.select("cls", F.col("camera_id").alias("camera_b"), F.col("recorded_ms").alias("b_ms"))
    pairs = spatial.co_sightings(left, right, on=["cls"], left_ms="a_ms", right_ms="b_ms",
                                 condition=F.col("camera_a") < F.col("camera_b"))
    return pairs.groupBy("camera_a", "camera_b").agg(F.count("*").alias("moments"))
