"""Roster reconciliation, audit, access, boundaries and operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.operators import access, audit, boundaries, operations, reconcile
from kerbline.plans.registry import query

STAMP = "2026-08-21 10:00 IST"
CHANGES = """
j as (select o.*, n.label as nl, n.portal_id as np, n.codec as nc, n.width as nw, n.portal_live as nv
  from {roster_old} o full join {roster_new} n on n.label = o.label),
ch as (select nl as label, 'added' as change, null as field, null as old_value, null as new_value from j where label is null
  union all select label, 'vanished', null, null, null from j where nl is null
  union all select label, 'renamed', 'portal_id', portal_id, np from j where label is not null and nl is not null and portal_id is distinct from np
  union all select label, 'changed', 'portal_id', portal_id, np from j where label is not null and nl is not null and portal_id is distinct from np
  union all select label, 'changed', 'codec', codec, nc from j where label is not null and nl is not null and nc is not null and codec is distinct from nc
  union all select label, 'changed', 'width', cast(width as string), cast(nw as string) from j where label is not null and nl is not null and width is distinct from nw
  union all select label, 'changed', 'portal_live', cast(portal_live as string), cast(nv as string) from j
    where label is not null and nl is not null and portal_live is distinct from nv)"""


@query("roster_changes", f"with {CHANGES} select label, change, field, old_value, new_value from ch")
def roster_changes(t):
    return reconcile.roster_changes(t.roster_old, t.roster_new)


@query("roster_change_summary", f"""
with {CHANGES} select count(*) filter (where change = 'added') as added, count(*) filter (where change = 'vanished') as vanished,
  count(*) filter (where change = 'renamed') as renamed, count(*) filter (where change = 'changed') as changed from ch""")
def change_summary(t):
    return reconcile.change_summary(reconcile.roster_changes(t.roster_old, t.roster_new))


def registry_rows(t):
    text = F.lit(None).cast("string")
    return t.roster_old.withColumns({
        "last_portal_id": text, "status": F.lit("online"), "status_source": F.lit("portal_claim"), "last_error": text,
        "last_seen": F.lit("before"), "source_type": F.lit("MP4_PROGRESSIVE"), "source_url": F.lit("/file"),
        "label_number": F.lit(None).cast("int"), "location_status": F.lit("verified"),
        "location_uncertainty_m": F.lit(25), "location_basis": F.lit("surveyed"), "department": F.lit("police"),
    })


@query("roster_apply", f"""
with {CHANGES}
select coalesce(label, nl) as label,
  case when nl is not null then np when portal_live then null else portal_id end as portal_id,
  case when nl is null and portal_live then portal_id end as last_portal_id,
  case when nl is not null then coalesce(nc, codec) else codec end as codec, coalesce(nw, width) as width,
  case when nl is null then false else nv end as portal_live,
  case when nl is null and portal_live then 'offline' else 'online' end as status,
  case when nl is null and portal_live then 'measured' else 'portal_claim' end as status_source,
  case when nl is null and portal_live then 'absent from the roster since {STAMP}' end as last_error,
  case when label is null then 'auto-added from the roster — needs geography review'
    when nl is null and portal_live and not contains(coalesce(notes, ''), 'left the portal roster')
      then case when notes is null then '' else notes || '; ' end || 'left the portal roster on {STAMP}; portal_id released (was ' || portal_id || ')'
    else notes end as notes,
  case when nl is null then 'before' else '{STAMP}' end as last_seen,
  case when nl is null then '/file' else '/stream/' || np end as source_url,
  case when label is null then 'unverified' else 'verified' end as location_status,
  cast(case when label is null then 15000 else 25 end as int) as location_uncertainty_m,
  case when label is null then 'unassigned' else 'police' end as department
from j""")
def roster_apply(t):
    out = reconcile.apply_roster(registry_rows(t), t.roster_new, STAMP)
    return out.drop("human_placed", "label_number", "location_basis", "source_type")


@query("registry_upsert", """
select coalesce(o.label, n.label) as label, case when n.label is not null then n.portal_id else o.portal_id end as portal_id,
  case when n.label is null or o.human_placed then o.lat else n.lat end as lat,
  case when n.label is null or o.human_placed then o.location_status else n.location_status end as location_status,
  case when n.label is not null then n.status else 'degraded' end as status, case when o.label is not null then 'police' end as department_id
from (select label, portal_id, human_placed, 21e0 as lat, 'verified' as location_status from {roster_old}) o
full join (select label, portal_id, 22e0 as lat, 'approximate' as location_status, 'online' as status from {roster_new}) n on n.label = o.label""")
def upsert(t):
    existing = t.roster_old.select(
        "label", "portal_id", F.lit(21.0).alias("lat"), F.lit("verified").alias("location_status"), F.lit("degraded").alias("status"),
        F.lit("police").alias("department_id"), F.when(F.col("human_placed"), "operator").alias("location_set_by"))
    incoming = t.roster_new.select("label", "portal_id", F.lit(22.0).alias("lat"), F.lit("approximate").alias("location_status"),
                                   F.lit("online").alias("status"), F.lit("other").alias("department_id"))
    return reconcile.upsert_registry(existing, incoming).drop("location_set_by")


PROBES = """select cast(c_custkey as string) as portal_id, case when c_custkey % 3 = 0 then null else 'hevc' end as codec,
  1000 + c_custkey % 900 as width, 700 as height, 12.5e0 as actual_fps, c_custkey * 1.5e0 as duration_s, c_custkey * 1000 as size_bytes from {customer}"""


@query("stream_rows_from_probe", f"""
with p as ({PROBES}) select r.label, r.portal_id, 'RTSP' as source_type, coalesce(p.codec, r.codec) as codec,
  coalesce(case when r.codec = 'h264' then r.width end, p.width) as width, p.height, p.actual_fps as fps, p.duration_s, p.size_bytes
from {{roster_new}} r left join p on p.portal_id = r.portal_id""")
def stream_rows(t):
    none = F.lit(None)
    roster = t.roster_new.withColumns({
        "width": F.when(F.col("codec") == "h264", F.col("width")), "height": none.cast("int"), "fps": none.cast("double"),
        "source_type": none.cast("string")})
    return reconcile.stream_rows(roster, t.sql(PROBES))


@query("insert_missing_readings", """
select n.camera_id, n.measured_seq from {time_sync} n where not exists (
  select 1 from {health} h where h.camera_id = n.camera_id)""")
def insert_missing(t):
    return reconcile.insert_missing(t.health, t.time_sync, ["camera_id"]).select("camera_id", "measured_seq")


SUGGESTIONS = """select s_name as label, case when s_suppkey % 7 = 2 then 'NOWHERE' else upper(r_name) end as suggested_department, n_name as basis
from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey"""


@query("department_suggestions", f"""
select c.camera_id, d.department_id, s.basis as rationale, false as confirmed, 'seed:label_inference' as assigned_by
from ({SUGGESTIONS}) s join {{cameras}} c on c.label = s.label join {{departments}} d on d.slug = lower(s.suggested_department)""")
def suggestions(t):
    return reconcile.resolve_suggestions(t.sql(SUGGESTIONS), t.cameras, t.departments).drop("basis")


@query("roster_digest", """
with r as (select endpoint, label, '{"codec":' || coalesce(to_json(codec)::varchar, 'null') || ',"label":' || to_json(label)::varchar
    || ',"portal_id":' || to_json(portal_id)::varchar || ',"width":' || coalesce(cast(width as varchar), 'null') || '}' as x
  from (select 'old' as endpoint, label, codec, portal_id, width from {roster_old} union all select 'new', label, codec, portal_id, width from {roster_new}) u),
b as (select endpoint, substr(sha256(label), 1, 3) as k, count(*) as n, sha256(array_to_string(list_sort(list(sha256(x))), ',')) as h from r group by 1, 2)
select endpoint, cast(sum(n) as bigint) as camera_count, sha256(array_to_string(list_sort(list(h)), ',')) as digest from b group by 1""")
def digest(t):
    cols = ["label", "portal_id", "codec", "width"]
    both = t.roster_old.select(F.lit("old").alias("endpoint"), *cols).unionByName(t.roster_new.select(F.lit("new").alias("endpoint"), *cols))
    return reconcile.roster_digest(both, ["endpoint"])


@query("roster_snapshot_changes", """
select endpoint, fetched_at_ms, lag(digest) over w as previous_digest, lag(digest) over w is null or digest <> lag(digest) over w as roster_changed
from {snapshots} window w as (partition by endpoint order by fetched_at_ms)""")
def snapshot_changes(t):
    return reconcile.snapshot_changes(t.snapshots).select("endpoint", "fetched_at_ms", "previous_digest", "roster_changed")


@query("audit_position_changes", """
select actor, case when lat is null then 'camera.position.cleared' else 'camera.position.set' end as action, camera_id as entity_id, version_no,
  lag(lat) over w as from_lat, lag(location_status) over w as from_status, lat as to_lat, location_uncertainty_m as to_uncertainty_m
from {camera_versions} window w as (partition by camera_id order by at_ms, version_no)""")
def position_changes(t):
    m = F.from_json("meta", "from struct<lat:double,location_status:string>, to struct<lat:double,location_uncertainty_m:bigint>")
    return audit.position_changes(t.camera_versions).withColumn("m", m).select(
        "actor", "action", "entity_id", "version_no", F.col("m.from.lat").alias("from_lat"),
        F.col("m.from.location_status").alias("from_status"), F.col("m.to.lat").alias("to_lat"),
        F.col("m.to.location_uncertainty_m").alias("to_uncertainty_m"))


LATER = """select camera_id, version_no, case when version_no % 50 = 9 then 'someone' else actor end as actor, at_ms, lat from {camera_versions}
where location_uncertainty_m <> 13"""


@query("audit_append_only_violations", """
select camera_id, version_no, case when location_uncertainty_m = 13 then 'vanished' else 'changed' end as violation
from {camera_versions} where location_uncertainty_m = 13 or version_no % 50 = 9""")
def append_only(t):
    before = t.camera_versions.select("camera_id", "version_no", "actor", "at_ms", "lat")
    return audit.append_only_violations(before, t.sql(LATER), ["camera_id", "version_no"])


@query("evidence_identity_violations", """
select doc_id, 'sha256' as changed_column from documents where doc_id % 40 = 3
union all select doc_id, 'path' from documents where doc_id % 60 = 3""")
def identity_violations(t):
    before = t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"), F.col("source").alias("path"))
    after = t.documents.select(
        "doc_id", F.sha2(F.when(F.col("doc_id") % 40 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"),
        F.when(F.col("doc_id") % 60 == 3, F.lit("moved")).otherwise(F.col("source")).alias("path"))
    return audit.immutable_violations(before, after, "doc_id", ["sha256", "path"])


@query("compare_two_results", """
with a as (select l_returnflag, l_linestatus, l_linenumber from lineitem),
b as (select l_returnflag, l_linestatus, case when l_partkey = 7 then 9 else l_linenumber end as l_linenumber from lineitem)
select x.l_returnflag, x.l_linestatus, x.l_linenumber, abs(n) as surplus, case when n > 0 then 'left' else 'right' end as only_in from (
  select l_returnflag, l_linestatus, l_linenumber, cast(sum(n) as bigint) as n from (select *, 1 as n from a union all select *, -1 from b) u group by all) x where n <> 0""")
def compare(t):
    cols = ["l_returnflag", "l_linestatus", "l_linenumber"]
    changed = t.lineitem.select(*cols[:2], F.when(F.col("l_partkey") == 7, 9).otherwise(F.col("l_linenumber")).alias("l_linenumber"))
    return audit.compare_results(t.lineitem.select(*cols), changed)


@query("access_visible_cameras", """
select username, role, case when role in ('state_admin', 'auditor') then (select count(*) from {cameras})
  else (select count(*) from {cameras} c where c.department_id = u.department_id) end as visible from {users} u where active""")
def visible(t):
    return access.visible_counts(t.users, t.cameras)


@query("access_users_with_permissions", """
select username, role from {users} where active and role in ('state_admin', 'investigator')""")
def users_with(t):
    return access.users_with(t.users, ["evidence:export", "integration:query"]).select("username", "role")


@query("access_permission_matrix", """
select role, count(*) as users, case role when 'state_admin' then 19 when 'department_admin' then 14 when 'control_room_operator' then 8
  when 'investigator' then 12 else 7 end as permissions from {users} group by 1""")
def matrix(t):
    held = access.permission_matrix(t.spark).groupBy("role").agg(F.count("*").cast("int").alias("permissions"))
    return t.users.groupBy("role").agg(F.count("*").alias("users")).join(held, "role")


RINGS = """
e as (select *, lag(x) over w as px, lag(y) over w as py from {rings} window w as (partition by feature, ring_no order by pos)),
m as (select feature, ring_no, coalesce(sum(px * y - x * py), 0) / 2 as a, coalesce(sum((px + x) * (px * y - x * py)), 0) as mx,
    coalesce(sum((py + y) * (px * y - x * py)), 0) as my,
    count(*) as points, min(x) as min_x, max(y) as max_y from e group by 1, 2)"""


@query("boundary_ring_measures", f"""
with {RINGS} select feature, ring_no, round(a, 6) as signed_area, points, min_x, max_y from m""")
def ring_measures(t):
    return boundaries.ring_measures(t.rings).select(
        "feature", "ring_no", F.round("signed_area", 6).alias("signed_area"), "points", "min_x", "max_y")


CENTROIDS = f"""{RINGS},
big as (select *, row_number() over (partition by feature order by abs(a) desc, ring_no) as r from m),
ce as (select feature as name, round(my / (6 * a), 5) as lat, round(mx / (6 * a), 5) as lng from big where r = 1),
al as (select 'Kutch' as name, lat, lng from ce where name = 'NATION_3'
  union all select 'Morbi', lat, lng from ce where name = 'NATION_5')"""
ALIASES = {"Kutch": ["Atlantis", "NATION_3", "NATION_4"], "Morbi": ["NATION_5"], "NATION_7": ["NATION_1"], "Nowhere": ["El Dorado"]}


@query("boundary_district_centroids", f"with {CENTROIDS} select * from ce union all select * from al")
def district_centroids(t):
    return boundaries.with_aliases(boundaries.feature_centroids(boundaries.ring_measures(t.rings)), ALIASES)


@query("boundary_state_centroid", f"""
with {CENTROIDS} select round(avg(lat), 5) as lat, round(avg(lng), 5) as lng from (select * from ce union all select * from al) x""")
def state_centroid(t):
    out = boundaries.state_centroid(district_centroids(t))
    return out.select(F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"))


@query("boundary_extent", """
select min(x) as min_x, min(y) as min_y, max(x) as max_x, max(y) as max_y, count(*) as points from {rings}""")
def extent(t):
    return boundaries.bounds(boundaries.ring_measures(t.rings))


@query("boundary_simplified_rings", """
with recursive v as (select feature, ring_no, pos, x, y from {rings}),
ends as (select feature, ring_no, min(pos) as a, max(pos) as b from v group by 1, 2),
walk as (
  select feature, ring_no, a, b from ends
  union all
  select feature, ring_no, unnest([a, m]), unnest([m, b]) from (
    select feature, ring_no, a, b, -max({'d': d, 'q': -pos}).q as m from (
      select w.feature, w.ring_no, w.a, w.b, p.pos,
        sqrt(pow(p.x - (f.x + u * (g.x - f.x)), 2) + pow(p.y - (f.y + u * (g.y - f.y)), 2)) as d
      from walk w join v f on f.feature = w.feature and f.ring_no = w.ring_no and f.pos = w.a
      join v g on g.feature = w.feature and g.ring_no = w.ring_no and g.pos = w.b
      join v p on p.feature = w.feature and p.ring_no = w.ring_no and p.pos > w.a and p.pos < w.b,
      lateral (select pow(g.x - f.x, 2) + pow(g.y - f.y, 2) as len) l,
      lateral (select case when len = 0 then 0 else greatest(0, least(1, ((p.x - f.x) * (g.x - f.x) + (p.y - f.y) * (g.y - f.y)) / len)) end as u) k) far
    group by 1, 2, 3, 4 having max(d) > 2.5) s)
select v.* from v where (feature, ring_no, pos) in (select (feature, ring_no, a) from walk union select (feature, ring_no, b) from walk)""")
def simplified(t):
    return boundaries.simplify_rings(t.rings, tolerance=2.5).select("feature", "ring_no", "pos", "x", "y")


@query("boundary_rounded_rings", """
with r as (select feature, ring_no, pos, round_even(x, 0) as x, round_even(y, 0) as y from {rings}),
l as (select *, lag(x) over w as px, lag(y) over w as py from r window w as (partition by feature, ring_no order by pos)),
d as (select * from l where px is null or x <> px or y <> py),
g as (select feature, ring_no, count(*) as n, arg_min(x, pos) as fx, arg_min(y, pos) as fy, arg_max(x, pos) as lx, arg_max(y, pos) as ly, max(pos) as e from d group by 1, 2),
k as (select *, n > 2 and (fx <> lx or fy <> ly) as opened from g),
ok as (select * from k where n + case when opened then 1 else 0 end >= 4)
select d.feature, d.ring_no, d.pos, d.x, d.y from d join ok on ok.feature = d.feature and ok.ring_no = d.ring_no
union all select feature, ring_no, e + 1, fx, fy from ok where opened""")
def rounded(t):
    return boundaries.round_rings(t.rings, precision=0)


@query("stream_health_summary", """
with l as (select *, row_number() over (partition by camera_id order by observed_at_ms desc, event_id desc) as r, count(*) over (partition by camera_id) as n from {health})
select c.camera_id, c.status as registry_status, l.status as measured_status, l.fps, l.latency_ms, l.observed_at_ms, coalesce(l.n, 0) as checks,
  c.status = l.status as claim_holds from {cameras} c left join l on l.camera_id = c.camera_id and r = 1""")
def health_summary(t):
    return operations.stream_health(t.health, t.cameras).drop("status_source")


@query("stream_pacing_drift", """
with s as (select *, ((now_ms / 1e3 + 19800 - 32400) % 43200 + 43200) % 43200 as o, seeked_to + greatest(0, (now_ms - started_at_ms) / 1e3) as raw from {publisher_state}),
p as (select *, case when duration_s > 0 then raw % duration_s else raw end as actual, case when duration_s > 0 then o % duration_s else o end as expected from s),
d as (select *, case when duration_s > 0 and actual - expected > duration_s / 2 then actual - expected - duration_s
  when duration_s > 0 and actual - expected < -duration_s / 2 then actual - expected + duration_s else actual - expected end as drift from p)
select camera_id, round(actual, 3) as actual_s, round(expected, 3) as expected_s, round(drift, 3) as drift_s, abs(drift) > 2 as reseek from d""")
def pacing(t):
    r = lambda c: F.round(c, 3).alias(c)
    return operations.pacing_drift(t.publisher_state).select("camera_id", r("actual_s"), r("expected_s"), r("drift_s"), "reseek")


START = "884563200000 + o_orderkey * 613000 % 9000000000"
REQUESTS = f"""select o_orderkey as request_id, 'cam/' || cast(o_custkey % 50 as string) as path_name, {START} as start_ms,
  {START} + (o_orderkey % 9 - 3) * 20000 as end_ms from {{orders}}"""
SEGMENT_ROWS = """select 'seg' || cast(event_id as string) as segment_id, 'cam/' || cast(user_id % 50 as string) as path_name,
  884563200000 + event_id * 977000 as segment_start_ms, 884563200000 + event_id * 977000 + 600000 as segment_end_ms from {events}"""


@query("evidence_needed_segments", f"""
with r as ({REQUESTS}), s as ({SEGMENT_ROWS})
select r.request_id, s.segment_id, r.start_ms - 30000 as from_ms, r.end_ms + 30000 as to_ms from r join s on s.path_name = r.path_name
where r.end_ms + 30000 > r.start_ms - 30000 and segment_start_ms < r.end_ms + 30000 and segment_end_ms > r.start_ms - 30000""")
def segments(t):
    requests = t.sql(REQUESTS)
    return operations.needed_segments(requests, t.sql(SEGMENT_ROWS)).select("request_id", "segment_id", "from_ms", "to_ms")


@query("evidence_windows", f"""
with r as ({REQUESTS})
select request_id, start_ms - 30000 as from_ms, end_ms + 30000 as to_ms, (end_ms - start_ms + 60000) / 1e3 as duration_s,
  case when end_ms - start_ms + 60000 <= 0 then 'empty window' end as window_error from r""")
def windows(t):
    requests = t.sql(REQUESTS)
    return operations.evidence_windows(requests).select("request_id", "from_ms", "to_ms", "duration_s", "window_error")


@query("place_choice", """
with q as (select *, coalesce(importance, 0) as imp, row_number() over (partition by label, query_pos order by coalesce(importance, 0) desc, result_pos) as r
  from {geocode_candidates}),
j as (select *, trim(replace(lower(coalesce(state_district, '')), ' district', '')) as got, trim(replace(lower(coalesce(expected_district, '')), ' district', '')) as want
  from q where r = 1),
k as (select *, case when coalesce(expected_district, '') <> '' and got <> '' and want <> '' and got <> want then 'district mismatch'
  when imp < 0.15 then 'importance below threshold' end as reason from j),
l as (select label, min(case when reason is null then query_pos end) as hit, arg_max(coalesce(reason, ''), query_pos) as last_reason from k group by 1)
select l.label, l.hit as query_pos, k.result_pos, k.imp as importance, case when l.hit is null then last_reason end as reason
from l left join k on k.label = l.label and k.query_pos = l.hit""")
def place_choice(t):
    return operations.choose_places(t.geocode_candidates)
