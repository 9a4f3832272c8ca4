"""Registry reports and the gap analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.operators import gaps, registry
from kerbline.plans.registry import query


@query("gap_coverage_by_district", """
select coalesce(district, '(district unknown)') as district, count(*) as cameras_total,
  count(*) filter (where status = 'online') as cameras_online,
  count(*) filter (where status = 'degraded') as cameras_degraded,
  count(*) filter (where status = 'offline') as cameras_offline,
  count(*) filter (where status_source = 'measured') as status_measured,
  count(*) filter (where status_source = 'portal_claim') as status_unverified,
  count(*) filter (where location_status = 'verified') as location_verified,
  count(*) filter (where location_status = 'approximate') as location_approximate,
  count(*) filter (where location_status = 'unverified') as location_unverified,
  count(*) filter (where department_id is null) as department_unassigned,
  round(avg(location_uncertainty_m)) as avg_uncertainty_m
from {cameras} group by 1 order by cameras_total desc""")
def coverage(t):
    return gaps.coverage_by_district(t.cameras)


@query("gap_summary", """
select (select count(*) from {cameras}) as cameras_total,
  (select count(*) from {cameras} where status = 'online') as online,
  (select count(*) from {cameras} where status = 'degraded') as degraded,
  (select count(*) from {cameras} where status = 'offline') as offline,
  (select count(*) from {cameras} where status_source = 'portal_claim') as status_unverified,
  (select count(*) from {cameras} where location_status = 'unverified') as location_unverified,
  (select count(*) from {cameras} where department_id is null) as department_unassigned,
  (select count(distinct district) from {cameras} where district is not null) as districts_covered""")
def summary(t):
    return gaps.registry_summary(t.cameras)


@query("gap_unusable_cameras", """
select camera_id, portal_id, name, district, status, status_source, last_error,
  (select max(h.observed_at_ms) from {health} h where h.camera_id = c.camera_id) as last_health_check_ms
from {cameras} c where status <> 'online'""")
def unusable(t):
    return gaps.unusable_cameras(t.cameras, t.health)


@query("gap_unverified_locations", """
select camera_id, portal_id, label, name, district, location_status, location_uncertainty_m, lat is null as has_no_coordinates
from {cameras} where location_status <> 'verified'""")
def unverified(t):
    return gaps.unverified_locations(t.cameras)


@query("gap_unassigned_departments", """
select camera_id, portal_id, label, name, district,
  (select count(*) from {assignments} a where a.camera_id = c.camera_id and confirmed) as confirmed_assignments,
  (select count(*) from {assignments} a where a.camera_id = c.camera_id and not confirmed) as pending_suggestions
from {cameras} c where department_id is null""")
def unassigned(t):
    return gaps.unassigned_departments(t.cameras, t.assignments)


@query("registry_list_order", """
select camera_id, portal_id, row_number() over (order by lat is null, cast(portal_id as int) nulls last, camera_id) as position
from {cameras}""")
def list_order(t):
    # The position is materialised only so the order itself can be checked; listing uses registry_order.
    from kerbline.operators.sequence import global_row_number

    cams = t.cameras.withColumns({
        "unplaced": F.col("lat").isNull().cast("int"), "n": F.coalesce(F.col("portal_id").cast("int"), F.lit(2147483647)),
    })
    return global_row_number(
        cams, order=["unplaced", "n", "camera_id"], chunk=F.col("unplaced") * 10000000 + F.floor(F.col("n") / 1000), out="position"
    ).select("camera_id", "portal_id", "position")


@query("registry_map_positions", """
select c.camera_id, c.portal_id, c.district, c.cluster, c.location_status, c.status, c.status_source,
  round(case when c.lat is not null then c.lat else coalesce(z.lat, 22.48418) end, 6) as lat,
  round(case when c.lng is not null then c.lng else coalesce(z.lng, 72.28309) end, 6) as lng,
  c.lat is null as position_is_fallback, d.name as department_label, s.source_type,
  coalesce(s.is_local_mirror, false) as is_local_mirror, s.width, s.height, s.fps
from {cameras} c left join {centroids} z on z.name = c.district
left join {streams} s on s.camera_id = c.camera_id
left join {departments} d on d.department_id = c.department_id""")
def positions(t):
    out = registry.map_positions(t.cameras, t.centroids, t.streams, t.departments)
    return out.select(
        "camera_id", "portal_id", "district", "cluster", "location_status", "status", "status_source",
        F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "position_is_fallback", "department_label",
        "source_type", "is_local_mirror", "width", "height", "fps",
    )


@query("registry_text_filter", """
select camera_id, district, cluster, status from (
  select c.*, d.name as department_label from {cameras} c left join {departments} d on d.department_id = c.department_id) c
where status = 'online' and not (location_status = 'verified' and coalesce(department_label, '') <> '')
  and (contains(lower(name), 'er 7') or contains(coalesce(portal_id, ''), 'er 7')
    or contains(lower(coalesce(district, '')), 'er 7') or contains(lower(coalesce(cluster, '')), 'er 7'))""")
def text_filter(t):
    named = t.cameras.join(
        t.departments.select("department_id", F.col("name").alias("department_label")), "department_id", "left"
    )
    return registry.registry_filter(named, text=" ER 7 ", status="online", gaps_only=True).select(
        "camera_id", "district", "cluster", "status"
    )


@query("registry_unlocated", "select camera_id, label from {cameras} where location_status = 'unverified'")
def unlocated(t):
    return registry.unlocated(t.cameras).select("camera_id", "label")


@query("registry_wall_cameras", "select camera_id, status from {cameras} where status in ('online', 'degraded')")
def wall(t):
    return registry.wall_cameras(t.cameras).select("camera_id", "status")


RAW_ROWS = """
select case when c_custkey % 37 = 5 then null else 'cam ' || cast(c_custkey % 1400 as string) end as label,
  case when c_custkey % 9 = 2 then null else cast(c_custkey % 1450 as string) end as portal_id,
  cast(null as string) as name,
  case c_custkey % 8 when 0 then null when 1 then 'WEBCAM' when 2 then 'HLS' else 'RTSP' end as source_type,
  case c_custkey % 6 when 0 then 'unverified' when 1 then 'guessed' when 2 then null when 3 then 'verified' else 'approximate' end as location_status,
  case c_custkey % 7 when 0 then 'offline' when 1 then 'broken' when 2 then null else 'online' end as status,
  case c_custkey % 5 when 0 then 'hearsay' when 1 then null else 'measured' end as status_source,
  case when c_custkey % 31 = 3 then null when c_custkey % 29 = 4 then -5 else c_custkey % 600 end as location_uncertainty_m,
  case when c_custkey % 3 = 0 then null else 22e0 end as lat,
  case when c_custkey % 3 = 0 or c_custkey % 50 = 7 then null else 72e0 end as lng,
  case when c_custkey % 14 = 7 then 'no frames' when c_custkey % 14 = 0 then '' end as last_error
from {customer}"""


@query("registry_row_defaults", f"""
select camera_id, source_type, location_status, status, status_source, source_url, department, count(*) as n from (
select coalesce(portal_id, 'offline:' || regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g')) as camera_id,
  coalesce(source_type, 'RTSP') as source_type, coalesce(location_status, 'unverified') as location_status,
  coalesce(status, 'online') as status, coalesce(status_source, 'portal_claim') as status_source,
  '/stream/' || coalesce(portal_id, '') as source_url, 'unassigned' as department
from ({RAW_ROWS}) r) x group by all""")
def row_defaults(t):
    rows = registry.with_defaults(t.sql(RAW_ROWS), {"source_type": "RTSP"})
    keys = ["camera_id", "source_type", "location_status", "status", "status_source", "source_url", "department"]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


@query("registry_row_violations", f"""
with r as (select label, portal_id, coalesce(source_type, 'RTSP') as source_type,
    coalesce(location_status, 'unverified') as location_status, coalesce(status, 'online') as status,
    coalesce(status_source, 'portal_claim') as status_source, location_uncertainty_m as unc, lat, lng, last_error
  from ({RAW_ROWS}) x),
v as (
  select label, 'label_required' as rule from r where label is null
  union all select label, 'source_type' from r where source_type = 'WEBCAM'
  union all select label, 'location_status' from r where location_status = 'guessed'
  union all select label, 'status' from r where status = 'broken'
  union all select label, 'status_source' from r where status_source = 'hearsay'
  union all select label, 'uncertainty' from r where unc is null or unc < 0
  union all select label, 'position_pair' from r where (lat is null) <> (lng is null)
  union all select label, 'position_flag' from r where lat is not null and location_status = 'unverified'
  union all select label, 'position_missing' from r where lat is null and location_status <> 'unverified'
  union all select label, 'last_error' from r where status <> 'online' and coalesce(last_error, '') = ''
  union all select min(label), 'label_unique' from r where label is not null group by label having count(*) > 1
  union all select min(label), 'portal_id_unique' from r where portal_id is not null group by portal_id having count(*) > 1)
select label, rule, count(*) as n from v group by 1, 2""")
def row_violations(t):
    rows = registry.with_defaults(t.sql(RAW_ROWS), {"source_type": "RTSP"})
    return registry.violations(rows).groupBy("label", "rule").agg(F.count("*").alias("n"))


PLACEMENTS = """
select c_custkey as placement_id,
  case c_custkey % 9 when 0 then cast('NaN' as double) when 1 then 19.4e0 else 19.5e0 + (c_custkey % 61) / 1e1 end as lat,
  case c_custkey % 11 when 0 then cast(null as double) when 1 then 75.6e0 else 67.5e0 + (c_custkey % 81) / 1e1 end as lng,
  c_custkey * 7 % 560 - 20 as uncertainty_m
from {customer}"""


@query("registry_placement_check", f"""
select accepted, reject_reason, count(*) as n from (
select case when lat is null or lng is null or isnan(lat) or isnan(lng) then 'not a valid coordinate'
  when not (lat >= 19.5 and lat <= 25.5 and lng >= 67.5 and lng <= 75.5) then 'outside the state'
  when not (uncertainty_m >= 0 and uncertainty_m <= 500) then 'uncertainty must be between 0 and 500 metres' end as reject_reason,
  reject_reason is null as accepted from ({PLACEMENTS}) p) x group by 1, 2""")
def placement(t):
    return registry.placement_decision(t.sql(PLACEMENTS)).groupBy("accepted", "reject_reason").agg(F.count("*").alias("n"))


@query("registry_geojson_features", """
select c.camera_id, c.location_uncertainty_m > 100 as shows_circle, c.name, round(c.lng, 6) as lng, round(c.lat, 6) as lat,
  cast(case when c.location_status = 'unverified' then 1 else 0 end as int) as unverified
from {cameras} c where c.lat is not null
union all
select c.camera_id, c.location_uncertainty_m > 100, c.name, round(coalesce(z.lng, 72.28309), 6), round(coalesce(z.lat, 22.48418), 6),
  cast(case when c.location_status = 'unverified' then 1 else 0 end as int)
from {cameras} c left join {centroids} z on z.name = c.district where c.lat is null""")
def geojson(t):
    placed = registry.map_positions(t.cameras, t.centroids, t.streams, t.departments)
    out = registry.geojson_features(placed)
    schema = (
        "type string, geometry struct<type:string,coordinates:array<double>>, "
        "properties struct<id:string,name:string,unverified:int>"
    )
    f = F.from_json("feature", schema)
    return out.select(
        "camera_id", "shows_circle", f["properties"]["name"].alias("name"),
        F.round(f["geometry"]["coordinates"][0], 6).alias("lng"), F.round(f["geometry"]["coordinates"][1], 6).alias("lat"),
        f["properties"]["unverified"].alias("unverified"),
    )


@query("registry_export_fields", """
select camera_id, label, coalesce(district, '') as district, cast(location_uncertainty_m as string) as location_uncertainty_m,
  coalesce(cluster, '') as cluster, status from {cameras}""")
def export(t):
    return registry.export_fields(t.cameras, ["camera_id", "label", "district", "location_uncertainty_m", "cluster", "status"])
