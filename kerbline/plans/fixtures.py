"""Domain tables derived from the given tables, written once and rendered for Spark or the SQL check.

Each function returns a SELECT; ``{name}`` refers to a given table or to another derived table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from kerbline.session import prepare

BASE = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


class SparkDialect:
    @staticmethod
    def ms(x):
        return f"unix_millis(cast({x} as timestamp))"

    @staticmethod
    def idiv(a, b):
        return f"({a} div {b})"

    @staticmethod
    def ts(ms):
        return f"timestamp_millis({ms})"

    @staticmethod
    def blend(base, own, first):
        return (
            f"zip_with(cast({base} as array<double>), cast({own} as array<double>), "
            f"(x, y) -> 0.95D * x + case when {first} then 0D else 0.3122D * y end)"
        )

    @staticmethod
    def unit(v):
        norm = f"sqrt(aggregate({v}, 0D, (s, y) -> s + y * y))"
        return f"get(transform(array({norm}), n -> transform({v}, x -> x / n)), 0)"

    empty_vector = "cast(array() as array<double>)"

    @staticmethod
    def tail(x, start):
        return f"substr({x}, {start})"


class DuckDialect:
    @staticmethod
    def ms(x):
        return f"(epoch_us({x}) // 1000)"

    @staticmethod
    def idiv(a, b):
        return f"({a} // {b})"

    @staticmethod
    def ts(ms):
        return f"make_timestamp(cast(({ms}) * 1000 as bigint))"

    @staticmethod
    def blend(base, own, first):
        return (
            f"list_transform(list_zip(cast({base} as double[]), cast({own} as double[])), "
            f"lambda x: 0.95 * x[1] + case when {first} then 0 else 0.3122 * x[2] end)"
        )

    @staticmethod
    def unit(v):
        return f"list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"

    empty_vector = "cast([] as double[])"

    @staticmethod
    def tail(x, start):
        return f"substr({x}, {start})"


# --- registry -------------------------------------------------------------------------------

def cameras(d):
    return """
select 'cam' || cast(s_suppkey as string) as camera_id, s_name as label, s_name as name,
  case when s_suppkey % 11 = 0 then null else cast(s_suppkey + 1 as string) end as portal_id,
  case when s_suppkey % 10 = 3 then null else n_name end as district,
  case when s_suppkey % 3 = 0 then null else 'cluster ' || cast(s_suppkey % 8 as string) end as cluster,
  case when s_suppkey % 4 = 1 then null else 20e0 + ((s_suppkey * 37) % 450) / 1e2 end as lat,
  case when s_suppkey % 4 = 1 then null else 68e0 + ((s_suppkey * 53) % 650) / 1e2 end as lng,
  case s_suppkey % 4 when 1 then 'unverified' when 2 then 'verified' else 'approximate' end as location_status,
  case s_suppkey % 4 when 1 then 15000 when 2 then 25 else 200 + 100 * (s_suppkey % 19) end as location_uncertainty_m,
  case s_suppkey % 7 when 2 then 'degraded' when 5 then 'offline' else 'online' end as status,
  case when s_suppkey % 3 = 0 then 'portal_claim' else 'measured' end as status_source,
  case when s_suppkey % 7 in (2, 5) then 'no frames' end as last_error,
  case when s_suppkey % 3 = 1 then 'dept' || cast(n_regionkey as string) end as department_id,
  s_suppkey as camera_no
from {supplier} join {nation} on s_nationkey = n_nationkey"""


def departments(d):
    return """
select 'dept' || cast(r_regionkey as string) as department_id, lower(r_name) as slug, r_name as name from {region}"""


def centroids(d):
    return """
select case when n_nationkey % 5 = 2 then 'old ' else '' end || n_name as name, 20e0 + (n_nationkey * 41 % 500) / 1e2 as lat, 68e0 + (n_nationkey * 67 % 600) / 1e2 as lng
from {nation}"""


def assignments(d):
    return """
select 'as' || cast(c_custkey as string) as assignment_id, 'cam' || cast(c_custkey * 7 % 130 as string) as camera_id,
  'dept' || cast(c_nationkey % 5 as string) as department_id, c_custkey % 3 = 0 as confirmed from {customer}"""


def health(d):
    return f"""
select event_id, 'cam' || cast(user_id % 120 as string) as camera_id, {d.ms('ts')} as observed_at_ms,
  case event_type when 'error' then 'offline' when 'click' then 'degraded' when 'view' then 'unknown' else 'online' end as status,
  value / 10e0 as fps, event_id % 400 as latency_ms, props as detail from {{events}}"""


def streams(d):
    return """
select case when s_suppkey % 6 = 1 then 'unlisted' else 'cam' end || cast(s_suppkey as string) as camera_id,
  case when s_suppkey % 5 = 0 then 'HLS' else 'RTSP' end as source_type,
  s_suppkey % 9 = 0 as is_local_mirror, 1920 as width, 1080 as height, 25e0 as fps
from {supplier}"""


# --- index ----------------------------------------------------------------------------------

def tracks(d):
    return f"""
select 'trk' || cast(o_orderkey as string) as track_id, 'cam' || cast(o_custkey % 100 as string) as camera_id,
  o_custkey % 40 as tracker_id,
  case o_orderkey % 5 when 0 then 'car' when 1 then 'truck' when 2 then 'motorcycle' when 3 then 'bus' else 'person' end as cls,
  {d.ms('o_orderdate')} + o_orderkey % 86400 * 1000 as started_ms,
  case when o_orderkey % 8 = 3 then null else {d.ms('o_orderdate')} + o_orderkey % 86400 * 1000 + 4000 + o_orderkey % 9 * 500 end as ended_ms,
  1 + o_orderkey % 9 as frame_count
from {{orders}}"""


def index_signatures(d):
    # People are tracked but never get a signature.
    return f"""
select * from (select 'trk' || cast(o_orderkey as string) as track_id,
  case o_orderkey % 5 when 0 then 'car' when 1 then 'truck' when 2 then 'motorcycle' when 3 then 'bus' else 'person' end as cls,
  case o_orderkey % 6 when 0 then 'white' when 1 then 'grey' when 2 then 'black' when 3 then 'red' when 4 then 'blue' end as colour,
  (o_orderkey % 100) / 1e2 as colour_confidence, o_orderkey % 7 = 0 as colour_uncertain,
  case when o_orderkey % 4 = 0 then 'GJ' || lpad(cast(o_orderkey % 39 as string), 2, '0') || 'AB'
    || lpad(cast(o_custkey % 10000 as string), 4, '0') end as partial_plate,
  case when o_orderkey % 13 = 0 then 0 else 512 end as embedding_size
from {{orders}}) s where cls <> 'person'"""


def detections(d):
    return f"""
select event_id as seq, 'cam' || cast(user_id % 10 as string) as camera_id, user_id as tracker_id,
  case event_type when 'signup' then 'car' when 'error' then 'truck' when 'click' then 'motorcycle'
       when 'view' then 'bus' else 'person' end as cls,
  value / 500e0 as confidence, {d.ms('ts')} as recorded_ms, event_id % 7 as x1, 40e0 + value as width_px
from {{events}}"""


def bulk_detections(d):
    return f"""
select 'cam' || cast(l_suppkey as string) as camera_id, 'trk' || cast(l_orderkey as string) as track_id,
  l_orderkey as tracker_id,
  case l_returnflag when 'A' then 'car' when 'N' then 'truck' else 'bus' end as cls,
  l_discount as confidence, {d.ms('l_shipdate')} as recorded_ms, l_linenumber as seq, l_partkey as part_no,
  40e0 + l_quantity * 8e0 as width_px
from {{lineitem}}"""


def frames(d):
    # One camera's feed wraps every 12 hours, like the grid's; arrival jitters by up to 50 ms.
    return f"""
select 'cam' || cast(user_id % 10 as string) as camera_id,
  'conn' || cast({d.idiv(d.ms('ts'), 864000000)} as string) as connection_id, event_id as seq,
  cast({d.ms('ts')} % 43200000 as double) as pts_ms,
  cast({d.ms('ts')} + event_id * 7 % 50 as double) as arrival_ms,
  event_id % 97 = 13 as scene_cut, event_id % 211 = 5 as clock_backwards
from {{events}}"""


def plate_reads(d):
    return """
select c_custkey as read_id, 'trk' || cast(c_custkey % 400 as string) as track_id,
  case c_custkey % 6
    when 0 then 'GJ' || lpad(cast(c_nationkey as string), 2, '0') || ser || num
    when 1 then 'gj-' || lpad(cast(c_nationkey as string), 2, '0') || ' ' || lower(ser) || ' ' || num
    when 2 then 'GJ' || replace(lpad(cast(c_nationkey as string), 2, '0'), '0', 'O') || ser || num
    when 3 then 'GJ' || lpad(cast(c_nationkey as string), 2, '0') || ser || 'I' || substr(num, 2, 3)
    when 4 then 'ZZ' || lpad(cast(c_nationkey as string), 2, '0') || ser || num
    else '22BH' || num || ser end as raw_ocr, round(0.5e0 + (c_custkey * 13 % 50) / 1e2, 2) as confidence
from (select c_custkey, c_nationkey, lpad(cast(c_custkey % 10000 as string), 4, '0') as num,
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(c_custkey % 26 as int) + 1, 1)
          || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(c_custkey * 7 % 26 as int) + 1, 1) as ser
      from {customer}) c"""


def signatures(d):
    """Groups of four look-alike vectors, unit length, on ten cameras."""
    raw = d.blend("b.embedding", "e.embedding", "e.vec_id = b.vec_id")
    group = d.idiv("e.vec_id", "4")
    base_ms = "1704067200000"
    return f"""
select track_id, camera_id, {d.unit('raw_vector')} as embedding, cls, recorded_ms, frame_count,
  colour, colour_uncertain, embedding_model, partial_plate, vec_no, group_no from (
select 'trk' || cast(e.vec_id as string) as track_id, 'cam' || cast(e.vec_id % 10 as string) as camera_id,
  {raw} as raw_vector,
  case {group} % 5 when 0 then 'car' when 1 then 'truck' when 2 then 'motorcycle' when 3 then 'bus' else 'car' end as cls,
  {base_ms} + 1000 * ({group} * 600 + (e.vec_id % 4)
    * case when {group} % 3 = 0 then 1200 else 9000 end) as recorded_ms,
  1 + e.vec_id % 9 as frame_count,
  case e.vec_id % 5 when 0 then 'white' when 1 then 'grey' when 2 then 'red' when 3 then 'blue' end as colour,
  e.vec_id % 6 = 1 as colour_uncertain, 'model' || cast(e.vec_id % 2 as string) as embedding_model,
  case when e.vec_id % 3 = 0 then p.raw_ocr end as partial_plate, e.vec_id as vec_no, {group} as group_no
from {{embeddings}} e join {{embeddings}} b on b.vec_id = e.vec_id - e.vec_id % 4
left join {{plate_reads}} p on p.read_id = e.vec_id) raw"""


def crop_vectors(d):
    vec = "cast(embedding as array<double>)" if d is SparkDialect else "cast(embedding as double[])"
    return f"""
select 'trk' || cast({d.idiv('vec_id', '4')} as string) as track_id, vec_id % 4 as crop_no,
  60 + vec_id * 31 % 400 as width, 40 + vec_id * 17 % 300 as height, {vec} as embedding from {{embeddings}}"""


def _vector_cells(d):
    """(vec_id, pos, n): a whole number from each component of each vector, to make pixels of."""
    if d is SparkDialect:
        source = "(select vec_id, posexplode(embedding) as (pos, e) from {embeddings})"
    else:
        source = "(select vec_id, unnest(range(len(embedding))) as pos, unnest(embedding) as e from {embeddings})"
    return f"(select vec_id, pos, cast(floor(abs(cast(e as double)) * 1e6) as bigint) as n from {source} c)"


def hsv_pixels(d):
    """One 8 by 8 crop per vector."""
    return f"""
select vec_id as crop_id, 'trk' || cast({d.idiv('vec_id', '4')} as string) as track_id, 8 as height, 8 as width,
  {d.idiv('pos', '8')} as row_no, pos % 8 as col_no,
  case when vec_id % 5 = 0 then 5 + n % 3 else n % 180 end as h,
  case vec_id % 3 when 0 then n % 256 when 1 then n % 70 else 60 + n % 190 end as s,
  case vec_id % 4 when 0 then n % 60 when 1 then 171 + n % 80 when 2 then n % 39 else n % 256 end as v
from {_vector_cells(d)} p"""


def gray_pixels(d):
    """32 by 32 frames of sixteen vectors each, five frames to a scene."""
    frame, idx = d.idiv("vec_id", "16"), "(vec_id % 16 * 64 + pos)"
    return f"""
select 'cam' || cast({d.idiv(frame, '5')} as string) as label, {frame} as frame_no,
  {d.idiv(idx, '32')} as row_no, {idx} % 32 as col_no, n % 256 as v from {_vector_cells(d)} p"""


# --- watchlist and alerts --------------------------------------------------------------------

def watchlists(d):
    return """
select 'list' || cast(n_nationkey as string) as watchlist_id, n_name as name, n_nationkey % 6 <> 4 as active from {nation}"""


def watchlist_entries(d):
    return """
select 'e' || cast(p_partkey as string) as entry_id, 'list' || cast(p_partkey % 25 as string) as watchlist_id,
  case p_partkey % 5 when 0 then 'vehicle_plate' when 1 then 'vehicle_plate' when 2 then 'vehicle_attributes'
    when 3 then 'vehicle_attributes' when 4 then 'person' end as entity_type,
  case when p_partkey % 5 in (0, 1) then
      'GJ ' || lpad(cast(p_partkey * 3 % 25 as string), 2, '0') || ' '
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(p_partkey * 3 % 26 as int) + 1, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(p_partkey * 21 % 26 as int) + 1, 1)
        || lpad(cast(p_partkey * 3 % 10000 as string), 4, '0')
    when p_partkey % 5 in (2, 3) then
      case p_partkey % 4 when 0 then 'White, ' when 1 then 'red ' when 2 then '' else 'silver ' end
        || case p_partkey % 3 when 0 then 'truck' when 1 then 'Car' else 'bus' end
    else p_name end as entity_value,
  p_type as reason,
  case p_partkey % 4 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' else 'low' end as priority,
  p_partkey % 7 <> 3 as active
from {part}"""


def watchlist_views(d):
    return f"""
select 'e' || cast(vec_no * 3 % 400 as string) as entry_id, embedding, embedding_model, track_id as source_track_id
from {{signatures}} where colour = 'red'"""


def alert_sightings(d):
    return f"""
select o_orderkey as seq, 'trk' || cast(o_custkey as string) as track_id,
  'e' || cast(o_orderkey % 3 as string) as entry_id, 'cam' || cast(o_custkey % 10 as string) as camera_id,
  round(o_totalprice / 1e6, 3) as confidence,
  case o_orderstatus when 'F' then 'plate' when 'O' then 'appearance' else 'plate-alternate' end as matched_via,
  o_orderstatus = 'P' as repaired,
  case when o_orderstatus = 'O' then 'internal_reid' else 'internal_anpr' end as source,
  case substr(o_orderpriority, 1, 1) when '1' then 'critical' when '2' then 'high' when '3' then 'medium' else 'low' end as priority,
  {d.ms('o_orderdate')} as recorded_ms, o_orderkey * 37 % 900 as pipeline_latency_ms
from {{orders}}"""


def alerts(d):
    return f"""
select 'al' || cast(o_orderkey as string) as alert_id,
  case substr(o_orderpriority, 1, 1) when '1' then 'critical' when '2' then 'high' when '3' then 'medium' else 'low' end as priority,
  case o_orderstatus when 'F' then 'new' when 'O' then 'acknowledged' else 'resolved' end as status,
  'cam' || cast(o_custkey % 120 as string) as camera_id, round(o_totalprice / 1e6, 3) as confidence,
  {d.ms('o_orderdate')} as recorded_ms, {d.ms('o_orderdate')} + o_orderkey * 7 % 5000 as created_ms
from {{orders}}"""


# --- rosters --------------------------------------------------------------------------------

def roster_old(d):
    return """
select s_name as label, cast(s_suppkey + 1 as string) as portal_id, case when s_suppkey % 2 = 0 then 'h264' end as codec,
  1920 as width, case when s_suppkey % 13 = 0 then false else true end as portal_live,
  case when s_suppkey % 17 = 3 then 'left the portal roster on earlier' when s_suppkey % 5 = 2 then 'seen at dusk' end as notes,
  s_suppkey % 9 = 4 as human_placed from {supplier}"""


def roster_new(d):
    return """
select label, cast(k + 5000 as string) as portal_id, codec, width, true as portal_live from (
  select s_name as label, s_suppkey as k,
    case when s_suppkey % 4 = 0 then 'hevc' when s_suppkey % 2 = 0 then 'h264' end as codec,
    case when s_suppkey % 6 = 1 then 1280 else 1920 end as width
  from {supplier} where s_acctbal > 0e0
  union all select 'new ' || n_name, 1000000000 + n_nationkey, 'h264', 1920 from {nation}) r"""


# --- measurements ---------------------------------------------------------------------------

def time_sync(d):
    return """
select 'cam' || cast(c_custkey % 700 as string) as camera_id, cast(c_custkey * 7919 % 43200 as double) as position_s,
  0.005e0 * (c_custkey * 7919 % 43200) + (c_custkey % 11) / 4e0 as offset_s, c_custkey as measured_seq from {customer}"""


def fingerprints(d):
    return """
select p_partkey as fingerprint_id, 'cam' || cast(p_partkey * 3 % 110 as string) as label,
  p_partkey * 101 % 21600 as slot_offset_s, substr(md5(cast(p_partkey % 700 as string)), 1, 16) as phash from {part}"""


def clock_reads(d):
    """OCR text of an overlay clock: the true second with a digit sometimes misread."""
    true_ms = "(1781395200000 + c_custkey * 997000 % 86400000)"
    stamp = (
        f"date_format(timestamp_millis({true_ms}), 'dd-MM-yyyy HH:mm:ss')" if d is SparkDialect
        else f"strftime(make_timestamp(cast({true_ms} * 1000 as bigint)), '%d-%m-%Y %H:%M:%S')"
    )
    return f"""
select c_custkey as read_id, 'cam' || cast(c_nationkey as string) as camera_id, c_custkey % 3 as variant,
  'clip' || cast({d.idiv('c_custkey', '6')} as string) as clip, cast(c_custkey % 6 * 300 as double) as seek_s,
  case c_custkey % 7 when 0 then replace({stamp}, ':', '2') when 1 then replace({stamp}, '07', '97')
    when 2 then substr({stamp}, 1, 9) when 3 then substr({stamp}, 3) else {stamp} end as ocr_text,
  {true_ms} + (c_custkey * 13 % 41 - 20) * 1000 as expected_ms
from {{customer}}"""


def clip_chunks(d):
    return """
select 'cam' || cast(l_suppkey as string) as camera_id, 'tag' || cast(l_orderkey as string) as tag, idx,
  idx * 60e0 as requested_offset_s, 60e0 as requested_duration_s, ok,
  case when ok then idx * 60e0 - l_discount * 20e0 end as first_pts_s,
  case when ok then idx * 60e0 + 58e0 + l_tax * 40e0 end as last_pts_s
from (select l_suppkey, l_orderkey, l_discount, l_tax, l_quantity > 5e0 as ok,
        row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as idx
      from {lineitem}) c"""


def geocode_candidates(d):
    return """
select 'Camera ' || cast(c_custkey % 300 as string) as label, c_custkey % 4 as query_pos, c_custkey as result_pos,
  case when c_custkey % 6 = 0 then null else (c_custkey * 17 % 100) / 2e2 end as importance,
  case when c_custkey % 5 = 0 then null else 'NATION_' || cast(c_custkey % 2 as string) || case when c_custkey % 3 = 0 then ' District' else '' end end as state_district,
  case when c_custkey % 300 % 7 = 0 then null else 'nation_0' end as expected_district
from {customer}"""


def rings(d):
    return """
select n_name as feature, c_custkey % 3 as ring_no,
  row_number() over (partition by c_nationkey, c_custkey % 3 order by c_custkey) - 1 as pos,
  68e0 + (c_custkey * 37 % 650) / 1e2 as x, 20e0 + (c_custkey * 53 % 450) / 1e2 as y
from {customer} join {nation} on c_nationkey = n_nationkey"""


def stream_log(d):
    return f"""
select event_id as seq, 'cam' || cast(user_id % 50 as string) as camera_id,
  case event_id % 12 when 0 then 'Could not find ref with POC ' || cast(event_id as string)
    when 1 then 'error: Connection refused' when 2 then 'RPS: Server returned 500'
    when 3 then 'Server returned ' || cast(event_id as string) when 4 then 'no frames yet'
    when 5 then 'no frame' when 6 then 'INVALID NAL UNIT SIZE' when 7 then '404 not found'
    when 8 then 'Server returned x' else 'event ' || event_type || ' ' || props end as message
from {{events}}"""


def publisher_state(d):
    return """
select 'cam' || cast(o_orderkey as string) as camera_id, cast(o_custkey % 600 as double) as seeked_to,
  1787239306351 + o_orderkey * 977 as started_at_ms,
  1787239306351 + o_orderkey * 977 + (o_orderkey * 7919 % 100000) - 500 as now_ms,
  case o_orderkey % 4 when 0 then null when 1 then 600e0 when 2 then 49437.28e0 else 43200e0 end as duration_s
from {orders}"""


def users(d):
    return """
select c_name as username, case c_custkey % 5 when 0 then 'state_admin' when 1 then 'department_admin'
    when 2 then 'control_room_operator' when 3 then 'investigator' else 'auditor' end as role,
  case when c_custkey % 4 = 0 then null else 'dept' || cast(c_nationkey % 5 as string) end as department_id,
  c_custkey % 8 <> 5 as active
from {customer}"""


def camera_versions(d):
    return f"""
select 'cam' || cast(o_custkey % 100 as string) as camera_id, o_orderkey as version_no,
  'operator' || cast(o_custkey % 9 as string) as actor, {d.ms('o_orderdate')} as at_ms,
  case when o_orderkey % 5 = 0 then null else 20e0 + (o_orderkey * 7 % 500) / 1e2 end as lat,
  case when o_orderkey % 5 = 0 then null else 68e0 + (o_orderkey * 11 % 700) / 1e2 end as lng,
  case when o_orderkey % 5 = 0 then 'unverified' else 'verified' end as location_status,
  (o_orderkey * 13) % 600 as location_uncertainty_m
from {{orders}}"""


def snapshots(d):
    return f"""
select 'endpoint' || cast(o_custkey % 20 as string) as endpoint, {d.ms('o_orderdate')} + o_orderkey as fetched_at_ms,
  substr(md5(cast({d.idiv('o_orderkey', '40')} as string)), 1, 8) as digest, o_custkey % 4 as added, o_custkey % 3 as vanished
from {{orders}}"""


DERIVED = {
    f.__name__: f
    for f in (
        cameras, departments, centroids, assignments, health, streams, tracks, index_signatures, detections,
        bulk_detections, frames, plate_reads, signatures, crop_vectors, hsv_pixels, gray_pixels, watchlists, watchlist_entries,
        watchlist_views, alert_sightings, alerts, roster_old, roster_new, time_sync, fingerprints, clock_reads,
        clip_chunks, geocode_candidates, rings, stream_log, publisher_state, users, camera_versions, snapshots,
    )
}

_REF = re.compile(r"\{([a-z_]+)\}")


class Tables:
    """The given tables and the ones derived from them, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = prepare(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in DERIVED:
            text = DERIVED[name](SparkDialect)
            return self.spark.sql(text, **{ref: getattr(self, ref) for ref in set(_REF.findall(text))})
        raise AttributeError(name)

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        refs = {ref: getattr(self, ref) for ref in set(_REF.findall(text)) if ref not in frames}
        # Braces that are not references (JSON in the text) are literal.
        literal = text.replace("{", "{{").replace("}", "}}")
        return self.spark.sql(re.sub(r"\{\{([a-z_]+)\}\}", r"{\1}", literal), **refs, **frames)


def duck(text: str) -> str:
    """Render a check: every ``{derived}`` table used becomes a common table expression."""
    order: list[str] = []

    def visit(body: str) -> None:
        for ref in _REF.findall(body):
            if ref in DERIVED and ref not in order:
                visit(DERIVED[ref](DuckDialect))
                order.append(ref)

    def render(body: str) -> str:
        return _REF.sub(lambda m: f"fx_{m.group(1)}" if m.group(1) in DERIVED else m.group(1), body)

    visit(text)
    if not order:
        return render(text)
    ctes = ",\n".join(f"fx_{name} as ({render(DERIVED[name](DuckDialect))})" for name in order)
    body = render(text).strip()
    if body.lower().startswith("with recursive"):
        return f"with recursive {ctes},\n{body[len('with recursive'):]}"
    if body.lower().startswith("with"):
        return f"with {ctes},\n{body[len('with'):]}"
    return f"with {ctes}\n{body}"
