"""Scans and contracts, run over text that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.plans.registry import query
from kerbline.sources import contracts, scans

ROSTERS = """select n_name as endpoint, '{{"cameras": [' || rows || '], "total": 1}}' as payload from (
  select n_name, array_join(collect_list('{{"id": ' || s_suppkey || ', "location": "' || s_name || '", "live": ' ||
    case when s_suppkey % 3 = 0 then 'false' else 'true' end || ', "codec": ' || case when s_suppkey % 5 = 0 then 'null' else '"h264"' end
    || ', "fps": 12.5}}'), ', ') as rows from {supplier} join {nation} on s_nationkey = n_nationkey group by n_name, floor(s_suppkey / 50)) r""".replace("{{", "{").replace("}}", "}")


@query("scan_roster_payloads", """
select n_name as endpoint, s_name as label, cast(s_suppkey as string) as portal_id, s_suppkey % 3 <> 0 as portal_live,
  case when s_suppkey % 5 <> 0 then 'h264' end as codec, 12.5e0 as fps from {supplier} join {nation} on s_nationkey = n_nationkey""")
def rosters(t):
    return scans.parse_roster(t.sql(ROSTERS)).select("endpoint", "label", "portal_id", "portal_live", "codec", "fps")


CSV_LINES = """select c_custkey as line_no, case c_custkey % 9 when 0 then '' when 1 then '  # ' || c_name when 2 then 'label,department,basis'
  when 3 then c_name || ' , ' || c_mktsegment else '"' || c_name || ', \"\"gate\"\"\", ' || lower(c_mktsegment) || ' ,' || cast(c_nationkey as string) end as value from {customer}"""


@query("scan_csv_lines", """
select c_custkey as line_no, case when c_custkey % 9 = 3 then c_name else c_name || ', "gate"' end as label,
  case when c_custkey % 9 = 3 then c_mktsegment else lower(c_mktsegment) end as department,
  case when c_custkey % 9 = 3 then '' else cast(c_nationkey as string) end as basis from customer where c_custkey % 9 > 2""")
def csv_lines(t):
    return scans.parse_csv_lines(t.sql(CSV_LINES), ["label", "department", "basis"])


PROBES = """select p_partkey as probe_id, '{"url": "u' || p_partkey || '", "size_bytes": ' || p_partkey * 7919000 || ', "bytes_fetched": ' || p_partkey * 1000
  || ', "box_order": ' || case p_partkey % 3 when 0 then '["ftyp","moov","mdat"]' when 1 then '["ftyp","mdat","moov"]' else '[]' end
  || ', "format": {"duration": ' || case when p_partkey % 4 = 0 then 'null' else '"' || p_partkey * 3 || '.5"' end || '}, "streams": ['
  || case when p_partkey % 5 = 0 then '' else '{"codec_type": "audio", "codec_name": "aac"}, ' end
  || '{"codec_type": "video", "codec_name": "h264", "width": 1920, "height": 1080, "r_frame_rate": "25/1", "avg_frame_rate": "'
  || case p_partkey % 4 when 0 then '0/0' when 1 then '30000/1001' when 2 then '25' else 'x/2' end || '", "nb_frames": "' || p_partkey || '", "bit_rate": "'
  || p_partkey * 1000 || '"}]}' as payload from {part}"""


@query("scan_media_probes", """
select p_partkey as probe_id, p_partkey % 3 = 0 as moov_at_front, case when p_partkey % 4 = 1 then 29.97e0 end as actual_fps, 25e0 as nominal_fps,
  case when p_partkey % 4 <> 0 then p_partkey * 3 + 0.5e0 end as duration_s, p_partkey % 5 <> 0 as has_audio, p_partkey as nb_frames,
  p_partkey as video_bitrate_kbps, case when p_partkey > 0 then round_even(p_partkey * 7919000 / 1e9, 2) end as size_gb, 'h264' as codec from part""")
def probes(t):
    return scans.summarize_probes(t.sql(PROBES)).select(
        "probe_id", "moov_at_front", "actual_fps", "nominal_fps", "duration_s", "has_audio", "nb_frames", "video_bitrate_kbps",
        "size_gb", "codec")


MANIFESTS = """select l_orderkey, '{"camera": "cam1", "tag": "t' || l_orderkey || '", "chunks": [' || array_join(collect_list('{"index": ' || l_linenumber
  || ', "requested_offset_s": ' || l_linenumber * 60 || ', "actual_first_pts_s": ' || l_quantity || ', "actual_last_pts_s": null, "ok": '
  || case when l_linenumber = 2 then 'false' else 'true' end || '}'), ',') || ']}' as payload from {lineitem} group by l_orderkey"""


@query("scan_capture_manifests", """
select 't' || l_orderkey as tag, cast(l_linenumber as int) as idx, l_linenumber * 60e0 as requested_offset_s, l_quantity as first_pts_s,
  l_linenumber <> 2 as ok from lineitem""")
def manifests(t):
    return scans.parse_manifests(t.sql(MANIFESTS)).select("tag", "idx", "requested_offset_s", "first_pts_s", "ok")


DISTRICTS = """select '{"features": [{"properties": {"DISTRICT": " ' || n_name || '", "ST_NM": "' || case when n_regionkey = 1 then ' gujarat ' else 'Goa' end
  || '"}, "geometry": {"type": "' || case n_nationkey % 3 when 0 then 'Polygon' when 1 then 'MultiPolygon' else 'Point' end || '", "coordinates": '
  || case n_nationkey % 3 when 0 then '[' || ring || ',[[1,1]]]' when 1 then '[[' || ring || '],[[[2,2],[3,3]]]]' else '[1, 2]' end || '}}]}' as payload
from (select n_name, n_regionkey, n_nationkey, '[' || array_join(collect_list('[' || s_suppkey || ', ' || s_nationkey || ']'), ',') || ']' as ring
  from {supplier} join {nation} on s_nationkey = n_nationkey group by n_name, n_regionkey, n_nationkey, floor(s_suppkey / 50)) r"""


@query("scan_district_rings", """
with r as (select * from supplier join nation on s_nationkey = n_nationkey where n_regionkey = 1)
select n_name as feature, cast(0 as int) as polygon_no, cast(0 as int) as ring_no, true as outer, cast(s_suppkey as double) as x, cast(s_nationkey as double) as y
  from r where n_nationkey % 3 < 2
union all select n_name, 0, 1, false, 1e0, 1e0 from r where n_nationkey % 3 = 0 group by n_name, s_suppkey // 50
union all select n_name, 1, 0, true, v, v from (select n_name, unnest([2e0, 3e0]) as v from r where n_nationkey % 3 = 1 group by n_name, s_suppkey // 50) x""")
def districts(t):
    return scans.parse_districts(t.sql(DISTRICTS), "Gujarat").select("feature", "polygon_no", "ring_no", "outer", "x", "y")


@query("scan_evidence_hashes", """
select doc_id, sha256(text) as sha256, doc_id % 7 not in (2, 3) as intact from documents""")
def evidence(t):
    docs = t.documents.withColumn("clip", F.concat(F.col("doc_id").cast("string"), F.lit(".mp4")))
    clips = docs.select("doc_id", "clip", F.encode("text", "utf-8").alias("content"))
    recorded = F.when(F.col("doc_id") % 7 == 2, F.lit("tampered")).when(F.col("doc_id") % 7 != 3, F.sha2("text", 256))
    sidecars = docs.select("clip", recorded.alias("sha256"))
    return scans.verify_evidence(clips, sidecars).select("doc_id", "sha256", "intact")


@query("parse_signature_events", """
select track_id, case when vec_no % 7 = 0 then 'car' else cls end as cls, colour, vec_no % 6 = 1 as colour_uncertain, partial_plate,
  cast(case when vec_no % 5 = 0 then 0 else 64 end as int) as dims, cast(recorded_ms as double) as recorded_at_ms from {signatures}""")
def signature_events(t):
    c = F.col
    fields = t.signatures.select(
        "track_id", "camera_id", F.lit(None).cast("string").alias("camera_label"), F.when(c("vec_no") % 7 != 0, c("cls")).alias("cls"),
        F.coalesce("colour", F.lit("")).alias("colour"), F.lit("0.5").alias("colour_confidence"),
        F.when(c("vec_no") % 6 == 1, F.when(c("vec_no") % 4 == 1, "true").otherwise("1")).otherwise("0").alias("colour_uncertain"),
        F.coalesce("partial_plate", F.lit("")).alias("partial_plate"),
        F.when(c("vec_no") % 5 == 0, "").otherwise(F.to_json("embedding")).alias("embedding"),
        F.lit("").alias("embedding_model"), c("recorded_ms").cast("string").alias("recorded_at_ms"), F.lit("12").alias("detected_at_ms"))
    return contracts.parse_signature_fields(fields).select(
        "track_id", "cls", "colour", "colour_uncertain", "partial_plate", F.size("embedding").alias("dims"), "recorded_at_ms")


STAMP = """"event_id": "' || event_id || '", "camera_id": "cam' || user_id || '", "emitted_at_ms": ' || event_id || ', "captured_at_ms": 5"""
BUS = f"""select event_id, case event_id % 11
  when 0 then '{{"type": "detection.new", {STAMP}, "frame": {{"width": ' || (event_id % 3) || ', "height": 1080, "index": 0}}, "cls": "car", "bbox": [1,2,3,4], "confidence": ' || value / 300 || ', "track_id": null}}'
  when 1 then '{{"type": "detection.new", {STAMP}, "frame": {{"width": 10, "height": 10, "index": 0}}, "cls": "' || event_type || '", "bbox": [1,2,3], "confidence": 0.5}}'
  when 2 then '{{"type": "track.updated", {STAMP}, "track_id": 4, "cls": "bus", "bbox": [1,2,3,4.5], "attributes": {{"color": null, "color_confidence": ' || value / 300 || ', "vehicle_type": null}}}}'
  when 3 then '{{"type": "plate.read", {STAMP}, "track_id": 4, "raw_ocr": "GJ", "normalized": null, "valid": true, "repaired": false, "confidence": "0.5", "frames_considered": 1, "agreement": 1, "bbox": [1,2,3,4], "crop_key": null}}'
  when 4 then '{{"type": "plate.read", {STAMP}, "track_id": 4, "raw_ocr": "GJ", "normalized": null, "valid": true, "repaired": false, "confidence": 0.5, "frames_considered": ' || (event_id % 4) || ', "agreement": 1, "bbox": [1,2,3,4], "crop_key": null}}'
  when 5 then '{{"type": "camera.health", {STAMP}, "status": "online", "fps": null, "latency_ms": 5, "detail": null}}'
  when 6 then '{{"type": "camera.health", {STAMP}, "status": "' || event_type || '", "fps": null}}'
  when 7 then '{{"type": "signature.created", {STAMP}, "camera_label": "", "track_id": "t", "cls": "truck", "colour": null, "colour_confidence": null, "partial_plate": null, "embedding": [0.1], "embedding_model": null, "recorded_at_ms": 1, "detected_at_ms": 2}}'
  when 8 then '{{"type": "telemetry", {STAMP}}}'
  when 9 then 'not json ' || props else '{{{STAMP}}}' end as value from {{events}}"""


@query("bus_event_contracts", """
select event_id, case when event_id % 11 < 2 then 'detection.new' when event_id % 11 = 2 then 'track.updated' when event_id % 11 < 5 then 'plate.read'
    when event_id % 11 < 7 then 'camera.health' when event_id % 11 = 7 then 'signature.created' when event_id % 11 = 8 then 'telemetry' end as type,
  case event_id % 11 when 0 then event_id % 3 > 0 and value / 300 between 0 and 1 when 2 then value / 300 between 0 and 1
    when 4 then event_id % 4 > 0 when 5 then true when 7 then true else false end as accepted from events""")
def bus_contracts(t):
    checked = contracts.check_events(t.sql(BUS))
    return checked.select("event_id", "type", (F.size("errors") == 0).alias("accepted"))


@query("bus_quarantine_reasons", """
with e as (select event_id, case event_id % 11 when 1 then ['bbox must be four numbers', 'cls is not an allowed value', 'track_id must be present']
    when 3 then ['confidence is required', 'not of the stated types'] when 6 then ['detail must be present', 'latency_ms must be present', 'status is not an allowed value']
    when 8 then ['unknown type telemetry'] when 9 then ['no type'] when 10 then ['no type']
    when 0 then list_concat(case when event_id % 3 = 0 then ['frame.width must be positive'] else [] end, case when value / 300 between 0 and 1 then [] else ['confidence must be within 0 and 1'] end)
    when 2 then case when value / 300 between 0 and 1 then [] else ['attributes.color_confidence must be within 0 and 1'] end
    when 4 then case when event_id % 4 = 0 then ['frames_considered must be positive'] else [] end else [] end as errs from events)
select unnest(errs) as reason, count(*) as n from e group by 1""")
def quarantine(t):
    bad = contracts.quarantine(contracts.check_events(t.sql(BUS)))
    return bad.select(F.explode("errors").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("bus_valid_health_events", """
select cast(event_id as string) as event_id, 'cam' || user_id as camera_id, 'online' as status, 5e0 as latency_ms from events where event_id % 11 = 5""")
def valid_health(t):
    checked = contracts.check_events(t.sql(BUS).drop("event_id"))
    return contracts.valid_events(checked, "camera.health").select("event_id", "camera_id", "status", "latency_ms")


ALERTS = """select o_orderkey, '{"id": "a' || o_orderkey || '", "source": "' || case when o_orderkey % 9 = 4 then 'rumour' else 'internal_anpr' end
  || '", "mock": false, "priority": "high", "status": "new", "entity_type": "vehicle_plate", "entity_value": "GJ", "reason": "r", "watchlist_id": null, "watchlist_entry_id": null'
  || ', "camera_id": "c", "camera_name": "n", "district": null, "lat": null, "lon": null, "captured_at": "t", "created_at": "t", "confidence": '
  || o_totalprice / 400000 || ', "track_id": null, "evidence": {"clip_key": null}, "enrichments": ['
  || case o_orderkey % 5 when 0 then '' when 1 then '{"source": "vahan", "fetched_at": "t"}' else '{"source": "vahan", "mock": true, "fetched_at": "t"}' end
  || ']' || case when o_orderkey % 7 = 3 then '' else ', "pipeline_latency_ms": 3' end || '}' as value from {orders}"""


@query("alert_envelope_contract", """
select o_orderkey, o_orderkey % 9 <> 4 and o_orderkey % 5 <> 1 and o_orderkey % 7 <> 3 and o_totalprice / 400000 between 0 and 1 as accepted from orders""")
def alert_contract(t):
    return contracts.check_alerts(t.sql(ALERTS)).select("o_orderkey", (F.size("errors") == 0).alias("accepted"))


MESSAGES = """select o_orderkey, case o_orderkey % 5
  when 0 then '{"type": "heartbeat", "ts": 1, "server_time_ist": "x", "connected_clients": ' || o_orderkey || '}'
  when 1 then '{"type": "alert.updated", "ts": 1, "alert_id": "a", "status": "' || case when o_orderkey % 3 = 0 then 'lost' else 'resolved' end || '", "actor": "me", "note": null}'
  when 2 then '{"type": "camera.health", "ts": 1, "camera_id": "c", "status": "unknown"}'
  when 3 then '{"type": "alert.created", "ts": 1, "alert": {"id": "a", "priority": "low", "status": "new"}}'
  else '{"type": "track.updated", "ts": 1, "camera_id": "c", "track_id": 4, "bbox": [1,2,3,4], "cls": "car", "plate": null}' end as value from {orders}"""


@query("operator_message_contract", """
select o_orderkey, case o_orderkey % 5 when 1 then o_orderkey % 3 <> 0 when 2 then false else true end as accepted from orders""")
def message_contract(t):
    checked = contracts.check_events(t.sql(MESSAGES), contracts.OPERATOR_MESSAGES)
    return checked.select("o_orderkey", (F.size("errors") == 0).alias("accepted"))
