"""Plates, slots, distances and text, applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import clock, geo, plates, text, vectors
from kerbline.plans.registry import query

STATES = ", ".join(f"('{s}')" for s in plates.STATE_CODES)

# Readings of a plate written as joins over the legal layouts, independent of the Spark expressions.
PLATE_CTES = f"""
states(code) as (values {STATES}),
layouts as (select n, r, (4 - n) * 2 + (2 - r) + 1 as pos from (values (4), (3), (2), (1)) a(n), (values (2), (1)) b(r)),
raws as (select distinct raw_ocr from {{plate_reads}}),
texts as (select raw_ocr, regexp_replace(upper(raw_ocr), '[^A-Z0-9]', '', 'g') as s from raws),
fixes as (select raw_ocr, s, case when length(s) between 4 and 11 then
    translate(substr(s, 1, 2), '0124568', 'OIZASGB') || translate(substr(s, 3, 1), 'OQDILJZASBGT', '000111245867')
    || substr(s, 4, greatest(length(s) - 3 - least(4, length(s) - 3), 0))
    || translate(right(s, least(4, length(s) - 3)), 'OQDILJZASBGT', '000111245867') end as fixed from texts),
forms as (select raw_ocr, s, false as repaired from texts
  union all select raw_ocr, fixed, true from fixes where fixed <> s),
parses as (
  select raw_ocr, repaired, pos, substr(s, 1, 2) as state_code, lpad(substr(s, 3, r), 2, '0') as rto_code,
    substr(s, 3 + r, length(s) - 2 - r - n) as series, right(s, n) as number, 'standard' as kind,
    substr(s, 1, 2) || lpad(substr(s, 3, r), 2, '0') || substr(s, 3 + r, length(s) - 2 - r - n) || right(s, n) as plate
  from forms, layouts
  where regexp_full_match(s, '[A-Z][A-Z][0-9]{{' || r || '}}[A-Z]{{0,3}}[0-9]{{' || n || '}}')
    and substr(s, 1, 2) in (select code from states)
  union all
  select raw_ocr, repaired, 0, null, substr(s, 1, 2), substr(s, 9), substr(s, 5, 4), 'bharat', s
  from forms where regexp_full_match(s, '[0-9][0-9]BH[0-9][0-9][0-9][0-9][A-Z][A-Z]?')),
scored as (select *, case when length(number) = 4 then 100 else 12 * length(number) end - case when repaired then 8 else 0 end
    + case when length(series) between 1 and 2 then 3 else 0 end + 2 + case when kind = 'bharat' then 5 else 0 end as score
  from parses),
ranked as (select *, row_number() over (partition by raw_ocr order by repaired, score desc, pos) as best_rank,
    row_number() over (partition by raw_ocr order by score desc, repaired, pos) as list_rank from scored),
best as (select * from ranked where best_rank = 1),
alts as (select raw_ocr, plate, min(list_rank) as place from ranked r
  where plate <> (select plate from best b where b.raw_ocr = r.raw_ocr) group by 1, 2),
alt_lists as (select raw_ocr, string_agg(plate, ',' order by place) as alternates from alts group by 1)"""


@query("plate_normalize", f"""
with {PLATE_CTES}
select p.read_id, t.s as cleaned, b.plate, b.state_code, b.rto_code, nullif(b.series, '') as series, b.number,
  coalesce(b.kind, 'unknown') as kind, b.plate is not null as valid, coalesce(b.repaired, false) as repaired,
  coalesce(a.alternates, '') as alternates
from {{plate_reads}} p join texts t on t.raw_ocr = p.raw_ocr
left join best b on b.raw_ocr = p.raw_ocr left join alt_lists a on a.raw_ocr = p.raw_ocr""")
def plate_normalize(t):
    out = plates.normalize_plates(t.plate_reads, "raw_ocr")
    r = F.col("plate_read")
    return out.select(
        "read_id", plates.clean(F.col("raw_ocr")).alias("cleaned"), r["plate"].alias("plate"), r["state_code"].alias("state_code"),
        r["rto_code"].alias("rto_code"), r["series"].alias("series"), r["number"].alias("number"), r["kind"].alias("kind"),
        r["valid"].alias("valid"), r["repaired"].alias("repaired"), F.array_join(r["alternates"], ",").alias("alternates"),
    )


@query("plate_normalize_no_repair", """
select read_id, regexp_full_match(s, '([A-Z][A-Z][0-9][0-9]?[A-Z]{0,3}[0-9]{1,4}|[0-9][0-9]BH[0-9]{4}[A-Z]{1,2})')
  and (s[3:4] = 'BH' or substr(s, 1, 2) in (""" + ", ".join(f"'{s}'" for s in plates.STATE_CODES) + """)) as valid
from (select read_id, regexp_replace(upper(raw_ocr), '[^A-Z0-9]', '', 'g') as s from {plate_reads}) p""")
def plate_no_repair(t):
    out = plates.normalize_plates(t.plate_reads, "raw_ocr", allow_repair=False)
    return out.select("read_id", F.col("plate_read")["valid"].alias("valid"))


@query("plate_distance", """
with c as (select read_id, regexp_replace(upper(raw_ocr), '[^A-Z0-9]', '', 'g') as s from {plate_reads})
select a.read_id, case when levenshtein(a.s, b.s) > 3 then 4 else levenshtein(a.s, b.s) end as distance
from c a join c b on b.read_id = a.read_id - a.read_id % 26""")
def plate_distance(t):
    reads = t.plate_reads
    base = reads.select(F.col("read_id").alias("base_id"), F.col("raw_ocr").alias("base_ocr"))
    return reads.join(base, F.col("base_id") == F.col("read_id") - F.col("read_id") % 26).select(
        "read_id", plates.plate_distance(F.col("raw_ocr"), F.col("base_ocr")).alias("distance")
    )


LEG_PAIRS = """
select c.camera_id, c.lat as a_lat, c.lng as a_lng, cast(1000000 as double) as a_ms, d.camera_id as to_camera,
  d.lat as b_lat, d.lng as b_lng, 1000000e0 + (c.camera_no * 7919 % 30000) * 1000e0 - 9000e0 as b_ms
from {cameras} c join {cameras} d on d.camera_no = c.camera_no + 1"""


@query("leg_plausibility", f"""
with p as ({LEG_PAIRS}), k as (select *, abs(b_ms - a_ms) / 1000e0 as s,
  2 * 6371e0 * asin(sqrt(pow(sin(radians(b_lat - a_lat) / 2), 2)
    + cos(radians(a_lat)) * cos(radians(b_lat)) * pow(sin(radians(b_lng - a_lng) / 2), 2))) as d from p)
select camera_id, to_camera, round(d, 4) as km, case when s >= 20 then round(d / (s / 3600e0), 4) end as speed_kmh,
  d is not null as verifiable, case when d is null then true when s < 20 then d <= 1.5 else d / (s / 3600e0) <= 140 end as possible
from k""")
def leg_plausibility(t):
    out = geo.assess_legs(t.sql(LEG_PAIRS))
    return out.select("camera_id", "to_camera", F.round("km", 4).alias("km"), F.round("speed_kmh", 4).alias("speed_kmh"),
                      "verifiable", "possible")


@query("cosine_guarded_and_plain", """
with v as (select vec_id, cast(embedding as double[]) as e from embeddings)
select a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) as guarded, round(list_dot_product(a.e, b.e), 6) as plain
from v a join v b on b.vec_id = a.vec_id - a.vec_id % 4""")
def cosine(t):
    v = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    base = v.select(F.col("vec_id").alias("base_id"), F.col("e").alias("base"))
    return v.join(base, F.col("base_id") == F.col("vec_id") - F.col("vec_id") % 4).select(
        "vec_id", F.round(vectors.guarded_cosine(F.col("e"), F.col("base")), 6).alias("guarded"),
        F.round(vectors.plain_cosine(F.col("e"), F.col("base")), 6).alias("plain"),
    )


@query("slot_arithmetic", """
with s as (select camera_id, now_ms, duration_s, ((now_ms / 1e3 + 19800 - 32400) % 43200 + 43200) % 43200 as o from {publisher_state})
select camera_id, round(o, 3) as slot_offset_s, cast(round(now_ms - o * 1000) as bigint) as slot_start_ms,
  round(43200 - o, 3) as until_rollover_s,
  round(case when duration_s > 0 then o % duration_s else o end, 3) as position_s,
  round(case when duration_s > 0 then least(o, greatest(0, duration_s - 0.5)) else o end, 3) as position_no_loop_s,
  round(case when duration_s > 0 then greatest(0, duration_s - o % duration_s) end, 3) as until_loop_s,
  'slot ' || case when cast(floor((now_ms - o * 1000) / 60000 + 330) as bigint) % 1440 = 540 then '09:00–21:00' else '21:00–09:00' end
    || ' IST, ' || cast(cast(floor(o / 3600) as int) as varchar) || 'h'
    || lpad(cast(cast(floor(o % 3600 / 60) as int) as varchar), 2, '0') || 'm in' as slot_text
from s""")
def slots(t):
    out = clock.slot_report(t.publisher_state, "now_ms", "duration_s")
    r = lambda c: F.round(c, 3).alias(c)
    return out.select("camera_id", r("slot_offset_s"), F.round("slot_start_ms").cast("bigint").alias("slot_start_ms"),
                      r("until_rollover_s"), r("position_s"), r("position_no_loop_s"), r("until_loop_s"), "slot_text")


@query("time_text", """
select event_id, strftime(make_timestamp((observed_at_ms + 19800000) * 1000), '%d/%m/%Y, %H:%M:%S') || ' IST' as ist,
  strftime(make_timestamp((observed_at_ms + 19800000) * 1000), '%H:%M:%S') as ist_time,
  strftime(make_timestamp((observed_at_ms + 19800000) * 1000), '%d/%m/%Y, %H:%M:%S.%g') || ' IST' as ist_precise,
  case when s < 60 then s || 's ago' when s < 3600 then s // 60 || 'm ' || s % 60 || 's ago'
    when s < 86400 then s // 3600 || 'h ' || s // 60 % 60 || 'm ago' else s // 86400 || 'd ' || s // 3600 % 24 || 'h ago' end as age,
  skew as skew_ms, abs(skew) > 3000 as skew_warning,
  greatest(0, latency_ms * 3 - 200) as latency
from (select *, greatest(0, (1706000000000 - observed_at_ms) // 1000) as s, event_id % 9000 - 4500 as skew from {health}) h""")
def time_text(t):
    seen = F.col("observed_at_ms")
    rows = t.health.withColumns({"server_ms": seen, "client_ms": seen + F.col("event_id") % 9000 - 4500})
    return clock.skew(rows, "server_ms", "client_ms").select(
        "event_id", clock.format_ist(seen).alias("ist"), clock.format_ist_time(seen).alias("ist_time"),
        clock.format_ist(seen, precise=True).alias("ist_precise"),
        clock.format_age(seen, F.lit(1706000000000)).alias("age"), "skew_ms", "skew_warning",
        clock.latency_ms(seen + 200, seen + F.col("latency_ms") * 3).alias("latency"),
    )


@query("stream_message_classes", """
select camera_id, case
    when regexp_matches(message, 'Could not find ref with POC|missing picture in access unit|no frame\\b|non-existing PPS|decode_slice_header error|Invalid NAL unit size|short term ref pic set|RPS|corrupted macroblock|Frame num gap', 'i') then 'benign'
    when regexp_matches(message, 'Connection refused|No route to host|401 Unauthorized|403 Forbidden|404 Not Found|Server returned [0-9]+|Immediate exit requested|Invalid data found when processing input', 'i') then 'fatal'
    else 'warning' end as message_class, count(*) as n from {stream_log} group by 1, 2""")
def message_classes(t):
    return text.classify_log(t.stream_log).groupBy("camera_id", "message_class").agg(F.count("*").alias("n"))


LABELS = """
select c_custkey, case c_custkey % 5 when 0 then cast(c_custkey % 90 as string) || ' new-bypass-near_' || lower(c_mktsegment) || '-2'
    when 1 then c_mktsegment || ' Char Rasta' when 2 then cast(c_custkey as string)
    when 3 then ' 07 ' || c_mktsegment || '-3-14 ' else lower(c_mktsegment) || ', junction' end as label,
  case c_custkey % 4 when 0 then null when 1 then c_mktsegment || ' Char Rasta' when 2 then lower(c_mktsegment) || ' char rasta' else ' Gate ' || c_mktsegment end as name,
  case when c_custkey % 3 = 0 then null else 'NATION ' || cast(c_nationkey as string) || ' District' end as district
from {customer}"""


@query("place_search_phrases", f"""
with l as ({LABELS}), c as (select *, trim(regexp_replace(trim(regexp_replace(regexp_replace(trim(label), '^[0-9]+ ', ''), '[-_]', ' ', 'g')),
    '(^|\\s+)[0-9]+(\\s+[0-9]+)*$', '')) as base, trim(coalesce(name, '')) as nm from l),
q as (select c_custkey, 1 as pos, nm || ', ' || district || ', Gujarat, India' as q from c where nm <> '' and district is not null
  union all select c_custkey, 2, nm || ', Gujarat, India' from c where nm <> ''
  union all select c_custkey, 3, base || ', ' || district || ', Gujarat, India' from c where base <> '' and district is not null
  union all select c_custkey, 4, base || ', Gujarat, India' from c where base <> ''),
d as (select c_custkey, min(pos) as pos, arg_min(q, pos) as q from q group by c_custkey, lower(q))
select l.c_custkey, coalesce((select string_agg(q, ' | ' order by pos) from d where d.c_custkey = l.c_custkey), '') as phrases,
  case when regexp_matches(trim(label), '^[0-9]+( |$)') then cast(regexp_extract(trim(label), '^([0-9]+)', 1) as int) end as label_number,
  trim(replace(lower(coalesce(district, '')), ' district', '')) as normal_district
from l""")
def place_phrases(t):
    c = F.col
    return t.sql(LABELS).select(
        "c_custkey", F.array_join(text.place_queries(c("name"), c("label"), c("district")), " | ").alias("phrases"),
        text.label_number(c("label")).alias("label_number"), text.normal_district(c("district")).alias("normal_district"),
    )


@query("attribute_match", """
with w as (select entry_id, entity_value, list_filter(regexp_split_to_array(lower(entity_value), '[\\s,]+'), lambda x: x <> '') as words
  from {watchlist_entries} where entity_type = 'vehicle_attributes'),
kinds as (select distinct words from w),
looks as (select cls, colour, colour_uncertain, count(*) as n from {signatures} group by all)
select array_to_string(words, ' ') as descriptor, cls, coalesce(colour, '-') as colour, colour_uncertain, n from kinds, looks
where list_contains(words, cls) and (not list_has_any(words, ['white', 'black', 'grey', 'silver', 'red', 'blue', 'green', 'yellow', 'orange', 'purple'])
  or (not colour_uncertain and list_contains(words, coalesce(colour, ''))))""")
def attribute_match(t):
    words = (
        t.watchlist_entries.where("entity_type = 'vehicle_attributes'")
        .select(text.descriptor_words(F.col("entity_value")).alias("words")).distinct()
        .withColumn("word", F.explode(F.array_distinct("words")))
    )
    looks = t.signatures.groupBy("cls", "colour", "colour_uncertain").agg(F.count("*").alias("n"))
    c = F.col
    return looks.join(words, F.lower("cls") == c("word")).where(
        text.attributes_agree(c("cls"), c("colour"), c("colour_uncertain"), c("words"))
    ).select(F.array_join("words", " ").alias("descriptor"), "cls", F.coalesce("colour", F.lit("-")).alias("colour"),
             "colour_uncertain", "n")
