"""Appearance, fingerprints, overlay clocks and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import plates
from kerbline.functions.binding import bind
from kerbline.operators import clockread, fingerprint, quality, signatures
from kerbline.plans.index_queries import VECTOR_DIM
from kerbline.plans.registry import query
from kerbline.plans.scalar_queries import PLATE_CTES
from kerbline.session import spread

COLOURS = """
body as (select crop_id, h, s, v from {hsv_pixels} where row_no >= 1 and row_no < 5 and col_no >= 2 and col_no < 6),
st as (select crop_id, avg(v) as mv, avg(case when s < 60 then 1e0 else 0e0 end) as weak, count(*) filter (where s >= 60) as strong from body group by 1),
hues as (select crop_id, h, count(*) as n, row_number() over (partition by crop_id order by count(*) desc, h) as r from body where s >= 60 group by 1, 2),
col as (select st.crop_id,
  case when weak > 0.6 then case when mv > 170 then 'white' when mv > 90 then 'grey' else 'black' end when strong = 0 then 'grey'
    when h <= 10 then 'red' when h <= 22 then 'orange' when h <= 33 then 'yellow' when h <= 85 then 'green' when h <= 125 then 'blue'
    when h <= 155 then 'purple' else 'red' end as colour,
  round_even(case when weak > 0.6 then weak when strong = 0 then 0.3 else least(1, n / strong * 3) end, 3) as colour_confidence,
  case when weak > 0.6 then mv < 60 or (mv <= 90 and mv < 40) when strong = 0 then true else mv < 60 end as colour_uncertain
  from st left join hues on hues.crop_id = st.crop_id and r = 1)"""


@query("colour_from_pixels", f"with {COLOURS} select * from col")
def colours(t):
    return signatures.estimate_colours(t.hsv_pixels)


TRACK_VECTORS = """
tv as (select track_id, pos, avg(u) as m from (
    select track_id, unnest(range(64)) as pos, unnest(list_transform(embedding, lambda x: x / greatest(1e-6, sqrt(list_dot_product(embedding, embedding))))) as u
    from {crop_vectors}) x group by 1, 2),
tn as (select track_id, sqrt(sum(m * m)) as n from tv group by 1)"""


@query("track_mean_vector", f"""
with {TRACK_VECTORS} select tv.track_id, cast(tv.pos as int) as pos, round(tv.m / tn.n, 6) as value from tv join tn on tn.track_id = tv.track_id""")
def mean_vector(t):
    out = signatures.track_embeddings(t.crop_vectors)
    return out.select("track_id", F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.round("value", 6))




@query("signature_assembly", f"""
with {COLOURS}, {TRACK_VECTORS}, tr as (select distinct track_id, 'car' as cls from {{crop_vectors}} union all select 'empty' || cast(n_nationkey as varchar), 'bus' from nation),
big as (select 'trk' || cast(vec_id // 4 as varchar) as track_id, vec_id, 60 + vec_id * 31 % 400 as width,
  row_number() over (partition by vec_id // 4 order by (60 + vec_id * 31 % 400) * (40 + vec_id * 17 % 300) desc, vec_id) as r from embeddings)
select tr.track_id, tr.cls, col.colour, coalesce(col.colour_confidence, 0) as colour_confidence, coalesce(col.colour_uncertain, true) as colour_uncertain,
  'model' as embedding_model, coalesce(big.width * 0.25 >= 90, false) as plate_readable, 64 as dims,
  case when tr.cls = 'bus' then 0e0 else 1e0 end as norm
from tr left join big on big.track_id = tr.track_id and r = 1 left join col on col.crop_id = big.vec_id""")
def assembly(t):
    crops = t.crop_vectors.withColumn("crop_id", F.expr("cast(substr(track_id, 4) as bigint) * 4 + crop_no"))
    tracks = t.crop_vectors.select("track_id").distinct().withColumn("cls", F.lit("car")).unionByName(
        t.nation.select(F.concat(F.lit("empty"), F.col("n_nationkey").cast("string")).alias("track_id"), F.lit("bus").alias("cls")))
    out = signatures.build_signatures(tracks, crops, signatures.estimate_colours(t.hsv_pixels), dim=VECTOR_DIM, model="model")
    norm = F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)), 6)
    return out.withColumns({"dims": F.size("embedding"), "norm": norm}).drop("embedding")


@query("plate_consensus", f"""
with {PLATE_CTES}, r as (select p.track_id, b.plate, count(*) as n, avg(p.confidence) as c from {{plate_reads}} p join best b on b.raw_ocr = p.raw_ocr group by 1, 2),
w as (select *, sum(n) over (partition by track_id) as total, row_number() over (partition by track_id order by n desc, c desc, plate) as k from r)
select track_id, plate as normalized, cast(total as bigint) as frames_considered, round(n / total, 6) as agreement from w where k = 1""")
def consensus(t):
    # Small rows that are dear to read go to every core; exploded, a reading is not computed again for the filter on it.
    key = bind(plates.normalize(F.col("raw_ocr")), plates.match_key)
    reads = spread(t.plate_reads).withColumn("plate", F.explode_outer(F.array(key)))
    return signatures.plate_consensus(reads).withColumn("agreement", F.round("agreement", 6))


MEDIANS = """
px as (select label, row_no, col_no, v, row_number() over (partition by label, row_no, col_no order by v) - 1 as i,
  count(*) over (partition by label, row_no, col_no) as n from {gray_pixels}),
med as (select label, row_no, col_no, v from px where i = n // 2)"""


@query("scene_median_frame", f"with {MEDIANS} select label, cast(row_no as int) as row_no, cast(col_no as int) as col_no, v from med")
def median_frame(t):
    return fingerprint.median_frames(t.gray_pixels, ["label"]).withColumns(
        {"row_no": F.col("row_no").cast("int"), "col_no": F.col("col_no").cast("int")})


@query("scene_perceptual_hash", f"""
with {MEDIANS}, k as (select unnest(range(8)) as k),
co as (select label, r.k as r, c.k as c, sum(v * cos(pi() * (2 * row_no + 1) * r.k / 64) * cos(pi() * (2 * col_no + 1) * c.k / 64)) as v
  from med, k r, k c group by 1, 2, 3),
mid as (select label, list_sort(list(v))[32] as m from co where r + c > 0 group by 1),
bits as (select co.label, r, c, case when v > m then 1 else 0 end as b from co join mid on mid.label = co.label)
select label, string_agg(format('{{:x}}', b3 * 8 + b2 * 4 + b1 * 2 + b0), '' order by q) as phash from (
  select label, (r * 8 + c) // 4 as q, max(case when c % 4 = 0 then b end) as b3, max(case when c % 4 = 1 then b end) as b2,
    max(case when c % 4 = 2 then b end) as b1, max(case when c % 4 = 3 then b end) as b0 from bits group by 1, 2) x group by 1""")
def perceptual_hash(t):
    return fingerprint.perceptual_hash(fingerprint.median_frames(t.gray_pixels, ["label"]), ["label"])


PRINTS = "p as (select fingerprint_id as id, label, cast(floor(slot_offset_s / 1800e0) as int) as b, cast('0x' || phash as ubigint) as h from {fingerprints})"
DISTANCES = f"""{PRINTS},
d as (select case when x.b <> y.b then 'same_camera_other_bucket' when x.label = y.label then 'same_camera_same_bucket'
    else 'other_camera_same_bucket' end as scope, bit_count(xor(x.h, y.h)) as distance
  from p x join p y on x.id < y.id and (x.b = y.b or x.label = y.label))"""


def prints(t):
    return t.fingerprints.withColumn("slot_bucket", fingerprint.slot_bucket(F.col("slot_offset_s")))


@query("fingerprint_pair_distances", f"""
with {DISTANCES}, g as (select scope, distance, count(*) as pairs from d group by all)
select scope, cast(distance as int) as distance, pairs,
  case when distance <= 10 then 'match' when distance >= 18 then 'conflict' else 'uncertain' end as distance_class from g""")
def pair_distances(t):
    return fingerprint.pair_distances(prints(t))


@query("fingerprint_separation", f"""
with {DISTANCES}, s as (select cast(max(case when scope = 'same_camera_same_bucket' then distance end) as int) as worst_same,
  cast(min(case when scope = 'other_camera_same_bucket' then distance end) as int) as best_different from d)
select *, best_different - worst_same as separation, best_different - worst_same >= 8 as usable from s""")
def separation(t):
    return fingerprint.separation(fingerprint.pair_distances(prints(t)))


@query("camera_identity_decision", f"""
with {PRINTS}, known as (select label, b, min(h) as kh from p group by 1, 2)
select p.id as fingerprint_id, p.label, cast(bit_count(xor(p.h, k.kh)) as int) as distance,
  case when k.kh is null then 'no_fingerprint' when bit_count(xor(p.h, k.kh)) <= 10 then 'reattach' else 'conflict' end as decision
from p left join known k on k.label = p.label and k.b = p.b + 1""")
def identity(t):
    seen = prints(t)
    known = seen.groupBy("label", "slot_bucket").agg(F.min("phash").alias("phash"))
    shifted = known.withColumn("slot_bucket", F.col("slot_bucket") - 1)
    return fingerprint.decide_identity(shifted, seen).select("fingerprint_id", "label", "distance", "decision")


RESOLVED = """
t as (select *, regexp_replace(ocr_text, '[^0-9]', '', 'g') as seen from {clock_reads}),
cand as (select read_id, seen, d, levenshtein(strftime(make_timestamp(cast((expected_ms + d * 1000) * 1000 as bigint)), '%d%m%Y%H%M%S'), seen) as dist,
    greatest(14, length(seen)) as m from t, (select unnest(range(-1800, 1801)) as d) x where length(seen) >= 10),
rk as (select *, 1.0::double - dist::double / m as score, row_number() over (partition by read_id order by dist, abs(d), d) as k from cand
  qualify k <= 40),
b as (select read_id, score, d from rk where k = 1),
res as (select t.*, case when b.score >= 0.78 then expected_ms + b.d * 1000 end as proposed_ms,
    round_even(case when b.score is null then 0 when b.score >= 0.78 and exists (select 1 from rk where rk.read_id = t.read_id and rk.k > 1
      and rk.score >= b.score - 0.02 and abs(rk.d - b.d) > 90) then b.score * 0.5 else b.score end, 3) as score
  from t left join b on b.read_id = t.read_id)"""


@query("overlay_clock_reads", f"with {RESOLVED} select read_id, cast(proposed_ms as bigint) as proposed_ms, score from res")
def clock_reads(t):
    return clockread.resolve_reads(t.clock_reads).select("read_id", "proposed_ms", "score")


VOTED = f"""{RESOLVED},
fr as (select clip, floor(seek_s / 600) as shot, proposed_ms, count(*) as agreeing, max(score) as score, min(variant) filter (where score = mx) as variant
  from (select *, max(score) over (partition by clip, floor(seek_s / 600), proposed_ms) as mx from res) r group by 1, 2, 3),
vote as (select *, row_number() over (partition by clip, shot order by score desc, variant) as k from fr)"""


@query("overlay_clock_votes", f"""
with {VOTED} select clip, cast(shot as int) as shot, cast(proposed_ms as bigint) as proposed_ms,
  round_even(case when proposed_ms is null then score else least(1, score * (1 + 0.15 * (agreeing - 1))) end, 3) as confidence from vote where k = 1""")
def clock_votes(t):
    reads = clockread.resolve_reads(t.clock_reads).withColumn("shot", F.floor(F.col("seek_s") / 600).cast("int"))
    return clockread.vote_frames(reads, ["clip", "shot"])


@query("overlay_clock_best_anchor", f"""
with {VOTED}, a as (select clip, shot, proposed_ms, round_even(case when proposed_ms is null then score else least(1, score * (1 + 0.15 * (agreeing - 1))) end, 3) as confidence
  from vote where k = 1), z as (select *, row_number() over (partition by clip order by confidence desc, shot) as r from a)
select clip, cast(shot as int) as shot, cast(proposed_ms as bigint) as proposed_ms, confidence from z where r = 1""")
def best_anchor(t):
    return clockread.best_anchors(clock_votes(t), ["clip"], "shot")


@query("overlay_clock_pair_accuracy", f"""
with {RESOLVED}, pr as (select i.clip, i.proposed_ms as a, j.proposed_ms as b, j.seek_s - i.seek_s as s from res i join res j on i.clip = j.clip and i.read_id < j.read_id),
f as (select clip, count(*) as frames, count(proposed_ms) as frames_read from res group by 1)
select f.clip, frames, frames_read, count(pr.clip) as pairs,
  count(*) filter (where a is not null and b is not null and abs((b - a) / 1e3 - s) < 1) as exact,
  count(*) filter (where a is not null and b is not null and abs((b - a) / 1e3 - s) >= 1) as wrong,
  count(*) filter (where pr.clip is not null and (a is null or b is null)) as unreadable
from f left join pr on pr.clip = f.clip group by 1, 2, 3""")
def pair_accuracy(t):
    return clockread.pair_accuracy(clockread.resolve_reads(t.clock_reads))


@query("overlay_clock_accuracy_gate", f"""
with {RESOLVED}, pr as (select i.proposed_ms as a, j.proposed_ms as b, j.seek_s - i.seek_s as s from res i join res j on i.clip = j.clip and i.read_id < j.read_id),
g as (select count(*) as pairs, count(*) filter (where abs((b - a) / 1e3 - s) < 1) as exact,
  count(*) filter (where abs((b - a) / 1e3 - s) >= 1) as wrong, count(*) filter (where a is null or b is null) as unreadable from pr)
select pairs, exact, wrong, unreadable, round(exact / pairs, 6) as accuracy, exact / pairs >= 0.95 as passes from g""")
def gate(t):
    per_clip = clockread.pair_accuracy(clockread.resolve_reads(t.clock_reads))
    return clockread.accuracy_gate(per_clip).withColumn("accuracy", F.round("accuracy", 6))


@query("reid_separation", f"""
with {TRACK_VECTORS}, big as (select track_id from {{crop_vectors}} group by 1 having count(*) >= 4),
same as (select list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s from {{crop_vectors}} a
  join {{crop_vectors}} b on a.track_id = b.track_id and a.crop_no < b.crop_no where a.track_id in (select track_id from big)),
v as (select track_id, list(m order by pos) as e from tv where track_id in (select track_id from big) group by 1),
diff as (select list_cosine_similarity(a.e::double[], b.e::double[]) as s from v a join v b on a.track_id < b.track_id)
select (select count(*) from same) as same_pairs, round((select median(s) from same), 4) as same_median,
  (select count(*) from diff) as different_pairs, round((select median(s) from diff), 4) as different_median,
  round((select median(s) from same) - (select median(s) from diff), 4) as gap""")
def reid(t):
    r = lambda c: F.round(c, 4).alias(c)
    return quality.reid_separation(t.crop_vectors).select(
        "same_pairs", r("same_median"), "different_pairs", r("different_median"), r("gap"))


@query("plate_legibility", """
select count(*) as boxes, median(width_px) as median_width, round(quantile_cont(width_px, 0.9), 6) as p90_width,
  avg(case when width_px * 0.25 >= 90 then 1 else 0 end) as share_legible, median(width_px) * 0.25 as median_plate_width from {bulk_detections}""")
def legibility(t):
    return quality.plate_legibility(t.bulk_detections).withColumn("p90_width", F.round("p90_width", 6))


@query("colour_doubt_rate", """
select camera_id, count(*) as signatures, count(*) filter (where colour_uncertain) as doubtful,
  count(*) filter (where colour_uncertain) / count(*) as doubt_rate from {signatures} group by 1""")
def doubt(t):
    return quality.colour_doubt(t.signatures)


SEAMS = """s as (select *, last_value(case when ok then last_pts_s end ignore nulls) over (partition by camera_id, tag order by idx
    rows between unbounded preceding and 1 preceding) as prev from {clip_chunks})"""


@query("capture_chunk_seams", f"""
with {SEAMS} select camera_id, tag, idx, round(requested_offset_s - first_pts_s, 6) as keyframe_snap_s,
  round(case when prev - first_pts_s > 0 then prev - first_pts_s else 0 end, 6) as overlap_s, round(prev, 6) as prev_last_pts_s from s""")
def seams(t):
    out = quality.chunk_seams(t.clip_chunks)
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("camera_id", "tag", "idx", r("keyframe_snap_s"), r("overlap_s"), r("prev_last_pts_s"))


@query("capture_manifest_totals", f"""
with {SEAMS} select camera_id, tag, count(*) filter (where ok) as chunks_ok, count(*) as chunks_total,
  round(sum(case when prev - first_pts_s > 0 then prev - first_pts_s else 0 end), 6) as cumulative_overlap_s, bool_and(ok) as complete
from s group by 1, 2""")
def manifest(t):
    return quality.manifest_totals(quality.chunk_seams(t.clip_chunks)).withColumn(
        "cumulative_overlap_s", F.round("cumulative_overlap_s", 6))


@query("capture_fresh_frames", f"""
with {SEAMS}, fr as (select camera_id, tag, idx, prev, unnest([first_pts_s, first_pts_s + 10, first_pts_s + 30, last_pts_s]) as pts_s from s where ok)
select camera_id, tag, idx, count(*) as frames, round(min(pts_s), 6) as first_fresh_s from fr where prev is null or pts_s > prev group by 1, 2, 3""")
def fresh(t):
    c = F.col
    chunks = t.clip_chunks
    pts = F.explode(F.array(c("first_pts_s"), c("first_pts_s") + 10, c("first_pts_s") + 30, c("last_pts_s")))
    frames = chunks.where("ok").select("camera_id", "tag", "idx", pts.alias("pts_s"))
    kept = quality.fresh_frames(frames, quality.chunk_seams(chunks))
    return kept.groupBy("camera_id", "tag", "idx").agg(F.count("*").alias("frames"), F.round(F.min("pts_s"), 6).alias("first_fresh_s"))
