import json
import random

from pyspark.sql import functions as F

from kerbline.operators import alerts, frames, tracks
from kerbline.sources import sinks
from kerbline.streaming import pipeline, processors, stateful

SIGHT = ("seq bigint, track_id string, entry_id string, camera_id string, confidence double, matched_via string, repaired boolean, source string, "
         "priority string, recorded_ms bigint, pipeline_latency_ms bigint")


def landed(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/part={i:03d}")
    return spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").drop("part")


def sight(seq, track, conf, via="appearance", entry="e"):
    return (seq, track, entry, "c", conf, via, via == "plate-alternate", "internal_reid", "high", 1000 * seq, seq)


def test_alerts_fold_upward_and_say_what_changed(spark, folder):
    batches = [[sight(1, "a", 0.8), sight(2, "b", 0.9)], [sight(3, "a", 0.95, "plate"), sight(4, "a", 0.95, "plate-alternate")], [sight(5, "a", 0.5), sight(6, None, 0.7), sight(7, None, 0.7)]]
    stream = landed(spark, folder, batches, SIGHT)
    for _ in range(2):  # the second run finds everything done
        q = pipeline.fold_stream(stream, out=f"{folder}/alerts", checkpoint=f"{folder}/cp", available_now=True)
        q.awaitTermination()
    log = sinks.read_log(spark, f"{folder}/alerts")
    assert sorted((r.batch_id, r.track_id or "-", r.change) for r in log.collect()) == [
        (0, "a", "alert"), (0, "b", "alert"), (1, "a", "alert.updated"), (2, "-", "alert"), (2, "-", "alert"), (2, "a", "alert.updated")]
    a = sinks.current_alerts(log).where("track_id = 'a'").first()
    assert (a.confidence, a.matched_via, a.repaired, a.recorded_ms, a.last_seen_ms, a.pipeline_latency_ms) == (0.95, "plate", False, 1000, 5000, 1)
    batch = alerts.fold_alerts(spark.createDataFrame([r for b in batches for r in b], SIGHT))
    cols = [c for c in batch.columns]
    assert sorted(map(repr, sinks.current_alerts(log).select(*cols).collect())) == sorted(map(repr, batch.collect()))
    counters = pipeline.live_counters(log, spark.createDataFrame([(7,)], "processed bigint")).first()
    assert (counters.processed, counters.raised) == (7, 4)


def test_first_sighting_fixes_the_alert(spark):
    rows = [sight(2, "a", 0.9, "plate"), sight(1, "a", 0.9)]
    r = alerts.fold_alerts(spark.createDataFrame(rows, SIGHT)).first()
    assert (r.recorded_ms, r.matched_via, r.last_seen_ms) == (1000, "appearance", 2000)
    one = alerts.fold_alerts(spark.createDataFrame(rows[:1], SIGHT)).first()
    assert one.last_seen_ms is None


def test_latency_percentiles(spark):
    df = spark.createDataFrame([(v,) for v in [5, 1, 9, 7, 3, 3000, 2000]], "v bigint")
    r = alerts.latency_percentiles(df, "v", {"p50": 0.5, "p95": 0.95, "p100": 1.0}).first()
    assert (r.n, r.p50, r.p95, r.p100) == (7, 7, 3000, 3000)
    assert alerts.latency_percentiles(df.limit(0), "v", {"p50": 0.5}).count() == 0


FRAME = "camera_id string, connection_id string, seq bigint, pts_ms double, arrival_ms double, scene_cut boolean, clock_backwards boolean"


def test_sampling_across_batches_equals_batch(spark, folder):
    rng, rows, pts = random.Random(1), [], 0.0
    for seq in range(300):
        pts = 0.0 if rng.random() < 0.02 else pts + rng.choice([20.0, 60.0, 95.0, 150.0, 310.0])
        rows.append((f"cam{seq % 2}", "c", seq, pts, 1e6 + seq * 70 + rng.random() * 9, rng.random() < 0.01, False))
    parts = [rows[:70], rows[70:71], rows[71:200], rows[200:]]
    stream = stateful.sampled_frames(landed(spark, folder, parts, FRAME), 100.0, settle_ms=900, burst_guard_ms=300)
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/cp").option("path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    cols = ["camera_id", "segment", "seq", "pts_ms", "emitted_at_seq"]
    got = sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").select(*cols).collect())
    seg = frames.mark_segments(spark.createDataFrame(rows, FRAME), chunk_seq=40)
    want = sorted(tuple(r) for r in frames.sample_on_grid(seg, 100.0, chunk_seq=40).select(*cols).collect())
    assert got == want and len(got) > 100
    anchored = {r.seq: (r.anchor_ms, r.anchor_settled) for r in frames.anchor_clock(seg, settle_ms=900, burst_guard_ms=300, chunk_seq=40).collect()}
    for r in spark.read.parquet(f"{folder}/out").collect():
        best, settled = anchored[r.emitted_at_seq]
        assert r.anchor_settled == settled and (r.absolute_ms is None) == (best is None)
        assert best is None or abs(r.absolute_ms - best - r.pts_ms) < 1e-6


def test_tracks_across_batches_equal_batch(spark, folder):
    schema = "camera_id string, segment int, seq bigint, recorded_ms bigint, tracker_id bigint, cls string, starts_segment boolean"
    rng, rows, now = random.Random(3), [], 0
    for seq in range(400):
        now += rng.choice([100, 900, 1900, 2500])
        for tracker in rng.sample(range(4), rng.randint(0, 2)) or [None]:
            rows.append((f"cam{seq % 2}", 0, seq, now, tracker, rng.choice(["car", "person"]), False))
    flush = [(f"cam{c}", 1, 1000 + c, now + 1, None, "car", True) for c in range(2)]
    cut = next(i for i, r in enumerate(rows) if r[2] == 150)
    stream = stateful.closed_tracks(landed(spark, folder, [rows[:cut], rows[cut:], flush], schema))
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/cp").option("path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    cols = ["camera_id", "tracker_id", "cls", "started_ms", "ended_ms", "frame_count"]
    got = sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").select(*cols).collect())
    df = spark.createDataFrame(rows, schema).drop("starts_segment")
    shown = df.groupBy("camera_id", "segment", F.col("seq").alias("frame_seq")).agg(F.min("recorded_ms").alias("recorded_ms"))
    batch = tracks.build_tracks(tracks.track_sessions(df, shown, chunk_ms=20_000))
    assert got == sorted(tuple(r) for r in batch.select(*cols).collect()) and len(got) > 50


def test_bad_events_are_set_aside_and_the_watchlist_is_reread(spark, folder):
    good = {"type": "signature.created", "event_id": "t1:1", "camera_id": "c", "camera_label": "", "track_id": "t1", "cls": "truck", "colour": "white",
            "colour_confidence": 0.9, "colour_uncertain": False, "partial_plate": "GJ01AB1234", "embedding": [1.0, 0.0], "embedding_model": None,
            "recorded_at_ms": 1, "detected_at_ms": 2}
    spark.createDataFrame([(json.dumps(good),), (json.dumps({**good, "cls": "boat"}),), ("{",)], "value string").coalesce(1).write.text(f"{folder}/in")
    targets = spark.createDataFrame([("p", "vehicle_plate", "GJ01AB1234", "r", "high")], "entry_id string, entity_type string, entity_value string, reason string, priority string")
    views = spark.createDataFrame([], "entry_id string, embedding array<double>, embedding_model string")
    loads = []
    watch = pipeline.Watchlist(lambda: loads.append(1) or (targets, views), refresh_s=3600)
    q = pipeline.match_stream(pipeline.signature_files(spark, f"{folder}/in"), watch, dim=2, out=f"{folder}/out", checkpoint=f"{folder}/cp", available_now=True)
    q.awaitTermination()
    (m,) = sinks.read_log(spark, f"{folder}/out/matches").collect()
    assert (m.entry_id, m.matched_via, m.track_id) == ("p", "plate", "t1")
    assert sinks.read_log(spark, f"{folder}/out/quarantine").count() == 2
    assert sinks.read_log(spark, f"{folder}/out/counters").first().processed == 1
    watch.current()
    assert len(loads) == 1 and watch.current(force=True) and len(loads) == 2


def test_a_camera_that_falls_silent_has_its_tracks_closed(spark, folder):
    import time

    schema = "camera_id string, seq bigint, recorded_ms bigint, tracker_id bigint, cls string, starts_segment boolean"
    first = [("silent", 1, 0, 7, "car", False), ("silent", 2, 40, 7, "car", False), ("live", 1, 0, 3, "bus", False)]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(f"{folder}/in/part=0")
    stream = spark.readStream.schema(schema + ", part int").parquet(f"{folder}/in").drop("part")
    out = stateful.closed_tracks(stream, departed_after_ms=4_000)
    writer = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/cp").option("path", f"{folder}/out")
    q = writer.trigger(processingTime="1 second").start()
    try:
        for i in range(1, 8):
            time.sleep(2)
            spark.createDataFrame([("live", 1 + i, 40 * i, 3, "bus", False)], schema).coalesce(1).write.parquet(f"{folder}/in/part={i}")
    finally:
        q.stop()
    got = spark.read.schema(out.schema).parquet(f"{folder}/out").where("camera_id = 'silent'").collect()
    assert [(r.tracker_id, r.started_ms, r.ended_ms, r.frame_count) for r in got] == [(7, 0, 40, 2)]


def test_a_feed_that_ends_leaves_no_track_open(spark, folder):
    schema = "camera_id string, seq bigint, recorded_ms bigint, tracker_id bigint, cls string, starts_segment boolean"
    batches = [[("a", 1, 0, 7, "car", False), ("b", 1, 0, 3, "person", False)], [("a", 2, 40, 7, "car", False), ("a", 3, 9_000_000, 8, "bus", False)]]
    stream = landed(spark, folder, batches, schema)
    want = [("a", 7, 0, 40, 2), ("a", 8, 9_000_000, 9_000_000, 1), ("b", 3, 0, 0, 1)]
    for _ in range(2):  # the second run finds everything done
        got = stateful.tracks_to_end(stream, f"{folder}/run")
        assert sorted((r.camera_id, r.tracker_id, r.started_ms, r.ended_ms, r.frame_count) for r in got.collect()) == want


def test_expired_alerts_are_read_from_the_table(spark, folder):
    """Whatever the time to live and however the sightings are cut, the table is that of the batch fold."""
    rng = random.Random(5)
    rows = [sight(i, rng.choice("abcd"), rng.choice([0.5, 0.7, 0.9]), rng.choice(["plate", "appearance"])) for i in range(1, 60)] + [sight(90, None, 0.4), sight(91, None, 0.4)]
    want = sorted(map(repr, alerts.fold_alerts(spark.createDataFrame(rows, SIGHT)).drop("alert_id").collect()))
    for name, ttl, cuts in (("long", 3_600_000, [20, 21, 40]), ("none", 1, [5, 30, 31, 50]), ("one", 1, [])):
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        stream = landed(spark, f"{folder}/{name}", parts, SIGHT)
        for _ in range(2):  # the second run finds everything done
            pipeline.alert_stream(stream, out=f"{folder}/{name}/alerts", checkpoint=f"{folder}/{name}/cp", ttl_ms=ttl, available_now=True).awaitTermination()
        log = sinks.read_log(spark, f"{folder}/{name}/alerts")
        table = sinks.read_alerts(spark, f"{folder}/{name}/alerts")
        cols = alerts.fold_alerts(spark.createDataFrame(rows, SIGHT)).drop("alert_id").columns
        assert sorted(map(repr, table.select(*cols).collect())) == want
        assert log.count() == log.select("batch_id", "alert_id").distinct().count()
        new = [r.alert_id for r in log.where("change = 'alert'").collect()]
        assert len(new) == len(set(new)) == 6  # every alert is new once


def test_alert_state_is_one_row_per_bucket_however_many_alerts(spark, folder):
    rows = [sight(i, f"t{i % 3000}", 0.5 + i % 7 / 20) for i in range(1, 9001)]
    stream = landed(spark, folder, [rows[:5000], rows[5000:]], SIGHT)
    pipeline.alert_stream(stream, out=f"{folder}/alerts", checkpoint=f"{folder}/cp", available_now=True).awaitTermination()
    held = spark.read.format("statestore").option("stateVarName", "alerts").load(f"{folder}/cp")
    assert 0 < held.count() <= processors.BUCKETS < 3000
    want = alerts.fold_alerts(spark.createDataFrame(rows, SIGHT)).drop("alert_id")
    got = sinks.read_alerts(spark, f"{folder}/alerts").select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


class Kept:
    """A value state, and the clock of its micro-batch."""

    def __init__(self):
        self.value, self.now = None, 0

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_alerts_of_a_bucket_expire_each_for_itself_and_nulls_come_last():
    kept, taken = Kept(), processors.AlertProcessor(10)
    taken.init(kept)

    def batch(now, *rows):
        kept.now = now
        read = [(0, track, "e", "", seq, conf, f"via{seq}", False, "s", "high", "c", seq, 1) for seq, track, conf in rows]
        return {r.track_id: (r.change, r.first_order, r.confidence, r.matched_via, r.last_seen_ms, r.sightings) for r in taken.handleInputRows((0,), iter(read), kept)}

    assert batch(0, (2, "a", 0.5), (1, "a", 0.5), (None, "b", None)) == {
        "a": ("alert", 1, 0.5, "via1", 2, 2), "b": ("alert", None, None, "viaNone", None, 1)}
    assert batch(5, (9, "b", 0.4), (8, "b", None)) == {"b": ("alert.updated", None, 0.4, "via9", 9, 3)}
    # Twelve after its last sighting a is forgotten; b, seen seven ago, is not. Neither is c, of which nothing was known.
    assert batch(12, (3, "a", 0.1), (4, "b", 0.9), (5, "c", 0.2)) == {
        "a": ("alert", 3, 0.1, "via3", None, 1), "b": ("alert.updated", None, 0.9, "via4", 4, 4), "c": ("alert", 5, 0.2, "via5", None, 1)}


def feed(n, seed):
    """Frames of two cameras, with a second connection each, breaks, and when each frame lands."""
    rng, rows, pts = random.Random(seed), [], {}
    for seq in range(n):
        cam = f"cam{seq % 2}"
        conn = "c1" if seq < n // 2 else "c2"
        pts[cam, conn] = 0.0 if rng.random() < 0.02 else pts.get((cam, conn), 0.0) + rng.choice([20.0, 60.0, 95.0, 150.0, 310.0])
        arrival = 1e6 + seq * 70.0
        rows.append((cam, conn, seq, pts[cam, conn], arrival, rng.random() < 0.01, False, arrival + (rng.choice([0, 900, 1900]) if rng.random() < 0.3 else 0), False))
    return sorted(rows, key=lambda r: (r[7], r[2]))


LANDED = FRAME + ", landed double, closes boolean"


def fed(spark, folder, rows, cuts, rule):
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    stream = landed(spark, folder, parts, LANDED)
    pipeline.to_end(stream, lambda s, at: pipeline.feed_stream(s, rule, out=folder, checkpoint=at, available_now=True), folder, "camera", {"landed": F.lit(1e300), "closes": F.lit(True)})
    read = lambda log, *c: sorted(map(repr, map(tuple, sinks.read_log(spark, f"{folder}/{log}").select(*c).collect())))
    return (read("frames", "camera_id", "connection_id", "segment", "seq", "pts_ms", "absolute_ms", "anchor_settled", "emitted_at_seq"),
            read("events", "kind", "camera_id", "connection_id", "segment", "seq"), read("late", "camera_id", "connection_id", "seq"))


def test_a_feed_out_of_order_equals_batch_however_it_is_cut(spark, folder):
    rows, rule = feed(240, 1), processors.Sampling(100.0, settle_ms=900, burst_guard_ms=300, delay_ms=2_000)
    got = [fed(spark, f"{folder}/{i}", rows, cuts, rule) for i, cuts in enumerate(([], [7, 8, 120], list(range(30, 240, 60))))]
    assert got[0] == got[1] == got[2] and not got[0][2]
    segs = frames.mark_segments(spark.createDataFrame([r[:7] for r in rows], FRAME), chunk_seq=40)
    kept = frames.sample_on_grid(segs, 100.0, chunk_seq=40).select("camera_id", "connection_id", "segment", "seq", "emitted_at_seq").collect()
    read = sinks.read_log(spark, f"{folder}/0/frames").select("camera_id", "connection_id", "segment", "seq", "emitted_at_seq").collect()
    assert sorted(map(tuple, read)) == sorted(map(tuple, kept)) and len(kept) > 100
    loops = sorted((r.camera_id, r.seq, r.payload) for r in frames.loop_events(segs).collect())
    events = sinks.read_log(spark, f"{folder}/0/events").collect()
    assert sorted((r.camera_id, r.seq, r.payload) for r in events if r.kind == "camera.loop") == loops and loops
    assert sorted((r.camera_id, r.seq) for r in events if r.kind == "camera.reconnect") == [("cam0", 120), ("cam1", 121)]


def test_late_frames_are_set_aside_however_the_feed_is_cut(spark, folder):
    rows = feed(160, 2)
    rows = sorted([(*r[:7], r[4] + 6_000.0, False) if r[2] in (20, 21, 30) else r for r in rows], key=lambda r: (r[7], r[2]))
    rule = processors.Sampling(100.0, settle_ms=900, burst_guard_ms=300, delay_ms=2_000)
    a, b = (fed(spark, f"{folder}/{i}", rows, cuts, rule) for i, cuts in enumerate(([], [40, 70, 100])))
    assert a == b and len(a[2]) == 3
    c = fed(spark, f"{folder}/c", [r for r in rows if r[2] not in (20, 21, 30)], [50, 60], rule)
    assert c[:2] == a[:2]


def test_a_connection_left_behind_is_finished(spark):
    """Nothing of it stays in the state once its camera has gone on for long enough; a camera that is closed has none."""
    walk = processors.Walk()
    rule = processors.Sampling(100.0, delay_ms=500)
    assert walk.lands([1, 0.0, 1000.0, False], rule) and walk.lands([3, 40.0, 1900.0, False], rule)
    assert [r[0] for r in walk.due_rows()] == [1]
    assert not walk.lands([2, 20.0, 1399.0, False], rule) and walk.lands([2, 20.0, 1400.0, False], rule)
    assert not walk.lands([1, 0.0, 1900.0, False], rule)  # its place has been taken
    assert [r[0] for r in walk.due_rows(everything=True)] == [2, 3]


def test_live_signatures_equal_the_cadence(spark, folder):
    schema = "camera_id string, seq bigint, recorded_ms bigint, tracker_id bigint, cls string, starts_segment boolean, embedding array<double>, area double"
    rng, rows, now = random.Random(3), [], 0
    for seq in range(300):
        now += rng.choice([100, 300, 900, 2500])
        for tracker in rng.sample(range(3), rng.randint(0, 2)) or [None]:
            vector = None if tracker is None or rng.random() < 0.1 else [rng.random(), rng.random(), 0.5]
            rows.append((f"cam{seq % 2}", seq, now, tracker, "person" if tracker == 2 else "car", False, vector, None if tracker is None else float(rng.randrange(40))))
    cuts = [i for i, r in enumerate(rows) if r[1] in (80, 81, 200) and rows[i - 1][1] != r[1]]
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    stream = landed(spark, folder, parts, schema)
    closing = {"seq": F.lit((1 << 63) - 1), "recorded_ms": F.lit(0), "starts_segment": F.lit(True)}
    rule = processors.Identification(max_crops=3)
    pipeline.to_end(stream, lambda s, at: pipeline.signature_stream(s, rule, out=folder, checkpoint=at, available_now=True), folder, "tracks", closing)
    df = spark.createDataFrame(rows, schema)
    shown = df.groupBy("camera_id", F.col("seq").alias("frame_seq")).agg(F.min("recorded_ms").alias("recorded_ms"))
    sessions = tracks.track_sessions(df, shown, chunk_ms=20_000)
    built = tracks.build_tracks(sessions)
    want = tracks.signature_moments(sessions, built).select("camera_id", "tracker_id", "frames_seen", "recorded_ms", "provisional").collect()
    got = sinks.read_log(spark, f"{folder}/signatures").collect()
    assert sorted((r.camera_id, r.tracker_id, r.frames_seen, r.recorded_ms, r.provisional) for r in got) == sorted(map(tuple, want)) and any(r.provisional for r in got)
    closed = sinks.read_log(spark, f"{folder}/tracks").select("camera_id", "tracker_id", "cls", "started_ms", "ended_ms", "frame_count").collect()
    assert sorted(map(tuple, closed)) == sorted(map(tuple, built.select("camera_id", "tracker_id", "cls", "started_ms", "ended_ms", "frame_count").collect()))
    per_track = {}
    for r in sessions.collect():
        per_track.setdefault((r.camera_id, r.tracker_id, r.session), []).append(r)
    sums = {}
    for rs in per_track.values():
        rs.sort(key=lambda r: r.seq)
        vs = [[x / sum(y * y for y in r.embedding) ** 0.5 for x in r.embedding] for r in rs if r.embedding]
        mean = [sum(c) / len(vs) for c in zip(*vs)] if vs else None
        mean = [x / sum(y * y for y in mean) ** 0.5 for x in mean] if mean else None
        sums[rs[0].camera_id, rs[0].tracker_id, rs[0].recorded_ms] = (mean, [r.seq for r in sorted(rs, key=lambda r: (-r.area, r.seq))[:3]])
    for r in got:
        if not r.provisional:
            mean, crops = sums[r.camera_id, r.tracker_id, r.started_ms]
            assert r.crops == crops and (r.embedding is None) == (mean is None)
            assert mean is None or max(abs(a - b) for a, b in zip(mean, r.embedding)) < 1e-12


def test_a_silent_camera_is_closed_by_its_timer(spark, folder):
    """Timers are on by default; here the wall clock is short."""
    import time

    schema = "camera_id string, seq bigint, recorded_ms bigint, tracker_id bigint, cls string, starts_segment boolean"
    spark.createDataFrame([("silent", 1, 0, 7, "car", False), ("silent", 2, 40, 7, "car", False)], schema).coalesce(1).write.parquet(f"{folder}/in/part=0")
    stream = spark.readStream.schema(schema + ", part int").parquet(f"{folder}/in").drop("part")
    q = pipeline.signature_stream(stream, processors.Identification(silent_after_ms=1_500), out=folder, checkpoint=f"{folder}/cp")
    try:
        for _ in range(60):
            time.sleep(0.5)
            done = sinks.read_log(spark, f"{folder}/tracks").collect() if q.lastProgress else []
            if done:
                break
    finally:
        q.stop()
    assert [(r.tracker_id, r.started_ms, r.ended_ms, r.frame_count) for r in done] == [(7, 0, 40, 2)]
