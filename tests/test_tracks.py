import random

from pyspark.sql import functions as F

from kerbline.operators import tracks

DET = "camera_id string, segment int, seq bigint, recorded_ms bigint, tracker_id bigint, cls string"


def build(spark, rows, frames=None, **kw):
    df = spark.createDataFrame(rows, DET)
    f = None if frames is None else spark.createDataFrame(frames, "camera_id string, segment int, frame_seq bigint, recorded_ms bigint")
    s = tracks.track_sessions(df, f, **kw)
    return s, tracks.build_tracks(s)


def test_idle_close_is_strict(spark):
    rows = [("c", 0, 1, 0, 7, "car"), ("c", 0, 2, 1000, 8, "car"), ("c", 0, 3, 2001, 8, "car"), ("c", 0, 4, 3000, 7, "car")]
    _, t = build(spark, rows)
    assert sorted((r.tracker_id, r.frame_count) for r in t.collect()) == [(7, 1), (7, 1), (8, 2)]
    rows[2] = ("c", 0, 3, 2000, 8, "car")
    _, t = build(spark, rows)
    assert sorted((r.tracker_id, r.frame_count) for r in t.collect()) == [(7, 2), (8, 2)]


def test_the_frame_it_reappears_in_does_not_close_it(spark):
    _, t = build(spark, [("c", 0, 1, 0, 7, "car"), ("c", 0, 2, 9000, 7, "truck")])
    (r,) = t.collect()
    assert (r.frame_count, r.started_ms, r.ended_ms, r.cls) == (2, 0, 9000, "car")


def test_an_empty_frame_closes_it(spark):
    rows = [("c", 0, 1, 0, 7, "car"), ("c", 0, 3, 9000, 7, "truck")]
    _, t = build(spark, rows, [("c", 0, 1, 0), ("c", 0, 2, 2500), ("c", 0, 3, 9000)])
    assert sorted((r.cls, r.frame_count) for r in t.collect()) == [("car", 1), ("truck", 1)]


def test_a_segment_cut_closes_everything_and_untracked_rows_are_ignored(spark):
    rows = [("c", 0, 1, 0, 1, "car"), ("c", 0, 2, 100, None, "car"), ("c", 1, 3, 200, 1, "bus")]
    s, t = build(spark, rows)
    assert s.count() == 2 and sorted((r.segment, r.cls, r.frame_count) for r in t.collect()) == [(0, "car", 1), (1, "bus", 1)]
    assert t.select("track_id").distinct().count() == 2


def test_sessions_equal_a_walk(spark):
    rng = random.Random(4)
    rows, now = [], 0
    for seq in range(900):
        now += rng.choice([10, 200, 700, 1500, 2600])
        for tracker in rng.sample(range(5), rng.randint(0, 3)):
            rows.append(("c", 0, seq, now, tracker, rng.choice(["car", "person"])))
    opened, want = {}, []
    by_frame = {}
    for r in rows:
        by_frame.setdefault((r[2], r[3]), []).append(r)
    for (_, at), dets in sorted(by_frame.items()):
        for d in dets:
            t = opened.setdefault(d[4], [d[5], at, at, 0])
            t[2], t[3] = at, t[3] + 1
        for k in [k for k, v in opened.items() if at - v[2] > 2000]:
            want.append((k, *opened.pop(k)))
    want += [(k, *v) for k, v in opened.items()]
    for chunk in (5_000, 10**9):
        _, t = build(spark, rows, chunk_ms=chunk)
        assert sorted((r.tracker_id, r.cls, r.started_ms, r.ended_ms, r.frame_count) for r in t.collect()) == sorted(want)


def test_signature_cadence(spark):
    rows = [("c", 0, i, i * 100, 1, "car") for i in range(30)] + [("c", 0, i, i * 100, 2, "person") for i in range(30)]
    s, t = build(spark, rows)
    got = tracks.signature_moments(s, t).collect()
    assert sorted(r.frames_seen for r in got if r.provisional) == [4, 16, 28]
    assert [(r.tracker_id, r.frames_seen) for r in got if not r.provisional] == [(1, 30)]


def test_crops_and_signature_fold(spark):
    crops = spark.createDataFrame([("t", i, i % 50) for i in range(200)], "track_id string, crop_no int, area int")
    best = tracks.best_crops(crops, keys=["track_id"], area="area", order="crop_no").collect()
    assert len(best) == 8 and {r.area for r in best} == {48, 49}
    rows = [("t", 1, "red", "GJ1"), ("t", 2, "blue", None), ("u", 1, None, None)]
    out = {r.track_id: r for r in tracks.fold_signatures(spark.createDataFrame(rows, "track_id string, n int, colour string, partial_plate string"), "n").collect()}
    assert (out["t"].colour, out["t"].partial_plate, out["u"].partial_plate) == ("blue", "GJ1", None)
