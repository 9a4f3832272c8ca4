import random

import pytest
from pyspark.sql import functions as F

from kerbline.operators import frames

SCHEMA = "camera_id string, connection_id string, seq bigint, pts_ms double, arrival_ms double, scene_cut boolean, clock_backwards boolean"


def feed(spark, pts, arrival=None, cuts=(), connection="c"):
    rows = [("cam", connection, i, float(p), float(arrival[i] if arrival else p), i in cuts, False) for i, p in enumerate(pts)]
    return spark.createDataFrame(rows, SCHEMA)


def nearest_to_grid(pts, interval):
    """What the sampler must keep, stepping through one segment by hand."""
    kept, due, waiting = [], None, None
    for i, p in enumerate(pts):
        due = p if due is None else due
        if p < due:
            waiting = i
            continue
        chosen = waiting if waiting is not None and abs(pts[waiting] - due) < abs(p - due) else i
        waiting = None
        due += interval
        while due <= pts[chosen]:
            due += interval
        kept.append((chosen, i))
    return kept


def sampled(spark, df, interval, chunk=7):
    out = frames.sample_on_grid(frames.mark_segments(df, chunk_seq=chunk), interval, chunk_seq=chunk)
    return sorted((r.connection_id, r.seq, r.emitted_at_seq) for r in out.collect())


def test_sampling_equals_a_step_by_step_walk(spark):
    rng = random.Random(11)
    df, want = None, []
    for n in range(60):
        gaps = [rng.choice([1, 20, 40, 90, 95, 99, 100, 105, 160, 199, 200, 210, 260, 301, 390, 450, 1000]) for _ in range(rng.randint(1, 45))]
        pts, p = [], rng.choice([0, 17, 1000])
        for g in gaps:
            pts.append(p)
            p += g
        part = feed(spark, pts, connection=f"k{n}")
        df = part if df is None else df.unionByName(part)
        want += [(f"k{n}", *pair) for pair in nearest_to_grid(pts, 100)]
    assert sampled(spark, df.coalesce(4), 100) == sorted(want)


def test_sampling_golden(spark):
    steady = [i * 40 for i in range(50)]
    assert 9 <= len(sampled(spark, feed(spark, steady), 200)) <= 11
    stall = [0, 100, 3100]
    assert [s for _, s, _ in sampled(spark, feed(spark, stall), 200)] == [0, 1, 2] or len(sampled(spark, feed(spark, stall), 200)) <= 3
    with pytest.raises(ValueError):
        frames.sample_on_grid(feed(spark, [0]), 0)


def test_the_grid_restarts_with_each_segment(spark):
    pts = [0, 150, 300, 10, 160, 320]
    assert [s for _, s, _ in sampled(spark, feed(spark, pts), 300)] == [0, 2, 3, 5]


def test_discontinuities(spark):
    df = feed(spark, [0, 40, 8041, 8080, 8000, 8040, 8090], cuts={6})
    for chunk in (2, 100):
        rows = frames.mark_segments(df, chunk_seq=chunk).orderBy("seq").collect()
        assert [r.discontinuity for r in rows] == [False, False, True, False, True, False, True]
        assert [r.segment for r in rows] == [0, 0, 1, 1, 2, 2, 3]
        assert [r.pts_jump for r in rows] == [False, False, True, False, True, False, False]
    assert frames.loop_events(frames.mark_segments(df)).count() == 3


def test_first_frame_starts_but_never_breaks(spark):
    assert not frames.mark_segments(feed(spark, [5000], cuts={0})).first().discontinuity


def test_anchor(spark):
    # A burst of old frames at once, then steady delivery with jitter; the least delayed frame wins.
    pts = [0, 40, 80, 1600, 2600, 6600, 7000]
    arrival = [1000, 1001, 1002, 2650, 3630, 7640, 8055]
    rows = frames.anchor_clock(frames.mark_segments(feed(spark, pts, arrival), chunk_seq=2), chunk_seq=2).orderBy("seq").collect()
    assert [r.anchor_ms for r in rows] == [None, None, None, 1050, 1030, 1030, 1030]
    assert [r.anchor_settled for r in rows] == [False] * 5 + [True, True]
    assert rows[4].absolute_ms == 3630
    final = frames.segment_anchors(frames.mark_segments(feed(spark, pts, arrival))).first()
    assert final.anchor_ms == 1030 and final.anchor_settled


def test_anchor_is_forgotten_at_a_break(spark):
    pts, arrival = [0, 2000, 4000, 100, 2100], [500, 2400, 4500, 9000, 11_300]
    rows = frames.anchor_clock(frames.mark_segments(feed(spark, pts, arrival), chunk_seq=2), chunk_seq=2).orderBy("seq").collect()
    assert [r.anchor_ms for r in rows] == [None, 400, 400, None, 9200]


def test_velocity_under_a_burst(spark):
    for step in (40, 80):
        rows = [("v", float(i * step), 100 + 240.0 * i * step / 1000, 50.0) for i in range(60)]
        df = spark.createDataFrame(rows, "k string, pts_ms double, x double, y double")
        out = frames.rolling_velocity(df, keys=["k"], chunk_ms=700).orderBy("pts_ms").collect()
        assert out[0].vx is None and len(out) == 60
        assert all(abs(r.vx - 240) < 24 and r.vy == 0 for r in out[1:])
        assert out[-1].samples == 1000 // step + 1


def test_velocity_keeps_the_last_two(spark):
    df = spark.createDataFrame([("v", 0.0, 0.0, 0.0), ("v", 5000.0, 10.0, 0.0)], "k string, pts_ms double, x double, y double")
    last = frames.rolling_velocity(df, keys=["k"], chunk_ms=1000).orderBy("pts_ms").collect()[1]
    assert (last.vx, last.samples) == (2.0, 2)


def test_live_time_falls_back_to_pts(spark):
    anchored = frames.anchor_clock(frames.mark_segments(feed(spark, [0, 2000], [500, 2400])))
    none = spark.createDataFrame([], "camera_id string, offset_s double, drift_rate double, source string")
    rows = frames.apply_clock(anchored, none, live=True).orderBy("seq").collect()
    assert rows[0].position_s == 0.0 and not rows[0].anchor_settled
    assert rows[1].position_s != 2.0 and rows[1].drift_source == "global_default"
