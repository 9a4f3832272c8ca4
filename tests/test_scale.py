"""Steps that must not grow faster than their input: each does its work once, or without what it does not need."""

import math
import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kerbline.operators import boundaries, fingerprint, similarity, spatial
from kerbline.plans import quality_queries
from kerbline.sources import contracts
from kerbline.streaming.stateful import Idle


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_idle_tracks_are_found_without_looking_at_the_others():
    rng = random.Random(5)
    for back in (0, 30):  # the clock may go back
        last, looked = {}, 0
        idle = Idle(50, ())

        def last_of(k):
            nonlocal looked
            looked += 1
            return last.get(k)

        now = 0
        for _ in range(4000):
            now += rng.randint(-back, 5 + back)
            k = rng.randrange(40)
            if k not in last or now < last[k]:
                idle.seen(now, k)
            last[k] = now
            want = {k for k, at in last.items() if now - at > 50}
            assert set(idle.since(now, last_of)) == want
            for k in want:
                del last[k]
        assert looked < 4 * 4000


def test_an_event_is_parsed_once(spark):
    rows = spark.createDataFrame([('{"id": "a"}',), ("no",)], "value string")
    assert optimized(contracts.check_alerts(rows)).count("from_json") == 1
    one = {"heartbeat": contracts.OPERATOR_MESSAGES["heartbeat"]}
    assert optimized(contracts.check_events(rows, one)).count("from_json") == 1


def test_a_plate_is_read_once_and_after_the_spread(spark):
    rows = [("t", "GJ01AB1234", 0.9), ("t", "gj-01 ab 1234", 0.8), ("t", "??", 0.7), ("u", "??", 0.5), (None, "GJ01AB1234", 0.5), ("v", None, 0.5)]
    reads = spark.createDataFrame(rows, "track_id string, raw_ocr string, confidence double")
    out = quality_queries.consensus(SimpleNamespace(plate_reads=reads))
    assert {tuple(r) for r in out.collect()} == {("t", "GJ01AB1234", 2, 1.0), (None, "GJ01AB1234", 1, 1.0)}
    plan = optimized(out)
    assert plan.index("regexp_replace") < plan.index("Repartition") and "regexp_replace" not in plan[plan.index("Repartition"):]
    assert sum("regexp_replace" in line for line in plan.splitlines()) == 1


def test_weights_add_up_exactly():
    rng = np.random.default_rng(3)
    distance, weight = rng.integers(0, 65, 500).astype("uint8"), rng.integers(0, 1 << 52, 500)
    totals = np.zeros(65, "int64")
    fingerprint._add(totals, distance, weight)
    assert totals.tolist() == [sum(int(w) for w, d in zip(weight, distance) if d == k) for k in range(65)]


def outline(points, tolerance):
    """The rule, point by point."""
    def far(p, a, b):
        dx, dy = b[1] - a[1], b[2] - a[2]
        length = dx * dx + dy * dy
        t = 0.0 if length == 0 else max(0.0, min(1.0, ((p[1] - a[1]) * dx + (p[2] - a[2]) * dy) / length))
        return math.hypot(p[1] - (a[1] + t * dx), p[2] - (a[2] + t * dy))

    kept, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        found = max(((far(points[i], points[a], points[b]), -i) for i in range(a + 1, b)), default=(0.0, 0))
        if found[0] > tolerance:
            kept.add(-found[1])
            todo += [(a, -found[1]), (-found[1], b)]
    return {points[i][0] for i in kept}


def test_outlines_are_the_same_in_rounds_and_in_one_task(spark):
    rng = random.Random(8)
    rows = [(f"f{f}", r, pos, rng.uniform(0, 9), rng.uniform(0, 9)) for f in range(2) for r in range(2) for pos in range(0, 3 * (60 + 40 * f), 3)]
    rows += [("one", 0, 0, 1.0, 1.0), ("gap", 0, 0, 1.0, 1.0), ("gap", 0, 1, None, 5.0), ("gap", 0, 2, 9.0, 9.0)]
    rings = spark.createDataFrame(rows, "feature string, ring_no int, pos int, x double, y double")
    want = set()
    for key in {r[:2] for r in rows} - {("gap", 0)}:
        want |= {(*key, pos) for pos in outline([r[2:] for r in rows if r[:2] == key], 3.0)}
    want |= {("gap", 0, 0), ("gap", 0, 2)}
    for local_points in (50_000, 7):
        got = [(r.feature, r.ring_no, r.pos) for r in boundaries.simplify_rings(rings, 3.0, local_points=local_points).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_short_rings_take_no_rounds(spark):
    rows = spark.range(400).select(F.lit("f").alias("feature"), F.lit(0).alias("ring_no"), F.col("id").alias("pos"),
                                   F.col("id").cast("double").alias("x"), (F.pmod(F.col("id") * 7919, F.lit(101)) / 1.0).alias("y"))
    assert optimized(boundaries.simplify_rings(rows)).count("FlatMapGroupsInPandas") == 1


def test_rows_travel_once_per_tile_not_per_block():
    rng = np.random.default_rng(4)
    for tile_rows in (25, 100, 8192):
        cells = similarity._tiled(pd.DataFrame({"__cell": rng.permutation(60), "n": rng.integers(1, 150, 60)}), tile_rows)
        held = {}
        for n, first, parts in cells[["n", "first", "parts"]].itertuples(index=False):
            for tile in range(first, first + parts):
                held.setdefault(tile, []).append(n / parts)
        assert sorted(held) == list(range(max(held) + 1)) and cells["__cell"].is_monotonic_increasing
        assert max(sum(h) for h in held.values()) <= tile_rows
        assert len(held) <= 2 * cells["n"].sum() / tile_rows + 1 + (cells["parts"] > 1).sum()


def test_nearest_cameras_without_all_pairs(spark):
    rng = random.Random(9)
    rows = [(f"c{i}", rng.choice((22.0, 22.5)) + rng.gauss(0, 0.002), 72.0 + rng.gauss(0, 0.002)) for i in range(150)]
    rows += [(f"same{i}", 22.0, 72.0) for i in range(40)] + [("alone", 22.3, 72.3), ("far", 40.0, 10.0), ("none", None, None), ("c0", 22.1, 72.1), (None, 22.0, 72.0), *[("same1", 22.0, 72.0)] * 5]
    cameras = spark.createDataFrame(rows, "camera_id string, lat double, lng double")
    want = spatial.nearest_cameras(spatial.cameras_near(cameras, 90_000), 3)
    order = ("camera_id", "nearness", "near_id", "distance_m")
    for crowd in (5, 1000):
        pairs = spatial.cameras_near(cameras, 90_000, nearest=3, crowd=crowd)
        got = spatial.nearest_cameras(pairs, 3)
        assert sorted(map(tuple, got.select(*order).collect())) == sorted(map(tuple, want.select(*order).collect()))
        assert pairs.count() < 2000 < spatial.cameras_near(cameras, 90_000).count()
    few = spark.createDataFrame(rows[:3], "camera_id string, lat double, lng double")
    assert spatial.cameras_near(few, 90_000, few.limit(1), nearest=1).count() == 1
