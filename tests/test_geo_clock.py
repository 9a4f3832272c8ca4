import math
import random

from pyspark.sql import functions as F

from kerbline.functions import clock, geo
from kerbline.operators import frames, spatial

LEG = "n string, a_lat double, a_lng double, a_ms double, b_lat double, b_lng double, b_ms double"
AHD, SURAT = (23.0225, 72.5714), (21.1702, 72.8311)


def test_leg_rule(spark):
    h = 3600_000.0
    rows = [("leap", *AHD, 0.0, *SURAT, 5000.0), ("same", *AHD, 0.0, *AHD, 4000.0), ("day", *AHD, 0.0, *SURAT, 4 * h),
            ("fast", *AHD, 0.0, *SURAT, h / 2), ("back", *AHD, h / 2, *SURAT, 0.0), ("lost", None, None, 0.0, *AHD, 5000.0)]
    got = {r.n: r for r in geo.assess_legs(spark.createDataFrame(rows, LEG)).collect()}
    assert not got["leap"].possible and got["leap"].km > 200
    assert got["same"].possible and got["same"].speed_kmh is None
    assert got["day"].possible and not got["fast"].possible
    assert (got["back"].possible, got["back"].speed_kmh) == (got["fast"].possible, got["fast"].speed_kmh)
    assert got["lost"].possible and not got["lost"].verifiable and got["lost"].km is None


def test_ellipsoidal_distance_is_close_to_a_known_geodesic(spark):
    # Flinders Peak to Buninyong: 54 972.271 m on a nearly identical ellipsoid.
    df = spark.createDataFrame([(-37.951033417, 144.424867889, -37.652821139, 143.926495528)], "a double, b double, c double, d double")
    km = df.select(geo.ellipsoidal_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0]
    assert abs(km - 54.972271) < 0.005


def test_hop_rule(spark):
    cams = spark.createDataFrame([("a", *AHD), ("b", *SURAT), ("c", None, None)], "camera_id string, lat double, lng double")
    hops = spark.createDataFrame([("a", "b", 4 * 3600.0), ("a", "b", 60.0), ("a", "b", -20.0), ("a", "c", 60.0), ("a", "a", -10.0)],
                                 "from_camera string, to_camera string, elapsed_s double")
    got = {(r.to_camera, r.elapsed_s): r for r in spatial.assess_hops(hops, cams).collect()}
    assert got["b", 14400.0].plausible and got["b", 14400.0].reason.startswith("implies ")
    assert not got["b", 60.0].plausible and "above the 120 km/h" in got["b", 60.0].reason
    assert got["b", -20.0].implied_speed_kmh is None and "precedes" in got["b", -20.0].reason
    assert got["c", 60.0].distance_m == 0.0 and not got["c", 60.0].plausible
    assert got["a", -10.0].plausible


def test_cells_lose_no_neighbour(spark):
    rng = random.Random(3)
    pts = [(f"c{i}", rng.uniform(22.0, 22.05), rng.uniform(72.0, 72.05)) for i in range(120)] + [("far", 40.0, 10.0), ("none", None, None)]
    got = {(r[0], r[1]) for r in spatial.cameras_near(spark.createDataFrame(pts, "camera_id string, lat double, lng double"), 700).collect()}

    def km(a, b):
        s = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(
            math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(s))

    want = {(a[0], b[0]) for a in pts[:-1] for b in pts[:-1] if a is not b and km(a, b) <= 0.7}
    assert got == want and len(want) > 20


def test_slot_arithmetic(spark):
    def at(ms, duration=None):
        df = spark.createDataFrame([(float(ms), duration)], "now double, d double")
        return clock.slot_report(df, "now", "d").first()

    r = at(1787239306351.337)
    assert abs(r.slot_offset_s - 42706.351337) < 1e-5
    nine = 1787196600000 - (1787196600000 + 19800_000 - 32400_000) % 43_200_000
    assert at(nine).slot_offset_s == 0 and at(nine + 6 * 3600_000).slot_offset_s == 21600
    assert at(nine + 605_000, 600.0).position_s == 5.0 and at(nine + 605_000, 600.0).position_no_loop_s == 599.5
    assert at(nine + 43_000_000, 49437.28).position_s == 43000.0
    assert at(nine + 3_661_000).slot_text.endswith("1h01m in")


def test_recorded_time_and_drift(spark):
    rows = [("a", 0.0, -1.0, 1), ("a", 10800.0, 53.0, 2), ("a", 21600.0, 110.0, 3), ("b", 0.0, 5.0, 1), ("b", 2700.0, 19.0, 2),
            ("c", 1305.0, 9.0, 1), ("d", 3600.0, 17.5, 1), ("d", 36000.0, 183.5, 2)]
    got = {r.camera_id: r for r in frames.fit_drift(spark.createDataFrame(rows, "camera_id string, position_s double, offset_s double, measured_seq int")).collect()}
    assert abs(got["a"].drift_rate - 0.005139) < 1e-6 and got["a"].max_residual_s < 2 and got["a"].source == "fitted"
    assert got["b"].source == "global_default" and got["b"].span_s == 2700
    assert got["c"].source == "single_anchor" and abs(got["c"].offset_s + got["c"].drift_rate * 1305 - 9.0) < 1e-9
    assert abs(got["d"].drift_rate - 0.005123) < 1e-6


def test_co_sighting_tolerance(spark):
    mk = lambda rows, p: spark.createDataFrame(rows, f"k int, {p} string, {p}_ms bigint")
    out = spatial.co_sightings(mk([(1, "x", 100_000)], "a"), mk([(1, "y", 114_000), (1, "z", 120_000), (1, "w", 85_000)], "b"),
                               on=["k"], left_ms="a_ms", right_ms="b_ms")
    assert {r.b for r in out.collect()} == {"y", "w"}
