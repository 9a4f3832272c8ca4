import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.operators import routes, similarity
from kerbline.operators.similarity import Side

DIM = 16


def cloud(n, seed=0, groups=12, spread=0.25, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, DIM))
    rows = []
    for i in range(n):
        v = centres[i % groups] + spread * rng.normal(size=DIM) if i >= copies else centres[0]
        v = v / np.linalg.norm(v)
        rows.append((f"t{i:04d}", f"cam{i % 7}", "car" if i % 3 else "bus", v.tolist()))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "track_id string, camera_id string, cls string, embedding array<double>")


def brute(rows, threshold, same_cls=True):
    m = np.array([r[3] for r in rows])
    sims = m @ m.T
    return {(rows[i][0], rows[j][0]): sims[i, j] for i in range(len(rows)) for j in range(len(rows))
            if i != j and rows[i][1] != rows[j][1] and (not same_cls or rows[i][2] == rows[j][2]) and sims[i, j] >= threshold}


def computed(df):
    """The same rows, with a vector that an expression makes."""
    return df.withColumn("embedding", F.transform(F.reverse("embedding"), lambda x: x * F.lit(1.0))).withColumn("embedding", F.reverse("embedding"))


@pytest.mark.parametrize("block", [8192, 40, 9])
@pytest.mark.parametrize("made", [lambda df: df, computed])
def test_every_route_to_the_pairs_gives_all_of_them(spark, made, block):
    rows = cloud(240, copies=80)  # a third of the rows are copies of one vector
    df = made(frame(spark, rows))
    got = similarity.similar_pairs(
        Side(df, "track_id", carry=("camera_id",)), Side(df, "track_id", carry=("camera_id",)), dim=DIM, threshold=0.82,
        match_on=["cls"], differ=("camera_id", "camera_id"), block_rows=block)
    found = {(r.l_id, r.r_id): r.similarity for r in got.collect()}
    want = brute(rows, 0.82)
    assert found.keys() == want.keys() and len(want) > 1000
    assert all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_small_left_side(spark):
    rows = cloud(120)
    df = frame(spark, rows)
    one = df.where("track_id = 't0005'")
    got = similarity.similar_pairs(Side(one, "track_id", carry=("camera_id",)), Side(df, "track_id", carry=("camera_id",)), dim=DIM,
                                   threshold=0.82, match_on=["cls"], differ=("camera_id", "camera_id"))
    assert {(r.l_id, r.r_id) for r in got.collect()} == {k for k in brute(rows, 0.82) if k[0] == "t0005"}


def test_vectors_that_are_not_unit_length(spark):
    rng = np.random.default_rng(9)
    rows = [(f"t{i:03d}", f"cam{i}", "car", (rng.normal(size=DIM) * rng.uniform(0.2, 3)).tolist()) for i in range(90)]
    rows.append(("zero", "camz", "car", [0.0] * DIM))
    rows.append(("short", "cams", "car", [1.0]))
    df = frame(spark, rows)
    full = rows[:-1]
    m = np.array([r[3] for r in full])
    norm = np.maximum(np.linalg.norm(m, axis=1), 1e-12)
    for guarded, sims in ((False, m @ m.T), (True, (m @ m.T) / norm[:, None] / norm[None, :])):
        want = {(full[i][0], full[j][0]) for i in range(len(full)) for j in range(len(full)) if i != j and sims[i, j] >= 0.5}
        for block in (8192, 10):
            got = similarity.similar_pairs(Side(df, "track_id"), Side(df, "track_id"), dim=DIM, threshold=0.5, match_on=["cls"],
                                           guarded=guarded, block_rows=block)
            assert {(r.l_id, r.r_id) for r in got.collect()} == want


@pytest.mark.parametrize("block", [8192, 30, 7])
def test_a_table_with_itself_gives_each_pair_once(spark, block):
    rows = cloud(200, copies=60)
    side = Side(computed(frame(spark, rows)), "track_id", carry=("camera_id",))
    got = similarity.similar_pairs(side, side, dim=DIM, threshold=0.82, match_on=["cls"], differ=("camera_id", "camera_id"), symmetric=True, block_rows=block)
    found = [(r.l_id, r.r_id) for r in got.collect()]
    assert len(found) == len(set(found))
    assert set(found) == {k for k in brute(rows, 0.82) if k[0] < k[1]}


@pytest.mark.parametrize("block", [8192, 20])
def test_match_matrix_counts_copies(spark, block):
    rows = cloud(150, copies=50)
    want = {}
    for (a, b) in brute(rows, 0.82):
        if a < b:
            ca, cb = (f"cam{int(x[1:]) % 7}" for x in (a, b))
            key = (min(ca, cb), max(ca, cb))
            want[key] = want.get(key, 0) + 1
    got = similarity.camera_match_matrix(computed(frame(spark, rows)), dim=DIM, threshold=0.82, block_rows=block)
    assert {(r.camera_a, r.camera_b): r.pairs for r in got.collect()} == want


def test_a_threshold_of_zero_is_refused(spark):
    df = frame(spark, cloud(3))
    with pytest.raises(ValueError):
        similarity.similar_pairs(Side(df, "track_id"), Side(df, "track_id"), dim=DIM, threshold=0.0, match_on=[])


SEED = "track_id string, camera_id string, recorded_ms bigint, lat double, lng double, cls string, embedding array<double>, frame_count int"


def walk(spark, rows, keep_seed=False, seed="s"):
    df = spark.createDataFrame([(t, c, ms, lat, lng, "car", [1.0, 0.0], 5) for t, c, ms, lat, lng in rows], SEED)
    out = routes.reconstruct_routes(df.where(F.col("track_id") == seed), df, dim=2, keep_seed=keep_seed).first()
    return [x.track_id for x in out.sightings], out.rejected, out


def test_a_route_keeps_only_what_one_vehicle_could_reach(spark):
    h = 3_600_000
    rows = [("s", "c0", 0, 23.0, 72.5), ("near", "c1", 5_000, 23.001, 72.5), ("leap", "c2", 60_000, 21.0, 72.8),
            ("again", "c1", 70_000, 23.001, 72.5), ("later", "c2", 4 * h, 21.0, 72.8), ("lost", "c3", 4 * h + 1000, None, None)]
    kept, rejected, out = walk(spark, rows)
    assert kept == ["s", "near", "later", "lost"] and rejected == 1 and out.unverifiable == 1
    first, second = out.sightings[0], out.sightings[1]
    assert first.similarity is None and first.leg_km is None and first.leg_verifiable
    assert second.leg_speed_kmh is None and second.leg_km == 0.11


def test_an_earlier_lookalike_can_displace_the_seed_unless_it_is_kept(spark):
    rows = [("early", "c1", 0, 21.0, 72.8), ("s", "c0", 60_000, 23.0, 72.5)]
    assert walk(spark, rows)[0] == ["early"]
    assert walk(spark, rows, keep_seed=True)[0] == ["early", "s"]


def test_the_seed_speaks_for_its_own_camera_and_may_be_thin(spark):
    df = spark.createDataFrame([("s", "c0", 5, 23.0, 72.5, "car", [1.0, 0.0], 1), ("same", "c0", 0, 23.0, 72.5, "car", [1.0, 0.0], 9),
                                ("thin", "c1", 9, 23.0, 72.5, "car", [1.0, 0.0], 2)], SEED)
    out = routes.reconstruct_routes(df.where("track_id = 's'"), routes.candidate_signatures(df, 2), dim=2).first()
    assert [x.track_id for x in out.sightings] == ["s"]
