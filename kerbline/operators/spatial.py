"""Cameras near cameras, hop plausibility, and sightings at the same moment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions import geo
from kerbline.functions.clock import CORRELATION_TOLERANCE_MS
from kerbline.session import written

#: Places in the fullest cell of the first circle of a search for the nearest, and how many circles may be tried.
CROWD, SEARCH_SIZES = 50, 10


def cameras_near(
    cameras: DataFrame, radius_m: float, of: DataFrame | None = None, *, ellipsoidal: bool = False,
    max_abs_lat: float = 60.0, nearest: int | None = None, crowd: int = CROWD,
) -> DataFrame:
    """Pairs of cameras within ``radius_m``, nearest first; ``of`` limits whose neighbours are wanted.

    Cells are at least as large as the radius, so only the nine cells around a camera can hold a
    neighbour: the search is an equi-join on the cell. ``max_abs_lat`` bounds how narrow a degree of
    longitude gets; positions beyond it, or within a cell of the 180th meridian, are refused.

    With ``nearest``, only each camera's nearest so many (:func:`nearest_cameras`, ties to the smaller id): a
    circle in which no cell holds more than ``crowd`` places grows fourfold in width, for the places that have
    too few cameras in it, up to the radius.
    """
    _, lng_step = _steps(radius_m, max_abs_lat)
    placed = cameras.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select("camera_id", "lat", "lng")
    inside = (F.abs("lat") <= max_abs_lat) & (F.abs("lng") <= 180 - lng_step)
    placed = placed.withColumn("lat", F.when(inside, F.col("lat")).otherwise(
        F.raise_error(F.lit("camera position outside the band this search covers")).cast("double")))
    wanted = placed if of is None else placed.join(of.select("camera_id").distinct(), "camera_id", "left_semi")
    measure = geo.ellipsoidal_km if ellipsoidal else geo.haversine_km
    if nearest is None:
        right = placed.select(F.col("camera_id").alias("near_id"), F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"))
        found = _within(wanted, right, radius_m, max_abs_lat, measure)
    else:
        found = _nearest(written(placed), wanted, radius_m, nearest, crowd, max_abs_lat, measure)
    return found.where("camera_id <> near_id").select("camera_id", "near_id", "distance_m").orderBy("camera_id", "distance_m", "near_id")


def _steps(radius_m: float, max_abs_lat: float) -> tuple[float, float]:
    """Height and width of cells as large as the radius, in degrees."""
    lat_step = radius_m / geo.METRES_PER_DEGREE * 1.01
    return lat_step, lat_step / math.cos(math.radians(max_abs_lat))


def _within(left: DataFrame, right: DataFrame, radius_m: float, max_abs_lat: float, measure) -> DataFrame:
    """Rows of ``left`` (lat, lng) with those of ``right`` (b_lat, b_lng) within the radius, themselves included."""
    cell = lambda c, step: F.floor(F.col(c) / step)
    lat_step, lng_step = _steps(radius_m, max_abs_lat)
    around = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    l = left.withColumn("o", around).withColumns({
        "cy": cell("lat", lat_step) + F.col("o.dy"), "cx": cell("lng", lng_step) + F.col("o.dx")}).drop("o")
    r = right.withColumns({"cy": cell("b_lat", lat_step), "cx": cell("b_lng", lng_step)})
    return (
        l.join(r, ["cy", "cx"]).drop("cy", "cx")
        .withColumn("distance_m", measure(F.col("lat"), F.col("lng"), F.col("b_lat"), F.col("b_lng")) * 1000)
        .where(F.col("distance_m") <= radius_m)
    )


def _nearest(placed: DataFrame, wanted: DataFrame, radius_m: float, k: int, crowd: int, max_abs_lat: float, measure) -> DataFrame:
    """At least the ``k`` nearest of each wanted camera, itself apart, and few more."""
    # An id may have several rows, which are all the camera itself: so many more are kept than asked for. Then a row
    # with that many smaller ids at its own place is among nobody's nearest.
    placed, wanted = (df.where(F.col("camera_id").isNotNull()) for df in (placed, wanted))
    k += placed.groupBy("camera_id").count().agg(F.max("count")).first()[0] or 0
    at = Window.partitionBy("lat", "lng").orderBy("camera_id")
    shown = placed.withColumn("n", F.row_number().over(at)).where(F.col("n") <= k)
    places = written(shown.groupBy("lat", "lng").agg(F.collect_list("camera_id").alias("ids")))
    sizes = [radius_m / 4 ** i for i in range(SEARCH_SIZES)]
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.floor(F.col("lat") / lat_step).alias("cy"), F.floor(F.col("lng") / lng_step).alias("cx"))
        for i, (lat_step, lng_step) in enumerate(_steps(s, max_abs_lat) for s in sizes)]))
    fullest = places.select(cells.alias("c")).groupBy("c").agg(F.count("*").alias("n")).groupBy("c.i").agg(F.max("n").alias("n"))
    start = fullest.where(F.col("n") <= crowd).agg(F.min("i")).first()[0]
    right = places.select(F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"), "ids")
    here = Window.partitionBy("lat", "lng").orderBy("distance_m", "near_id")
    open_, found = wanted.select("lat", "lng").distinct(), None
    for size in reversed(sizes[:SEARCH_SIZES if start is None else start + 1]):
        near = _within(open_, right, size, max_abs_lat, measure).select("lat", "lng", "distance_m", F.explode("ids").alias("near_id"))
        near = written(near.withColumn("n", F.row_number().over(here)).where(F.col("n") <= k))
        full = near.where(F.col("n") == k).select("lat", "lng")
        done = near if size == radius_m else near.join(full, ["lat", "lng"], "left_semi")
        found = done if found is None else found.unionByName(done)
        if size < radius_m:
            open_ = written(open_.join(full, ["lat", "lng"], "left_anti"))
            if open_.isEmpty():
                break
    return wanted.join(found.drop("n"), ["lat", "lng"])


def nearest_cameras(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest per camera; Spark keeps only k rows per camera before the shuffle."""
    w = Window.partitionBy("camera_id").orderBy("distance_m", "near_id")
    return pairs.withColumn("nearness", F.row_number().over(w)).where(F.col("nearness") <= k)


def assess_hops(
    hops: DataFrame, cameras: DataFrame, *, max_speed_kmh: float = geo.HOP_MAX_SPEED_KMH,
    tolerance_s: float = geo.HOP_TOLERANCE_S, ellipsoidal: bool = False,
) -> DataFrame:
    """Judge rows (from_camera, to_camera, elapsed_s) by the camera-pair rule."""
    at = lambda p: cameras.select(F.col("camera_id").alias(f"{p}_camera"), F.col("lat").alias(f"{p}_lat"), F.col("lng").alias(f"{p}_lng"))
    measure = geo.ellipsoidal_km if ellipsoidal else geo.haversine_km
    joined = (
        hops.join(at("from"), "from_camera", "left").join(at("to"), "to_camera", "left")
        .withColumn("__d", measure(F.col("from_lat"), F.col("from_lng"), F.col("to_lat"), F.col("to_lng")) * 1000)
    )
    return (
        joined.withColumns(geo.hop(F.col("__d"), F.col("elapsed_s"), max_speed_kmh, tolerance_s))
        .withColumn("distance_m", F.coalesce("__d", F.lit(0.0)))
        .drop("__d", "from_lat", "from_lng", "to_lat", "to_lng")
    )


def co_sightings(
    left: DataFrame, right: DataFrame, *, on: list[str], left_ms: str, right_ms: str,
    tolerance_ms: int = CORRELATION_TOLERANCE_MS, condition: Column | None = None,
) -> DataFrame:
    """Pairs of rows within the tolerance. Column names of the two sides must differ except ``on``.

    Time is cut into buckets of one tolerance, so a partner is in the same bucket or a neighbour's.
    """
    bucket = lambda c: F.floor(F.col(c) / tolerance_ms)
    l = left.withColumn("__b", bucket(left_ms))
    r = right.withColumn("__b", F.explode(F.array(bucket(right_ms) - 1, bucket(right_ms), bucket(right_ms) + 1)))
    close = F.abs(F.col(left_ms) - F.col(right_ms)) <= tolerance_ms
    joined = l.join(r, [*on, "__b"]).where(close if condition is None else close & condition)
    return joined.drop("__b")


def co_sighting_counts(
    sightings: DataFrame, *, tolerance_ms: int = CORRELATION_TOLERANCE_MS, chunk_ms: int = 3_600_000
) -> DataFrame:
    """For each (camera, moment): how many sightings other cameras had within the tolerance.

    Sightings are folded per camera and millisecond first. Time is cut into chunks whose edges are
    shared with the neighbour, so a sliding count never needs the whole timeline in one place.
    """
    at = sightings.groupBy("camera_id", "recorded_ms").agg(F.count("*").alias("here"))
    return _sliding(at, tolerance_ms, chunk_ms)


def _sliding(at: DataFrame, tolerance_ms: int, chunk_ms: int) -> DataFrame:
    """Sightings on other cameras within the tolerance: those of all cameras minus the camera's own.

    All cameras are summed per millisecond before anything slides over them, so no task holds more than
    one row per millisecond of a chunk, or one camera's chunk.
    """
    def around(rows: DataFrame, keys: list[str], count: str, out: str) -> DataFrame:
        home = F.floor(F.col("recorded_ms") / chunk_ms)
        low, high = (F.floor((F.col("recorded_ms") + d) / chunk_ms) for d in (-tolerance_ms, tolerance_ms))
        near = Window.partitionBy("__chunk", *keys).orderBy("recorded_ms").rangeBetween(-tolerance_ms, tolerance_ms)
        return (
            rows.withColumn("__home", home).withColumn("__chunk", F.explode(F.sequence(low, high)))
            .withColumn(out, F.sum(count).over(near)).where(F.col("__chunk") == F.col("__home")).drop("__chunk", "__home")
        )

    everyone = around(at.groupBy("recorded_ms").agg(F.sum("here").alias("__all")), [], "__all", "__near").drop("__all")
    return around(at, ["camera_id"], "here", "__own").join(everyone, "recorded_ms").select(
        "camera_id", "recorded_ms", "here", (F.col("__near") - F.col("__own")).alias("elsewhere"))
