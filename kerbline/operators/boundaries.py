"""District boundaries: areas, centroids, renamed districts, and simplified outlines."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.sequence import stitched
from kerbline.session import written

# Outline tolerance and precision in degrees, and districts known by another name in
# the boundary source, or split off since from the one named.
SIMPLIFY_TOLERANCE = 0.001
COORD_PRECISION = 4
MIN_RING_POINTS = 4
DISTRICT_ALIASES = {
    "Ahmedabad": ["Ahmadabad"], "Mehsana": ["Mahesana"], "Banaskantha": ["Banas Kantha"], "Kutch": ["Kachchh"],
    "Sabarkantha": ["Sabar Kantha"], "Panchmahal": ["Panch Mahals"], "Dahod": ["Dohad"], "Chhota Udaipur": ["Vadodara"],
    "Gir Somnath": ["Junagadh"], "Devbhoomi Dwarka": ["Jamnagar"], "Morbi": ["Rajkot"], "Botad": ["Bhavnagar"],
    "Mahisagar": ["Panch Mahals"], "Aravalli": ["Sabar Kantha"],
}
CHUNK_POINTS = 50_000
#: What tells rings apart, as far as a table has it: rings are numbered within their polygon.
RING = ("feature", "polygon_no", "ring_no")


def _ring_key(rings: DataFrame) -> list[str]:
    return [c for c in RING if c in rings.columns]


def ring_measures(vertices: DataFrame) -> DataFrame:
    """Per ring: signed area, first moments, bounds and number of points, from one pass over its edges."""
    c, key = F.col, _ring_key(vertices)
    edges = stitched(vertices, keys=key, order=["pos"], chunk=F.floor(c("pos") / CHUNK_POINTS), previous={"px": "x", "py": "y"})
    cross = c("px") * c("y") - c("x") * c("py")
    some = lambda e: F.coalesce(F.sum(e), F.lit(0.0))
    return edges.groupBy(*key).agg(
        (some(cross) / 2).alias("signed_area"), some((c("px") + c("x")) * cross).alias("mx"), some((c("py") + c("y")) * cross).alias("my"),
        F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.count("*").alias("points"),
        F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def feature_centroids(measures: DataFrame) -> DataFrame:
    """The centroid of each feature's largest ring: small islands must not drag it out to sea."""
    largest = measures.groupBy("feature").agg(F.max_by(
        F.struct("signed_area", "mx", "my", "mean_x", "mean_y"), F.struct(F.abs("signed_area"), *[-F.col(c) for c in _ring_key(measures)[1:]])).alias("r"))
    flat = F.col("r.signed_area") == 0
    return largest.select(
        F.col("feature").alias("name"),
        F.round(F.when(flat, F.col("r.mean_y")).otherwise(F.try_divide(F.col("r.my"), 6 * F.col("r.signed_area"))), 5).alias("lat"),
        F.round(F.when(flat, F.col("r.mean_x")).otherwise(F.try_divide(F.col("r.mx"), 6 * F.col("r.signed_area"))), 5).alias("lng"))


def with_aliases(centroids: DataFrame, aliases: dict[str, list[str]] = DISTRICT_ALIASES) -> DataFrame:
    """Add current names the source lacks, from the first listed name it has."""
    rows = [(name, i, source) for name, sources in aliases.items() for i, source in enumerate(sources)]
    table = centroids.sparkSession.createDataFrame(rows, "alias string, rank int, source string")
    found = table.join(centroids.withColumnRenamed("name", "source"), "source").groupBy("alias").agg(
        F.min_by(F.struct("lat", "lng"), "rank").alias("p"))
    extra = found.join(centroids.select(F.col("name").alias("alias")), "alias", "left_anti")
    return centroids.unionByName(extra.select(F.col("alias").alias("name"), "p.lat", "p.lng"))


def state_centroid(centroids: DataFrame) -> DataFrame:
    return centroids.agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))


def bounds(measures: DataFrame) -> DataFrame:
    return measures.agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"),
                        F.max("max_y").alias("max_y"), F.sum("points").alias("points"))


def _to_segment(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((x - ax) * dx + (y - ay) * dy, length)))
    t = F.when(length == 0, 0.0).otherwise(t)
    return F.hypot(x - (ax + t * dx), y - (ay + t * dy))


def _farthest(x: np.ndarray, y: np.ndarray, a: tuple, b: tuple) -> tuple[int, float]:
    """The first vertex farthest from the segment, as :func:`_to_segment` measures; NaN is farther than any number."""
    (ax, ay), (bx, by) = a, b
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = np.zeros(len(x)) if length == 0 else np.nan_to_num(np.clip(((x - ax) * dx + (y - ay) * dy) / length, 0.0, 1.0), nan=1.0)
    far = np.hypot(x - (ax + t * dx), y - (ay + t * dy))
    at = int(np.argmax(np.where(np.isnan(far), np.inf, far)))
    return at, far[at]


def _outline(stretch: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    """The vertices of one stretch that Douglas-Peucker keeps."""
    stretch = stretch.sort_values("pos", kind="stable", ignore_index=True)
    pos, x, y = (stretch[c].to_numpy() for c in ("pos", "x", "y"))
    first = stretch.iloc[0]
    kept, todo = [], [(0, len(pos), (first["ax"], first["ay"]), (first["bx"], first["by"]))]
    while todo:
        start, stop, a, b = todo.pop()
        if start == stop:
            continue
        at, far = _farthest(x[start:stop], y[start:stop], a, b)
        if far <= tolerance:
            continue
        at += start
        m = (x[at], y[at])
        kept.append(at)
        todo += [(start, int(np.searchsorted(pos, pos[at], "left")), a, m), (int(np.searchsorted(pos, pos[at], "right")), stop, m, b)]
    return stretch.iloc[kept]


def simplify_rings(vertices: DataFrame, tolerance: float = SIMPLIFY_TOLERANCE, local_points: int = CHUNK_POINTS) -> DataFrame:
    """Douglas-Peucker over every ring at once.

    A stretch of outline of up to ``local_points`` vertices is finished by one task. A longer one is split in
    rounds: its farthest vertex is found as a grouped maximum that merges before the shuffle, so the longest
    ring is spread over the cluster like any other rows, until its pieces are short enough.
    """
    c, key = F.col, _ring_key(vertices)
    ends = vertices.groupBy(*key).agg(F.min_by(F.struct("pos", "x", "y"), "pos").alias("a"), F.max_by(F.struct("pos", "x", "y"), "pos").alias("b"))
    corner = lambda e: ends.select(*key, c(f"{e}.pos").alias("pos"), c(f"{e}.x").alias("x"), c(f"{e}.y").alias("y"))
    kept = corner("a").unionByName(corner("b").join(ends.where("a.pos < b.pos").select(*key), key, "left_semi"))
    # A place that is not known is no distance away: such a vertex is never kept, such an end keeps nothing.
    known = [c(f).isNotNull() for f in ("x", "y", "a.x", "a.y", "b.x", "b.y")]
    open_ = vertices.join(ends, key).where((c("pos") > c("a.pos")) & (c("pos") < c("b.pos")))
    open_ = open_.where(reduce(and_, known)).select(*key, "pos", "x", "y", "a", "b").withColumn("at", c("a.pos"))
    open_ = written(open_)
    schema = open_.select(*key, "pos", "x", "y").schema
    names = schema.names

    def finish(stretch: pd.DataFrame) -> pd.DataFrame:
        return _outline(stretch, tolerance)[names]

    short = []
    while True:
        far = _to_segment(c("x"), c("y"), c("a.x"), c("a.y"), c("b.x"), c("b.y"))
        long = open_.groupBy(*key, "at").agg(F.count("*").alias("n")).where(c("n") > local_points).drop("n")
        long = written(long)
        if long.isEmpty():
            short.append(open_)
            break
        short.append(open_.join(long, [*key, "at"], "left_anti"))
        rows = open_.join(long, [*key, "at"], "left_semi")
        splits = rows.groupBy(*key, "at").agg(
            F.max_by(F.struct("pos", "x", "y"), F.struct(far, -c("pos"))).alias("m"), F.max(far).alias("far")
        ).where(c("far") > tolerance).drop("far")
        splits = written(splits)
        kept = kept.unionByName(splits.select(*key, "m.pos", "m.x", "m.y"))
        halves = rows.join(splits, [*key, "at"]).where(c("pos") != c("m.pos"))
        open_ = written(halves.select(
            *key, "pos", "x", "y", F.when(c("pos") < c("m.pos"), c("a")).otherwise(c("m")).alias("a"),
            F.when(c("pos") < c("m.pos"), c("m")).otherwise(c("b")).alias("b")).withColumn("at", c("a.pos")))
    for rows in short:
        flat = rows.select(*key, "at", "pos", "x", "y", c("a.x").alias("ax"), c("a.y").alias("ay"), c("b.x").alias("bx"), c("b.y").alias("by"))
        kept = kept.unionByName(flat.groupBy(*key, "at").applyInPandas(finish, schema))
    return kept


def round_rings(vertices: DataFrame, precision: int = COORD_PRECISION, min_points: int = MIN_RING_POINTS) -> DataFrame:
    """Round, drop repeats next to each other, close each ring, drop rings too short to enclose anything."""
    c, key = F.col, _ring_key(vertices)
    rounded = vertices.withColumns({"x": F.bround("x", precision), "y": F.bround("y", precision)})
    chunk = F.floor(c("pos") / CHUNK_POINTS)
    compared = stitched(rounded, keys=key, order=["pos"], chunk=chunk, previous={"px": "x", "py": "y"})
    distinct = compared.where(c("px").isNull() | (c("x") != c("px")) | (c("y") != c("py"))).drop("px", "py")
    ring = distinct.groupBy(*key).agg(
        F.count("*").alias("n"), F.min_by(F.struct("x", "y"), "pos").alias("first"), F.max_by(F.struct("x", "y"), "pos").alias("last"),
        F.max("pos").alias("end"))
    opened = (c("n") > 2) & (c("first") != c("last"))
    sized = ring.withColumn("total", c("n") + opened.cast("int")).where(c("total") >= min_points)
    closing = sized.where(opened).select(*key, (c("end") + 1).alias("pos"), "first.x", "first.y")
    return distinct.join(sized.select(*key), key, "left_semi").select(*key, "pos", "x", "y").unionByName(closing)
