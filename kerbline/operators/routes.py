"""Where one vehicle went: look-alikes of each seed, walked in time under the leg rule."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions.geo import EARTH_RADIUS_KM, MAX_PLAUSIBLE_SPEED_KMH, MIN_ELAPSED_SECONDS, SAME_PLACE_KM
from kerbline.operators.similarity import BLOCK_ROWS, Side, similar_pairs

# Fixed values.
APPEARANCE_THRESHOLD = 0.82
EMBEDDING_DIM = 512
MIN_CANDIDATE_FRAMES = 3

ROUTE_SCHEMA = (
    "seed_id string, rejected bigint, unverifiable bigint, sightings array<struct<step:int,track_id:string,"
    "camera_id:string,recorded_ms:bigint,similarity:double,leg_km:double,leg_speed_kmh:double,leg_verifiable:boolean>>"
)


def located_signatures(signatures: DataFrame, tracks: DataFrame, cameras: DataFrame) -> DataFrame:
    """Signatures with their track's time and camera and the camera's position. Size decides the join."""
    t = tracks.select("track_id", "camera_id", F.col("started_ms").alias("recorded_ms"), "frame_count")
    c = cameras.select(
        "camera_id", F.col("label").alias("camera_label"), F.col("name").alias("camera_name"), "lat", "lng",
        (F.col("location_status") != "verified").alias("position_approximate"),
    )
    return signatures.join(t, "track_id").join(c, "camera_id")


def candidate_signatures(located: DataFrame, dim: int = EMBEDDING_DIM) -> DataFrame:
    """Good enough to be matched against; a seed is exempt from this."""
    return located.where((F.size("embedding") == dim) & (F.col("frame_count") >= MIN_CANDIDATE_FRAMES))


def lookalikes(
    seeds: DataFrame, candidates: DataFrame, *, dim: int = EMBEDDING_DIM, threshold: float = APPEARANCE_THRESHOLD,
    same_model: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Same class, another camera, similar enough: one row per (seed, candidate)."""
    return similar_pairs(
        Side(seeds, "track_id", carry=("camera_id",)),
        Side(candidates, "track_id", carry=("camera_id", "recorded_ms", "lat", "lng")),
        dim=dim, threshold=threshold, match_on=["cls", "embedding_model"] if same_model else ["cls"],
        differ=("camera_id", "camera_id"), block_rows=block_rows,
    )


def _haversine(a_lat: float, a_lng: float, b_lat: float, b_lng: float) -> float:
    s = (
        math.sin(math.radians(b_lat - a_lat) / 2) ** 2
        + math.cos(math.radians(a_lat)) * math.cos(math.radians(b_lat)) * math.sin(math.radians(b_lng - a_lng) / 2) ** 2
    )
    return 2 * EARTH_RADIUS_KM * math.asin(min(1.0, math.sqrt(s)))


class _Walk:
    """One seed's journey so far. Holds a camera set and the last stop, never the sightings offered."""

    def __init__(self, seed_id: str, keep_seed: bool) -> None:
        self.seed_id, self.keep_seed = seed_id, keep_seed
        self.cameras: set[str] = set()
        self.last: tuple | None = None
        self.kept: list[dict] = []
        self.rejected = 0

    def offer(self, row) -> None:
        if row.camera_id in self.cameras:
            return
        km = speed = None
        verifiable = True
        if self.last is not None:
            lat, lng, ms = self.last
            verifiable = not any(v is None or math.isnan(v) for v in (lat, lng, row.lat, row.lng))
            if verifiable:
                km = _haversine(lat, lng, row.lat, row.lng)
                seconds = abs(row.recorded_ms - ms) / 1000.0
                if seconds >= MIN_ELAPSED_SECONDS:
                    speed = km / (seconds / 3600.0)
                possible = km <= SAME_PLACE_KM if speed is None else speed <= MAX_PLAUSIBLE_SPEED_KMH
                if not possible and not (self.keep_seed and row.is_seed):
                    self.rejected += 1
                    return
        self.cameras.add(row.camera_id)
        self.last = (row.lat, row.lng, row.recorded_ms)
        self.kept.append({
            "step": len(self.kept) + 1, "track_id": row.track_id, "camera_id": row.camera_id,
            "recorded_ms": int(row.recorded_ms),
            "similarity": None if row.is_seed else round(float(row.similarity), 3),
            "leg_km": None if km is None else round(km, 2),
            "leg_speed_kmh": None if speed is None else round(speed, 1), "leg_verifiable": verifiable,
        })

    def result(self) -> dict:
        return {
            "seed_id": self.seed_id, "rejected": self.rejected,
            "unverifiable": sum(not k["leg_verifiable"] for k in self.kept), "sightings": self.kept,
        }


def walk_routes(seeds: DataFrame, matches: DataFrame, keep_seed: bool = False) -> DataFrame:
    """Walk every seed's sightings in time order, one row per seed.

    Which leg is allowed depends on the last sighting kept, so the walk is sequential per seed. Rows
    stream through sorted partitions; a task holds one seed's kept stops, not its candidates.
    """
    own = seeds.select(
        F.col("track_id").alias("seed_id"), "track_id", "camera_id", "recorded_ms", "lat", "lng",
        F.lit(None).cast("double").alias("similarity"), F.lit(True).alias("is_seed"),
    )
    found = matches.select(
        F.col("l_id").alias("seed_id"), F.col("r_id").alias("track_id"), F.col("r_camera_id").alias("camera_id"),
        F.col("r_recorded_ms").alias("recorded_ms"), F.col("r_lat").alias("lat"), F.col("r_lng").alias("lng"),
        "similarity", F.lit(False).alias("is_seed"),
    )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: _Walk | None = None
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                if current is None or current.seed_id != row.seed_id:
                    if current is not None:
                        done.append(current.result())
                    current = _Walk(row.seed_id, keep_seed)
                current.offer(row)
            if done:
                yield pd.DataFrame(done)
        if current is not None:
            yield pd.DataFrame([current.result()])

    return (
        own.unionByName(found)
        .repartition("seed_id")
        .sortWithinPartitions("seed_id", "recorded_ms", F.desc("is_seed"), "track_id")
        .mapInPandas(walk, ROUTE_SCHEMA)
    )


def reconstruct_routes(
    seeds: DataFrame, candidates: DataFrame, *, dim: int = EMBEDDING_DIM, threshold: float = APPEARANCE_THRESHOLD,
    keep_seed: bool = False, same_model: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    found = lookalikes(
        seeds, candidates, dim=dim, threshold=threshold, same_model=same_model, block_rows=block_rows
    )
    return walk_routes(seeds, found, keep_seed)


def route_sightings(routes: DataFrame) -> DataFrame:
    """One row per stop, with the totals of its route."""
    return routes.select("seed_id", "rejected", "unverifiable", F.explode("sightings").alias("s")).select(
        "seed_id", "rejected", "unverifiable", "s.*"
    )
