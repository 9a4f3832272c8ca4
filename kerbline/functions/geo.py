"""Distances and the two rules for whether a vehicle could have made a leg."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_KM = 6371.0
MAX_PLAUSIBLE_SPEED_KMH = 140.0
MIN_ELAPSED_SECONDS = 20.0
SAME_PLACE_KM = 1.5
HOP_MAX_SPEED_KMH = 120.0
HOP_TOLERANCE_S = 15.0
HOP_MIN_ELAPSED_S = 0.001
METRES_PER_DEGREE = 111_194.92664455873  # EARTH_RADIUS_KM * pi / 180, in metres

# WGS 84 ellipsoid, for the optional ellipsoidal distance.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563


def haversine_km(a_lat: Column, a_lng: Column, b_lat: Column, b_lng: Column) -> Column:
    half_lat, half_lng = F.radians(b_lat - a_lat) / 2, F.radians(b_lng - a_lng) / 2
    s = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(a_lat)) * F.cos(F.radians(b_lat)) * F.sin(half_lng) * F.sin(half_lng)
    # Not least(1, s): that would turn an unknown position into half the globe.
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.when(s > 1, 1.0).otherwise(F.sqrt(s)))


def ellipsoidal_km(a_lat: Column, a_lng: Column, b_lat: Column, b_lng: Column) -> Column:
    """Lambert's formula on WGS 84: metres-level agreement with a geodesic at city distances."""
    beta = lambda lat: F.atan((1 - WGS84_F) * F.tan(F.radians(lat)))
    p, q = (beta(a_lat) + beta(b_lat)) / 2, (beta(b_lat) - beta(a_lat)) / 2
    half_dlat = (beta(b_lat) - beta(a_lat)) / 2
    half_dlng = F.radians(b_lng - a_lng) / 2
    h = F.pow(F.sin(half_dlat), 2) + F.cos(beta(a_lat)) * F.cos(beta(b_lat)) * F.pow(F.sin(half_dlng), 2)
    sigma = 2 * F.asin(F.when(h > 1, 1.0).otherwise(F.sqrt(h)))
    x = (sigma - F.sin(sigma)) * F.pow(F.sin(p) * F.cos(q), 2) / F.greatest(F.pow(F.cos(sigma / 2), 2), F.lit(1e-300))
    y = (sigma + F.sin(sigma)) * F.pow(F.cos(p) * F.sin(q), 2) / F.greatest(F.pow(F.sin(sigma / 2), 2), F.lit(1e-300))
    return F.when(sigma == 0, 0.0).otherwise(WGS84_A / 1000 * (sigma - WGS84_F / 2 * (x + y)))


def leg(
    a_lat: Column, a_lng: Column, a_ms: Column, b_lat: Column, b_lng: Column, b_ms: Column
) -> dict[str, Column]:
    """The route rule: direction of time is ignored, an unplaced camera cannot contradict anything."""
    placed = a_lat.isNotNull() & a_lng.isNotNull() & b_lat.isNotNull() & b_lng.isNotNull()
    km = F.when(placed, haversine_km(a_lat, a_lng, b_lat, b_lng))
    seconds = F.abs(b_ms - a_ms) / 1000.0
    speed = F.when(placed & (seconds >= MIN_ELAPSED_SECONDS), km / (seconds / 3600.0))
    possible = (
        F.when(~placed, True)
        .when(seconds < MIN_ELAPSED_SECONDS, km <= SAME_PLACE_KM)
        .otherwise(speed <= MAX_PLAUSIBLE_SPEED_KMH)
    )
    return {"possible": possible, "km": km, "speed_kmh": speed, "verifiable": placed}


def assess_legs(pairs: DataFrame) -> DataFrame:
    """Add possible, km, speed_kmh, verifiable to rows carrying a_/b_ lat, lng, ms."""
    c = F.col
    return pairs.withColumns(leg(c("a_lat"), c("a_lng"), c("a_ms"), c("b_lat"), c("b_lng"), c("b_ms")))


def hop(
    distance_m: Column, elapsed_s: Column, max_speed_kmh: float = HOP_MAX_SPEED_KMH, tolerance_s: float = HOP_TOLERANCE_S
) -> dict[str, Column]:
    """The camera-pair rule: direction matters, and elapsed time gets the clock tolerance added."""
    speed = distance_m / F.greatest(elapsed_s + tolerance_s, F.lit(HOP_MIN_ELAPSED_S)) * 3.6
    backwards = elapsed_s < -tolerance_s
    judged = distance_m.isNotNull() & ~backwards
    text = F.format_string("%.1f", speed)
    reason = (
        F.when(distance_m.isNull(), "one or both cameras have no verified position")
        .when(backwards, "second sighting precedes the first by more than the clock tolerance")
        .when(speed <= max_speed_kmh, F.concat(F.lit("implies "), text, F.lit(" km/h")))
        .otherwise(F.concat(F.lit("implies "), text, F.lit(f" km/h, above the {max_speed_kmh:g} km/h plausibility limit")))
    )
    return {
        "plausible": F.when(judged, speed <= max_speed_kmh).otherwise(False),
        "implied_speed_kmh": F.when(judged, speed),
        "reason": reason,
    }
