"""What the registry does not know: coverage, unusable cameras, unplaced and unowned cameras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Declaration order of the two enums, which is their sort order.
LOCATION_STATUS_ORDER = ["verified", "approximate", "unverified"]
CAMERA_STATUS_ORDER = ["online", "degraded", "offline"]


def enum_rank(col: Column | str, order: list[str]) -> Column:
    """Position of a value in its enum; text order would be a different order."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), F.col(col) if isinstance(col, str) else col)


def _is(col: str, value: str) -> Column:
    return F.count_if(F.col(col) == value)


def coverage_by_district(cameras: DataFrame) -> DataFrame:
    return (
        cameras.groupBy(F.coalesce("district", F.lit("(district unknown)")).alias("district"))
        .agg(
            F.count("*").alias("cameras_total"),
            _is("status", "online").alias("cameras_online"),
            _is("status", "degraded").alias("cameras_degraded"),
            _is("status", "offline").alias("cameras_offline"),
            _is("status_source", "measured").alias("status_measured"),
            _is("status_source", "portal_claim").alias("status_unverified"),
            _is("location_status", "verified").alias("location_verified"),
            _is("location_status", "approximate").alias("location_approximate"),
            _is("location_status", "unverified").alias("location_unverified"),
            F.count_if(F.col("department_id").isNull()).alias("department_unassigned"),
            F.round(F.avg("location_uncertainty_m")).alias("avg_uncertainty_m"),
        )
        .orderBy(F.desc("cameras_total"), "district")
    )


def registry_summary(cameras: DataFrame) -> DataFrame:
    """One row. Districts are counted in a first grouping so the distinct never funnels raw rows."""
    per_district = cameras.groupBy("district").agg(
        F.count("*").alias("n"),
        _is("status", "online").alias("online"),
        _is("status", "degraded").alias("degraded"),
        _is("status", "offline").alias("offline"),
        _is("status_source", "portal_claim").alias("status_unverified"),
        _is("location_status", "unverified").alias("location_unverified"),
        F.count_if(F.col("department_id").isNull()).alias("department_unassigned"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per_district.agg(
        total("n").alias("cameras_total"),
        *[total(c).alias(c) for c in per_district.columns[2:]],
        F.count("district").alias("districts_covered"),
    )


def unusable_cameras(cameras: DataFrame, health: DataFrame) -> DataFrame:
    """Cameras that are not online, why, and when anything last checked them."""
    latest = health.groupBy("camera_id").agg(F.max("observed_at_ms").alias("last_health_check_ms"))
    return (
        cameras.where(F.col("status") != "online")
        .join(latest, "camera_id", "left")
        .select("camera_id", "portal_id", "name", "district", "status", "status_source", "last_error",
                "last_health_check_ms")
        .orderBy(enum_rank("status", CAMERA_STATUS_ORDER), F.asc_nulls_last("portal_id"))
    )


def unverified_locations(cameras: DataFrame) -> DataFrame:
    return (
        cameras.where(F.col("location_status") != "verified")
        .select("camera_id", "portal_id", "label", "name", "district", "location_status", "location_uncertainty_m",
                F.col("lat").isNull().alias("has_no_coordinates"))
        .orderBy(enum_rank("location_status", LOCATION_STATUS_ORDER).desc(), F.desc("location_uncertainty_m"))
    )


def unassigned_departments(cameras: DataFrame, assignments: DataFrame) -> DataFrame:
    counts = assignments.groupBy("camera_id").agg(
        F.count_if("confirmed").alias("confirmed_assignments"),
        F.count_if(~F.col("confirmed")).alias("pending_suggestions"),
    )
    return (
        cameras.where(F.col("department_id").isNull())
        .join(counts, "camera_id", "left")
        .select("camera_id", "portal_id", "label", "name", "district",
                F.coalesce("confirmed_assignments", F.lit(0)).alias("confirmed_assignments"),
                F.coalesce("pending_suggestions", F.lit(0)).alias("pending_suggestions"))
        .orderBy(F.asc_nulls_last("portal_id"))
    )
