"""The camera registry: defaults, row rules, map positions, filters and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Enum members, bounds and defaults a registry row is held to.
SOURCE_TYPES = ["MP4_PROGRESSIVE", "RTSP", "HLS", "MJPEG", "FILE_LOOP", "ONVIF_STUB", "VMS_SDK_STUB"]
LOCATION_STATUSES = ["verified", "approximate", "unverified"]
STATUSES = ["online", "degraded", "offline"]
STATUS_SOURCES = ["measured", "portal_claim"]
STATE_CENTROID = (22.48418, 72.28309)
BOUNDS = {"min_lat": 19.5, "max_lat": 25.5, "min_lng": 67.5, "max_lng": 75.5}
MAX_PLACEMENT_UNCERTAINTY_M = 500
CIRCLE_ABOVE_M = 100

ROW_DEFAULTS = {
    "source_type": "", "location_status": "unverified", "status": "online",
    "status_source": "portal_claim", "department": "unassigned",
}


def derived_id(portal_id: Column, label: Column) -> Column:
    """A camera without a portal id is keyed by a slug of its label."""
    return F.coalesce(
        portal_id, F.concat(F.lit("offline:"), F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"))
    )


def with_defaults(rows: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """Fill what a registry row may leave out; a missing column counts as missing values."""
    filled = {**ROW_DEFAULTS, **(defaults or {})}
    present = set(rows.columns)
    fill = {
        name: F.coalesce(F.col(name) if name in present else F.lit(None).cast("string"), F.lit(value))
        for name, value in filled.items()
    }
    return rows.withColumns({
        "camera_id": derived_id(F.col("portal_id"), F.col("label")),
        "name": F.coalesce(F.col("name"), F.col("label")),
        "source_url": F.coalesce(
            F.col("source_url") if "source_url" in present else F.lit(None).cast("string"),
            F.concat(F.lit("/stream/"), F.coalesce(F.col("portal_id"), F.lit(""))),
        ),
        **fill,
    })


def violations(rows: DataFrame) -> DataFrame:
    """One row per broken rule: (label, rule, message). Row rules need no shuffle; uniqueness does."""
    c = F.col
    rules = [
        ("label_required", c("label").isNull() | (c("label") == ""), F.lit("label is required")),
        ("source_type", ~c("source_type").isin(SOURCE_TYPES), F.concat(F.lit("unknown source_type "), c("source_type"))),
        ("location_status", ~c("location_status").isin(LOCATION_STATUSES),
         F.concat(F.lit("unknown location_status "), c("location_status"))),
        ("status", ~c("status").isin(STATUSES), F.concat(F.lit("unknown status "), c("status"))),
        ("status_source", ~c("status_source").isin(STATUS_SOURCES),
         F.concat(F.lit("unknown status_source "), c("status_source"))),
        ("uncertainty",
         c("location_uncertainty_m").isNull() | F.isnan(c("location_uncertainty_m").cast("double"))
         | (c("location_uncertainty_m") < 0) | (c("location_uncertainty_m").cast("double") == float("inf")),
         F.lit("location_uncertainty_m must be a non-negative number")),
        ("position_pair", c("lat").isNull() != c("lng").isNull(), F.lit("lat and lng must both be set or both be null")),
        ("position_flag", c("lat").isNotNull() & (c("location_status") == "unverified"),
         F.lit("has coordinates but is flagged unverified")),
        ("position_missing", c("lat").isNull() & (c("location_status") != "unverified"),
         F.lit("no coordinates, so location_status must be unverified")),
        ("last_error", (c("status") != "online") & (F.coalesce(c("last_error"), F.lit("")) == ""),
         F.lit("a status other than online requires a last_error")),
    ]
    broken = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(rule).alias("rule"), message.alias("message"))) for rule, test, message in rules
    ]))
    per_row = rows.select("label", F.explode(broken).alias("v")).select("label", "v.rule", "v.message")

    def repeated(key: str, rule: str) -> DataFrame:
        return (
            rows.where(c(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min("label").alias("first_label"))
            .where("n > 1")
            .select(c("first_label").alias("label"), F.lit(rule).alias("rule"),
                    F.concat(F.lit(f"duplicate {key} "), c(key)).alias("message"))
        )

    return per_row.unionByName(repeated("label", "label_unique")).unionByName(repeated("portal_id", "portal_id_unique"))


def in_bounds(lat: Column, lng: Column, bounds: dict[str, float] = BOUNDS) -> Column:
    finite = ~F.isnan(lat) & ~F.isnan(lng)
    return F.coalesce(
        finite & lat.between(bounds["min_lat"], bounds["max_lat"]) & lng.between(bounds["min_lng"], bounds["max_lng"]),
        F.lit(False),
    )


def in_range(lat: Column, lng: Column) -> Column:
    """The generic geographic range, whatever the deployment."""
    return in_bounds(lat, lng, {"min_lat": -90.0, "max_lat": 90.0, "min_lng": -180.0, "max_lng": 180.0})


def placement_decision(placements: DataFrame, bounds: dict[str, float] = BOUNDS) -> DataFrame:
    """Accept a proposed position, or say why not."""
    lat, lng, unc = F.col("lat"), F.col("lng"), F.col("uncertainty_m").cast("double")
    finite = F.coalesce(~F.isnan(lat) & ~F.isnan(lng) & (F.abs(lat) != float("inf")) & (F.abs(lng) != float("inf")),
                        F.lit(False))
    unc_ok = F.coalesce(~F.isnan(unc) & unc.between(0, MAX_PLACEMENT_UNCERTAINTY_M), F.lit(False))
    reason = (
        F.when(~finite, "not a valid coordinate")
        .when(~in_bounds(lat, lng, bounds), "outside the state")
        .when(~unc_ok, "uncertainty must be between 0 and 500 metres")
    )
    return placements.withColumns({"accepted": reason.isNull(), "reject_reason": reason})


def map_positions(
    cameras: DataFrame, centroids: DataFrame, streams: DataFrame, departments: DataFrame,
    state_centroid: tuple[float, float] = STATE_CENTROID,
) -> DataFrame:
    """Registry rows as the map needs them: own position, else the district's, else the state's."""
    own = F.col("c.lat").isNotNull() & F.col("c.lng").isNotNull()
    c, z = cameras.alias("c"), centroids.alias("z")
    s = streams.select("camera_id", "source_type", "is_local_mirror", "width", "height", "fps")
    d = departments.select("department_id", F.col("name").alias("department_label"))
    return (
        c.join(z, F.col("c.district") == F.col("z.name"), "left")
        .select(
            "c.camera_id", "c.portal_id", "c.name", "c.label", "c.district", "c.cluster",
            F.when(own, F.col("c.lat")).otherwise(F.coalesce("z.lat", F.lit(state_centroid[0]))).alias("lat"),
            F.when(own, F.col("c.lng")).otherwise(F.coalesce("z.lng", F.lit(state_centroid[1]))).alias("lng"),
            (~own).alias("position_is_fallback"),
            "c.location_status", "c.location_uncertainty_m", "c.status", "c.status_source", "c.last_error",
            "c.department_id",
        )
        .join(s, "camera_id", "left")
        .join(d, "department_id", "left")
        .withColumn("is_local_mirror", F.coalesce("is_local_mirror", F.lit(False)))
    )


def registry_order(cameras: DataFrame) -> DataFrame:
    """Placed cameras first, then by portal id as a number, those without one last."""
    return cameras.orderBy(F.col("lat").isNull(), F.col("portal_id").cast("int").asc_nulls_last())


def registry_filter(
    cameras: DataFrame, text: str = "", status: str = "all", gaps_only: bool = False
) -> DataFrame:
    out = cameras
    if status != "all":
        out = out.where(F.col("status") == status)
    if gaps_only:
        has_department = F.coalesce(F.col("department_label"), F.lit("")) != ""
        out = out.where(~((F.col("location_status") == "verified") & has_department))
    needle = text.strip().lower()
    if needle:
        found = F.lower("name").contains(needle) | F.coalesce("portal_id", F.lit("")).contains(needle)
        for name in ("district", "cluster"):
            found = found | F.lower(F.coalesce(name, F.lit(""))).contains(needle)
        out = out.where(found)
    return out


def unlocated(cameras: DataFrame) -> DataFrame:
    return cameras.where(F.col("location_status") == "unverified")


def wall_cameras(cameras: DataFrame) -> DataFrame:
    return cameras.where(F.col("status") != "offline")


def geojson_features(cameras: DataFrame) -> DataFrame:
    """One GeoJSON Feature per camera; a collection is these rows, written as JSON lines."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"),
        F.struct(
            F.col("camera_id").alias("id"), F.col("portal_id").alias("portalId"), "name", "status",
            F.col("location_status").alias("locationStatus"),
            F.col("location_uncertainty_m").alias("uncertaintyM"),
            (F.col("location_status") == "unverified").cast("int").alias("unverified"),
        ).alias("properties"),
    )
    return cameras.select(
        "camera_id", F.to_json(feature).alias("feature"),
        (F.col("location_uncertainty_m") > CIRCLE_ABOVE_M).alias("shows_circle"),
    )


def export_fields(cameras: DataFrame, fields: list[str]) -> DataFrame:
    """The chosen fields as text, nulls empty: what a tab-separated export writes."""
    unknown = [f for f in fields if f not in cameras.columns]
    if unknown:
        raise ValueError(f"unknown field(s) {unknown}")
    return cameras.select(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields])
