"""Batch scans. Every schema is stated; nothing is inferred. Parsing works on any column of text, so
the same code reads files, table columns and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROSTER_CAMERA = (
    "id string, location string, live boolean, codec string, width int, height int, fps double, bitrate_kbps int, "
    "rtsp_url string, webrtc_url string, hls_live_url string"
)
ROSTER_SCHEMA = f"cameras array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in ROSTER_CAMERA.split(','))}>>"
PROBE_SCHEMA = (
    "url string, error string, size_bytes bigint, content_type string, etag string, accepts_ranges boolean, bytes_fetched bigint, "
    "box_order array<string>, format struct<duration:string>, streams array<struct<codec_type:string,codec_name:string,width:int,"
    "height:int,r_frame_rate:string,avg_frame_rate:string,nb_frames:string,bit_rate:string>>"
)
MANIFEST_SCHEMA = (
    "camera string, tag string, requested_offset_s double, chunks array<struct<index:int,requested_offset_s:double,"
    "requested_duration_s:double,actual_first_pts_s:double,actual_last_pts_s:double,ok:boolean,detail:string>>"
)
DISTRICT_SCHEMA = (
    "features array<struct<properties:struct<DISTRICT:string,ST_NM:string>,geometry:struct<type:string,coordinates:string>>>"
)
SIDECAR_SCHEMA = "clip string, sha256 string, sizeBytes bigint"


def _json_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")


def parse_roster(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Cameras of a discovery payload, one row each. A payload without a ``cameras`` list fails the job."""
    cameras = F.from_json(F.col(payload), ROSTER_SCHEMA)["cameras"]
    listed = F.when(cameras.isNull(), F.raise_error(F.lit("unexpected roster payload: no 'cameras' list")).cast(
        ROSTER_SCHEMA.split(" ", 1)[1])).otherwise(cameras)
    keep = [c for c in payloads.columns if c != payload]
    return payloads.select(*keep, F.explode(listed).alias("c")).select(
        *keep, F.col("c.location").alias("label"), F.col("c.id").alias("portal_id"), F.col("c.live").alias("portal_live"),
        "c.codec", "c.width", "c.height", "c.fps", "c.bitrate_kbps", "c.rtsp_url", "c.webrtc_url", "c.hls_live_url")


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    return parse_roster(_json_documents(spark, path))


def read_registry(spark: SparkSession, path: str, schema: str, defaults: dict[str, str] | None = None) -> DataFrame:
    """Registry rows from JSON lines, with what they leave out filled in."""
    from kerbline.operators.registry import with_defaults

    return with_defaults(spark.read.schema(schema).json(path), defaults)


def parse_csv_lines(lines: DataFrame, columns: list[str], line: str = "value") -> DataFrame:
    """Rows of comma-separated text: quoted cells, doubled quotes; blank and ``#`` lines are skipped, cells trimmed.

    A line equal to the header, and a cell a short line lacks, are handled as a reader would: dropped, empty.
    """
    text = F.col(line)
    kept = lines.where((F.trim(text) != "") & ~F.ltrim(text).startswith("#"))
    schema = ", ".join(f"`{c}` string" for c in columns)
    cells = F.from_csv(text, schema, {"quote": '"', "escape": '"'})
    keep = [c for c in lines.columns if c != line]
    parsed = kept.select(*keep, cells.alias("r")).select(
        *keep, *[F.trim(F.coalesce(F.col("r")[c], F.lit(""))).alias(c) for c in columns])
    is_header = None
    for c in columns:
        part = F.col(c) == c
        is_header = part if is_header is None else is_header & part
    return parsed.where(~is_header)


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file whose first line that is neither blank nor a comment names the columns."""
    lines = spark.read.text(path)
    head = lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#")).first()
    if head is None:
        return spark.createDataFrame([], "label string").limit(0)
    return parse_csv_lines(lines, [c.strip().strip('"') for c in head["value"].split(",")])


def _ratio(expr: Column) -> Column:
    """``a/b`` as a number; null without a slash, with a zero below, or with anything but integers."""
    num, den = F.split_part(expr, F.lit("/"), F.lit(1)).try_cast("bigint"), F.split_part(expr, F.lit("/"), F.lit(2)).try_cast("bigint")
    return F.when(expr.contains("/") & (den != 0), F.bround(num / den, 3))


def summarize_probes(probes: DataFrame, payload: str = "payload") -> DataFrame:
    """What a media probe says about a file, from its JSON."""
    keep = [c for c in probes.columns if c != payload]
    p = F.col("p")
    parsed = probes.select(*keep, F.from_json(F.col(payload), PROBE_SCHEMA).alias("p"))
    of_type = lambda kind: F.get(F.filter(p["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    staged = parsed.withColumns({"v": of_type("video"), "a": of_type("audio")})
    v, size = F.col("v"), p["size_bytes"]
    duration = F.nullif(p["format"]["duration"], F.lit("")).try_cast("double")
    has = lambda x: F.when(x != 0, x)
    return staged.select(
        *keep, p["url"].alias("url"), p["error"].alias("error"), size.alias("size_bytes"),
        F.bround(has(size) / 1e9, 2).alias("size_gb"),
        (F.coalesce(F.array_contains(F.slice(p["box_order"], 1, 2), "moov"), F.lit(False))).alias("moov_at_front"),
        F.bround(p["bytes_fetched"] / 1e6, 2).alias("probe_mb_fetched"),
        F.bround(has(duration), 2).alias("duration_s"), F.bround(has(duration) / 3600, 3).alias("duration_h"),
        v["codec_name"].alias("codec"), v["width"].alias("width"), v["height"].alias("height"),
        _ratio(v["r_frame_rate"]).alias("nominal_fps"), _ratio(v["avg_frame_rate"]).alias("actual_fps"),
        v["nb_frames"].try_cast("bigint").alias("nb_frames"),
        F.bround(v["bit_rate"].try_cast("double") / 1000).cast("bigint").alias("video_bitrate_kbps"),
        F.col("a").isNotNull().alias("has_audio"),
    )


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    return summarize_probes(_json_documents(spark, path))


def parse_manifests(manifests: DataFrame, payload: str = "payload") -> DataFrame:
    """Captured chunks, one row each, from capture manifests."""
    m = F.from_json(F.col(payload), MANIFEST_SCHEMA)
    keep = [c for c in manifests.columns if c != payload]
    return manifests.select(*keep, m.alias("m")).select(
        *keep, F.col("m.camera").alias("camera_id"), F.col("m.tag").alias("tag"), F.explode("m.chunks").alias("c")).select(
        *keep, "camera_id", "tag", F.col("c.index").alias("idx"), "c.requested_offset_s", "c.requested_duration_s",
        F.col("c.actual_first_pts_s").alias("first_pts_s"), F.col("c.actual_last_pts_s").alias("last_pts_s"), "c.ok", "c.detail")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifests(_json_documents(spark, path))


def parse_districts(features: DataFrame, state: str, payload: str = "payload") -> DataFrame:
    """Outer and inner rings of one state's districts, one row per vertex; ring 0 of a polygon is the outer one.

    Polygons hold rings, multipolygons hold polygons of rings; other geometries are ignored.
    """
    f = F.col("f")
    rows = features.select(F.explode(F.from_json(F.col(payload), DISTRICT_SCHEMA)["features"]).alias("f")).where(
        (F.lower(F.trim(f["properties"]["ST_NM"])) == state.strip().lower())
        & f["geometry"]["type"].isin("Polygon", "MultiPolygon"))
    coords, single = f["geometry"]["coordinates"], f["geometry"]["type"] == "Polygon"
    polygons = F.when(single, F.array(F.from_json(coords, "array<array<array<double>>>"))).otherwise(
        F.from_json(coords, "array<array<array<array<double>>>>"))
    rings = rows.select(F.trim(f["properties"]["DISTRICT"]).alias("feature"), F.posexplode(polygons).alias("polygon_no", "p")).select(
        "feature", "polygon_no", F.posexplode("p").alias("hole_no", "ring"))
    return rings.select(
        "feature", "polygon_no", F.col("hole_no").alias("ring_no"), (F.col("hole_no") == 0).alias("outer"),
        F.posexplode("ring").alias("pos", "xy")).select(
        "feature", "polygon_no", "ring_no", "outer", F.col("pos").cast("bigint").alias("pos"), F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))


def read_districts(spark: SparkSession, path: str, state: str) -> DataFrame:
    return parse_districts(_json_documents(spark, path), state)


def read_stream_log(spark: SparkSession, path: str) -> DataFrame:
    """Decoder messages, one per line, with the file they came from as the camera."""
    from kerbline.functions.text import classify_log

    lines = spark.read.text(path).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("camera_id"), F.col("value").alias("message"))
    return classify_log(lines)


def verify_evidence(clips: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Does each clip still hash to what its sidecar recorded? Without a readable sidecar the answer is no."""
    s = sidecars.select("clip", F.col("sha256").alias("recorded_sha256"))
    return clips.withColumn("sha256", F.sha2("content", 256)).drop("content").join(s, "clip", "left").withColumn(
        "intact", F.coalesce(F.col("sha256") == F.col("recorded_sha256"), F.lit(False)))


def read_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Clips and their sidecar JSON files in a folder."""
    name = F.element_at(F.split("path", "/"), -1)
    clips = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp4").load(folder).select(
        name.alias("clip"), "content", "length")
    sidecars = spark.read.schema(SIDECAR_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return verify_evidence(clips, sidecars)
