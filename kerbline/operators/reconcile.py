"""Keeping the registry in step with an upstream roster whose ids move: the label is the identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.text import label_number
from kerbline.operators.sequence import stitched

# Fields the roster owns, the ones whose empty value means "not stated", and the
# state of a camera nobody has placed.
ROSTER_FIELDS = [
    "portal_id", "codec", "portal_live", "width", "height", "fps", "bitrate_kbps", "rtsp_url", "webrtc_url", "hls_live_url",
]
EMPTY_MEANS_UNSTATED = ["codec", "width", "height", "fps", "bitrate_kbps"]
UNPLACED_UNCERTAINTY_M = 15_000
UNPLACED_BASIS = "no position — shown at district centroid"
ADDED_NOTE = "auto-added from the roster — needs geography review"
DEPARTURE_MARK = "left the portal roster"
# Fields refreshed on a row whose position a person set.
HUMAN_PLACED_REFRESH = ["portal_id", "name", "status", "status_source", "last_error", "last_seen_ms"]


def refuse_repeated_labels(roster: DataFrame) -> None:
    """Labels identify cameras, so a roster that repeats one cannot be applied."""
    repeated = roster.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").limit(3).collect()
    if repeated:
        raise ValueError(f"the roster repeats labels, for example {[r['label'] for r in repeated]}: refusing to apply it")


def _stated(name: str, col: Column) -> Column:
    if name not in EMPTY_MEANS_UNSTATED:
        return col
    text = col.cast("string")
    return F.when(~text.isin("", "0", "0.0"), col)


def _paired(local: DataFrame, remote: DataFrame) -> tuple[DataFrame, list[str]]:
    fields = [f for f in ROSTER_FIELDS if f in local.columns and f in remote.columns]
    r = remote.select(F.col("label").alias("__label"), *[_stated(f, F.col(f)).alias(f"__{f}") for f in fields])
    return local.join(r, local["label"] == r["__label"], "full_outer"), fields


def roster_changes(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(label, change, field, old_value, new_value): added, vanished, renamed and changed, from one join."""
    pairs, fields = _paired(local, remote)
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")

    def change(when: Column, kind: str, field: str | None = None, old: Column = none, new: Column = none) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("change"), F.lit(field).cast("string").alias("field"),
                                     old.alias("old_value"), new.alias("new_value")))

    both = F.col("label").isNotNull() & F.col("__label").isNotNull()
    found = [
        change(F.col("label").isNull(), "added"), change(F.col("__label").isNull(), "vanished"),
        change(both & ~F.col("portal_id").eqNullSafe(F.col("__portal_id")), "renamed", "portal_id", text("portal_id"), text("__portal_id")),
        *[change(both & F.col(f"__{f}").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"__{f}")), "changed", f, text(f), text(f"__{f}"))
          for f in fields],
    ]
    return pairs.select(F.coalesce("label", "__label").alias("label"), F.explode(F.array_compact(F.array(*found))).alias("c")).select(
        "label", "c.*")


def change_summary(changes: DataFrame) -> DataFrame:
    count = lambda kind: F.count_if(F.col("change") == kind).alias(kind)
    return changes.agg(count("added"), count("vanished"), count("renamed"), count("changed"))


def apply_roster(local: DataFrame, remote: DataFrame, stamp: str) -> DataFrame:
    """The registry after a sync. Roster fields overwrite, ours stay; nothing is ever deleted.

    A camera that left goes offline once, releases its id (ids are reused) and keeps it as history.
    """
    pairs, fields = _paired(local, remote)
    c = F.col
    added, gone = c("label").isNull(), c("__label").isNull()
    leaves = gone & ~c("portal_live").eqNullSafe(False)
    last_id = F.when(leaves & c("portal_id").isNotNull(), c("portal_id")).otherwise(c("last_portal_id"))
    note = F.concat(F.lit(f"{DEPARTURE_MARK} on {stamp}; portal_id released (was "), F.coalesce(last_id, F.lit("none")), F.lit(")"))
    old_notes = F.coalesce("notes", F.lit(""))
    departed_notes = F.when(old_notes.contains(DEPARTURE_MARK), c("notes")).when(old_notes != "", F.concat(old_notes, F.lit("; "), note)).otherwise(note)
    new_id = c("__portal_id")
    out = {
        "label": F.coalesce("label", "__label"),
        **{f: F.coalesce(f"__{f}", f) for f in fields},
        "portal_id": F.when(gone, F.when(~leaves, c("portal_id"))).otherwise(new_id),
        "last_portal_id": last_id,
        "portal_live": F.when(leaves, False).otherwise(F.coalesce("__portal_live", "portal_live")),
        "status": F.when(leaves, "offline").when(added, "online").otherwise(c("status")),
        "status_source": F.when(leaves, "measured").when(added, "portal_claim").otherwise(c("status_source")),
        "last_error": F.when(leaves, f"absent from the roster since {stamp}").otherwise(c("last_error")),
        "notes": F.when(leaves, departed_notes).when(added, ADDED_NOTE).otherwise(c("notes")),
        "last_seen": F.when(gone, c("last_seen")).otherwise(F.lit(stamp)),
        "source_type": F.when(gone, c("source_type")).otherwise("RTSP"),
        "source_url": F.when(gone, c("source_url")).otherwise(F.concat(F.lit("/stream/"), new_id)),
        "label_number": F.when(added, label_number(c("__label"))).otherwise(c("label_number")),
        "location_status": F.when(added, "unverified").otherwise(c("location_status")),
        "location_uncertainty_m": F.when(added, UNPLACED_UNCERTAINTY_M).otherwise(c("location_uncertainty_m")),
        "location_basis": F.when(added, UNPLACED_BASIS).otherwise(c("location_basis")),
        "department": F.when(added, "unassigned").otherwise(c("department")),
    }
    known = set(local.columns)
    missing = [n for n in out if n not in known]
    if missing:
        raise ValueError(f"registry rows lack {missing}")
    return pairs.select(*[out.get(n, c(n)).alias(n) for n in local.columns])


def upsert_registry(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Load roster rows by label. A position a person set survives, and so does the department."""
    shared = [n for n in incoming.columns if n in existing.columns and n not in ("label", "department_id", "location_set_by")]
    inc = incoming.select(F.col("label").alias("__label"), *[F.col(n).alias(f"__{n}") for n in shared])
    joined = existing.join(inc, existing["label"] == inc["__label"], "full_outer")
    arrives, held = F.col("__label").isNotNull(), F.col("location_set_by").isNotNull()

    def value(name: str) -> Column:
        if name == "label":
            return F.coalesce("label", "__label")
        if name not in shared:
            return F.col(name)
        refreshed = arrives if name in HUMAN_PLACED_REFRESH else arrives & ~held
        return F.when(refreshed, F.col(f"__{name}")).otherwise(F.col(name))

    return joined.select(*[value(n).alias(n) for n in existing.columns])


def stream_rows(roster: DataFrame, probes: DataFrame) -> DataFrame:
    """What is known of each stream. The probe measured codec, length and size; the roster states the rest first."""
    p = probes.select(F.col("portal_id").alias("__pid"), *[F.col(n).alias(f"__{n}") for n in probes.columns if n != "portal_id"])
    return roster.join(p, roster["portal_id"] == p["__pid"], "left").select(
        "label", "portal_id", F.coalesce("source_type", F.lit("RTSP")).alias("source_type"),
        F.coalesce("__codec", "codec").alias("codec"), F.coalesce("width", "__width").alias("width"),
        F.coalesce("height", "__height").alias("height"), F.coalesce("fps", "__actual_fps").alias("fps"),
        F.col("__duration_s").alias("duration_s"), F.col("__size_bytes").alias("size_bytes"))


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not there yet: appending them twice appends them once."""
    return incoming.join(existing.select(*keys), keys, "left_anti")


def resolve_suggestions(suggestions: DataFrame, cameras: DataFrame, departments: DataFrame) -> DataFrame:
    """Department suggestions by label and slug; ones naming nothing known are dropped, none is confirmed."""
    cam = cameras.select("label", "camera_id")
    dept = departments.select(F.col("slug").alias("__slug"), "department_id")
    return (
        suggestions.withColumn("__slug", F.lower("suggested_department")).join(cam, "label").join(dept, "__slug")
        .select("camera_id", "department_id", F.lit("label_inference").alias("basis"), F.col("basis").alias("rationale"),
                F.lit(False).alias("confirmed"), F.lit("seed:label_inference").alias("assigned_by"))
    )


def roster_digest(rosters: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """A digest per roster that changes if any row changes and ignores row order.

    A row is hashed as JSON, keys sorted and nulls kept, so no two different rows read the same. Row hashes
    are hashed in up to 4096 label buckets, and buckets into one digest, so no step gathers a whole roster.
    """
    fields = sorted(c for c in rosters.columns if c not in keys)
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    rows = rosters.select(*keys, F.substring(F.sha2(F.col(label), 256), 1, 3).alias("__bucket"), F.sha2(text, 256).alias("__row"))
    combine = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ","), 256)
    buckets = rows.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"), combine("__row").alias("__digest"))
    return buckets.groupBy(*keys).agg(F.sum("__n").alias("camera_count"), combine("__digest").alias("digest"))


def snapshot_changes(snapshots: DataFrame, chunk_ms: int = 30 * 86_400_000) -> DataFrame:
    """Each snapshot against the one before it from the same endpoint."""
    out = stitched(snapshots, keys=["endpoint"], order=["fetched_at_ms"], chunk=F.floor(F.col("fetched_at_ms") / chunk_ms),
                   previous={"previous_digest": "digest"})
    return out.withColumn("roster_changed", F.col("previous_digest").isNull() | (F.col("digest") != F.col("previous_digest")))
