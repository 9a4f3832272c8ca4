"""Folding matches into alerts, and what the alert service reports about itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.sequence import ranked_values

KEY = ["track_id", "entry_id"]
#: Taken from the first sighting and never changed by a later one.
FIRST = ["source", "priority", "camera_id", "recorded_ms", "pipeline_latency_ms"]


def alert_id(track: Column, entry: Column, order: Column) -> Column:
    """The same alert gets the same id on every run; a sighting without a key is its own alert."""
    own = F.when(track.isNull() | entry.isNull(), order.cast("string")).otherwise("")
    return F.concat(F.lit("c"), F.substring(F.sha2(F.concat_ws("|", track, entry, own), 256), 1, 24))


def fold_alerts(sightings: DataFrame, order: str = "seq", extra: list[Column] | None = None) -> DataFrame:
    """One alert per (track, entry): built on the first sighting, only ever raised by later ones.

    Confidence is the maximum; how it matched changes only on a strictly better sighting; last seen
    is the latest sighting after the first. Partial results merge before the shuffle.
    """
    keyless = F.col("track_id").isNull() | F.col("entry_id").isNull()
    rows = sightings.withColumn("__solo", F.when(keyless, F.col(order)))
    first = [F.min_by(c, order).alias(c) for c in FIRST if c in sightings.columns]
    better = F.struct(-F.col("confidence"), F.col(order))
    return (
        rows.groupBy(*KEY, "__solo")
        .agg(
            F.min(order).alias("first_order"), *first, F.max("confidence").alias("confidence"),
            F.min_by("matched_via", better).alias("matched_via"), F.min_by("repaired", better).alias("repaired"),
            F.when(F.count("*") > 1, F.max_by("recorded_ms", order)).alias("last_seen_ms"),
            F.count("*").alias("sightings"), *(extra or []),
        )
        .withColumn("alert_id", alert_id(F.col("track_id"), F.col("entry_id"), F.col("first_order")))
        .drop("__solo")
    )


def sightings_of(matches: DataFrame, events: DataFrame, emitted_ms: str | None = None) -> DataFrame:
    """Matches with what the alert needs of their signature event, and the measured latency."""
    from kerbline.functions.clock import latency_ms

    needed = ["event_id", "track_id", "camera_id", "recorded_at_ms", "detected_at_ms"] + ([emitted_ms] if emitted_ms else [])
    emitted = F.col(emitted_ms) if emitted_ms else F.unix_millis(F.current_timestamp())
    return (
        matches.join(events.select(*needed), "event_id")
        .withColumns({
            "pipeline_latency_ms": latency_ms(F.col("detected_at_ms"), emitted),
            "recorded_ms": F.col("recorded_at_ms"), "seq": F.struct("detected_at_ms", "event_id"),
        })
    )


def latency_percentiles(alerts: DataFrame, value: str, percentiles: dict[str, float]) -> DataFrame:
    """Exact: the sorted value at floor(n * p), capped at the last."""
    ranks = {k: F.least(F.floor(F.col("n") * p), F.col("n") - 1) for k, p in percentiles.items()}
    return ranked_values(alerts, keys=[], value=value, chunk=F.floor(F.col(value) / 1000), ranks=ranks)


def service_counters(matches: DataFrame, events: DataFrame) -> DataFrame:
    """How many events were processed and how many distinct alerts they raised."""
    raised = matches.groupBy("track_id", "entry_id").agg(F.count("*").alias("n")).agg(
        F.lit("raised").alias("counter"), F.count("*").alias("value"))
    processed = events.agg(F.lit("processed").alias("counter"), F.count("*").alias("value"))
    return processed.unionByName(raised)
