"""Scene fingerprints: the median frame, its perceptual hash, and how hashes compare."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.pairs import BLOCK_ROWS, compare_within
from kerbline.operators.sequence import ranked_values

# Fixed values.
HASH_SIDE, KEEP = 32, 8
SLOT_BUCKET_SECONDS = 1800
MATCH_MAX_DISTANCE, CONFLICT_MIN_DISTANCE = 10, 18
USABLE_SEPARATION_BITS = 8
HASH_BITS = 64


def slot_bucket(offset_s: Column) -> Column:
    return F.floor(offset_s / SLOT_BUCKET_SECONDS).cast("int")


def hamming(a: Column, b: Column) -> Column:
    bits = lambda h: F.conv(h, 16, -10).cast("bigint")
    return F.bit_count(bits(a).bitwiseXOR(bits(b)))


def distance_class(distance: Column) -> Column:
    return (
        F.when(distance <= MATCH_MAX_DISTANCE, "match").when(distance >= CONFLICT_MIN_DISTANCE, "conflict")
        .otherwise("uncertain")
    )


def median_frames(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """The upper median of each pixel over a scene's frames. A pixel has at most 256 distinct values."""
    at = [*keys, "row_no", "col_no"]
    return ranked_values(pixels, keys=at, value="v", chunk=F.lit(0), ranks={"v": F.floor(F.col("n") / 2)}).select(*at, "v")


def perceptual_hash(frames: DataFrame, keys: list[str]) -> DataFrame:
    """64-bit hash of a 32 by 32 frame: the sign of its low frequencies against their median.

    The cosine transform is separable, so it is two groupings: eight sums along each row, then eight
    along each of those.
    """
    def cosine(at: str, k: int) -> Column:
        return F.cos(math.pi * (2 * F.col(at) + 1) * k / (2.0 * HASH_SIDE))

    rows = frames.groupBy(*keys, "row_no").agg(
        *[F.sum(F.col("v") * cosine("col_no", k)).alias(f"c{k}") for k in range(KEEP)])
    block = rows.groupBy(*keys).agg(
        F.array(*[F.sum(F.col(f"c{c}") * cosine("row_no", r)) for r in range(KEEP) for c in range(KEEP)]).alias("block"))
    # The first term is overall brightness: it is left out of the median but still compared with it.
    median = F.element_at(F.array_sort(F.slice("block", 2, KEEP * KEEP - 1)), (KEEP * KEEP - 1) // 2 + 1)
    bits = F.array_join(F.transform("block", lambda v: F.when(v > F.col("median"), "1").otherwise("0")), "")
    return block.withColumn("median", median).select(*keys, F.lpad(F.lower(F.conv(bits, 2, 16)), 16, "0").alias("phash"))


def _add(totals: np.ndarray, distance: np.ndarray, weight: np.ndarray) -> None:
    """Add the weights to the totals per distance. Sums run in doubles, so weights go in halves that they hold exactly."""
    low = np.bincount(distance, weight & 0x7FFFFFF, minlength=len(totals))
    totals += low.astype("int64") + (np.bincount(distance, weight >> 27, minlength=len(totals)).astype("int64") << 27)


def pair_distances(prints: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """How many pairs of fingerprints lie at each distance: (scope, distance, distance_class, pairs).

    Scopes: the same camera in one time bucket, different cameras in one bucket, and the same camera
    across buckets. Copies of a hash are folded into a weight; tasks emit at most 65 counts per scope.
    """
    folded = prints.groupBy("label", "slot_bucket", "phash").agg(F.count("*").alias("weight")).withColumns({
        "bits": F.conv("phash", 16, -10).cast("bigint"), "row_id": F.xxhash64("label", "slot_bucket", "phash")})

    def kernel_for(scope_of, within_label: bool):
        def kernel(a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
            other = a if b is None else b
            x, y = a["bits"].to_numpy().view("uint64"), other["bits"].to_numpy().view("uint64")
            wa, wb = a["weight"].to_numpy(), other["weight"].to_numpy()
            ka, kb = (f[scope_of].to_numpy() for f in (a, other))
            scopes = ("same_camera_other_bucket", None) if within_label else ("other_camera_same_bucket", "same_camera_same_bucket")
            totals = {scope: np.zeros(HASH_BITS + 1, "int64") for scope in scopes if scope}
            for start in range(0, len(a), 256):
                stop = min(start + 256, len(a))
                d = np.bitwise_count(x[start:stop, None] ^ y[None, :])
                w = wa[start:stop, None] * wb[None, :]
                if b is None:
                    w[np.arange(len(other))[None, :] <= np.arange(start, stop)[:, None]] = 0
                same = ka[start:stop, None] == kb[None, :]
                # Within one camera, pairs of one bucket are the other comparison's.
                for scope, among in zip(scopes, (~same, same)):
                    if scope:
                        _add(totals[scope], d[among], w[among])
            if b is None and not within_label:
                totals["same_camera_same_bucket"][0] += (wa * (wa - 1) // 2).sum()
            return pd.concat([pd.DataFrame({"scope": scope, "distance": np.flatnonzero(n).astype("int32"), "pairs": n[n > 0]})
                              for scope, n in totals.items()], ignore_index=True)
        return kernel

    schema = "scope string, distance int, pairs bigint"
    in_bucket = compare_within(folded, keys=["slot_bucket"], id="row_id", kernel=kernel_for("label", False),
                               schema=schema, block_rows=block_rows)
    across = compare_within(folded, keys=["label"], id="row_id", kernel=kernel_for("slot_bucket", True),
                            schema=schema, block_rows=block_rows)
    return in_bucket.unionByName(across).groupBy("scope", "distance").agg(F.sum("pairs").alias("pairs")).withColumn(
        "distance_class", distance_class(F.col("distance")))


def separation(distances: DataFrame) -> DataFrame:
    """Worst match of a camera with itself against the closest other camera; usable if far enough apart."""
    worst = F.max(F.when(F.col("scope") == "same_camera_same_bucket", F.col("distance")))
    closest = F.min(F.when(F.col("scope") == "other_camera_same_bucket", F.col("distance")))
    return distances.agg(worst.alias("worst_same"), closest.alias("best_different")).withColumns({
        "separation": F.col("best_different") - F.col("worst_same"),
        "usable": F.col("best_different") - F.col("worst_same") >= USABLE_SEPARATION_BITS,
    })


def decide_identity(known: DataFrame, observed: DataFrame) -> DataFrame:
    """Does a camera that answers to a label look like the camera that label belongs to?

    Label and picture agreeing reattaches it; anything else is a conflict for a person to settle.
    """
    k = known.select("label", "slot_bucket", F.col("phash").alias("known_phash"))
    joined = observed.join(k, ["label", "slot_bucket"], "left")
    distance = F.when(F.col("known_phash").isNotNull(), hamming(F.col("phash"), F.col("known_phash")))
    look = distance_class(F.col("distance"))
    return joined.withColumn("distance", distance).withColumn("look", F.when(F.col("distance").isNotNull(), look)).withColumn(
        "decision",
        F.when(F.col("known_phash").isNull(), "no_fingerprint").when(F.col("look") == "match", "reattach").otherwise("conflict"),
    )
