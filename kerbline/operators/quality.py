"""How good the index is: re-identification separation, plate legibility, colour doubt, manifests."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions import vectors
from kerbline.operators.pairs import BLOCK_ROWS, compare_within
from kerbline.operators.sequence import ranked_values, stitched
from kerbline.operators.signatures import MIN_PLATE_WIDTH_PX, PLATE_SHARE_OF_WIDTH, track_embeddings
from kerbline.session import written

MIN_CROPS = 4
BINS = 20_000
RESOLUTION = 1e-11
CHUNK_ROWS = 10_000


def _counts_between(rows: DataFrame, keys: list[str], id: str, block_rows: int, lo: float, hi: float) -> pd.DataFrame:
    """Pairs per stretch of [lo, hi), at most ``BINS`` and one for all below; counted in tasks."""

    def kernel(a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
        x = np.stack(a["embedding"].to_numpy())
        y = x if b is None else np.stack(b["embedding"].to_numpy())
        counts = np.zeros(BINS + 2, dtype="int64")
        for start in range(0, len(x), 1024):
            part = x[start:start + 1024] @ y.T
            bins = np.clip(np.floor((part - lo) / (hi - lo) * BINS), -1, BINS).astype("int64") + 1
            if b is None:
                bins = bins[np.arange(len(y))[None, :] > np.arange(start, start + len(part))[:, None]]
            counts += np.bincount(bins.ravel(), minlength=BINS + 2)
        at = np.nonzero(counts)[0]
        return pd.DataFrame({"bin": at - 1, "pairs": counts[at]})

    found = compare_within(rows, keys=keys, id=id, kernel=kernel, schema="bin bigint, pairs bigint", block_rows=block_rows)
    return found.groupBy("bin").agg(F.sum("pairs").alias("pairs")).orderBy("bin").toPandas()


def _median_similarity(rows: DataFrame, keys: list[str], id: str, block_rows: int) -> tuple[int, float | None]:
    """How many pairs, and the median of their similarities: the stretch that holds it is cut again and again."""
    unit = written(rows.withColumn("embedding", vectors.unit(F.col("embedding"))))

    def ranked(rank: int, counts: pd.DataFrame, lo: float, hi: float) -> float:
        while hi - lo > RESOLUTION:
            upto = counts["pairs"].cumsum().to_numpy()
            at = int(counts["bin"].iat[int(np.searchsorted(upto, rank, side="right"))])
            step = (hi - lo) / BINS
            lo, hi = lo + at * step, lo + (at + 1) * step
            if hi - lo > RESOLUTION:
                counts = again(lo, hi)
        return (lo + hi) / 2

    @functools.cache
    def again(lo: float, hi: float) -> pd.DataFrame:
        return _counts_between(unit, keys, id, block_rows, lo, hi)

    lo, hi = -1.0 - 1e-6, 1.0 + 1e-6
    first = again(lo, hi)
    n = int(first["pairs"].sum())
    if not n:
        return 0, None
    return n, (ranked((n - 1) // 2, first, lo, hi) + ranked(n // 2, first, lo, hi)) / 2


def reid_separation(crops: DataFrame, *, min_crops: int = MIN_CROPS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Median similarity of crops of one vehicle, of different vehicles' mean vectors, and the gap.

    Only vehicles with enough crops count. Similarities are counted per stretch in each task, and the
    stretch that holds a median is cut again until it is narrower than ``RESOLUTION``; pairs never leave a
    task, and what the driver sees is one count per stretch. Every two vehicles are compared: the work is
    quadratic in vehicles, as the measure demands.
    """
    sizes = crops.groupBy("track_id").agg(F.count("*").alias("__n")).where(F.col("__n") >= min_crops)
    enough = crops.join(sizes.drop("__n"), "track_id", "left_semi")
    same = _median_similarity(enough, ["track_id"], "crop_no", block_rows)
    different = _median_similarity(track_embeddings(enough).withColumn("__all", F.lit(0)), ["__all"], "track_id", block_rows)
    gap = same[1] - different[1] if same[0] and different[0] else None
    return crops.sparkSession.createDataFrame(
        [(same[0], same[1], different[0], different[1], gap)],
        "same_pairs bigint, same_median double, different_pairs bigint, different_median double, gap double")


def plate_legibility(detections: DataFrame, width: str = "width_px") -> DataFrame:
    """How wide vehicles are, how wide their plates must then be, and how many clear the bar."""
    widths = ranked_values(
        detections, keys=[], value=width, chunk=F.floor(F.col(width) / 64),
        ranks={"lo": F.floor((F.col("n") - 1) / 2), "hi": F.floor(F.col("n") / 2),
               "p90_lo": F.floor((F.col("n") - 1) * 0.9), "p90_hi": F.ceil((F.col("n") - 1) * 0.9)})
    part = (F.col("n") - 1) * 0.9 - F.floor((F.col("n") - 1) * 0.9)
    clears = (F.col(width) * PLATE_SHARE_OF_WIDTH >= MIN_PLATE_WIDTH_PX).cast("int")
    shares = detections.agg(F.avg(clears).alias("share_legible"))
    table = widths.select(
        F.col("n").alias("boxes"), ((F.col("lo") + F.col("hi")) / 2.0).alias("median_width"),
        (F.col("p90_lo") + (F.col("p90_hi") - F.col("p90_lo")) * part).alias("p90_width"))
    one = F.lit(1).alias("__one")
    return table.select("*", one).join(shares.select("*", one), "__one").drop("__one").withColumn(
        "median_plate_width", F.col("median_width") * PLATE_SHARE_OF_WIDTH)


def colour_doubt(signatures: DataFrame) -> DataFrame:
    return signatures.groupBy("camera_id").agg(
        F.count("*").alias("signatures"), F.count_if("colour_uncertain").alias("doubtful"),
        (F.count_if("colour_uncertain") / F.count("*")).alias("doubt_rate"))


def chunk_seams(chunks: DataFrame) -> DataFrame:
    """How each captured chunk meets the one before it: keyframe snap, overlap, and where new frames start.

    The previous chunk is the last good one before it.
    """
    good_end = F.when(F.col("ok"), F.col("last_pts_s"))
    with_prev = stitched(chunks, keys=["camera_id", "tag"], order=["idx"], chunk=F.floor(F.col("idx") / CHUNK_ROWS),
                         running_last={"prev_last_pts_s": good_end})
    overlap = F.col("prev_last_pts_s") - F.col("first_pts_s")
    return with_prev.withColumns({
        "keyframe_snap_s": F.col("requested_offset_s") - F.col("first_pts_s"),
        "overlap_s": F.when(overlap > 0, overlap).otherwise(0.0),
    })


def fresh_frames(frames: DataFrame, seams: DataFrame) -> DataFrame:
    """Frames of each chunk that the chunk before it does not already hold."""
    edge = seams.select("camera_id", "tag", "idx", "prev_last_pts_s")
    joined = frames.join(edge, ["camera_id", "tag", "idx"])
    return joined.where(F.col("prev_last_pts_s").isNull() | (F.col("pts_s") > F.col("prev_last_pts_s"))).drop("prev_last_pts_s")


def manifest_totals(seams: DataFrame) -> DataFrame:
    return seams.groupBy("camera_id", "tag").agg(
        F.count_if("ok").alias("chunks_ok"), F.count("*").alias("chunks_total"),
        F.sum("overlap_s").alias("cumulative_overlap_s"), (F.count_if("ok") == F.count("*")).alias("complete"))
