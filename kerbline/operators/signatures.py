"""What a vehicle looks like: colour from pixels, one vector per track, the assembled signature."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions import vectors
from kerbline.functions.binding import bind

# Hue bands on the 0-179 scale, brightness and saturation limits, plate width.
HUE_BANDS = [
    ("red", 0, 10), ("orange", 11, 22), ("yellow", 23, 33), ("green", 34, 85),
    ("blue", 86, 125), ("purple", 126, 155), ("red", 156, 179),
]
LOW_LIGHT_VALUE = 60.0
WEAK_SATURATION = 60
ACHROMATIC_SHARE = 0.6
WHITE_ABOVE, GREY_ABOVE, DARK_BLACK_BELOW = 170, 90, 40
MIN_CROP_PX = 8
MIN_PLATE_WIDTH_PX = 90.0
PLATE_SHARE_OF_WIDTH = 0.25
TINY_NORM = 1e-6


def estimate_colours(pixels: DataFrame) -> DataFrame:
    """(crop_id, colour, colour_confidence, colour_uncertain) from a table of HSV pixels.

    Only the middle of the crop counts. Hues are counted per crop before the commonest is chosen, so
    a crop's pixels are never gathered.
    """
    c = F.col
    low = lambda size, share: F.floor(c(size) * share)
    body = pixels.where(
        (c("row_no") >= low("height", 0.20)) & (c("row_no") < low("height", 0.65))
        & (c("col_no") >= low("width", 0.25)) & (c("col_no") < low("width", 0.75))
        & (c("height") >= MIN_CROP_PX) & (c("width") >= MIN_CROP_PX)
    )
    strong = c("s") >= WEAK_SATURATION
    by_hue = body.groupBy("crop_id", F.when(strong, c("h")).alias("hue")).agg(
        F.count("*").alias("n"), F.sum("v").alias("v"))
    stats = by_hue.groupBy("crop_id").agg(
        (F.sum("v") / F.sum("n")).alias("mean_v"),
        (F.coalesce(F.sum(F.when(c("hue").isNull(), c("n"))), F.lit(0)) / F.sum("n")).alias("weak_share"),
        F.coalesce(F.sum(F.when(c("hue").isNotNull(), c("n"))), F.lit(0)).alias("strong_n"),
        F.max_by(F.struct("hue", "n"), F.when(c("hue").isNotNull(), F.struct("n", -c("hue")))).alias("top"),
    )
    band = F.lit(None).cast("string")
    for name, lo, hi in reversed(HUE_BANDS):
        band = F.when(c("top.hue").between(lo, hi), name).otherwise(band)
    dark = c("mean_v") < LOW_LIGHT_VALUE
    grey_scale = F.when(c("mean_v") > WHITE_ABOVE, "white").when(c("mean_v") > GREY_ABOVE, "grey").otherwise("black")
    achromatic, no_hue = c("weak_share") > ACHROMATIC_SHARE, c("strong_n") == 0
    known = stats.select(
        "crop_id",
        F.when(achromatic, grey_scale).when(no_hue, "grey").otherwise(band).alias("colour"),
        F.when(achromatic, F.bround("weak_share", 3)).when(no_hue, 0.3)
        .otherwise(F.bround(F.least(F.lit(1.0), c("top.n") / c("strong_n") * 3), 3)).alias("colour_confidence"),
        F.when(achromatic, dark | ((grey_scale == "black") & (c("mean_v") < DARK_BLACK_BELOW)))
        .when(no_hue, True).otherwise(dark).alias("colour_uncertain"),
    )
    return pixels.select("crop_id").distinct().join(known, "crop_id", "left").select(
        "crop_id", "colour", F.coalesce("colour_confidence", F.lit(0.0)).alias("colour_confidence"),
        F.coalesce("colour_uncertain", F.lit(True)).alias("colour_uncertain"),
    )


def track_embeddings(crops: DataFrame, *, floor: float = TINY_NORM) -> DataFrame:
    """One vector per track: crops scaled to unit length, averaged, scaled again. Averages merge before the shuffle."""
    scaled = crops.withColumn("__v", array_to_vector(vectors.unit(F.col("embedding"), floor)))
    mean = scaled.groupBy("track_id").agg(
        vector_to_array(Summarizer.mean(F.col("__v"))).alias("__m"), F.count("*").alias("crops"))
    length = F.sqrt(vectors.squared_norm(F.col("__m")))
    scaled_again = bind(length, lambda n: F.transform("__m", lambda x: x / F.when(n > floor, n).otherwise(1.0)))
    return mean.select("track_id", "crops", scaled_again.alias("embedding"))


def plate_worth_reading(width_px: Column) -> Column:
    """Would a plate, about a quarter of the vehicle's width, be wide enough to read?"""
    return width_px * PLATE_SHARE_OF_WIDTH >= MIN_PLATE_WIDTH_PX


def embed_crops(crops: DataFrame, embed_fn: Callable[[pd.Series], pd.Series], image: str = "image") -> DataFrame:
    """Hook for an embedding model: called on Arrow batches of crop bytes, returns arrays of double."""
    embed = F.pandas_udf(embed_fn, "array<double>")
    return crops.withColumn("embedding", embed(F.col(image)))


def read_plates(crops: DataFrame, read_plate_fn: Callable[[pd.Series], pd.Series], image: str = "image", width: str = "width") -> DataFrame:
    """Hook for a plate reader: only crops wide enough to read reach it."""
    read = F.pandas_udf(read_plate_fn, "string")
    worth = crops.where(plate_worth_reading(F.col(width))).withColumn("partial_plate", read(F.col(image)))
    rest = crops.where(~F.coalesce(plate_worth_reading(F.col(width)), F.lit(False))).withColumn("partial_plate", F.lit(None).cast("string"))
    return worth.unionByName(rest)


def build_signatures(tracks: DataFrame, crops: DataFrame, colours: DataFrame, *, dim: int, model: str | None) -> DataFrame:
    """Assemble signatures: colour from the largest crop, vector from all of them.

    A track without crops gets a zero vector, which matches nothing; without a model the vector is empty.
    """
    largest = (
        crops.join(colours, "crop_id", "left").groupBy("track_id")
        .agg(F.max_by(
            F.struct("colour", "colour_confidence", "colour_uncertain", "width", "crop_id"),
            F.struct(F.col("width") * F.col("height"), -F.col("crop_id"))).alias("best"))
    )
    out = tracks.select("track_id", "cls").join(largest, "track_id", "left")
    if model is None:
        out = out.withColumn("embedding", F.array().cast("array<double>"))
    else:
        out = out.join(track_embeddings(crops).drop("crops"), "track_id", "left").withColumn(
            "embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0), dim)))
    return out.select(
        "track_id", "cls", "best.colour", F.coalesce("best.colour_confidence", F.lit(0.0)).alias("colour_confidence"),
        F.coalesce("best.colour_uncertain", F.lit(True)).alias("colour_uncertain"), "embedding",
        F.lit(model).alias("embedding_model"),
        F.coalesce(plate_worth_reading(F.col("best.width")), F.lit(False)).alias("plate_readable"),
    )


def plate_consensus(reads: DataFrame) -> DataFrame:
    """The reading most frames of a track agree on, and how large a share that is.

    Ties go to the higher mean confidence, then to the smaller plate text.
    """
    per_plate = reads.where(F.col("plate").isNotNull()).groupBy("track_id", "plate").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("confidence"))
    best = per_plate.groupBy("track_id").agg(
        F.min_by("plate", F.struct(-F.col("n"), -F.col("confidence"), "plate")).alias("normalized"),
        F.max("n").alias("winning"), F.sum("n").alias("frames_considered"),
    )
    return best.select("track_id", "normalized", "frames_considered",
                       (F.col("winning") / F.col("frames_considered")).alias("agreement"))
