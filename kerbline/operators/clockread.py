"""Overlay clocks read by OCR: which second was meant, which variant to trust, how often it was right."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.session import spread

# Fixed values.
WINDOW_S = 1800
MIN_DIGITS = 10
MIN_SCORE = 0.78
RIVAL_RANKS, RIVAL_MARGIN, RIVAL_AWAY_S = 40, 0.02, 90
AGREEMENT_BONUS = 0.15
EXACT_WITHIN_MS = 1000
REQUIRED_ACCURACY = 0.95
STAMP_DIGITS = 14
#: Seconds whose distances a task holds at once.
SLICE_CELLS = 1 << 20
TIMESTAMP_PATTERN = r"\d[\d\s:/.\-]{8,}\d"


def _distances(seen: np.ndarray, hour: np.ndarray) -> np.ndarray:
    """Edit distances, (reads, 3600), from each row of ``seen`` to the stamps of every second of its ``hour``.

    Stamps of an hour share its characters, those of a minute the minute's too: the recurrence runs over the
    tree of their beginnings, one column of the texts at a time, for all reads at once. Of the last digit
    only the outcome is worked out, from its parents.
    """
    (n, length), head = seen.shape, hour.shape[1]
    kind = np.int16 if length + head < 16_000 else np.int32
    one, far = kind(1), kind(length + head + 8)
    # Distances to the text so far: of the hour's beginnings, then with one, two and three digits more.
    lead = [np.full(n, i, kind) for i in range(head + 1)]
    tree = [np.full((n, *shape), head + 1 + i, kind) for i, shape in enumerate([(6,), (6, 10), (6, 10, 6)])]
    # The parent's distance less the column read, where that column is the last digit, and in any column.
    met, unmet = np.full((n, 10, 6, 10, 6), far, kind), np.full((n, 6, 10, 6), far, kind)
    rows = np.arange(n)
    for j in range(length):
        s = seen[:, j]
        ahead = tree[2] - kind(j)
        np.minimum(unmet, ahead, out=unmet)
        met[rows, s] = np.minimum(met[rows, s], ahead)
        over, lead[0] = lead[0], lead[0] + one
        for i in range(head):
            best = np.minimum(np.minimum(lead[i], lead[i + 1]) + one, over + (hour[:, i] != s).astype(kind))
            over, lead[i + 1] = lead[i + 1], best
        above = lead[head]
        miss = (np.arange(10) != s[:, None]).astype(kind)
        for k, level in enumerate(tree):
            step = miss[:, :level.shape[-1]].reshape(n, *[1] * (level.ndim - 2), -1)
            best = np.minimum(np.minimum(level, above[..., None]) + one, over[..., None] + step)
            above, over, tree[k] = best, level, best
    plain = np.minimum(unmet + kind(length), tree[2] + one)
    return np.minimum(np.moveaxis(met, 1, -1) + kind(length - 1), plain[..., None]).reshape(n, 3600)


def _judge(seen: np.ndarray, hours: list[np.ndarray], first: np.ndarray, window_s: int) -> tuple:
    """The best second of each read's window: its score, how far it is from the middle, and whether it has a far rival."""
    deltas = np.arange(-window_s, window_s + 1)
    deltas = deltas[np.lexsort((deltas, np.abs(deltas)))]
    every = np.concatenate([_distances(seen, h) for h in hours], axis=1)
    order = np.take_along_axis(every, first[:, None] + window_s + deltas, axis=1) * np.int64(len(deltas)) + np.arange(len(deltas))
    ranks = min(RIVAL_RANKS, len(deltas))
    top = np.sort(np.partition(order, ranks - 1, axis=1)[:, :ranks], axis=1)
    score = 1.0 - top // len(deltas) / max(STAMP_DIGITS, seen.shape[1])
    delta = deltas[top % len(deltas)]
    rivals = (score[:, 1:] >= score[:, :1] - RIVAL_MARGIN) & (np.abs(delta[:, 1:] - delta[:, :1]) > RIVAL_AWAY_S)
    return score[:, 0], delta[:, 0], rivals.any(axis=1)


def _characters(texts: pd.Series) -> np.ndarray:
    """Texts of one length as rows of code points, digits as their value."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<i4").reshape(len(texts), -1) - ord("0")


def _judged(window_s: int, parts: int):
    """A task's function over (digits seen, the window's hours as text, its first second within them)."""

    @F.pandas_udf("score double, delta int, rivalled boolean")
    def judged(seen: pd.Series, hours: pd.Series, first: pd.Series) -> pd.DataFrame:
        n = len(seen)
        score, delta, rivalled = np.full(n, np.nan), np.zeros(n, "int32"), np.zeros(n, bool)
        able = pd.Series(np.flatnonzero(seen.notna() & first.notna()))
        if len(able):
            alike = able.map(lambda i: (len(seen.iat[i]), *map(len, hours.iat[i])))
            for _, group in able.groupby(alike):
                rows = max(1, SLICE_CELLS // (3600 * parts))
                for at in range(0, len(group), rows):
                    i = group.to_numpy()[at:at + rows]
                    stamps = hours.iloc[i]
                    score[i], delta[i], rivalled[i] = _judge(
                        _characters(seen.iloc[i]), [_characters(stamps.str[h]) for h in range(parts)],
                        first.iloc[i].to_numpy("int64"), window_s)
        return pd.DataFrame({"score": score, "delta": delta, "rivalled": rivalled})

    return judged


def resolve_reads(reads: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """Add proposed_ms and score: the second near the expected time whose digits are closest to the text.

    Every second of the window is compared, inside the row's task: nothing is exploded. A winner that scores
    like a candidate far away in time is noise choosing, and its score is halved.
    """
    c = F.col
    seen = F.regexp_replace("ocr_text", r"\D", "")
    enough = F.coalesce(F.length("__seen") >= MIN_DIGITS, F.lit(False))
    start = F.floor(c("expected_ms") / 1000) - window_s
    hour = F.floor(start / 3600)
    # Expected times are the overlay's own wall clock, so they are rendered without a zone shift (UTC).
    parts = (2 * window_s + 3599) // 3600 + 1
    hours = F.array(*[F.date_format(F.timestamp_seconds((hour + h) * 3600), "ddMMyyyyHH") for h in range(parts)])
    judged = _judged(window_s, parts)(c("__seen"), c("__hours"), c("__first"))
    out = spread(reads).withColumn("__seen", seen).withColumns({
        "__hours": F.when(enough, hours), "__first": F.when(enough, start - hour * 3600)}).withColumn("__j", judged)
    readable = F.coalesce(c("__j.score") >= MIN_SCORE, F.lit(False))
    return out.withColumns({
        "proposed_ms": F.when(readable, c("expected_ms") + c("__j.delta") * 1000),
        "score": F.when(~enough, 0.0).when(readable & c("__j.rivalled"), F.bround(c("__j.score") * 0.5, 3))
        .otherwise(F.bround(c("__j.score"), 3)),
    }).drop("__seen", "__hours", "__first", "__j")


def vote_frames(resolved: DataFrame, frame: list[str]) -> DataFrame:
    """One reading per frame from its image variants: the best score, raised by variants that agree."""
    proposals = resolved.groupBy(*frame, "proposed_ms").agg(
        F.count("*").alias("agreeing"), F.max(F.struct("score", -F.col("variant"))).alias("top"))
    best = proposals.groupBy(*frame).agg(F.max_by(F.struct("proposed_ms", "agreeing", "top"), "top").alias("b"))
    score = F.col("b.top.score")
    raised = F.least(F.lit(1.0), score * (1 + AGREEMENT_BONUS * (F.col("b.agreeing") - 1)))
    return best.select(
        *frame, F.col("b.proposed_ms").alias("proposed_ms"),
        F.bround(F.when(F.col("b.proposed_ms").isNotNull(), raised).otherwise(score), 3).alias("confidence"))


def best_anchors(frames: DataFrame, anchor: list[str], order: str) -> DataFrame:
    """The most confident frame of each anchor; the earliest tried wins a tie."""
    return frames.groupBy(*anchor).agg(
        F.max_by(F.struct(*[c for c in frames.columns if c not in anchor]), F.struct("confidence", -F.col(order))).alias("b")
    ).select(*anchor, "b.*")


def pair_accuracy(frames: DataFrame, clip: str = "clip") -> DataFrame:
    """Per clip: of all pairs of frames, how many readings advance as the seek did, to within a second.

    A pair agrees when the two readings are off by nearly the same amount, so agreeing pairs are found
    by counting neighbours in sorted offsets; the pairs are never formed.
    """
    c = F.col
    offset = (c("proposed_ms") - c("seek_s") * 1000).cast("bigint")
    counts = frames.groupBy(clip, offset.alias("off")).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy(clip).orderBy("off").rangeBetween(1, EXACT_WITHIN_MS - 1)
    read = c("off").isNotNull()
    agreeing = F.when(read, c("n") * (c("n") - 1) / 2 + c("n") * F.coalesce(c("near"), F.lit(0)))
    totals = counts.withColumn("near", F.sum("n").over(ahead)).groupBy(clip).agg(
        F.sum("n").alias("frames"), F.coalesce(F.sum(F.when(read, c("n"))), F.lit(0)).alias("frames_read"),
        F.coalesce(F.sum(agreeing), F.lit(0)).cast("bigint").alias("exact"))
    both = (c("frames_read") * (c("frames_read") - 1) / 2).cast("bigint")
    pairs = (c("frames") * (c("frames") - 1) / 2).cast("bigint")
    return totals.select(clip, "frames", "frames_read", pairs.alias("pairs"), "exact",
                         (both - c("exact")).alias("wrong"), (pairs - both).alias("unreadable"))


def accuracy_gate(per_clip: DataFrame) -> DataFrame:
    total = per_clip.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "exact", "wrong", "unreadable")])
    accuracy = F.when(F.col("pairs") > 0, F.col("exact") / F.col("pairs"))
    return total.withColumns({"accuracy": accuracy, "passes": F.coalesce(accuracy >= REQUIRED_ACCURACY, F.lit(False))})
