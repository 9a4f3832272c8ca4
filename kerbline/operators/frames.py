"""Frames of a feed: where it breaks, what its clock is, and which frames to keep.

All of it follows arrival order per connection. Each step is a window over chunks of a connection
(see ``sequence``), so a feed that never breaks is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions import clock
from kerbline.operators.sequence import stitched
from kerbline.session import cut_lineage

# Fixed values.
MAX_FORWARD_GAP_MS = 5_000
SETTLE_MS, BURST_GUARD_MS = 5_000, 1_500
VELOCITY_WINDOW_MS = 1_000
CHUNK_SEQ = 100_000

CONNECTION = ["camera_id", "connection_id"]


def pts_jump(pts: Column, previous: Column, max_forward_gap_ms: float = MAX_FORWARD_GAP_MS) -> Column:
    return F.coalesce((pts < previous) | (pts - previous > max_forward_gap_ms), F.lit(False))


def mark_segments(
    frames: DataFrame, *, max_forward_gap_ms: float = MAX_FORWARD_GAP_MS, chunk_seq: int = CHUNK_SEQ
) -> DataFrame:
    """Add pts_jump, discontinuity, segment (0 for the first) and what the segment started with.

    Any of a PTS jump, a scene cut or a clock reading going backwards breaks the feed. The first
    frame of a connection starts it; it does not break it. The result is written once, to the
    checkpoint folder, because anchoring, sampling and events all start from it.
    """
    chunk = F.floor(F.col("seq") / chunk_seq)
    seen = stitched(
        frames, keys=CONNECTION, order=["seq"], chunk=chunk,
        previous={"prev_pts_ms": "pts_ms", "prev_arrival_ms": "arrival_ms", "prev_seq": "seq"},
    )
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in frames.columns else F.lit(False)
    jump = pts_jump(F.col("pts_ms"), F.col("prev_pts_ms"), max_forward_gap_ms)
    first = F.col("prev_seq").isNull()
    marked = seen.withColumns({
        "pts_jump": jump, "discontinuity": ~first & (jump | flag("scene_cut") | flag("clock_backwards")),
    }).withColumn("starts_segment", first | F.col("discontinuity"))
    marked = cut_lineage(marked)
    starts = F.col("starts_segment")
    numbered = stitched(
        marked, keys=CONNECTION, order=["seq"], chunk=chunk,
        previous={"prev2_pts_ms": "prev_pts_ms", "prev_starts_segment": "starts_segment"},
        running_sum={"segment": F.col("discontinuity").cast("bigint"), "ordinal": F.lit(1).cast("bigint")},
        running_last={"__start": F.when(starts, F.struct("pts_ms", "arrival_ms"))},
    )
    start = F.when(starts, F.struct("pts_ms", "arrival_ms")).otherwise(F.col("__start"))
    return cut_lineage(numbered.withColumns({
        "segment_pts_ms": start["pts_ms"], "segment_arrival_ms": start["arrival_ms"],
    }).drop("__start"))


def loop_events(segments: DataFrame) -> DataFrame:
    """One ``camera.loop`` event per discontinuity; the start of a connection is not one."""
    return segments.where("discontinuity").select(
        F.lit("camera.loop").alias("kind"), "camera_id", "seq",
        F.to_json(F.struct("connection_id", "segment", "pts_ms")).alias("payload"),
    )


def anchor_clock(
    segments: DataFrame, *, settle_ms: float = SETTLE_MS, burst_guard_ms: float = BURST_GUARD_MS,
    chunk_seq: int = CHUNK_SEQ,
) -> DataFrame:
    """Add the best anchor so far (smallest arrival - PTS outside the join burst), its settledness and absolute time.

    Both running values restart with the segment: ordering by the newest segment first makes one
    running minimum over the connection do that.
    """
    since = F.col("arrival_ms") - F.col("segment_arrival_ms")
    delay = F.when(since >= burst_guard_ms, F.col("arrival_ms") - F.col("pts_ms")).otherwise(F.lit(float("inf")))
    newest = (-F.col("segment")).alias("s")
    run = stitched(
        segments, keys=CONNECTION, order=["seq"], chunk=F.floor(F.col("seq") / chunk_seq),
        running_min={"__best": F.struct(newest, delay.alias("v")), "__longest": F.struct(newest, (-since).alias("v"))},
    )
    best = F.when(F.col("__best.v") < float("inf"), F.col("__best.v"))
    return run.withColumns({
        "anchor_ms": best, "absolute_ms": best + F.col("pts_ms"),
        "anchor_settled": best.isNotNull() & (-F.col("__longest.v") >= burst_guard_ms + settle_ms),
    }).drop("__best", "__longest")


def segment_anchors(segments: DataFrame, *, settle_ms: float = SETTLE_MS, burst_guard_ms: float = BURST_GUARD_MS) -> DataFrame:
    """The final anchor of every segment, as one aggregation."""
    since = F.col("arrival_ms") - F.col("segment_arrival_ms")
    return (
        segments.groupBy(*CONNECTION, "segment")
        .agg(
            F.count("*").alias("frames"),
            F.min(F.when(since >= burst_guard_ms, F.col("arrival_ms") - F.col("pts_ms"))).alias("anchor_ms"),
            F.max(since).alias("__longest"),
        )
        .withColumn("anchor_settled", F.col("anchor_ms").isNotNull() & (F.col("__longest") >= burst_guard_ms + settle_ms))
        .drop("__longest")
    )


def sample_on_grid(segments: DataFrame, interval_ms: float, *, chunk_seq: int = CHUNK_SEQ) -> DataFrame:
    """Keep, for each tick of a fixed PTS grid, whichever straddling frame is closer to it.

    The grid starts at the segment's first frame. A frame that reaches a tick is kept, unless the one
    just before it was waiting and is strictly closer. When that earlier frame wins across a gap of
    several ticks, the tick after it is already due and the next frame is kept as well.

    Written without a state machine: a tick crossing is visible from neighbouring frames. Only the
    "already due" case feeds back, from two frames earlier, so along a run of such frames two apart
    it alternates, and its parity within the run settles it.
    """
    if not interval_ms > 0:
        raise ValueError("the PTS grid interval must be positive")
    c = F.col
    chunk = F.floor(c("seq") / chunk_seq)
    tick = lambda pts: F.floor((pts - c("segment_pts_ms")) / interval_ms)
    first, second = c("starts_segment"), F.coalesce(c("prev_starts_segment"), F.lit(False))
    ticks = segments.withColumns({"__t": tick(c("pts_ms")), "__t1": tick(c("prev_pts_ms")), "__t2": tick(c("prev2_pts_ms"))})
    due = c("segment_pts_ms") + (c("__t1") + 1) * interval_ms
    crosses = ~first & (c("__t") > c("__t1"))
    earlier_crossed = second | (c("__t1") > c("__t2"))
    earlier_closer = F.abs(c("prev_pts_ms") - due) < F.abs(c("pts_ms") - due)
    flagged = ticks.withColumns({
        "__crosses": crosses, "__waited": ~first & ~earlier_crossed, "__closer": earlier_closer,
    }).withColumn("__leap", c("__crosses") & c("__waited") & c("__closer") & (c("__t") > c("__t1") + 1))
    runs = stitched(
        flagged, keys=CONNECTION, order=["seq"], chunk=chunk, running_last={"__last_leap": F.when(c("__leap"), c("ordinal"))}
    )
    opens = c("__leap") & (c("__last_leap").isNull() | (c("ordinal") - c("__last_leap") != 2))
    placed = stitched(
        cut_lineage(runs.withColumn("__opens", opens)), keys=CONNECTION, order=["seq"], chunk=chunk,
        running_last={"__run_start": F.when(c("__opens"), c("ordinal"))},
    )
    last_left_due = F.coalesce((c("__last_leap") - c("__run_start")) % 4 == 0, F.lit(False))
    behind = c("ordinal") - c("__last_leap")
    overdue = ~first & F.coalesce(last_left_due & (behind == 1), F.lit(False))
    pending = c("__waited") & ~F.coalesce(last_left_due & (behind == 2), F.lit(False))
    take_earlier = ~overdue & c("__crosses") & pending & c("__closer")
    kept = placed.withColumn("__earlier", take_earlier).where(first | overdue | c("__crosses"))
    pick = lambda now, before: F.when(c("__earlier"), c(before)).otherwise(c(now))
    extra = [n for n in ("anchor_ms", "anchor_settled") if n in segments.columns]
    return kept.select(
        *CONNECTION, "segment", pick("seq", "prev_seq").alias("seq"), pick("pts_ms", "prev_pts_ms").alias("pts_ms"),
        pick("arrival_ms", "prev_arrival_ms").alias("arrival_ms"), c("seq").alias("emitted_at_seq"), *extra,
    )


def rolling_velocity(
    observations: DataFrame, *, keys: list[str], window_ms: int = VELOCITY_WINDOW_MS, chunk_ms: int = 60_000
) -> DataFrame:
    """Velocity from the first to the last observation of the window, in PTS time; null when it cannot be told.

    When the window holds only the current observation, the one before it is used. Chunks of PTS
    share the last ``window_ms`` of their neighbour.
    """
    c = F.col
    home = F.floor(c("pts_ms") / chunk_ms)
    known = stitched(
        observations, keys=keys, order=["pts_ms"], chunk=home, previous={"__px": "x", "__py": "y", "__pt": "pts_ms"}
    )
    spread = known.withColumn("__home", home).withColumn(
        "__c", F.explode(F.sequence(home, F.floor((c("pts_ms") + window_ms) / chunk_ms))))
    span = Window.partitionBy(*keys, "__c").orderBy("pts_ms").rangeBetween(-window_ms, 0)
    framed = spread.withColumns({
        "__n": F.count("*").over(span), "__f": F.first(F.struct("x", "y", "pts_ms")).over(span),
    }).where(c("__c") == c("__home"))
    earlier = F.when(c("__n") >= 2, c("__f")).otherwise(
        F.when(c("__pt").isNotNull(), F.struct(c("__px").alias("x"), c("__py").alias("y"), c("__pt").alias("pts_ms"))))
    dt = (c("pts_ms") - earlier["pts_ms"]) / 1000.0
    vx, vy = (F.when(dt > 0, (c(a) - earlier[a]) / dt) for a in ("x", "y"))
    return framed.withColumns({
        "vx": vx, "vy": vy, "speed": F.sqrt(vx * vx + vy * vy),
        "samples": F.when(dt > 0, F.greatest(c("__n"), F.lit(2))),
    }).drop("__px", "__py", "__pt", "__home", "__c", "__n", "__f")


def fit_drift(
    anchors: DataFrame, *, min_span_s: float = clock.MIN_ANCHOR_SPAN_SECONDS, global_rate: float = clock.GLOBAL_DRIFT_RATE
) -> DataFrame:
    """Clock error per camera as a line over file position, and where the line comes from.

    With one anchor, or anchors too close together, the slope is borrowed and the line passes
    through the earliest position.
    """
    c = F.col
    order = F.struct("position_s", "measured_seq")
    fitted = anchors.groupBy("camera_id").agg(
        F.count("*").alias("anchor_count"), (F.max("position_s") - F.min("position_s")).alias("span_s"),
        F.regr_slope("offset_s", "position_s").alias("__b"), F.regr_intercept("offset_s", "position_s").alias("__a"),
        F.min_by(F.struct("position_s", "offset_s"), order).alias("__first"),
    )
    borrowed = (c("anchor_count") == 1) | (c("span_s") < min_span_s)
    models = fitted.select(
        "camera_id", "anchor_count", "span_s",
        F.when(c("anchor_count") == 1, "single_anchor").when(borrowed, "global_default").otherwise("fitted").alias("source"),
        F.when(borrowed, F.lit(global_rate)).otherwise(c("__b")).alias("drift_rate"),
        F.when(borrowed, c("__first.offset_s") - global_rate * c("__first.position_s")).otherwise(c("__a")).alias("offset_s"),
    )
    line = models.select("camera_id", F.col("offset_s").alias("__o"), F.col("drift_rate").alias("__r"))
    residuals = (
        anchors.join(line, "camera_id")
        .groupBy("camera_id").agg(F.max(F.abs(c("offset_s") - (c("__o") + c("__r") * c("position_s")))).alias("__res"))
    )
    return models.join(residuals, "camera_id", "left").select(
        *models.columns, F.when(c("source") == "fitted", c("__res")).alias("max_residual_s"))


def apply_clock(
    frames: DataFrame, drift: DataFrame, *, live: bool, epoch_ms: float = clock.RECORDING_EPOCH_MS,
    global_rate: float = clock.GLOBAL_DRIFT_RATE,
) -> DataFrame:
    """Add slot_time_ms and the drift-corrected recorded_ms.

    A recording's PTS is its slot position. A live frame's position comes from its absolute time;
    before an anchor exists its PTS stands in, and ``anchor_settled`` says so.
    """
    c = F.col
    own = c("pts_ms") / 1000.0
    position = F.coalesce(clock.slot_offset_seconds(c("absolute_ms")), own) if live else own
    models = drift.select("camera_id", c("offset_s").alias("__o"), c("drift_rate").alias("__r"), c("source").alias("drift_source"))
    placed = frames.withColumn("position_s", position).join(models, "camera_id", "left")
    return placed.withColumns({
        "slot_time_ms": clock.slot_time_ms(c("position_s"), epoch_ms),
        "recorded_ms": clock.recorded_at_ms(
            c("position_s"), F.coalesce("__o", F.lit(0.0)), F.coalesce("__r", F.lit(global_rate)), epoch_ms),
        "drift_source": F.coalesce("drift_source", F.lit("global_default")),
    }).drop("__o", "__r")
