"""Stateful streams over feeds: sampling, anchoring and segments per connection; tracks per camera.

Rows of one key arrive in order across micro-batches; each batch is sorted by sequence number. The
state of a key is a few numbers, or its open tracks, never its history.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kerbline.operators.frames import BURST_GUARD_MS, MAX_FORWARD_GAP_MS, SETTLE_MS
from kerbline.operators.tracks import IDLE_CLOSE_MS, VEHICLE_CLASSES

SAMPLED = (
    "camera_id string, connection_id string, segment bigint, seq bigint, pts_ms double, arrival_ms double, "
    "absolute_ms double, anchor_settled boolean, starts_segment boolean, emitted_at_seq bigint"
)
CLOSED_TRACK = (
    "camera_id string, tracker_id bigint, cls string, started_ms bigint, ended_ms bigint, frame_count bigint, is_vehicle boolean"
)
#: What a track is made of, and how many rows are turned into Python values at once.
DETECTED, SLICE_ROWS = ("camera_id", "seq", "recorded_ms", "tracker_id", "cls", "starts_segment"), 65_536


class Idle:
    """Which open tracks have been idle too long, without looking at the others.

    A heap has a time for every open track, at or before its last sight: a track is entered when it opens and
    when its time goes back; one that was seen since its entry is entered again when the entry comes up.
    """

    def __init__(self, idle_ms: float, tracks: Iterable[tuple]) -> None:
        self.idle_ms, self.entries = idle_ms, list(tracks)
        heapq.heapify(self.entries)

    def seen(self, at: int, tracker) -> None:
        heapq.heappush(self.entries, (at, tracker))

    def since(self, now: int, last_of: Callable) -> list:
        """Trackers last seen more than ``idle_ms`` before ``now``; ``last_of`` tells when, or None if closed."""
        found = {}
        while self.entries and now - self.entries[0][0] > self.idle_ms:
            _, tracker = heapq.heappop(self.entries)
            last = last_of(tracker)
            if last is None:
                continue
            if now - last > self.idle_ms:
                found[tracker] = None
            else:
                heapq.heappush(self.entries, (last, tracker))
        return list(found)


def sampled_frames(
    frames: DataFrame, interval_ms: float, *, max_forward_gap_ms: float = MAX_FORWARD_GAP_MS, settle_ms: float = SETTLE_MS,
    burst_guard_ms: float = BURST_GUARD_MS,
) -> DataFrame:
    """Frames on the PTS grid, with segment and absolute time. A break resets grid, anchor and last PTS together."""
    if not interval_ms > 0:
        raise ValueError("the PTS grid interval must be positive")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        if state.exists:
            segment, last, start, due, held, best, settled, fresh = json.loads(state.get[0])
        else:
            segment, last, start, due, held, best, settled, fresh = 0, None, None, None, None, None, False, True
        out = []
        for f in rows.itertuples(index=False):
            jumped = last is not None and (f.pts_ms < last or f.pts_ms - last > max_forward_gap_ms)
            if last is not None and (jumped or bool(f.scene_cut) or bool(f.clock_backwards)):
                segment, start, due, held, best, settled, fresh = segment + 1, None, None, None, None, False, True
            last = f.pts_ms
            start = f.arrival_ms if start is None else start
            since = f.arrival_ms - start
            if since >= burst_guard_ms:
                delay = f.arrival_ms - f.pts_ms
                best = delay if best is None else min(best, delay)
                settled = settled or since >= burst_guard_ms + settle_ms
            due = f.pts_ms if due is None else due
            now = [int(f.seq), f.pts_ms, f.arrival_ms]
            if f.pts_ms < due:
                held = now
                continue
            chosen = held if held is not None and abs(held[1] - due) < abs(now[1] - due) else now
            held = None
            due += interval_ms * max(1, math.floor((chosen[1] - due) / interval_ms) + 1)
            out.append((*key, segment, *chosen, None if best is None else best + chosen[1], settled and best is not None, fresh, now[0]))
            fresh = False
        state.update((json.dumps([segment, last, start, due, held, best, settled, fresh]),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SAMPLED.split(", ")])

    return frames.groupBy("camera_id", "connection_id").applyInPandasWithState(
        step, SAMPLED, "state string", "append", GroupStateTimeout.NoTimeout)


def closed_tracks(detections: DataFrame, idle_ms: float = IDLE_CLOSE_MS, departed_after_ms: int | None = None) -> DataFrame:
    """Tracks as they close: idle for longer than ``idle_ms`` on the camera's own clock, or cut by a new segment.

    A row without a tracker id is a frame with nothing in it; it still moves the clock. With
    ``departed_after_ms``, a camera that sends nothing for that long has its open tracks closed and its
    state dropped, by a timer that fires with the next micro-batch of any camera.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
        out = []

        def close(tracker: str) -> None:
            cls, first, last, n = opened.pop(tracker)
            out.append((key[0], int(tracker), cls, first, last, n, cls in VEHICLE_CLASSES))

        if state.hasTimedOut:
            for tracker in list(opened):
                close(tracker)
            state.remove()
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CLOSED_TRACK.split(", ")])
            return
        idle = Idle(idle_ms, ((track[2], tracker) for tracker, track in opened.items()))

        def end_frame() -> None:
            for tracker in idle.since(now, lambda k: opened[k][2] if k in opened else None):
                close(tracker)

        rows = pd.concat(list(batches)).dropna(subset="seq").sort_values("seq", kind="stable")
        frame = now = None
        for at in range(0, len(rows), SLICE_ROWS):
            part = rows.iloc[at:at + SLICE_ROWS]
            for seq, recorded_ms, tracker_id, cls, starts in zip(*(part[c].tolist() for c in DETECTED[1:])):
                if seq != frame:
                    if frame is not None:
                        end_frame()
                    frame, now = seq, int(recorded_ms)
                    if starts:
                        for tracker in list(opened):
                            close(tracker)
                if pd.isna(tracker_id):
                    continue
                tracker = str(int(tracker_id))
                track = opened.get(tracker)
                if track is None:
                    track = opened[tracker] = [cls, now, now, 0]
                    idle.seen(now, tracker)
                elif now < track[2]:
                    idle.seen(now, tracker)
                track[2], track[3] = now, track[3] + 1
        if frame is not None:
            end_frame()
        state.update((json.dumps(opened),))
        if departed_after_ms is not None:
            state.setTimeoutDuration(departed_after_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CLOSED_TRACK.split(", ")])

    timeout = GroupStateTimeout.NoTimeout if departed_after_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return detections.select(*DETECTED).groupBy("camera_id").applyInPandasWithState(step, CLOSED_TRACK, "state string", "append", timeout)


def tracks_to_end(detections: DataFrame, folder: str, idle_ms: float = IDLE_CLOSE_MS) -> DataFrame:
    """All tracks of a feed that ends: what ``closed_tracks`` emits, and the tracks still open after the last row.

    The feed is run to its end; then a closing row for every camera with state, read from the state store, goes
    through the same query, so every track is emitted once and by one path. Output and checkpoint lie in ``folder``;
    called again with it, a run goes on where it stopped. Rows that come after the end are a new feed.
    """
    spark, ends = detections.sparkSession, f"{folder}/ends"
    spark.createDataFrame([], detections.schema).write.mode("append").parquet(ends)
    closed = closed_tracks(detections.unionByName(spark.readStream.schema(detections.schema).parquet(ends)), idle_ms)

    def run() -> None:
        closed.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option(
            "path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()

    run()
    # In one batch with rows of its camera, the closing row is the last.
    said = {"seq": F.lit((1 << 63) - 1), "recorded_ms": F.lit(0), "starts_segment": F.lit(True), "camera_id": F.col("key.camera_id")}
    marks = [said.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in detections.schema.fields]
    spark.read.format("statestore").load(f"{folder}/checkpoint").select(*marks).write.mode("append").parquet(ends)
    run()
    return spark.read.schema(closed.schema).parquet(f"{folder}/out")
