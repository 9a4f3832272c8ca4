"""Stateful processors for feeds that arrive out of order and never end.

Each keeps its state in Spark's state store, per camera or per bucket of alerts, and bounds it: frames wait only for
their connection's watermark, tracks until they are idle, alerts until their time to live is over. A camera
that falls silent is closed by a timer. Needs the RocksDB state store (:func:`durable_state`).

What a row does depends on the rows that landed before it, never on how they were cut into micro-batches:
rows of a micro-batch are taken in the order they landed (``landed``, an offset or any number that grows
with it). A camera's rows of one micro-batch are held together, so its size bounds a task's memory.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kerbline.operators.alerts import FIRST, KEY, alert_id
from kerbline.operators.frames import BURST_GUARD_MS, MAX_FORWARD_GAP_MS, SETTLE_MS
from kerbline.operators.tracks import EARLY_SIGNATURE_FRAMES, IDLE_CLOSE_MS, MAX_CROPS, RESIGNATURE_EVERY, VEHICLE_CLASSES
from kerbline.streaming.stateful import Idle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How far a row may be behind the newest one of its connection, and a connection behind its camera.
DELAY_MS, OVER_AFTER_MS = 10_000, 600_000
#: A camera that sends nothing for this long, by the wall clock, is closed.
SILENT_AFTER_MS = 600_000


def durable_state(spark: SparkSession) -> None:
    """The state store that these processors need, for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _taken(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(order, kind="stable")


class _Timed(StatefulProcessor):
    """Renews one wall-clock timer per key with every micro-batch that has rows for it."""

    handle: StatefulProcessorHandle

    def renew(self, now_ms: int, after_ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(now_ms + after_ms)

    def close(self) -> None:
        pass


# ---- frames ----------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Sampling:
    interval_ms: float
    max_forward_gap_ms: float = MAX_FORWARD_GAP_MS
    settle_ms: float = SETTLE_MS
    burst_guard_ms: float = BURST_GUARD_MS
    delay_ms: float = DELAY_MS
    over_after_ms: float = OVER_AFTER_MS
    silent_after_ms: int = SILENT_AFTER_MS


@dataclass
class Walk:
    """One connection in order: segment, grid, anchor, the frame that waits; and the rows that wait for the watermark."""

    segment: int = 0
    last: float | None = None
    start: float | None = None
    due: float | None = None
    held: list | None = None
    best: float | None = None
    settled: bool = False
    fresh: bool = True
    frontier: float | None = None
    newest: float | None = None
    released: int | None = None
    waiting: list = field(default_factory=list)  # a heap by sequence number

    def lands(self, row: list, rule: Sampling) -> bool:
        """Whether ``row`` (seq, pts, arrival, breaks) is in time; then it waits for its turn."""
        if (self.frontier is not None and row[2] < self.frontier) or (self.released is not None and row[0] <= self.released):
            return False
        heapq.heappush(self.waiting, row)
        self.newest = row[2] if self.newest is None else max(self.newest, row[2])
        self.frontier = self.newest - rule.delay_ms
        return True

    def due_rows(self, everything: bool = False) -> Iterator[list]:
        while self.waiting and (everything or self.waiting[0][2] < self.frontier):
            row = heapq.heappop(self.waiting)
            self.released = row[0]
            yield row

    def step(self, rule: Sampling, seq: int, pts: float, arrival: float, breaks: bool) -> tuple[bool, tuple | None]:
        """(whether the feed broke here, the frame that is kept now)."""
        jumped = self.last is not None and (pts < self.last or pts - self.last > rule.max_forward_gap_ms)
        broke = self.last is not None and (jumped or breaks)
        if broke:
            self.segment += 1
            self.start = self.due = self.held = self.best = None
            self.settled, self.fresh = False, True
        self.last = pts
        self.start = arrival if self.start is None else self.start
        since = arrival - self.start
        if since >= rule.burst_guard_ms:
            self.best = arrival - pts if self.best is None else min(self.best, arrival - pts)
            self.settled = self.settled or since >= rule.burst_guard_ms + rule.settle_ms
        self.due = pts if self.due is None else self.due
        now = [seq, pts, arrival]
        if pts < self.due:
            self.held = now
            return broke, None
        chosen = self.held if self.held is not None and abs(self.held[1] - self.due) < abs(pts - self.due) else now
        self.held = None
        self.due += rule.interval_ms * max(1, math.floor((chosen[1] - self.due) / rule.interval_ms) + 1)
        kept = (*chosen, None if self.best is None else self.best + chosen[1], self.settled and self.best is not None, self.fresh, seq)
        self.fresh = False
        return broke, kept


FEED = (
    "kind string, camera_id string, connection_id string, segment bigint, seq bigint, pts_ms double, arrival_ms double, absolute_ms double, "
    "anchor_settled boolean, starts_segment boolean, emitted_at_seq bigint"
)
_FEED_COLUMNS = [c.split()[0] for c in FEED.split(", ")]


class FeedProcessor(_Timed):
    """A camera's feed: kept frames, loop and reconnect events and late rows, told apart by ``kind``."""

    def __init__(self, rule: Sampling) -> None:
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.camera = handle.getValueState("camera", "newest double")
        self.walks = handle.getMapState("walks", "connection_id string", "walk string")

    def _advance(self, camera: str, connection: str, walk: Walk, first: bool, everything: bool, out: list) -> None:
        for row in walk.due_rows(everything):
            if walk.last is None and not first:
                out.append(("camera.reconnect", camera, connection, walk.segment, row[0], row[1], row[2], None, None, None, None))
            broke, kept = walk.step(self.rule, *row)
            if broke:
                out.append(("camera.loop", camera, connection, walk.segment, row[0], row[1], row[2], None, None, None, None))
            if kept:
                out.append(("frame", camera, connection, walk.segment, *kept))

    def handleInputRows(self, key, rows, timerValues):
        out: list[tuple] = []
        newest = self.camera.get()[0] if self.camera.exists() else None
        walks = {k[0]: json.loads(v[0]) for k, v in self.walks.iterator()}
        known = {name: (Walk(**w["walk"]), w["first"]) for name, w in walks.items()}
        touched, over = set(), set()
        batch = _taken(rows, ["landed"])
        breaks = batch["scene_cut"].eq(True) | batch["clock_backwards"].eq(True)
        closes = batch["closes"].eq(True) if "closes" in batch else [False] * len(batch)
        for connection, seq, pts, arrival, broken, close in zip(
                batch["connection_id"], batch["seq"], batch["pts_ms"], batch["arrival_ms"], breaks, closes):
            if close:
                for name, (walk, first) in known.items():
                    self._advance(key[0], name, walk, first, True, out)
                    over.add(name)
                known, newest = {}, None
                continue
            late = newest is not None and arrival < newest - self.rule.over_after_ms
            if not late:
                if connection not in known:
                    known[connection] = (Walk(), newest is None)
                    over.discard(connection)
                walk, first = known[connection]
                late = not walk.lands([int(seq), float(pts), float(arrival), bool(broken)], self.rule)
            if late:
                out.append(("late", key[0], connection, None, int(seq), float(pts), float(arrival), None, None, None, None))
                continue
            touched.add(connection)
            self._advance(key[0], connection, walk, first, False, out)
            if newest is None or arrival > newest:
                newest = float(arrival)
                for name in [n for n, (w, _) in known.items() if w.newest < newest - self.rule.over_after_ms]:
                    walk, first = known.pop(name)  # the camera has gone on without this connection
                    self._advance(key[0], name, walk, first, True, out)
                    over.add(name)
        for name in over:
            if name in walks:
                self.walks.removeKey((name,))
        for name in touched & known.keys():
            walk, first = known[name]
            self.walks.updateValue((name,), (json.dumps({"walk": asdict(walk), "first": first}),))
        if newest is None:
            self.camera.clear()
        else:
            self.camera.update((newest,))
            self.renew(timerValues.getCurrentProcessingTimeInMs(), self.rule.silent_after_ms)
        yield pd.DataFrame(out, columns=_FEED_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out: list[tuple] = []
        for (name,), (text,) in list(self.walks.iterator()):
            w = json.loads(text)
            self._advance(key[0], name, Walk(**w["walk"]), w["first"], True, out)
        self.walks.clear()
        self.camera.clear()
        yield pd.DataFrame(out, columns=_FEED_COLUMNS)


def feed_events(frames: DataFrame, rule: Sampling) -> DataFrame:
    """One pass over a feed: rows of kind ``frame``, ``camera.loop``, ``camera.reconnect`` and ``late``.

    ``frames`` has camera_id, connection_id, seq, pts_ms, arrival_ms, scene_cut, clock_backwards, landed and,
    optionally, closes. A connection's watermark is its newest arrival less ``delay_ms``: rows below it are
    taken in order of their number, rows that land below it are late. Watermarks are per connection, as a
    camera with a slow uplink is not late because another is fast. A connection that its camera has left
    behind by ``over_after_ms``, a camera silent for ``silent_after_ms`` and a row that closes end the wait.
    """
    if not rule.interval_ms > 0:
        raise ValueError("the PTS grid interval must be positive")
    durable_state(frames.sparkSession)
    return frames.groupBy("camera_id").transformWithStateInPandas(FeedProcessor(rule), FEED, "Append", "ProcessingTime")


# ---- tracks and signatures -------------------------------------------------------------------------------

SIGNATURE = (
    "kind string, camera_id string, tracker_id bigint, cls string, started_ms bigint, recorded_ms bigint, frames_seen bigint, provisional boolean, "
    "embedding array<double>, crops array<bigint>"
)
_SIGNATURE_COLUMNS = [c.split()[0] for c in SIGNATURE.split(", ")]


@dataclass(frozen=True)
class Identification:
    idle_ms: float = IDLE_CLOSE_MS
    early_frames: int = EARLY_SIGNATURE_FRAMES
    again_every: int = RESIGNATURE_EVERY
    max_crops: int = MAX_CROPS
    silent_after_ms: int = SILENT_AFTER_MS


def _unit(v: list[float], least: float) -> list[float]:
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v] if norm > least else list(v)


class TrackProcessor(_Timed):
    """Open tracks of a camera, each identified while it is in view and once more when it closes.

    Per track: class of the first sight, times, frames, the sum of unit crop vectors and the largest crops.
    """

    def __init__(self, rule: Identification) -> None:
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracks = handle.getMapState("tracks", "tracker_id bigint", "track string")

    def _signature(self, camera: str, tracker: int, t: dict, provisional: bool) -> tuple:
        n = max(1, t["vectors"])
        mean = _unit([x / n for x in t["sum"]], 1e-6) if t["sum"] is not None else None
        crops = [number for _, _, number in sorted(t["crops"], key=lambda c: (-c[0], -c[1]))]
        return ("signature", camera, tracker, t["cls"], t["first"], t["last"], t["n"], provisional, mean, crops)

    def _closed(self, camera: str, tracker: int, t: dict, out: list) -> None:
        if t["cls"] in VEHICLE_CLASSES:
            out.append(self._signature(camera, tracker, t, False))
        out.append(("track", camera, tracker, t["cls"], t["first"], t["last"], t["n"], None, None, None))

    def _seen(self, t: dict, now: int, vector, area, number: int) -> None:
        t["last"], t["n"] = now, t["n"] + 1
        if vector is not None:
            v = _unit([float(x) for x in vector], 1e-6)
            t["sum"] = v if t["sum"] is None else [a + b for a, b in zip(t["sum"], v)]
            t["vectors"] += 1
        if area is not None and not pd.isna(area):
            crop = [float(area), -number, number]  # of equal areas the earlier one stays
            (heapq.heappush if len(t["crops"]) < self.rule.max_crops else heapq.heappushpop)(t["crops"], crop)

    def handleInputRows(self, key, rows, timerValues):
        out: list[tuple] = []
        stored = {k[0]: json.loads(v[0]) for k, v in self.tracks.iterator()}
        known, touched = dict(stored), set()
        batch = _taken(rows, ["seq"])
        for name in ("embedding", "area"):
            if name not in batch:
                batch[name] = None
        starts = batch["starts_segment"].eq(True)
        idle = Idle(self.rule.idle_ms, ((t["last"], tracker) for tracker, t in known.items()))
        at = 0
        columns = list(zip(batch["seq"], batch["recorded_ms"], batch["tracker_id"], batch["cls"], batch["embedding"], batch["area"], starts))
        while at < len(columns):
            end = at
            while end < len(columns) and columns[end][0] == columns[at][0]:
                end += 1
            frame, now = columns[at:end], int(columns[at][1])
            if any(row[6] for row in frame):
                for tracker in sorted(known):
                    self._closed(key[0], tracker, known[tracker], out)
                known = {}
            for seq, _, tracker, cls, vector, area, _ in frame:
                if tracker is None or pd.isna(tracker):
                    continue
                tracker = int(tracker)
                t = known.get(tracker)
                if t is None:
                    t = known[tracker] = {"cls": cls, "first": now, "last": now, "n": 0, "sum": None, "vectors": 0, "crops": []}
                    idle.seen(now, tracker)
                elif now < t["last"]:
                    idle.seen(now, tracker)
                self._seen(t, now, vector, area, int(seq))
                touched.add(tracker)
                if cls_due(t, self.rule):
                    out.append(self._signature(key[0], tracker, t, True))
            for tracker in idle.since(now, lambda k: known[k]["last"] if k in known else None):
                self._closed(key[0], tracker, known.pop(tracker), out)
            at = end
        for tracker in stored.keys() - known.keys():
            self.tracks.removeKey((tracker,))
        for tracker in touched & known.keys():
            self.tracks.updateValue((tracker,), (json.dumps(known[tracker]),))
        self.renew(timerValues.getCurrentProcessingTimeInMs(), self.rule.silent_after_ms)
        yield pd.DataFrame(out, columns=_SIGNATURE_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out: list[tuple] = []
        for (tracker,), (text,) in sorted(self.tracks.iterator()):
            self._closed(key[0], tracker, json.loads(text), out)
        self.tracks.clear()
        yield pd.DataFrame(out, columns=_SIGNATURE_COLUMNS)


def cls_due(t: dict, rule: Identification) -> bool:
    """Whether a vehicle is identified at this sight: early, and every so often after."""
    return t["cls"] in VEHICLE_CLASSES and t["n"] >= rule.early_frames and (t["n"] - rule.early_frames) % rule.again_every == 0


def live_signatures(detections: DataFrame, rule: Identification = Identification()) -> DataFrame:
    """Rows of kind ``signature`` while a vehicle is in view and at its close, and ``track`` for every closed track.

    ``detections`` has camera_id, seq, recorded_ms, tracker_id, cls, starts_segment and, optionally, embedding
    (a vector per crop) and area. A row without a tracker is a frame with nothing in it; it still moves the
    clock. Tracks close when idle, at a new segment, and when their camera falls silent.
    """
    durable_state(detections.sparkSession)
    return detections.groupBy("camera_id").transformWithStateInPandas(TrackProcessor(rule), SIGNATURE, "Append", "ProcessingTime")


# ---- alerts ----------------------------------------------------------------------------------------------

ALERT_TTL_MS = 24 * 3_600_000
ALERT = (
    "track_id string, entry_id string, solo string, first_order bigint, source string, priority string, camera_id string, recorded_ms bigint, "
    "pipeline_latency_ms bigint, confidence double, matched_via string, repaired boolean, last_seen_ms bigint, last_order bigint, sightings bigint, change string"
)
_ALERT_COLUMNS = [c.split()[0] for c in ALERT.split(", ")]
_KEPT = _ALERT_COLUMNS[3:-1]


#: What the alerts of a feed are dealt over: state is read and written, and Python called, once per bucket and micro-batch.
BUCKETS = 1024
_SIGHTING = {"track_id": "string", "entry_id": "string", "solo": "string", "seq": "bigint", "confidence": "double", "matched_via": "string",
             "repaired": "boolean", "source": "string", "priority": "string", "camera_id": "string", "recorded_ms": "bigint", "pipeline_latency_ms": "bigint"}


class AlertProcessor(StatefulProcessor):
    """One alert per (track, entry), raised by its first sighting and only ever lifted by later ones.

    A key of the state is a bucket of alerts, held as one text. An alert in it lives for ``ttl_ms`` after its last
    sighting, and the bucket as long as its youngest. Whether an alert is new or updated follows from that.
    """

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.alerts = handle.getValueState("alerts", "alerts string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs()
        stored = json.loads(self.alerts.get()[0]) if self.alerts.exists() else []
        known = {tuple(name): (at, a) for name, at, a in stored if at + self.ttl_ms > now}
        changes: dict[tuple, str] = {}
        alert = Row(*_ALERT_COLUMNS)
        # By order, in every alert of the bucket; one without an order comes last.
        for _, *name, seq, confidence, matched_via, repaired, source, priority, camera, recorded, latency in sorted(rows, key=lambda r: (r[4] is None, r[4])):
            name = tuple(name)
            a = known[name][1] if name in known else None
            if name not in changes:
                changes[name] = "alert" if a is None else "alert.updated"
            if a is None:
                a = {"first_order": seq, "source": source, "priority": priority, "camera_id": camera, "recorded_ms": recorded, "pipeline_latency_ms": latency,
                     "confidence": confidence, "matched_via": matched_via, "repaired": repaired, "last_seen_ms": None, "last_order": seq, "sightings": 0}
            elif confidence is not None and (a["confidence"] is None or confidence > a["confidence"]):
                a.update(confidence=confidence, matched_via=matched_via, repaired=repaired)
            a["sightings"] += 1
            if a["sightings"] > 1:
                a.update(last_seen_ms=recorded, last_order=seq)
            known[name] = now, a
        self.alerts.update((json.dumps([(name, *held) for name, held in known.items()]),))
        for name, change in changes.items():
            a = known[name][1]
            yield alert(*name, *[a[c] for c in _KEPT], change)

    def close(self) -> None:
        pass


def live_alerts(sightings: DataFrame, order: str = "seq", ttl_ms: int = ALERT_TTL_MS, buckets: int = BUCKETS) -> DataFrame:
    """New and updated alerts per micro-batch, with state that expires. Rows of one alert come in order of ``order``.

    After its state is gone, a further sighting looks like a new alert; :func:`kept_whole` makes it an update.
    A task holds the sightings that a bucket gets in one micro-batch and its living alerts. ``buckets`` stays the
    same for the life of a checkpoint.
    """
    durable_state(sightings.sparkSession)
    keyless = F.col("track_id").isNull() | F.col("entry_id").isNull()
    # A null in the key would cut its rows into groups of one.
    rows = sightings.withColumns({"seq": F.col(order).cast("bigint"), "solo": F.when(keyless, F.col(order).cast("string")).otherwise("")})
    dealt = rows.select(F.pmod(F.xxhash64(*KEY, "solo"), F.lit(buckets)).alias("bucket"), *[F.col(c).cast(kind) for c, kind in _SIGHTING.items()])
    out = dealt.groupBy("bucket").transformWithState(AlertProcessor(ttl_ms), ALERT, "Update", "ProcessingTime")
    return out.withColumn("alert_id", alert_id(F.col("track_id"), F.col("entry_id"), F.col("solo"))).drop("solo")


def kept_whole(batch: DataFrame, table: DataFrame | None) -> DataFrame:
    """``batch`` with every alert joined to what ``table`` knows from before its state began.

    The cold path: what state has forgotten is in the alert table. ``since_order`` says where the state behind a row
    began, ``before`` what the alert was until then; a later row of the same state takes ``before`` over.
    """
    rows = batch.withColumn("since_order", F.col("first_order"))
    known = F.lit(None).cast(batch.select(F.struct(*_KEPT).alias("k")).schema["k"].dataType)
    if table is None:
        return rows.withColumn("before", known)
    old = table.select("alert_id", F.struct("since_order", "before", F.struct(*_KEPT).alias("whole")).alias("old"))
    seen = rows.join(old.join(rows.select("alert_id"), "alert_id", "left_semi"), "alert_id", "left")
    seen = seen.withColumn("before", F.when(F.col("old.since_order") == F.col("since_order"), F.col("old.before")).otherwise(F.col("old.whole")))
    better = F.col("confidence") > F.col("before.confidence")
    merged = {c: F.col(f"before.{c}") for c in ("first_order", *FIRST)}
    merged |= {c: F.when(better, F.col(c)).otherwise(F.col(f"before.{c}")) for c in ("confidence", "matched_via", "repaired")}
    # The state's first sighting is a later one of the alert: it has been seen again, if only once.
    merged |= {"last_seen_ms": F.coalesce("last_seen_ms", "recorded_ms"), "sightings": F.col("sightings") + F.col("before.sightings"), "change": F.lit("alert.updated")}
    back = F.col("before").isNotNull()
    return seen.select(*[F.when(back, merged[c]).otherwise(F.col(c)).alias(c) if c in merged else F.col(c) for c in (*rows.columns, "before")])
