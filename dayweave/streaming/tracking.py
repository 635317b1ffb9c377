"""Online tracking and windowing: state per camera and per track.

A camera's tracker lives in typed state variables, one row a track, which event-time timers clear when the camera falls silent; such state
needs the RocksDB store, which `typed_state` asks for while a query starts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dayweave.operators.tracks import BOX, Tracker

TRACKED_BOX = "camera long, frame_idx long, x1 double, y1 double, x2 double, y2 double, confidence double, track_id long, confirmed boolean"
WINDOW = "track_id long, start_frame long, end_frame long, n_rows int"


def timed(rows: DataFrame) -> tuple[DataFrame, str]:
    """rows with row_at_ms (milliseconds) where they have an event_time, which carries a watermark, and the timeout that state then has. By
    event time, so that a replay expires the same state; without a watermark nothing can."""
    if "event_time" in rows.columns:
        return rows.withColumn("row_at_ms", F.unix_millis(F.col("event_time").cast("timestamp"))), GroupStateTimeout.EventTimeTimeout
    return rows, GroupStateTimeout.NoTimeout


def expire(state: GroupState, pdf: pd.DataFrame, idle_ms: int) -> None:
    """Has the state time out once the watermark is idle_ms beyond the latest row."""
    if "row_at_ms" in pdf:
        state.setTimeoutTimestamp(max(int(pdf["row_at_ms"].max()), state.getCurrentWatermarkMs()) + idle_ms)


#: One row a track: identity, last box, velocity, how often it was met and how many frames ago.
TRACK_STATE = "id long, x1 double, y1 double, x2 double, y2 double, vx double, vy double, hits int, age int"


@contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start within it keep their state in RocksDB, as state variables and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class CameraTracker(StatefulProcessor):
    """The tracker of one camera. State: the last frame and the next id; the live tracks. Where rows have an event time, one timer stands
    idle_ms after the camera's latest row and clears both; without, both go ttl_ms after their last update, if that is given."""

    def __init__(self, idle_ms: int, ttl_ms: int | None, settings: dict):
        self.idle_ms, self.ttl_ms, self.settings = idle_ms, ttl_ms, settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.camera = handle.getValueState("camera", "last_frame long, next_id long", self.ttl_ms)
        self.tracks = handle.getListState("tracks", TRACK_STATE, self.ttl_ms)

    def _load(self) -> tuple[Tracker, int | None]:
        tracker, last = Tracker(**self.settings), None
        if self.camera.exists():
            last, tracker.next_id = map(int, self.camera.get())
            tracker.tracks = [{"id": int(t[0]), "box": np.array(t[1:5], float), "velocity": np.array(t[5:7], float), "hits": int(t[7]), "age": int(t[8])} for t in self.tracks.get()]
        return tracker, last

    def _save(self, tracker: Tracker, last: int) -> None:
        self.camera.update((last, tracker.next_id))
        rows = [(t["id"], *map(float, t["box"]), *map(float, t["velocity"]), t["hits"], t["age"]) for t in tracker.tracks]
        self.tracks.put(rows) if rows else self.tracks.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tracker, last = self._load()
        pdf = pd.concat(list(rows)).sort_values(["frame_idx", *BOX], kind="stable")
        late = last if last is not None else pdf["frame_idx"].min() - 1
        part = pdf[pdf["frame_idx"] > late]
        if len(part):
            ids, sure = tracker.follow(part["frame_idx"].to_numpy(), part[list(BOX)].to_numpy(float), part["confidence"].to_numpy(float), last)
            last = int(part["frame_idx"].iloc[-1])
            part = part.assign(track_id=ids, confirmed=sure)[ids >= 0]
        if last is not None:
            self._save(tracker, last)
        if "row_at_ms" in pdf:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(int(pdf["row_at_ms"].max()), timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        if len(part):
            yield part[[f.split()[0] for f in TRACKED_BOX.split(", ")]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.camera.clear()
        self.tracks.clear()
        return iter(())

    def close(self) -> None:
        pass


def track_stream(detections: DataFrame, idle_ms: int = 3_600_000, ttl_ms: int | None = None, **settings) -> DataFrame:
    """detections (camera, frame_idx, box, confidence) with track ids; ages count frames without boxes. Start it within typed_state.

    Frames that arrive behind the camera's last frame are dropped: association cannot be undone. Once the watermark of event_time, if rows
    have it, is idle_ms beyond a camera's latest row, its state goes and ids begin anew.
    """
    rows, _ = timed(detections)
    by_event = "row_at_ms" in rows.columns
    if by_event and ttl_ms is not None:
        raise ValueError("state expires by event time here; a time to live counts the clock's time")
    mode = "EventTime" if by_event else "ProcessingTime" if ttl_ms is not None else "None"
    return rows.groupBy("camera").transformWithStateInPandas(CameraTracker(idle_ms, ttl_ms, settings), TRACKED_BOX, "Append", mode)


def window_stream(rows: DataFrame, length: int = 30, stride: int = 15, most_gap: int = 5, idle_ms: int = 3_600_000) -> DataFrame:
    """Windows over usable rows (track_id, frame_idx, usable) as they fill up; a gap of frames starts over. State: at most `length` frames,
    which go once the watermark of event_time, if rows have it, is idle_ms beyond the track's latest row."""

    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, last = json.loads(state.get[0]) if state.exists else ([], None)
        out = []
        pdf = pd.concat(list(pdfs))
        for frame, usable in pdf.sort_values("frame_idx")[["frame_idx", "usable"]].itertuples(index=False):
            if last is not None and frame <= last:
                continue
            if last is not None and frame - last > most_gap:
                held = []
            last = int(frame)
            if usable:
                held.append(last)
            if len(held) == length:
                out.append((key[0], held[0], held[-1], length))
                held = held[stride:]
        state.update((json.dumps([held, last]),))
        expire(state, pdf, idle_ms)
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in WINDOW.split(", ")])

    rows, timeout = timed(rows)
    return rows.groupBy("track_id").applyInPandasWithState(run, WINDOW, "saved string", "append", timeout)
