"""Stateful streams: overlap tracking and the stride throttle.

Rows wait in state until the watermark has passed their slot of time and are then
taken in frame order, so late arrivals inside the watermark change nothing. Event
time must grow with the frame number of a key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

import trackspark
from trackspark.operators.tracking import BOX, LiveTracks, frames_of

TRACK_OUT = "source_id string, shot_id string, frame_index bigint, det_index int, tracklet_id string"
THROTTLE_OUT = "tracklet_id string, frame_index bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """Stateful processors need the RocksDB store, and a planning process that gets no Python files."""
    cloudpickle.register_pickle_by_value(trackspark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _InOrder(StatefulProcessor):
    """Holds rows in slots of event time and hands over a slot, in frame order, once the watermark has passed its end.

    A slot is one entry of a map state with one timer, so a trigger reads and writes the slots its rows fall into and those
    that end, never the rest of what waits. Rows older than the watermark never arrive here, so an ended slot stays ended;
    timers of a key expire in time order.
    """

    waiting_schema = ""
    waiting_columns: list[str] = []
    slot_ms = 2_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [f.split() for f in self.waiting_schema.split(", ")]
        held = ", ".join(f"{name} array<{kind}>" for name, kind in fields)
        self.waiting = handle.getMapState("waiting", "slot bigint", held)
        self.open_state(handle)

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def take(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues):
        fresh: dict[int, list[tuple]] = {}
        for batch in rows:
            at = batch.ts.astype("int64") // (10 ** 6 if str(batch.ts.dtype).startswith("datetime64[ns") else 10 ** 3)
            for slot, *row in zip(at // self.slot_ms, *[batch[c].tolist() for c in self.waiting_columns]):
                fresh.setdefault(int(slot), []).append(tuple(row))
        for slot, new in sorted(fresh.items()):
            columns = [list(c) for c in zip(*new)]
            if self.waiting.containsKey((slot,)):
                columns = [[*old, *c] for old, c in zip(self.waiting.getValue((slot,)), columns)]
            else:
                self.handle.registerTimer((slot + 1) * self.slot_ms)
            self.waiting.updateValue((slot,), tuple(columns))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        slot = expiredTimerInfo.getExpiryTimeInMs() // self.slot_ms - 1
        held = self.waiting.getValue((slot,))
        self.waiting.removeKey((slot,))
        out = self.take(key, pd.DataFrame(dict(zip(self.waiting_columns, held))))
        if len(out):
            yield out

    def close(self) -> None:
        pass


class OverlapTracking(_InOrder):
    """The batch tracker with its live tracks in state."""

    waiting_schema = "frame_index bigint, det_index int, x1 double, y1 double, x2 double, y2 double"
    waiting_columns = ["frame_index", "det_index", *BOX]

    def __init__(self, lost_track_buffer: int = 30, iou_threshold: float = 0.2) -> None:
        self.buffer, self.threshold = lost_track_buffer, iou_threshold

    def open_state(self, handle) -> None:
        self.live = handle.getListState("live", "f bigint, d int, x1 double, y1 double, x2 double, y2 double, no bigint")
        self.count = handle.getValueState("count", "n bigint")

    def take(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        held = [tuple(r) for r in self.live.get()] if self.live.exists() else []
        tracks = LiveTracks(self.buffer, self.threshold, [r[:6] for r in held])
        tracks.label = [r[6] for r in held]
        made = self.count.get()[0] if self.count.exists() else 0
        out = []
        for frame, numbers, boxes in frames_of(rows):
            taken = tracks.step(frame, numbers, boxes)
            for d, t in enumerate(taken):
                if tracks.label[t] is None:
                    made += 1
                    tracks.label[t] = made
                out.append((key[0], key[1], frame, numbers[d], f"{key[1]}:t{tracks.label[t]}"))
            tracks.commit(frame, numbers, boxes, taken)
        state = [(*s, n) for s, n in zip(tracks.state(), tracks.label)]
        self.live.clear()
        if state:
            self.live.put([tuple(x.item() if isinstance(x, np.generic) else x for x in s) for s in state])
        self.count.update((made,))
        return pd.DataFrame(out, columns=["source_id", "shot_id", "frame_index", "det_index", "tracklet_id"])


class StrideThrottle(_InOrder):
    """Keeps a row only ``stride`` or more frames after the last kept one."""

    waiting_schema = "frame_index bigint"
    waiting_columns = ["frame_index"]

    def __init__(self, stride: int) -> None:
        self.stride = stride

    def open_state(self, handle) -> None:
        self.free = handle.getValueState("free", "frame bigint")

    def take(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        free = self.free.get()[0] if self.free.exists() else 0
        kept = []
        for frame in sorted(set(rows.frame_index)):
            if frame >= free:
                kept.append((key[0], int(frame)))
                free = int(frame) + self.stride
        self.free.update((free,))
        return pd.DataFrame(kept, columns=["tracklet_id", "frame_index"])


def track_stream(detections: DataFrame, delay: str = "10 seconds", lost_track_buffer: int = 30, iou_threshold: float = 0.2) -> DataFrame:
    """Streaming tracker; detections(source_id, shot_id, frame_index, det_index, x1..y2, ts)."""
    use_rocksdb(detections.sparkSession)
    return detections.withWatermark("ts", delay).groupBy("source_id", "shot_id").transformWithStateInPandas(
        OverlapTracking(lost_track_buffer, iou_threshold), TRACK_OUT, "Append", "EventTime"
    )


def throttle_stream(rows: DataFrame, stride: int, delay: str = "10 seconds") -> DataFrame:
    """Streaming throttle; rows(tracklet_id, frame_index, ts)."""
    use_rocksdb(rows.sparkSession)
    return rows.withWatermark("ts", delay).groupBy("tracklet_id").transformWithStateInPandas(StrideThrottle(stride), THROTTLE_OUT, "Append", "EventTime")
