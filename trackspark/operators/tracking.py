"""Greedy overlap tracking of one shot, split into blocks of frames that run side by side."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.scale import frame_bucket, spread
from trackspark.session import cut_lineage

SHOT = ["source_id", "shot_id"]
BOX = ["x1", "y1", "x2", "y2"]
BLOCK_FRAMES = 4096
#: Pairs of tracks and detections up to which plain numbers beat arrays.
FEW_PAIRS = 150


class LiveTracks:
    """Tracks still waiting for a detection, in creation order.

    A track is its last detection (frame, detection number) and box. Age is
    counted in frames, so frames without a detection need no rows.
    """

    def __init__(self, buffer: int, threshold: float, state: list | None = None) -> None:
        self.buffer, self.threshold = buffer, threshold
        self.last: list[tuple[int, int]] = [(int(t[0]), int(t[1])) for t in state or []]
        self.boxes: list[tuple[float, ...]] = [tuple(float(x) for x in t[2:6]) for t in state or []]
        self.label: list[Any] = list(self.last)  # whoever uses the tracks may keep a label on each
        self.inherited = len(self.last)
        self.tied = False

    def state(self) -> list[tuple]:
        return [(*key, *box) for key, box in zip(self.last, self.boxes)]

    def expire(self, frame: int) -> None:
        """Drop tracks that were lost for more than the buffer before ``frame``."""
        keep = [i for i, key in enumerate(self.last) if frame - key[0] <= self.buffer + 1]
        if len(keep) < len(self.last):
            self.inherited = sum(1 for i in keep if i < self.inherited)
            self.last, self.boxes, self.label = [self.last[i] for i in keep], [self.boxes[i] for i in keep], [self.label[i] for i in keep]

    def _overlaps(self, boxes: list[tuple]) -> list[tuple[float, int, int]]:
        """(minus overlap, track, detection) of the pairs that reach the threshold, best first."""
        a = np.asarray(self.boxes)[:, None, :]
        b = np.asarray(boxes, float)[None, :, :]
        width = np.clip(np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0]), 0, None)
        height = np.clip(np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1]), 0, None)
        shared = width * height
        area = lambda c: np.clip(c[..., 2] - c[..., 0], 0, None) * np.clip(c[..., 3] - c[..., 1], 0, None)
        union = area(a) + area(b) - shared
        overlap = np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)
        tracks, dets = np.nonzero(overlap >= self.threshold)
        return sorted(zip((-overlap[tracks, dets]).tolist(), tracks.tolist(), dets.tolist()))

    def _overlaps_of_few(self, boxes: list[tuple]) -> list[tuple[float, int, int]]:
        """The same numbers without arrays, which cost more than a few pairs. Not for a threshold that boxes apart reach."""
        clipped = lambda x: 0.0 if x < 0 else x  # a NaN stays one
        areas = [clipped(x2 - x1) * clipped(y2 - y1) for x1, y1, x2, y2 in boxes]
        out = []
        for t, (ax1, ay1, ax2, ay2) in enumerate(self.boxes):
            area = clipped(ax2 - ax1) * clipped(ay2 - ay1)
            for d, (bx1, by1, bx2, by2) in enumerate(boxes):
                if ax2 <= bx1 or bx2 <= ax1:
                    continue
                width = (ax2 if ax2 < bx2 else bx2) - (ax1 if ax1 > bx1 else bx1)
                if width <= 0:
                    continue
                height = (ay2 if ay2 < by2 else by2) - (ay1 if ay1 > by1 else by1)
                if height <= 0:
                    continue
                shared = width * height
                union = area + areas[d] - shared
                if union > 0 and shared / union >= self.threshold:
                    out.append((-(shared / union), t, d))
        out.sort()
        return out

    def _order_matters(self, scored: list[tuple[float, int, int]]) -> bool:
        """Whether two inherited tracks overlap one detection equally: only then does their order decide anything."""
        for low, (one, two) in enumerate(zip(scored, scored[1:])):
            if one[0] == two[0] and two[1] < self.inherited:
                for other in scored[low + 1:]:
                    if other[0] != one[0]:
                        break
                    if other[2] == one[2] and other[1] != one[1] and max(one[1], other[1]) < self.inherited:
                        return True
        return False

    def step(self, frame: int, numbers: list[int], boxes: list[tuple]) -> list[int]:
        """Assign the detections of one frame; returns the track index of each (new tracks at the end)."""
        self.expire(frame)
        taken = [-1] * len(numbers)
        if self.last and len(numbers):
            if 0 < self.threshold and len(self.last) * len(numbers) <= FEW_PAIRS:
                scored = self._overlaps_of_few(boxes)
            else:
                scored = self._overlaps(boxes)
            if len(scored) > 1 and not self.tied:
                self.tied = self._order_matters(scored)
            used: set[int] = set()
            for _, t, d in scored:
                if t in used or taken[d] >= 0:
                    continue
                used.add(t)
                taken[d] = t
        for d, number in enumerate(numbers):
            if taken[d] < 0:
                taken[d] = len(self.last)
                self.last.append((frame, number))
                self.boxes.append(tuple(boxes[d]))
                self.label.append(None)
        return taken

    def commit(self, frame: int, numbers: list[int], boxes: list[tuple], taken: list[int]) -> None:
        for d, t in enumerate(taken):
            self.last[t], self.boxes[t] = (frame, numbers[d]), tuple(boxes[d])


def frames_of(pdf: pd.DataFrame) -> Iterator[tuple[int, list[int], list[tuple]]]:
    """(frame, detection numbers, boxes) in frame order."""
    pdf = pdf.sort_values(["frame_index", "det_index"])
    frames = pdf.frame_index.to_numpy()
    numbers = pdf.det_index.astype("int64").tolist()
    boxes = list(zip(*[pdf[c].astype(float).tolist() for c in BOX]))
    cuts = (np.flatnonzero(np.diff(frames)) + 1).tolist()
    for low, high in zip([0, *cuts], [*cuts, len(frames)]):
        if high > low:
            yield int(frames[low]), numbers[low:high], boxes[low:high]


_STATE = "array<struct<f:bigint,d:int,x1:double,y1:double,x2:double,y2:double,no:int>>"
#: One row a block. ``no`` and ``local`` number the tracks of a block: those it entered with, then its own in order of creation.
_BLOCK = (
    f"source_id string, shot_id string, block bigint, first_frame bigint, entry {_STATE}, leaving {_STATE}, tied boolean, "
    "frames array<bigint>, dets array<int>, local array<int>, piece_frame array<bigint>"
)
_CHAIN = f"source_id string, shot_id string, block bigint, turn int, alive {_STATE}, entry_no array<bigint>, made_before bigint"
_NAMES = ["source_id", "shot_id", "block", "first_frame", "entry", "leaving", "tied", "frames", "dets", "local", "piece_frame"]


def _as_state(rows: list[tuple], numbers: list[int]) -> list[dict]:
    return [dict(zip(("f", "d", *BOX, "no"), (*row, no))) for row, no in zip(rows, numbers)]


def _from_state(value: Any) -> list[tuple]:
    return [tuple(t[k] for k in ("f", "d", *BOX)) for t in (value if value is not None else [])]


def _walk_block(pdf: pd.DataFrame, live: LiveTracks) -> pd.DataFrame:
    """Own frames of a block from a given set of live tracks."""
    head = (pdf.source_id.iloc[0], pdf.shot_id.iloc[0], int(pdf.block.iloc[0]))
    first = int(pdf.frame_index.min())
    live.expire(first)
    made = len(live.last)
    entry = _as_state(live.state(), list(range(made)))
    live.inherited, live.tied = made, False
    live.label = list(range(made))
    frames, dets, local, begun = [], [], [], []
    for frame, numbers, boxes in frames_of(pdf):
        taken = live.step(frame, numbers, boxes)
        for t in taken:
            if live.label[t] is None:
                live.label[t] = made
                made += 1
                begun.append(frame)
            local.append(live.label[t])
        frames.extend([frame] * len(numbers))
        dets.extend(numbers)
        live.commit(frame, numbers, boxes, taken)
    leaving = _as_state(live.state(), live.label)
    lists = [np.array(frames, "int64"), np.array(dets, "int32"), np.array(local, "int32"), np.array(begun, "int64")]
    return pd.DataFrame([(*head, first, entry, leaving, live.tied, *lists)], columns=_NAMES)


def _first_run(buffer: int, threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        warm, own = pdf[pdf.warm], pdf[~pdf.warm]
        if own.empty:
            return pd.DataFrame(columns=_NAMES)
        live = LiveTracks(buffer, threshold)
        for frame, numbers, boxes in frames_of(warm):
            taken = live.step(frame, numbers, boxes)
            live.commit(frame, numbers, boxes, taken)
        return _walk_block(own, live)

    return run


def _rerun(buffer: int, threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _walk_block(pdf, LiveTracks(buffer, threshold, _from_state(pdf.alive.iloc[0])))

    return run


def _chain(buffer: int):
    """The blocks of a shot in order, without their frames: which of them began with other tracks than their predecessor left.

    Tracks are numbered through the shot on the way. A track is named by its last detection, so equal names are equal tracks.
    Where a block met a tie, its tracks must also have been in order of creation; that order is only known as long as no
    earlier block of the shot is wrong.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, before, made, sure = [], [], 0, True
        for row in pdf.sort_values("block").itertuples(index=False):
            alive = [(t, no) for t, no in before if row.first_frame - t["f"] <= buffer + 1]
            if sure:
                alive.sort(key=lambda e: e[1])
            names = [(t["f"], t["d"]) for t, _ in alive]
            guess = [(t["f"], t["d"]) for t in row.entry]
            wrong = sorted(names) != sorted(guess) or (sure and row.tied and names != guess)
            number = dict(zip(names, (no for _, no in alive)))
            entry_no = [number.get(name, 0) for name in guess]
            out.append((row.source_id, row.shot_id, row.block, row.turn, [t for t, _ in alive] if wrong else None, entry_no, made))
            sure = sure and not wrong
            before = [(t, entry_no[t["no"]] if t["no"] < len(guess) else made + t["no"] - len(guess) + 1) for t in row.leaving]
            made += row.made
        return pd.DataFrame(out, columns=[part.split()[0] for part in _CHAIN.split(", ")])

    return run


def track_shots(
    detections: DataFrame, lost_track_buffer: int = 30, iou_threshold: float = 0.2, block_frames: int = BLOCK_FRAMES, max_rounds: int = 10_000
) -> DataFrame:
    """Greedy overlap tracker per shot with ids ``shot:tN`` in order of creation.

    The tracker is sequential, but what a block of frames needs from the past
    is only the set of live tracks. Every block first guesses that set from the
    frames just before it and all blocks run at once. A block whose guess
    differs from what its predecessor really left is run again from the real
    set; blocks whose guess holds are final. Creation order only decides which
    of two tracks gets a detection that both overlap equally, so only blocks
    that met such a tie are checked against the real order. The result equals one pass over the whole shot, while no task ever
    holds more than one block.

    detections(source_id, shot_id, frame_index, det_index, x1, y1, x2, y2, ..)
    """
    warm_frames = min(block_frames, 4 * (lost_track_buffer + 1))
    detections = cut_lineage(detections.withColumn("det_index", F.col("det_index").cast("int")))  # every round and the last join read them
    core = detections.select(*SHOT, "frame_index", "det_index", *BOX)
    home = core.withColumn("block", frame_bucket("frame_index", block_frames))
    ahead = home.withColumn("block", F.col("block") + 1).filter(F.col("frame_index") >= F.col("block") * block_frames - warm_frames)
    both = home.withColumn("warm", F.lit(False)).unionByName(ahead.withColumn("warm", F.lit(True)))
    key = [*SHOT, "block"]
    done = cut_lineage(spread(both, *key).groupBy(*key).applyInPandas(_first_run(lost_track_buffer, iou_threshold), _BLOCK).withColumn("turn", F.lit(0)))
    # a round reads one row a block, reruns the wrong blocks and writes those alone; earlier versions stay where they are
    for turn in range(1, max_rounds):
        fields = F.struct("first_frame", "entry", "leaving", "tied", F.size("piece_frame").alias("made"))
        latest = done.groupBy(*key).agg(F.max_by(fields, "turn").alias("h"), F.max("turn").alias("turn")).select(*key, "turn", "h.*")
        chain = cut_lineage(latest.groupBy(*SHOT).applyInPandas(_chain(lost_track_buffer), _CHAIN))
        wrong = chain.filter("alive is not null").select(*key, "alive")
        if wrong.isEmpty():
            return _number_tracks(done, chain, detections)
        again = spread(home.join(wrong, key), *key).groupBy(*key).applyInPandas(_rerun(lost_track_buffer, iou_threshold), _BLOCK)
        done = done.unionByName(cut_lineage(again.withColumn("turn", F.lit(turn))))
    raise RuntimeError("blocks did not settle")


def _number_tracks(done: DataFrame, chain: DataFrame, detections: DataFrame) -> DataFrame:
    """Number the tracks of a shot by their first detection and put the ids on the detections."""
    final = done.join(chain.select(*SHOT, "block", "turn", "entry_no", "made_before"), [*SHOT, "block", "turn"])
    rows = final.select(*SHOT, "entry_no", "made_before", F.explode(F.arrays_zip("frames", "dets", "local")).alias("_d"))
    known = F.size("entry_no")
    number = F.when(F.col("_d.local") < known, F.get("entry_no", F.col("_d.local"))).otherwise(F.col("made_before") + F.col("_d.local") - known + 1)
    assigned = rows.select(*SHOT, F.col("_d.frames").alias("frame_index"), F.col("_d.dets").alias("det_index"), F.concat_ws(":t", "shot_id", number.cast("string")).alias("tracklet_id"))
    return detections.join(assigned, [*SHOT, "frame_index", "det_index"])


# --- plug-ins --------------------------------------------------------------

class Tracker(Protocol):
    """A tracker plug-in: sees the frames of one shot in order.

    One that also has ``update_many`` is given runs of whole frames of a shot instead and answers what ``update`` would
    frame by frame; a table a frame costs more than most trackers.
    """

    def reset(self, shot_id: str) -> None: ...

    def update(self, frame: pd.DataFrame) -> pd.DataFrame:
        """Rows of one frame (frame_index, det_index, x1..y2, score) to rows (tracklet_id, frame_index, det_index)."""
        ...


TRACKERS: dict[str, Callable[[], Tracker]] = {}
DETECTORS: dict[str, Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]] = {}
TRACK_SCHEMA = "source_id string, shot_id string, frame_index bigint, det_index int, tracklet_id string"
DETECTION_SCHEMA = "source_id string, frame_index bigint, det_index int, x1 double, y1 double, x2 double, y2 double, score double, class_name string, class_id int"


def register_tracker(name: str, build: Callable[[], Tracker]) -> None:
    TRACKERS[name] = build


def register_detector(name: str, build: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> None:
    """``build()`` runs once per task and returns frames -> detections on Arrow batches."""
    DETECTORS[name] = build


def run_tracker(detections: DataFrame, name: str) -> DataFrame:
    """Run a plug-in over every shot; a task streams sorted rows and holds one batch and one frame at a time.

    Answers leave the task in one table per batch, not per frame.
    """
    build = TRACKERS[name]
    given = ["frame_index", "det_index", "tracklet_id"]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tracker, current, held = build(), None, None
        many = getattr(tracker, "update_many", None)

        def starts(rows: pd.DataFrame, names: list[str]) -> np.ndarray:
            turns = np.zeros(max(len(rows) - 1, 0), bool)
            for values in (rows[c].to_numpy() for c in names):
                turns |= values[1:] != values[:-1]
            return np.flatnonzero(turns) + 1

        def answered(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal current
            edges = [0, *starts(rows, SHOT if many else [*SHOT, "frame_index"]).tolist(), len(rows)]
            sources, shots = rows.source_id.to_numpy(), rows.shot_id.to_numpy()
            owners, answers = [], []
            for low, high in zip(edges, edges[1:]):
                owner = (sources[low], shots[low])
                if owner != current:
                    current = owner
                    tracker.reset(owner[1])
                out = (many or tracker.update)(rows.iloc[low:high])
                owners.append((*owner, len(out)))
                answers.append([out[c].to_numpy() for c in given])
            sizes = [n for *_, n in owners]
            named = {c: np.repeat(np.array([o[i] for o in owners], dtype=object), sizes) for i, c in enumerate(SHOT)}
            return pd.DataFrame({**named, **{c: np.concatenate([a[i] for a in answers]) for i, c in enumerate(given)}})

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch])
            if len(rows) == 0:
                continue
            last = max([0, *starts(rows, [*SHOT, "frame_index"])[-1:]])  # the last frame may go on in the next batch
            held = rows.iloc[last:]
            if last:
                yield answered(rows.iloc[:last])
        if held is not None:
            yield answered(held)

    columns = [*SHOT, "frame_index", "det_index", *BOX, "score"]
    ordered = spread(detections.select(*columns), *SHOT).sortWithinPartitions(*SHOT, "frame_index", "det_index")
    return ordered.mapInPandas(stream, TRACK_SCHEMA)


def run_detector(frames: DataFrame, name: str) -> DataFrame:
    """Run a detector plug-in over a table of frames or thumbnails."""
    build = DETECTORS[name]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = build()
        for batch in batches:
            yield predict(batch)

    return frames.mapInPandas(stream, DETECTION_SCHEMA)
