"""The block-wise tracker against one plain pass, and the streams against the batch."""

import random

import pytest
from pyspark.sql import functions as F

from trackspark.operators.tracking import register_tracker, run_tracker, track_shots
from trackspark.streaming.stateful import throttle_stream


def overlap(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union else 0.0


def one_pass(rows, buffer, threshold):
    """Plain frame loop over one shot: {(frame, det): track number}."""
    live, made, out = {}, 0, {}
    by_frame = {}
    for frame, det, *box in rows:
        by_frame.setdefault(frame, []).append((det, box))
    for frame in range(min(by_frame), max(by_frame) + 1):
        dets = sorted(by_frame.get(frame, []))
        for t in live.values():
            t["miss"] += 1
        edges = sorted((-overlap(t["box"], box), no, i) for no, t in live.items() for i, (_, box) in enumerate(dets) if overlap(t["box"], box) >= threshold)
        used, taken = set(), {}
        for _, no, i in edges:
            if no not in used and i not in taken:
                used.add(no)
                taken[i] = no
        for i, (det, box) in enumerate(dets):
            if i not in taken:
                made += 1
                taken[i] = made
                live[made] = {}
            live[taken[i]] = {"box": box, "miss": 0}
            out[(frame, det)] = taken[i]
        live = {no: t for no, t in live.items() if t["miss"] <= buffer}
    return out


def crowd(seed, frames=160, objects=6, grid=True):
    """Objects that cross, vanish and reappear; a coarse grid makes exact ties common."""
    rng = random.Random(seed)
    rows = []
    at = [[rng.randrange(0, 60), rng.randrange(0, 20)] for _ in range(objects)]
    for frame in range(frames):
        det = 0
        for p in at:
            p[0] += rng.choice([-2, 0, 0, 2])
            p[1] += rng.choice([-1, 0, 1])
            if rng.random() < 0.75:
                rows.append((frame, det, float(p[0]), float(p[1]), float(p[0] + 16), float(p[1] + 16)))
                det += 1
    return rows


@pytest.mark.parametrize("seed,block,buffer", [(1, 16, 3), (2, 8, 2), (3, 32, 6)])
def test_blocks_equal_one_pass(spark, seed, block, buffer):
    rows = crowd(seed)
    shots = [("s", f"shot-{k}", *r) for k in range(2) for r in (rows if k == 0 else crowd(seed + 50))]
    df = spark.createDataFrame(shots, "source_id string, shot_id string, frame_index bigint, det_index int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.shot_id, r.frame_index, r.det_index): r.tracklet_id for r in track_shots(df, buffer, 0.2, block_frames=block).collect()}
    want = {}
    for k in range(2):
        part = [r[2:] for r in shots if r[1] == f"shot-{k}"]
        want.update({(f"shot-{k}", f, d): f"shot-{k}:t{n}" for (f, d), n in one_pass(part, buffer, 0.2).items()})
    assert got == want


def test_a_round_writes_only_the_blocks_it_reruns(spark, monkeypatch):
    from trackspark.operators import tracking

    written = []
    real = tracking.cut_lineage

    def counted(df):
        out = real(df)
        if "piece_frame" in out.columns and "turn" in out.columns:
            written.append((out.select("source_id", "shot_id", "block").distinct().count(), out.agg(F.max("turn")).first()[0]))
        return out

    monkeypatch.setattr(tracking, "cut_lineage", counted)
    rows = [("s", f"shot-{k}", *r) for k in range(3) for r in crowd(20 + k, frames=400, objects=8)]
    df = spark.createDataFrame(rows, "source_id string, shot_id string, frame_index bigint, det_index int, x1 double, y1 double, x2 double, y2 double")
    tracking.track_shots(df, 12, 0.2, block_frames=20).collect()
    assert written[0] == (60, 0) and len(written) > 1
    assert all(0 < blocks < 60 for blocks, _ in written[1:]) and [turn for _, turn in written] == list(range(len(written)))


def test_gap_opens_a_new_track_only_after_the_buffer(spark):
    box = (0.0, 0.0, 10.0, 10.0)
    rows = [("s", "shot-0", f, 0, *box) for f in (0, 1, 4, 9)]
    df = spark.createDataFrame(rows, "source_id string, shot_id string, frame_index bigint, det_index int, x1 double, y1 double, x2 double, y2 double")
    got = {r.frame_index: r.tracklet_id for r in track_shots(df, 2, 0.2).collect()}
    assert got == {0: "shot-0:t1", 1: "shot-0:t1", 4: "shot-0:t1", 9: "shot-0:t2"}


def test_tracker_plugin_sees_frames_in_order(spark):
    class Counter:
        def reset(self, shot_id):
            self.seen = []
            self.shot = shot_id

        def update(self, frame):
            value = int(frame.frame_index.iloc[0])
            assert not self.seen or value > self.seen[-1]
            self.seen.append(value)
            return frame.assign(tracklet_id=f"{self.shot}:n{len(self.seen)}")[["frame_index", "det_index", "tracklet_id"]]

    register_tracker("counter", Counter)
    rows = [("s", f"shot-{k}", f, d, 0.0, 0.0, 1.0, 1.0, 0.5) for k in range(3) for f in range(0, 40, 2) for d in range(2)]
    df = spark.createDataFrame(rows, "source_id string, shot_id string, frame_index bigint, det_index int, x1 double, y1 double, x2 double, y2 double, score double")
    out = run_tracker(df, "counter").groupBy("shot_id").agg(F.count_distinct("tracklet_id").alias("n"), F.count("*").alias("rows")).collect()
    assert {(r.shot_id, r.n, r.rows) for r in out} == {(f"shot-{k}", 20, 40) for k in range(3)}


def test_tracker_plugin_may_take_many_whole_frames(spark):
    class Pairs:
        def reset(self, shot_id):
            self.shot = shot_id

        def update(self, frame):
            raise AssertionError("frames come together")

        def update_many(self, frames):
            sizes = frames.groupby("frame_index").det_index.transform("size")
            return frames.assign(tracklet_id=[f"{self.shot}:{n}" for n in sizes])[["frame_index", "det_index", "tracklet_id"]]

    register_tracker("pairs", Pairs)
    schema = "source_id string, shot_id string, frame_index bigint, det_index int, x1 double, y1 double, x2 double, y2 double, score double"
    rows = [("s", f"shot-{k}", f, d, 0.0, 0.0, 1.0, 1.0, 0.5) for k in range(3) for f in range(30) for d in range(3)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # batches end inside frames
    try:
        out = run_tracker(spark.createDataFrame(rows, schema), "pairs").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted((r.shot_id, r.frame_index, r.det_index, r.tracklet_id) for r in out) == [(f"shot-{k}", f, d, f"shot-{k}:3") for k in range(3) for f in range(30) for d in range(3)]


def test_stream_state_reads_follow_arrivals_not_the_backlog(spark, tmp_path):
    """Nothing is released while the backlog grows twelvefold; every trigger brings as many rows and must read as much."""
    schema = "tracklet_id string, frame_index bigint, ts timestamp"
    for i in range(12):
        rows = [("t", f) for f in range(400 * i, 400 * i + 400)]
        frame = spark.createDataFrame(rows, "tracklet_id string, frame_index bigint").withColumn("ts", (F.col("frame_index") * 0.04 + 1_700_000_000).cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = throttle_stream(stream, 6, "1 hour").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    told = [p["stateOperators"][0]["customMetrics"] for p in query.recentProgress if p["numInputRows"]]
    reads = [int(m["rocksdbGetCount"]) for m in told]
    assert len(reads) == 12 and max(reads[2:]) <= 2 * min(reads[2:])


def test_late_rows_inside_the_watermark_change_nothing(spark, tmp_path):
    """Frames arrive out of order over several triggers; the kept frames equal those of one ordered pass."""
    rng = random.Random(3)
    frames = [f for f in range(900) if rng.random() < 0.6]
    pieces = [[f for f in frames if (f // 30 + f % 3) // 2 == i] for i in range(17)]
    for i, piece in enumerate([*pieces, [1_000_000]]):
        frame = spark.createDataFrame([("t", f) for f in piece], "tracklet_id string, frame_index bigint")
        frame.withColumn("ts", (F.col("frame_index") * 0.04 + 1_700_000_000).cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03}")
    stream = spark.readStream.schema("tracklet_id string, frame_index bigint, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = throttle_stream(stream, 7, "10 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    want, free = [], 0
    for f in sorted(frames):
        if f >= free:
            want.append(f)
            free = f + 7
    assert sorted(r.frame_index for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want
