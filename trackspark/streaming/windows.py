"""Windowed streams and the incremental merge of detection logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_summary(rows: DataFrame, size: str, slide: str | None = None, delay: str = "10 seconds") -> DataFrame:
    """Track summary per event-time window; rows(shot_id, tracklet_id, frame_index, ts).

    Distinct tracklets are counted per window through one row per (window, tracklet).
    """
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    per_track = rows.withWatermark("ts", delay).groupBy(span.alias("span"), "shot_id", "tracklet_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("frame_index").alias("first"), F.max("frame_index").alias("last")
    )
    return per_track.groupBy("span", "shot_id").agg(
        F.sum("n").alias("observation_count"), F.count(F.lit(1)).alias("unique_tracklets"), F.count_if(F.col("last") > F.col("first")).alias("multi_frame_tracklets"),
        F.min("first").alias("first_frame"), F.max("last").alias("last_frame"),
    )


def session_stretches(rows: DataFrame, max_gap_frames: int, frame_ms: int, delay: str = "10 seconds") -> DataFrame:
    """Gap-free stretches of a tracklet; the session gap ends half a frame after the largest allowed step."""
    gap = f"{int((max_gap_frames + 1) * frame_ms + frame_ms // 2)} milliseconds"
    return rows.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("span"), "tracklet_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame")
    )


def merge_stream(frames: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Frame records of arriving log chunks, repeats within the watermark dropped once."""
    return frames.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["source_hash", "frame_index"])


def arrival_counter(path: str):
    """foreachBatch writer: per batch and frame, how often a record arrived (repeats are violations)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("source_hash", "frame_index").agg(F.count(F.lit(1)).alias("arrivals"))
        # the batch id is the folder, so a replayed batch replaces itself
        counts.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def merge_report(arrivals: DataFrame, targets: DataFrame) -> DataFrame:
    """Repeats and coverage per source over all batches; targets(source_hash, frame_count)."""
    per_frame = arrivals.groupBy("source_hash", "frame_index").agg(F.sum("arrivals").alias("n"))
    per_source = per_frame.groupBy("source_hash").agg(
        F.count(F.lit(1)).alias("frames"), F.sum(F.col("n") - 1).alias("repeats"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame")
    )
    full = targets.join(per_source, "source_hash", "left")
    complete = (F.col("frames") == F.col("frame_count")) & (F.col("first_frame") == 0) & (F.col("last_frame") == F.col("frame_count") - 1)
    return full.select(
        "source_hash", "frame_count", F.coalesce("frames", F.lit(0).cast("bigint")).alias("frames"), F.coalesce("repeats", F.lit(0).cast("bigint")).alias("repeats"),
        F.coalesce(complete, F.lit(False)).alias("complete"),
    )


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", for_each=None, timeout_s: int = 600) -> None:
    """Run a stream over everything available into Parquet (or a batch function); raises if time runs out first."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(for_each).start() if for_each else writer.format("parquet").option("path", path).start()
    try:
        ended = query.awaitTermination(timeout_s)
    finally:
        query.stop()
    if query.exception() is not None:
        raise query.exception()
    if not ended:
        raise TimeoutError(f"the stream had not taken in all its input after {timeout_s} seconds")
