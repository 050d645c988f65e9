"""Fixed-order table exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.functions.geometry import contact_x, contact_y

# Fixed column order of the observation export.
OBSERVATION_COLUMNS = (
    "run_id", "shot_id", "frame_index", "pts", "time_base", "tracklet_id", "player_id", "play_id", "bbox_xyxy_px", "detection_score",
    "team", "team_score", "jersey_number", "field_xy_yards", "position_source", "calibration_id", "identity_version",
    "calibration_status", "calibration_reason", "position_uncertainty_yards", "play_time_s", "time_map_id", "source_tracklet_id",
)
UNSETTLED = ("not_provided", "unvalidated", "partial", "invalid")


def observation_csv_rows(rows: DataFrame) -> DataFrame:
    """The 23 export columns; arrays as JSON text, no field position as an empty cell."""
    packed = rows.withColumn("time_base", F.to_json(F.array("tb_num", "tb_den"))).withColumn("bbox_xyxy_px", F.to_json(F.array("x1", "y1", "x2", "y2")))
    packed = packed.withColumn(
        "field_xy_yards", F.when(F.col("field_x").isNotNull() & F.col("field_y").isNotNull(), F.to_json(F.array("field_x", "field_y")))
    )
    return packed.select(*OBSERVATION_COLUMNS)


def observation_parquet_rows(rows: DataFrame) -> DataFrame:
    """The same contract with native arrays."""
    packed = rows.withColumn("time_base", F.array(F.col("tb_num").cast("bigint"), F.col("tb_den").cast("bigint")))
    packed = packed.withColumn("bbox_xyxy_px", F.array("x1", "y1", "x2", "y2"))
    packed = packed.withColumn("field_xy_yards", F.when(F.col("field_x").isNotNull() & F.col("field_y").isNotNull(), F.array("field_x", "field_y")))
    return packed.select(*OBSERVATION_COLUMNS)


def trajectories(rows: DataFrame) -> DataFrame:
    """Rows with a player id and their contact pixel and yards."""
    placed = F.col("field_x").isNotNull() & F.col("field_y").isNotNull()
    return rows.filter(F.coalesce("player_id", F.lit("")) != "").select(
        "player_id", "shot_id", "frame_index", "pts", contact_x().alias("x_px"), contact_y().alias("y_px"),
        F.when(placed, F.col("field_x")).alias("x_yards"), F.when(placed, F.col("field_y")).alias("y_yards"), "position_source", "calibration_id",
        "calibration_status", "position_uncertainty_yards", "play_time_s", "time_map_id", "source_tracklet_id",
    )


def play_trajectories(rows: DataFrame, cadence_hz: float = 10.0) -> DataFrame:
    """One best row per (play, player, time bin); a missing status passes, a missing uncertainty ranks last."""
    usable = rows.filter(
        (F.coalesce("player_id", F.lit("")) != "") & (F.coalesce("play_id", F.lit("")) != "") & F.col("play_time_s").isNotNull()
        & F.col("field_x").isNotNull() & F.col("field_y").isNotNull()
        & (F.col("calibration_status").isNull() | ~F.col("calibration_status").isin(*UNSETTLED))
        & (F.col("time_map_id").isNull() | (F.col("time_map_id") == "play-time-map"))
    )
    quality = F.struct(
        F.coalesce("position_uncertainty_yards", F.lit(float("inf"))).alias("a"), (-F.col("detection_score")).alias("b"),
        F.col("shot_id"), F.col("frame_index"), F.col("tracklet_id"),
    )
    kept = F.struct("field_x", "field_y", "shot_id", "frame_index", "pts", "position_uncertainty_yards", "calibration_id", "source_tracklet_id")
    binned = usable.withColumn("_bin", F.rint(F.col("play_time_s") * cadence_hz).cast("bigint"))
    best = binned.groupBy("play_id", "player_id", "_bin").agg(F.min_by(kept, quality).alias("_k"))
    return best.select(
        "player_id", "play_id", (F.col("_bin") / F.lit(float(cadence_hz))).alias("play_time_s"), F.col("_k.field_x").alias("x_yards"), F.col("_k.field_y").alias("y_yards"),
        "_k.shot_id", "_k.frame_index", "_k.pts", "_k.position_uncertainty_yards", "_k.calibration_id", "_k.source_tracklet_id",
    )


def write_ordered_csv(df: DataFrame, path: str, order: list[str], partitions: int | None = None) -> None:
    """Globally ordered CSV: files in name order hold rows in key order."""
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def write_observations_csv(rows: DataFrame, path: str) -> None:
    write_ordered_csv(observation_csv_rows(rows), path, ["frame_index", "shot_id", "tracklet_id"])


def write_observations_parquet(rows: DataFrame, path: str) -> None:
    order = ["frame_index", "shot_id", "tracklet_id"]
    observation_parquet_rows(rows).repartitionByRange("run_id", "shot_id", "frame_index").sortWithinPartitions("run_id", *order).write.mode(
        "overwrite"
    ).partitionBy("run_id", "shot_id").parquet(path)


def write_trajectories_csv(rows: DataFrame, path: str) -> None:
    write_ordered_csv(trajectories(rows), path, ["player_id", "frame_index", "shot_id"])


def write_play_trajectories_csv(rows: DataFrame, path: str, cadence_hz: float = 10.0) -> None:
    write_ordered_csv(play_trajectories(rows, cadence_hz), path, ["play_id", "player_id", "play_time_s"])


def write_detection_table(detections: DataFrame, provenance: DataFrame, path: str) -> None:
    """Detections by source and detector config, provenance beside them."""
    detections.repartitionByRange("source_sha256", "detector_config_hash", "frame_index").sortWithinPartitions(
        "source_sha256", "detector_config_hash", "frame_index", "det_index"
    ).write.mode("overwrite").partitionBy("source_sha256", "detector_config_hash").parquet(f"{path}/detections")
    provenance.write.mode("overwrite").parquet(f"{path}/provenance")


def detection_log_lines(frames: DataFrame, logs: DataFrame) -> DataFrame:
    """JSON lines of detection logs: the metadata line sorts first, then frames in order.

    frames(log_id, frame_index, detections array<struct>), logs(log_id, source_hash, detector_config_hash, provenance)
    """
    meta = logs.select(
        "log_id", F.lit(-1).cast("bigint").alias("line_no"),
        F.to_json(F.struct(F.struct("detector_config_hash", "provenance", "source_hash").alias("_meta"))).alias("value"),
    )
    body = frames.select("log_id", F.col("frame_index").alias("line_no"), F.to_json(F.struct("detections", "frame_index")).alias("value"))
    return meta.unionByName(body)


def write_documents(df: DataFrame, path: str, key: str, value: Column) -> None:
    """One JSON document per row under its key, plus the table itself."""
    df.select(key, F.to_json(value).alias("value")).write.mode("overwrite").partitionBy(key).text(f"{path}/documents")
    df.write.mode("overwrite").parquet(f"{path}/table")
