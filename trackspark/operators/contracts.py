"""Row contracts as named rules; rows that break one go to a reject table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.functions.geometry import box_ok, finite
from trackspark.functions.scalars import CALIBRATION_STATUSES, RUN_STATUSES
from trackspark.scale import adjacent_row, frame_bucket


def _unless_null(name: str, ok: Column) -> Column:
    return F.col(name).isNull() | ok


def detection_rules() -> dict[str, Column]:
    return {
        "box": box_ok(),
        "score": finite("score") & F.col("score").between(0.0, 1.0),
        "class_id": F.col("class_id") >= 0,
    }


def track_rules() -> dict[str, Column]:
    return {
        "box": box_ok(),
        "frame_index": F.col("frame_index") >= 0,
        "pts": F.col("pts") >= 0,
        "score": F.col("score").between(0.0, 1.0),
        "state": F.col("state").isin("observed", "predicted"),
    }


def observation_rules() -> dict[str, Column]:
    return {
        "box": box_ok(),
        "frame_index": F.col("frame_index") >= 0,
        "pts": F.col("pts") >= 0,
        "time_base": (F.col("tb_num") > 0) & (F.col("tb_den") > 0),
        "detection_score": F.col("detection_score").between(0.0, 1.0),
        "team_score": F.col("team_score").between(0.0, 1.0),
        "jersey_number": _unless_null("jersey_number", F.col("jersey_number").between(0, 99)),
        "field_position": (F.col("field_x").isNull() & F.col("field_y").isNull()) | finite("field_x", "field_y"),
        "identity_version": F.col("identity_version") >= 0,
        "position_uncertainty": _unless_null(
            "position_uncertainty_yards", finite("position_uncertainty_yards") & (F.col("position_uncertainty_yards") >= 0)
        ),
        "play_time": _unless_null("play_time_s", finite("play_time_s")),
        "calibration_status": _unless_null("calibration_status", F.col("calibration_status").isin(*CALIBRATION_STATUSES)),
    }


def manifest_rules() -> dict[str, Column]:
    return {
        "input_duration_s": F.col("input_duration_s") >= 0,
        "source_fps": F.col("source_fps") > 0,
        "frame_count": F.col("frame_count") >= 0,
        "status": F.col("status").isin(*RUN_STATUSES),
    }


def class_mapping_violations(dets: DataFrame, mapping: DataFrame) -> DataFrame:
    """Observed (class_id, class_name) pairs that the configured map does not hold."""
    seen = dets.groupBy("source_id", "class_id", "class_name").agg(F.count(F.lit(1)).alias("n"))
    allowed = mapping.select(F.col("class_id").cast("int").alias("_id"), F.col("class_name").alias("_name"))
    return seen.join(allowed, (F.col("class_id") == F.col("_id")) & (F.col("class_name") == F.col("_name")), "left_anti")


def hash_gates(inputs: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Per run and input kind: inputs without a source hash, with a wrong one, and the gate."""
    expected = runs.select(key, F.col("source_sha256").alias("_expected"))
    same = F.col("source_sha256").eqNullSafe(F.col("_expected"))
    return inputs.join(expected, key).groupBy(key, "input_kind").agg(
        F.count(F.lit(1)).alias("inputs"),
        F.count_if(F.col("source_sha256").isNull()).alias("undeclared"),
        F.count_if(F.col("source_sha256").isNotNull() & ~same).alias("mismatched"),
        F.bool_and(same).alias("passed"),
    )


def frame_violations(rows: DataFrame, index: DataFrame, width: float, height: float) -> DataFrame:
    """Rows against the frame index of their source; index(source_id, frame_index, index_pts)."""
    joined = rows.join(index, ["source_id", "frame_index"], "left")
    rule = F.array_compact(F.array(
        F.when(F.col("index_pts").isNull(), "unknown_frame"),
        F.when(F.col("index_pts") != F.col("pts"), "pts_mismatch"),
        F.when((F.col("x1") < 0) | (F.col("y1") < 0) | (F.col("x2") > width) | (F.col("y2") > height), "outside_image"),
    ))
    return joined.withColumn("rule", F.explode(rule)).drop("index_pts")


def index_order(index: DataFrame, keys: list[str]) -> DataFrame:
    """Per source: frames whose PTS does not increase and jumps in the frame numbers."""
    near = adjacent_row(
        index.withColumn("_bucket", frame_bucket("frame_index")), keys, ["frame_index"], "_bucket",
        {"_pts": "pts", "_frame": "frame_index"},
    )
    return near.groupBy(*keys).agg(
        F.count_if(F.col("_pts") >= F.col("pts")).alias("not_increasing"),
        F.count_if(F.col("frame_index") - F.col("_frame") > 1).alias("gaps"),
    )
