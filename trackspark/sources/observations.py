"""Observation tables in CSV form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.functions.geometry import box_ok, finite
from trackspark.session import cut_lineage
from trackspark.sinks.tables import OBSERVATION_COLUMNS


def read_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All cells as text with the file they came from; typing happens in ``parse_rows``."""
    schema = ", ".join(f"{c} string" for c in OBSERVATION_COLUMNS)
    return spark.read.option("header", True).option("escape", '"').schema(schema).csv(paths).withColumn("file_path", F.col("_metadata.file_path"))


def parse_rows(raw: DataFrame) -> dict[str, DataFrame]:
    """``rows`` and ``rejects``: rows without a tracklet are dropped, bad optional numbers become null."""
    number = lambda name: F.when(finite(F.col(name).try_cast("double")), F.col(name).try_cast("double"))
    text = lambda name: F.when(F.trim(name) != "", F.col(name))
    named = raw.filter(F.trim(F.coalesce("tracklet_id", F.lit(""))) != "")
    arrays = named.withColumn("_tb", F.from_json("time_base", "array<bigint>")).withColumn("_box", F.from_json("bbox_xyxy_px", "array<double>")).withColumn(
        "_xy", F.from_json("field_xy_yards", "array<double>")
    )
    typed = arrays.select(
        *[c for c in ("file_path", "run_id", "shot_id") if c in raw.columns], F.trim("tracklet_id").alias("tracklet_id"),
        F.col("frame_index").try_cast("bigint").alias("frame_index"), F.col("pts").try_cast("bigint").alias("pts"),
        F.get("_tb", F.lit(0)).alias("tb_num"), F.get("_tb", F.lit(1)).alias("tb_den"), F.size("_tb").alias("_tb_size"), F.size("_box").alias("_box_size"),
        *[F.get("_box", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))],
        F.get("_xy", F.lit(0)).alias("field_x"), F.get("_xy", F.lit(1)).alias("field_y"),
        number("detection_score").alias("detection_score"), F.coalesce("team", F.lit("unknown")).alias("team"), number("team_score").alias("team_score"),
        number("position_uncertainty_yards").alias("position_uncertainty_yards"), number("play_time_s").alias("play_time_s"),
        *[text(c).alias(c) for c in ("player_id", "play_id", "calibration_id", "calibration_status", "time_map_id", "source_tracklet_id")],
    )
    rule = (
        F.when(F.col("frame_index").isNull() | F.col("pts").isNull(), "frame_or_pts")
        .when((F.col("frame_index") < 0) | (F.col("pts") < 0) | (F.col("_tb_size") != 2) | (F.col("_box_size") != 4), "source_coordinates")
        .when(F.col("tb_num").isNull() | F.col("tb_den").isNull() | (F.col("tb_num") <= 0) | (F.col("tb_den") <= 0) | ~box_ok(), "time_base_or_box")
    )
    marked = cut_lineage(typed.withColumn("rule", rule).drop("_tb_size", "_box_size"))  # cells are read once
    rows = marked.filter("rule is null").drop("rule")
    repeats = cut_lineage(rows.groupBy("tracklet_id", "frame_index").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    repeated = rows.join(repeats.drop("n"), ["tracklet_id", "frame_index"], "left_semi").withColumn("rule", F.lit("duplicate_frame"))
    rejects = marked.filter("rule is not null").unionByName(repeated, allowMissingColumns=True)
    return {"rows": rows.join(repeats.drop("n"), ["tracklet_id", "frame_index"], "left_anti"), "rejects": rejects}
