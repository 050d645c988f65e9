"""Annotation manifests: source metadata, shots, annotations, landmarks, frame labels, timing events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REVIEW = "review_status:string,reviewer:string,reviewed_at:string,revision:int,annotation_confidence:double"
PLACE = "shot_id:string,source_frame:bigint,pts:bigint"
ANNOTATION = (
    f"struct<id:string,{PLACE},track_id:string,bbox_xyxy_px:array<double>,ground_contact_xy_px:array<double>,ground_contact_xy_yards:array<double>,"
    "ground_contact_confidence:double,coordinate_space:string,label:string,visibility:string,occluded:boolean,team:string,global_id:string,cross_shot_id:string,"
    "cross_shot_review_status:string,identity_second_reviewer:string,identity_second_reviewed_at:string,identity_second_revision:int,"
    f"identity_second_confidence:double,{REVIEW}>"
)
LANDMARK = f"struct<id:string,{PLACE},image_xy_px:array<double>,field_xy_yards:array<double>,landmark_id:string,role:string,{REVIEW}>"
FRAME_LABEL = f"struct<{PLACE},labeled:boolean,ignore:boolean,{REVIEW}>"
TIMING = f"struct<id:string,{PLACE},event:string,play_id:string,play_time_s:double,{REVIEW}>"
SHOT = "struct<start_frame:bigint,end_frame:bigint,play_id:string,split:string,camera_label:string>"
MANIFEST = (
    "schema_version int, reviewed boolean, source struct<sha256:string,width:int,height:int,frame_count:bigint,time_base:array<bigint>>, "
    f"shots map<string,{SHOT}>, annotations array<{ANNOTATION}>, landmarks array<{LANDMARK}>, frame_labels array<{FRAME_LABEL}>, timing_events array<{TIMING}>"
)


def parse_manifests(docs: DataFrame) -> dict[str, DataFrame]:
    """Six child tables; ``width``/``height`` travel with the records that are checked against the image."""
    parsed = docs.select("file_path", F.from_json("value", MANIFEST).alias("d"))
    sources = parsed.select(
        "file_path", F.col("d.schema_version").alias("schema_version"), F.coalesce("d.reviewed", F.lit(False)).alias("reviewed"), F.col("d.source.sha256").alias("source_sha256"),
        F.col("d.source.width").alias("width"), F.col("d.source.height").alias("height"), F.col("d.source.frame_count").alias("frame_count"),
        F.get("d.source.time_base", F.lit(0)).alias("tb_num"), F.get("d.source.time_base", F.lit(1)).alias("tb_den"),
    )
    shots = parsed.select("file_path", F.col("d.source.frame_count").alias("frame_count"), F.explode(F.map_entries("d.shots")).alias("s")).select(
        "file_path", "frame_count", F.col("s.key").alias("shot_id"), F.col("s.value.start_frame").alias("start_frame"), F.col("s.value.end_frame").alias("end_frame"),
        F.col("s.value.play_id").alias("play_id"), F.coalesce("s.value.split", F.lit("unassigned")).alias("split"), F.coalesce("s.value.camera_label", F.lit("")).alias("camera_label"),
    )
    table = lambda field: parsed.select(
        "file_path", F.col("d.source.sha256").alias("source_sha256"), F.col("d.source.width").alias("width"), F.col("d.source.height").alias("height"), F.explode(f"d.{field}").alias("r")
    ).select("file_path", "source_sha256", "width", "height", "r.*")
    return {
        "sources": sources, "shots": shots, "annotations": table("annotations"), "landmarks": table("landmarks"),
        "frame_labels": table("frame_labels"), "timing_events": table("timing_events"),
    }
