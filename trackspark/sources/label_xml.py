"""Video labels in XML: tracks of boxes or points, and frame tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.session import cut_lineage

ATTRIBUTE = "array<struct<_name:string,_VALUE:string>>"
SHAPE = "_frame bigint,_outside int,_occluded int,_keyframe int"
TRACK = (
    f"_id bigint, _label string, _source string, attribute {ATTRIBUTE}, "
    f"box array<struct<{SHAPE.replace(' ', ':')},_xtl:double,_ytl:double,_xbr:double,_ybr:double,attribute:{ATTRIBUTE}>>, "
    f"points array<struct<{SHAPE.replace(' ', ':')},_points:string,attribute:{ATTRIBUTE}>>"
)
TAG = f"_frame bigint, _label string, attribute {ATTRIBUTE}"


def _attributes(column: str) -> Column:
    """Name to value, the first of a repeated name; mostly there is one attribute or none."""
    entries = F.transform(F.coalesce(F.col(column), F.array().cast(ATTRIBUTE)), lambda a: F.struct(a["_name"].alias("key"), F.coalesce(a["_VALUE"], F.lit("")).alias("value")))
    named = F.filter(entries, lambda e: e["key"].isNotNull())
    first = F.filter(F.transform(named, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i"))), lambda e: ~F.exists(F.slice(named, F.lit(1), e["i"]), lambda p: p["key"] == e["key"]))
    only = F.get(F.col(column), F.lit(0))
    one = (F.size(F.col(column)) == 1) & only["_name"].isNotNull()
    return F.when(one, F.create_map(F.coalesce(only["_name"], F.lit("")), F.coalesce(only["_VALUE"], F.lit("")))).otherwise(
        F.map_from_entries(F.transform(first, lambda e: F.struct(e["key"], e["value"])))
    )


def _merged(outer: Column, inner: Column) -> Column:
    """Shape attributes override track attributes."""
    kept = F.map_filter(outer, lambda k, _: ~F.map_contains_key(inner, k))
    return F.map_concat(kept, inner)


def read_tracks(spark: SparkSession, paths: str | list[str]) -> dict[str, DataFrame]:
    """``boxes``, ``points`` (one row per coordinate pair), ``tags`` and ``rejects`` of many label files."""
    raw = spark.read.format("xml").option("rowTag", "track").schema(TRACK).load(paths).withColumn("file_path", F.col("_metadata.file_path"))
    raw = cut_lineage(raw)  # boxes, points and rejects read the parsed tracks, not the files
    tags = spark.read.format("xml").option("rowTag", "tag").schema(TAG).load(paths).withColumn("file_path", F.col("_metadata.file_path"))
    tracks = raw.select("file_path", F.col("_id").alias("track_id"), F.coalesce("_label", F.lit("")).alias("label"), F.coalesce("_source", F.lit("manual")).alias("track_source"), _attributes("attribute").alias("_track"), "box", "points")
    on = lambda c, default: F.coalesce(F.col(c), F.lit(default)) == 1
    base = ["file_path", "track_id", "label", "track_source"]
    boxes = tracks.select(*base, "_track", F.explode("box").alias("b")).select(
        *base, F.col("b._frame").alias("task_frame"), on("b._outside", 0).alias("outside"), on("b._occluded", 0).alias("occluded"), on("b._keyframe", 1).alias("keyframe"),
        *[F.col(f"b.{a}").alias(c) for a, c in (("_xtl", "x1"), ("_ytl", "y1"), ("_xbr", "x2"), ("_ybr", "y2"))], _merged(F.col("_track"), _attributes("b.attribute")).alias("attributes"),
    )
    shapes = tracks.select(*base, "_track", F.explode("points").alias("p")).select(
        *base, F.col("p._frame").alias("task_frame"), on("p._outside", 0).alias("outside"), on("p._occluded", 0).alias("occluded"), on("p._keyframe", 1).alias("keyframe"),
        F.transform(F.filter(F.split(F.coalesce("p._points", F.lit("")), ";"), lambda s: s != ""), lambda s: F.struct(F.get(F.split(s, ",", 2), F.lit(0)).try_cast("double").alias("x"), F.get(F.split(s, ",", 2), F.lit(1)).try_cast("double").alias("y"))).alias("coordinates"),
        _merged(F.col("_track"), _attributes("p.attribute")).alias("attributes"),
    )
    tag_rows = tags.select("file_path", F.col("_frame").alias("task_frame"), F.coalesce("_label", F.lit("")).alias("label"), _attributes("attribute").alias("attributes"))
    twice = lambda df, rule: df.groupBy("file_path", "track_id", "task_frame").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("file_path", "track_id", "task_frame", F.lit(rule).alias("rule"))
    visible_bad = boxes.filter(~F.col("outside") & ~F.coalesce((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.lit(False)))
    bad_points = shapes.filter(~F.col("outside") & ((F.size("coordinates") == 0) | F.exists("coordinates", lambda c: c["x"].isNull() | c["y"].isNull())))
    none = F.lit(None).cast("bigint")
    ids = tracks.groupBy("file_path", "track_id").agg(F.count(F.lit(1)).alias("n"), F.max((F.size("box") > 0) & (F.size("points") > 0)).alias("mixed"), F.max((~F.col("track_source").isin("manual", "auto"))).alias("odd_source"), F.max(F.col("label") == "").alias("no_label"))
    track_rules = F.array_compact(F.array(F.when(F.col("n") > 1, "duplicate_track_id"), F.when(F.col("mixed"), "mixed_shapes"), F.when(F.col("odd_source"), "track_source"), F.when(F.col("no_label"), "label")))
    rejects = (
        ids.select("file_path", "track_id", none.alias("task_frame"), F.explode(track_rules).alias("rule"))
        .unionByName(twice(boxes, "duplicate_box")).unionByName(twice(shapes, "duplicate_points"))
        .unionByName(visible_bad.select("file_path", "track_id", "task_frame", F.lit("box").alias("rule")))
        .unionByName(bad_points.select("file_path", "track_id", "task_frame", F.lit("points").alias("rule")))
        .unionByName(tag_rows.filter("task_frame is null or task_frame < 0").select("file_path", none.alias("track_id"), "task_frame", F.lit("tag_frame").alias("rule")))
    )
    # the written tracks look small, their shapes are as many as the detections: never to be broadcast
    boxes, shapes = boxes.hint("merge"), shapes.hint("merge")
    return {"boxes": boxes, "points": shapes, "tags": tag_rows, "rejects": rejects}
