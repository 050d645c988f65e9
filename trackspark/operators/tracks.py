"""Track tables: summaries, conflicts, reviewed splits, gaps, throttles, trails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.functions.geometry import BOX, contact_x, contact_y, iou
from trackspark.scale import FRAME_BUCKET, adjacent_row, frame_bucket, interval_join, positions, row_frames, running_sum


def track_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, tracklets, tracklets over several frames, repeated ids in a frame, first and last frame."""
    per_cell = rows.groupBy(*keys, "tracklet_id", "frame_index").agg(F.count(F.lit(1)).alias("n"))
    per_track = per_cell.groupBy(*keys, "tracklet_id").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") - 1).alias("repeats"),
        F.count(F.lit(1)).alias("frames"),
        F.min("frame_index").alias("first"),
        F.max("frame_index").alias("last"),
    )
    return per_track.groupBy(*keys).agg(
        F.sum("n").alias("observation_count"),
        F.count(F.lit(1)).alias("unique_tracklets"),
        F.count_if(F.col("frames") > 1).alias("multi_frame_tracklets"),
        F.sum("repeats").alias("duplicate_track_ids_within_frame"),
        F.min("first").alias("first_frame"),
        F.max("last").alias("last_frame"),
    )


def overlapping_pairs(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs of tracks of one frame whose boxes overlap; the join never leaves a frame."""
    left = rows.select("shot_id", "frame_index", F.col("tracklet_id").alias("left_tracklet_id"), *BOX)
    right = rows.select(
        "shot_id", "frame_index", F.col("tracklet_id").alias("right_tracklet_id"), *[F.col(c).alias(f"r_{c}") for c in BOX]
    )
    return (
        left.join(right, ["shot_id", "frame_index"])
        .filter(F.col("left_tracklet_id") < F.col("right_tracklet_id"))
        .withColumn("iou", iou(BOX, [f"r_{c}" for c in BOX]))
        .filter(F.col("iou") >= threshold)
        .select("shot_id", "frame_index", "left_tracklet_id", "right_tracklet_id", "iou")
    )


def suspect_tracklets(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "shot_id", F.explode(F.array("left_tracklet_id", "right_tracklet_id")).alias("tracklet_id")
    ).distinct()


def conflict_report(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per shot: status, pair count and number of suspect tracks; clean shots stay in."""
    pairs = overlapping_pairs(rows, threshold)
    counts = pairs.groupBy("shot_id").agg(F.count(F.lit(1)).alias("conflict_count"))
    suspects = suspect_tracklets(pairs).groupBy("shot_id").agg(F.count(F.lit(1)).alias("suspect_count"))
    return (
        rows.select("shot_id").distinct().join(counts, "shot_id", "left").join(suspects, "shot_id", "left").select(
            "shot_id",
            F.coalesce("conflict_count", F.lit(0)).alias("conflict_count"),
            F.coalesce("suspect_count", F.lit(0)).alias("suspect_count"),
            F.when(F.col("conflict_count") > 0, "review_required").otherwise("no_conflicts_detected").alias("status"),
        )
    )


def refine_tracklets(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Each row with its reviewed segment, or its own tracklet where none is declared."""
    spans = splits.select("tracklet_id", F.col("segment_id").alias("_segment"), F.col("start_frame").alias("_s"), F.col("end_frame").alias("_e"))
    joined = interval_join(rows, spans, ["tracklet_id"], "frame_index", "_s", "_e", FRAME_BUCKET, how="left")
    split_ids = splits.select("tracklet_id").distinct().withColumn("_is_split", F.lit(True))
    return joined.join(split_ids, "tracklet_id", "left").select(
        *rows.columns,
        F.when(F.col("_segment").isNotNull(), F.col("_segment"))
        .when(F.col("_is_split").isNull(), F.col("tracklet_id"))
        .alias("segment_id"),
    )


def split_violations(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """(tracklet_id, segment_id, rule) for every rule a reviewed split breaks."""
    spans = rows.groupBy("tracklet_id").agg(F.min("frame_index").alias("_first"), F.max("frame_index").alias("_last"))
    known = splits.join(spans, "tracklet_id")
    out = lambda df, rule: df.select("tracklet_id", "segment_id", F.lit(rule).alias("rule"))
    unknown = out(splits.join(spans, "tracklet_id", "left_anti"), "unknown_tracklet")
    outside = out(
        known.filter(
            (F.col("end_frame") <= F.col("start_frame"))
            | (F.col("start_frame") < F.col("_first"))
            | (F.col("end_frame") > F.col("_last") + 1)
        ),
        "interval_outside_tracklet",
    )
    near = adjacent_row(
        splits.withColumn("_bucket", frame_bucket("start_frame")),
        ["tracklet_id"], ["start_frame", "end_frame", "segment_id"], "_bucket", {"_previous_end": "end_frame"},
    )
    overlap = out(near.filter(F.col("start_frame") < F.col("_previous_end")), "overlapping_segments")
    repeated = splits.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    duplicate = out(splits.join(repeated, "segment_id", "left_semi"), "duplicate_segment_id")
    placed = refine_tracklets(rows, splits)
    empty = out(known.join(placed, ["tracklet_id", "segment_id"], "left_anti"), "segment_without_rows")
    uncovered = (
        placed.filter(F.col("segment_id").isNull()).select("tracklet_id").distinct()
        .select("tracklet_id", F.lit(None).cast("string").alias("segment_id"), F.lit("frames_not_covered").alias("rule"))
    )
    return unknown.unionByName(outside).unionByName(overlap).unionByName(duplicate).unionByName(empty).unionByName(uncovered)


def gap_segments(rows: DataFrame, max_gap_frames: int = 2) -> DataFrame:
    """Number the stretches of a tracklet; a gap over ``max_gap_frames + 1`` frames opens the next."""
    bucketed = rows.withColumn("_bucket", frame_bucket("frame_index"))
    near = adjacent_row(bucketed, ["tracklet_id"], ["frame_index"], "_bucket", {"_previous": "frame_index"})
    opened = (F.col("frame_index") - F.col("_previous") > max_gap_frames + 1).cast("int")
    return running_sum(
        near, ["tracklet_id"], ["frame_index"], "_bucket", F.coalesce(opened, F.lit(0)), "segment_no"
    ).drop("_previous", "_bucket")


def trail_window(rows: DataFrame, length: int = 90) -> DataFrame:
    """The last ``length`` contact points of a track up to each row, reset at cuts by the shot key."""
    pointed = rows.select(
        "shot_id", "tracklet_id", "frame_index",
        F.struct(F.rint(contact_x()).alias("x"), contact_y().alias("y")).alias("_point"),
        frame_bucket("frame_index").alias("_bucket"),
    )
    return row_frames(
        pointed, ["shot_id", "tracklet_id"], ["frame_index"], "_bucket", length - 1, 0,
        lambda w: {"trail": F.collect_list("_point").over(w.rowsBetween(-(length - 1), 0))},
    ).drop("_point", "_bucket", "_pos")


def best_per_bucket(rows: DataFrame, stride: int, per_tracklet: int, min_height: float = 0.0) -> DataFrame:
    """Best row per ``frame div stride`` by (score, height, earlier frame), then evenly spaced picks."""
    height = F.col("y2") - F.col("y1")
    best = (
        rows.filter(height >= min_height)
        .groupBy("tracklet_id", F.floor(F.col("frame_index") / stride).alias("stride_no"))
        .agg(
            F.max_by(
                F.struct("frame_index", "score", height.alias("height")),
                F.struct(F.col("score"), height, -F.col("frame_index")),
            ).alias("_best")
        )
        .select("tracklet_id", "stride_no", "_best.*")
        .withColumn("_bucket", frame_bucket("stride_no"))
    )
    placed = positions(best, ["tracklet_id"], ["stride_no"], "_bucket", "_at")
    sizes = best.groupBy("tracklet_id").agg(F.count(F.lit(1)).alias("_n"))
    steps = F.sequence(F.lit(0), F.lit(per_tracklet - 1))
    if per_tracklet > 1:
        wanted = F.transform(steps, lambda i: F.rint(i * (F.col("_n") - 1) / F.lit(float(per_tracklet - 1))).cast("bigint"))
    else:
        wanted = F.array(F.floor(F.col("_n") / 2).cast("bigint"))
    return (
        placed.join(sizes, "tracklet_id")
        .filter((F.col("_n") <= per_tracklet) | F.array_contains(wanted, F.col("_at")))
        .select("tracklet_id", "stride_no", "frame_index", "score", "height")
    )


def stride_throttle(rows: DataFrame, stride: int, block: int = FRAME_BUCKET) -> DataFrame:
    """Keep a row only ``stride`` or more frames after the last kept row of its tracklet.

    The rule is sequential, but a block of frames only depends on how many of
    its first frames are still barred (0..stride-1). Each block tabulates its
    exit for every such entry, the short tables are chained per tracklet, and
    all blocks then replay at once.
    """
    if block < stride:
        raise ValueError("a block must be at least one stride long")
    frames = (
        rows.select("tracklet_id", "frame_index", frame_bucket("frame_index", block).alias("_block"))
        .groupBy("tracklet_id", "_block")
        .agg(F.sort_array(F.collect_set("frame_index")).alias("_frames"))
    )
    start = F.col("_block") * block
    exit_of = lambda entry: F.aggregate(
        "_frames", entry, lambda free, frame: F.when(frame >= free, frame + stride).otherwise(free)
    )
    tables = frames.select(
        "tracklet_id", "_block",
        F.transform(F.sequence(F.lit(0), F.lit(stride - 1)), lambda barred: exit_of((start + barred).cast("bigint"))).alias("_exits"),
    )
    chain = tables.groupBy("tracklet_id").agg(F.sort_array(F.collect_list(F.struct("_block", "_exits"))).alias("_chain"))
    none = F.lit(0).cast("bigint")
    walked = F.aggregate(
        "_chain",
        F.struct(none.alias("free"), F.array().cast("array<struct<b:bigint,free:bigint>>").alias("entries")),
        lambda acc, row: F.struct(
            F.get(row["_exits"], F.greatest(acc["free"] - row["_block"] * block, none).cast("int")).alias("free"),
            F.concat(
                acc["entries"],
                F.array(F.struct(row["_block"].alias("b"), F.greatest(acc["free"], row["_block"] * block).alias("free"))),
            ).alias("entries"),
        ),
    )
    entries = chain.select("tracklet_id", F.explode(walked["entries"]).alias("_e")).select(
        "tracklet_id", F.col("_e.b").alias("_block"), F.col("_e.free").alias("_free")
    )
    kept = F.aggregate(
        "_frames",
        F.struct(F.col("_free").alias("free"), F.array().cast("array<bigint>").alias("kept")),
        lambda acc, frame: F.when(
            frame >= acc["free"],
            F.struct((frame + stride).alias("free"), F.concat(acc["kept"], F.array(frame)).alias("kept")),
        ).otherwise(acc),
    )
    return frames.join(entries, ["tracklet_id", "_block"]).select("tracklet_id", F.explode(kept["kept"]).alias("frame_index"))


def variant_comparison(rows: DataFrame, frames: DataFrame, variants: list[str]) -> DataFrame:
    """Per tracker variant and shot over the same frames: rows, tracklets, median boxes, empty frames.

    A variant without rows stays in as incomplete. rows(variant, shot_id, tracklet_id, frame_index), frames(shot_id, frame_index)
    """
    from trackspark.scale import exact_quantiles

    per_frame = rows.groupBy("variant", "shot_id", "frame_index").agg(F.count(F.lit(1)).alias("boxes"))
    cells = frames.groupBy("shot_id").agg(F.count(F.lit(1)).alias("frames")).withColumn("variant", F.explode(F.array(*[F.lit(x) for x in variants])))
    medians = exact_quantiles(per_frame, ["variant", "shot_id"], "boxes", {"median_boxes": 0.5})
    filled = per_frame.groupBy("variant", "shot_id").agg(F.count(F.lit(1)).alias("filled"), F.sum("boxes").alias("row_count"))
    tracks = rows.groupBy("variant", "shot_id").agg(F.count_distinct("tracklet_id").alias("tracklets"))
    joined = cells.join(filled, ["variant", "shot_id"], "left").join(tracks, ["variant", "shot_id"], "left").join(medians, ["variant", "shot_id"], "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "variant", "shot_id",
        F.coalesce("row_count", zero).alias("row_count"),
        F.coalesce("tracklets", zero).alias("tracklets"),
        "median_boxes",
        (F.col("frames") - F.coalesce("filled", zero)).alias("empty_frames"),
        F.when(F.col("row_count") > 0, "complete").otherwise("incomplete").alias("status"),
    )
