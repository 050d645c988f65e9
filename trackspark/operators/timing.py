"""Shared play clock from reviewed correspondences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.operators.calibrate import PTS_BUCKET
from trackspark.scale import adjacent_row, frame_bucket, interval_join

PLAY_ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"


def time_segments(correspondences: DataFrame) -> DataFrame:
    """Consecutive reviewed points of a (play, shot); at a knot the earlier segment owns the PTS."""
    bucketed = correspondences.withColumn("_bucket", frame_bucket("pts", PTS_BUCKET))
    keys = ["play_id", "shot_id"]
    ahead = adjacent_row(bucketed, keys, ["pts"], "_bucket", {"to_pts": "pts", "to_s": "play_time_s"}, following=True)
    behind = adjacent_row(ahead, keys, ["pts"], "_bucket", {"_before": "pts"})
    return behind.filter(F.col("to_pts").isNotNull()).select(
        *keys, F.col("pts").alias("from_pts"), F.col("play_time_s").alias("from_s"), "to_pts", "to_s",
        F.when(F.col("_before").isNull(), F.col("pts")).otherwise(F.col("pts") + 1).alias("first_pts"),
    )


def time_at(rows: DataFrame, segments: DataFrame, out: str = "play_time_s", extent: DataFrame | None = None) -> DataFrame:
    """Piecewise-linear play time, null outside the reviewed support. rows(play_id, shot_id, pts, ..)"""
    joined = interval_join(rows, segments, ["play_id", "shot_id"], "pts", "first_pts", "to_pts", PTS_BUCKET, how="left", closed=True, extent=extent)
    ratio = (F.col("pts") - F.col("from_pts")) / (F.col("to_pts") - F.col("from_pts")).cast("double")
    return joined.withColumn(out, F.col("from_s") + ratio * (F.col("to_s") - F.col("from_s"))).drop(
        "from_pts", "from_s", "to_pts", "to_s", "first_pts"
    )


def anchor_time(pts: Column, frame: Column, tb_num: Column, tb_den: Column, fps: Column) -> Column:
    """Offset from a joined anchor(source_pts, source_frame, anchor_s): by PTS, else by frame rate, else null."""
    by_pts = F.coalesce(F.col("anchor_s"), F.lit(0.0)) + (pts - F.col("source_pts")) * tb_num / tb_den
    return F.when(F.col("source_pts").isNotNull(), by_pts).otherwise((frame - F.col("source_frame")) / fps)


def play_clock(rows: DataFrame, segments: DataFrame, anchors: DataFrame, extent: DataFrame | None = None) -> DataFrame:
    """A play with a map uses only the map; one without uses its anchors.

    rows(play_id, shot_id, pts, frame_index, tb_num, tb_den, fps, ..),
    anchors(play_id, shot_id, source_pts, source_frame, anchor_s)
    """
    mapped = segments.select("play_id").distinct().withColumn("_mapped", F.lit(True))
    timed = time_at(rows, segments, "_map_s", extent).join(mapped, "play_id", "left").join(anchors, ["play_id", "shot_id"], "left")
    by_anchor = anchor_time(F.col("pts"), F.col("frame_index"), F.col("tb_num"), F.col("tb_den"), F.col("fps"))
    return timed.select(
        *rows.columns,
        F.when(F.col("_mapped"), F.col("_map_s")).otherwise(by_anchor).alias("play_time_s"),
        F.when(F.col("_mapped"), "play-time-map").otherwise("legacy-anchor-offset").alias("time_map_id"),
    )


def validate_clock(checks: DataFrame, segments: DataFrame, max_residual_ms: float = 50.0) -> DataFrame:
    """Held-out residuals per play; a check outside support or a large residual fails the gate."""
    timed = time_at(checks.withColumnRenamed("play_time_s", "_true"), segments, "_predicted")
    residual = F.abs(F.col("_predicted") - F.col("_true")) * 1000.0
    report = timed.groupBy("play_id").agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("_predicted").isNull()).alias("missing"),
        F.max(residual).alias("max_residual_ms"),
    )
    gate = (F.col("missing") == 0) & (F.col("max_residual_ms") <= max_residual_ms)
    return report.withColumn("gate", F.coalesce(gate, F.lit(False))).withColumn("status", F.when(F.col("gate"), "valid").otherwise("invalid"))


def alignment_violations(
    plays: DataFrame, anchors: DataFrame, correspondences: DataFrame, checks: DataFrame, ranges: DataFrame
) -> DataFrame:
    """(play_id, rule) for every broken rule of a reviewed alignment.

    plays(play_id), anchors(play_id, shot_id, source_frame), correspondences/checks(play_id, shot_id, pts,
    play_time_s, event), ranges(play_id, shot_id, start_frame, end_frame)
    """
    out = lambda df, rule: df.select("play_id", F.lit(rule).alias("rule")).distinct()
    keys = ["play_id", "shot_id"]
    found = [out(plays.filter(~F.col("play_id").rlike(PLAY_ID_PATTERN)), "unsafe_play_id")]
    repeated = plays.groupBy("play_id").agg(F.count(F.lit(1)).alias("n"))
    found.append(out(repeated.filter("n > 1"), "duplicate_play_id"))
    anchor_counts = anchors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    per_play = anchor_counts.groupBy("play_id").agg(F.count(F.lit(1)).alias("shots"))
    found.append(out(plays.join(per_play, "play_id", "left").filter(F.coalesce("shots", F.lit(0)) < 2), "fewer_than_two_anchors"))
    found.append(out(anchor_counts.filter("n > 1"), "duplicate_anchor"))
    per_shot = correspondences.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event").alias("events"))
    found.append(out(per_shot.filter("n < 2"), "fewer_than_two_correspondences"))
    found.append(out(per_shot.filter("events < n"), "duplicate_event"))
    near = adjacent_row(
        correspondences.withColumn("_bucket", frame_bucket("pts", PTS_BUCKET)), keys, ["pts", "play_time_s"], "_bucket",
        {"_pts": "pts", "_s": "play_time_s"},
    )
    found.append(out(near.filter((F.col("_pts") == F.col("pts")) | (F.col("play_time_s") <= F.col("_s"))), "not_increasing"))
    for rows, rule in ((correspondences, "event_sets_differ"), (checks, "check_event_sets_differ")):
        shots = rows.groupBy("play_id").agg(F.count_distinct("shot_id").alias("shots"))
        spread = rows.groupBy("play_id", "event").agg(F.count_distinct("shot_id").alias("seen")).join(shots, "play_id")
        found.append(out(spread.filter("seen < shots"), rule))
    checked = checks.select("play_id").distinct()
    mapped_shots = correspondences.select(*keys).distinct().join(checked, "play_id", "left_semi")
    check_shots = checks.select(*keys).distinct()
    uncovered = mapped_shots.join(check_shots, keys, "left_anti").unionByName(check_shots.join(mapped_shots, keys, "left_anti"))
    found.append(out(uncovered, "checks_do_not_cover_shots"))
    found.append(out(checks.join(correspondences, [*keys, "event"], "left_semi"), "check_not_held_out"))
    twice = lambda fields, rule: out(checks.groupBy(*keys, *fields).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), rule)
    found += [twice(["event"], "duplicate_check_event"), twice(["pts"], "duplicate_check_pts")]
    found.append(out(ranges.filter((F.col("start_frame") < 0) | (F.col("end_frame") <= F.col("start_frame"))), "invalid_range"))
    found.append(out(ranges.join(anchors, keys, "left_anti"), "range_without_anchor"))
    found.append(out(correspondences.join(anchors, keys, "left_anti"), "correspondence_without_anchor"))
    inside = (F.col("source_frame") >= F.col("start_frame")) & (F.col("source_frame") < F.col("end_frame"))
    found.append(out(anchors.join(ranges, keys).filter(~inside), "anchor_outside_range"))
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def anchor_shot_violations(anchors: DataFrame, shots: DataFrame) -> DataFrame:
    """Anchors outside the source or inside another shot than they name.

    anchors(source_id, play_id, shot_id, source_frame), shots(source_id, shot_id, start_frame, end_frame)
    """
    from trackspark.operators.shots import shot_of_frame

    located = shot_of_frame(
        anchors.select("source_id", "play_id", F.col("shot_id").alias("named_shot"), F.col("source_frame").alias("frame_index")), shots
    ).select("source_id", "play_id", "named_shot", "frame_index", F.col("shot_id").alias("actual_shot"))
    base = anchors.select("source_id", "play_id", F.col("shot_id").alias("named_shot"), F.col("source_frame").alias("frame_index"))
    joined = base.join(located, ["source_id", "play_id", "named_shot", "frame_index"], "left")
    return joined.select(
        "source_id", "play_id", "named_shot", "actual_shot",
        F.when(F.col("actual_shot").isNull(), "outside_source").otherwise("wrong_shot").alias("rule"),
    ).filter(F.col("actual_shot").isNull() | (F.col("actual_shot") != F.col("named_shot")))
