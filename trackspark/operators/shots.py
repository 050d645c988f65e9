"""Shots: ranges, lookups, cut scouting, play windows, even samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.scale import FRAME_BUCKET, adjacent_row, frame_bucket, interval_join, positions, row_frames


def shot_ranges(boundaries: DataFrame, frame_counts: DataFrame) -> DataFrame:
    """Half-open ranges per source from distinct starts in ``[0, frame_count)``; frame 0 always starts one.

    boundaries(source_id, frame_index), frame_counts(source_id, frame_count)
    """
    starts = (
        boundaries.join(frame_counts, "source_id")
        .filter((F.col("frame_index") >= 0) & (F.col("frame_index") < F.col("frame_count")))
        .select("source_id", F.col("frame_index").alias("start_frame"))
        .union(frame_counts.filter("frame_count > 0").select("source_id", F.lit(0).cast("bigint")))
        .distinct()
        .withColumn("_bucket", frame_bucket("start_frame"))
    )
    starts = positions(starts, ["source_id"], ["start_frame"], "_bucket", "shot_no")
    ends = adjacent_row(starts, ["source_id"], ["start_frame"], "_bucket", {"_next": "start_frame"}, following=True)
    return ends.join(frame_counts, "source_id").select(
        "source_id",
        F.concat(F.lit("shot-"), F.col("shot_no").cast("string")).alias("shot_id"),
        "shot_no",
        "start_frame",
        F.coalesce("_next", "frame_count").alias("end_frame"),
    )


def shot_of_frame(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """As-of shot of each row; rows(source_id, frame_index, ..)."""
    spans = ranges.select("source_id", F.col("shot_id").alias("shot_id"), "start_frame", "end_frame")
    return interval_join(rows, spans, ["source_id"], "frame_index", "start_frame", "end_frame", FRAME_BUCKET).drop(
        "start_frame", "end_frame"
    )


def declared_shot_of_frame(rows: DataFrame, declared: DataFrame, ranges: DataFrame, key: list[str]) -> DataFrame:
    """One declared range wins, none falls back to the as-of shot, several are an error row.

    declared(source_id, shot_id, start_frame, end_frame); ``key`` identifies a row.
    """
    spans = declared.select(
        "source_id", F.col("shot_id").alias("_declared"), F.col("start_frame").alias("_s"), F.col("end_frame").alias("_e")
    )
    hits = (
        interval_join(rows, spans, ["source_id"], "frame_index", "_s", "_e", FRAME_BUCKET)
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_hits"), F.min("_declared").alias("_declared"))
    )
    base = shot_of_frame(rows, ranges).withColumnRenamed("shot_id", "_asof")
    joined = base.join(hits, key, "left")
    return joined.select(
        *[c for c in base.columns if c != "_asof"],
        F.when(F.col("_hits") == 1, F.col("_declared")).when(F.col("_hits").isNull(), F.col("_asof")).alias("shot_id"),
        (F.coalesce("_hits", F.lit(0)) > 1).alias("overlapping"),
    )


def play_of_frame(rows: DataFrame, play_shots: DataFrame, extent: DataFrame | None = None) -> DataFrame:
    """play_id only for shots of the play and inside the declared range (null range = whole shot)."""
    spans = play_shots.select(
        "shot_id",
        F.col("play_id").alias("play_id"),
        F.coalesce("start_frame", F.lit(0).cast("bigint")).alias("_s"),
        F.col("end_frame").alias("_e"),
    )
    return interval_join(rows, spans, ["shot_id"], "frame_index", "_s", "_e", FRAME_BUCKET, how="left", extent=extent).drop("_s", "_e")


def scene_scores(thumbs: DataFrame) -> DataFrame:
    """Mean absolute difference of consecutive grey thumbnails over 255.

    thumbs(source_id, frame_index, pixels array<double>)
    """
    near = adjacent_row(
        thumbs.withColumn("_bucket", frame_bucket("frame_index")),
        ["source_id"], ["frame_index"], "_bucket", {"_previous": "pixels"},
    ).filter(F.col("_previous").isNotNull())
    total = F.aggregate(
        F.zip_with("_previous", "pixels", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, d: acc + d
    )
    return near.select("source_id", "frame_index", (total / F.size("pixels") / 255.0).alias("score"))


def _middle(values: Column) -> Column:
    """Median of a short array, 0 when empty."""
    ordered, n = F.sort_array(values), F.size(values)
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    return F.when(n == 0, F.lit(0.0)).otherwise((low + high) / 2.0)


def neighbour_median(w, value: str, reach: int) -> Column:
    """Median of the ``reach`` rows on each side, without the row itself."""
    left = F.collect_list(value).over(w.rowsBetween(-reach, -1))
    right = F.collect_list(value).over(w.rowsBetween(1, reach))
    return _middle(F.concat(left, right))


def local_spike_cuts(scores: DataFrame, threshold: float = 0.28, reach: int = 6) -> DataFrame:
    """Cuts where a score clears the threshold and three times its neighbourhood.

    scores(source_id, frame_index, score, manual): any manual cut of a source replaces its scene cuts.
    """
    rows = row_frames(
        scores.withColumn("_bucket", frame_bucket("frame_index")),
        ["source_id"], ["frame_index"], "_bucket", reach, reach,
        lambda w: {"baseline": neighbour_median(w, "score", reach)},
    )
    has_manual = scores.groupBy("source_id").agg(F.bool_or("manual").alias("_has_manual"))
    spike = (F.col("score") >= threshold) & (F.col("score") >= F.greatest(F.col("baseline") * 3.0, F.lit(0.04)))
    return (
        rows.join(has_manual, "source_id")
        .filter(F.when(F.col("_has_manual"), F.col("manual")).otherwise(spike))
        .select(
            "source_id", "frame_index",
            F.when(F.col("_has_manual"), "manual").otherwise("scene").alias("reason"),
            F.when(F.col("_has_manual"), 1.0).otherwise(F.least(F.col("score"), F.lit(1.0))).alias("confidence"),
        )
    )


def threshold_cuts(scores: DataFrame, threshold: float = 0.28) -> DataFrame:
    """Start at 0, manual cuts, and scene cuts above the threshold; manual wins at a frame."""
    start = scores.select("source_id").distinct().select(
        "source_id", F.lit(0).cast("bigint").alias("frame_index"), F.lit("start").alias("reason"), F.lit(1.0).alias("confidence")
    )
    cuts = scores.filter((F.col("frame_index") > 0) & (F.col("manual") | (F.col("score") >= threshold))).select(
        "source_id", "frame_index",
        F.when(F.col("manual"), "manual").otherwise("scene").alias("reason"),
        F.when(F.col("manual"), 1.0).otherwise(F.least(F.col("score"), F.lit(1.0))).alias("confidence"),
    )
    return start.unionByName(cuts)


def play_windows(shots: DataFrame, max_shots: int = 4, max_seconds: float = 35.0) -> DataFrame:
    """Runs of 2..max_shots adjacent shots not longer than max_seconds, numbered per source.

    shots(source_id, shot_no, start_frame, end_frame, start_pts, end_pts, tb_num, tb_den, fps); a null
    end_pts (end of file) is timed by frame rate. A window stops growing at the first length that is too long.
    """
    first = shots.select("source_id", "shot_no", "start_frame", "start_pts", "tb_num", "tb_den", "fps")
    last = shots.select("source_id", F.col("shot_no").alias("_last"), "end_frame", "end_pts")
    sized = (
        first.withColumn("shots", F.explode(F.sequence(F.lit(2), F.lit(max_shots))))
        .withColumn("_last", F.col("shot_no") + F.col("shots") - 1)
        .join(last, ["source_id", "_last"])
        .withColumn(
            "duration_s",
            F.when(
                F.col("end_pts").isNotNull(), (F.col("end_pts") - F.col("start_pts")) * F.col("tb_num") / F.col("tb_den")
            ).otherwise((F.col("end_frame") - F.col("start_frame")) / F.col("fps")),
        )
    )
    from pyspark.sql import Window

    prefix = Window.partitionBy("source_id", "shot_no").orderBy("shots").rowsBetween(Window.unboundedPreceding, 0)
    kept = sized.withColumn("_fits", F.bool_and(F.col("duration_s") <= max_seconds).over(prefix)).filter("_fits")
    kept = kept.withColumn("_bucket", frame_bucket("shot_no", 1024))
    numbered = positions(kept, ["source_id"], ["shot_no", "shots"], "_bucket", "candidate_no")
    return numbered.select(
        "source_id",
        F.format_string("play-candidate-%06d", F.col("candidate_no")).alias("candidate_id"),
        F.col("shot_no").alias("first_shot"), F.col("_last").alias("last_shot"),
        "start_frame", "end_frame", "start_pts", "end_pts",
        F.round("duration_s", 6).alias("duration_s"),
        F.when(F.col("end_pts").isNotNull(), "source_pts").otherwise("frame_rate_to_eof_estimate").alias("duration_method"),
    )


def even_samples(ranges: DataFrame, count: int) -> DataFrame:
    """``count`` frames spread evenly over each range, ends included, duplicates removed."""
    step = F.col("_i") * (F.col("end_frame") - F.col("start_frame") - 1) / F.lit(float(max(1, count - 1)))
    return (
        ranges.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        .withColumn("source_frame", (F.col("start_frame") + F.rint(step)).cast("bigint"))
        .drop("_i")
        .distinct()
    )
