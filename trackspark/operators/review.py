"""Review queue, nearest rows, greedy picks and proposal rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions.scalars import review_item_id
from trackspark.scale import frame_bucket, interval_join, positions, row_frames

NEAREST_S = 0.1
TIME_WIDTH_S = 64.0


def nearest_rows(targets: DataFrame, rows: DataFrame, keys: list[str], tolerance_s: float = NEAREST_S) -> DataFrame:
    """Row nearest each target play time within the tolerance, ties to the lower frame.

    targets(*keys, tracklet_id, target_s), rows(tracklet_id, frame_index, pts, play_time_s)
    """
    spans = targets.select(
        *keys, "tracklet_id", "target_s", (F.col("target_s") - tolerance_s - 1e-9).alias("_from"), (F.col("target_s") + tolerance_s + 1e-9).alias("_to")
    )
    timed = rows.filter("play_time_s is not null").select("tracklet_id", "frame_index", "pts", F.col("play_time_s").alias("_at"))
    near = interval_join(timed, spans, ["tracklet_id"], "_at", "_from", "_to", TIME_WIDTH_S, closed=True)
    near = near.withColumn("_gap", F.abs(F.col("_at") - F.col("target_s"))).filter(F.col("_gap") <= tolerance_s)
    return near.groupBy(*keys, "tracklet_id", "target_s").agg(
        F.min_by(F.struct("frame_index", "pts", F.col("_at").alias("play_time_s")), F.struct("_gap", "frame_index")).alias("row")
    )


def middle_rows(rows: DataFrame) -> DataFrame:
    """Row number ``n div 2`` of each tracklet by frame."""
    bucketed = rows.select("tracklet_id", "frame_index", "pts", "play_time_s", frame_bucket("frame_index").alias("_bucket"))
    placed = positions(bucketed, ["tracklet_id"], ["frame_index", "pts"], "_bucket", "_no")
    sizes = rows.groupBy("tracklet_id").agg(F.count(F.lit(1)).alias("_n"))
    return placed.join(sizes, "tracklet_id").filter(F.col("_no") == F.floor(F.col("_n") / 2)).select(
        "tracklet_id", F.struct("frame_index", "pts", "play_time_s").alias("row")
    )


def _priority(kind: Column, has_link: Column, has_evidence: Column) -> tuple[Column, Column]:
    """Heuristic priority in [0, 1] with its sorted reasons."""
    c = F.col
    value = F.when(kind == "ambiguous", 0.92).when(kind == "accepted", 0.72).when(kind == "unmatched", 0.52).otherwise(0.28)
    margin, score, rank = c("ambiguity_margin"), c("link_score"), c("review_rank_score")
    value = value + F.when(margin.isNotNull(), 0.2 * (1.0 - F.least(F.lit(1.0), margin / 0.5))).otherwise(0.0)
    value = value + F.when(score.isNotNull(), 0.1 * (1.0 - F.abs(score - 0.65) / 0.65)).otherwise(0.0)
    value = value + F.when(has_evidence & rank.isNotNull(), 0.15 * rank).otherwise(0.0)
    conflict = has_evidence & F.coalesce("reviewed_jersey_conflict", F.lit(False))
    value = F.when(conflict, F.greatest(value, F.lit(0.96))).otherwise(value)
    blank = {
        "left_team": F.coalesce(c("left_team") == "unknown", F.lit(True)),
        "right_team": F.coalesce(c("right_team") == "unknown", F.lit(True)),
        "paired_sample_count": F.coalesce(c("paired_sample_count") == 0, F.lit(True)),
        "combined_uncertainty_yards": F.coalesce(c("combined_uncertainty_yards") == 0, F.lit(True)),
    }
    count = sum((b.cast("int") for b in list(blank.values())[1:]), blank["left_team"].cast("int"))
    value = value + F.when(has_evidence & (count > 0), F.least(F.lit(0.08), 0.02 * count)).otherwise(0.0)
    short = has_evidence & F.coalesce(c("overlap_span_s") < 1.0, F.lit(False))
    value = value + F.when(short, 0.03).otherwise(0.0)
    reasons = F.array_compact(F.array(
        F.when(kind == "ambiguous", "assignment_ambiguity").when(kind == "accepted", "accepted_link_needs_audit")
        .when(kind == "unmatched", "unmatched_tracklet").otherwise("candidate_rejection"),
        F.when(margin < 0.1, "low_assignment_margin"),
        F.when(has_link, c("link_reason")),
        F.when(has_evidence & rank.isNotNull(), "multi_cue_review_rank"),
        F.when(conflict, "reviewed_jersey_conflict"),
        *[F.when(has_evidence & b, f"missing_{name}") for name, b in blank.items()],
        F.when(short, "short_overlap"),
        F.when(has_evidence, c("evidence_reason")),
    ))
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 6), F.array_sort(F.array_distinct(reasons))


def review_queue(links: DataFrame, evidence: DataFrame, rows: DataFrame, max_items: int | None = 100, samples_per_pair: int = 3) -> DataFrame:
    """Ordered review items per play: every pair with a link or evidence, and every unmatched tracklet.

    ``max_items`` of None emits all; each item carries its play's total and emitted count. A side of a sample without
    a row says why, but for unmatched tracklets, which are shown by their middle row.

    links(play_id, left_key, right_key, decision, score, alternative_score, ambiguity_margin, rejection_reason and, if
    there, evidence_keys array<string>),
    evidence as from ``pair_evidence``, rows(tracklet_id, frame_index, pts, play_time_s)
    """
    key = ["play_id", "left_key", "right_key"]
    no_keys = F.array().cast("array<string>")
    linked = links.select(
        *key, "decision", F.col("score").alias("link_score"), "alternative_score", "ambiguity_margin", F.col("rejection_reason").alias("link_reason"), F.lit(True).alias("_linked"),
        (F.col("evidence_keys") if "evidence_keys" in links.columns else no_keys).alias("evidence_keys"),
    )
    known = evidence.select(
        *key, "eligible", F.col("score").alias("evidence_score"), "review_rank_score", "reviewed_jersey_conflict", "left_team", "right_team",
        "paired_sample_count", "combined_uncertainty_yards", "overlap_start_s", "overlap_end_s", "overlap_span_s",
        F.col("rejection_reason").alias("evidence_reason"), F.lit(True).alias("_known"),
    )
    pairs = linked.filter("right_key is not null").join(known, key, "full")
    alone = linked.filter("right_key is null")
    items = pairs.unionByName(alone, allowMissingColumns=True)
    has_link, has_evidence = F.coalesce("_linked", F.lit(False)), F.coalesce("_known", F.lit(False))
    kind = (
        F.when(F.col("right_key").isNull(), "unmatched").when(F.col("decision") == "same", "accepted").when(F.col("decision") == "different", "rejected")
        .when(F.col("decision") == "insufficient_evidence", "ambiguous").when(has_evidence & ~F.coalesce("eligible", F.lit(False)), "rejected").otherwise("ambiguous")
    )
    items = items.withColumn("kind", kind)
    priority, reasons = _priority(F.col("kind"), has_link, has_evidence)
    unmatched_default = F.when(F.col("right_key").isNull(), "insufficient_evidence").otherwise("candidate")
    rank_or_score = F.when(F.coalesce("review_rank_score", F.lit(0.0)) != 0.0, F.col("review_rank_score")).otherwise(F.col("evidence_score"))
    items = items.select(
        *key, "kind", F.coalesce("decision", unmatched_default).alias("decision"), priority.alias("priority"), reasons.alias("priority_reasons"),
        F.coalesce("link_score", rank_or_score).alias("score"), "alternative_score", "ambiguity_margin",
        F.coalesce("link_reason", "evidence_reason").alias("rejection_reason"), F.coalesce("evidence_keys", no_keys).alias("evidence_keys"),
        F.lit("unreviewed").alias("review_status"), F.when(has_evidence, F.struct(
            "eligible", F.col("evidence_score").alias("score"), "review_rank_score", "left_team", "right_team", "paired_sample_count",
            "combined_uncertainty_yards", "overlap_start_s", "overlap_end_s", "overlap_span_s", F.col("evidence_reason").alias("rejection_reason"),
        )).alias("evidence"),
        review_item_id(F.col("play_id"), F.col("left_key"), F.col("right_key"), F.col("kind")).alias("review_item_id"),
        "overlap_start_s", "overlap_end_s",
    )
    # ordered before any sample is looked up: only emitted items need samples
    order = Window.partitionBy("play_id").orderBy(F.desc("priority"), "left_key", F.coalesce("right_key", F.lit("")), "review_item_id")
    total = F.count(F.lit(1)).over(Window.partitionBy("play_id"))
    emitted = F.col("total_item_count") if max_items is None else F.least("total_item_count", F.lit(max_items).cast("bigint"))
    top = items.withColumns({"queue_no": F.row_number().over(order), "total_item_count": total}).withColumn("emitted_item_count", emitted)
    if max_items is not None:
        top = top.filter(F.col("queue_no") <= max_items)
    return top.join(_queue_samples(top, rows, samples_per_pair), "review_item_id", "left")


def _queue_samples(top: DataFrame, rows: DataFrame, samples_per_pair: int) -> DataFrame:
    start, end = F.col("overlap_start_s"), F.col("overlap_end_s")
    count = F.least(F.lit(samples_per_pair), F.greatest(F.lit(1), F.floor((end - start) / 0.2).cast("int") + 1))
    times = F.when(count == 1, F.array((start + end) / 2.0)).otherwise(
        F.transform(F.sequence(F.lit(0), count - 1), lambda i: start + (end - start) * i / (count - 1))
    )
    timed = F.when(start.isNotNull() & end.isNotNull() & (end >= start), times)
    wanted = top.select("review_item_id", "left_key", "right_key", F.posexplode_outer(timed).alias("_no", "target_s"))
    wanted = wanted.withColumn("_no", F.coalesce("_no", F.lit(0)))
    ends = wanted.select(
        "review_item_id", "_no", "target_s", F.explode(F.array(
            F.struct(F.lit("left").alias("side"), F.col("left_key").alias("tracklet_id")), F.struct(F.lit("right").alias("side"), F.col("right_key").alias("tracklet_id"))
        )).alias("_s")
    ).select("review_item_id", "_no", "target_s", "_s.side", "_s.tracklet_id").filter("tracklet_id is not null")
    by_time = nearest_rows(ends.filter("target_s is not null"), rows, ["review_item_id", "_no", "side"]).select("review_item_id", "_no", "side", "row")
    by_middle = ends.filter("target_s is null").join(middle_rows(rows), "tracklet_id").select("review_item_id", "_no", "side", "row")
    found = by_time.unionByName(by_middle).groupBy("review_item_id", "_no").agg(
        F.max(F.when(F.col("side") == "left", F.col("row"))).alias("left"), F.max(F.when(F.col("side") == "right", F.col("row"))).alias("right")
    )
    seen = rows.select("tracklet_id").distinct()
    has = lambda side: seen.select(F.col("tracklet_id").alias(f"{side}_key"), F.lit(True).alias(f"_{side}_seen"))
    why = lambda side: F.when(F.col("right_key").isNotNull() & F.col(side).isNull(), F.when(
        F.col(f"_{side}_seen"), "no_observation_within_time_tolerance").otherwise("no_tracklet_observations")).alias(f"{side}_missing_reason")
    known = wanted.join(has("left"), "left_key", "left").join(has("right"), "right_key", "left")
    full = known.join(found, ["review_item_id", "_no"], "left").select(
        "review_item_id", "_no", "right_key",
        F.struct(F.col("target_s").alias("requested_play_time_s"), "left", "right", why("left"), why("right")).alias("sample"),
    )
    listed = full.groupBy("review_item_id").agg(  # at most ``samples_per_pair`` entries
        F.sort_array(F.collect_list(F.struct("_no", "sample"))).alias("_all"), F.first("right_key").alias("_right")
    )
    same = lambda a, b: a["sample"]["left"]["frame_index"].eqNullSafe(b["sample"]["left"]["frame_index"]) & a["sample"]["right"]["frame_index"].eqNullSafe(b["sample"]["right"]["frame_index"])
    unique = F.filter("_all", lambda a: ~F.exists("_all", lambda b: (b["_no"] < a["_no"]) & same(a, b)))
    samples = F.transform(unique, lambda a: a["sample"])
    available = F.when(F.col("_right").isNull(), F.exists("samples", lambda s: s["left"].isNotNull())).otherwise(
        F.exists("samples", lambda s: s["left"].isNotNull() & s["right"].isNotNull())
    )
    return listed.withColumn("samples", samples).select("review_item_id", "samples", available.alias("source_frames_available"))


# --- greedy picks ----------------------------------------------------------

def separated_top(scores: DataFrame, keys: list[str], min_gap_frames: int, picks: int = 8) -> DataFrame:
    """Highest scores first, dropping rows closer than ``min_gap_frames`` to a taken one, up to ``picks``.

    Rows of one frame bar each other, so the best of a frame stands for it. A pick then
    bars fewer than ``2 * gap`` rows and the first ``picks * 2 * gap`` rows by score hold
    every pick; map tasks cut to that many.
    """
    enough = picks * max(1, 2 * min_gap_frames)
    window = Window.partitionBy(*keys).orderBy(F.desc("score"), "frame_index")
    rows = scores.select(*keys, "score", "frame_index")
    if min_gap_frames > 0:
        rows = rows.groupBy(*keys, "frame_index").agg(F.max("score").alias("score"))
    best = rows.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= enough)
    listed = best.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_rank", "frame_index", "score"))).alias("_rows"))
    empty = F.array().cast("array<struct<_rank:int,frame_index:bigint,score:double>>")
    taken = F.aggregate(
        "_rows", empty,
        lambda acc, row: F.when(
            (F.size(acc) < picks) & ~F.exists(acc, lambda t: F.abs(t["frame_index"] - row["frame_index"]) < min_gap_frames),
            F.concat(acc, F.array(row)),
        ).otherwise(acc),
    )
    return listed.select(*keys, F.posexplode(taken).alias("pick_no", "_p")).select(*keys, "pick_no", "_p.frame_index", "_p.score")


def motion_bursts(motion: DataFrame, reach: int = 4) -> DataFrame:
    """Burst strength of each frame over its neighbourhood; strict local minima are skipped.

    motion(source_id, frame_index, p95, mean, camera_motion); ``camera`` marks camera-motion keyframe rows.
    """
    from trackspark.operators.shots import neighbour_median

    rows = row_frames(
        motion.withColumn("_bucket", frame_bucket("frame_index")), ["source_id"], ["frame_index"], "_bucket", reach, reach,
        lambda w: {
            "_base": neighbour_median(w, "p95", reach), "_camera_base": neighbour_median(w, "camera_motion", reach),
            "_before": F.lag("p95").over(w), "_after": F.lead("p95").over(w),
        },
    )
    strength = F.greatest(F.lit(0.0), F.col("p95") - F.col("_base")) / F.greatest(F.lit(0.25), F.col("_base"))
    dip = F.coalesce((F.col("p95") < F.col("_before")) & (F.col("p95") < F.col("_after")), F.lit(False))
    return rows.select(
        "source_id", "frame_index", "p95", "mean", "camera_motion", strength.alias("score"), dip.alias("dip"),
        (F.col("camera_motion") > F.greatest(F.lit(0.5), F.col("_camera_base") * 1.5)).alias("camera"),
    )


def burst_proposals(bursts: DataFrame, fps: float, min_separation_s: float = 0.5, picks: int = 8, ranges: DataFrame | None = None) -> DataFrame:
    """Separated motion bursts and camera keyframes with a half-second window on each side.

    Windows are clipped to the frames asked for, ranges(source_id, start_frame, end_frame), even where no motion was
    measured there; a source without a range is clipped to the frames it has.
    """
    gap, radius = round(min_separation_s * fps), round(0.5 * fps)
    span = bursts.groupBy("source_id").agg(F.min("frame_index").alias("_lo"), (F.max("frame_index") + 1).alias("_hi"))
    if ranges is not None:
        asked = ranges.groupBy(F.col("source_id").cast("string").alias("_asked")).agg(F.min("start_frame").alias("_from"), F.max("end_frame").alias("_to"))
        span = span.join(asked, F.col("source_id").cast("string") == F.col("_asked"), "left").select("source_id", F.coalesce("_from", "_lo").alias("_lo"), F.coalesce("_to", "_hi").alias("_hi"))
    burst = separated_top(bursts.filter("not dip"), ["source_id"], gap, picks).withColumn("kind", F.lit("motion_burst"))
    camera = separated_top(
        bursts.filter("camera").withColumn("score", F.col("camera_motion")), ["source_id"], gap, picks
    ).withColumn("kind", F.lit("camera_motion_keyframe_candidate"))
    return burst.unionByName(camera).join(span, "source_id").select(
        "source_id", "kind", "pick_no", "frame_index", F.round("score", 4).alias("score"),
        F.greatest(F.col("_lo"), F.col("frame_index") - radius).alias("window_start_frame"),
        F.least(F.col("_hi"), F.col("frame_index") + radius + 1).alias("window_end_frame"),
    )


def longest_segments(segments: DataFrame, limit: int = 100) -> DataFrame:
    """Longest line segments per frame, ties by coordinates. segments(source_id, frame_index, x1, y1, x2, y2)"""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    window = Window.partitionBy("source_id", "frame_index").orderBy(F.desc("length"), "x1", "y1", "x2", "y2")
    return segments.withColumn("length", F.sqrt(dx * dx + dy * dy)).withColumn("line_no", F.row_number().over(window) - 1).filter(F.col("line_no") < limit)


def line_intersections(lines: DataFrame, width: float, height: float) -> DataFrame:
    """Crossings of line pairs of one frame (at most 100 lines a frame) with their support score."""
    a = lines.select("source_id", "frame_index", F.col("line_no").alias("first_line"), *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")])
    b = lines.select("source_id", "frame_index", F.col("line_no").alias("second_line"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    c = F.col
    adx, ady, bdx, bdy = c("a_x2") - c("a_x1"), c("a_y2") - c("a_y1"), c("b_x2") - c("b_x1"), c("b_y2") - c("b_y1")
    joined = a.join(b, ["source_id", "frame_index"]).filter("first_line < second_line").select(
        "*", adx.alias("adx"), ady.alias("ady"), bdx.alias("bdx"), bdy.alias("bdy"),
        F.sqrt(adx * adx + ady * ady).alias("al"), F.sqrt(bdx * bdx + bdy * bdy).alias("bl"), (adx * bdy - ady * bdx).alias("cross"),
    ).filter((c("al") >= 1) & (c("bl") >= 1) & (F.abs("cross") >= 0.25 * c("al") * c("bl")))
    dx, dy = c("b_x1") - c("a_x1"), c("b_y1") - c("a_y1")
    met = joined.withColumn("t", (dx * c("bdy") - dy * c("bdx")) / c("cross")).withColumn("u", (dx * c("ady") - dy * c("adx")) / c("cross"))
    met = met.filter(c("t").between(-0.15, 1.15) & c("u").between(-0.15, 1.15))
    met = met.withColumn("x", c("a_x1") + c("t") * c("adx")).withColumn("y", c("a_y1") + c("t") * c("ady"))
    inside = (c("x") >= 4) & (c("x") < width - 4.0) & (c("y") >= 4) & (c("y") < height - 4.0)
    support = F.least("al", "bl") * (0.5 + 0.5 * F.abs("cross") / (c("al") * c("bl")))
    return met.filter(inside).select("source_id", "frame_index", "first_line", "second_line", "x", "y", support.alias("support"))


def suppress_points(points: DataFrame, radius: float = 12.0, limit: int = 200) -> DataFrame:
    """Strongest points first, dropping ones within ``radius`` of a kept (3-place) point, up to ``limit`` per frame.

    A frame has at most 4,950 crossings (100 lines), so its list is small by construction.
    """
    keys = ["source_id", "frame_index"]
    listed = points.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("support")).alias("o"), "x", "y", "first_line", "second_line"))).alias("_rows")
    )
    empty = F.array().cast("array<struct<kx:double,ky:double,support:double,first_line:int,second_line:int>>")
    taken = F.aggregate(
        "_rows", empty,
        lambda acc, p: F.when(
            (F.size(acc) < limit) & ~F.exists(acc, lambda k: (k["kx"] - p["x"]) * (k["kx"] - p["x"]) + (k["ky"] - p["y"]) * (k["ky"] - p["y"]) < radius * radius),
            F.concat(acc, F.array(F.struct(
                F.bround(p["x"], 3).alias("kx"), F.bround(p["y"], 3).alias("ky"), F.bround(-p["o"], 3).alias("support"), p["first_line"].alias("first_line"), p["second_line"].alias("second_line"),
            ))),
        ).otherwise(acc),
    )
    return listed.select(*keys, F.posexplode(taken).alias("point_no", "_p")).select(*keys, "point_no", "_p.*")


def review_pack_rows(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Observation proposals on selected frames with their contact point. wanted(source_id, frame_index)"""
    return rows.join(wanted, ["source_id", "frame_index"], "left_semi").select(
        "source_id", "frame_index", "tracklet_id", "x1", "y1", "x2", "y2", F.coalesce("detection_score", F.lit(0.0)).alias("detection_score"),
        F.coalesce("team", F.lit("unknown")).alias("team_suggestion"), F.coalesce("team_score", F.lit(0.0)).alias("team_score"),
        F.bround((F.col("x1") + F.col("x2")) / 2.0, 3).alias("contact_x"), F.col("y2").alias("contact_y"), F.lit("unreviewed").alias("review_status"),
    )


def digit_words(words: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """One- and two-digit numbers of recognised words, best confidence per crop and number.

    words(crop_id, text, conf string or double in percent)
    """
    tokens = words.select("crop_id", (F.col("conf").try_cast("double") / 100.0).alias("confidence"), F.expr(r"regexp_extract_all(text, '(?<!\\d)\\d{1,2}(?!\\d)', 0)").alias("_t"))
    kept = tokens.filter(F.col("confidence").between(0.0, 1.0) & (F.col("confidence") >= min_confidence))
    return kept.select("crop_id", "confidence", F.explode("_t").alias("_w")).groupBy("crop_id", F.col("_w").cast("int").alias("number")).agg(
        F.bround(F.max("confidence"), 4).alias("confidence")
    )
