"""Scores of tracks, identities, teams and positions against reviewed truth."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions.geometry import BOX, iou
from trackspark.functions.scalars import meaningful_id, shot_of
from trackspark.operators.assignment import match_edges
from trackspark.scale import adjacent_row, exact_quantiles, frame_bucket, edge_components, fresh, last_known, one_row, positions, running_sum, spread
from trackspark.session import cut_lineage

FRAME = ["shot_id", "frame_index"]
BLOCK = ["shot_id", "_block"]
SOLVE_FRAMES = 256
MIN_PURITY = 0.75


def restrict_to_window(frames: DataFrame, start_frame: int, end_frame: int) -> DataFrame:
    """Frames of ``[start, end)``; a plain predicate, so it reaches a Parquet scan."""
    if start_frame < 0 or end_frame <= start_frame:
        raise ValueError("invalid frame window")
    return frames.filter((F.col("frame_index") >= start_frame) & (F.col("frame_index") < end_frame))


def evaluated_frames(frames: DataFrame) -> DataFrame:
    return frames.filter(F.col("labeled") & ~F.col("ignore_frame")).select(*FRAME)


def reference_edges(objects: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """(shot, frame, object, tracklet, iou) with enough overlap; the join never leaves a frame."""
    left = objects.select(*FRAME, "object_id", *[F.col(c).alias(f"r_{c}") for c in BOX])
    right = rows.select(*FRAME, "tracklet_id", *BOX)
    return (
        left.join(right, FRAME)
        .withColumn("iou", iou([f"r_{c}" for c in BOX], BOX))
        .filter(F.col("iou") >= threshold)
        .select(*FRAME, "object_id", "tracklet_id", "iou")
    )


MATCH_COLUMNS = ["shot_id", "frame_index", "object_id", "tracklet_id", "iou"]


def _solve_by_frame(weight: str):
    """Best one-to-one match of every frame in a group, over one sort of the whole group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame_index", "object_id", "tracklet_id"])  # a group holds one shot
        frames = pdf.frame_index.to_numpy()
        objects, tracks, weights = pdf.object_id.tolist(), pdf.tracklet_id.tolist(), pdf[weight].tolist()
        edges = [0, *(np.flatnonzero(frames[1:] != frames[:-1]) + 1).tolist(), len(pdf)]
        kept: list[int] = []
        for low, high in zip(edges, edges[1:]):
            kept += [low + i for i in match_edges(objects[low:high], tracks[low:high], weights[low:high])]
        return pdf[MATCH_COLUMNS].iloc[kept]

    return run


def injective_matches(edges: DataFrame) -> DataFrame:
    """One-to-one match of largest total IoU per frame.

    An edge whose both ends have no other edge is final. Only contested edges
    reach the solver, in groups of a few hundred frames.
    """
    per = lambda end: F.count(F.lit(1)).over(Window.partitionBy(*FRAME, end))
    marked = edges.withColumn("_degree", F.greatest(per("object_id"), per("tracklet_id")))
    final = marked.filter("_degree = 1").drop("_degree")
    contested = marked.filter("_degree > 1").drop("_degree").withColumn("_bucket", frame_bucket("frame_index", SOLVE_FRAMES))
    schema = "shot_id string, frame_index bigint, object_id string, tracklet_id string, iou double"
    solved = spread(contested, "shot_id", "_bucket").groupBy("shot_id", "_bucket").applyInPandas(_solve_by_frame("iou"), schema)
    return final.unionByName(solved)


def matches(objects: DataFrame, rows: DataFrame, frames: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Matches over labelled, not ignored frames."""
    scored = evaluated_frames(frames)
    return injective_matches(reference_edges(objects.join(scored, FRAME, "left_semi"), rows, threshold))


def reference_votes(matched: DataFrame) -> DataFrame:
    return matched.groupBy("tracklet_id", "object_id").agg(F.count(F.lit(1)).alias("votes"))


def dominant_objects(votes: DataFrame, min_purity: float = MIN_PURITY) -> DataFrame:
    """Most voted object per tracklet (ties to the smaller id), with its purity."""
    best = votes.groupBy("tracklet_id").agg(
        F.max("votes").alias("_top"), F.sum("votes").alias("total_votes"),
        F.min_by("object_id", F.struct(-F.col("votes"), F.col("object_id"))).alias("object_id"),
    )
    purity = F.col("_top") / F.col("total_votes")
    return best.select("tracklet_id", "object_id", "total_votes", purity.alias("purity"), (purity >= min_purity).alias("pure"))


def identity_steps(objects: DataFrame, matched: DataFrame, frames: DataFrame) -> DataFrame:
    """Each evaluated reference box with its matched track, the last earlier one, and the step flags."""
    base = objects.join(evaluated_frames(frames), FRAME, "left_semi").select(*FRAME, "object_id")
    joined = base.join(matched.select(*FRAME, "object_id", "tracklet_id"), [*FRAME, "object_id"], "left")
    joined = joined.withColumn("_bucket", frame_bucket("frame_index")).withColumn("_hit", F.col("tracklet_id").isNotNull())
    joined = cut_lineage(joined)  # the matching is read by two chained lookups
    keys = ["shot_id", "object_id"]
    known = last_known(joined, keys, ["frame_index"], "_bucket", "tracklet_id", "previous_tracklet_id")
    near = adjacent_row(known, keys, ["frame_index"], "_bucket", {"_previous_hit": "_hit"})
    seen = F.col("_hit") & F.col("previous_tracklet_id").isNotNull()
    return near.select(
        *FRAME, "object_id", "tracklet_id", "previous_tracklet_id",
        seen.alias("edge"),
        (seen & (F.col("tracklet_id") == F.col("previous_tracklet_id"))).alias("stable"),
        (seen & (F.col("tracklet_id") != F.col("previous_tracklet_id"))).alias("switched"),
        (seen & ~F.coalesce("_previous_hit", F.lit(False))).alias("resumed"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def shot_metrics(objects: DataFrame, rows: DataFrame, frames: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Diagnostic tracking metrics per shot; not the standard HOTA."""
    scored = evaluated_frames(frames)
    matched = matches(objects, rows, frames, threshold)
    steps = identity_steps(objects, matched, frames).groupBy("shot_id").agg(
        F.count(F.lit(1)).alias("ground_truth_detections"),
        F.count("tracklet_id").alias("matched_detections"),
        F.count_if("edge").alias("_edges"), F.count_if("stable").alias("_stable"),
        F.count_if("switched").alias("id_switches"), F.count_if("resumed").alias("fragmentation"),
    )
    predicted = rows.join(scored, FRAME, "left_semi").groupBy("shot_id").agg(F.count(F.lit(1)).alias("_predicted"))
    counts = scored.groupBy("shot_id").agg(F.count(F.lit(1)).alias("evaluated_frames"))
    zero = F.lit(0).cast("bigint")
    joined = frames.select("shot_id").distinct().join(counts, "shot_id", "left").join(steps, "shot_id", "left").join(predicted, "shot_id", "left")
    full = joined.select("shot_id", *[
        F.coalesce(c, zero).alias(c)
        for c in ("evaluated_frames", "ground_truth_detections", "matched_detections", "_predicted", "_edges", "_stable", "id_switches", "fragmentation")
    ]).withColumn("false_positives", F.col("_predicted") - F.col("matched_detections"))
    return with_ratios(full.withColumn(
        "AssA", F.when(F.col("_edges") > 0, F.col("_stable") / F.col("_edges")).otherwise((F.col("matched_detections") > 0).cast("double"))
    ).drop("_predicted", "_edges", "_stable"))


def with_ratios(counts: DataFrame) -> DataFrame:
    gt, hit, extra = F.col("ground_truth_detections"), F.col("matched_detections"), F.col("false_positives")
    deta = _ratio(hit, gt + extra)
    return (
        counts.withColumn("coverage", _ratio(hit, gt)).withColumn("DetA", deta)
        .withColumn("HOTA", F.sqrt(F.col("DetA") * F.col("AssA")))
        .withColumn("detection_f1", F.when(gt > 0, 2 * hit / (2 * hit + extra + (gt - hit))).otherwise(0.0))
    )


def aggregate_metrics(per_shot: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over shots; ratios recomputed, AssA weighted by matches."""
    sums = ["evaluated_frames", "ground_truth_detections", "matched_detections", "false_positives", "id_switches", "fragmentation"]
    summed = per_shot.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums], F.sum(F.col("AssA") * F.col("matched_detections")).alias("_weighted")
    )
    return with_ratios(summed.withColumn("AssA", _ratio(F.col("_weighted"), F.col("matched_detections")))).drop("detection_f1", "_weighted")


def _with_total(per_row: DataFrame, value: str) -> DataFrame:
    """Each row once for its shot and once for the total (null shot)."""
    return per_row.withColumn("shot_id", F.explode(F.array(F.col("shot_id"), F.lit(None).cast("string"))))


def contact_rows(objects: DataFrame, rows: DataFrame, frames: DataFrame, threshold: float = 0.5, min_confidence: float = 0.5) -> DataFrame:
    """Reviewed contacts of evaluated frames with the error of the matched position (null: missing or invalid)."""
    held = F.col("contact_x").isNotNull()
    sure = F.col("contact_confidence").isNull() | (F.col("contact_confidence") >= min_confidence)
    contacts = objects.filter(held & sure).join(evaluated_frames(frames), FRAME, "left_semi")
    matched = injective_matches(reference_edges(contacts, rows, threshold))
    placed = matched.join(rows.select(*FRAME, "tracklet_id", "field_x", "field_y"), [*FRAME, "tracklet_id"])
    error = F.sqrt(F.pow(F.col("field_x") - F.col("contact_x"), 2) + F.pow(F.col("field_y") - F.col("contact_y"), 2))
    return contacts.select(*FRAME, "object_id", "contact_x", "contact_y").join(
        placed.select(*FRAME, "object_id", "tracklet_id", "field_x", "field_y"), [*FRAME, "object_id"], "left"
    ).select(*FRAME, "object_id", "tracklet_id", error.alias("error_yards"))


def excluded_contacts(objects: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Reviewed contacts per shot that are too uncertain to be scored."""
    low = F.col("contact_x").isNotNull() & (F.col("contact_confidence") < min_confidence)
    return objects.groupBy("shot_id").agg(F.count_if(low).alias("excluded_low_confidence"))


def contact_report(contacts: DataFrame) -> DataFrame:
    """Position error per shot and in total (``*``), with gates."""
    contacts = cut_lineage(contacts.select("shot_id", "error_yards"))  # the matching is read by counts and percentiles
    doubled = _with_total(contacts, "error_yards").withColumn("shot_id", F.coalesce("shot_id", F.lit("*")))
    counts = doubled.groupBy("shot_id").agg(
        F.count("error_yards").alias("evaluated_contacts"), F.count_if(F.col("error_yards").isNull()).alias("invalid_or_missing")
    )
    errors = exact_quantiles(doubled, ["shot_id"], "error_yards", {"median_error_yards": 0.5, "p95_error_yards": 0.95})
    n, bad = F.col("evaluated_contacts"), F.col("invalid_or_missing")
    joined = counts.join(errors, "shot_id", "left").withColumn("valid_fraction", F.when(n > 0, n / (n + bad)))
    gated = joined.withColumn("median_at_most_1_5_yards", F.col("median_error_yards") <= 1.5).withColumn(
        "valid_fraction_at_least_0_90", F.col("valid_fraction") >= 0.9
    ).withColumn("status", F.when(n > 0, "evaluated").otherwise("not_evaluated"))
    passing = F.coalesce(F.col("median_at_most_1_5_yards") & F.col("valid_fraction_at_least_0_90"), F.lit(False))
    every = gated.filter("shot_id <> '*'").groupBy(F.lit("*").alias("shot_id")).agg(F.bool_and(passing).alias("every_shot_gate_passes"))
    return gated.join(every, "shot_id", "left")


def team_rows(objects: DataFrame, rows: DataFrame, frames: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Reviewed objects with a known team and the team of the matched track."""
    known = objects.filter(F.col("team").isNotNull() & (F.col("team") != "unknown")).join(evaluated_frames(frames), FRAME, "left_semi")
    matched = injective_matches(reference_edges(known, rows, threshold))
    labelled = matched.join(rows.select(*FRAME, "tracklet_id", F.col("team").alias("predicted_team")), [*FRAME, "tracklet_id"])
    return known.select(*FRAME, "object_id", F.col("team").alias("expected_team")).join(
        labelled.select(*FRAME, "object_id", "tracklet_id", "predicted_team"), [*FRAME, "object_id"], "left"
    )


def team_report(labelled: DataFrame) -> DataFrame:
    """Team accuracy and coverage per shot and in total (``*``), with gates.

    One pass: a row counts for its shot and for the total.
    """
    hit = F.col("tracklet_id").isNotNull()
    doubled = _with_total(labelled, "expected_team").withColumn("shot_id", F.coalesce("shot_id", F.lit("*")))
    counts = doubled.groupBy("shot_id").agg(
        F.count_if(hit).alias("assigned"),
        F.count_if(hit & F.col("predicted_team").eqNullSafe(F.col("expected_team"))).alias("correct"),
        F.count_if(~hit).alias("unknown_or_missing"),
    )
    n = F.col("assigned")
    rated = counts.withColumn("accuracy", F.when(n > 0, F.col("correct") / n)).withColumn(
        "coverage", F.when(n > 0, n / (n + F.col("unknown_or_missing")))
    )
    gated = rated.withColumn("accuracy_at_least_0_98", F.col("accuracy") >= 0.98).withColumn(
        "coverage_at_least_0_95", F.col("coverage") >= 0.95
    ).withColumn("status", F.when(n > 0, "evaluated").otherwise("not_evaluated"))
    passing = F.coalesce(F.col("accuracy_at_least_0_98") & F.col("coverage_at_least_0_95"), F.lit(False))
    every = gated.filter("shot_id <> '*'").groupBy(F.lit("*").alias("shot_id")).agg(F.bool_and(passing).alias("every_shot_gate_passes"))
    return gated.join(every, "shot_id", "left")


def truth_of_tracklets(dominant: DataFrame, global_map: DataFrame) -> DataFrame:
    """Pure tracklets with the reviewed player behind their dominant object. global_map(shot_id, object_id, global_id)"""
    pure = dominant.filter("pure").withColumn("shot_id", shot_of("tracklet_id"))
    return pure.join(global_map, ["shot_id", "object_id"]).select("tracklet_id", "shot_id", "object_id", "global_id")


def _cross_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Unordered pairs from different shots inside each key, by counting, one total row."""
    per_shot = rows.groupBy(*keys, "shot_id").agg(F.count(F.lit(1)).alias("n"))
    per_key = per_shot.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    return per_key.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("sq")) / 2), F.lit(0)).cast("bigint").alias("pairs"))


def cross_shot_report(
    identities: DataFrame, rows: DataFrame, objects: DataFrame, frames: DataFrame, global_map: DataFrame, threshold: float = 0.5
) -> DataFrame:
    """One row of cross-shot identity scores; pair totals come from counts, never from pairs.

    identities(tracklet_id, player_id), global_map(shot_id, object_id, global_id)
    """
    matched = matches(objects, rows, frames, threshold)
    dominant = cut_lineage(dominant_objects(reference_votes(matched)))  # one row per tracklet, read often
    truth = cut_lineage(truth_of_tracklets(dominant, global_map))
    owned = identities.withColumn("shot_id", shot_of("tracklet_id"))
    attributed = truth.join(identities, "tracklet_id", "left")

    covered = shared_player_state(attributed, shared_players(objects, frames, global_map)).agg(
        F.count(F.lit(1)).alias("eligible_shared_players"), F.count_if("correct").alias("correct_shared_players")
    )
    named = attributed.filter("player_id is not null")
    resolvable = _cross_pairs(attributed, ["global_id"]).withColumnRenamed("pairs", "resolvable_tracklet_pairs")
    merged = _cross_pairs(named, ["player_id"]).withColumnRenamed("pairs", "merged_pairs")
    true_merges = _cross_pairs(named, ["player_id", "global_id"]).withColumnRenamed("pairs", "true_merges")
    accepted = _cross_pairs(owned, ["player_id"]).withColumnRenamed("pairs", "_accepted")
    both_known = _cross_pairs(owned.join(truth.select("tracklet_id"), "tracklet_id", "left_semi"), ["player_id"]).withColumnRenamed("pairs", "_known")

    in_frame = rows.select("tracklet_id", "frame_index").distinct().join(owned, "tracklet_id")
    collided = (
        in_frame.groupBy("player_id", "shot_id", "frame_index").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select("player_id", "shot_id").distinct()
    )
    two_players = (
        owned.join(truth.select("tracklet_id", "global_id"), "tracklet_id").groupBy("player_id", "shot_id")
        .agg(F.count_distinct("global_id").alias("n")).filter("n > 1").select("player_id", "shot_id")
    )
    contaminated = collided.unionByName(two_players).agg(F.count_distinct("player_id").alias("contaminated_players"))
    mixed = dominant.agg(F.count_if(~F.col("pure")).alias("mixed_tracklets"))
    found = truth.agg(F.count(F.lit(1)).alias("attributed_tracklets"))
    unattributed = identities.join(truth, "tracklet_id", "left_anti").agg(F.count(F.lit(1)).alias("unattributed_tracklets"))

    row = one_row(covered, resolvable, merged, true_merges, accepted, both_known, contaminated, mixed, found, unattributed)
    row = row.withColumn("false_merges", F.col("merged_pairs") - F.col("true_merges")).withColumn(
        "accepted_unattributed_pairs", F.col("_accepted") - F.col("_known")
    )
    eligible = F.col("eligible_shared_players") > 0
    coverage = F.when(eligible, F.col("correct_shared_players") / F.col("eligible_shared_players"))
    return row.select(
        F.when(eligible, "evaluated").otherwise("not_evaluated").alias("status"),
        "attributed_tracklets", "eligible_shared_players", "correct_shared_players", coverage.alias("coverage"),
        "resolvable_tracklet_pairs", "merged_pairs", "true_merges", "false_merges",
        F.when(F.col("merged_pairs") > 0, F.col("true_merges") / F.col("merged_pairs")).alias("precision"),
        "accepted_unattributed_pairs", "contaminated_players", "mixed_tracklets", "unattributed_tracklets",
        (F.col("false_merges") == 0).alias("false_merges_zero"),
        ((F.col("contaminated_players") == 0) & (F.col("accepted_unattributed_pairs") == 0) & (F.col("mixed_tracklets") == 0)).alias("components_clean"),
        (coverage >= 0.8).alias("coverage_at_least_0_80"),
    )


def _first_pairs(rows: DataFrame, key: str, other: str, limit: int) -> DataFrame:
    """First (left, right) tracklets, left < right, of one ``key`` in two shots that do not share ``other``; null shares nothing.

    No pairs are formed to find them: five summary groups of a key tell the largest partner of any of its
    tracklets, so the first ``limit`` tracklets with a partner behind them are known, and only they are joined.
    """
    apart = lambda a, b: F.coalesce(a != b, F.lit(True))
    tops = cut_lineage(rows.groupBy(key, "shot_id", other).agg(F.max("tracklet_id").alias("top")))
    group = F.struct("shot_id", F.col(other).alias("o"), "top")
    best = lambda name, table: table.groupBy(key).agg(F.max_by(group, "top").alias(name))
    summary = best("a", tops)
    for name, near, fits in (
        ("b", "a", lambda: F.col("shot_id") != F.col("a.shot_id")),
        ("c", "b", lambda: (F.col("shot_id") != F.col("a.shot_id")) & apart(F.col(other), F.col("b.o"))),
        ("d", "a", lambda: apart(F.col(other), F.col("a.o"))),
        ("e", "d", lambda: apart(F.col(other), F.col("a.o")) & (F.col("shot_id") != F.col("d.shot_id"))),
    ):
        summary = summary.join(best(name, tops.join(summary, key).filter(F.col(near).isNotNull() & fits())), key, "left")
    shot, own = F.col("shot_id"), F.col(other)
    partner = (
        F.when((shot != F.col("a.shot_id")) & apart(own, F.col("a.o")), F.col("a.top"))
        .when(shot == F.col("a.shot_id"), F.when(apart(own, F.col("b.o")), F.col("b.top")).otherwise(F.col("c.top")))
        .otherwise(F.when(F.col("d.shot_id") != shot, F.col("d.top")).otherwise(F.col("e.top")))
    )
    first = rows.join(summary, key).filter(partner > F.col("tracklet_id")).select(
        key, F.col("tracklet_id").alias("left"), shot.alias("_ls"), own.alias("_lo")
    ).distinct().orderBy("left").limit(limit)
    right = rows.select(key, F.col("tracklet_id").alias("right"), shot.alias("_rs"), own.alias("_ro"))
    return (
        right.join(F.broadcast(first), key)  # at most ``limit`` rows
        .filter((F.col("right") > F.col("left")) & (F.col("_ls") != F.col("_rs")) & apart(F.col("_lo"), F.col("_ro")))
        .orderBy("left", "right").limit(limit)
    )


def false_merge_examples(attributed: DataFrame, limit: int = 20) -> DataFrame:
    """First ``limit`` (left, right) pairs of one player id and two reviewed players, in pair order.

    attributed(tracklet_id, shot_id, global_id, player_id)
    """
    found = _first_pairs(attributed.filter("player_id is not null"), "player_id", "global_id", limit)
    return found.select("left", "right", F.col("_lo").alias("left_player"), F.col("_ro").alias("right_player"))


def missed_link_examples(attributed: DataFrame, limit: int = 20) -> DataFrame:
    """First ``limit`` (left, right) pairs of one reviewed player in two shots without a common player id, in pair order.

    attributed(tracklet_id, shot_id, global_id, player_id); a tracklet without an id is linked with nothing
    """
    return _first_pairs(attributed, "global_id", "player_id", limit).select("left", "right", F.col("global_id").alias("player"))


def shared_players(objects: DataFrame, frames: DataFrame, global_map: DataFrame) -> DataFrame:
    """Reviewed players visible in two or more shots, whatever the detector saw."""
    visible = objects.join(evaluated_frames(frames), FRAME, "left_semi").select("shot_id", "object_id").distinct()
    return (
        global_map.filter(meaningful_id(F.col("global_id"))).join(visible, ["shot_id", "object_id"], "left_semi")
        .groupBy(F.trim("global_id").alias("global_id")).agg(F.count_distinct("shot_id").alias("shots")).filter("shots >= 2")
    )


def shared_player_state(attributed: DataFrame, shared: DataFrame) -> DataFrame:
    """(global_id, correct): found in two shots under one player id."""
    per_player = attributed.groupBy("global_id").agg(F.count_distinct("shot_id").alias("seen_shots"), F.count_distinct("player_id").alias("ids"))
    correct = F.coalesce((F.col("seen_shots") >= 2) & (F.col("ids") == 1), F.lit(False))
    return shared.join(per_player, "global_id", "left").select("global_id", correct.alias("correct"))


def missing_shared_players(attributed: DataFrame, objects: DataFrame, frames: DataFrame, global_map: DataFrame) -> DataFrame:
    """Shared players that were not found in two shots under one id."""
    return shared_player_state(attributed, shared_players(objects, frames, global_map)).filter("not correct").select("global_id")


def first_examples(rows: DataFrame, keys: list[str], order: list[str], limit: int = 20) -> DataFrame:
    """First ``limit`` rows per report in a stated order; map tasks already cut to ``limit``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("example_no", F.row_number().over(window)).filter(F.col("example_no") <= limit)


# --- standard metrics ------------------------------------------------------

ALPHAS = [round(0.05 * i, 2) for i in range(1, 20)]
EPSILON = 2.220446049250313e-16


def _frame_boxes(objects: DataFrame, rows: DataFrame, frames: DataFrame) -> DataFrame:
    """(shot, block, frame, _no, _frame, _objects, _tracks): the boxes of an evaluated frame; ``_no`` counts the block's frames with both."""
    listed = lambda df, kind, name: df.select(*FRAME, F.lit(kind).alias("_kind"), F.col(name).alias("id"), *BOX)
    marks = evaluated_frames(frames).select(*FRAME, F.lit(2).alias("_kind"))
    dealt = listed(objects, 0, "object_id").unionByName(listed(rows, 1, "tracklet_id")).unionByName(marks, allowMissingColumns=True)
    dealt = dealt.filter(F.col("shot_id").isNotNull() & F.col("frame_index").isNotNull())
    dealt = dealt.withColumn("_block", frame_bucket("frame_index", SOLVE_FRAMES)).repartition("shot_id", "_block")
    boxes = lambda kind: F.collect_list(F.when(F.col("_kind") == kind, F.struct("id", *BOX)))
    held = dealt.groupBy(*BLOCK, "frame_index").agg(F.max("_kind").alias("_kind"), boxes(0).alias("_objects"), boxes(1).alias("_tracks"))
    both = (F.size("_objects") > 0) & (F.size("_tracks") > 0)
    number = F.count_if(both).over(Window.partitionBy(*BLOCK).orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return held.filter("_kind = 2").withColumn("_no", F.when(both, number)).withColumn("_frame", F.monotonically_increasing_id())


def frame_overlaps(objects: DataFrame, rows: DataFrame, frames: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Overlapping pairs of evaluated frames, and every evaluated box once, with all that a frame alone decides.

    Boxes are dealt once, by shot and block of frames; a frame never leaves its task. ``_object`` and ``_track`` mark the row
    that stands for a box (its pair with the first box of the other side, or alone); ``iou`` is null where nothing overlaps.
    ``_share`` is the pair's part of all overlaps of its ends, ``_degree`` the larger number of their pairs. By the
    threshold, ``_open`` frames have a contested pair.
    """
    held = _frame_boxes(objects, rows, frames)
    kept = [*BLOCK, "frame_index", "_no", "_frame"]
    placed = held.select(*kept, F.posexplode_outer("_objects").alias("_i", "_o"), "_tracks")
    placed = placed.select(*kept, "_i", "_o", F.posexplode_outer("_tracks").alias("_j", "_t"))
    first = lambda at: F.coalesce(F.col(at) == 0, F.lit(True))
    pairs = placed.select(
        *kept, F.col("_o.id").alias("object_id"), F.col("_t.id").alias("tracklet_id"),
        *[F.col(f"_o.{c}").alias(f"r_{c}") for c in BOX], *[F.col(f"_t.{c}").alias(c) for c in BOX],
        (F.col("_i").isNotNull() & first("_j")).alias("_object"), (F.col("_j").isNotNull() & first("_i")).alias("_track"),
    ).withColumn("iou", iou([f"r_{c}" for c in BOX], BOX)).filter((F.col("iou") > 0) | F.col("_object") | F.col("_track"))
    pairs = pairs.withColumn("iou", F.when(F.col("iou") > 0, F.col("iou"))).drop(*BOX, *[f"r_{c}" for c in BOX])  # a filter on this form is slow
    # the number of the frame comes first: rows lie in its order already, so sorting compares few strings
    frame = Window.partitionBy("_frame", *BLOCK)
    ends = [Window.partitionBy("_frame", *BLOCK, end) for end in ("object_id", "tracklet_id")]
    near = F.col("iou") >= threshold - EPSILON
    shares = F.sum("iou").over(ends[0]) + F.sum("iou").over(ends[1]) - F.col("iou")
    return pairs.withColumn("_share", F.col("iou") / shares).withColumn("_degree", F.greatest(*[F.count("iou").over(w) for w in ends])).withColumn(
        "_rivals", F.greatest(*[F.count_if(near).over(w) for w in ends])
    ).withColumn("_open", F.max(F.when(near, F.col("_rivals")).otherwise(0)).over(frame) > 1).drop("_rivals", "_frame")


def _solve_block(pairs: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
    """Best total-score match of every frame of a block; the score is the overlap times the weight of the two ids."""
    weight = dict(zip(zip(weights.object_id, weights.tracklet_id), weights.weight))
    score = pairs.iou.to_numpy() * np.array([weight.get(key, 0.0) for key in zip(pairs.object_id, pairs.tracklet_id)], float)
    return _solve_by_frame("score")(pairs.assign(score=score)[~(score <= 0)])


def _scored_matches(pairs: DataFrame, aligned: DataFrame) -> DataFrame:
    """Best total-score match per frame over positive scores; keeps the IoU.

    A pair without a rival is matched whatever its score, as every overlap has a positive one. A block of contested frames
    meets the weights of the id pairs it holds, so its boxes are dealt out once.
    """
    schema = "shot_id string, frame_index bigint, object_id string, tracklet_id string, iou double"
    final = pairs.filter("_degree = 1").select(*MATCH_COLUMNS)
    contested = pairs.filter("_degree > 1").select(*BLOCK, "frame_index", "object_id", "tracklet_id", "iou")
    weights = contested.select(*BLOCK, "object_id", "tracklet_id").distinct().join(
        aligned.select("shot_id", "object_id", "tracklet_id", F.col("_align").alias("weight")), ["shot_id", "object_id", "tracklet_id"]
    )
    solved = spread(fresh(contested), *BLOCK).groupBy(*BLOCK).cogroup(fresh(weights).groupBy(*BLOCK)).applyInPandas(_solve_block, schema)
    return final.unionByName(solved)


def _per_shot_and_total(df: DataFrame) -> DataFrame:
    """Each per-shot row once for its shot and once for ``*``."""
    return df.withColumn("shot_id", F.explode(F.array(F.col("shot_id"), F.lit("*"))))


def id_counts(overlaps: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per pair of ids that met: common boxes, shares, and the evaluated boxes its rows stand for; one row a pair of a shot."""
    return overlaps.groupBy("shot_id", "object_id", "tracklet_id").agg(
        F.sum("_share").alias("_potential"), F.count_if(F.col("iou") >= threshold).alias("n"),
        F.count_if("_object").alias("_gt"), F.count_if("_track").alias("_tr"),
    )


def box_counts(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evaluated boxes per reference id and per tracklet."""
    per = lambda name, out: ids.groupBy("shot_id", name).agg(F.sum(out).alias(out)).filter(F.col(out) > 0)
    return per("object_id", "_gt"), per("tracklet_id", "_tr")


def hota(overlaps: DataFrame, ids: DataFrame, per_object: DataFrame, per_track: DataFrame) -> DataFrame:
    """HOTA, DetA and AssA averaged over 19 thresholds, per shot and over all shots (``*``, ids disjoint).

    overlaps as ``frame_overlaps`` gives them, ids as ``id_counts`` does
    """
    key = ["shot_id", "object_id", "tracklet_id"]
    potential = ids.filter("_potential is not null").select(*key, "_potential")
    aligned = potential.join(per_object, ["shot_id", "object_id"]).join(per_track, ["shot_id", "tracklet_id"]).withColumn(
        "_align", F.col("_potential") / (F.col("_gt") + F.col("_tr") - F.col("_potential"))
    )
    matched = _scored_matches(overlaps.filter("iou is not null"), aligned)
    alphas = F.array(*[F.lit(a) for a in ALPHAS])
    # one counter per threshold, so a match travels as one row
    counts = matched.groupBy(*key).agg(F.array(*[F.count_if(F.col("iou") >= a - EPSILON) for a in ALPHAS]).alias("_cs"))
    levels = counts.join(per_object, ["shot_id", "object_id"]).join(per_track, ["shot_id", "tracklet_id"]).select(
        "shot_id", "_gt", "_tr", F.explode(F.arrays_zip(alphas.alias("alpha"), F.col("_cs").alias("c"))).alias("_l")
    ).select("shot_id", "_gt", "_tr", F.col("_l.alpha").alias("alpha"), F.col("_l.c").alias("_c"))
    ass = levels.withColumn("_a", F.col("_c") * F.col("_c") / F.greatest(F.lit(1), F.col("_gt") + F.col("_tr") - F.col("_c")))
    per_alpha = ass.groupBy("shot_id", "alpha").agg(F.sum("_c").alias("_tp"), F.sum("_a").alias("_ass"))
    gts = per_object.groupBy("shot_id").agg(F.sum("_gt").alias("_gts"))
    trs = per_track.groupBy("shot_id").agg(F.sum("_tr").alias("_trs"))
    base = gts.join(trs, "shot_id", "full").withColumn("alpha", F.explode(alphas)).join(per_alpha, ["shot_id", "alpha"], "left")
    summed = _per_shot_and_total(base).groupBy("shot_id", "alpha").agg(
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("_tp", "_ass", "_gts", "_trs")]
    )
    det = F.col("_tp") / F.greatest(F.lit(1), F.col("_gts") + F.col("_trs") - F.col("_tp"))
    out = summed.withColumn("_det", det).withColumn("_assa", F.col("_ass") / F.greatest(F.lit(1), F.col("_tp")))
    return out.groupBy("shot_id").agg(
        F.avg(F.sqrt(F.col("_det") * F.col("_assa"))).alias("HOTA"), F.avg("_det").alias("DetA"), F.avg("_assa").alias("AssA")
    )


def _solve_sequence(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["object_id", "tracklet_id"])
    picks = match_edges(pdf.object_id.tolist(), pdf.tracklet_id.tolist(), pdf.n.astype(float).tolist())
    return pd.DataFrame({"shot_id": [pdf.shot_id.iloc[0]], "idtp": [int(pdf.n.iloc[picks].sum())]})


def idf1(ids: DataFrame, per_object: DataFrame, per_track: DataFrame) -> DataFrame:
    """Identity F1 per shot and in total: the id-to-id assignment that keeps most matched boxes of a shot.

    The assignment table has one row per id pair of a shot, not per box, and is
    solved per connected component of ids. Ids never cross shots, so the total sums the shots.
    """
    counts = ids.filter("n > 0").select("shot_id", "object_id", "tracklet_id", "n")
    grouped = edge_components(counts, ["shot_id", "object_id"], ["shot_id", "tracklet_id"])
    solved = grouped.groupBy("component").applyInPandas(_solve_sequence, "shot_id string, idtp bigint")
    tp = solved.groupBy("shot_id").agg(F.sum("idtp").alias("idtp"))
    gts = per_object.groupBy("shot_id").agg(F.sum("_gt").alias("_gts"))
    trs = per_track.groupBy("shot_id").agg(F.sum("_tr").alias("_trs"))
    per = _per_shot_and_total(gts.join(trs, "shot_id", "full").join(tp, "shot_id", "left"))
    out = per.groupBy("shot_id").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("idtp", "_gts", "_trs")])
    # IDTP / (IDTP + (IDFN + IDFP) / 2) with IDFN = gt - IDTP and IDFP = tracks - IDTP
    return out.select("shot_id", (2 * F.col("idtp") / F.greatest(F.lit(1), F.col("_gts") + F.col("_trs"))).alias("IDF1"))


#: Frames of a contested run that one task solves, frames before it that it guesses its entry from, and guesses at most.
RUN_BLOCK, RUN_WARM, RUN_STARTS = 256, 24, 8
_SOLVED = "shot_id string, run_no bigint, block bigint, entry string, leaving string, frame_index bigint, frame_no bigint, object_id string, tracklet_id string"
_SOLVED_COLUMNS = [part.split()[0] for part in _SOLVED.split(", ")]


def _state(matching: dict) -> str:
    return json.dumps(sorted(matching.items()))


def _next_matching(frame: list[tuple], previous: dict) -> list[int]:
    """Chosen edges of one frame: keeping the previous partner beats any overlap; at a run's start the last sure partner counts."""
    kept = [(previous.get(o) == t) if previous else (held == t) for o, t, _, held in frame]
    weight = [iou + 1000.0 * keep for (_, _, iou, _), keep in zip(frame, kept)]
    return match_edges([e[0] for e in frame], [e[1] for e in frame], weight)


class _BlockRun:
    """One block of a run: its frames, and in front of them a few of the block before."""

    def __init__(self, head: tuple, entry: str | None) -> None:
        self.head, self.entry = head, entry
        self.warm: list[list[tuple]] = []
        self.own: list[tuple[int, int, list[tuple]]] = []

    def entries(self) -> list[dict]:
        """Matchings that may enter: the asked one, or what every start of the frames before leads to."""
        if self.entry is not None:
            return [dict(json.loads(self.entry))]
        if not self.warm:
            return [{}]
        starts = [{}, *[{o: t} for o, t, _, _ in self.warm[0]]]
        found: dict[str, dict] = {}
        for start in starts:
            previous = start
            for frame in self.warm:
                previous = {frame[i][0]: frame[i][1] for i in _next_matching(frame, previous)}
            found.setdefault(_state(previous), previous)
            if len(found) == RUN_STARTS:
                break
        return list(found.values())

    def rows(self) -> list[tuple]:
        out = []
        for entry in self.entries():
            name, previous = _state(entry), entry
            for index, number, frame in self.own:
                picks = _next_matching(frame, previous)
                previous = {frame[i][0]: frame[i][1] for i in picks}
                out += [(*self.head, name, None, index, number, frame[i][0], frame[i][1]) for i in picks]
            out.append((*self.head, name, _state(previous), None, None, None, None))
        return out


def _solve_blocks(batches):
    """Rows sorted by run, block and frame; a task holds the rows of one block at a time."""
    columns = ["shot_id", "run_no", "block", "entry", "frame_index", "frame_no", "own", "object_id", "tracklet_id", "iou", "held"]
    block: _BlockRun | None = None
    last = None
    for batch in batches:
        out: list[tuple] = []
        for shot, run, number, entry, index, frame, own, *edge in zip(*[batch[c].tolist() for c in columns]):
            head = (shot, int(run), int(number))
            if block is None or head != block.head:
                out += block.rows() if block is not None else []
                block, last = _BlockRun(head, entry), None
            if frame != last:
                block.own.append((int(index), int(frame), [])) if own else block.warm.append([])
                last = frame
            (block.own[-1][2] if own else block.warm[-1]).append(tuple(edge))
        yield _solved(out)
    if block is not None:
        yield _solved(block.rows())


def _solved(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_SOLVED_COLUMNS).astype({c: "Int64" for c in ("run_no", "block", "frame_index", "frame_no")})


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Blocks of one run as functions from the entering to the leaving matching, applied one after another.

    An entry that a block has no answer for is asked for; the chain goes on from the block's latest answer, so later
    blocks are asked in the same round.
    """
    known: dict[int, dict[str, str]] = {}
    for block, entry, leaving in zip(pdf.block, pdf.entry, pdf.leaving):
        known.setdefault(int(block), {})[entry] = leaving
    state, out = _state({}), []
    for block in sorted(known):
        sure = state in known[block]
        out.append((pdf.shot_id.iloc[0], int(pdf.run_no.iloc[0]), block, state, sure))
        state = known[block][state] if sure else next(reversed(known[block].values()))
    return pd.DataFrame(out, columns=["shot_id", "run_no", "block", "entry", "sure"])


def solve_runs(work: DataFrame, block_frames: int = RUN_BLOCK, max_rounds: int = 100_000) -> DataFrame:
    """Matchings of contested runs, where a frame's matching depends on the one before.

    work(shot_id, run_no, frame_index, frame_no, object_id, tracklet_id, iou, held). A run is cut into blocks of
    frames. Every block tabulates which matching leaves for each matching that may enter it; the tables are chained per run,
    one row a block. Blocks that lack an entry are solved again for it, all of them at once, until every chain is
    closed. The result equals one pass over the run, and no task holds more than one block.
    """
    key = ["shot_id", "run_no", "block"]
    home = cut_lineage(work.withColumn("block", F.floor(F.col("frame_no") / block_frames).cast("bigint")))
    ahead = home.withColumn("block", F.col("block") + 1).filter(F.col("frame_no") >= F.col("block") * block_frames - RUN_WARM)
    ahead = ahead.join(home.select(*key).distinct(), key, "left_semi")
    columns = [*key, "frame_index", "frame_no", "object_id", "tracklet_id", "iou", "held"]

    def solved(rows: DataFrame) -> DataFrame:
        ordered = spread(rows, *key).sortWithinPartitions(*key, "frame_no", "object_id", "tracklet_id")
        return cut_lineage(ordered.mapInPandas(_solve_blocks, _SOLVED))

    told = solved(
        home.select(*columns, F.lit(None).cast("string").alias("entry"), F.lit(True).alias("own"))
        .unionByName(ahead.select(*columns, F.lit(None).cast("string").alias("entry"), F.lit(False).alias("own")))
    )
    for _ in range(max_rounds):
        tables = told.filter("leaving is not null").select(*key, "entry", "leaving")
        run = Window.partitionBy("shot_id", "run_no")
        tables = tables.withColumn("long", F.min("block").over(run) < F.max("block").over(run))
        chain = tables.filter("long").groupBy("shot_id", "run_no").applyInPandas(_chain, "shot_id string, run_no bigint, block bigint, entry string, sure boolean")
        chain = cut_lineage(chain.unionByName(tables.filter(~F.col("long") & (F.col("entry") == _state({}))).select(*key, "entry", F.lit(True).alias("sure"))))
        asked = chain.filter("not sure").drop("sure")
        if asked.isEmpty():
            final = told.filter("leaving is null").join(chain.drop("sure"), [*key, "entry"], "left_semi")
            return final.select("shot_id", "frame_index", "frame_no", "object_id", "tracklet_id")
        more = solved(home.join(asked, key).select(*columns, "entry", F.lit(True).alias("own")))
        told = told.unionByName(more)  # answers of earlier rounds stay where they were written
    raise RuntimeError("runs did not settle")


def clear_switches(overlaps: DataFrame, frames: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Identity switches and fragmentations by the CLEAR rule, per shot and in total.

    A frame's matching depends on the previous one only while edges are
    contested. Frames without a contested edge are decided on their own and cut
    the rest into independent runs, which are solved in blocks. overlaps as ``frame_overlaps`` gives them, of this threshold
    """
    before = Window.partitionBy("shot_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    held = overlaps.groupBy(*BLOCK).agg((F.coalesce(F.max("_no"), F.lit(-1)) + 1).alias("_held"))
    starts = cut_lineage(held.select(*BLOCK, F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_start")))  # one row a block
    numbered = overlaps.filter("_no is not null").join(starts, BLOCK).withColumn("frame_no", F.col("_start") + F.col("_no"))
    edges = numbered.filter(F.col("iou") >= threshold - EPSILON)
    final = edges.filter(~F.col("_open")).select(*FRAME, "frame_no", "object_id", "tracklet_id")
    open_frames = numbered.filter("_open and _object and _track").select("shot_id", "frame_no").withColumn("_bucket", frame_bucket("frame_no"))
    near = adjacent_row(open_frames, ["shot_id"], ["frame_no"], "_bucket", {"_before": "frame_no"})
    begins = F.coalesce((F.col("frame_no") != F.col("_before") + 1).cast("int"), F.lit(1))
    runs = running_sum(near, ["shot_id"], ["frame_no"], "_bucket", begins, "run_no").select("shot_id", "frame_no", "run_no")
    last = final.select("shot_id", (F.col("frame_no") + 1).alias("frame_no"), "object_id", F.col("tracklet_id").alias("held"))
    work = (
        edges.filter("_open").select(*FRAME, "frame_no", "object_id", "tracklet_id", "iou").join(runs, ["shot_id", "frame_no"])
        .join(last, ["shot_id", "frame_no", "object_id"], "left")
        .select(*FRAME, "frame_no", "object_id", "tracklet_id", "iou", F.coalesce("held", F.lit("")).alias("held"), "run_no")
    )
    matched = final.unionByName(solve_runs(work)).withColumn("_bucket", frame_bucket("frame_no"))
    steps = adjacent_row(matched, ["shot_id", "object_id"], ["frame_no"], "_bucket", {"_track": "tracklet_id", "_no": "frame_no"})
    flags = steps.groupBy("shot_id").agg(
        F.count_if(F.col("_track") != F.col("tracklet_id")).alias("id_switches"),
        F.count_if(F.col("_no") + 1 != F.col("frame_no")).alias("fragmentation"),
    )
    full = frames.select("shot_id").distinct().join(flags, "shot_id", "left")
    return _per_shot_and_total(full).groupBy("shot_id").agg(
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("id_switches", "fragmentation")]
    )


def standard_metrics(objects: DataFrame, rows: DataFrame, frames: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Published-definition metrics per shot plus a combined row (``*``)."""
    overlaps = cut_lineage(frame_overlaps(objects, rows, frames, threshold))  # read by three scores
    ids = cut_lineage(id_counts(overlaps, threshold))
    per_object, per_track = box_counts(ids)
    return (
        hota(overlaps, ids, per_object, per_track)
        .join(idf1(ids, per_object, per_track), "shot_id", "left")
        .join(clear_switches(overlaps, frames, threshold), "shot_id", "left")
    )


# --- promotion -------------------------------------------------------------

def promotion_gate(
    runs: DataFrame, min_idf1: float = 0.9, max_id_switches_per_shot: int = 1, min_cross_shot_coverage: float = 0.8
) -> DataFrame:
    """Passed, failed or not evaluated per run, with the reasons in order; missing evidence beats failure.

    One row per run; null columns mean that evidence was not supplied. Optional
    reports count only when ``contact_supplied``/``team_supplied`` is true.
    """
    c = F.col
    standard = c("standard_status") == "evaluated"
    cross = c("cross_status") == "evaluated"
    pending = c("calibration_status").isNull() | c("calibration_status").isin("not_provided", "unvalidated", "partial")
    usable = c("shared_eligible").isNotNull() & (c("shared_eligible") > 0) & (c("shared_correct") >= 0) & (c("shared_correct") <= c("shared_eligible"))
    coverage = F.when(usable, c("shared_correct") / c("shared_eligible")).otherwise(F.coalesce(c("coverage"), F.lit(0.0)))
    yes = lambda condition: F.coalesce(condition, F.lit(False))
    no = lambda condition: ~yes(condition)
    rules: list[tuple[Column, str | Column, bool]] = [
        (yes(c("proxy_detector")), "proxy detector results cannot satisfy the promotion gate", True),
        (no(standard), "standard tracking metrics are unavailable", True),
        (yes(standard) & no(c("idf1") >= min_idf1), "IDF1 is below the promotion gate", False),
        (yes(standard) & no(c("worst_shot_idf1") >= min_idf1), "a shot is below the per-shot IDF1 gate", False),
        (yes(standard) & yes(c("worst_shot_switches") > max_id_switches_per_shot), "a shot exceeds the identity-switch gate", False),
        (pending, F.concat(F.lit("calibration status is "), F.coalesce("calibration_status", F.lit("missing"))), True),
        (~pending & no(c("calibration_status") == "valid"), F.concat(F.lit("calibration status is "), F.coalesce("calibration_status", F.lit("missing"))), False),
        (yes(c("calibration_status") == "valid") & c("calibration_median_ok").isNull(), "calibration gate evidence is missing", True),
        (yes(c("calibration_status") == "valid") & c("calibration_median_ok").isNotNull() & no(c("calibration_median_ok") & c("calibration_p95_ok")), "calibration error is below the promotion gate", False),
        (no(cross), "cross-shot identity is not evaluated", True),
        (yes(cross) & c("false_merges_zero").isNull(), "cross-shot false-merge gate evidence is missing", True),
        (yes(cross) & c("false_merges_zero").isNotNull() & no(c("false_merges_zero") & (c("false_merges") == 0)), "cross-shot identity has false merges", False),
        (yes(cross) & c("components_clean").isNull(), "identity component gate evidence is missing", True),
        (yes(cross) & c("components_clean").isNotNull() & no(c("components_clean")), "identity components are contaminated or unattributed", False),
        (yes(cross) & c("shared_eligible").isNull(), "cross-shot shared-player denominator is missing", True),
        (yes(cross) & c("shared_eligible").isNotNull() & no(usable), "cross-shot shared-player denominator is invalid", True),
        (yes(cross) & (coverage < min_cross_shot_coverage), "cross-shot coverage is below the promotion gate", False),
        (yes(c("contact_supplied")) & no(c("contact_status") == "evaluated"), "ground-contact position error is not evaluated", True),
        (yes(c("contact_supplied")) & yes(c("contact_status") == "evaluated") & c("contact_gate").isNull(), "ground-contact gate evidence is missing", True),
        (yes(c("contact_supplied")) & yes(c("contact_status") == "evaluated") & c("contact_gate").isNotNull() & no(c("contact_gate")), "ground-contact position error is below the promotion gate", False),
        (yes(c("team_supplied")) & no(c("team_status") == "evaluated"), "team assignment is not evaluated", True),
        (yes(c("team_supplied")) & yes(c("team_status") == "evaluated") & c("team_gate").isNull(), "team assignment gate evidence is missing", True),
        (yes(c("team_supplied")) & yes(c("team_status") == "evaluated") & c("team_gate").isNotNull() & no(c("team_gate")), "team assignment is below the promotion gate", False),
    ]
    reasons = F.array_compact(F.array(*[F.when(hit, text if isinstance(text, Column) else F.lit(text)) for hit, text, _ in rules]))
    missing = F.lit(False)
    for hit, _, is_missing in rules:
        if is_missing:
            missing = missing | hit
    return runs.withColumn("reasons", reasons).withColumn(
        "gate_status", F.when(F.size("reasons") == 0, "passed").when(missing, "not_evaluated").otherwise("failed")
    )
