"""End-to-end jobs over a corpus: every game, shot and play of one call is a key, never a loop."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.functions.scalars import is_player, split_rejects
from trackspark.operators import calibrate as CAL
from trackspark.operators import contracts as C
from trackspark.operators import cues as CU
from trackspark.operators import evaluation as EV
from trackspark.operators import identity as ID
from trackspark.operators import labels as LB
from trackspark.operators import pairs as PR
from trackspark.operators import review as RV
from trackspark.operators import shots as SH
from trackspark.operators import teams as TE
from trackspark.operators import timing as TM
from trackspark.operators import tracks as TR
from trackspark.operators.runs import batch_status, readiness
from trackspark.operators.tracking import track_shots
from trackspark.scale import extent_of, one_row
from trackspark.session import cut_lineage

PAIR_TOLERANCE_S = 0.05


def run_analytics(
    detections: DataFrame, ranges: DataFrame, splits: DataFrame, crops: DataFrame, prototypes: Mapping[str, Sequence[float]], timeline: DataFrame,
    correspondences: DataFrame, checks: DataFrame, anchors: DataFrame, references: DataFrame | None = None, frames: DataFrame | None = None,
    global_map: DataFrame | None = None, run_id: str = "run", tb: tuple[int, int] = (1, 30000), fps: float = 30.0, threshold: float = 0.65,
    withheld: DataFrame | None = None, detectors: DataFrame | None = None, play_ranges: DataFrame | None = None,
    reads: DataFrame | None = None, read_candidates: DataFrame | None = None, crop_embeddings: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Detections to tracks, teams, field positions, play clock, identities and, with truth, scores and a gate.

    Stages that several later stages read are written once. Inputs:
    detections(source_id, frame_index, det_index, pts, x1..y2, score, class_id, class_name), ranges as from
    ``shot_ranges`` with corpus-wide shot ids, splits(tracklet_id, segment_id, start_frame, end_frame),
    crops(shot_id, frame_index, x-centre aligned det_index, r, g, b), timeline(shot_id, pts_start, pts_end, fit),
    correspondences/checks(play_id, shot_id, pts, play_time_s, event),
    anchors(play_id, shot_id, source_pts, source_frame, anchor_s). For the gate: withheld(error_yards) has all
    withheld landmark errors (without it calibration is unvalidated), detectors(source_id, proxy) the detector of each
    source (a source without one counts as a proxy). play_ranges(play_id, shot_id, start_frame, end_frame) limits a play to
    part of a shot; a shot without one belongs to its play whole. Jersey reads, read_candidates and crop_embeddings as in
    ``operators.cues`` rank pairs; reviewed numbers forbid links.
    """
    detections = cut_lineage(detections)  # rules and conditions on columns, not on whatever made them
    good, rejects = split_rejects(detections, C.detection_rules())
    players = good.filter(is_player(F.col("class_id"), F.col("class_name")))
    placed = SH.shot_of_frame(players, ranges)
    tracked = cut_lineage(track_shots(placed))
    extent = extent_of(tracked, ["shot_id"], "frame_index", "pts")
    refined = TR.refine_tracklets(tracked, splits).withColumn("source_tracklet_id", F.col("tracklet_id"))
    rows = refined.withColumn("tracklet_id", F.coalesce("segment_id", "tracklet_id")).drop("segment_id")
    coloured = rows.select("tracklet_id", "shot_id", "frame_index", "det_index").join(crops, ["shot_id", "frame_index", "det_index"])
    teams = cut_lineage(TE.team_by_prototype(rows, coloured, prototypes))
    positioned = CAL.project_rows(CAL.calibration_at(rows, timeline, extent=extent))
    play_shots = correspondences.select("play_id", "shot_id").union(anchors.select("play_id", "shot_id")).distinct()
    in_play = SH.play_of_frame(positioned, declared_spans(play_shots, play_ranges), extent)
    timed_in = in_play.select("*", F.lit(float(tb[0])).alias("tb_num"), F.lit(tb[1]).alias("tb_den"), F.lit(fps).alias("fps"))
    segments = TM.time_segments(correspondences)
    clock = TM.play_clock(timed_in, segments, anchors, extent)
    labelled = clock.join(teams.select("tracklet_id", "team", F.col("score").alias("team_score")), "tracklet_id", "left")
    observations = cut_lineage(labelled.select(
        F.lit(run_id).alias("run_id"), "source_id", "shot_id", "frame_index", "pts", F.col("tb_num").cast("int").alias("tb_num"), "tb_den", "tracklet_id", "source_tracklet_id", "play_id", "x1", "y1", "x2", "y2",
        F.col("score").alias("detection_score"), F.coalesce("team", F.lit("unknown")).alias("team"), F.coalesce("team_score", F.lit(0.0)).alias("team_score"), F.lit(None).cast("int").alias("jersey_number"),
        "field_x", "field_y", "position_source", "calibration_id", F.lit(2).alias("identity_version"), "calibration_status", "calibration_reason", "position_uncertainty_yards", "play_time_s", "time_map_id",
    ))
    clock_ok = TM.validate_clock(checks, segments)
    samples = PR.field_samples(observations)
    ladder = cut_lineage(play_ladder(play_shots, samples, clock_ok, timeline))
    open_plays = ladder.filter("status = 'resolve'").select("play_id")
    eligible = samples.join(open_plays, "play_id", "left_semi")
    attributes = observations.select("tracklet_id", "play_id", "team").distinct()
    cues = None
    if reads is not None and read_candidates is not None:
        reviewed = CU.reviewed_numbers(reads, read_candidates)
        jerseys = reviewed.groupBy("tracklet_id").agg(F.sort_array(F.collect_set("number")).alias("jerseys"))  # shirt numbers, so at most a hundred
        attributes = attributes.join(jerseys, "tracklet_id", "left")
        pairs = ID.comparable_pairs(eligible, teams, PAIR_TOLERANCE_S)
        cues = cut_lineage(pair_cues(pairs, reads, read_candidates, crop_embeddings))
    else:
        attributes = attributes.withColumn("jerseys", F.lit(None).cast("array<int>"))
    resolved = ID.resolve_plays(
        play_shots.join(open_plays, "play_id", "left_semi"), eligible, teams, observations, attributes, cues=cues, threshold=threshold,
        full_evidence=False, sample_tolerance_s=PAIR_TOLERANCE_S,
    )
    status = resolved["status"].unionByName(abstained_plays(ladder, play_shots, samples), allowMissingColumns=True)
    accepted = resolved["links"].filter("decision = 'same'").select("left_key", "right_key")
    ids = cut_lineage(ID.player_ids(observations.select("tracklet_id").distinct(), accepted))
    final = observations.join(ids, "tracklet_id")
    out = {
        "rejects": rejects, "tracks": tracked, "conflicts": TR.conflict_report(tracked), "teams": teams, "observations": final, "clock": clock_ok,
        "evidence": resolved["evidence"], "evidence_counts": resolved["evidence_counts"], "links": resolved["links"], "plays": status, "identities": ids, "coverage": ID.identity_coverage(ids),
    }
    if references is not None and frames is not None and global_map is not None:
        out.update(score_run(tracked, final, ids, references, frames, global_map, timeline, withheld, detector_state(detections.select("source_id").distinct(), detectors)))
    return out


def declared_spans(play_shots: DataFrame, play_ranges: DataFrame | None) -> DataFrame:
    """(play_id, shot_id, start_frame, end_frame) of every shot of a play; null without a declared range."""
    if play_ranges is None:
        return play_shots.withColumns({"start_frame": F.lit(None).cast("bigint"), "end_frame": F.lit(None).cast("bigint")})
    return play_shots.join(play_ranges.select("play_id", "shot_id", "start_frame", "end_frame"), ["play_id", "shot_id"], "left")


def play_ladder(play_shots: DataFrame, samples: DataFrame, clock: DataFrame, timeline: DataFrame) -> DataFrame:
    """Which plays may be resolved, and why the others may not. timeline(shot_id, fit)"""
    fitted = timeline.filter(CAL.G.identity_eligible("fit.")).select("shot_id").distinct().withColumn("_fitted", F.lit(True))
    present = samples.select("play_id", "shot_id").distinct().join(fitted, "shot_id", "left").groupBy("play_id").agg(
        F.count(F.lit(1)).alias("_present"), F.count_if(F.col("_fitted").isNull()).alias("_open")
    )
    plays = play_shots.select("play_id").distinct().join(present, "play_id", "left").join(clock.select("play_id", "gate"), "play_id", "left")
    zero = F.lit(0).cast("bigint")
    return ID.resolution_ladder(plays.select(
        "play_id", F.coalesce("_present", zero).alias("present_shots"), F.lit(True).alias("has_timeline"), F.lit(False).alias("has_static"),
        F.lit(False).alias("has_shared"), F.coalesce("gate", F.lit(False)).alias("timing_eligible"), F.coalesce("_open", zero).alias("uncalibrated_shots"),
    ))


def abstained_plays(ladder: DataFrame, play_shots: DataFrame, samples: DataFrame) -> DataFrame:
    """Status rows of the plays that the ladder holds back, with their aligned shots that have no usable position."""
    held = ladder.filter("status = 'abstained'").select("play_id", "status", "reason", F.col("present_shots").alias("present"))
    missing = play_shots.join(samples.select("play_id", "shot_id").distinct(), ["play_id", "shot_id"], "left_anti")
    per = play_shots.groupBy("play_id").agg(F.count(F.lit(1)).alias("shots")).join(
        missing.groupBy("play_id").agg(F.sort_array(F.collect_list("shot_id")).alias("unresolved_shots")), "play_id", "left"  # at most the views of a play
    )
    none = {name: F.lit(0).cast("bigint") for name in ("unmatched_tracklets", "accepted_links", "rejected_links", "candidate_pairs", "failed_pairs")}
    return held.join(per, "play_id").withColumn("unresolved_shots", F.coalesce("unresolved_shots", F.array().cast("array<string>"))).withColumns(none)


def pair_cues(pairs: DataFrame, reads: DataFrame, candidates: DataFrame, embeddings: DataFrame | None) -> DataFrame:
    """Jersey and appearance cues of the pairs that can still be linked."""
    looks = pairs.select(F.col("left_key").alias("tracklet_id"), F.lit("none").alias("model"), F.array().cast("array<double>").alias("vector")).filter(F.lit(False))
    if embeddings is not None:
        looks = CU.mean_embeddings(embeddings)
    return CU.compare_cues(pairs, CU.number_distribution(reads, candidates), CU.number_distribution(reads, candidates, True), looks)


def detector_state(sources: DataFrame, detectors: DataFrame | None) -> DataFrame:
    """One row: ``proxy_detector`` unless every source is known to have a real detector."""
    if detectors is None:
        return sources.agg(F.lit(True).alias("proxy_detector"))
    known = detectors.groupBy("source_id").agg((F.bool_or("proxy") | (F.count("proxy") < F.count(F.lit(1)))).alias("proxy"))
    return sources.join(known, "source_id", "left").agg(F.coalesce(F.bool_or(F.coalesce("proxy", F.lit(True))), F.lit(True)).alias("proxy_detector"))


def standard_state(frames: DataFrame) -> DataFrame:
    """One row: standard metrics are evaluated only where a frame is scored."""
    return EV.evaluated_frames(frames).agg(F.when(F.count(F.lit(1)) > 0, "evaluated").otherwise("not_evaluated").alias("standard_status"))


def pooled_quality(timeline: DataFrame, withheld: DataFrame | None) -> DataFrame:
    """Calibration quality of the run over all withheld errors, not over one figure per keyframe."""
    fits = timeline.select(F.lit("all").alias("source_id"), F.col("fit.status").alias("status"), CAL.G.identity_eligible("fit.").alias("eligible"))
    if withheld is None:
        errors = fits.select("source_id", F.lit(None).cast("double").alias("error_yards")).filter(F.lit(False))
    else:
        errors = withheld.select(F.lit("all").alias("source_id"), "error_yards")
    return CAL.quality_report(fits, errors, ["source_id"])


def score_run(
    tracked: DataFrame, observations: DataFrame, ids: DataFrame, references: DataFrame, frames: DataFrame, global_map: DataFrame, timeline: DataFrame,
    withheld: DataFrame | None, detector: DataFrame,
) -> dict[str, DataFrame]:
    """Tracking, contact, team and cross-shot scores and the promotion gate of a run.

    Tracking is scored on the tracker's own tracks, before reviewed splits; the rest on the observations.
    """
    shots = EV.shot_metrics(references, tracked, frames)
    standard = cut_lineage(EV.standard_metrics(references, tracked, frames))
    contact = EV.contact_report(EV.contact_rows(references, observations, frames))
    team = EV.team_report(EV.team_rows(references, observations, frames))
    cross = EV.cross_shot_report(ids, observations, references, frames, global_map)
    quality = pooled_quality(timeline, withheld)
    total = standard.filter("shot_id = '*'").select(F.col("IDF1").alias("idf1"))
    worst = standard.filter("shot_id <> '*'").agg(F.min("IDF1").alias("worst_shot_idf1"), F.max("id_switches").alias("worst_shot_switches"))
    one = lambda df, **cols: df.select(*[F.col(v).alias(k) for k, v in cols.items()])
    passed = lambda df, *columns: df.filter("shot_id = '*'").select(F.col("status").alias("_status"), (F.col(columns[0]) & F.col(columns[1]) & F.col("every_shot_gate_passes")).alias("_gate"))
    named = lambda df, kind: df.select(F.col("_status").alias(f"{kind}_status"), F.col("_gate").alias(f"{kind}_gate"))
    gate_in = one_row(
        total, worst, detector, standard_state(frames),
        one(quality, calibration_status="status", calibration_median_ok="median_at_most_1_yard", calibration_p95_ok="p95_at_most_2_yards"),
        one(cross, cross_status="status", false_merges="false_merges", false_merges_zero="false_merges_zero", components_clean="components_clean", shared_eligible="eligible_shared_players", shared_correct="correct_shared_players", coverage="coverage"),
        named(passed(contact, "median_at_most_1_5_yards", "valid_fraction_at_least_0_90"), "contact"),
        named(passed(team, "accuracy_at_least_0_98", "coverage_at_least_0_95"), "team"),
    ).select("*", F.lit(True).alias("contact_supplied"), F.lit(True).alias("team_supplied"))
    return {"shot_metrics": shots, "standard": standard, "contact": contact, "team": team, "cross_shot": cross, "calibration_quality": quality, "gate": EV.promotion_gate(gate_in)}


def run_batch(plays: DataFrame, resolved: DataFrame, gates: DataFrame) -> DataFrame:
    """Batch status over plays: a play is a key of the one job above.

    plays(source_id, play_id), resolved(play_id, status), gates(source_id, gate_status)
    """
    joined = plays.join(resolved.select("play_id", F.col("status").alias("_resolved")), "play_id", "left").join(gates, "source_id", "left")
    rows = joined.select(
        "source_id", "play_id", F.when(F.col("_resolved").isNotNull(), "complete").otherwise("unavailable").alias("status"),
        F.when(F.col("_resolved") == "resolved", "complete").otherwise("complete_with_unresolved").alias("manifest_status"), "gate_status",
    )
    return batch_status(rows, ["source_id"])


def stage_review(
    ranges: DataFrame, observations: DataFrame, motion: DataFrame, frame_map: DataFrame, links: DataFrame, evidence: DataFrame, inputs: DataFrame,
    frames_per_shot: int = 12, fps: float = 30.0,
) -> dict[str, DataFrame]:
    """Everything a reviewer needs, as tables of one job.

    ranges(source_id, shot_id, shot_no, start_frame, end_frame, start_pts, end_pts, tb_num, tb_den, fps),
    observations(source_id, run_id, shot_id, tracklet_id, frame_index, pts, x1..y2, detection_score, team, team_score, play_time_s),
    motion(source_id, frame_index, p95, mean, camera_motion), frame_map as in ``label_proposals``, inputs as in ``readiness``.
    """
    wanted = SH.even_samples(ranges.select("source_id", "start_frame", "end_frame"), frames_per_shot).select("source_id", F.col("source_frame").alias("frame_index")).distinct()
    labels = LB.label_proposals(observations.withColumn("file_path", F.col("shot_id")), frame_map)
    return {
        "play_windows": SH.play_windows(ranges), "review_frames": wanted, "review_pack": RV.review_pack_rows(observations, wanted),
        "timing_proposals": RV.burst_proposals(RV.motion_bursts(motion), fps, ranges=ranges.select("source_id", "start_frame", "end_frame")), "label_boxes": labels["boxes"], "label_contacts": labels["contacts"],
        "jersey_samples": TR.best_per_bucket(observations.withColumn("score", F.col("detection_score")), 30, 6),
        "queue": RV.review_queue(links, evidence, observations), "readiness": readiness(inputs),
    }
