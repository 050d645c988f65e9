"""Parts of the end-to-end job and the samples of the review queue on small tables."""

from __future__ import annotations

from trackspark.operators.review import review_queue
from trackspark.operators.shots import play_of_frame
from trackspark.plans.run import abstained_plays, declared_spans, play_ladder

FIT = "struct<inlier_count:int,median_error_px:double,reprojection_threshold_px:double,median_error_yards:double,status:string,withheld_point_count:int,withheld_p95_error_yards:double>"
GOOD = (8, 1.0, 4.0, 0.2, "valid", 4, 0.5)


def plays_of(spark):
    shots = spark.createDataFrame([(p, f"{p}-{s}") for p in "abcde" for s in (1, 2)], "play_id string, shot_id string")
    samples = spark.createDataFrame([(p, f"{p}-{s}") for p in "abcd" for s in (1, 2) if (p, s) != ("b", 2)], "play_id string, shot_id string")
    clock = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", True)], "play_id string, gate boolean")
    return shots, samples, clock


def test_ladder_of_the_job_names_the_first_reason(spark):
    shots, samples, clock = plays_of(spark)
    unproven = GOOD[:5] + (0, None)
    # shot d-2 has one fit without withheld points; shot a-2 has such a fit beside a good one
    fits = [(f"{p}-{s}", GOOD) for p in "abcd" for s in (1, 2) if (p, s) != ("d", 2)] + [("d-2", unproven), ("a-2", unproven)]
    ladder = play_ladder(shots, samples, clock, spark.createDataFrame(fits, f"shot_id string, fit {FIT}"))
    got = {r.play_id: (r.status, r.reason) for r in ladder.collect()}
    sparse = "no calibrated field positions for the aligned shots"
    assert got == {
        "a": ("resolve", None), "b": ("abstained", sparse), "c": ("abstained", "play-time map or alignment source hash has no passing validation"),
        "d": ("abstained", "cross-shot resolution requires shot-specific calibration"), "e": ("abstained", sparse),
    }
    held = {r.play_id: r for r in abstained_plays(ladder, shots, samples).collect()}
    assert {p: (r.shots, r.present, r.unresolved_shots, r.accepted_links) for p, r in held.items()} == {
        "b": (2, 1, ["b-2"], 0), "c": (2, 2, [], 0), "d": (2, 2, [], 0), "e": (2, 0, ["e-1", "e-2"], 0),
    }


def test_ladder_without_plays_or_fits(spark):
    shots, samples, clock = plays_of(spark)
    no_fits = spark.createDataFrame([], f"shot_id string, fit {FIT}")
    assert {r.reason for r in play_ladder(shots, samples, clock.filter("gate"), no_fits).filter("play_id = 'a'").collect()} == {"cross-shot resolution requires shot-specific calibration"}
    assert play_ladder(shots.filter("false"), samples, clock, no_fits).count() == 0


def test_declared_ranges_limit_a_play(spark):
    shots = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("c", "s2")], "play_id string, shot_id string")
    ranges = spark.createDataFrame([("a", "s1", 0, 5), ("b", "s1", 7, 9)], "play_id string, shot_id string, start_frame bigint, end_frame bigint")
    rows = spark.createDataFrame([("s1", f) for f in range(10)] + [("s2", 3), ("s3", 4)], "shot_id string, frame_index bigint")
    got = {(r.shot_id, r.frame_index): r.play_id for r in play_of_frame(rows, declared_spans(shots, ranges)).collect()}
    want = {("s1", f): "a" if f < 5 else "b" if f in (7, 8) else None for f in range(10)} | {("s2", 3): "c", ("s3", 4): None}
    assert got == want
    whole = play_of_frame(rows.filter("shot_id <> 's1'"), declared_spans(shots.filter("shot_id <> 's1'"), None))
    assert {(r.shot_id, r.play_id) for r in whole.collect()} == {("s2", "c"), ("s3", None)}


LINK = "play_id string, left_key string, right_key string, decision string, score double, alternative_score double, ambiguity_margin double, rejection_reason string"
EVIDENCE = (
    "play_id string, left_key string, right_key string, eligible boolean, score double, review_rank_score double, reviewed_jersey_conflict boolean, left_team string, right_team string,"
    "paired_sample_count bigint, combined_uncertainty_yards double, overlap_start_s double, overlap_end_s double, overlap_span_s double, rejection_reason string"
)


def queue_of(spark, with_keys):
    links = [("p", "l1", "r1", "same", 0.9, None, 0.4, None), ("p", "l3", None, "insufficient_evidence", 0.0, None, None, "no_eligible_edge")]
    if with_keys:
        links = spark.createDataFrame([(*links[0], ["team_agreement"]), (*links[1], [])], LINK + ", evidence_keys array<string>")
    else:
        links = spark.createDataFrame(links, LINK)
    evidence = spark.createDataFrame([
        ("p", "l1", "r1", True, 0.9, 0.8, False, "A", "A", 9, 0.5, 1.0, 1.3, 0.3, None),
        ("p", "l1", "gone", False, None, None, False, "A", "B", 0, None, 1.0, 1.0, 0.0, "team_mismatch"),
    ], EVIDENCE)
    rows = spark.createDataFrame(
        [("l1", 10, 10, 1.02), ("l1", 13, 13, 1.3), ("r1", 20, 20, 1.0), ("r1", 22, 22, 1.5), ("l3", 30, 30, None), ("l3", 31, 31, None), ("l3", 32, 32, None)],
        "tracklet_id string, frame_index bigint, pts bigint, play_time_s double",
    )
    return {(r.left_key, r.right_key): r for r in review_queue(links, evidence, rows).collect()}


def test_samples_say_why_a_side_is_missing(spark):
    queue = queue_of(spark, True)
    pair = queue["l1", "r1"]
    told = [(s.left and s.left.frame_index, s.right and s.right.frame_index, s.left_missing_reason, s.right_missing_reason) for s in pair.samples]
    assert told == [(10, 20, None, None), (13, None, None, "no_observation_within_time_tolerance")]
    assert pair.source_frames_available and pair.review_status == "unreviewed" and pair.evidence_keys == ["team_agreement"] and pair.evidence.score == 0.9
    gone = queue["l1", "gone"]
    assert [(s.left.frame_index, s.right, s.right_missing_reason) for s in gone.samples] == [(10, None, "no_tracklet_observations")]
    assert not gone.source_frames_available and gone.evidence_keys == [] and gone.evidence.rejection_reason == "team_mismatch"
    alone = queue["l3", None]
    assert [(s.left.frame_index, s.right, s.left_missing_reason, s.right_missing_reason) for s in alone.samples] == [(31, None, None, None)]
    assert alone.evidence is None and alone.source_frames_available


def test_links_without_evidence_keys_have_none(spark):
    assert all(r.evidence_keys == [] for r in queue_of(spark, False).values())
