"""Summaries, team evidence, cues and calibration reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.functions import geometry as G
from trackspark.operators import calibrate as CAL
from trackspark.operators import cues as CU
from trackspark.operators import teams as TE
from trackspark.operators import timing as TM
from trackspark.operators import tracks as TR
from trackspark.plans.catalog import query
from trackspark.plans.catalog.geometry import CLOSED, ELIGIBLE
from trackspark.plans.catalog.joins import RANGES, SEGMENTS

PROTOTYPES = {"A": (0.75, 0.125, 0.25), "B": (0.25, 0.125, 0.75)}


@query("a1_track_summary", "obs", """
SELECT shot_id, CAST(sum(n) AS BIGINT) AS observation_count, CAST(count(*) AS BIGINT) AS unique_tracklets, CAST(sum(CASE WHEN frames > 1 THEN 1 ELSE 0 END) AS BIGINT) AS multi_frame_tracklets,
 CAST(sum(n - frames) AS BIGINT) AS duplicate_track_ids_within_frame, min(f) AS first_frame, max(l) AS last_frame
FROM (SELECT shot_id, concat(shot_id, ':t', CAST(CAST(floor(x1/20) AS INT) AS STRING)) AS t, count(*) AS n, count(DISTINCT frame_index) AS frames, min(frame_index) AS f, max(frame_index) AS l FROM obs GROUP BY 1, 2) GROUP BY shot_id""")
def a1(v):
    # coarse ids by image column, so frames do hold repeated ids
    rows = v.obs.withColumn("tracklet_id", F.concat("shot_id", F.lit(":t"), F.floor(F.col("x1") / 20).cast("string")))
    return TR.track_summary(rows, ["shot_id"])


TEAM_CTE = """scored AS (SELECT tracklet_id, sqrt(pow(r-0.75E0,2)+pow(g-0.125E0,2)+pow(b-0.25E0,2)) AS da, sqrt(pow(r-0.25E0,2)+pow(g-0.125E0,2)+pow(b-0.75E0,2)) AS db FROM crops),
 per AS (SELECT tracklet_id, count(*) AS n, sum(CASE WHEN da <= db THEN 1 ELSE 0 END) AS na, sum(CASE WHEN da > db THEN 1 ELSE 0 END) AS nb, avg(CASE WHEN abs(da-db) < 0.05 THEN 1.0E0 ELSE 0 END) AS near,
   avg(CASE WHEN da <= db THEN 1/(1+4*da) END) AS sa, avg(CASE WHEN da > db THEN 1/(1+4*db) END) AS sb FROM scored GROUP BY 1),
 rated AS (SELECT tracklet_id, n, CASE WHEN na >= nb THEN 'A' ELSE 'B' END AS w, CASE WHEN na >= nb THEN sa ELSE sb END AS score, greatest(na,nb)*1.0E0/n AS cover, greatest(least(na,nb)*1.0E0/n, near) AS amb FROM per),
 teams AS (SELECT tracklet_id, CASE WHEN amb >= 0.5 OR score < 0.5 THEN 'unknown' ELSE w END AS team, score, CASE WHEN amb >= 0.5 OR score < 0.5 THEN 'ambiguous_rgb_prototype' ELSE 'rgb_prototype' END AS source, n AS crop_count, cover AS assignment_coverage, amb AS ambiguity FROM rated)"""


def teams(v):
    return TE.team_by_prototype(v.obs, v.crops, PROTOTYPES)


@query("a2_team_by_prototype", "crops", f""", {TEAM_CTE}
SELECT tracklet_id, team, round(score,6) AS score, source, crop_count, round(assignment_coverage,6) AS assignment_coverage, round(ambiguity,6) AS ambiguity,
 source = 'rgb_prototype' AND team <> 'unknown' AND score > 0 AND assignment_coverage > 0 AND ambiguity < 0.5 AS eligible FROM teams""")
def a2(v):
    t = teams(v)
    return t.select(
        "tracklet_id", "team", F.round("score", 6).alias("score"), "source", "crop_count",
        F.round("assignment_coverage", 6).alias("assignment_coverage"), F.round("ambiguity", 6).alias("ambiguity"), TE.team_eligible().alias("eligible"),
    )


@query("a3_team_by_clusters")
def a3(v):
    crops = v.crops
    out = TE.team_by_clusters(crops, crops, ["shot_id"])
    return out.withColumn("score", F.round("score", 6)).withColumn("assignment_coverage", F.round("assignment_coverage", 6))


READS = "reads_ok AS (SELECT * FROM reads WHERE review_status <> 'rejected')"
REVIEWED = """reviewed AS (SELECT tracklet_id, accepted_number AS number, 1.0E0 AS confidence FROM reads WHERE review_status IN ('reviewed','accepted') AND accepted_number IS NOT NULL
  UNION ALL SELECT tracklet_id, number, confidence FROM reads WHERE review_status IN ('reviewed','accepted') AND accepted_number IS NULL AND confidence >= 0.9)"""
MEANS = """unit AS (SELECT tracklet_id, model, vector, sqrt(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE)*CAST(x AS DOUBLE)))) AS norm FROM embeds WHERE review_status <> 'rejected' AND crop_quality_score >= 0.6),
 dims AS (SELECT tracklet_id, model, i, avg(CAST(vector[i] AS DOUBLE)/norm) AS m FROM unit, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1,2,3),
 lens AS (SELECT tracklet_id, model, sqrt(sum(m*m)) AS total FROM dims GROUP BY 1,2),
 unitmeans AS (SELECT d.tracklet_id, d.model, d.i, d.m/l.total AS x FROM dims d JOIN lens l ON l.tracklet_id = d.tracklet_id AND l.model = d.model)"""


def candidates(v):
    return v.reads.select("tracklet_id", "source_frame", "number", "confidence")


@query("a4_number_distribution", "reads", f""", {READS}, {REVIEWED}
SELECT 'all' AS kind, tracklet_id, number, round(avg(confidence), 9) AS confidence FROM reads_ok GROUP BY 2, 3
UNION ALL SELECT 'reviewed', tracklet_id, number, round(avg(confidence), 9) FROM reviewed GROUP BY 2, 3""")
def a4_numbers(v):
    make = lambda kind, only: CU.number_distribution(v.reads, candidates(v), only).select(
        F.lit(kind).alias("kind"), "tracklet_id", "number", F.round("confidence", 9).alias("confidence")
    )
    return make("all", False).unionByName(make("reviewed", True))


@query("a4_mean_embeddings", "embeds", f""", {MEANS}
SELECT tracklet_id, model, CAST(i - 1 AS INT) AS dim, round(x, 6) AS x FROM unitmeans""")
def a4_embeddings(v):
    return CU.mean_embeddings(v.embeds).select("tracklet_id", "model", F.posexplode("vector").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query("a4_median_quality", "reads", """
SELECT tracklet_id, CAST(count(*) AS BIGINT) AS jersey_read_count, round(median(confidence*40),6) AS median_crop_height_px, round(median(CASE WHEN number > 20 THEN number*1.0E0 END),6) AS median_sharpness FROM reads GROUP BY 1""")
def a4_quality(v):
    rows = v.reads.withColumn("crop_height_px", F.col("confidence") * 40).withColumn("sharpness", F.when(F.col("number") > 20, F.col("number") * 1.0))
    out = CU.median_quality(rows, ["crop_height_px", "sharpness"])
    return out.select("tracklet_id", "jersey_read_count", F.round("median_crop_height_px", 6).alias("median_crop_height_px"), F.round("median_sharpness", 6).alias("median_sharpness"))


@query("a5_reviewed_jersey_set", "reads", """
SELECT tracklet_id, CAST(number AS INT) AS number FROM (SELECT tracklet_id, accepted_number AS number FROM reads WHERE review_status IN ('reviewed','accepted') AND accepted_number IS NOT NULL
 UNION SELECT tracklet_id, min(number) FROM reads WHERE review_status IN ('reviewed','accepted') AND accepted_number IS NULL AND confidence >= 0.9 GROUP BY tracklet_id, source_frame HAVING count(*) = 1)""")
def a5(v):
    return CU.reviewed_numbers(v.reads, candidates(v))


PAIRS = """pairs AS (SELECT a.tracklet_id AS l, b.tracklet_id AS r FROM (SELECT DISTINCT tracklet_id FROM obs) a JOIN (SELECT DISTINCT tracklet_id FROM obs) b ON split_part(a.tracklet_id,':',1) < split_part(b.tracklet_id,':',1)
  AND CAST(split_part(substr(a.tracklet_id,6),':',1) AS INT) // 3 = CAST(split_part(substr(b.tracklet_id,6),':',1) AS INT) // 3)"""
CUE_SQL = f"""{READS}, {REVIEWED}, {MEANS}, nums AS (SELECT tracklet_id, number, avg(confidence) AS c FROM reads_ok GROUP BY 1,2), rev AS (SELECT DISTINCT tracklet_id, number FROM reviewed),
 jersey AS (SELECT l, r, max(least(a.c, b.c)) AS j FROM pairs JOIN nums a ON a.tracklet_id = l JOIN nums b ON b.tracklet_id = r AND b.number = a.number GROUP BY 1,2),
 agreed AS (SELECT DISTINCT l, r FROM pairs JOIN rev a ON a.tracklet_id = l JOIN rev b ON b.tracklet_id = r AND b.number = a.number),
 looks AS (SELECT l, r, max(greatest(-1, least(1, s))) AS a FROM (SELECT l, r, a.model, sum(a.x*b.x) AS s FROM pairs JOIN unitmeans a ON a.tracklet_id = l JOIN unitmeans b ON b.tracklet_id = r AND b.model = a.model AND b.i = a.i GROUP BY 1,2,3) GROUP BY 1,2),
 cue AS (SELECT p.l AS left_key, p.r AS right_key, j, a, g.l IS NOT NULL AS agree, g.l IS NULL AND p.l IN (SELECT tracklet_id FROM rev) AND p.r IN (SELECT tracklet_id FROM rev) AS conflict,
   CASE WHEN j IS NOT NULL AND a IS NOT NULL THEN (0.25*j + 0.35*(a+1)/2)/0.6 WHEN j IS NOT NULL THEN j WHEN a IS NOT NULL THEN (a+1)/2 END AS rank
  FROM pairs p LEFT JOIN jersey x ON x.l = p.l AND x.r = p.r LEFT JOIN looks k ON k.l = p.l AND k.r = p.r LEFT JOIN agreed g ON g.l = p.l AND g.r = p.r)"""


def shot_pairs(v):
    """Cross-shot tracklet pairs of a play of three shots."""
    tracklets = v.obs.select("play_id", "shot_id", "tracklet_id").distinct()
    right = tracklets.select("play_id", F.col("shot_id").alias("right_shot"), F.col("tracklet_id").alias("right_key"))
    left = tracklets.select("play_id", F.col("shot_id").alias("left_shot"), F.col("tracklet_id").alias("left_key"))
    return left.join(right, "play_id").filter(F.col("left_shot") < F.col("right_shot"))


def cue_comparison(v, pairs):
    return CU.compare_cues(
        pairs, CU.number_distribution(v.reads, candidates(v)), CU.number_distribution(v.reads, candidates(v), True), CU.mean_embeddings(v.embeds)
    )


@query("j17_cue_agreement", "obs reads embeds", f""", {PAIRS}, {CUE_SQL}
SELECT left_key, right_key, round(j,6) AS jersey_number_proposal_score, round(a,5) AS appearance_similarity_proposal, agree AS reviewed_jersey_agreement, conflict AS reviewed_jersey_conflict, round(rank,5) AS cue_rank_score FROM cue""")
def j17(v):
    out = cue_comparison(v, shot_pairs(v))
    return out.select(
        "left_key", "right_key", F.round("jersey_number_proposal_score", 6).alias("jersey_number_proposal_score"),
        F.round("appearance_similarity_proposal", 5).alias("appearance_similarity_proposal"), "reviewed_jersey_agreement", "reviewed_jersey_conflict",
        F.round("cue_rank_score", 5).alias("cue_rank_score"),
    )


@query("v7_cue_binding", "obs reads", """
SELECT c.tracklet_id, c.source_frame, CASE WHEN o.pts IS NULL THEN 'missing_observation' WHEN o.pts <> c.source_pts THEN 'pts_mismatch' ELSE 'box_mismatch' END AS rule
FROM (SELECT tracklet_id, source_frame, source_frame*1001 + (CASE WHEN number = 7 THEN 1 ELSE 0 END) AS source_pts, number FROM reads) c LEFT JOIN obs o ON o.tracklet_id = c.tracklet_id AND o.frame_index = c.source_frame
WHERE o.pts IS NULL OR o.pts <> c.source_pts OR c.number % 5 = 0""")
def v7(v):
    obs = v.obs
    boxes = obs.select("tracklet_id", F.col("frame_index").alias("source_frame"), *G.BOX)
    cues = v.reads.join(boxes, ["tracklet_id", "source_frame"], "left").select(
        "tracklet_id", "source_frame", (F.col("source_frame") * 1001 + F.when(F.col("number") == 7, 1).otherwise(0)).alias("source_pts"),
        (F.col("x1") + F.when(F.col("number") % 5 == 0, 0.06).otherwise(0.04)).alias("x1"), "y1", "x2", "y2",
    )
    return CU.binding_violations(cues, obs)


#: Every shot has a second camera without any fit; a fit without withheld points knows a median in two of three cases.
BARE_MEDIAN = "CASE WHEN withheld_point_count = 0 AND key_no % 3 > 0 THEN (key_no % 7)/4.0E0 END"


@query("a14_static_calibration_quality", "keyframes withheld", f"""
, errs AS (SELECT w.shot_id, w.error_yards FROM withheld w JOIN keyframes k ON k.shot_id = w.shot_id AND k.key_no = w.key_no WHERE k.withheld_point_count > 0 UNION ALL SELECT shot_id, {BARE_MEDIAN} FROM keyframes WHERE {BARE_MEDIAN} IS NOT NULL)
SELECT e.shot_id, entries, CASE WHEN n IS NULL THEN 0 ELSE n END AS withheld_point_count, round(med,6) AS median_error_yards, round(p95,6) AS p95_error_yards, med <= 1 AS median_at_most_1_yard, p95 <= 2 AS p95_at_most_2_yards,
 CASE WHEN n IS NULL AND any_bad THEN 'invalid' WHEN n IS NULL THEN 'unvalidated' WHEN all_ok AND med <= 1 AND p95 <= 2 THEN 'valid' ELSE 'invalid' END AS status
FROM (SELECT shot_id, count(*) AS entries, bool_and(status = 'valid' AND {ELIGIBLE}) AS all_ok, bool_or(status = 'invalid') AS any_bad FROM keyframes GROUP BY 1) e
LEFT JOIN (SELECT shot_id, count(*) AS n, median(error_yards) AS med, quantile_cont(error_yards, 0.95) AS p95 FROM errs GROUP BY 1) q ON q.shot_id = e.shot_id
UNION ALL SELECT DISTINCT concat(shot_id, '-b'), 0, 0, NULL, NULL, NULL, NULL, 'not_provided' FROM keyframes""")
def a14(v):
    keys = v.keyframes.withColumn("fit_id", F.col("key_no")).withColumn("withheld_median_error_yards", F.expr(BARE_MEDIAN))
    errors = v.withheld.join(keys.filter("withheld_point_count > 0").select("shot_id", "key_no"), ["shot_id", "key_no"]).withColumn("fit_id", F.col("key_no"))
    cameras = keys.select(F.explode(F.array("shot_id", F.concat("shot_id", F.lit("-b")))).alias("shot_id"))
    out = CAL.quality_report(keys.withColumn("eligible", G.identity_eligible()), errors, ["shot_id"], cameras)
    return out.withColumn("median_error_yards", F.round("median_error_yards", 6)).withColumn("p95_error_yards", F.round("p95_error_yards", 6))


@query("a15_timeline_quality", "keyframes withheld", f"""
SELECT k.keyframe_id, k.entries, coalesce(q.n, 0) AS withheld_point_count, round(med,6) AS median_error_yards, round(p95,6) AS p95_error_yards, med <= 1 AS median_at_most_1_yard, p95 <= 2 AS p95_at_most_2_yards,
 CASE WHEN n IS NULL AND status = 'invalid' THEN 'invalid' WHEN n IS NULL THEN 'unvalidated' WHEN ok AND med <= 1 AND p95 <= 2 THEN 'valid' ELSE 'invalid' END AS status
FROM (SELECT keyframe_id, shot_id, key_no, status, CAST(1 AS BIGINT) AS entries, status = 'valid' AND {ELIGIBLE} AS ok FROM keyframes) k
LEFT JOIN (SELECT key_no, shot_id, nullif(count(e), 0) AS n, median(e) AS med, quantile_cont(e, 0.95) AS p95 FROM (SELECT *, CASE WHEN error_yards > 0.25 THEN error_yards END AS e FROM withheld) GROUP BY 1, 2) q ON q.key_no = k.key_no AND q.shot_id = k.shot_id""")
def a15(v):
    keys = v.keyframes
    # small errors are unknown
    errors = v.withheld.withColumn("error_yards", F.expr("CASE WHEN error_yards > 0.25 THEN error_yards END")).join(keys.select("shot_id", "key_no", "keyframe_id"), ["shot_id", "key_no"])
    out = CAL.quality_report(keys.withColumn("eligible", G.identity_eligible()), errors, ["keyframe_id"])
    return out.withColumn("median_error_yards", F.round("median_error_yards", 6)).withColumn("p95_error_yards", F.round("p95_error_yards", 6))


@query("a17_calibration_status_rollup", "keyframes", """
SELECT shot_id, CASE WHEN bool_and(status = 'valid') THEN 'valid' WHEN bool_and(status = 'invalid') THEN 'invalid' WHEN bool_or(status IN ('invalid','partial')) OR count(DISTINCT status) > 1 THEN 'partial' ELSE 'unvalidated' END AS status, CAST(count(*) AS BIGINT) AS n FROM keyframes GROUP BY 1""")
def a17(v):
    return v.keyframes.groupBy("shot_id").agg(CAL.status_rollup().alias("status"), F.count("*").alias("n"))


@query("w2_keyframe_intervals", "keyframes", f""", {CLOSED}, prev AS (SELECT *, lag(pts_end) OVER (PARTITION BY shot_id ORDER BY pts_start, keyframe_id) AS pe FROM closed)
SELECT shot_id, keyframe_id, pts_start, pts_end, concat_ws(',', CASE WHEN status = 'valid' AND NOT {ELIGIBLE} THEN 'valid_without_evidence' END, CASE WHEN pts_end <= pts_start THEN 'invalid_interval' END, CASE WHEN pts_start < pe THEN 'overlapping_interval' END) AS broken FROM prev""")
def w2(v):
    closed = CAL.close_intervals(v.keyframes)
    return closed.select("shot_id", "keyframe_id", "pts_start", "pts_end", F.concat_ws(",", "broken").alias("broken"))


CHECKS = """checks AS (SELECT play_id, shot_id, event, pts + 50050 AS pts, play_time_s + n/8.0E0 AS play_time_s FROM events_map)"""


@query("a19_timing_validation", "events_map", f""", {SEGMENTS}, {CHECKS},
 timed AS (SELECT c.play_id, s.play_time_s + (c.pts - s.pts)*1.0E0/(s.to_pts - s.pts)*(s.to_s - s.play_time_s) AS p, c.play_time_s AS t FROM checks c LEFT JOIN seg s ON s.play_id = c.play_id AND s.shot_id = c.shot_id AND s.to_pts IS NOT NULL AND (c.pts > s.pts OR (c.pts = s.pts AND s.is_first)) AND c.pts <= s.to_pts)
SELECT play_id, CAST(count(*) AS BIGINT) AS checks, CAST(sum(CASE WHEN p IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, round(max(abs(p-t)*1000), 3) AS max_residual_ms,
 coalesce(sum(CASE WHEN p IS NULL THEN 1 ELSE 0 END) = 0 AND max(abs(p-t)*1000) <= 50, false) AS gate, CASE WHEN sum(CASE WHEN p IS NULL THEN 1 ELSE 0 END) = 0 AND max(abs(p-t)*1000) <= 50 THEN 'valid' ELSE 'invalid' END AS status FROM timed GROUP BY 1""")
def a19(v):
    events = v.events_map
    checks = events.select("play_id", "shot_id", "event", (F.col("pts") + 50050).alias("pts"), (F.col("play_time_s") + F.col("n") / 8.0).alias("play_time_s"))
    out = TM.validate_clock(checks, TM.time_segments(events))
    return out.withColumn("max_residual_ms", F.round("max_residual_ms", 3))


@query("v5_alignment_rules", "events_map", """
, near AS (SELECT *, lag(pts) OVER w AS p, lag(play_time_s) OVER w AS t FROM events_map WINDOW w AS (PARTITION BY play_id, shot_id ORDER BY pts, play_time_s)),
 anchors AS (SELECT play_id, shot_id, min(frame_index) AS f, min(n) AS n FROM events_map GROUP BY 1, 2), spans AS (SELECT play_id, shot_id, min(frame_index) + min(n) - 246 AS s, max(frame_index) AS e FROM events_map GROUP BY 1, 2)
SELECT DISTINCT play_id, 'not_increasing' AS rule FROM near WHERE p = pts OR play_time_s <= t
UNION SELECT play_id, 'fewer_than_two_anchors' FROM anchors GROUP BY 1 HAVING count(*) < 2
UNION SELECT e.play_id, 'event_sets_differ' FROM events_map e JOIN (SELECT play_id, count(DISTINCT shot_id) AS s FROM events_map GROUP BY 1) k ON k.play_id = e.play_id GROUP BY e.play_id, e.event, k.s HAVING count(DISTINCT e.shot_id) < k.s
UNION SELECT play_id, 'check_not_held_out' FROM events_map WHERE n > 249
UNION SELECT e.play_id, 'checks_do_not_cover_shots' FROM (SELECT DISTINCT play_id, shot_id FROM events_map) e WHERE e.play_id IN (SELECT play_id FROM events_map WHERE n > 249) AND NOT EXISTS (SELECT 1 FROM events_map c WHERE c.play_id = e.play_id AND c.shot_id = e.shot_id AND c.n > 249)
UNION SELECT a.play_id, 'check_event_sets_differ' FROM (SELECT play_id, event, count(DISTINCT shot_id) AS seen FROM events_map WHERE n > 249 GROUP BY 1, 2) a JOIN (SELECT play_id, count(DISTINCT shot_id) AS shots FROM events_map WHERE n > 249 GROUP BY 1) b ON b.play_id = a.play_id WHERE seen < shots
UNION SELECT a.play_id, 'anchor_outside_range' FROM anchors a JOIN spans s ON s.play_id = a.play_id AND s.shot_id = a.shot_id WHERE NOT (a.f >= s AND a.f < e)
UNION SELECT play_id, 'invalid_range' FROM spans WHERE s < 0 OR e <= s""")
def v5(v):
    events = v.events_map
    anchors = events.groupBy("play_id", "shot_id").agg(F.min("frame_index").alias("source_frame"))
    spans = events.groupBy("play_id", "shot_id").agg((F.min("frame_index") + F.min("n") - 246).alias("start_frame"), F.max("frame_index").alias("end_frame"))
    return TM.alignment_violations(events.select("play_id").distinct(), anchors, events, events.filter("n > 249"), spans)


@query("v5_anchor_shots", "boundaries dets", f""", {RANGES}, a AS (SELECT *, start_frame + shot_no*500 AS f FROM ranges)
SELECT a.source_id, concat('play-shot-', CAST(a.shot_no AS STRING)) AS play_id, concat('shot-', CAST(a.shot_no AS STRING)) AS named_shot, 'shot-' || CAST(r.shot_no AS STRING) AS actual_shot, CASE WHEN r.shot_no IS NULL THEN 'outside_source' ELSE 'wrong_shot' END AS rule
FROM a LEFT JOIN ranges r ON r.source_id = a.source_id AND a.f >= r.start_frame AND a.f < r.end_frame WHERE r.shot_no IS NULL OR r.shot_no <> a.shot_no""")
def v5_anchors(v):
    from trackspark.plans.catalog.joins import source_ranges

    ranges = source_ranges(v)
    anchors = ranges.select("source_id", F.concat(F.lit("play-"), "shot_id").alias("play_id"), "shot_id", (F.col("start_frame") + F.col("shot_no") * 500).alias("source_frame"))
    return TM.anchor_shot_violations(anchors, ranges).select("source_id", "play_id", "named_shot", "actual_shot", "rule")


@query("a22_variant_comparison", "obs frames", """
, variants AS (SELECT 'all' AS variant, * FROM obs UNION ALL SELECT 'strict', * FROM obs WHERE score > 0.4 UNION ALL SELECT 'wide', * FROM obs WHERE x2 < 70)
SELECT v.variant, f.shot_id, coalesce(n, 0) AS row_count, coalesce(t, 0) AS tracklets, med AS median_boxes, f.n_frames - coalesce(filled, 0) AS empty_frames, CASE WHEN n > 0 THEN 'complete' ELSE 'incomplete' END AS status
FROM (SELECT DISTINCT variant FROM variants) v CROSS JOIN (SELECT shot_id, count(*) AS n_frames FROM frames GROUP BY 1) f
LEFT JOIN (SELECT variant, shot_id, CAST(sum(b) AS BIGINT) AS n, count(*) AS filled, median(b) AS med FROM (SELECT variant, shot_id, frame_index, count(*) AS b FROM variants GROUP BY 1,2,3) GROUP BY 1,2) q ON q.variant = v.variant AND q.shot_id = f.shot_id
LEFT JOIN (SELECT variant, shot_id, count(DISTINCT tracklet_id) AS t FROM variants GROUP BY 1,2) k ON k.variant = v.variant AND k.shot_id = f.shot_id""")
def a22(v):
    obs = v.obs
    rows = obs.withColumn("variant", F.explode(F.array_compact(F.array(
        F.lit("all"), F.when(F.col("score") > 0.4, "strict"), F.when(F.col("x2") < 70, "wide")))))
    return TR.variant_comparison(rows, v.frames, ["all", "strict", "wide"])


PIXELS = """SELECT CAST(floor(l_orderkey/32.0) AS BIGINT) AS crop_id, CAST(l_orderkey % 32 AS INT) AS px, CAST(l_linenumber AS INT) AS py, 32 AS width, 8 AS height, min(l_quantity)/64.0E0 AS r, max(l_discount) AS g, (min(l_partkey) % 256)/256.0E0 AS b FROM lineitem GROUP BY l_orderkey, l_linenumber"""


@query("a25_crop_colour", "", f"""
WITH torso AS (SELECT * FROM ({PIXELS}) WHERE px >= 6 AND px < 25 AND py >= 1 AND py < 6),
 cuts AS (SELECT crop_id, quantile_cont(r,0.2) AS r1, quantile_cont(r,0.8) AS r2, quantile_cont(g,0.2) AS g1, quantile_cont(g,0.8) AS g2, quantile_cont(b,0.2) AS b1, quantile_cont(b,0.8) AS b2 FROM torso GROUP BY 1)
SELECT t.crop_id, round(coalesce(avg(CASE WHEN ok THEN r END), avg(r)),11) AS r, round(coalesce(avg(CASE WHEN ok THEN g END), avg(g)),11) AS g, round(coalesce(avg(CASE WHEN ok THEN b END), avg(b)),11) AS b
FROM (SELECT t.*, r BETWEEN r1 AND r2 AND g BETWEEN g1 AND g2 AND b BETWEEN b1 AND b2 AS ok FROM torso t JOIN cuts c ON c.crop_id = t.crop_id) t GROUP BY 1""")
def a25(v):
    from trackspark.plans.views import with_views

    pixels = v.spark.sql(with_views("", f"SELECT * FROM ({PIXELS})", v.sf_dir))
    return TE.crop_colours(pixels).select("crop_id", *[F.round(c, 11).alias(c) for c in "rgb"])
