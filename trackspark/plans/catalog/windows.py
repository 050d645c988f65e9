"""Neighbourhood, gap, throttle and sampling windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.operators import calibrate as CAL
from trackspark.operators import review as RV
from trackspark.operators import shots as SH
from trackspark.operators import tracks as TR
from trackspark.plans.catalog import query
from trackspark.plans.catalog.joins import RANGES, source_ranges


@query("w3_local_spike_cuts", "scores", """
, near AS (SELECT *, list(score) OVER (PARTITION BY source_no ORDER BY frame_index ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS a, list(score) OVER (PARTITION BY source_no ORDER BY frame_index ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS b, bool_or(manual) OVER (PARTITION BY source_no) AS has_manual FROM scores),
 rated AS (SELECT *, coalesce(list_median(list_concat(coalesce(a, []), coalesce(b, []))), 0) AS base FROM near)
SELECT source_no AS source_id, frame_index, CASE WHEN has_manual THEN 'manual' ELSE 'scene' END AS reason, CASE WHEN has_manual THEN 1.0E0 ELSE least(1.0E0, score) END AS confidence FROM rated
WHERE CASE WHEN has_manual THEN manual ELSE score >= 0.05 AND score >= greatest(base*3, 0.04) END""".replace("list_median(", "list_aggregate(").replace("coalesce(b, [])))", "coalesce(b, [])), 'median')"))
def w3(v):
    return SH.local_spike_cuts(v.scores.withColumnRenamed("source_no", "source_id"), 0.05)


@query("w4_threshold_cuts", "scores", """
SELECT source_no AS source_id, frame_index, CASE WHEN manual THEN 'manual' ELSE 'scene' END AS reason, CASE WHEN manual THEN 1.0E0 ELSE least(1.0E0, score) END AS confidence FROM scores WHERE manual OR score >= 0.05
UNION ALL SELECT DISTINCT source_no, 0, 'start', 1.0E0 FROM scores""")
def w4(v):
    return SH.threshold_cuts(v.scores.withColumnRenamed("source_no", "source_id"), 0.05)


MOTION = "motion AS (SELECT source_no AS source_id, frame_index, score*64 AS p95, score*32 AS mean, score*512*(1 + frame_index % 3)/64.0E0 AS camera_motion FROM scores)"


MOTION_RATED = """ near AS (SELECT *, list(p95) OVER w AS a, list(p95) OVER x AS b, list(camera_motion) OVER w AS ca, list(camera_motion) OVER x AS cb, lag(p95) OVER o AS before, lead(p95) OVER o AS after FROM motion WINDOW o AS (PARTITION BY source_id ORDER BY frame_index), w AS (PARTITION BY source_id ORDER BY frame_index ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), x AS (PARTITION BY source_id ORDER BY frame_index ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)),
 rated AS (SELECT *, coalesce(list_aggregate(list_concat(coalesce(a, []), coalesce(b, [])), 'median'), 0) AS base, coalesce(list_aggregate(list_concat(coalesce(ca, []), coalesce(cb, [])), 'median'), 0) AS cbase FROM near)"""


@query("w5_motion_bursts", "scores", f""", {MOTION},
{MOTION_RATED}
SELECT source_id, frame_index, round(greatest(0, p95-base)/greatest(0.25, base), 9) AS score, coalesce(p95 < before AND p95 < after, false) AS dip, camera_motion > greatest(0.5, cbase*1.5) AS camera FROM rated""")
def w5(v):
    return RV.motion_bursts(motion(v)).select("source_id", "frame_index", F.round("score", 9).alias("score"), "dip", "camera")


def motion(v):
    c = F.col
    return v.scores.select(
        c("source_no").alias("source_id"), "frame_index", (c("score") * 64).alias("p95"), (c("score") * 32).alias("mean"),
        (c("score") * 512 * (1 + c("frame_index") % 3) / 64.0).alias("camera_motion"),
    )


@query("t4_separated_bursts", "scores", f""", {MOTION},
{MOTION_RATED}, found AS (
 SELECT source_id, 'motion_burst' AS kind, greatest(0, p95-base)/greatest(0.25, base) AS score, frame_index AS f FROM rated WHERE NOT coalesce(p95 < before AND p95 < after, false)
 UNION ALL SELECT source_id, 'camera_motion_keyframe_candidate', camera_motion, frame_index FROM rated WHERE camera_motion > greatest(0.5, cbase*1.5)),
 lists AS (SELECT source_id, kind, list({{'s': score, 'f': f}} ORDER BY score DESC, f) AS rest FROM found GROUP BY 1, 2),
 span AS (SELECT source_id, min(frame_index) AS lo, max(frame_index) + 1 AS hi FROM motion GROUP BY 1)
SELECT p.source_id, p.kind, p.pick_no, p.head.f AS frame_index, CAST(floor(round(p.head.s, 4)*1000 + 0.01E0) AS BIGINT) AS score_milli, greatest(CASE WHEN p.source_id % 3 = 0 THEN lo ELSE lo - 5 END, p.head.f - 2) AS window_start_frame, least(CASE WHEN p.source_id % 3 = 0 THEN hi ELSE hi + 1 END, p.head.f + 3) AS window_end_frame
FROM (WITH RECURSIVE pick AS (SELECT source_id, kind, CAST(0 AS INT) AS pick_no, rest[1] AS head, list_filter(rest, lambda x: abs(x.f - rest[1].f) >= 2) AS rest FROM lists
  UNION ALL SELECT source_id, kind, CAST(pick_no + 1 AS INT), rest[1], list_filter(rest, lambda x: abs(x.f - rest[1].f) >= 2) FROM pick WHERE len(rest) > 0 AND pick_no < 7) SELECT * FROM pick) p JOIN span s ON s.source_id = p.source_id""")
def t4(v):
    """Two of three sources are asked for from five frames before their first on."""
    found = motion(v)
    asked = found.groupBy("source_id").agg((F.min("frame_index") - 5).alias("start_frame"), (F.max("frame_index") + 2).alias("end_frame")).filter("source_id % 3 <> 0")
    told = RV.burst_proposals(RV.motion_bursts(found), fps=4.0, ranges=asked)
    return told.withColumn("score_milli", F.floor(F.col("score") * 1000 + 0.01)).drop("score")  # both engines round halves their own way


@query("w7_play_windows", "boundaries dets", f""", {RANGES}, shots AS (SELECT *, start_frame*1001 AS start_pts, CASE WHEN end_frame < max(end_frame) OVER (PARTITION BY source_id) THEN end_frame*1001 END AS end_pts FROM ranges),
 wins AS (SELECT a.source_id, a.shot_no AS f, b.shot_no AS l, a.start_frame, b.end_frame, a.start_pts, b.end_pts, CASE WHEN b.end_pts IS NOT NULL THEN (b.end_pts - a.start_pts)*1.0E0/30000 ELSE (b.end_frame - a.start_frame)/30.0E0 END AS d FROM shots a JOIN shots b ON b.source_id = a.source_id AND b.shot_no > a.shot_no AND b.shot_no <= a.shot_no + 3),
 fit AS (SELECT *, bool_and(d <= 120) OVER (PARTITION BY source_id, f ORDER BY l) AS ok FROM wins)
SELECT source_id, concat('play-candidate-', lpad(CAST(row_number() OVER (PARTITION BY source_id ORDER BY f, l) - 1 AS STRING), 6, '0')) AS candidate_id, f AS first_shot, l AS last_shot, start_frame, end_frame, start_pts, end_pts, round(d, 6) AS duration_s, CASE WHEN end_pts IS NOT NULL THEN 'source_pts' ELSE 'frame_rate_to_eof_estimate' END AS duration_method FROM fit WHERE ok""")
def w7(v):
    ranges = source_ranges(v)
    last = ranges.groupBy("source_id").agg(F.max("end_frame").alias("_last"))
    shots = ranges.join(last, "source_id").select(
        "source_id", "shot_no", "start_frame", "end_frame", (F.col("start_frame") * 1001).alias("start_pts"),
        F.when(F.col("end_frame") < F.col("_last"), F.col("end_frame") * 1001).alias("end_pts"), F.lit(1.0).alias("tb_num"), F.lit(30000).alias("tb_den"), F.lit(30.0).alias("fps"),
    )
    return SH.play_windows(shots, 4, 120.0)


@query("w8_best_per_bucket", "obs", """
, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tracklet_id, frame_index // 30 ORDER BY score DESC, y2 - y1 DESC, frame_index) AS rn FROM obs) WHERE rn = 1),
 num AS (SELECT *, row_number() OVER (PARTITION BY tracklet_id ORDER BY frame_index) - 1 AS place, count(*) OVER (PARTITION BY tracklet_id) AS n FROM best)
SELECT tracklet_id, frame_index // 30 AS stride_no, frame_index, score, y2 - y1 AS height FROM num WHERE n <= 8 OR place IN (SELECT CAST(round_even(i*(n-1)/7.0E0, 0) AS BIGINT) FROM (SELECT unnest(range(0, 8)) AS i))""")
def w8(v):
    return TR.best_per_bucket(v.obs, 30, 8)


FUSED = """SELECT play_id, concat('P', right(tracklet_id, 1)) AS player_id, shot_id, frame_index, pts, tracklet_id, play_time_s, score AS detection_score, x1 AS field_x, CASE WHEN frame_index % 37 = 0 THEN NULL ELSE y1 END AS field_y,
 CASE WHEN frame_index % 4 = 0 THEN NULL WHEN frame_index % 9 = 0 THEN 'partial' ELSE 'valid' END AS calibration_status, CASE WHEN frame_index % 5 = 0 THEN NULL WHEN frame_index % 41 = 0 THEN 'legacy-anchor-offset' ELSE 'play-time-map' END AS time_map_id,
 CASE WHEN frame_index % 3 = 0 THEN NULL ELSE score END AS position_uncertainty_yards, CAST(NULL AS STRING) AS calibration_id, tracklet_id AS source_tracklet_id FROM obs"""


@query("w9_play_time_dedupe", "obs", f"""
, r AS (SELECT *, CAST(round_even(play_time_s*10.0E0, 0) AS BIGINT) AS bin FROM ({FUSED}) WHERE field_y IS NOT NULL AND (calibration_status IS NULL OR calibration_status = 'valid') AND (time_map_id IS NULL OR time_map_id = 'play-time-map'))
SELECT player_id, play_id, bin/10.0E0 AS play_time_s, field_x AS x_yards, field_y AS y_yards, shot_id, frame_index, pts, position_uncertainty_yards, calibration_id, source_tracklet_id FROM (SELECT *, row_number() OVER (PARTITION BY play_id, player_id, bin ORDER BY coalesce(position_uncertainty_yards, 'Infinity'::DOUBLE), -detection_score, shot_id, frame_index, tracklet_id) AS rn FROM r) WHERE rn = 1""")
def w9(v):
    from trackspark.plans.views import with_views
    from trackspark.sinks.tables import play_trajectories

    return play_trajectories(v.spark.sql(with_views("obs", FUSED, v.sf_dir)))


@query("w10_gap_sessions", "obs", """
SELECT tracklet_id, CAST(seg AS BIGINT) AS segment_no, CAST(count(*) AS BIGINT) AS n, min(frame_index) AS first_frame, max(frame_index) AS last_frame FROM (SELECT *, sum(CASE WHEN frame_index - prev > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY tracklet_id ORDER BY frame_index) AS seg FROM (SELECT *, lag(frame_index) OVER (PARTITION BY tracklet_id ORDER BY frame_index) AS prev FROM obs)) GROUP BY 1, 2""")
def w10(v):
    return TR.gap_segments(v.obs, 2).groupBy("tracklet_id", F.col("segment_no").cast("bigint").alias("segment_no")).agg(
        F.count("*").alias("n"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame")
    )


@query("w11_stride_throttle", "obs", """
SELECT * FROM (WITH RECURSIVE keep AS (SELECT tracklet_id, min(frame_index) AS frame_index FROM obs GROUP BY 1 UNION ALL SELECT k.tracklet_id, (SELECT min(o.frame_index) FROM obs o WHERE o.tracklet_id = k.tracklet_id AND o.frame_index >= k.frame_index + 6) FROM keep k WHERE k.frame_index IS NOT NULL)
SELECT tracklet_id, frame_index FROM keep WHERE frame_index IS NOT NULL)""".strip())
def w11(v):
    return TR.stride_throttle(v.obs, 6)


@query("w12_calibration_propagation")
def w12(v):
    """Small shifts per labelled frame carry every keyframe forward."""
    keys = CAL.close_intervals(v.keyframes)
    lines = keys.select(
        "shot_id", "keyframe_id", "pts_start", "pts_end", F.array("m00", "m01", "m02", "m10", "m11", "m12", "m20", "m21", "m22").alias("matrix"),
        F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((10.0, 20.0), (90.0, 25.0), (80.0, 46.5))]).alias("support_polygon"),
    )
    shift = (F.col("frame_index") % 3 - 1) * 0.25
    moves = v.frames.filter("labeled").select(
        "shot_id", "pts", F.array(F.lit(1.0), F.lit(0.0), shift, F.lit(0.0), F.lit(1.0), -shift, F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("motion")
    )
    out = CAL.propagate_timeline(lines, moves, max_gap_pts=6 * 1001)
    return out.select("shot_id", "keyframe_id", "calibration_id", "pts_start", "pts_end", F.round(F.get("matrix", F.lit(0)), 6).alias("m00"), F.round(F.get("matrix", F.lit(2)), 6).alias("m02"), F.size("support_polygon").alias("corners"))


@query("w13_trail_window", "obs", """
SELECT shot_id, tracklet_id, frame_index, CAST(count(*) OVER w AS BIGINT) AS trail_length, round(sum(round_even((x1+x2)/2, 0)) OVER w, 6) AS trail_x_sum, first_value(y2) OVER w AS oldest_y FROM obs WINDOW w AS (PARTITION BY shot_id, tracklet_id ORDER BY frame_index ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)""")
def w13(v):
    t = TR.trail_window(v.obs, 90)
    return t.select(
        "shot_id", "tracklet_id", "frame_index", F.size("trail").cast("bigint").alias("trail_length"),
        F.round(F.aggregate("trail", F.lit(0.0), lambda acc, p: acc + p["x"]), 6).alias("trail_x_sum"), F.get("trail", F.lit(0))["y"].alias("oldest_y"),
    )


@query("w14_even_samples", "boundaries dets", f""", {RANGES}
SELECT DISTINCT source_id, shot_no, CAST(start_frame + round_even(i*(end_frame-start_frame-1)/11.0E0, 0) AS BIGINT) AS source_frame FROM ranges, (SELECT unnest(range(0, 12)) AS i)""")
def w14(v):
    return SH.even_samples(source_ranges(v), 12).select("source_id", "shot_no", "source_frame")


@query("p20_scene_scores", "scores", """
, thumbs AS (SELECT source_no AS source_id, frame_index, [score*512, score*256, 255 - score*128] AS px FROM scores), near AS (SELECT *, lag(px) OVER (PARTITION BY source_id ORDER BY frame_index) AS p FROM thumbs)
SELECT source_id, frame_index, round((abs(px[1]-p[1])+abs(px[2]-p[2])+abs(px[3]-p[3]))/3/255, 9) AS score FROM near WHERE p IS NOT NULL""")
def p20(v):
    c = F.col("score")
    thumbs = v.scores.select(F.col("source_no").alias("source_id"), "frame_index", F.array(c * 512, c * 256, 255 - c * 128).alias("pixels"))
    return SH.scene_scores(thumbs).withColumn("score", F.round("score", 9))
