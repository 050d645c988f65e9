"""Lookups by frame and time, overlap and reference joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.operators import calibrate as CAL
from trackspark.operators import shots as SH
from trackspark.operators import timing as TM
from trackspark.operators import tracks as TR
from trackspark.plans.catalog import iou_sql, query
from trackspark.plans.catalog.geometry import CLOSED, timeline

COUNTS = "counts AS (SELECT source_id, max(frame_index) + 50 AS frame_count FROM (SELECT source_id, frame_index FROM dets UNION ALL SELECT source_id, frame_index FROM boundaries) GROUP BY source_id)"
RANGES = f"""{COUNTS}, starts AS (SELECT DISTINCT b.source_id, b.frame_index AS s FROM boundaries b JOIN counts c ON c.source_id = b.source_id WHERE b.frame_index >= 0 AND b.frame_index < c.frame_count
  UNION SELECT source_id, 0 FROM counts), ranges AS (SELECT s.source_id, row_number() OVER (PARTITION BY s.source_id ORDER BY s) - 1 AS shot_no,
  s AS start_frame, coalesce(lead(s) OVER (PARTITION BY s.source_id ORDER BY s), frame_count) AS end_frame FROM starts s JOIN counts c ON c.source_id = s.source_id)"""


def source_ranges(v):
    bounds = v.boundaries
    counts = (
        v.dets.select("source_id", "frame_index").unionByName(bounds.select("source_id", "frame_index"))
        .groupBy("source_id").agg((F.max("frame_index") + 50).alias("frame_count"))
    )
    return SH.shot_ranges(bounds, counts)


@query("w1_shot_ranges", "boundaries dets", f""", {RANGES}
SELECT source_id, concat('shot-', CAST(shot_no AS STRING)) AS shot_id, start_frame, end_frame FROM ranges""")
def w1(v):
    return source_ranges(v).select("source_id", "shot_id", "start_frame", "end_frame")


@query("j1_shot_lookup", "boundaries dets", f""", {RANGES}
SELECT d.source_id, concat('shot-', CAST(shot_no AS STRING)) AS shot_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(frame_index*det_index) AS BIGINT) AS checksum
FROM dets d JOIN ranges r ON r.source_id = d.source_id AND d.frame_index >= start_frame AND d.frame_index < end_frame GROUP BY 1, 2""")
def j1(v):
    rows = SH.shot_of_frame(v.dets, source_ranges(v))
    return rows.groupBy("source_id", "shot_id").agg(
        F.count("*").alias("n"), F.sum(F.col("frame_index") * F.col("det_index")).alias("checksum")
    )


@query("j2_declared_shot_lookup", "boundaries dets", f""", {RANGES},
 declared AS (SELECT source_id, concat('cam-', CAST(frame_index AS STRING)) AS name, frame_index + 100 AS s, frame_index + 700 AS e FROM boundaries
   UNION ALL SELECT source_id, concat('alt-', CAST(frame_index AS STRING)), frame_index + 600, frame_index + 900 FROM boundaries),
 hits AS (SELECT d.source_id, d.frame_index, d.det_index, count(*) AS n, min(name) AS name FROM dets d JOIN declared x ON x.source_id = d.source_id AND d.frame_index >= s AND d.frame_index < e GROUP BY 1,2,3)
SELECT d.source_id, CASE WHEN h.n = 1 THEN h.name WHEN h.n IS NULL THEN concat('shot-', CAST(shot_no AS STRING)) END AS shot_id, coalesce(h.n, 0) > 1 AS overlapping, CAST(count(*) AS BIGINT) AS n
FROM dets d JOIN ranges r ON r.source_id = d.source_id AND d.frame_index >= start_frame AND d.frame_index < end_frame
LEFT JOIN hits h ON h.source_id = d.source_id AND h.frame_index = d.frame_index AND h.det_index = d.det_index GROUP BY 1,2,3""")
def j2(v):
    bounds = v.boundaries
    span = lambda name, s, e: bounds.select(
        "source_id", F.concat(F.lit(name), F.col("frame_index").cast("string")).alias("shot_id"),
        (F.col("frame_index") + s).alias("start_frame"), (F.col("frame_index") + e).alias("end_frame"),
    )
    declared = span("cam-", 100, 700).unionByName(span("alt-", 600, 900))
    rows = SH.declared_shot_of_frame(v.dets, declared, source_ranges(v), ["source_id", "frame_index", "det_index"])
    return rows.groupBy("source_id", "shot_id", "overlapping").agg(F.count("*").alias("n"))


SOURCE = "concat('game-', CAST(CAST(substr(shot_id, 6) AS INT) % 3 AS STRING))"


@query("j3_calibration_at_pts", "obs keyframes", f""", {CLOSED}, o AS (SELECT *, {SOURCE} AS source_id FROM obs)
SELECT o.shot_id, o.tracklet_id, o.frame_index, coalesce(k.keyframe_id, s.keyframe_id, g.keyframe_id) AS calibration_id FROM o
LEFT JOIN closed k ON k.shot_id = o.shot_id AND o.pts >= k.pts_start AND (k.pts_end IS NULL OR o.pts < k.pts_end)
LEFT JOIN (SELECT shot_id, max(keyframe_id) AS keyframe_id FROM keyframes GROUP BY shot_id HAVING count(*) > 4 AND max(key_no) % 2 = 0) s ON s.shot_id = o.shot_id
LEFT JOIN (SELECT {SOURCE} AS source_id, min(keyframe_id) AS keyframe_id FROM keyframes GROUP BY 1) g ON g.source_id = o.source_id AND o.source_id <> 'game-2'""")
def j3(v):
    """Shared fits of two games; the third has none."""
    keys = v.keyframes
    per_shot = keys.groupBy("shot_id").agg(F.count("*").alias("n"), F.max_by(F.struct(*keys.columns), "keyframe_id").alias("k"), F.max("key_no").alias("last"))
    own = per_shot.filter("n > 4 AND last % 2 = 0").select("k.*").withColumn("source_id", F.lit(None).cast("string"))
    of_game = keys.withColumn("source_id", F.expr(SOURCE)).filter("source_id <> 'game-2'").groupBy("source_id")
    shared = of_game.agg(F.min_by(F.struct(*keys.columns), "keyframe_id").alias("k")).select("k.*", "source_id").withColumn("shot_id", F.lit("*"))
    fits = own.unionByName(shared)
    rows = CAL.calibration_at(v.obs.withColumn("source_id", F.expr(SOURCE)), timeline(v), fits.select("source_id", "shot_id", CAL.as_fit(fits, "keyframe_id").alias("fit")))
    return rows.select("shot_id", "tracklet_id", "frame_index", F.col("fit.calibration_id").alias("calibration_id"))


SEGMENTS = """seg AS (SELECT *, lead(pts) OVER (PARTITION BY play_id, shot_id ORDER BY pts) AS to_pts, lead(play_time_s) OVER (PARTITION BY play_id, shot_id ORDER BY pts) AS to_s, lag(pts) OVER (PARTITION BY play_id, shot_id ORDER BY pts) IS NULL AS is_first FROM events_map)"""
TIMED = """timed AS (SELECT o.*, s.play_time_s + (o.pts - s.pts)*1.0E0/(s.to_pts - s.pts)*(s.to_s - s.play_time_s) AS mapped_s FROM obs o LEFT JOIN seg s ON s.play_id = o.play_id AND s.shot_id = o.shot_id AND s.to_pts IS NOT NULL
  AND (o.pts > s.pts OR (o.pts = s.pts AND s.is_first)) AND o.pts <= s.to_pts)"""


@query("j4_play_time_at_pts", "obs events_map", f""", {SEGMENTS}, {TIMED}
SELECT play_id, shot_id, tracklet_id, frame_index, round(mapped_s, 9) AS mapped_s FROM timed""")
def j4(v):
    rows = TM.time_at(v.obs.drop("play_time_s"), TM.time_segments(v.events_map), "mapped_s")
    return rows.select("play_id", "shot_id", "tracklet_id", "frame_index", F.round("mapped_s", 9).alias("mapped_s"))


ANCHORS = """SELECT play_id, shot_id, CASE WHEN sum(n) % 3 = 0 THEN NULL ELSE min(pts) END AS source_pts, min(frame_index) AS source_frame, CASE WHEN sum(n) % 2 = 0 THEN min(play_time_s) END AS anchor_s FROM events_map GROUP BY play_id, shot_id HAVING sum(n) % 7 <> 1"""


HAS_MAP = "CAST(substr(play_id, 6) AS INT) % 2 = 0"


@query("j5_play_time_by_anchor", "obs events_map", f""", seg AS (SELECT *, lead(pts) OVER w AS to_pts, lead(play_time_s) OVER w AS to_s, lag(pts) OVER w IS NULL AS is_first FROM (SELECT * REPLACE (CASE WHEN {HAS_MAP} THEN play_id ELSE concat('lost-', play_id) END AS play_id) FROM events_map) WINDOW w AS (PARTITION BY play_id, shot_id ORDER BY pts)), {TIMED},
 anchors AS ({ANCHORS})
SELECT t.play_id, t.shot_id, t.tracklet_id, t.frame_index, CASE WHEN {HAS_MAP.replace('play_id', 't.play_id')} THEN 'play-time-map' ELSE 'legacy-anchor-offset' END AS time_map_id,
 round(CASE WHEN {HAS_MAP.replace('play_id', 't.play_id')} THEN mapped_s WHEN a.source_pts IS NOT NULL THEN coalesce(a.anchor_s,0) + (t.pts - a.source_pts)*1.0E0/30000 ELSE (t.frame_index - a.source_frame)/30.0E0 END, 9) AS play_time_s
FROM timed t LEFT JOIN anchors a ON a.play_id = t.play_id AND a.shot_id = t.shot_id""")
def j5(v):
    from trackspark.plans.views import with_views

    # the events of every second play carry a play id that no row has
    segments = TM.time_segments(v.events_map.withColumn("play_id", F.expr(f"CASE WHEN {HAS_MAP} THEN play_id ELSE concat('lost-', play_id) END")))
    anchors = v.spark.sql(with_views("events_map", ANCHORS, v.sf_dir))
    rows = v.obs.drop("play_time_s").select("*", F.lit(1.0).alias("tb_num"), F.lit(30000).alias("tb_den"), F.lit(30.0).alias("fps"))
    out = TM.play_clock(rows, segments, anchors)
    return out.select("play_id", "shot_id", "tracklet_id", "frame_index", "time_map_id", F.round("play_time_s", 9).alias("play_time_s"))


@query("j6_play_membership", "obs events_map", """, spans AS (SELECT play_id, shot_id, min(frame_index) + 200 AS s, CASE WHEN sum(n) % 3 = 0 THEN NULL ELSE max(frame_index) END AS e FROM events_map GROUP BY 1, 2)
SELECT o.shot_id, p.play_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(o.frame_index) AS BIGINT) AS frame_sum FROM obs o LEFT JOIN spans p ON p.shot_id = o.shot_id AND o.frame_index >= p.s AND (p.e IS NULL OR o.frame_index < p.e) GROUP BY 1, 2""")
def j6(v):
    spans = v.events_map.groupBy("play_id", "shot_id").agg(
        (F.min("frame_index") + 200).alias("start_frame"), F.when(F.sum("n") % 3 != 0, F.max("frame_index")).alias("end_frame")
    )
    rows = SH.play_of_frame(v.obs.drop("play_id"), spans)
    return rows.groupBy("shot_id", "play_id").agg(F.count("*").alias("n"), F.sum("frame_index").alias("frame_sum"))


PAIRS = f"""pairs AS (SELECT a.shot_id, a.frame_index, a.tracklet_id AS l, b.tracklet_id AS r, {iou_sql('a', 'b')} AS iou FROM obs a JOIN obs b ON a.shot_id = b.shot_id AND a.frame_index = b.frame_index AND a.tracklet_id < b.tracklet_id WHERE {iou_sql('a', 'b')} >= 0.25)"""


@query("j7_track_conflicts", "obs", f""", {PAIRS}
SELECT shot_id, frame_index, l AS left_tracklet_id, r AS right_tracklet_id, round(iou, 6) AS iou FROM pairs""")
def j7(v):
    return TR.overlapping_pairs(v.obs, 0.25).withColumn("iou", F.round("iou", 6))


@query("j7_conflict_report", "obs", f""", {PAIRS}
SELECT s.shot_id, coalesce(c.n, 0) AS conflict_count, coalesce(t.n, 0) AS suspect_count, CASE WHEN c.n > 0 THEN 'review_required' ELSE 'no_conflicts_detected' END AS status
FROM (SELECT DISTINCT shot_id FROM obs) s LEFT JOIN (SELECT shot_id, count(*) AS n FROM pairs WHERE iou >= 0.5 GROUP BY 1) c ON c.shot_id = s.shot_id
LEFT JOIN (SELECT shot_id, count(DISTINCT id) AS n FROM (SELECT shot_id, l AS id FROM pairs WHERE iou >= 0.5 UNION ALL SELECT shot_id, r FROM pairs WHERE iou >= 0.5) GROUP BY 1) t ON t.shot_id = s.shot_id""")
def j7_report(v):
    return TR.conflict_report(v.obs, 0.5)


SPLITS = """splits AS (SELECT tracklet_id, concat(tracklet_id, ':a') AS segment_id, min(frame_index) AS s, min(frame_index) + 900 AS e FROM obs WHERE tracklet_id LIKE '%t3' GROUP BY 1
 UNION ALL SELECT tracklet_id, concat(tracklet_id, ':b'), min(frame_index) + CASE WHEN min(frame_index) % 2 = 0 THEN 900 ELSE 880 END, max(frame_index) + 1 FROM obs WHERE tracklet_id LIKE '%t3' GROUP BY 1
 UNION ALL SELECT tracklet_id, concat(tracklet_id, ':half'), min(frame_index) + 5, max(frame_index) - 100 FROM obs WHERE tracklet_id LIKE '%t5' GROUP BY 1
 UNION ALL SELECT concat(tracklet_id, '-gone'), concat(tracklet_id, ':x'), 0, 10 FROM obs WHERE tracklet_id LIKE '%t6' GROUP BY tracklet_id)"""


def splits(v):
    spans = v.obs.groupBy("tracklet_id").agg(F.min("frame_index").alias("f"), F.max("frame_index").alias("l"))
    make = lambda ends, suffix, start, end: spans.filter(F.col("tracklet_id").endswith(ends)).select(
        "tracklet_id", F.concat("tracklet_id", F.lit(suffix)).alias("segment_id"), start.alias("start_frame"), end.alias("end_frame")
    )
    f, l = F.col("f"), F.col("l")
    gone = make("t6", ":x", F.lit(0).cast("bigint"), F.lit(10).cast("bigint")).withColumn("tracklet_id", F.concat("tracklet_id", F.lit("-gone")))
    return (
        make("t3", ":a", f, f + 900)
        .unionByName(make("t3", ":b", f + F.when(f % 2 == 0, 900).otherwise(880), l + 1))
        .unionByName(make("t5", ":half", f + 5, l - 100)).unionByName(gone)
    )


@query("j13_reviewed_split_overlay", "obs", f""", {SPLITS}
SELECT o.tracklet_id, CASE WHEN p.segment_id IS NOT NULL THEN p.segment_id WHEN o.tracklet_id NOT IN (SELECT tracklet_id FROM splits) THEN o.tracklet_id END AS segment_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(frame_index) AS BIGINT) AS frame_sum
FROM obs o LEFT JOIN splits p ON p.tracklet_id = o.tracklet_id AND o.frame_index >= p.s AND o.frame_index < p.e GROUP BY 1, 2""")
def j13(v):
    rows = TR.refine_tracklets(v.obs, splits(v))
    return rows.groupBy("tracklet_id", "segment_id").agg(F.count("*").alias("n"), F.sum("frame_index").alias("frame_sum"))


@query("j13_split_violations", "obs", f""", {SPLITS}, spans AS (SELECT tracklet_id, min(frame_index) AS f, max(frame_index) AS l FROM obs GROUP BY 1)
SELECT tracklet_id, segment_id, 'unknown_tracklet' AS rule FROM splits WHERE tracklet_id NOT IN (SELECT tracklet_id FROM spans)
UNION ALL SELECT p.tracklet_id, segment_id, 'interval_outside_tracklet' FROM splits p JOIN spans x ON x.tracklet_id = p.tracklet_id WHERE e <= s OR s < f OR e > l + 1
UNION ALL SELECT tracklet_id, segment_id, 'overlapping_segments' FROM (SELECT *, lag(e) OVER (PARTITION BY tracklet_id ORDER BY s, e, segment_id) AS pe FROM splits) WHERE s < pe
UNION ALL SELECT DISTINCT o.tracklet_id, NULL, 'frames_not_covered' FROM obs o WHERE o.tracklet_id IN (SELECT tracklet_id FROM splits) AND NOT EXISTS (SELECT 1 FROM splits p WHERE p.tracklet_id = o.tracklet_id AND o.frame_index >= p.s AND o.frame_index < p.e)""")
def j13_rules(v):
    return TR.split_violations(v.obs, splits(v))
