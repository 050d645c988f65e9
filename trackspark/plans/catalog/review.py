"""Review queue, proposals, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.operators import review as RV
from trackspark.plans.catalog import query
from trackspark.plans.catalog.identity import EVIDENCE, evidence
from trackspark.plans.views import with_views
from trackspark.scale import total_order
from trackspark.session import cut_lineage

# links that SQL can state as well: by evidence score, plus unmatched tracklets
LINKS = """lk AS (SELECT left_key AS l, right_key AS r, CASE WHEN score >= 0.6 THEN 'same' ELSE 'insufficient_evidence' END AS decision, round(score, 6) AS sc, round(score/4, 6) AS alt, round(greatest(0, score - 0.5), 6) AS margin, CASE WHEN score < 0.6 THEN 'global_assignment_ambiguous' END AS why FROM ev WHERE reason IS NULL AND score >= 0.5
  UNION ALL SELECT DISTINCT left_key, NULL, 'insufficient_evidence', 0.0E0, NULL::DOUBLE, NULL::DOUBLE, 'no_eligible_edge' FROM ev WHERE left_key NOT IN (SELECT left_key FROM ev WHERE reason IS NULL AND score >= 0.5))"""


def simple_links(ev):
    strong = ev.filter("eligible and score >= 0.5")
    made = strong.select(
        "play_id", "left_key", "right_key", F.when(F.col("score") >= 0.6, "same").otherwise("insufficient_evidence").alias("decision"), F.round("score", 6).alias("score"),
        F.round(F.col("score") / 4, 6).alias("alternative_score"), F.round(F.greatest(F.lit(0.0), F.col("score") - 0.5), 6).alias("ambiguity_margin"),
        F.when(F.col("score") < 0.6, "global_assignment_ambiguous").alias("rejection_reason"),
    )
    alone = ev.select("play_id", "left_key").distinct().join(strong, "left_key", "left_anti").select(
        "play_id", "left_key", F.lit(None).cast("string").alias("right_key"), F.lit("insufficient_evidence").alias("decision"), F.lit(0.0).alias("score"),
        F.lit(None).cast("double").alias("alternative_score"), F.lit(None).cast("double").alias("ambiguity_margin"), F.lit("no_eligible_edge").alias("rejection_reason"),
    )
    return made.unionByName(alone)


#: Every review item with its kind, priority (``p2`` before rounding) and reasons.
ITEMS = f""", {EVIDENCE}, {LINKS}, play AS (SELECT DISTINCT tracklet_id, play_id FROM obs),
 ev2 AS (SELECT *, CASE WHEN gate IS NULL THEN n ELSE 0 END AS pn, CASE WHEN gate IS NULL AND n >= 5 THEN s2 - s1 ELSE 0 END AS span, CASE WHEN gate IS NULL AND n >= 5 THEN s1 END AS os, CASE WHEN gate IS NULL AND n >= 5 THEN s2 END AS oe, CASE WHEN gate IS NULL AND n >= 5 AND s2-s1 >= 0.4 THEN u50 END AS unc, CASE WHEN reason IS NULL THEN CASE WHEN rank IS NOT NULL THEN round_even(0.75*score + 0.25*rank, 6) ELSE score END END AS rr FROM ev),
 items AS (SELECT coalesce(e.left_key, k.l) AS l, coalesce(e.right_key, k.r) AS r, e.left_key IS NOT NULL AS he, k.l IS NOT NULL AS hl, decision, sc, alt, margin, why, pn, span, unc, rr, reason, lt, rt, e.conflict, e.score, os, oe FROM ev2 e LEFT JOIN lk k ON k.l = e.left_key AND k.r = e.right_key
   UNION ALL SELECT l, NULL, false, true, decision, sc, alt, margin, why, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM lk WHERE r IS NULL),
 kinds AS (SELECT *, CASE WHEN r IS NULL THEN 'unmatched' WHEN decision = 'same' THEN 'accepted' WHEN decision = 'insufficient_evidence' THEN 'ambiguous' WHEN reason IS NOT NULL THEN 'rejected' ELSE 'ambiguous' END AS kind,
   CASE WHEN he THEN (lt = 'unknown')::INT + (rt = 'unknown')::INT + (pn = 0)::INT + (coalesce(unc, 0) = 0)::INT ELSE 0 END AS blanks FROM items),
 v1 AS (SELECT *, CASE kind WHEN 'ambiguous' THEN 0.92E0 WHEN 'accepted' THEN 0.72E0 WHEN 'unmatched' THEN 0.52E0 ELSE 0.28E0 END + CASE WHEN margin IS NOT NULL THEN 0.2E0*(1 - least(1, margin/0.5)) ELSE 0 END + CASE WHEN sc IS NOT NULL THEN 0.1E0*(1 - abs(sc - 0.65)/0.65) ELSE 0 END + CASE WHEN rr IS NOT NULL THEN 0.15E0*rr ELSE 0 END AS p1 FROM kinds),
 v2 AS (SELECT *, CASE WHEN conflict THEN greatest(p1, 0.96E0) ELSE p1 END + CASE WHEN blanks > 0 THEN least(0.08E0, 0.02E0*blanks) ELSE 0 END + CASE WHEN he AND span < 1 THEN 0.03E0 ELSE 0 END AS p2 FROM v1),
 v3 AS (SELECT *, round(greatest(0, least(1, p2)), 4) AS priority, array_to_string(list_sort(list_distinct(list_filter([CASE kind WHEN 'ambiguous' THEN 'assignment_ambiguity' WHEN 'accepted' THEN 'accepted_link_needs_audit' WHEN 'unmatched' THEN 'unmatched_tracklet' ELSE 'candidate_rejection' END,
   CASE WHEN margin < 0.1 THEN 'low_assignment_margin' END, CASE WHEN hl THEN why END, CASE WHEN rr IS NOT NULL THEN 'multi_cue_review_rank' END, CASE WHEN conflict THEN 'reviewed_jersey_conflict' END, CASE WHEN he AND lt = 'unknown' THEN 'missing_left_team' END, CASE WHEN he AND rt = 'unknown' THEN 'missing_right_team' END,
   CASE WHEN he AND pn = 0 THEN 'missing_paired_sample_count' END, CASE WHEN he AND coalesce(unc,0) = 0 THEN 'missing_combined_uncertainty_yards' END, CASE WHEN he AND span < 1 THEN 'short_overlap' END, CASE WHEN he THEN reason END], lambda x: x IS NOT NULL))), ',') AS reasons FROM v2)"""


@query("t1_review_queue", "obs crops reads embeds", f"""{ITEMS}
SELECT p.play_id, l AS left_key, r AS right_key, kind, priority, reasons, substring(sha256(concat_ws(chr(0), p.play_id, l, coalesce(r, ''), kind)),1,16) AS review_item_id, coalesce(why, reason) AS rejection_reason, count(*) OVER (PARTITION BY p.play_id) AS total_item_count, count(*) OVER (PARTITION BY p.play_id) AS emitted_item_count FROM v3 JOIN play p ON p.tracklet_id = l""")
def t1(v):
    ev = cut_lineage(evidence(v))  # read by the links and the queue
    queue = RV.review_queue(simple_links(ev), ev, v.obs, max_items=None)
    return queue.select(
        "play_id", "left_key", "right_key", "kind", F.round("priority", 4).alias("priority"), F.concat_ws(",", "priority_reasons").alias("reasons"), "review_item_id", "rejection_reason",
        "total_item_count", "emitted_item_count",
    )


@query("t1_review_samples", "obs crops reads embeds", f"""{ITEMS},
 queue AS (SELECT *, CAST(row_number() OVER (PARTITION BY play_id ORDER BY p6 DESC, l, coalesce(r, ''), id) AS INT) AS queue_no FROM (SELECT p.play_id, l, r, os, oe, round(greatest(0, least(1, p2)), 6) AS p6, substring(sha256(concat_ws(chr(0), p.play_id, l, coalesce(r, ''), kind)),1,16) AS id FROM v3 JOIN play p ON p.tracklet_id = l)),
 counted AS (SELECT *, CASE WHEN oe >= os THEN CAST(least(3, greatest(1, floor((oe-os)/0.2E0) + 1)) AS INT) END AS c FROM queue WHERE queue_no <= 100),
 wanted AS (SELECT * EXCLUDE (c), c, unnest(range(0, coalesce(c, 1))) AS i FROM counted),
 timed AS (SELECT *, CASE WHEN c = 1 THEN (os+oe)/2 WHEN c > 1 THEN os + (oe-os)*i/(c-1) END AS target FROM wanted),
 ends AS (SELECT id, i, target, 'left' AS side, l AS tracklet_id FROM timed UNION ALL SELECT id, i, target, 'right', r FROM timed WHERE r IS NOT NULL),
 middle AS (SELECT tracklet_id, frame_index FROM (SELECT tracklet_id, frame_index, row_number() OVER (PARTITION BY tracklet_id ORDER BY frame_index, pts) - 1 AS rn, count(*) OVER (PARTITION BY tracklet_id) AS n FROM obs) WHERE rn = n // 2),
 hits AS (SELECT e.id, e.i, e.side, o.frame_index, row_number() OVER (PARTITION BY e.id, e.i, e.side ORDER BY abs(o.play_time_s - e.target), o.frame_index) AS rn FROM ends e JOIN obs o ON o.tracklet_id = e.tracklet_id AND abs(o.play_time_s - e.target) <= 0.1E0),
 found AS (SELECT id, i, side, frame_index FROM hits WHERE rn = 1 UNION ALL SELECT e.id, e.i, e.side, m.frame_index FROM ends e JOIN middle m ON m.tracklet_id = e.tracklet_id WHERE e.target IS NULL),
 seen AS (SELECT DISTINCT tracklet_id FROM obs),
 drawn AS (SELECT t.play_id, t.queue_no, t.id, t.i, t.target, t.r, a.frame_index AS lf, b.frame_index AS rf,
   CASE WHEN t.r IS NOT NULL AND a.frame_index IS NULL THEN CASE WHEN t.l IN (FROM seen) THEN 'no_observation_within_time_tolerance' ELSE 'no_tracklet_observations' END END AS lwhy,
   CASE WHEN t.r IS NOT NULL AND b.frame_index IS NULL THEN CASE WHEN t.r IN (FROM seen) THEN 'no_observation_within_time_tolerance' ELSE 'no_tracklet_observations' END END AS rwhy
   FROM timed t LEFT JOIN found a ON a.id = t.id AND a.i = t.i AND a.side = 'left' LEFT JOIN found b ON b.id = t.id AND b.i = t.i AND b.side = 'right')
SELECT play_id, queue_no, id AS review_item_id, CAST(count(DISTINCT concat(coalesce(CAST(lf AS STRING), '-'), ':', coalesce(CAST(rf AS STRING), '-'))) AS INT) AS sample_count, bool_or(lf IS NOT NULL AND (r IS NULL OR rf IS NOT NULL)) AS source_frames_available,
 round(max(CASE WHEN i = 0 THEN target END), 6) AS first_time_s, max(CASE WHEN i = 0 THEN lf END) AS first_left_frame, max(CASE WHEN i = 0 THEN rf END) AS first_right_frame, max(CASE WHEN i = 0 THEN lwhy END) AS first_left_missing, max(CASE WHEN i = 0 THEN rwhy END) AS first_right_missing
FROM drawn GROUP BY play_id, queue_no, id""")
def t1_samples(v):
    ev = cut_lineage(evidence(v))  # read by the links and the queue
    queue = RV.review_queue(simple_links(ev), ev, v.obs, max_items=100)
    first = F.get("samples", F.lit(0))
    return queue.select(
        "play_id", "queue_no", "review_item_id", F.size("samples").alias("sample_count"), "source_frames_available", F.round(first["requested_play_time_s"], 6).alias("first_time_s"),
        first["left"]["frame_index"].alias("first_left_frame"), first["right"]["frame_index"].alias("first_right_frame"),
        first["left_missing_reason"].alias("first_left_missing"), first["right_missing_reason"].alias("first_right_missing"),
    )


TARGETS = """SELECT event_id, tracklet_id, (event_id % 2500)*0.125E0 + (event_id % 7)/32.0E0 AS target_s FROM (SELECT event_id, concat('shot-', CAST(user_id % 6 AS STRING), ':t', CAST(1 + user_id % 7 AS STRING)) AS tracklet_id FROM events)"""


@query("j12_nearest_observation", "obs", f"""
SELECT event_id, tracklet_id, frame_index FROM (SELECT t.event_id, t.tracklet_id, o.frame_index, row_number() OVER (PARTITION BY t.event_id ORDER BY abs(o.play_time_s - t.target_s), o.frame_index) AS rn FROM ({TARGETS}) t JOIN obs o ON o.tracklet_id = t.tracklet_id AND abs(o.play_time_s - t.target_s) <= 0.1) WHERE rn = 1""")
def j12(v):
    targets = v.spark.sql(with_views("", f"SELECT * FROM ({TARGETS})", v.sf_dir))
    return RV.nearest_rows(targets, v.obs, ["event_id"]).select("event_id", "tracklet_id", F.col("row.frame_index").alias("frame_index"))


@query("j12_middle_row", "obs", """
SELECT tracklet_id, frame_index, pts FROM (SELECT *, row_number() OVER (PARTITION BY tracklet_id ORDER BY frame_index, pts) - 1 AS rn, count(*) OVER (PARTITION BY tracklet_id) AS n FROM obs) WHERE rn = n // 2""")
def j12_middle(v):
    return RV.middle_rows(v.obs).select("tracklet_id", "row.frame_index", "row.pts")


# one segment per line item, tilted by its part and supplier
SEGMENTS = """SELECT 'src' AS source_id, CAST(floor(l_orderkey/4.0) AS BIGINT) AS frame_index, CAST(l_partkey % 600 AS DOUBLE) AS x1, CAST(l_suppkey % 50 * 7 AS DOUBLE) AS y1, CAST(l_partkey % 600 + l_quantity*4 - 60 AS DOUBLE) AS x2, CAST(l_suppkey % 50 * 7 + (l_orderkey % 9 - 4)*25 AS DOUBLE) AS y2 FROM lineitem"""
LONGEST = f"""lines AS (SELECT *, sqrt(pow(x2-x1,2)+pow(y2-y1,2)) AS length FROM ({SEGMENTS})), top AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_id, frame_index ORDER BY length DESC, x1, y1, x2, y2) - 1 AS INT) AS line_no FROM lines)"""


def segments(v):
    return v.spark.sql(with_views("", f"SELECT * FROM ({SEGMENTS})", v.sf_dir))


@query("t6_longest_segments", "", f"""
WITH {LONGEST} SELECT frame_index, line_no, x1, y1, round(length, 9) AS length FROM top WHERE line_no < 100""")
def t6(v):
    return RV.longest_segments(segments(v)).select("frame_index", "line_no", "x1", "y1", F.round("length", 9).alias("length"))


CROSSINGS = f"""WITH {LONGEST.replace("top AS (", "top AS MATERIALIZED (")}, p AS (SELECT a.frame_index, a.line_no AS f, b.line_no AS s, a.x1, a.y1, a.x2-a.x1 AS adx, a.y2-a.y1 AS ady, b.x2-b.x1 AS bdx, b.y2-b.y1 AS bdy, b.x1-a.x1 AS dx, b.y1-a.y1 AS dy, a.length AS al, b.length AS bl FROM top a JOIN top b ON a.frame_index = b.frame_index AND a.line_no < b.line_no WHERE a.line_no < 100 AND b.line_no < 100),
 q AS (SELECT *, adx*bdy - ady*bdx AS c FROM p), m AS (SELECT *, (dx*bdy-dy*bdx)/c AS t, (dx*ady-dy*adx)/c AS u FROM q WHERE al >= 1 AND bl >= 1 AND abs(c) >= 0.25*al*bl)"""


@query("j16_segment_intersections", "", f"""
{CROSSINGS}
SELECT frame_index, f AS first_line, s AS second_line, round(x1+t*adx, 6) AS x, round(y1+t*ady, 6) AS y, round(least(al,bl)*(0.5+0.5*abs(c)/(al*bl)), 6) AS support FROM m WHERE t BETWEEN -0.15 AND 1.15 AND u BETWEEN -0.15 AND 1.15 AND x1+t*adx >= 4 AND x1+t*adx < 636 AND y1+t*ady >= 4 AND y1+t*ady < 356""")
def j16(v):
    out = RV.line_intersections(RV.longest_segments(segments(v)), 640, 360)
    return out.select("frame_index", "first_line", "second_line", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("support", 6).alias("support"))


@query("t5_suppressed_points", "", f"""
{CROSSINGS}, hit AS (SELECT frame_index, f, s, x1+t*adx AS x, y1+t*ady AS y, least(al,bl)*(0.5+0.5*abs(c)/(al*bl)) AS support FROM m WHERE t BETWEEN -0.15 AND 1.15 AND u BETWEEN -0.15 AND 1.15 AND x1+t*adx >= 4 AND x1+t*adx < 636 AND y1+t*ady >= 4 AND y1+t*ady < 356),
 lists AS (SELECT frame_index, list({{'x': x, 'y': y, 'support': support, 'f': f, 's': s}} ORDER BY -support, x, y, f, s) AS rest FROM hit GROUP BY 1)
SELECT 'src' AS source_id, frame_index, point_no, round_even(head.x, 3) AS kx, round_even(head.y, 3) AS ky, round_even(head.support, 3) AS support, head.f AS first_line, head.s AS second_line FROM (
WITH RECURSIVE pick AS (SELECT frame_index, CAST(0 AS INT) AS point_no, rest[1] AS head, list_filter(rest, lambda p: pow(round_even(rest[1].x, 3) - p.x, 2) + pow(round_even(rest[1].y, 3) - p.y, 2) >= 144) AS rest FROM lists
 UNION ALL SELECT frame_index, CAST(point_no + 1 AS INT), rest[1], list_filter(rest, lambda p: pow(round_even(rest[1].x, 3) - p.x, 2) + pow(round_even(rest[1].y, 3) - p.y, 2) >= 144) FROM pick WHERE len(rest) > 0 AND point_no < 199) SELECT * FROM pick)""")
def t5(v):
    return RV.suppress_points(RV.line_intersections(RV.longest_segments(segments(v)), 640, 360))


@query("t3_ordered_export", "obs", """
SELECT rank_no, shot_id, tracklet_id, frame_index FROM (SELECT *, CAST(row_number() OVER (ORDER BY frame_index, shot_id, tracklet_id) - 1 AS BIGINT) AS rank_no FROM obs)""")
def t3(v):
    rows = v.obs.select("shot_id", "tracklet_id", "frame_index")
    return total_order(rows, ["frame_index", "shot_id", "tracklet_id"], "rank_no").select("rank_no", "shot_id", "tracklet_id", "frame_index")


@query("p19_review_pack", "obs frames", """
SELECT o.shot_id AS source_id, o.frame_index, o.tracklet_id, o.x1, o.y1, o.x2, o.y2, o.score AS detection_score, 'unknown' AS team_suggestion, 0.0E0 AS team_score, round_even((o.x1+o.x2)/2, 3) AS contact_x, o.y2 AS contact_y, 'unreviewed' AS review_status FROM obs o JOIN frames f ON f.frame_index = o.frame_index AND f.shot_id = o.shot_id AND f.labeled""")
def p19(v):
    rows = v.obs.select(F.col("shot_id").alias("source_id"), "frame_index", "tracklet_id", "x1", "y1", "x2", "y2", F.col("score").alias("detection_score"), F.lit(None).cast("string").alias("team"), F.lit(None).cast("double").alias("team_score"))
    return RV.review_pack_rows(rows, v.frames.filter("labeled").select(F.col("shot_id").alias("source_id"), "frame_index"))


WORDS = """SELECT user_id AS crop_id, concat('#', CAST(user_id % 120 AS STRING), ' x', CAST(event_id % 7 AS STRING), '-', props) AS text, CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS STRING) END AS conf FROM events"""


@query("p21_digit_words", "", f"""
SELECT crop_id, CAST(tok AS INT) AS number, round_even(max(c), 4) AS confidence FROM (SELECT crop_id, TRY_CAST(conf AS DOUBLE)/100 AS c, unnest(list_filter(regexp_extract_all(text, '[0-9]+'), lambda t: len(t) <= 2)) AS tok FROM ({WORDS})) WHERE c BETWEEN 0 AND 1 AND c >= 0.25 GROUP BY 1, 2""")
def p21(v):
    return RV.digit_words(v.spark.sql(with_views("", f"SELECT * FROM ({WORDS})", v.sf_dir)), 0.25)


@query("u2_set_differences", "obs frames", """
SELECT shot_id, CAST(count(*) AS BIGINT) AS frames_without_rows, min(frame_index) AS first_missing FROM (SELECT shot_id, frame_index FROM frames EXCEPT SELECT shot_id, frame_index FROM obs) GROUP BY 1""")
def u2(v):
    missing = v.frames.select("shot_id", "frame_index").join(v.obs.select("shot_id", "frame_index"), ["shot_id", "frame_index"], "left_anti")
    return missing.groupBy("shot_id").agg(F.count("*").alias("frames_without_rows"), F.min("frame_index").alias("first_missing"))


@query("u3_shared_frames", "obs", """
SELECT a.shot_id, a.tracklet_id AS a, b.tracklet_id AS b, CAST(count(*) AS BIGINT) AS shared_frames FROM obs a JOIN obs b ON b.shot_id = a.shot_id AND b.frame_index = a.frame_index AND a.tracklet_id < b.tracklet_id GROUP BY 1,2,3""")
def u3(v):
    rows = v.obs.select("shot_id", "frame_index", "tracklet_id")
    a = rows.withColumnRenamed("tracklet_id", "a")
    b = rows.withColumnRenamed("tracklet_id", "b")
    return a.join(b, ["shot_id", "frame_index"]).filter("a < b").groupBy("shot_id", "a", "b").agg(F.count("*").alias("shared_frames"))
