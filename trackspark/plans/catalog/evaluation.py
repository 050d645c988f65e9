"""Reference matching, tracking scores, identity scores and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.operators import evaluation as EV
from trackspark.plans.catalog import iou_sql, query
from trackspark.plans.views import with_views

EVALD = "evald AS (SELECT shot_id, frame_index FROM frames WHERE labeled AND NOT ignore_frame)"
MATCHED = f"""{EVALD}, matched AS (SELECT r.shot_id, r.frame_index, r.object_id, o.tracklet_id, {iou_sql('r', 'o')} AS iou FROM ref_sep r JOIN evald e ON e.shot_id = r.shot_id AND e.frame_index = r.frame_index
  JOIN obs_sep o ON o.shot_id = r.shot_id AND o.frame_index = r.frame_index WHERE {iou_sql('r', 'o')} >= 0.5)"""
VOTES = f"""{MATCHED}, votes AS (SELECT tracklet_id, object_id, count(*) AS votes FROM matched GROUP BY 1, 2),
 dominant AS (SELECT tracklet_id, object_id, total, votes*1.0E0/total AS purity FROM (SELECT *, sum(votes) OVER (PARTITION BY tracklet_id) AS total, row_number() OVER (PARTITION BY tracklet_id ORDER BY votes DESC, object_id) AS rn FROM votes) WHERE rn = 1)"""


@query("j8_injective_matches", "obs ref_objects", f"""
SELECT * FROM (WITH RECURSIVE e AS (SELECT r.shot_id AS s, r.frame_index AS f, r.object_id AS g, o.tracklet_id AS t, {iou_sql('r', 'o')} AS w FROM ref_objects r JOIN obs o ON r.shot_id = o.shot_id AND r.frame_index = o.frame_index WHERE {iou_sql('r', 'o')} >= 0.5),
 g AS (SELECT f, g, row_number() OVER (PARTITION BY f ORDER BY g) AS i, count(*) OVER (PARTITION BY f) AS n FROM (SELECT DISTINCT f, g FROM e)),
 p AS (SELECT DISTINCT f, 0::BIGINT AS i, n, []::VARCHAR[] AS used, []::VARCHAR[] AS pairs, 0.0E0 AS w FROM g
  UNION ALL SELECT p.f, p.i + 1, p.n, CASE WHEN x.t IS NULL THEN p.used ELSE list_append(p.used, x.t) END, CASE WHEN x.t IS NULL THEN p.pairs ELSE list_append(p.pairs, g.g || '=' || x.t) END, p.w + x.w
  FROM p JOIN g ON g.f = p.f AND g.i = p.i + 1 JOIN (SELECT f, g, t, w FROM e UNION ALL SELECT f, g, NULL, 0.0E0 FROM g) x ON x.f = p.f AND x.g = g.g WHERE x.t IS NULL OR NOT list_contains(p.used, x.t)),
 best AS (SELECT f, pairs FROM p WHERE i = n QUALIFY row_number() OVER (PARTITION BY f ORDER BY round(w, 9) DESC, pairs) = 1)
SELECT f AS frame_index, split_part(pair, '=', 1) AS object_id, split_part(pair, '=', 2) AS tracklet_id FROM (SELECT f, unnest(pairs) AS pair FROM best))""")
def j8(v):
    return EV.injective_matches(EV.reference_edges(v.ref_objects, v.obs, 0.5)).select("frame_index", "object_id", "tracklet_id")


@query("a6_reference_votes", "obs_sep ref_sep frames", f""", {VOTES}
SELECT tracklet_id, object_id, total AS total_votes, round(purity, 9) AS purity, purity >= 0.75 AS pure FROM dominant""".replace("total AS", "CAST(total AS BIGINT) AS"))
def a6(v):
    matched = EV.matches(v.ref_sep, v.obs_sep, v.frames)
    return EV.dominant_objects(EV.reference_votes(matched)).withColumn("purity", F.round("purity", 9))


STEPS = f"""{MATCHED}, steps AS (SELECT r.shot_id, r.frame_index, r.object_id, m.tracklet_id AS t FROM ref_sep r JOIN evald e ON e.shot_id = r.shot_id AND e.frame_index = r.frame_index
   LEFT JOIN matched m ON m.shot_id = r.shot_id AND m.frame_index = r.frame_index AND m.object_id = r.object_id),
 lagged AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY shot_id, object_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known, lag(t) OVER (PARTITION BY shot_id, object_id ORDER BY frame_index) AS prev FROM steps),
 flags AS (SELECT *, t IS NOT NULL AND known IS NOT NULL AS edge, coalesce(t = known, false) AS stable, coalesce(t <> known, false) AS switched, t IS NOT NULL AND known IS NOT NULL AND prev IS NULL AS resumed FROM lagged)"""


@query("w6_switches_fragmentation", "obs_sep ref_sep frames", f""", {STEPS}
SELECT shot_id, object_id, CAST(count(*) AS BIGINT) AS boxes, CAST(count(t) AS BIGINT) AS matched, CAST(sum(CASE WHEN switched THEN 1 ELSE 0 END) AS BIGINT) AS id_switches, CAST(sum(CASE WHEN resumed THEN 1 ELSE 0 END) AS BIGINT) AS fragmentation FROM flags GROUP BY 1, 2""")
def w6(v):
    matched = EV.matches(v.ref_sep, v.obs_sep, v.frames)
    steps = EV.identity_steps(v.ref_sep, matched, v.frames)
    return steps.groupBy("shot_id", "object_id").agg(
        F.count("*").alias("boxes"), F.count("tracklet_id").alias("matched"), F.count_if("switched").alias("id_switches"), F.count_if("resumed").alias("fragmentation")
    )


SHOT_METRICS = f"""{STEPS}, base AS (SELECT k.shot_id, coalesce(ef, 0) AS evaluated_frames, coalesce(gt, 0) AS gt, coalesce(hit, 0) AS hit, coalesce(pred, 0) - coalesce(hit, 0) AS fp, coalesce(edges,0) AS edges, coalesce(stables,0) AS stables, coalesce(sw, 0) AS sw, coalesce(fr, 0) AS fr
  FROM (SELECT DISTINCT shot_id FROM frames) k LEFT JOIN (SELECT shot_id, count(*) AS ef FROM evald GROUP BY 1) a ON a.shot_id = k.shot_id
  LEFT JOIN (SELECT shot_id, count(*) AS gt, count(t) AS hit, sum(edge::INT) AS edges, sum(stable::INT) AS stables, sum(switched::INT) AS sw, sum(resumed::INT) AS fr FROM flags GROUP BY 1) b ON b.shot_id = k.shot_id
  LEFT JOIN (SELECT o.shot_id, count(*) AS pred FROM obs_sep o JOIN evald e ON e.shot_id = o.shot_id AND e.frame_index = o.frame_index GROUP BY 1) c ON c.shot_id = k.shot_id),
 m AS (SELECT *, CASE WHEN gt > 0 THEN hit*1.0E0/gt ELSE 0 END AS cov, hit*1.0E0/(gt+fp) AS deta, CASE WHEN edges > 0 THEN stables*1.0E0/edges WHEN hit > 0 THEN 1 ELSE 0 END AS assa FROM base)"""
COUNT_COLS = "CAST({0}(evaluated_frames) AS BIGINT) AS evaluated_frames, CAST({0}(gt) AS BIGINT) AS ground_truth_detections, CAST({0}(hit) AS BIGINT) AS matched_detections, CAST({0}(fp) AS BIGINT) AS false_positives, CAST({0}(sw) AS BIGINT) AS id_switches, CAST({0}(fr) AS BIGINT) AS fragmentation"
RATIOS = ("coverage", "DetA", "AssA", "HOTA", "detection_f1")


def _rounded(df):
    for name in RATIOS:
        if name in df.columns:
            df = df.withColumn(name, F.round(name, 9))
    return df


@query("a7_shot_metrics", "obs_sep ref_sep frames", f""", {SHOT_METRICS}
SELECT shot_id, {COUNT_COLS.format('')}, round(cov,9) AS coverage, round(deta,9) AS "DetA", round(assa,9) AS "AssA", round(sqrt(deta*assa),9) AS "HOTA", round(2.0E0*hit/(2*hit+fp+gt-hit),9) AS detection_f1 FROM m""")
def a7(v):
    return _rounded(EV.shot_metrics(v.ref_sep, v.obs_sep, v.frames))


@query("a8_tracking_aggregate", "obs_sep ref_sep frames", f""", {SHOT_METRICS}
SELECT {COUNT_COLS.format('sum')}, round(sum(hit)*1.0E0/sum(gt),9) AS coverage, round(sum(hit)*1.0E0/(sum(gt)+sum(fp)),9) AS "DetA", round(sum(assa*hit)/sum(hit),9) AS "AssA", round(sqrt(sum(hit)*1.0E0/(sum(gt)+sum(fp))*sum(assa*hit)/sum(hit)),9) AS "HOTA" FROM m""")
def a8(v):
    return _rounded(EV.aggregate_metrics(EV.shot_metrics(v.ref_sep, v.obs_sep, v.frames), []))


@query("a9_standard_metrics")
def a9(v):
    out = EV.standard_metrics(v.ref_objects, v.obs, v.frames)
    for name in ("HOTA", "DetA", "AssA", "IDF1"):
        out = out.withColumn(name, F.round(name, 6))
    return out


PLACED = """SELECT *, CASE WHEN frame_index % 17 <> 0 THEN (x1+x2)/2.0E0*8/60 END AS field_x, CASE WHEN frame_index % 17 <> 0 THEN 20.0E0 + score END AS field_y, CASE WHEN tracklet_id LIKE '%t4' THEN 'unknown' WHEN CAST(right(tracklet_id, 1) AS INT) % 2 = 0 THEN 'A' ELSE 'B' END AS team FROM obs_sep"""
CONTACTS = f"""{EVALD}, placed AS ({PLACED}), c AS (SELECT r.* FROM ref_sep r JOIN evald e ON e.shot_id = r.shot_id AND e.frame_index = r.frame_index WHERE contact_confidence >= 0.5),
 errs AS (SELECT c.shot_id, c.frame_index, c.object_id, o.tracklet_id, sqrt(pow(o.field_x - c.contact_x,2) + pow(o.field_y - c.contact_y,2)) AS err FROM c LEFT JOIN placed o ON o.shot_id = c.shot_id AND o.frame_index = c.frame_index AND {iou_sql('c', 'o')} >= 0.5),
 doubled AS (SELECT shot_id, err FROM errs UNION ALL SELECT '*', err FROM errs),
 per AS (SELECT shot_id, count(err) AS n, count(*) - count(err) AS bad, median(err) AS med, quantile_cont(err, 0.95) AS p95 FROM doubled GROUP BY 1)"""


def placed(v):
    return v.spark.sql(with_views("obs_sep", PLACED, v.sf_dir))


@query("a10_ground_contact_error", "obs_sep ref_sep frames", f""", {CONTACTS}
SELECT shot_id, n AS evaluated_contacts, bad AS invalid_or_missing, round(med,9) AS median_error_yards, round(p95,9) AS p95_error_yards, round(n*1.0E0/(n+bad),9) AS valid_fraction, med <= 1.5 AS median_at_most_1_5_yards, n*1.0E0/(n+bad) >= 0.9 AS valid_fraction_at_least_0_90,
 CASE WHEN n > 0 THEN 'evaluated' ELSE 'not_evaluated' END AS status, CASE WHEN shot_id = '*' THEN (SELECT bool_and(med <= 1.5 AND n*1.0E0/(n+bad) >= 0.9) FROM per WHERE shot_id <> '*') END AS every_shot_gate_passes FROM per""")
def a10(v):
    report = EV.contact_report(EV.contact_rows(v.ref_sep, placed(v), v.frames))
    return report.select(
        "shot_id", "evaluated_contacts", "invalid_or_missing", *[F.round(c, 9).alias(c) for c in ("median_error_yards", "p95_error_yards", "valid_fraction")],
        "median_at_most_1_5_yards", "valid_fraction_at_least_0_90", "status", "every_shot_gate_passes",
    )


@query("a10_excluded_contacts", "ref_sep", """
SELECT shot_id, CAST(count(CASE WHEN contact_x IS NOT NULL AND contact_confidence < 0.5 THEN 1 END) AS BIGINT) AS excluded_low_confidence FROM ref_sep GROUP BY 1""")
def a10_excluded(v):
    return EV.excluded_contacts(v.ref_sep)


@query("a11_team_accuracy", "obs_sep ref_sep frames", f""", {EVALD}, placed AS ({PLACED}),
 l AS (SELECT r.shot_id, r.team AS expected, o.tracklet_id, o.team FROM (SELECT r.* FROM ref_sep r JOIN evald e ON e.shot_id = r.shot_id AND e.frame_index = r.frame_index) r LEFT JOIN placed o ON o.shot_id = r.shot_id AND o.frame_index = r.frame_index AND {iou_sql('r', 'o')} >= 0.5),
 per AS (SELECT shot_id, count(tracklet_id) AS n, sum(CASE WHEN team = expected THEN 1 ELSE 0 END) AS ok, count(*) - count(tracklet_id) AS miss FROM (SELECT * FROM l UNION ALL SELECT '*', expected, tracklet_id, team FROM l) GROUP BY 1)
SELECT shot_id, n AS assigned, CAST(ok AS BIGINT) AS correct, miss AS unknown_or_missing, round(ok*1.0E0/n,9) AS accuracy, round(n*1.0E0/(n+miss),9) AS coverage, ok*1.0E0/n >= 0.98 AS accuracy_at_least_0_98, n*1.0E0/(n+miss) >= 0.95 AS coverage_at_least_0_95, 'evaluated' AS status,
 CASE WHEN shot_id = '*' THEN (SELECT bool_and(ok*1.0E0/n >= 0.98 AND n*1.0E0/(n+miss) >= 0.95) FROM per WHERE shot_id <> '*') END AS every_shot_gate_passes FROM per""")
def a11(v):
    report = EV.team_report(EV.team_rows(v.ref_sep, placed(v), v.frames))
    return report.withColumn("accuracy", F.round("accuracy", 9)).withColumn("coverage", F.round("coverage", 9))


IDENTITIES = """SELECT DISTINCT tracklet_id, CASE WHEN tracklet_id LIKE '%t7' THEN 'P6' WHEN tracklet_id LIKE '%t1' AND CAST(substr(split_part(tracklet_id, ':', 1), 6) AS INT) % 4 = 0 THEN concat('solo-', tracklet_id) ELSE concat('P', right(tracklet_id, 1)) END AS player_id FROM obs_sep"""
GLOBALS = """SELECT DISTINCT shot_id, object_id, CASE WHEN object_id = 'p5' THEN 'Unknown' ELSE concat('G', right(object_id, 1)) END AS global_id FROM ref_sep"""


def identities(v):
    number = F.substring_index("tracklet_id", ":t", -1)
    shot_no = F.regexp_extract("tracklet_id", r"shot-(\d+)", 1).cast("int")
    return v.obs_sep.select("tracklet_id").distinct().select(
        "tracklet_id",
        F.when(number == "7", "P6").when((number == "1") & (shot_no % 4 == 0), F.concat(F.lit("solo-"), "tracklet_id")).otherwise(F.concat(F.lit("P"), number)).alias("player_id"),
    )


def global_map(v):
    return v.ref_sep.select("shot_id", "object_id").distinct().withColumn(
        "global_id", F.when(F.col("object_id") == "p5", "Unknown").otherwise(F.concat(F.lit("G"), F.substring("object_id", 2, 9)))
    )


TRUTH = f"""{VOTES}, ids AS ({IDENTITIES}), gmap AS ({GLOBALS}), truth AS (SELECT d.tracklet_id, g.shot_id, g.object_id, g.global_id FROM dominant d JOIN gmap g ON g.shot_id = split_part(d.tracklet_id, ':', 1) AND g.object_id = d.object_id WHERE d.purity >= 0.75)"""


@query("j14_truth_attribution", "obs_sep ref_sep frames", f""", {TRUTH} SELECT tracklet_id, shot_id, object_id, global_id FROM truth""")
def j14(v):
    matched = EV.matches(v.ref_sep, v.obs_sep, v.frames)
    return EV.truth_of_tracklets(EV.dominant_objects(EV.reference_votes(matched)), global_map(v))


CROSS = f"""{TRUTH}, att AS (SELECT t.*, i.player_id FROM truth t LEFT JOIN ids i ON i.tracklet_id = t.tracklet_id),
 pairs AS (SELECT a.tracklet_id AS l, b.tracklet_id AS r, a.global_id AS lg, b.global_id AS rg, a.global_id = b.global_id AS same_player, coalesce(a.player_id = b.player_id, false) AS same_id FROM att a JOIN att b ON a.tracklet_id < b.tracklet_id AND a.shot_id <> b.shot_id),
 shared AS (SELECT g.global_id, count(DISTINCT g.shot_id) AS s FROM gmap g WHERE lower(g.global_id) NOT IN ('','unknown','unresolved','ambiguous') AND EXISTS (SELECT 1 FROM ref_sep r JOIN evald e ON e.shot_id = r.shot_id AND e.frame_index = r.frame_index WHERE r.shot_id = g.shot_id AND r.object_id = g.object_id) GROUP BY 1 HAVING count(DISTINCT g.shot_id) >= 2),
 players AS (SELECT global_id, count(DISTINCT shot_id) AS s, count(DISTINCT player_id) AS i FROM att GROUP BY 1),
 idpairs AS (SELECT a.tracklet_id AS l, b.tracklet_id AS r FROM ids a JOIN ids b ON a.player_id = b.player_id AND a.tracklet_id < b.tracklet_id AND split_part(a.tracklet_id,':',1) <> split_part(b.tracklet_id,':',1)),
 dirty AS (SELECT i.player_id FROM obs_sep o JOIN ids i ON i.tracklet_id = o.tracklet_id GROUP BY i.player_id, o.shot_id, o.frame_index HAVING count(DISTINCT o.tracklet_id) > 1
   UNION SELECT player_id FROM att WHERE player_id IS NOT NULL GROUP BY player_id, shot_id HAVING count(DISTINCT global_id) > 1)"""


@query("a12_cross_shot_identity", "obs_sep ref_sep frames", f""", {CROSS}, nums AS (SELECT
  (SELECT count(*) FROM truth) AS attributed_tracklets, (SELECT count(*) FROM shared) AS eligible, (SELECT count(*) FROM shared k JOIN players p ON p.global_id = k.global_id WHERE p.s >= 2 AND p.i = 1) AS correct,
  (SELECT count(*) FROM pairs WHERE same_player) AS resolvable, (SELECT count(*) FROM pairs WHERE same_id) AS merged, (SELECT count(*) FROM pairs WHERE same_id AND same_player) AS good,
  (SELECT count(*) FROM idpairs WHERE l NOT IN (SELECT tracklet_id FROM truth) OR r NOT IN (SELECT tracklet_id FROM truth)) AS unattributed_pairs, (SELECT count(*) FROM dirty) AS dirty,
  (SELECT count(*) FROM dominant WHERE purity < 0.75) AS mixed, (SELECT count(*) FROM ids WHERE tracklet_id NOT IN (SELECT tracklet_id FROM truth)) AS loose)
SELECT 'evaluated' AS status, attributed_tracklets, eligible AS eligible_shared_players, correct AS correct_shared_players, correct*1.0E0/eligible AS coverage, resolvable AS resolvable_tracklet_pairs, merged AS merged_pairs, good AS true_merges, merged - good AS false_merges,
 round(good*1.0E0/merged, 9) AS precision, unattributed_pairs AS accepted_unattributed_pairs, dirty AS contaminated_players, mixed AS mixed_tracklets, loose AS unattributed_tracklets, merged = good AS false_merges_zero, dirty = 0 AND unattributed_pairs = 0 AND mixed = 0 AS components_clean, correct*1.0E0/eligible >= 0.8 AS coverage_at_least_0_80 FROM nums""")
def a12(v):
    out = EV.cross_shot_report(identities(v), v.obs_sep, v.ref_sep, v.frames, global_map(v))
    return out.withColumn("precision", F.round("precision", 9))


@query("t2_false_merge_examples", "obs_sep ref_sep frames", f""", {CROSS}
SELECT l AS left, r AS right, lg AS left_player, rg AS right_player FROM pairs WHERE same_id AND NOT same_player ORDER BY l, r LIMIT 20""".replace("AS left,", 'AS "left",').replace("AS right,", 'AS "right",'))
def t2_merges(v):
    matched = EV.matches(v.ref_sep, v.obs_sep, v.frames)
    truth = EV.truth_of_tracklets(EV.dominant_objects(EV.reference_votes(matched)), global_map(v))
    return EV.false_merge_examples(truth.join(identities(v), "tracklet_id", "left"))


def attributed(v):
    truth = EV.truth_of_tracklets(EV.dominant_objects(EV.reference_votes(EV.matches(v.ref_sep, v.obs_sep, v.frames))), global_map(v))
    return truth.join(identities(v), "tracklet_id", "left")


@query("t2_missed_link_examples", "obs_sep ref_sep frames", f""", {CROSS}
SELECT l AS "left", r AS "right", lg AS player FROM pairs WHERE same_player AND NOT same_id ORDER BY l, r LIMIT 20""")
def t2_missed(v):
    return EV.missed_link_examples(attributed(v))


@query("t2_missing_shared_players", "obs_sep ref_sep frames", f""", {TRUTH}, seen AS (SELECT g.global_id, count(DISTINCT g.shot_id) AS shots FROM gmap g JOIN (SELECT DISTINCT r.shot_id, r.object_id FROM ref_sep r JOIN frames f ON f.shot_id = r.shot_id AND f.frame_index = r.frame_index AND f.labeled AND NOT f.ignore_frame) o ON o.shot_id = g.shot_id AND o.object_id = g.object_id
  WHERE lower(trim(g.global_id)) NOT IN ('', 'unknown', 'unresolved', 'ambiguous') GROUP BY 1 HAVING count(DISTINCT g.shot_id) >= 2), per AS (SELECT t.global_id, count(DISTINCT t.shot_id) AS shots, count(DISTINCT i.player_id) AS ids FROM truth t LEFT JOIN ids i ON i.tracklet_id = t.tracklet_id GROUP BY 1)
SELECT s.global_id FROM seen s LEFT JOIN per p ON p.global_id = s.global_id WHERE NOT coalesce(p.shots >= 2 AND p.ids = 1, false)""")
def t2_missing(v):
    return EV.missing_shared_players(attributed(v), v.ref_sep, v.frames, global_map(v))


@query("t2_contact_examples", "obs_sep ref_sep frames", f""", {CONTACTS}
SELECT shot_id, frame_index, object_id, round(err, 9) AS error_yards, example_no FROM (SELECT *, CAST(row_number() OVER (PARTITION BY shot_id ORDER BY frame_index, object_id) AS INT) AS example_no FROM errs WHERE err IS NOT NULL) WHERE example_no <= 20""")
def t2_contacts(v):
    rows = EV.contact_rows(v.ref_sep, placed(v), v.frames).filter("error_yards is not null")
    return EV.first_examples(rows, ["shot_id"], ["frame_index", "object_id"]).select("shot_id", "frame_index", "object_id", F.round("error_yards", 9).alias("error_yards"), "example_no")


GATES = """SELECT o_custkey AS run_id, max(o_orderstatus) = 'P' AND min(o_orderkey) % 7 = 0 AS proxy_detector, CASE WHEN count(*) > 3 THEN 'evaluated' ELSE 'unavailable' END AS standard_status, (800 + sum(o_orderkey) % 200)/1000.0E0 AS idf1,
 (850 + min(o_orderkey) % 150)/1000.0E0 AS worst_shot_idf1, CAST(count(*) % 5 AS BIGINT) AS worst_shot_switches,
 CASE sum(o_orderkey) % 6 WHEN 0 THEN NULL WHEN 1 THEN 'unvalidated' WHEN 2 THEN 'invalid' ELSE 'valid' END AS calibration_status, CASE WHEN min(o_orderkey) % 5 = 0 THEN NULL ELSE max(o_orderkey) % 3 <> 0 END AS calibration_median_ok, max(o_orderkey) % 4 <> 0 AS calibration_p95_ok,
 CASE WHEN count(*) % 2 = 0 THEN 'evaluated' ELSE 'not_evaluated' END AS cross_status, CAST(sum(o_orderkey) % 4 AS BIGINT) AS false_merges, CASE WHEN min(o_orderkey) % 11 = 0 THEN NULL ELSE sum(o_orderkey) % 4 = 0 END AS false_merges_zero,
 CASE WHEN min(o_orderkey) % 13 = 0 THEN NULL ELSE max(o_orderkey) % 2 = 0 END AS components_clean, CASE WHEN count(*) = 6 THEN NULL ELSE CAST(count(*) % 8 AS BIGINT) END AS shared_eligible, CAST(count(*) % 6 AS BIGINT) AS shared_correct, 0.9E0 AS coverage,
 count(*) > 8 AS contact_supplied, CASE WHEN max(o_orderkey) % 3 = 0 THEN 'not_evaluated' ELSE 'evaluated' END AS contact_status, CASE WHEN max(o_orderkey) % 7 = 0 THEN NULL ELSE max(o_orderkey) % 5 < 4 END AS contact_gate, count(*) > 10 AS team_supplied, CASE WHEN max(o_orderkey) % 4 = 0 THEN 'not_evaluated' ELSE 'evaluated' END AS team_status, CASE WHEN max(o_orderkey) % 9 = 0 THEN NULL ELSE max(o_orderkey) % 6 < 5 END AS team_gate
 FROM orders GROUP BY o_custkey"""


@query("a13_promotion_gate", "", f"""
WITH r AS ({GATES}), s AS (SELECT *, standard_status = 'evaluated' AS st, cross_status = 'evaluated' AS cr, coalesce(shared_eligible > 0 AND shared_correct <= shared_eligible, false) AS usable FROM r),
 q AS (SELECT *, CASE WHEN usable THEN shared_correct*1.0E0/shared_eligible ELSE coverage END AS cov, coalesce(calibration_status IN ('unvalidated','partial','not_provided'), true) AS pend FROM s),
 w AS (SELECT run_id, [
 CASE WHEN proxy_detector THEN '!proxy detector results cannot satisfy the promotion gate' END, CASE WHEN NOT st THEN '!standard tracking metrics are unavailable' END,
 CASE WHEN st AND idf1 < 0.9 THEN 'IDF1 is below the promotion gate' END, CASE WHEN st AND worst_shot_idf1 < 0.9 THEN 'a shot is below the per-shot IDF1 gate' END, CASE WHEN st AND worst_shot_switches > 1 THEN 'a shot exceeds the identity-switch gate' END,
 CASE WHEN pend THEN concat('!calibration status is ', coalesce(calibration_status, 'missing')) WHEN calibration_status <> 'valid' THEN concat('calibration status is ', calibration_status)
   WHEN calibration_median_ok IS NULL THEN '!calibration gate evidence is missing' WHEN NOT (calibration_median_ok AND calibration_p95_ok) THEN 'calibration error is below the promotion gate' END,
 CASE WHEN NOT cr THEN '!cross-shot identity is not evaluated' END, CASE WHEN cr AND false_merges_zero IS NULL THEN '!cross-shot false-merge gate evidence is missing' WHEN cr AND NOT (false_merges_zero AND false_merges = 0) THEN 'cross-shot identity has false merges' END,
 CASE WHEN cr AND components_clean IS NULL THEN '!identity component gate evidence is missing' WHEN cr AND NOT components_clean THEN 'identity components are contaminated or unattributed' END,
 CASE WHEN cr AND shared_eligible IS NULL THEN '!cross-shot shared-player denominator is missing' WHEN cr AND NOT usable THEN '!cross-shot shared-player denominator is invalid' END,
 CASE WHEN cr AND cov < 0.8 THEN 'cross-shot coverage is below the promotion gate' END,
 CASE WHEN contact_supplied AND contact_status <> 'evaluated' THEN '!ground-contact position error is not evaluated' WHEN contact_supplied AND contact_gate IS NULL THEN '!ground-contact gate evidence is missing' WHEN contact_supplied AND NOT contact_gate THEN 'ground-contact position error is below the promotion gate' END,
 CASE WHEN team_supplied AND team_status <> 'evaluated' THEN '!team assignment is not evaluated' WHEN team_supplied AND team_gate IS NULL THEN '!team assignment gate evidence is missing' WHEN team_supplied AND NOT team_gate THEN 'team assignment is below the promotion gate' END] AS all_reasons FROM q)
SELECT run_id, replace(array_to_string(list_filter(all_reasons, lambda x: x IS NOT NULL), '; '), '!', '') AS reasons, CASE WHEN len(list_filter(all_reasons, lambda x: x IS NOT NULL)) = 0 THEN 'passed' WHEN len(list_filter(all_reasons, lambda x: x LIKE '!%')) > 0 THEN 'not_evaluated' ELSE 'failed' END AS gate_status FROM w""")
def a13(v):
    runs = v.spark.sql(with_views("", f"SELECT * FROM ({GATES})", v.sf_dir))
    return EV.promotion_gate(runs).select("run_id", F.concat_ws("; ", "reasons").alias("reasons"), "gate_status")
