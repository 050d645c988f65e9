"""Cross-shot evidence, links, components and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.operators import identity as ID
from trackspark.operators import pairs as PR
from trackspark.operators import teams as TE
from trackspark.plans.catalog import query
from trackspark.plans.catalog.aggregates import CUE_SQL, PAIRS, PROTOTYPES, TEAM_CTE, cue_comparison, shot_pairs, teams
from trackspark.plans.catalog.evaluation import IDENTITIES, identities
from trackspark.plans.views import with_views
from trackspark.session import cut_lineage

SAMPLES = """SELECT play_id, shot_id, tracklet_id, frame_index, pts, play_time_s, (x1+x2)/2.0E0*0.5 AS field_x, y2*0.25E0 AS field_y,
 CASE WHEN tracklet_id LIKE '%t6' THEN score*4 WHEN frame_index % 11 = 0 THEN NULL ELSE score END AS position_uncertainty_yards,
 CASE WHEN frame_index % 23 = 0 THEN 'invalid' WHEN frame_index % 29 = 0 THEN 'unvalidated' ELSE 'valid' END AS calibration_status FROM obs"""
SAMPLE_CTE = f"""samples AS (SELECT play_id, shot_id, tracklet_id, play_time_s AS s, field_x AS x, field_y AS y, coalesce(position_uncertainty_yards, 0) AS u FROM ({SAMPLES}) WHERE calibration_status = 'valid')"""


def samples(v):
    return PR.field_samples(v.spark.sql(with_views("obs", SAMPLES, v.sf_dir)))


@query("g5_field_tracks", "obs", f""", {SAMPLE_CTE}
SELECT tracklet_id, CAST(count(*) AS BIGINT) AS n, round(min(s),6) AS first_s, round(max(s),6) AS last_s, round(sum(x),6) AS sum_x, round(max(u),6) AS max_u FROM samples GROUP BY 1""")
def g5(v):
    s = samples(v)
    bad = PR.unordered_samples(s).groupBy("tracklet_id").agg(F.count("*").alias("bad"))
    return s.groupBy("tracklet_id").agg(
        F.count("*").alias("n"), F.round(F.min("play_time_s"), 6).alias("first_s"), F.round(F.max("play_time_s"), 6).alias("last_s"),
        F.round(F.sum("x"), 6).alias("sum_x"), F.round(F.max("uncertainty"), 6).alias("max_u"),
    ).join(bad, "tracklet_id", "left_anti")


# samples 0.125 s apart and a 0.05 s tolerance: only equal times can pair
EVIDENCE = f"""{PAIRS}, {CUE_SQL}, {TEAM_CTE}, {SAMPLE_CTE}, rated AS (SELECT *, source = 'rgb_prototype' AND team <> 'unknown' AND score > 0 AND assignment_coverage > 0 AND ambiguity < 0.5 AS ok FROM teams)""".replace("rated AS (SELECT tracklet_id, n", "rated0 AS (SELECT tracklet_id, n").replace("FROM rated)", "FROM rated0)") + """,
 gated AS (SELECT c.*, coalesce(a.team,'unknown') AS lt, coalesce(b.team,'unknown') AS rt, coalesce(a.score,0) AS ls, coalesce(b.score,0) AS rs, CASE WHEN c.conflict THEN 'reviewed_jersey_mismatch' WHEN NOT coalesce(a.ok,false) THEN 'left_team_ineligible' WHEN NOT coalesce(b.ok,false) THEN 'right_team_ineligible' WHEN a.team <> b.team THEN 'team_mismatch' END AS gate
   FROM cue c LEFT JOIN rated a ON a.tracklet_id = c.left_key LEFT JOIN rated b ON b.tracklet_id = c.right_key),
 joined AS (SELECT g.left_key, g.right_key, a.s, a.x AS lx, a.y AS ly, b.x AS rx, b.y AS ry, a.u + b.u AS u, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) AS d FROM gated g JOIN samples a ON a.tracklet_id = g.left_key JOIN samples b ON b.tracklet_id = g.right_key AND b.s = a.s WHERE g.gate IS NULL),
 st AS (SELECT left_key, right_key, count(*) AS n, min(s) AS s1, max(s) AS s2, median(u) AS u50, median(d) AS d50, quantile_cont(d, 0.9) AS d90, arg_max(lx,s)-arg_min(lx,s) AS ldx, arg_max(ly,s)-arg_min(ly,s) AS ldy, arg_max(rx,s)-arg_min(rx,s) AS rdx, arg_max(ry,s)-arg_min(ry,s) AS rdy FROM joined GROUP BY 1,2),
 ev0 AS (SELECT g.*, coalesce(n,0) AS n, s1, s2, u50, d50, d90, CASE WHEN sqrt(ldx*ldx+ldy*ldy) < 1e-6 OR sqrt(rdx*rdx+rdy*rdy) < 1e-6 THEN 0.5 ELSE greatest(0, least(1, ((ldx*rdx+ldy*rdy)/(sqrt(ldx*ldx+ldy*ldy)*sqrt(rdx*rdx+rdy*rdy))+1)/2)) END AS shape,
   CASE WHEN gate IS NOT NULL THEN gate WHEN coalesce(n,0) < 5 THEN 'insufficient_overlap_samples' WHEN s2 - s1 < 0.4 THEN 'insufficient_overlap_duration' WHEN u50 > 2 THEN 'position_uncertainty_exceeds_limit' WHEN d90 > 6 THEN 'field_distance_exceeds_limit' END AS reason FROM gated g LEFT JOIN st ON st.left_key = g.left_key AND st.right_key = g.right_key),
 ev AS (SELECT *, CASE WHEN reason IS NULL THEN greatest(0, least(1, (0.55*(1-d50/6)+0.30*shape+0.15*ls*rs)*exp(-u50/2))) END AS score FROM ev0)"""


def evidence(v, with_cues: bool = True):
    pairs = cut_lineage(shot_pairs(v))
    return PR.pair_evidence(pairs, samples(v), teams(v), cue_comparison(v, pairs) if with_cues else None)


@query("j9_candidate_evidence", "obs crops reads embeds", f""", {EVIDENCE}
SELECT left_key, right_key, lt AS left_team, rt AS right_team, CASE WHEN gate IS NULL THEN n ELSE 0 END AS paired_sample_count, CASE WHEN gate IS NULL AND n >= 5 THEN round(s1,6) END AS overlap_start_s, CASE WHEN gate IS NULL AND n >= 5 THEN round(s2-s1,6) ELSE 0 END AS overlap_span_s,
 CASE WHEN gate IS NULL AND n >= 5 AND s2-s1 >= 0.4 THEN round(u50,6) END AS combined_uncertainty_yards, CASE WHEN gate IS NULL AND n >= 5 AND s2-s1 >= 0.4 AND u50 <= 2 THEN round(d50,6) END AS median_distance_yards,
 CASE WHEN gate IS NULL AND n >= 5 AND s2-s1 >= 0.4 AND u50 <= 2 THEN round(d90,6) END AS p90_distance_yards, CASE WHEN reason IS NULL THEN round(shape,6) END AS shape_agreement, round(score,6) AS score, reason IS NULL AS eligible, reason AS rejection_reason FROM ev""")
def j9(v):
    e = evidence(v)
    r = lambda name: F.round(name, 6).alias(name)
    return e.select(
        "left_key", "right_key", "left_team", "right_team", "paired_sample_count", r("overlap_start_s"), r("overlap_span_s"), r("combined_uncertainty_yards"),
        r("median_distance_yards"), r("p90_distance_yards"), r("shape_agreement"), r("score"), "eligible", "rejection_reason",
    )


@query("j10_eligible_scores", "obs crops reads embeds", f""", {EVIDENCE}
SELECT left_key, right_key, round(score, 6) AS score FROM ev WHERE reason IS NULL""")
def j10(v):
    return PR.eligible_scores(evidence(v)).select("left_key", "right_key", F.round("score", 6).alias("score"))


@query("a26_shape_agreement", "obs crops reads embeds", f""", {EVIDENCE}
SELECT left_key, right_key, round(shape, 9) AS shape FROM ev WHERE gate IS NULL AND n >= 5""")
def a26(v):
    pairs, placed = cut_lineage(shot_pairs(v)), cut_lineage(samples(v))
    open_pairs = PR.pair_evidence(pairs, placed, teams(v), cue_comparison(v, pairs)).filter(
        "rejection_reason is null or rejection_reason in ('position_uncertainty_exceeds_limit','field_distance_exceeds_limit','insufficient_overlap_duration')"
    )
    joined = PR.paired_samples(open_pairs, placed)
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ends = joined.groupBy("left_key", "right_key").agg(
        F.count("*").alias("n"), F.min_by(p("lx", "ly"), "left_s").alias("fl"), F.max_by(p("lx", "ly"), "left_s").alias("ll"),
        F.min_by(p("rx", "ry"), "left_s").alias("fr"), F.max_by(p("rx", "ry"), "left_s").alias("lr"),
    )
    shape = PR.shape_agreement(F.col("fl"), F.col("ll"), F.col("fr"), F.col("lr"), F.col("n"))
    return ends.select("left_key", "right_key", F.round(shape, 9).alias("shape"))


@query("j11_monotone_pairing")
def j11(v):
    """Dense clocks: neighbours lie inside the tolerance, so the order of use matters."""
    dense = samples(v).withColumn("play_time_s", F.col("play_time_s") * 0.25 + F.when(F.col("shot_id").endswith("1"), 0.011).otherwise(0.0))
    rows = PR.paired_samples(shot_pairs(v), dense)
    return rows.groupBy("left_key", "right_key").agg(
        F.count("*").alias("pairs"), F.round(F.max(F.abs(F.col("left_s") - F.col("right_s"))), 6).alias("max_gap_s"), F.count_distinct("right_s").alias("right_used")
    )


@query("g1_matching_with_abstention")
def g1(v):
    tracks = samples(v).select("play_id", "shot_id", "tracklet_id").distinct()
    lefts, _ = ID.shot_pair_tracks(tracks)
    links = ID.match_tracklets(lefts, PR.eligible_scores(evidence(v, False)), threshold=0.5)
    return links.withColumn("score", F.round("score", 6)).withColumn("alternative_score", F.round("alternative_score", 6)).withColumn("ambiguity_margin", F.round("ambiguity_margin", 6))


LINK_SQL = """nodes AS (SELECT DISTINCT tracklet_id, CAST(substr(split_part(tracklet_id,':',1),6) AS INT) AS k, CAST(right(tracklet_id,1) AS INT) AS line FROM obs),
 links AS (SELECT a.tracklet_id AS l, b.tracklet_id AS r FROM nodes a JOIN nodes b ON b.line = a.line AND b.k = a.k + 1 AND (a.line + a.k) % 3 <> 0)"""


def chain_links(v):
    nodes = cut_lineage(v.obs.select("tracklet_id", "play_id").distinct().select(  # one row per tracklet, read often
        "tracklet_id", "play_id", F.regexp_extract("tracklet_id", r"shot-(\d+)", 1).cast("int").alias("k"), F.substring_index("tracklet_id", ":t", -1).cast("int").alias("line")
    ))
    right = nodes.select(F.col("tracklet_id").alias("right_key"), (F.col("k") - 1).alias("k"), "line")
    return nodes, nodes.join(right, ["k", "line"]).filter((F.col("line") + F.col("k")) % 3 != 0).select(F.col("tracklet_id").alias("left_key"), "right_key")


@query("g2_player_ids", "obs", f"""
SELECT * FROM (WITH RECURSIVE {{}} , e AS (SELECT l AS a, r AS b FROM links UNION ALL SELECT r, l FROM links), walk AS (SELECT tracklet_id AS id, tracklet_id AS seen FROM nodes UNION SELECT w.id, e.b FROM walk w JOIN e ON e.a = w.seen),
 comp AS (SELECT id, min(seen) AS root FROM walk GROUP BY 1), num AS (SELECT root, row_number() OVER (ORDER BY root) AS i FROM (SELECT DISTINCT root FROM comp))
SELECT id AS tracklet_id, concat('P', CASE WHEN i < 100 THEN lpad(CAST(i AS STRING), 2, '0') ELSE CAST(i AS STRING) END) AS player_id FROM comp JOIN num ON num.root = comp.root)""".replace("{}", LINK_SQL))
def g2(v):
    nodes, links = chain_links(v)
    return ID.player_ids(nodes, links)


def _attributes(v, plays=None):
    plays = v.obs.select("tracklet_id", "play_id").distinct() if plays is None else plays.select("tracklet_id", "play_id")
    t = TE.team_by_prototype(plays, v.crops, PROTOTYPES).select("tracklet_id", "team")
    from trackspark.operators.cues import reviewed_numbers
    from trackspark.plans.catalog.aggregates import candidates

    numbers = reviewed_numbers(v.reads, candidates(v)).withColumn("number", F.col("number") % 4).groupBy("tracklet_id").agg(F.sort_array(F.collect_set("number")).alias("jerseys"))
    return plays.join(t, "tracklet_id", "left").join(numbers, "tracklet_id", "left")


@query("g3_safe_links")
def g3(v):
    nodes, links = chain_links(v)
    extra = nodes.join(nodes.select(F.col("tracklet_id").alias("right_key"), "k", (F.col("line") - 2).alias("line")), ["k", "line"]).select(F.col("tracklet_id").alias("left_key"), "right_key")
    proposed = links.unionByName(extra).withColumn("decision", F.lit("same")).withColumn("play_id", F.lit("all"))
    return ID.safe_links(proposed, _attributes(v, nodes), v.obs)


@query("g4_play_resolution")
def g4(v):
    plays = v.obs.select("play_id", "shot_id").distinct()
    out = ID.resolve_plays(plays, samples(v), teams(v), v.obs, _attributes(v), threshold=0.5)
    return out["status"].withColumn("unresolved_shots", F.concat_ws(",", "unresolved_shots"))


LADDER = """SELECT concat('play-', CAST(o_custkey AS STRING)) AS play_id, CAST(count(*) % 4 AS INT) AS present_shots, max(o_orderkey) % 2 = 0 AS has_timeline, min(o_orderkey) % 3 <> 0 AS has_static, min(o_orderkey) % 5 = 0 AS has_shared, sum(o_orderkey) % 4 <> 0 AS timing_eligible, CAST(sum(o_orderkey) % 3 AS INT) AS uncalibrated_shots FROM orders GROUP BY o_custkey"""


@query("g6_abstention_ladder", "", f"""
SELECT play_id, reason, CASE WHEN reason IS NULL THEN 'resolve' ELSE 'abstained' END AS status FROM (SELECT play_id, CASE WHEN present_shots < 2 THEN 'no calibrated field positions for the aligned shots'
 WHEN NOT has_timeline AND has_static AND has_shared THEN 'cross-shot resolution requires shot-specific calibration' WHEN NOT has_timeline AND has_static THEN 'legacy static calibration is unvalidated for cross-shot identity; supply a schema-v2 timeline with withheld landmarks'
 WHEN NOT timing_eligible THEN 'play-time map or alignment source hash has no passing validation' WHEN uncalibrated_shots > 0 THEN 'cross-shot resolution requires shot-specific calibration' END AS reason FROM ({LADDER}))""")
def g6(v):
    return ID.resolution_ladder(v.spark.sql(with_views("", f"SELECT * FROM ({LADDER})", v.sf_dir))).select("play_id", "reason", "status")


RAW_LINKS = """SELECT concat('play-', CAST(o_custkey % 40 AS STRING)) AS play_id, concat('shot-0:t', CAST(o_orderkey % 7 AS STRING)) AS left_key, CASE WHEN o_orderstatus <> 'P' THEN concat('shot-1:t', CAST(o_orderkey % 5 AS STRING)) END AS right_key,
 CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P' THEN 'same' ELSE 'insufficient_evidence' END AS decision, o_totalprice/1000000.0E0 AS score FROM orders"""


@query("u4_link_dedupe", "", f"""
SELECT play_id, left_key, right_key, decision, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY play_id, left_key, right_key ORDER BY decision = 'same' DESC, score DESC) AS rn FROM ({RAW_LINKS})) WHERE rn = 1""")
def u4(v):
    raw = v.spark.sql(with_views("", f"SELECT * FROM ({RAW_LINKS})", v.sf_dir))
    return ID.dedupe_links(raw).withColumn("score", F.round("score", 9))


@query("a27_identity_coverage", "obs_sep", f"""
SELECT CAST(sum(n) AS BIGINT) AS tracklet_count, CAST(count(*) AS BIGINT) AS player_id_count, CAST(sum(CASE WHEN s > 1 THEN 1 ELSE 0 END) AS BIGINT) AS cross_shot_player_ids FROM (SELECT player_id, count(*) AS n, count(DISTINCT split_part(tracklet_id,':',1)) AS s FROM ({IDENTITIES}) GROUP BY 1)""")
def a27(v):
    return ID.identity_coverage(identities(v))
