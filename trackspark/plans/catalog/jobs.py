"""Trackers, streams, plug-ins, run checks and end-to-end jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.operators import calibrate as CAL
from trackspark.operators import runs as RN
from trackspark.operators import tracking as TK
from trackspark.plans import run as RUN
from trackspark.plans.catalog import query
from trackspark.plans.catalog.aggregates import PROTOTYPES, candidates
from trackspark.plans.catalog.identity import RAW_LINKS
from trackspark.plans.catalog.scans import scratch
from trackspark.plans.views import with_views
from trackspark.session import cut_lineage
from trackspark.sources.artifacts import REQUIRED, list_artifacts, missing_artifacts
from trackspark.streaming import stateful as ST
from trackspark.streaming import windows as SW


def shot_detections(v):
    """Valid player boxes of the observation view as detections of one source."""
    return v.obs.select(
        F.lit("src").alias("source_id"), "shot_id", "frame_index", "pts", F.substring_index("tracklet_id", ":t", -1).cast("int").alias("det_index"), "x1", "y1", "x2", "y2", "score",
    )


#: The whole greedy tracker, one frame of every shot per step: live tracks and picks are lists, the best pair of those left is taken first.
GREEDY = """, d AS (SELECT shot_id, frame_index AS f, list({'d': det, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} ORDER BY det) AS dets, row_number() OVER (PARTITION BY shot_id ORDER BY frame_index) AS k
  FROM (SELECT *, CAST(string_split(tracklet_id, ':t')[2] AS INT) AS det FROM obs) GROUP BY shot_id, frame_index)
SELECT shot_id, concat(shot_id, ':t', CAST(no AS STRING)) AS tracklet_id, CAST(count(*) AS BIGINT) AS n, min(f) AS first_frame, max(f) AS last_frame FROM (
WITH RECURSIVE walk AS (
  SELECT shot_id, k, f, CAST(len(dets) AS BIGINT) AS made, list_transform(dets, lambda x, i: {'no': CAST(i AS BIGINT), 'f': f, 'x1': x.x1, 'y1': x.y1, 'x2': x.x2, 'y2': x.y2, 'now': true}) AS live
  FROM d WHERE k = 1
  UNION ALL
  SELECT shot_id, k, f, made + len(dets) - len(got),
    list_concat(
      list_transform(alive, lambda t: CASE WHEN len(list_filter(got, lambda g: g.no = t.no)) = 0 THEN {'no': t.no, 'f': t.f, 'x1': t.x1, 'y1': t.y1, 'x2': t.x2, 'y2': t.y2, 'now': false}
        ELSE list_transform(list_filter(got, lambda g: g.no = t.no), lambda g: {'no': t.no, 'f': f, 'x1': g.x1, 'y1': g.y1, 'x2': g.x2, 'y2': g.y2, 'now': true})[1] END),
      list_transform(list_filter(dets, lambda x: len(list_filter(got, lambda g: g.d = x.d)) = 0), lambda x, i: {'no': made + i, 'f': f, 'x1': x.x1, 'y1': x.y1, 'x2': x.x2, 'y2': x.y2, 'now': true})) AS live
  FROM (
    SELECT *, CASE WHEN len(pairs) = 0 THEN [] ELSE list_reduce(list_transform(pairs, lambda p: [p]), lambda a, b: CASE WHEN len(list_filter(a, lambda q: q.no = b[1].no OR q.d = b[1].d)) > 0 THEN a ELSE list_concat(a, b) END) END AS got FROM (
      SELECT *, list_sort(list_filter(flatten(list_transform(alive, lambda t: list_transform(dets, lambda x: {'s': -(greatest(0, least(t.x2, x.x2) - greatest(t.x1, x.x1)) * greatest(0, least(t.y2, x.y2) - greatest(t.y1, x.y1))
          / ((t.x2 - t.x1) * (t.y2 - t.y1) + (x.x2 - x.x1) * (x.y2 - x.y1) - greatest(0, least(t.x2, x.x2) - greatest(t.x1, x.x1)) * greatest(0, least(t.y2, x.y2) - greatest(t.y1, x.y1)))),
        'no': t.no, 'd': x.d, 'x1': x.x1, 'y1': x.y1, 'x2': x.x2, 'y2': x.y2}))), lambda p: p.s <= -0.2E0)) AS pairs FROM (
        SELECT w.shot_id, d.k, d.f, w.made, d.dets, list_filter(w.live, lambda t: d.f - t.f <= 31) AS alive FROM walk w JOIN d ON d.shot_id = w.shot_id AND d.k = w.k + 1))))
SELECT shot_id, k, f, unnest(list_transform(list_filter(live, lambda t: t.now), lambda t: t.no)) AS no FROM walk)
GROUP BY 1, 2"""


@query("g7_iou_tracker", "obs", GREEDY)
def g7(v):
    out = TK.track_shots(shot_detections(v))
    return out.groupBy("shot_id", "tracklet_id").agg(F.count("*").alias("n"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"))


END = "end-of-stream"


def as_stream(v, df, name: str):
    """The rows as a file stream: Spark writes them once and reads them back as they arrive.

    One closing row far in the future lets the watermark pass every real row.
    """
    path = scratch(v, name)
    texts = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    closing = df.agg((F.max("frame_index") + 10_000_000).alias("frame_index")).select(
        *[F.lit(END).alias(c) if c in texts else (F.col(c) if c == "frame_index" else F.lit(0).cast(df.schema[c].dataType).alias(c)) for c in df.columns]
    )
    timed = df.unionByName(closing).withColumn("ts", (F.col("frame_index") * 0.04 + 1_700_000_000).cast("timestamp"))
    timed.repartitionByRange(4, "frame_index").write.parquet(path)
    return v.spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 2).parquet(path)


def collected(v, stream, name: str):
    out = scratch(v, name)
    SW.drain(stream, out, scratch(v, name + "-state"), timeout_s=300)
    rows = v.spark.read.schema(stream.schema).parquet(out)
    key = next(c for c in ("shot_id", "tracklet_id", "source_hash") if c in rows.columns)
    return rows.filter(F.col(key) != END)


@query("st1_stateful_tracking", "obs", GREEDY)
def st1(v):
    dets = shot_detections(v).select("source_id", "shot_id", "frame_index", "det_index", "x1", "y1", "x2", "y2")
    out = collected(v, ST.track_stream(as_stream(v, dets, "tracker-in"), "60 seconds"), "tracker-out")
    return out.groupBy("shot_id", "tracklet_id").agg(F.count("*").alias("n"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"))


@query("st2_stateful_throttle", "obs", """
SELECT tracklet_id, CAST(count(*) AS BIGINT) AS kept, min(frame_index) AS first_frame, max(frame_index) AS last_frame FROM (WITH RECURSIVE keep AS (SELECT tracklet_id, min(frame_index) AS frame_index FROM obs GROUP BY 1 UNION ALL SELECT k.tracklet_id, (SELECT min(o.frame_index) FROM obs o WHERE o.tracklet_id = k.tracklet_id AND o.frame_index >= k.frame_index + 6) FROM keep k WHERE k.frame_index IS NOT NULL)
SELECT tracklet_id, frame_index FROM keep WHERE frame_index IS NOT NULL) GROUP BY 1""")
def st2(v):
    out = collected(v, ST.throttle_stream(as_stream(v, v.obs.select("tracklet_id", "frame_index"), "throttle-in"), 6, "60 seconds"), "throttle-out")
    return out.groupBy("tracklet_id").agg(F.count("*").alias("kept"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"))


@query("st3_incremental_merge", "dets", """
SELECT source_id AS source_hash, CAST(max(frame_index) % 5000 + 1 AS BIGINT) AS frame_count, CAST(count(DISTINCT frame_index) AS BIGINT) AS frames, CAST(count(DISTINCT CASE WHEN class_name = 'ball' THEN frame_index END) AS BIGINT) AS repeats, count(DISTINCT frame_index) = max(frame_index) % 5000 + 1 AND min(frame_index) % 5000 = 0 AS complete FROM dets GROUP BY 1""")
def st3(v):
    dets = v.dets
    local = lambda df: df.select(F.col("source_id").alias("source_hash"), (F.col("frame_index") % 5000).alias("frame_index")).distinct()
    chunks = local(dets).unionByName(local(dets.filter("class_name = 'ball'")))  # frames with a ball arrive twice
    path = scratch(v, "arrivals")
    SW.drain(as_stream(v, chunks, "chunks"), "", scratch(v, "arrivals-state"), for_each=SW.arrival_counter(path))
    targets = dets.groupBy(F.col("source_id").alias("source_hash")).agg((F.max("frame_index") % 5000 + 1).alias("frame_count"))
    return SW.merge_report(v.spark.read.parquet(path).filter(F.col("source_hash") != END), targets)


@query("st3_deduplicated_merge", "dets", """
SELECT source_id AS source_hash, CAST(count(DISTINCT frame_index) AS BIGINT) AS frames, CAST(sum(DISTINCT frame_index) AS BIGINT) AS frame_sum FROM dets GROUP BY 1""")
def st3_merge(v):
    rows = v.dets.select(F.col("source_id").alias("source_hash"), "frame_index")
    out = collected(v, SW.merge_stream(as_stream(v, rows, "merge-in")), "merge-out")
    return out.groupBy("source_hash").agg(F.count("*").alias("frames"), F.sum("frame_index").alias("frame_sum"))


@query("st4_windowed_summary", "obs", """
, t AS (SELECT shot_id, tracklet_id, frame_index, CAST(floor((frame_index*0.04E0 + 1700000000)/30) AS BIGINT)*30 AS w FROM obs), p AS (SELECT w, shot_id, tracklet_id, count(*) AS n, min(frame_index) AS f, max(frame_index) AS l FROM t GROUP BY 1, 2, 3)
SELECT shot_id, w AS window_start, CAST(sum(n) AS BIGINT) AS observation_count, CAST(count(*) AS BIGINT) AS unique_tracklets, CAST(sum(CASE WHEN l > f THEN 1 ELSE 0 END) AS BIGINT) AS multi_frame_tracklets, min(f) AS first_frame, max(l) AS last_frame FROM p GROUP BY 1, 2""")
def st4(v):
    out = collected(v, SW.windowed_summary(as_stream(v, v.obs.select("shot_id", "tracklet_id", "frame_index"), "summary-in"), "30 seconds", delay="30 seconds"), "summary-out")
    return out.select("shot_id", F.unix_timestamp("span.start").alias("window_start"), "observation_count", "unique_tracklets", "multi_frame_tracklets", "first_frame", "last_frame")


@query("st4_session_stretches", "obs", """
, s AS (SELECT tracklet_id, sum(CASE WHEN frame_index - prev > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY tracklet_id ORDER BY frame_index) AS seg FROM (SELECT *, lag(frame_index) OVER (PARTITION BY tracklet_id ORDER BY frame_index) AS prev FROM obs)), c AS (SELECT tracklet_id, seg, count(*) AS n FROM s GROUP BY 1, 2)
SELECT tracklet_id, CAST(count(*) AS BIGINT) AS stretches, CAST(sum(n) AS BIGINT) AS "rows", CAST(max(n) AS BIGINT) AS longest FROM c GROUP BY 1""")
def st4_sessions(v):
    out = collected(v, SW.session_stretches(as_stream(v, v.obs.select("tracklet_id", "frame_index"), "sessions-in"), 2, 40, "30 seconds"), "sessions-out")
    return out.groupBy("tracklet_id").agg(F.count("*").alias("stretches"), F.sum("n").alias("rows"), F.max("n").alias("longest"))


class NearestColumn:
    """A small plug-in: the image column names the track."""

    def reset(self, shot_id):
        self.shot_id = shot_id

    def update(self, frame):
        return frame.assign(tracklet_id=[f"{self.shot_id}:c{int(x // 24)}" for x in frame.x1])[["frame_index", "det_index", "tracklet_id"]]

    update_many = update  # a box is named by itself, so frames may come together


def bright_boxes():
    def predict(frames):
        import pandas as pd

        kept = frames[frames.score > 0.25]
        return pd.DataFrame({
            "source_id": kept.source_id.astype(str), "frame_index": kept.frame_index, "det_index": 0, "x1": 0.0, "y1": 0.0, "x2": kept.score * 64, "y2": 10.0, "score": kept.score.clip(0, 1), "class_name": "player", "class_id": 0,
        })

    return predict


@query("x1_tracker_plugin", "obs", """
SELECT shot_id, concat(shot_id, ':c', CAST(CAST(floor(x1/24) AS INT) AS STRING)) AS tracklet_id, CAST(count(*) AS BIGINT) AS n FROM obs GROUP BY 1, 2""")
def x1(v):
    TK.register_tracker("nearest-column", NearestColumn)
    return TK.run_tracker(shot_detections(v), "nearest-column").groupBy("shot_id", "tracklet_id").agg(F.count("*").alias("n"))


@query("x2_detector_plugin", "scores", """
SELECT CAST(source_no AS STRING) AS source_id, CAST(count(*) AS BIGINT) AS n, round(sum(score*64), 6) AS width_sum FROM scores WHERE score > 0.25 GROUP BY 1""")
def x2(v):
    TK.register_detector("bright-boxes", bright_boxes)
    frames = v.scores.select(F.col("source_no").cast("string").alias("source_id"), "frame_index", "score")
    return TK.run_detector(frames, "bright-boxes").groupBy("source_id").agg(F.count("*").alias("n"), F.round(F.sum("x2"), 6).alias("width_sum"))


@query("x3_assignment_solver")
def x3(v):
    """The assignment solver as a grouped map over contested frames only."""
    from trackspark.operators.evaluation import injective_matches, reference_edges

    edges = reference_edges(v.ref_objects, v.obs, 0.3)
    return injective_matches(edges).groupBy("shot_id").agg(F.count("*").alias("matches"), F.round(F.sum("iou"), 6).alias("total_iou"))


#: One line per order, dealt over the files of 40 runs; every fourth file of a run got another name.
PRESENT = """SELECT o_custkey % 40 AS run_no, CAST(o_orderkey % 15 AS INT) AS i, (o_custkey % 40 + o_orderkey % 15) % 4 = 0 AS renamed, concat(CAST(o_orderkey AS STRING), ' ', o_orderpriority) AS line FROM orders"""


@query("s17_run_artifact_scan", "", f"""
WITH p AS (SELECT DISTINCT run_no, i FROM ({PRESENT}) WHERE NOT renamed) SELECT concat('run-', CAST(run_no AS STRING)) AS run_id, CAST(15 - count(*) AS BIGINT) AS missing FROM p GROUP BY run_no HAVING count(*) < 15""")
def s17(v):
    names = F.array(*[F.lit(n) for n in REQUIRED])
    name = F.when(F.col("renamed"), "notes.txt").otherwise(F.get(names, F.col("i")))
    lines = v.spark.sql(with_views("", f"SELECT * FROM ({PRESENT})", v.sf_dir)).select(F.concat(F.lit("run-"), F.col("run_no").cast("string")).alias("run_id"), name.alias("name"), "line")
    root = scratch(v, "runs")
    lines.repartition("run_id").write.partitionBy("run_id", "name").text(root)
    return missing_artifacts(list_artifacts(v.spark, root)).groupBy("run_id").agg(F.count("*").alias("missing"))


RUNS = """SELECT o_custkey AS run_no, count(*) AS n, min(o_orderkey) % 3 = 0 AS bad_hash, min(o_orderkey) % 5 = 0 AS bad_count, min(o_orderkey) % 7 = 0 AS bad_gate, min(o_orderkey) % 11 = 0 AS no_shots, max(o_orderkey) % 13 = 0 AS no_count, max(o_orderkey) % 17 = 0 AS broken_review FROM orders GROUP BY o_custkey"""


@query("a20_run_consistency", "", f"""
SELECT concat('run-', CAST(run_no AS STRING)) AS run_id, concat_ws('; ', CASE WHEN broken_review THEN 'invalid JSON review.json' END, CASE WHEN no_shots THEN 'missing shots.json' END, CASE WHEN bad_hash THEN 'manifest config_hash does not match analysis-config analysis_hash' END, CASE WHEN no_count THEN 'unable to count observations.csv' WHEN bad_count THEN 'metrics observation_count does not match observations.csv' END,
 CASE WHEN bad_gate OR broken_review THEN 'review and tracking-evaluation promotion gates differ' END) AS errors, CASE WHEN bad_hash OR bad_count OR bad_gate OR no_shots OR no_count OR broken_review THEN 'invalid' ELSE 'valid' END AS status FROM ({RUNS})""")
def a20(v):
    runs = v.spark.sql(with_views("", f"SELECT * FROM ({RUNS})", v.sf_dir)).withColumn("run_id", F.concat(F.lit("run-"), F.col("run_no").cast("string")))
    js = lambda *fields: F.to_json(F.struct(*fields))
    lit = lambda value, name: F.lit(value).alias(name)
    docs = {
        "run-manifest.json": js(F.when(F.col("bad_hash"), "x").otherwise("h").alias("config_hash"), lit("s", "input_sha256")), "analysis-config.json": js(lit("h", "analysis_hash"), lit("s", "source_sha256")),
        "metrics.json": js(F.struct(lit("h", "analysis_hash")).alias("analysis"), F.when(F.col("no_count"), "many").otherwise((F.col("n") + F.when(F.col("bad_count"), 1).otherwise(0)).cast("string")).alias("observation_count")),
        "identity-links.json": js(lit(2, "schema_version"), lit(2, "tracklet_count"), lit(1, "player_id_count")), "identities.json": js(lit("P01", "a"), lit("P01", "b")),
        "tracking-evaluation.json": js(F.struct(lit("failed", "status")).alias("promotion_gate")), "review.json": F.when(F.col("broken_review"), "{").otherwise(js(F.struct(F.when(F.col("bad_gate"), "passed").otherwise("failed").alias("status")).alias("promotion_gate"))),
        "calibration.json": js(lit("s", "source_sha256")), "calibration-quality.json": js(lit(1, "schema_version")), "tracklet-refinement.json": js(lit(1, "schema_version")), "shots.json": js(lit(1, "schema_version")),
    }
    documents = runs.select("run_id", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), d.alias("value")) for k, d in docs.items()])).alias("d"), "no_shots").select("run_id", "d.name", "d.value", "no_shots")
    documents = documents.filter("not (no_shots and name = 'shots.json')").drop("no_shots")
    tables = runs.select("run_id", F.explode(F.array(*[F.lit(n) for n in REQUIRED if not n.endswith(".json")])).alias("name"))
    listing = documents.select("run_id", "name").unionByName(tables)
    counts = v.orders.groupBy(F.concat(F.lit("run-"), F.col("o_custkey").cast("string")).alias("run_id")).agg(F.count("*").alias("rows"))
    out = RN.run_consistency(listing, documents, counts)
    return out.select("run_id", F.concat_ws("; ", "errors").alias("errors"), "status")


PLAYS = """SELECT o_custkey % 100 AS batch_no, o_orderkey AS play_id, CASE WHEN o_orderkey % 211 = 0 THEN 'unavailable' ELSE 'complete' END AS status, CASE WHEN o_custkey % 3 = 0 THEN 'complete' ELSE 'complete_with_unresolved' END AS manifest_status, CASE WHEN o_custkey % 3 = 0 THEN 'passed' ELSE 'failed' END AS gate_status FROM orders"""


@query("a21_batch_status", "", f"""
SELECT batch_no, CAST(count(*) AS BIGINT) AS plays, CASE WHEN bool_and(status = 'complete') AND bool_and(manifest_status = 'complete' AND gate_status = 'passed') THEN 'complete' WHEN bool_and(status = 'complete') THEN 'complete_with_unresolved' ELSE 'incomplete' END AS status FROM ({PLAYS}) GROUP BY 1""")
def a21(v):
    return RN.batch_status(v.spark.sql(with_views("", f"SELECT * FROM ({PLAYS})", v.sf_dir)), ["batch_no"])


INPUTS = """SELECT o_custkey AS source_id, CASE WHEN count(*) % 4 = 0 THEN NULL ELSE count(*) % 2 = 0 END AS review_pack_reviewed, CASE sum(o_orderkey) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'unvalidated' ELSE 'valid' END AS calibration_status, CASE WHEN min(o_orderkey) % 6 = 0 THEN NULL ELSE CAST(count(*) AS BIGINT) END AS plays, CAST(count(*) - (max(o_orderkey) % 4 // 3) AS BIGINT) AS eligible_plays,
 CASE WHEN max(o_orderkey) % 5 = 0 THEN NULL ELSE max(o_orderkey) % 7 <> 0 END AS reference_ok, max(o_orderkey) % 3 <> 0 AS has_global_map, CASE WHEN count(*) = 7 THEN NULL ELSE count(*) % 5 <> 0 END AS annotations_ok, count(*) % 3 = 0 AS annotations_reviewed FROM orders GROUP BY o_custkey"""
INPUTS_SPARK = INPUTS.replace("max(o_orderkey) % 4 // 3", "(max(o_orderkey) % 4) div 3")


@query("a23_readiness_gates", "", f"""
SELECT *, CASE WHEN calibration = 'valid' AND timing = 'valid' AND reference = 'valid' THEN 'ready_for_evaluation' ELSE 'not_ready' END AS status FROM (SELECT source_id, CASE WHEN review_pack_reviewed IS NULL THEN 'missing' WHEN review_pack_reviewed THEN 'reviewed' ELSE 'unreviewed' END AS review_pack,
 CASE WHEN annotations_ok IS NULL THEN 'missing' WHEN NOT annotations_ok THEN 'invalid' WHEN annotations_reviewed THEN 'valid' ELSE 'unreviewed' END AS annotations, coalesce(calibration_status, 'missing') AS calibration, CASE WHEN plays IS NULL THEN 'missing' WHEN eligible_plays = plays THEN 'valid' ELSE 'unvalidated' END AS timing,
 CASE WHEN reference_ok IS NULL THEN 'missing' WHEN NOT reference_ok THEN 'invalid' WHEN has_global_map THEN 'valid' ELSE 'missing_cross_shot_map' END AS reference FROM ({INPUTS}))""")
def a23(v):
    return RN.readiness(v.spark.sql(with_views("", f"SELECT * FROM ({INPUTS_SPARK})", v.sf_dir)))


def smooth(rows):
    """Boxes that sway back and forth with an eighth of the jitter, so tracks last."""
    saw, sway = (F.col("frame_index") % 100) * 0.25, F.abs(F.col("frame_index") % 200 - 100) * 0.25
    base = F.floor((F.col("x1") - saw + 30) / 60) * 60
    x1 = base + sway + (F.col("x1") - saw - base) * 0.125
    return rows.withColumn("_w", F.col("x2") - F.col("x1")).withColumn("x1", x1).withColumn("x2", F.col("x1") + F.col("_w")).drop("_w")


def analytics(v, scored: bool = True):
    """The whole chain on the separated views."""
    v = v.written("obs_sep", "frames")
    rows = smooth(v.obs_sep)
    dets = rows.select(
        F.lit("src").alias("source_id"), "frame_index", "pts", F.substring_index("tracklet_id", ":t", -1).cast("int").alias("det_index"), "x1", "y1", "x2", "y2", F.least("score", F.lit(1.0)).alias("score"), F.lit(0).alias("class_id"), F.lit("player").alias("class_name"),
    )
    ranges = v.frames.groupBy("shot_id").agg(F.min("frame_index").alias("start_frame"), (F.max("frame_index") + 1).alias("end_frame")).withColumn("source_id", F.lit("src"))
    no_splits = v.spark.createDataFrame([], "tracklet_id string, segment_id string, start_frame bigint, end_frame bigint")
    crops = v.crops.select("shot_id", "frame_index", F.substring_index("tracklet_id", ":t", -1).cast("int").alias("det_index"), "r", "g", "b")
    fits = CAL.close_intervals(v.keyframes).withColumn("status", F.lit("valid")).withColumn("inlier_count", F.lit(8)).withColumn("median_error_px", F.lit(1.0)).withColumn("withheld_point_count", F.lit(4)).withColumn(
        "withheld_p95_error_yards", F.lit(0.5)
    ).withColumn("m00", F.lit(0.125)).withColumn("m01", F.lit(0.0)).withColumn("m11", F.lit(0.5)).withColumn("m21", F.lit(0.0))
    line = fits.select("shot_id", "pts_start", F.when(F.col("pts_end") > F.col("pts_start"), F.col("pts_end")).alias("pts_end"), CAL.as_fit(fits, "keyframe_id").alias("fit"))
    frames = v.frames
    points = lambda offset: frames.groupBy("shot_id").agg(F.min("frame_index").alias("a"), F.max("frame_index").alias("b")).select(
        F.concat(F.lit("play-"), F.floor(F.col("a") / 7500).cast("string")).alias("play_id"), "shot_id", F.explode(F.array(
            F.struct((F.col("a") + offset).alias("f"), F.lit(f"s{offset}").alias("event")), F.struct((F.col("b") - offset).alias("f"), F.lit(f"e{offset}").alias("event")))).alias("x")
    ).select("play_id", "shot_id", (F.col("x.f") * 1001).alias("pts"), ((F.col("x.f") % 2500) * 0.125).alias("play_time_s"), "x.event")
    anchors = frames.groupBy("shot_id").agg(F.min("frame_index").alias("source_frame")).select(
        F.concat(F.lit("play-"), F.floor(F.col("source_frame") / 7500).cast("string")).alias("play_id"), "shot_id", (F.col("source_frame") * 1001).alias("source_pts"), "source_frame", F.lit(0.0).alias("anchor_s")
    )
    # a play leaves out the last frame of each of its shots
    play_ranges = frames.groupBy("shot_id").agg(F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame")).select(
        F.concat(F.lit("play-"), F.floor(F.col("start_frame") / 7500).cast("string")).alias("play_id"), "shot_id", "start_frame", "end_frame"
    )
    truth = cut_lineage(smooth(v.ref_sep)) if scored else v.ref_sep
    ids = truth.select("shot_id", "object_id").distinct().withColumn("global_id", F.concat(F.lit("G"), "object_id"))
    extra = {"references": truth, "frames": frames, "global_map": ids} if scored else {}
    extra |= {"reads": v.reads, "read_candidates": candidates(v), "crop_embeddings": v.embeds, "play_ranges": play_ranges}
    extra |= {"withheld": v.withheld, "detectors": v.spark.createDataFrame([("src", False)], "source_id string, proxy boolean")}
    return RUN.run_analytics(dets, ranges, no_splits, crops, PROTOTYPES, line, points(0), points(100), anchors, threshold=0.5, **extra)


@query("e1_run_analytics")
def e1(v):
    out = analytics(v)
    kinds = [
        out["gate"].select(F.lit("gate").alias("kind"), F.col("gate_status").alias("name"), F.concat_ws("; ", "reasons").alias("value")),
        out["plays"].select(F.lit("play").alias("kind"), F.col("play_id").alias("name"), F.col("status").alias("value")),
        out["evidence_counts"].groupBy(F.lit("pairs").alias("kind"), F.coalesce("rejection_reason", F.lit("eligible")).alias("name")).agg(F.concat_ws(" of ", F.sum("formed"), F.sum("pairs")).alias("value")),
        out["calibration_quality"].select(F.lit("calibration").alias("kind"), F.col("status").alias("name"), F.concat_ws(" ", "withheld_point_count", F.round("median_error_yards", 6), F.round("p95_error_yards", 6)).alias("value")),
        out["coverage"].select(F.lit("coverage").alias("kind"), F.lit("player_ids").alias("name"), F.col("player_id_count").cast("string").alias("value")),
        out["standard"].select(F.lit("standard").alias("kind"), F.col("shot_id").alias("name"), F.round("IDF1", 6).cast("string").alias("value")),
        out["observations"].groupBy(F.lit("observations").alias("kind"), F.col("shot_id").alias("name")).agg(F.count("*").cast("string").alias("value")),
    ]
    result = kinds[0]
    for part in kinds[1:]:
        result = result.unionByName(part)
    return result


@query("e2_batch_by_play")
def e2(v):
    out = analytics(v, scored=False)
    plays = v.obs_sep.select(F.lit("src").alias("source_id"), "play_id").distinct()
    gates = plays.select("source_id").distinct().withColumn("gate_status", F.lit("not_evaluated"))
    return RUN.run_batch(plays, out["plays"], gates)


@query("e3_review_staging")
def e3(v):
    from trackspark.plans.catalog.identity import evidence
    from trackspark.plans.catalog.review import simple_links
    from trackspark.plans.catalog.windows import motion

    v = v.written("obs", "frames", "scores")
    ranges = v.frames.groupBy("shot_id").agg(F.min("frame_index").alias("start_frame"), (F.max("frame_index") + 1).alias("end_frame")).select(
        F.lit("src").alias("source_id"), "shot_id", F.regexp_extract("shot_id", r"(\d+)", 1).cast("bigint").alias("shot_no"), "start_frame", "end_frame", (F.col("start_frame") * 1001).alias("start_pts"), (F.col("end_frame") * 1001).alias("end_pts"),
        F.lit(1.0).alias("tb_num"), F.lit(60000).alias("tb_den"), F.lit(60.0).alias("fps"),
    )
    ev = cut_lineage(evidence(v, False))
    obs = v.obs.select(F.lit("src").alias("source_id"), F.lit("run-1").alias("run_id"), "shot_id", "tracklet_id", "frame_index", "pts", "x1", "y1", "x2", "y2", F.col("score").alias("detection_score"), F.lit("A").alias("team"), F.lit(0.5).alias("team_score"), "play_time_s")
    maps = v.frames.select(F.col("shot_id").alias("file_path"), F.col("frame_index").alias("source_frame"), F.col("frame_index").alias("task_frame"), F.col("pts").alias("source_pts"), F.lit(600).alias("task_width"), F.lit(320).alias("task_height"), F.lit(0.0).alias("cx1"), F.lit(0.0).alias("cy1"), F.lit(128.0).alias("cx2"), F.lit(64.0).alias("cy2"))
    inputs = v.spark.sql(with_views("", f"SELECT * FROM ({INPUTS_SPARK})", v.sf_dir))
    out = RUN.stage_review(ranges, obs, motion(v), maps, simple_links(ev), ev, inputs, fps=4.0)
    result = None
    for name, df in out.items():
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        result = part if result is None else result.unionByName(part)
    return result


@query("k8_run_documents", "obs_sep frames", f"""
SELECT 'run-1' AS run_id, 'identities' AS kind, CAST(count(*) AS BIGINT) AS documents, min(tracklet_id) AS first_item FROM (SELECT DISTINCT tracklet_id FROM obs_sep)
UNION ALL SELECT 'run-1', 'identity-links', count(*), min(concat_ws('|', left_key, right_key)) FROM ({RAW_LINKS}) UNION ALL SELECT 'run-1', 'metrics', count(*), min(shot_id) FROM (SELECT DISTINCT shot_id FROM frames)
UNION ALL SELECT 'run-1', 'review', 1, 'gate' UNION ALL SELECT 'run-1', 'run-manifest', 1, 'manifest'""")
def k8(v):
    from trackspark.operators.evaluation import shot_metrics
    from trackspark.plans.catalog.evaluation import identities
    from trackspark.sinks.documents import run_documents, write_run_documents

    run = lambda df: df.withColumn("run_id", F.lit("run-1"))
    links = v.spark.sql(with_views("", f"SELECT * FROM ({RAW_LINKS})", v.sf_dir))
    gates = v.orders.groupBy().agg(F.max("o_orderstatus").alias("gate_status"))
    manifests = v.frames.groupBy().agg(F.count("*").alias("frame_count"), F.lit("complete").alias("status"))
    docs = run_documents(run(identities(v)), run(links), run(shot_metrics(v.ref_sep, v.obs_sep, v.frames)), run(gates), run(manifests))
    path = scratch(v, "documents")
    write_run_documents(docs, path)
    return v.spark.read.schema("run_id string, item string, document string, kind string").json(path).groupBy("run_id", "kind").agg(F.count("*").alias("documents"), F.min("item").alias("first_item"))
