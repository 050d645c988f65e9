"""Row contracts, gates and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.functions import scalars as S
from trackspark.operators import contracts as C
from trackspark.plans.catalog import query

COUNT = "CAST(count(*) AS BIGINT) AS n"


@query("v1_detection_contract", "dets", f"""
SELECT rule, {COUNT} FROM (
 SELECT unnest(list_filter([CASE WHEN NOT (x2 > x1 AND y2 > y1) THEN 'box' END, CASE WHEN NOT (score BETWEEN 0 AND 1) THEN 'score' END,
   CASE WHEN NOT class_id >= 0 THEN 'class_id' END, 'total'], lambda x: x IS NOT NULL)) AS rule FROM dets) GROUP BY rule""")
def v1(v):
    rules = F.concat(S.broken_rules(C.detection_rules()), F.array(F.lit("total")))
    return v.dets.select(F.explode(rules).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query("v2_track_row_contract", "obs", f"""
SELECT shot_id, rule, {COUNT} FROM (SELECT shot_id, unnest(list_filter([CASE WHEN NOT (x2 > x1 AND y2 > y1) THEN 'box' END,
  CASE WHEN NOT frame_index - 40 >= 0 THEN 'frame_index' END, CASE WHEN NOT score*1.5E0 BETWEEN 0 AND 1 THEN 'score' END,
  CASE WHEN tracklet_id LIKE '%t7' THEN 'state' END], lambda x: x IS NOT NULL)) AS rule FROM obs) GROUP BY shot_id, rule""")
def v2(v):
    rows = v.obs.withColumn("frame_index", F.col("frame_index") - 40).withColumn("score", F.col("score") * 1.5)
    rows = rows.withColumn("state", F.when(F.col("tracklet_id").endswith("t7"), "lost").otherwise("observed"))
    _, rejects = S.split_rejects(rows, C.track_rules())
    return rejects.groupBy("shot_id", "rule").agg(F.count("*").alias("n"))


OBS23 = """SELECT 'run-1' AS run_id, shot_id, frame_index, pts, 1 AS tb_num, CASE WHEN frame_index % 400 = 0 THEN 0 ELSE 30000 END AS tb_den, tracklet_id,
 x1, y1, x2, y2, score*1.3E0 AS detection_score, CASE WHEN x1 > 30 THEN 'A' ELSE 'B' END AS team, 0.5E0 AS team_score,
 CAST(frame_index % 103 AS INT) AS jersey_number, x1 AS field_x, CASE WHEN frame_index % 9 = 0 THEN NULL ELSE y1 END AS field_y,
 2 AS identity_version, score - 0.05E0 AS position_uncertainty_yards, play_time_s,
 CASE WHEN frame_index % 50 = 0 THEN 'guess' WHEN frame_index % 3 = 0 THEN NULL ELSE 'valid' END AS calibration_status FROM obs"""


@query("v3_observation_contract", "obs", f"""
SELECT rule, {COUNT} FROM (SELECT unnest(list_filter([
  CASE WHEN NOT (x2 > x1 AND y2 > y1) THEN 'box' END, CASE WHEN tb_den <= 0 THEN 'time_base' END,
  CASE WHEN NOT detection_score BETWEEN 0 AND 1 THEN 'detection_score' END, CASE WHEN NOT jersey_number BETWEEN 0 AND 99 THEN 'jersey_number' END,
  CASE WHEN (field_x IS NULL) <> (field_y IS NULL) THEN 'field_position' END,
  CASE WHEN position_uncertainty_yards < 0 THEN 'position_uncertainty' END,
  CASE WHEN calibration_status = 'guess' THEN 'calibration_status' END], lambda x: x IS NOT NULL)) AS rule FROM ({OBS23})) GROUP BY rule""")
def v3(v):
    from trackspark.plans.views import with_views

    rows = v.spark.sql(with_views("obs", OBS23, v.sf_dir))
    _, rejects = S.split_rejects(rows, C.observation_rules())
    return rejects.groupBy("rule").agg(F.count("*").alias("n"))


@query("v4_run_manifest_contract", "", f"""
SELECT rule, {COUNT} FROM (SELECT unnest(list_filter([CASE WHEN NOT input_duration_s >= 0 THEN 'input_duration_s' END,
  CASE WHEN NOT source_fps > 0 THEN 'source_fps' END, CASE WHEN NOT frame_count >= 0 THEN 'frame_count' END,
  CASE WHEN status NOT IN ('complete','complete_with_unresolved','incomplete','failed') THEN 'status' END], lambda x: x IS NOT NULL)) AS rule
 FROM (SELECT o_custkey, min(o_totalprice) - 5000.0E0 AS input_duration_s, (sum(o_orderkey) % 61)*1.0E0 AS source_fps, count(*) - 4 AS frame_count,
   CASE max(o_orderstatus) WHEN 'P' THEN 'complete' WHEN 'O' THEN 'incomplete' ELSE 'unknown' END AS status FROM orders GROUP BY o_custkey)) GROUP BY rule""")
def v4(v):
    runs = v.orders.groupBy("o_custkey").agg(
        (F.min("o_totalprice") - 5000.0).alias("input_duration_s"),
        ((F.sum("o_orderkey") % 61) * 1.0).alias("source_fps"),
        (F.count("*") - 4).alias("frame_count"),
        F.max("o_orderstatus").alias("_s"),
    ).withColumn("status", F.when(F.col("_s") == "P", "complete").when(F.col("_s") == "O", "incomplete").otherwise("unknown"))
    _, rejects = S.split_rejects(runs, C.manifest_rules())
    return rejects.groupBy("rule").agg(F.count("*").alias("n"))


@query("v9_class_mapping_check", "dets", """
SELECT source_id, class_id, class_name, CAST(count(*) AS BIGINT) AS n FROM dets
WHERE NOT ((class_id = 0 AND class_name = 'Player') OR (class_id = 1 AND class_name = 'referee') OR (class_id = 2 AND class_name = 'ball'))
GROUP BY source_id, class_id, class_name""")
def v9(v):
    mapping = v.spark.createDataFrame([("0", "Player"), ("1", "referee"), ("2", "ball")], "class_id string, class_name string")
    return C.class_mapping_violations(v.dets, mapping)


@query("v10_source_hash_gate", "", """
SELECT i.o_custkey % 40 AS run_no, i.o_orderpriority AS input_kind, CAST(count(*) AS BIGINT) AS inputs,
  CAST(sum(CASE WHEN i.o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS undeclared,
  CAST(sum(CASE WHEN i.o_orderstatus <> 'O' AND i.o_orderstatus <> r.status THEN 1 ELSE 0 END) AS BIGINT) AS mismatched,
  bool_and(i.o_orderstatus = r.status) AS passed
FROM orders i JOIN (SELECT o_custkey % 40 AS run_no, max(o_orderstatus) AS status FROM orders GROUP BY 1) r ON r.run_no = i.o_custkey % 40
GROUP BY 1, 2""")
def v10(v):
    inputs = v.orders.select(
        (F.col("o_custkey") % 40).alias("run_no"), F.col("o_orderpriority").alias("input_kind"),
        F.when(F.col("o_orderstatus") != "O", F.sha2("o_orderstatus", 256)).alias("source_sha256"),
    )
    runs = v.orders.groupBy((F.col("o_custkey") % 40).alias("run_no")).agg(F.sha2(F.max("o_orderstatus"), 256).alias("source_sha256"))
    return C.hash_gates(inputs, runs, "run_no")


@query("v8_source_frame_check", "obs frames", f"""
SELECT rule, {COUNT} FROM (SELECT unnest(list_filter([CASE WHEN f.frame_index IS NULL THEN 'unknown_frame' END,
  CASE WHEN f.pts <> o.pts + (CASE WHEN o.score > 0.7 THEN 1 ELSE 0 END) THEN 'pts_mismatch' END,
  CASE WHEN o.x1 < 0 OR o.x2 > 100 OR o.y1 < 0 OR o.y2 > 60 THEN 'outside_image' END], lambda x: x IS NOT NULL)) AS rule
 FROM obs o LEFT JOIN (SELECT * REPLACE (CASE WHEN labeled THEN frame_index ELSE -1 - frame_index END AS frame_index) FROM frames) f ON f.frame_index = o.frame_index AND f.shot_id = o.shot_id) GROUP BY rule""")
def v8(v):
    # frames without a label carry numbers that no row has
    number = F.when(F.col("labeled"), F.col("frame_index")).otherwise(-1 - F.col("frame_index"))
    index = v.frames.select(F.col("shot_id").alias("source_id"), number.alias("frame_index"), F.col("pts").alias("index_pts"))
    rows = v.obs.select(
        F.col("shot_id").alias("source_id"), "frame_index",
        (F.col("pts") + F.when(F.col("score") > 0.7, 1).otherwise(0)).alias("pts"), "x1", "y1", "x2", "y2",
    )
    return C.frame_violations(rows, index, width=100, height=60).groupBy("rule").agg(F.count("*").alias("n"))


@query("v8_frame_index_order", "", """
SELECT shot_no, CAST(sum(CASE WHEN prev >= pts THEN 1 ELSE 0 END) AS BIGINT) AS not_increasing, CAST(sum(CASE WHEN frame - pf > 1 THEN 1 ELSE 0 END) AS BIGINT) AS gaps
FROM (SELECT *, lag(pts) OVER (PARTITION BY shot_no ORDER BY frame) AS prev, lag(frame) OVER (PARTITION BY shot_no ORDER BY frame) AS pf
  FROM (SELECT floor(event_id/500.0) AS shot_no, event_id + CAST(floor(event_id/7.0) AS BIGINT) AS frame, CAST(floor(value*4) AS BIGINT) AS pts FROM events)) GROUP BY shot_no""")
def v8_order(v):
    # every seventh frame number is skipped
    index = v.events.select(
        F.floor(F.col("event_id") / 500.0).cast("double").alias("shot_no"), (F.col("event_id") + F.floor(F.col("event_id") / 7.0)).alias("frame_index"),
        F.floor(F.col("value") * 4).alias("pts"),
    )
    return C.index_order(index, ["shot_no"])


@query("p1_player_filter", "dets", """
SELECT source_id, class_id, class_name, CAST(count(*) AS BIGINT) AS n FROM dets
WHERE class_id = 0 OR lower(class_name) IN ('player','person','football_player','athlete') GROUP BY 1,2,3""")
def p1(v):
    return v.dets.filter(S.is_player(F.col("class_id"), F.col("class_name"))).groupBy("source_id", "class_id", "class_name").agg(F.count("*").alias("n"))


@query("p2_frame_window", "ref_objects frames", """
SELECT f.shot_id, CAST(count(DISTINCT CASE WHEN f.frame_index >= 1000 AND f.frame_index < 9000 THEN f.frame_index END) AS BIGINT) AS frames_kept
FROM frames f GROUP BY f.shot_id""")
def p2(v):
    from trackspark.operators.evaluation import restrict_to_window

    frames = v.frames
    kept = restrict_to_window(frames, 1000, 9000)
    per_shot = kept.groupBy("shot_id").agg(F.count_distinct("frame_index").alias("n"))
    return frames.select("shot_id").distinct().join(per_shot, "shot_id", "left").select(
        "shot_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("frames_kept")
    )


@query("p3_pts_seconds", "obs", """
SELECT shot_id, tracklet_id, frame_index, round(pts*1.0E0/30000, 6) AS seconds FROM obs""")
def p3(v):
    return v.obs.select(
        "shot_id", "tracklet_id", "frame_index",
        F.round(S.seconds(F.col("pts"), F.lit(1.0), F.lit(30000)), 6).alias("seconds"),
    )


@query("p14_ids", "", """
SELECT concat('play-', CAST(o_orderkey % 50 AS STRING)) AS play_id, substring(sha256(concat_ws(chr(0), concat('play-', CAST(o_orderkey % 50 AS STRING)), concat('shot-0:t', CAST(o_custkey AS STRING)),
   CASE WHEN o_orderstatus = 'F' THEN '' ELSE concat('shot-1:t', CAST(o_orderkey AS STRING)) END, o_orderpriority)),1,16) AS review_item_id,
  substring(sha256(concat('{"customer":', CAST(o_custkey AS STRING), ',"order":', CAST(o_orderkey AS STRING), ',"status":"', o_orderstatus, '"}')),1,16) AS config_id
FROM orders""")
def p14(v):
    play = F.concat(F.lit("play-"), (F.col("o_orderkey") % 50).cast("string"))
    right = F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("shot-1:t"), F.col("o_orderkey").cast("string")))
    return v.orders.select(
        play.alias("play_id"),
        S.review_item_id(play, F.concat(F.lit("shot-0:t"), F.col("o_custkey").cast("string")), right, F.col("o_orderpriority")).alias("review_item_id"),
        S.config_hash(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status")).alias("config_id"),
    )


@query("f1_string_functions", "obs", """
SELECT split_part(tracklet_id, ':', 1) AS shot, upper(split_part(tracklet_id, ':', 2)) AS local_id, regexp_matches(replace(tracklet_id,':','.'), '^[A-Za-z0-9][A-Za-z0-9_.-]*$') AS safe_dotted,
  regexp_matches(tracklet_id, '^[A-Za-z0-9][A-Za-z0-9_.-]*$') AS safe_raw, CAST(count(*) AS BIGINT) AS n FROM obs GROUP BY tracklet_id""")
def f1(v):
    safe = r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"
    return v.obs.groupBy("tracklet_id").agg(F.count("*").alias("n")).select(
        S.shot_of("tracklet_id").alias("shot"), F.upper(F.substring_index("tracklet_id", ":", -1)).alias("local_id"),
        F.replace(F.col("tracklet_id"), F.lit(":"), F.lit(".")).rlike(safe).alias("safe_dotted"), F.col("tracklet_id").rlike(safe).alias("safe_raw"), "n",
    )


@query("f2_zoned_timestamps", "", """
SELECT zone, CAST(count(*) AS BIGINT) AS n, CAST(count(ts) AS BIGINT) AS parsed, CAST(sum(epoch(ts)) AS BIGINT) AS epoch_sum FROM (
 SELECT o_orderpriority AS zone, CASE o_orderpriority WHEN '1-URGENT' THEN o_orderdate WHEN '2-HIGH' THEN o_orderdate - INTERVAL 2 HOUR WHEN '3-MEDIUM' THEN o_orderdate + INTERVAL 330 MINUTE END AS ts FROM orders) GROUP BY zone""")
def f2(v):
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    tail = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Z").when(F.col("o_orderpriority") == "2-HIGH", "+02:00")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "-05:30").otherwise("")
    )
    ts = S.zoned_timestamp(F.concat(day, tail))
    return v.orders.select(F.col("o_orderpriority").alias("zone"), ts.alias("ts")).groupBy("zone").agg(
        F.count("*").alias("n"), F.count("ts").alias("parsed"), F.sum(F.unix_timestamp("ts")).alias("epoch_sum")
    )


@query("f3_math_functions", "obs", """
SELECT tracklet_id, round(median(x1),6) AS med, round(quantile_cont(x1, 0.9),6) AS p90, round(avg(exp(-score)),6) AS mean_exp, round(max(sqrt(x1*x1+y1*y1)),6) AS max_norm,
  CAST(sum(round_even(play_time_s*10.0E0,0)) AS BIGINT) AS half_even_sum, round(avg(greatest(0.0E0, least(1.0E0, score*2 - 0.25E0))),6) AS clipped FROM obs GROUP BY tracklet_id""")
def f3(v):
    from trackspark.scale import exact_quantiles

    obs = v.obs
    quantiles = exact_quantiles(obs, ["tracklet_id"], "x1", {"med": 0.5, "p90": 0.9})
    rest = obs.groupBy("tracklet_id").agg(
        F.round(F.avg(F.exp(-F.col("score"))), 6).alias("mean_exp"),
        F.round(F.max(F.sqrt(F.col("x1") * F.col("x1") + F.col("y1") * F.col("y1"))), 6).alias("max_norm"),
        F.sum(F.rint(F.col("play_time_s") * 10.0).cast("bigint")).alias("half_even_sum"),
        F.round(F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") * 2 - 0.25))), 6).alias("clipped"),
    )
    return rest.join(quantiles.select("tracklet_id", F.round("med", 6).alias("med"), F.round("p90", 6).alias("p90")), "tracklet_id")


@query("f4_json_arrays", "", """
SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(json_extract(props,'$.k') AS BIGINT)) AS BIGINT) AS key_sum, CAST(max(json_extract_string(concat('[',CAST(user_id AS STRING),',',CAST(event_id AS STRING),']'),'$[1]')) AS STRING) AS last_item FROM events GROUP BY event_type""")
def f4(v):
    boxed = F.to_json(F.array("user_id", "event_id"))
    return v.events.select(
        "event_type", F.from_json("props", "map<string,bigint>")["k"].alias("k"), F.get(F.from_json(boxed, "array<bigint>"), F.lit(1)).cast("string").alias("item")
    ).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("key_sum"), F.max("item").alias("last_item"))


@query("f5_sha256", "", """
SELECT lang, CAST(count(DISTINCT sha256(text)) AS BIGINT) AS distinct_hashes, min(sha256(text)) AS low, max(substring(sha256(text),1,16)) AS high FROM documents GROUP BY lang""")
def f5(v):
    return v.documents.select("lang", F.sha2("text", 256).alias("h")).groupBy("lang").agg(
        F.count_distinct("h").alias("distinct_hashes"), F.min("h").alias("low"), F.max(F.substring("h", 1, 16)).alias("high")
    )
