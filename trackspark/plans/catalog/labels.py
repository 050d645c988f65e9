"""Manifests, labels, imports, references from annotations and fits from landmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.functions import geometry as G
from trackspark.operators import calibrate as CAL
from trackspark.operators import labels as LB
from trackspark.operators import manifest as MF
from trackspark.plans.catalog import query
from trackspark.plans.catalog.geometry import CLOSED, ELIGIBLE, FX, OK, _inside_sql, quad
from trackspark.plans.catalog.scans import DOC_FRAMES, scratch
from trackspark.plans.views import with_views
from trackspark.sources import label_xml as LX
from trackspark.sources import manifest as SM

# annotations with one kind of defect per divisor of the frame number
ANN = """SELECT shot_id AS file_path, shot_id, CASE WHEN frame_index % 97 = 0 THEN concat(shot_id, ':twice') ELSE concat(tracklet_id, '@', CAST(frame_index AS STRING)) END AS id, frame_index AS source_frame, CASE WHEN frame_index % 101 = 0 THEN -1 ELSE pts END AS pts, tracklet_id AS track_id,
 x1, y1, CASE WHEN frame_index % 61 = 0 THEN x1 - 1 ELSE x2 END AS x2, y2, CASE WHEN frame_index % 71 = 0 THEN 'coach' ELSE 'player' END AS label, CASE WHEN frame_index % 73 = 0 THEN 'hidden' ELSE 'visible' END AS visibility, CASE WHEN frame_index % 79 = 0 THEN ' ' ELSE 'A' END AS team,
 CASE WHEN frame_index % 103 = 0 THEN 'unreviewed' ELSE 'reviewed' END AS review_status, CASE WHEN frame_index % 83 = 0 THEN '' ELSE 'ann' END AS reviewer, CASE WHEN frame_index % 89 = 0 THEN '2026-01-02T03:04:05' ELSE '2026-01-02T03:04:05Z' END AS reviewed_at, CAST(CASE WHEN frame_index % 107 = 0 THEN 0 ELSE 1 END AS INT) AS revision,
 score*1.35E0 AS annotation_confidence, CASE WHEN tracklet_id LIKE '%t1' THEN 'G1' WHEN tracklet_id LIKE '%t2' THEN 'unknown' END AS global_id, CASE WHEN tracklet_id LIKE '%t1' AND frame_index % 109 <> 0 THEN 'approved' WHEN tracklet_id LIKE '%t3' THEN 'maybe' END AS cross_shot_review_status,
 CASE WHEN frame_index % 113 = 0 THEN 'ANN' ELSE 'second' END AS identity_second_reviewer, '2026-01-02T03:04:05+02:00' AS identity_second_reviewed_at, CAST(1 AS INT) AS identity_second_revision, 0.5E0 AS identity_second_confidence FROM obs"""


def annotation_rows(v):
    base = v.spark.sql(with_views("obs", ANN, v.sf_dir))
    extra = {"ground_contact_xy_px": "array<double>", "ground_contact_xy_yards": "array<double>", "ground_contact_confidence": "double", "coordinate_space": "string", "cross_shot_id": "string", "occluded": "boolean"}
    rows = base.withColumn("bbox_xyxy_px", F.array("x1", "y1", "x2", "y2")).drop("x1", "y1", "x2", "y2").withColumn("width", F.lit(110)).withColumn("height", F.lit(60)).withColumn("source_sha256", F.col("file_path"))
    for name, kind in extra.items():
        rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows


def shot_rows(v):
    return v.obs.groupBy(F.col("shot_id").alias("file_path"), "shot_id").agg(F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame")).select(
        "*", (F.col("end_frame") + 10).alias("frame_count"), F.lit("p").alias("play_id"), F.lit("train").alias("split"), F.lit("side").alias("camera_label")
    )


@query("v6_annotation_rules", "obs", f""", a AS ({ANN}), sh AS (SELECT shot_id, max(frame_index) AS e FROM obs GROUP BY 1),
 marked AS (SELECT a.shot_id, unnest(list_filter([CASE WHEN source_frame >= e THEN 'outside_shot' END, CASE WHEN pts < 0 THEN 'pts' END, CASE WHEN x2 <= x1 THEN 'box' END, CASE WHEN x2 > x1 AND (x2 > 110 OR x1 < 0) THEN 'box_outside_image' END, CASE WHEN label = 'coach' THEN 'label' END,
  CASE WHEN visibility = 'hidden' THEN 'visibility' END, CASE WHEN team = ' ' THEN 'team' END, CASE WHEN review_status = 'unreviewed' THEN 'not_reviewed' END, CASE WHEN reviewer = '' THEN 'reviewer' END, CASE WHEN reviewed_at NOT LIKE '%Z' THEN 'reviewed_at' END, CASE WHEN revision = 0 THEN 'revision' END,
  CASE WHEN annotation_confidence > 1 THEN 'annotation_confidence' END, CASE WHEN global_id = 'G1' AND cross_shot_review_status IS NULL THEN 'global_id_needs_approval' END, CASE WHEN cross_shot_review_status = 'maybe' THEN 'cross_shot_review_status' END,
  CASE WHEN cross_shot_review_status IS NOT NULL AND lower(identity_second_reviewer) = lower(reviewer) THEN 'second_reviewer' END], lambda x: x IS NOT NULL)) AS rule FROM a JOIN sh ON sh.shot_id = a.shot_id)
SELECT shot_id, rule, CAST(count(*) AS BIGINT) AS n FROM marked GROUP BY 1, 2 UNION ALL SELECT shot_id, 'duplicate_id', 1 FROM a WHERE id LIKE '%:twice' GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT shot_id, 'conflicting_identity_decisions', count(*) FROM (SELECT shot_id, track_id FROM a WHERE cross_shot_review_status IS NOT NULL OR global_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT concat(coalesce(cross_shot_review_status,''), '/', coalesce(global_id,''))) > 1) GROUP BY 1""")
def v6(v):
    found = MF.annotation_violations(annotation_rows(v), shot_rows(v)).unionByName(MF.shot_violations(shot_rows(v)))
    return found.select(F.col("file_path").alias("shot_id"), "rule").groupBy("shot_id", "rule").agg(F.count("*").alias("n"))


def manifest_docs(v):
    """One manifest per 500 frames of a shot."""
    rows = annotation_rows(v).withColumn("chunk", F.floor(F.col("source_frame") / DOC_FRAMES))
    fields = [c for c in rows.columns if c not in ("file_path", "width", "height", "source_sha256", "chunk")]
    per = rows.groupBy("shot_id", "chunk").agg(F.collect_list(F.struct(*fields)).alias("annotations"))
    landmark = F.struct(
        F.concat_ws(":", "shot_id", "keyframe_id").alias("id"), "shot_id", F.floor(F.col("pts_start") / 1001).alias("source_frame"), F.col("pts_start").alias("pts"), F.array(F.col("median_error_px"), F.lit(5.0)).alias("image_xy_px"), F.array(F.lit(20.0), F.lit(0.0)).alias("field_xy_yards"),
        F.lit("yardline:20:sideline:near").alias("landmark_id"), F.when(F.col("inlier_count") > 5, "withheld").otherwise("fit").alias("role"), F.lit("reviewed").alias("review_status"),
    )
    marks = v.keyframes.groupBy("shot_id", F.floor(F.col("pts_start") / 1001 / DOC_FRAMES).alias("chunk")).agg(F.collect_list(landmark).alias("landmarks"))
    labels = v.frames.filter("labeled").groupBy("shot_id", F.floor(F.col("frame_index") / DOC_FRAMES).alias("chunk")).agg(
        F.collect_list(F.struct("shot_id", F.col("frame_index").alias("source_frame"), "pts", "labeled", F.col("ignore_frame").alias("ignore"), F.lit("reviewed").alias("review_status"))).alias("frame_labels")
    )
    events = v.events_map.groupBy("shot_id", F.floor(F.col("frame_index") / DOC_FRAMES).alias("chunk")).agg(
        F.collect_list(F.struct(F.concat_ws(":", "shot_id", "event").alias("id"), "shot_id", F.col("frame_index").alias("source_frame"), "pts", "event", "play_time_s")).alias("timing_events")
    )
    joined = per.join(marks, ["shot_id", "chunk"], "left").join(labels, ["shot_id", "chunk"], "left").join(events, ["shot_id", "chunk"], "left")
    doc = F.struct(
        F.lit(1).alias("schema_version"), F.lit(True).alias("reviewed"),
        F.struct(F.lit("hash-1").alias("sha256"), F.lit(110).alias("width"), F.lit(60).alias("height"), F.lit(10_000_000).cast("bigint").alias("frame_count"), F.array(F.lit(1), F.lit(30000)).alias("time_base")).alias("source"),
        F.create_map("shot_id", F.struct((F.col("chunk") * DOC_FRAMES).alias("start_frame"), ((F.col("chunk") + 1) * DOC_FRAMES).alias("end_frame"), F.lit("train").alias("split"), F.lit("side").alias("camera_label"))).alias("shots"),
        "annotations", "landmarks", "frame_labels", "timing_events",
    )
    return joined.select(F.concat_ws("/", F.lit("mem:"), "shot_id", F.col("chunk").cast("string")).alias("file_path"), F.to_json(doc).alias("value"))


@query("s12_annotation_manifest_scan", "obs keyframes frames events_map", f""", a AS ({ANN})
SELECT 'annotation' AS kind, label AS name, CAST(count(*) AS BIGINT) AS n, round(sum(x1), 6) AS total FROM a GROUP BY 2 UNION ALL SELECT 'landmark', CASE WHEN inlier_count > 5 THEN 'withheld' ELSE 'fit' END, count(*), sum(median_error_px) FROM keyframes GROUP BY 2
UNION ALL SELECT 'frame_label', CAST(ignore_frame AS STRING), count(*), sum(frame_index)*1.0E0 FROM frames WHERE labeled GROUP BY 2 UNION ALL SELECT 'timing_event', event, count(*), round(sum(play_time_s), 6) FROM events_map GROUP BY 2
UNION ALL SELECT 'shot', 'side', count(*), sum(c*500)*1.0E0 FROM (SELECT DISTINCT shot_id, floor(frame_index/500.0) AS c FROM obs)""")
def s12(v):
    t = SM.parse_manifests(manifest_docs(v))
    g = lambda df, kind, name, total: df.groupBy(F.lit(kind).alias("kind"), name.cast("string").alias("name")).agg(F.count("*").alias("n"), F.round(F.sum(total), 6).cast("double").alias("total"))
    return (
        g(t["annotations"], "annotation", F.col("label"), F.get("bbox_xyxy_px", F.lit(0))).unionByName(g(t["landmarks"], "landmark", F.col("role"), F.get("image_xy_px", F.lit(0))))
        .unionByName(g(t["frame_labels"], "frame_label", F.col("ignore"), F.col("source_frame").cast("double"))).unionByName(g(t["timing_events"], "timing_event", F.col("event"), F.col("play_time_s")))
        .unionByName(g(t["shots"], "shot", F.col("camera_label"), F.col("start_frame").cast("double")))
    )


@query("a24_reference_from_annotations", "obs keyframes frames", f""", {CLOSED}, p AS (SELECT o.*, CASE WHEN k.keyframe_id IS NULL THEN 'calibration_unavailable' WHEN NOT {ELIGIBLE} THEN k.status WHEN NOT {_inside_sql('((x1+x2)/2.0E0)', 'y2')} THEN 'outside_calibration_support' WHEN NOT {OK} THEN 'projection_invalid' ELSE 'projected' END AS st, {FX} AS fx
  FROM obs o LEFT JOIN closed k ON k.shot_id = o.shot_id AND o.pts >= k.pts_start AND (k.pts_end IS NULL OR o.pts < k.pts_end))
SELECT shot_id, 'object' AS kind, st AS name, CAST(count(*) AS BIGINT) AS n, round(sum(CASE WHEN st = 'projected' THEN fx END), 4) AS total FROM p GROUP BY 1, 3
UNION ALL SELECT coalesce(o.shot_id, f.shot_id), 'frame', concat(coalesce(f.labeled, true), '/', coalesce(f.ignore_frame, false)), count(*), NULL FROM (SELECT DISTINCT shot_id, frame_index FROM obs) o FULL JOIN (SELECT * FROM frames WHERE ignore_frame) f ON f.shot_id = o.shot_id AND f.frame_index = o.frame_index GROUP BY 1, 3
UNION ALL SELECT DISTINCT shot_id, 'identity', CASE WHEN tracklet_id LIKE '%t1' THEN 'G1' END, CAST(1 AS BIGINT), NULL FROM obs WHERE tracklet_id LIKE '%t1'""")
def a24(v):
    none = lambda kind: F.lit(None).cast(kind)
    rows = v.obs.select(
        F.col("shot_id").alias("source_sha256"), "shot_id", F.concat_ws("@", "tracklet_id", F.col("frame_index").cast("string")).alias("id"), F.col("tracklet_id").alias("track_id"), F.col("frame_index").alias("source_frame"), "pts",
        F.array("x1", "y1", "x2", "y2").alias("bbox_xyxy_px"), F.array(G.contact_x(), G.contact_y()).alias("ground_contact_xy_px"), none("array<double>").alias("ground_contact_xy_yards"), F.col("score").alias("ground_contact_confidence"),
        F.lit("player").alias("label"), F.lit("A").alias("team"), F.lit("visible").alias("visibility"), F.lit(False).alias("occluded"), F.when(F.col("tracklet_id").endswith("t1"), "G1").when(F.col("tracklet_id").endswith("t2"), "Unknown").alias("global_id"), none("string").alias("cross_shot_id"),
    )
    labels = v.frames.filter("ignore_frame").select(F.col("shot_id").alias("source_sha256"), "shot_id", F.col("frame_index").alias("source_frame"), "pts", "labeled", F.col("ignore_frame").alias("ignore"))
    closed = CAL.close_intervals(v.keyframes).withColumn("support_polygon", quad())
    out = MF.reference_from_annotations(rows, labels, closed.select("shot_id", "pts_start", "pts_end", CAL.as_fit(closed, "keyframe_id", ["support_polygon"]).alias("fit")))
    objects = out["objects"].groupBy("shot_id", F.lit("object").alias("kind"), F.col("projection_status").alias("name")).agg(F.count("*").alias("n"), F.round(F.sum("contact_x"), 4).alias("total"))
    frames = out["frames"].groupBy("shot_id", F.lit("frame").alias("kind"), F.concat(F.col("labeled").cast("string"), F.lit("/"), F.col("ignore_frame").cast("string")).alias("name")).agg(F.count("*").alias("n"), none("double").alias("total"))
    ids = out["identities"].groupBy("shot_id", F.lit("identity").alias("kind"), F.col("global_id").alias("name")).agg(F.count("*").alias("n"), none("double").alias("total"))
    return objects.unionByName(frames).unionByName(ids)


@query("p15_import_status", "", """
SELECT s AS given, CASE WHEN s = 'rejected' THEN NULL ELSE 'unreviewed' END AS draft_status, CASE WHEN s IN ('reviewed','accepted') THEN s END AS final_status, s NOT IN ('rejected','reviewed','accepted') AS final_broken, CAST(count(*) AS BIGINT) AS n
FROM (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'reviewed' WHEN '2-HIGH' THEN 'accepted' WHEN '3-MEDIUM' THEN 'rejected' WHEN '5-LOW' THEN '' ELSE 'draft' END AS s FROM orders) GROUP BY 1""")
def p15(v):
    p = F.col("o_orderpriority")
    given = F.when(p == "1-URGENT", "reviewed").when(p == "2-HIGH", "accepted").when(p == "3-MEDIUM", "rejected").when(p == "5-LOW", "").otherwise("draft")
    draft, _ = LB.import_status(F.col("given"), False)
    final, broken = LB.import_status(F.col("given"), True)
    return v.orders.select(given.alias("given")).select("given", draft.alias("draft_status"), final.alias("final_status"), broken.alias("final_broken")).groupBy(
        "given", "draft_status", "final_status", "final_broken"
    ).agg(F.count("*").alias("n"))


def label_files(v) -> str:
    """Label XML per 500 frames of a shot, written by Spark, compressed; task frames count from the block's first frame.

    The numbers of a block are dealt once and become text where they meet, so no text is shuffled.
    """
    rows = v.obs.withColumn("chunk", F.floor(F.col("frame_index") / DOC_FRAMES)).select("shot_id", "chunk", "tracklet_id", "frame_index", "x1", "y1", "x2", "y2")
    rows = rows.repartition("shot_id", "chunk").withColumn("task", F.col("frame_index") - F.col("chunk") * DOC_FRAMES)
    number = F.substring_index("tracklet_id", ":t", -1)
    text = lambda c: c.cast("string")
    box = lambda e: F.concat(
        F.lit('<box frame="'), text(e["task"]), F.lit('" outside="'), F.when(e["frame_index"] % 31 == 0, "1").otherwise("0"), F.lit('" occluded="'), F.when(e["frame_index"] % 7 == 0, "1").otherwise("0"), F.lit('" keyframe="1" xtl="'), text(e["x1"]),
        F.lit('" ytl="'), text(e["y1"]), F.lit('" xbr="'), text(e["x2"]), F.lit('" ybr="'), text(e["y2"]), F.lit('"><attribute name="review_status">'), F.when(e["frame_index"] % 13 == 0, "rejected").otherwise("accepted"), F.lit("</attribute></box>"),
    )
    points = lambda e: F.concat(
        F.lit('<points frame="'), text(e["task"]), F.lit('" outside="0" occluded="0" keyframe="1" points="'), text(e["cx"]), F.lit(","), text(e["cy"]),
        F.lit('"><attribute name="review_status">accepted</attribute></points>'),
    )
    shape = F.struct("task", "frame_index", "x1", "y1", "x2", "y2", G.contact_x().alias("cx"), G.contact_y().alias("cy"))
    tracks = rows.groupBy("shot_id", "chunk", "tracklet_id").agg(F.sort_array(F.collect_list(shape)).alias("_s")).select(
        "shot_id", "chunk", "tracklet_id", F.concat_ws("", F.transform("_s", box)).alias("boxes"), F.concat_ws("", F.transform("_s", points)).alias("pts")
    )
    track = lambda label, offset, body: F.concat(
        F.lit('<track id="'), (number.cast("int") + offset).cast("string"), F.lit(f'" label="{label}" source="auto"><attribute name="tracklet_id">'), F.col("tracklet_id"), F.lit("</attribute>"), F.col(body), F.lit("</track>")
    )
    body = tracks.groupBy("shot_id", "chunk").agg(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat(track("player", 0, "boxes"), track("ground_contact", 100, "pts"))))).alias("tracks"))
    tags = v.frames.filter("labeled").withColumn("chunk", F.floor(F.col("frame_index") / DOC_FRAMES)).groupBy("shot_id", "chunk").agg(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat(
        F.lit('<tag frame="'), (F.col("frame_index") - F.col("chunk") * DOC_FRAMES).cast("string"), F.lit('" label="'), F.when(F.col("ignore_frame"), "ignored_frame").otherwise("reviewed_frame"), F.lit('"><attribute name="review_status">reviewed</attribute></tag>'))))).alias("tags"))
    doc = body.join(tags, ["shot_id", "chunk"], "left").select(
        F.concat_ws("_", "shot_id", F.col("chunk").cast("string")).alias("doc"),
        F.concat(F.lit("<annotations><version>1.1</version>\n"), "tracks", F.lit("\n"), F.coalesce("tags", F.lit("")), F.lit("\n</annotations>")).alias("value"),
    )
    path = scratch(v, "labels")
    doc.write.option("compression", "gzip").partitionBy("doc").text(path)
    return path


def read_labels(v):
    named = lambda df: df.withColumn("file_path", F.regexp_extract("file_path", r"doc=([^/]+)", 1))
    return {k: named(df) for k, df in LX.read_tracks(v.spark, label_files(v)).items()}


def label_map(v):
    """Task frames of every label file, dense from its first frame."""
    chunk = F.floor(F.col("frame_index") / DOC_FRAMES)
    return v.frames.select(
        F.concat_ws("_", "shot_id", chunk.cast("string")).alias("file_path"), (F.col("frame_index") - chunk * DOC_FRAMES).alias("task_frame"), F.col("frame_index").alias("source_frame"), F.col("pts").alias("source_pts"),
        F.lit(160).alias("task_width"), F.lit(80).alias("task_height"), F.lit(0.0).alias("cx1"), F.lit(0.0).alias("cy1"), F.lit(160.0).alias("cx2"), F.lit(80.0).alias("cy2"), F.lit(160).alias("source_width"), F.lit(80).alias("source_height"), F.lit("hash-1").alias("source_sha256"), "shot_id",
    )


@query("s14_label_xml_scan", "obs frames", """
SELECT 'box' AS kind, tracklet_id AS name, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN frame_index % 31 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS outside, CAST(sum(CASE WHEN frame_index % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS occluded, round(sum(x2), 6) AS total FROM obs GROUP BY 2
UNION ALL SELECT 'points', tracklet_id, count(*), 0, 0, round(sum((x1+x2)/2), 6) FROM obs GROUP BY 2 UNION ALL SELECT 'tag', CASE WHEN ignore_frame THEN 'ignored_frame' ELSE 'reviewed_frame' END, count(*), 0, 0, sum(frame_index % 500)*1.0E0 FROM frames WHERE labeled AND EXISTS (SELECT 1 FROM obs o WHERE o.shot_id = frames.shot_id AND floor(o.frame_index/500.0) = floor(frames.frame_index/500.0)) GROUP BY 2""")
def s14(v):
    t = read_labels(v)
    name = F.try_element_at("attributes", F.lit("tracklet_id"))
    zero = F.lit(0).cast("bigint")
    boxes = t["boxes"].groupBy(F.lit("box").alias("kind"), name.alias("name")).agg(F.count("*").alias("n"), F.count_if("outside").alias("outside"), F.count_if("occluded").alias("occluded"), F.round(F.sum("x2"), 6).alias("total"))
    points = t["points"].groupBy(F.lit("points").alias("kind"), name.alias("name")).agg(F.count("*").alias("n"), zero.alias("outside"), zero.alias("occluded"), F.round(F.sum(F.get("coordinates", F.lit(0))["x"]), 6).alias("total"))
    tags = t["tags"].groupBy(F.lit("tag").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n"), zero.alias("outside"), zero.alias("occluded"), F.sum("task_frame").cast("double").alias("total"))
    return boxes.unionByName(points).unionByName(tags)


@query("p16_labels_to_records", "obs frames", """
, kept AS (SELECT *, frame_index % 31 <> 0 AND frame_index % 13 <> 0 AS boxed FROM obs)
SELECT 'record' AS kind, tracklet_id AS name, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN boxed THEN 1 END) AS BIGINT) AS boxed FROM kept GROUP BY 2
UNION ALL SELECT 'frame_label', CAST(ignore_frame AS STRING), count(*), 0 FROM frames WHERE labeled AND EXISTS (SELECT 1 FROM obs o WHERE o.shot_id = frames.shot_id AND floor(o.frame_index/500.0) = floor(frames.frame_index/500.0)) GROUP BY 2""")
def p16(v):
    t = read_labels(v)
    shots = label_map(v).groupBy("file_path", "shot_id").agg(F.min("source_frame").alias("start_frame"), (F.max("source_frame") + 1).alias("end_frame"))
    out = LB.import_labels(t["boxes"], t["points"], t["tags"], label_map(v), shots, True, "ann", 1, "2026-01-01T00:00:00Z", 0.9)
    records = out["records"].groupBy(F.lit("record").alias("kind"), F.col("track_id").alias("name")).agg(F.count("*").alias("n"), F.count("bbox_xyxy_px").alias("boxed"))
    labels = out["frame_labels"].groupBy(F.lit("frame_label").alias("kind"), F.col("ignore").cast("string").alias("name")).agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("boxed"))
    return records.unionByName(labels)


@query("p17_manifest_merge", "obs frames", """
, recs AS (SELECT shot_id, tracklet_id, CASE WHEN score > 0.77 THEN '' ELSE 'ann' END AS reviewer, floor(frame_index/50.0) AS part FROM obs)
SELECT r.shot_id, r.part, r.n AS records, coalesce(o.n, 0) AS open_proposals, r.ok AND o.n IS NULL AS reviewed FROM (SELECT shot_id, part, count(*) AS n, bool_and(reviewer <> '') AS ok FROM recs GROUP BY 1, 2) r
LEFT JOIN (SELECT shot_id, floor(frame_index/50.0) AS part, count(*) AS n FROM frames WHERE ignore_frame GROUP BY 1, 2) o ON o.shot_id = r.shot_id AND o.part = r.part""")
def p17(v):
    part = F.floor(F.col("frame_index") / 50.0).cast("double").alias("part")
    recs = v.obs.select("shot_id", part, F.lit("annotation").alias("kind"), "tracklet_id", F.lit("reviewed").alias("review_status"), F.when(F.col("score") > 0.77, "").otherwise("ann").alias("reviewer"), F.lit("2026-01-01T00:00:00Z").alias("reviewed_at"), F.lit(1).alias("revision"), F.lit(0.9).alias("annotation_confidence"))
    early, late = recs.filter(F.col("tracklet_id").endswith("1")), recs.filter(~F.col("tracklet_id").endswith("1"))
    return MF.merge_manifest(early, late, v.frames.filter("ignore_frame").select("shot_id", part), ["shot_id", "part"])["status"]


@query("p18_manifest_template", "boundaries dets", """
, sh AS (SELECT source_id, concat('s', CAST(frame_index AS STRING)) AS shot_id, frame_index AS s, frame_index + 1248 + frame_index % 4 AS e, 9000 AS n FROM boundaries), o AS (SELECT *, lag(e) OVER (PARTITION BY source_id ORDER BY s, e, shot_id) AS pe FROM sh)
SELECT source_id, shot_id, s AS start_frame, e AS end_frame, 'unassigned' AS split, concat_ws(',', CASE WHEN e > n THEN 'interval' END, CASE WHEN s < pe THEN 'overlapping_shots' END) AS rules FROM o""")
def p18(v):
    f = F.col("frame_index")
    shots = v.boundaries.select(F.col("source_id").alias("file_path"), F.concat(F.lit("s"), f.cast("string")).alias("shot_id"), f.alias("start_frame"), (f + 1248 + f % 4).alias("end_frame"), F.lit(None).cast("string").alias("play_id"), F.lit(None).cast("string").alias("split"), F.lit("side").alias("camera_label"))
    packs = v.boundaries.select(F.col("source_id").alias("file_path"), F.col("source_id").alias("source_sha256"), F.lit(9000).cast("bigint").alias("frame_count")).distinct()
    out = MF.manifest_template(packs, shots)
    rules = out["violations"].groupBy("file_path", F.col("item").alias("shot_id")).agg(F.concat_ws(",", F.sort_array(F.collect_list("rule"))).alias("rules"))
    return out["shots"].join(rules, ["file_path", "shot_id"], "left").select(F.col("file_path").alias("source_id"), "shot_id", "start_frame", "end_frame", "split", F.coalesce("rules", F.lit("")).alias("rules"))


@query("j15_label_frame_map", "obs frames", """
SELECT shot_id, mapped, CAST(count(*) AS BIGINT) AS n, CAST(sum(pts) AS BIGINT) AS pts_sum FROM (SELECT o.shot_id, f.frame_index IS NOT NULL AS mapped, f.pts FROM obs o LEFT JOIN (SELECT * FROM frames WHERE labeled) f ON f.shot_id = o.shot_id AND f.frame_index = o.frame_index) GROUP BY 1, 2""")
def j15(v):
    chunk = F.floor(F.col("frame_index") / DOC_FRAMES)
    shapes = v.obs.select(F.concat_ws("_", "shot_id", chunk.cast("string")).alias("file_path"), (F.col("frame_index") - chunk * DOC_FRAMES).alias("task_frame"), "tracklet_id")
    labeled = label_map(v).join(v.frames.filter("labeled").select("shot_id", F.col("frame_index").alias("source_frame")), ["shot_id", "source_frame"], "left_semi")
    out = LB.on_source(shapes, labeled)
    side = lambda df, mapped, pts: df.select(F.substring_index("file_path", "_", 1).alias("shot_id"), F.lit(mapped).alias("mapped"), pts.alias("p"))
    both = side(out["mapped"], True, F.col("source_pts")).unionByName(side(out["unmapped"], False, F.lit(None).cast("bigint")))
    return both.groupBy("shot_id", "mapped").agg(F.count("*").alias("n"), F.sum("p").alias("pts_sum"))


@query("k10_label_proposals", "obs frames", """
, m AS (SELECT o.*, 8.0E0 AS cx1, 12.0E0 AS cy1, 68.0E0 AS cx2, 44.0E0 AS cy2 FROM obs o JOIN frames f ON f.shot_id = o.shot_id AND f.frame_index = o.frame_index WHERE f.labeled),
 seg AS (SELECT *, sum(CASE WHEN frame_index - p > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY tracklet_id ORDER BY frame_index) AS segment_no FROM (SELECT *, lag(frame_index) OVER (PARTITION BY tracklet_id ORDER BY frame_index) AS p FROM m))
SELECT tracklet_id, CAST(segment_no AS BIGINT) AS segment_no, frame_index, (greatest(x1,cx1)-cx1)*10 AS task_x1, (least(y2,cy2)-cy1)*10 AS task_y2, round_even((greatest(x1,cx1)+least(x2,cx2))/2, 3) AS contact_proposal_x FROM seg WHERE least(x2,cx2) > greatest(x1,cx1) AND least(y2,cy2) > greatest(y1,cy1)""")
def k10(v):
    maps = v.frames.filter("labeled").select(
        F.col("shot_id").alias("file_path"), F.col("frame_index").alias("source_frame"), F.col("frame_index").alias("task_frame"), F.col("pts").alias("source_pts"), F.lit(600).alias("task_width"), F.lit(320).alias("task_height"),
        F.lit(8.0).alias("cx1"), F.lit(12.0).alias("cy1"), F.lit(68.0).alias("cx2"), F.lit(44.0).alias("cy2"),
    )
    rows = v.obs.select(F.col("shot_id").alias("file_path"), F.lit("run-1").alias("run_id"), "shot_id", "tracklet_id", "frame_index", "pts", "x1", "y1", "x2", "y2", F.col("score").alias("detection_score"), F.lit("A").alias("team"), F.lit(0.5).alias("team_score"))
    out = LB.label_proposals(rows, maps, 2)
    return out["boxes"].select("tracklet_id", F.col("segment_no").cast("bigint").alias("segment_no"), "frame_index", "task_x1", "task_y2", "contact_proposal_x")


# twelve landmarks per keyframe; the eleventh is displaced, two are withheld
LANDMARKS = """SELECT concat('shot-', CAST(CAST(floor(l_orderkey/2500.0) AS INT) AS STRING)) AS shot_id, CAST(floor(l_orderkey/500.0)*500500 AS BIGINT) AS pts, CAST(l_suppkey % 12 AS INT) AS landmark_no, CASE WHEN l_suppkey % 12 IN (8, 9) THEN 'withheld' ELSE 'fit' END AS role,
 (l_suppkey % 12 % 4)*30.0E0 + sum(l_partkey) % 25 AS field_x, floor(l_suppkey % 12 / 4.0)*20.0E0 + sum(l_partkey) % 11 AS field_y, CASE WHEN l_suppkey % 12 = 11 THEN 40.0E0 ELSE 0 END AS moved FROM lineitem GROUP BY floor(l_orderkey/2500.0), floor(l_orderkey/500.0), l_suppkey % 12"""


def landmarks(v):
    base = v.spark.sql(with_views("", f"SELECT * FROM ({LANDMARKS})", v.sf_dir))
    w = 1.0 + 0.002 * F.col("field_x") + 0.004 * F.col("field_y")
    return base.select(
        "shot_id", "pts", "landmark_no", "role", "field_x", "field_y",
        ((9.0 * F.col("field_x") + 1.5 * F.col("field_y") + 40.0) / w + F.col("moved")).alias("image_x"), ((0.5 * F.col("field_x") + 11.0 * F.col("field_y") + 60.0) / w).alias("image_y"),
    )


@query("a16_homography_fit")
def a16(v):
    out = CAL.fit_keyframes(landmarks(v))
    return out.select("shot_id", "pts", "point_count", "inlier_count", F.concat_ws(",", F.transform("outlier_indices", lambda x: x.cast("string"))).alias("outliers"), F.round("median_error_px", 6).alias("median_error_px"), F.round("withheld_p95_error_yards", 6).alias("withheld_p95_error_yards"), "status", "reason")


@query("a18_timeline_from_landmarks")
def a18(v):
    out = CAL.timeline_from_landmarks(landmarks(v))
    return out.select("shot_id", "keyframe_id", "pts_start", "pts_end", "status", "rejected", F.size("support_polygon").alias("corners"), F.concat_ws(",", "broken").alias("broken"))
