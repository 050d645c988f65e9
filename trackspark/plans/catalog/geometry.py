"""Boxes, projections, polygons and landmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.functions import crop as K
from trackspark.functions import geometry as G
from trackspark.functions.field import landmark_point
from trackspark.operators import calibrate as CAL
from trackspark.plans.catalog import iou_sql, query

FIT_COLS = "m00,m01,m02,m10,m11,m12,m20,m21,m22,inlier_count,median_error_px,reprojection_threshold_px,median_error_yards,withheld_point_count,withheld_p95_error_yards,status"
CLOSED = "closed AS (SELECT k.* REPLACE (coalesce(pts_end, lead(pts_start) OVER (PARTITION BY shot_id ORDER BY pts_start, keyframe_id)) AS pts_end) FROM keyframes k)"
USABLE = "(inlier_count >= 4 AND median_error_px <= reprojection_threshold_px*2)"
ELIGIBLE = f"({USABLE} AND status = 'valid' AND withheld_point_count > 0 AND withheld_p95_error_yards IS NOT NULL)"


def project_sql(x: str, y: str) -> tuple[str, str, str]:
    """(x yards, y yards, on-field test) of a pixel in SQL."""
    w = f"(m20*({x})+m21*({y})+m22)"
    fx = f"((m00*({x})+m01*({y})+m02)/{w})"
    fy = f"((m10*({x})+m11*({y})+m12)/{w})"
    ok = f"({USABLE} AND abs({w}) > 1e-9 AND {fx} BETWEEN 0 AND 120 AND {fy} BETWEEN 0 AND 160.0E0/3)"
    return fx, fy, ok


FX, FY, OK = project_sql("(x1+x2)/2.0E0", "y2")


@query("p4_box_iou", "obs ref_objects", f"""
SELECT o.shot_id, o.frame_index, o.tracklet_id, r.object_id, round({iou_sql('r', 'o')}, 6) AS iou
FROM obs o JOIN ref_objects r ON o.shot_id = r.shot_id AND o.frame_index = r.frame_index WHERE {iou_sql('r', 'o')} > 0.25""")
def p4(v):
    refs = v.ref_objects.select("shot_id", "frame_index", "object_id", *[F.col(c).alias(f"r_{c}") for c in G.BOX])
    return (
        v.obs.join(refs, ["shot_id", "frame_index"])
        .withColumn("iou", G.iou([f"r_{c}" for c in G.BOX], G.BOX)).filter("iou > 0.25")
        .select("shot_id", "frame_index", "tracklet_id", "object_id", F.round("iou", 6).alias("iou"))
    )


@query("p5_ground_contact", "obs", "SELECT shot_id, tracklet_id, frame_index, (x1+x2)/2.0E0 AS x_px, y2 AS y_px FROM obs")
def p5(v):
    return v.obs.select("shot_id", "tracklet_id", "frame_index", G.contact_x().alias("x_px"), G.contact_y().alias("y_px"))


def timeline(v):
    closed = CAL.close_intervals(v.keyframes)
    return closed.select("shot_id", "pts_start", "pts_end", "keyframe_id", CAL.as_fit(closed, "keyframe_id").alias("fit"))


@query("p6_homography_projection", "obs keyframes", f"""
, {CLOSED} SELECT o.shot_id, o.tracklet_id, o.frame_index, k.keyframe_id, CASE WHEN {OK} THEN round({FX},6) END AS field_x, CASE WHEN {OK} THEN round({FY},6) END AS field_y
FROM obs o JOIN closed k ON k.shot_id = o.shot_id AND o.pts >= k.pts_start AND (k.pts_end IS NULL OR o.pts < k.pts_end)""".lstrip("\n"))
def p6(v):
    rows = CAL.calibration_at(v.obs, timeline(v)).filter("fit is not null")
    point = G.project(G.contact_x(), G.contact_y(), [F.col(f"fit.{m}") for m in G.MATRIX], G.matrix_usable("fit."))
    return rows.withColumn("_p", point).select(
        "shot_id", "tracklet_id", "frame_index", F.col("fit.calibration_id").alias("keyframe_id"),
        F.round("_p.x", 6).alias("field_x"), F.round("_p.y", 6).alias("field_y"),
    )


def _sensitivity_sql() -> str:
    parts = []
    for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)):
        nx, ny, nok = project_sql(f"(x1+x2)/2.0E0+({dx})", f"y2+({dy})")
        parts.append(f"CASE WHEN {nok} THEN sqrt(pow({nx}-{FX},2)+pow({ny}-{FY},2)) END")
    return f"CASE WHEN {OK} THEN coalesce(greatest({', '.join(parts)}), 0) END"


@query("p7_projection_sensitivity", "obs keyframes", f"""
, {CLOSED} SELECT o.shot_id, o.tracklet_id, o.frame_index, round({_sensitivity_sql()}, 6) AS sensitivity_yards
FROM obs o JOIN closed k ON k.shot_id = o.shot_id AND o.pts >= k.pts_start AND (k.pts_end IS NULL OR o.pts < k.pts_end)""".lstrip("\n"))
def p7(v):
    rows = CAL.calibration_at(v.obs, timeline(v)).filter("fit is not null")
    value = G.projection_sensitivity(
        G.contact_x(), G.contact_y(), 1.0, [F.col(f"fit.{m}") for m in G.MATRIX], G.matrix_usable("fit.")
    )
    return rows.select("shot_id", "tracklet_id", "frame_index", F.round(value, 6).alias("sensitivity_yards"))


# a quadrilateral of each keyframe, as fixed offsets
QUAD = ((10.0, 20.0), (90.0, 25.0), (80.0, 46.5), (15.0, 45.0))


def _inside_sql(x: str, y: str) -> str:
    edges = list(zip(QUAD, QUAD[1:] + QUAD[:1]))
    odd = "+".join(
        f"(CASE WHEN ({ay}E0 > {y}) <> ({by}E0 > {y}) AND {x} < ({bx}E0-{ax}E0)*({y}-{ay}E0)/({by}E0-{ay}E0)+{ax}E0 THEN 1 ELSE 0 END)"
        for (ax, ay), (bx, by) in edges
    )
    on = " OR ".join(
        f"(abs(({bx}E0-{ax}E0)*({y}-{ay}E0)-({by}E0-{ay}E0)*({x}-{ax}E0)) < 1e-9 AND {x} BETWEEN {min(ax, bx)} AND {max(ax, bx)} AND {y} BETWEEN {min(ay, by)} AND {max(ay, by)})"
        for (ax, ay), (bx, by) in edges
    )
    return f"(({odd}) % 2 = 1 OR {on})"


def quad():
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in QUAD])


@query("p8_observation_projection", "obs keyframes", f"""
, {CLOSED}, placed AS (SELECT o.shot_id, o.tracklet_id, o.frame_index, k.keyframe_id, k.status, k.keyframe_id IS NOT NULL AS has_fit,
   NOT {_inside_sql('((x1+x2)/2.0E0)', 'y2')} AND k.keyframe_id IS NOT NULL AS outside, coalesce({OK}, false) AS ok, {FX} AS fx, {FY} AS fy, {ELIGIBLE} AS eligible, k.withheld_p95_error_yards AS p95
 FROM obs o LEFT JOIN closed k ON k.shot_id = o.shot_id AND o.pts >= k.pts_start AND (k.pts_end IS NULL OR o.pts < k.pts_end))
SELECT shot_id, tracklet_id, frame_index, keyframe_id AS calibration_id, CASE WHEN ok AND NOT outside THEN round(fx,6) END AS field_x, CASE WHEN ok AND NOT outside THEN round(fy,6) END AS field_y,
 CASE WHEN outside THEN 'invalid' ELSE status END AS calibration_status,
 CASE WHEN outside THEN 'contact point lies outside calibration support' WHEN has_fit AND NOT ok THEN 'projection_invalid' END AS calibration_reason,
 CASE WHEN ok AND NOT outside AND eligible THEN p95 END AS position_uncertainty_yards, CASE WHEN ok AND NOT outside THEN 'bottom_center' END AS position_source FROM placed""".lstrip("\n"))
def p8(v):
    closed = CAL.close_intervals(v.keyframes).withColumn("support_polygon", quad())
    lines = closed.select("shot_id", "pts_start", "pts_end", CAL.as_fit(closed, "keyframe_id", ["support_polygon"]).alias("fit"))
    placed = CAL.project_rows(CAL.calibration_at(v.obs, lines))
    return placed.select(
        "shot_id", "tracklet_id", "frame_index", "calibration_id", F.round("field_x", 6).alias("field_x"), F.round("field_y", 6).alias("field_y"),
        "calibration_status", "calibration_reason", "position_uncertainty_yards", "position_source",
    )


CROPPED = """SELECT tracklet_id, frame_index, x1, y1, x2, y2, 8.0E0 AS cx1, 8.0E0 AS cy1, 8.0E0 + 4*(10 + frame_index % 17) AS cx2, 45.0E0 AS cy2, 600 AS task_width, 360 AS task_height FROM obs"""


@query("p9_task_transforms", "obs", f"""
SELECT tracklet_id, frame_index, CASE WHEN inside THEN round((x1-cx1)*task_width/(cx2-cx1),6) END AS tx1, CASE WHEN inside THEN round((y2-cy1)*task_height/(cy2-cy1),6) END AS ty2,
 round(cx1 + x1*(cx2-cx1)/task_width, 5) AS back_x1, round(cy1 + y2*(cy2-cy1)/task_height, 5) AS back_y2,
 CASE WHEN (x1+x2)/2 BETWEEN cx1 AND cx2 AND y2 BETWEEN cy1 AND cy2 THEN round(((x1+x2)/2-cx1)*task_width/(cx2-cx1),6) END AS point_x
FROM (SELECT *, (x1-cx1)*task_width/(cx2-cx1) >= -1e-6 AND (y1-cy1) >= 0 AND (x2-cx1)*task_width/(cx2-cx1) <= task_width + 1e-6 AND (y2-cy1)*task_height/(cy2-cy1) <= task_height + 1e-6 AS inside FROM ({CROPPED}))""")
def p9(v):
    from trackspark.plans.views import with_views

    rows = v.spark.sql(with_views("obs", CROPPED, v.sf_dir))
    task, back = K.box_to_task(), K.box_to_source()
    return rows.select(
        "tracklet_id", "frame_index", F.round(task["x1"], 6).alias("tx1"), F.round(task["y2"], 6).alias("ty2"),
        F.round(back["x1"], 5).alias("back_x1"), F.round(back["y2"], 5).alias("back_y2"),
        F.round(K.point_to_task(G.contact_x(), G.contact_y())["x"], 6).alias("point_x"),
    )


@query("p10_crop_boxes", "obs", f"""
SELECT tracklet_id, frame_index, round(cx1 + x1*(cx2-cx1)/task_width,6) AS sx1, round(cy1 + y2*(cy2-cy1)/task_height,6) AS sy2, round(cx1 + x2, 6) AS plain_x2,
 CASE WHEN kept THEN greatest(x1,cx1) END AS clip_x1, CASE WHEN kept THEN least(x2,cx2) END AS clip_x2, CASE WHEN kept THEN least(y2,cy2) END AS clip_y2
FROM (SELECT *, least(x2,cx2) > greatest(x1,cx1) AND least(y2,cy2) > greatest(y1,cy1) AS kept FROM ({CROPPED}))""")
def p10(v):
    from trackspark.plans.views import with_views

    rows = v.spark.sql(with_views("obs", CROPPED, v.sf_dir))
    scaled, clipped = K.crop_box_to_source(), K.clip_to_crop()
    plain = K.crop_box_to_source(resize=[F.lit(None).cast("double"), F.lit(None).cast("double")])
    return rows.select(
        "tracklet_id", "frame_index", F.round(scaled["x1"], 6).alias("sx1"), F.round(scaled["y2"], 6).alias("sy2"), F.round(plain["x2"], 6).alias("plain_x2"),
        clipped["x1"].alias("clip_x1"), clipped["x2"].alias("clip_x2"), clipped["y2"].alias("clip_y2"),
    )


@query("p11_point_in_polygon", "obs", f"""
SELECT shot_id, tracklet_id, frame_index, {_inside_sql('((x1+x2)/2.0E0)', 'y2')} AS inside FROM obs""")
def p11(v):
    return v.obs.select("shot_id", "tracklet_id", "frame_index", G.in_polygon(G.contact_x(), G.contact_y(), quad()).alias("inside"))


LANDMARKS = """SELECT p_partkey, p_partkey % 6 AS form, p_size, CASE p_partkey % 6 WHEN 0 THEN concat('yardline:', CAST(p_size*3 AS STRING), ':sideline:near')
 WHEN 1 THEN concat('Yard:', CAST(p_size AS STRING), '/hash-far') WHEN 2 THEN 'goal_line:west:hash:near' WHEN 3 THEN 'End_Line/east/sideline/far'
 WHEN 4 THEN concat('goal:line:', CASE WHEN p_size % 2 = 0 THEN 'east' ELSE 'nowhere' END, ':hash-b') ELSE concat('yard', CAST(p_size AS STRING)) END AS landmark_id FROM part"""


@query("p12_field_landmark", "", f"""
SELECT p_partkey, landmark_id, CASE form WHEN 0 THEN CASE WHEN p_size*3 <= 120 THEN p_size*3.0E0 END WHEN 1 THEN p_size*1.0E0 WHEN 2 THEN 10.0E0 WHEN 3 THEN 120.0E0 WHEN 4 THEN CASE WHEN p_size % 2 = 0 THEN 110.0E0 END END AS x,
 round(CASE form WHEN 0 THEN CASE WHEN p_size*3 <= 120 THEN 0.0E0 END WHEN 1 THEN 160.0E0/3 - 70.75E0/3 WHEN 2 THEN 70.75E0/3 WHEN 3 THEN 160.0E0/3 WHEN 4 THEN CASE WHEN p_size % 2 = 0 THEN 160.0E0/3 - 70.75E0/3 END END, 6) AS y
FROM ({LANDMARKS})""")
def p12(v):
    from trackspark.plans.views import with_views

    base = v.spark.sql(with_views("", f"SELECT * FROM ({LANDMARKS})", v.sf_dir))
    point = landmark_point(F.col("landmark_id"))
    return base.select("p_partkey", "landmark_id", point["x"].alias("x"), F.round(point["y"], 6).alias("y"))


@query("p13_matrix_normalisation", "keyframes", """
SELECT keyframe_id, abs(scale) > 1e-12 AS usable, CASE WHEN abs(scale) > 1e-12 THEN round(m00/scale,6) END AS n00, CASE WHEN abs(scale) > 1e-12 THEN round(m21/scale,9) END AS n21
FROM (SELECT *, (median_error_px - 4)*0.5E0 AS scale FROM keyframes)""")
def p13(v):
    from trackspark.sources.calibration import normalised_matrix

    frames = v.keyframes.withColumn("scale", (F.col("median_error_px") - 4) * 0.5)
    rows = frames.select("keyframe_id", F.array(
        F.array("m00", "m01", "m02"), F.array("m10", "m11", "m12"), F.array("m20", "m21", "scale")).alias("matrix"))
    n = normalised_matrix(F.col("matrix"))
    return rows.select(
        "keyframe_id", n.isNotNull().alias("usable"), F.round(F.get(n, F.lit(0)), 6).alias("n00"), F.round(F.get(n, F.lit(7)), 9).alias("n21")
    )
