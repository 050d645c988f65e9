"""Labelled shapes to annotation records, and proposals back to the labelling task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.functions import crop as K
from trackspark.functions.field import landmark_point
from trackspark.functions.geometry import contact_x, contact_y
from trackspark.functions.scalars import UNDECIDED_IDS
from trackspark.operators.tracks import gap_segments
from trackspark.session import cut_lineage

SETTLED = ("reviewed", "accepted")
FRAME_TAGS = ("reviewed_frame", "empty_frame", "ignored_frame")


def import_status(status: Column, reviewed: bool) -> tuple[Column, Column]:
    """(status to import or null when dropped, whether the record breaks the import rule)."""
    given = F.trim(F.coalesce(status, F.lit("")))
    dropped = given == "rejected"
    if not reviewed:
        return F.when(~dropped, F.lit("unreviewed")), F.lit(False)
    ok = given.isin(*SETTLED)
    return F.when(~dropped & ok, given), ~dropped & ~ok


def on_source(shapes: DataFrame, frame_map: DataFrame) -> dict[str, DataFrame]:
    """Label shapes with their source frame and PTS; ``unmapped`` lists shapes of unknown task frames."""
    mapping = frame_map.select("file_path", "task_frame", "source_frame", "source_pts", "task_width", "task_height", *K.CROP, "source_width", "source_height", "source_sha256")
    keys = ["file_path", "task_frame"]
    return {"mapped": shapes.join(mapping, keys), "unmapped": shapes.join(mapping, keys, "left_anti")}


def _text(name: str) -> Column:
    value = F.try_element_at("attributes", F.lit(name))
    return F.when(F.trim(value) != "", value)


def _tracklet(default: Column | None = None) -> Column:
    named = F.coalesce(_text("tracklet_id"), _text("source_tracklet_id"))
    return named if default is None else F.coalesce(named, default)


def import_labels(
    boxes: DataFrame, points: DataFrame, tags: DataFrame, frame_map: DataFrame, shots: DataFrame,
    reviewed: bool = False, reviewer: str | None = None, revision: int | None = None, reviewed_at: str | None = None, annotation_confidence: float | None = None,
) -> dict[str, DataFrame]:
    """``records``, ``landmarks``, ``frame_labels``, ``proposals``, ``timing_events`` and ``violations``.

    shots(file_path, shot_id, start_frame, end_frame): the shot each label file belongs to.
    """
    if reviewed and (not reviewer or not reviewed_at or revision is None or annotation_confidence is None):
        raise ValueError("a reviewed import names its reviewer, revision, time and confidence")
    stamp = [
        F.lit(reviewer if reviewed else None).cast("string").alias("reviewer"), F.lit(revision if reviewed else None).cast("int").alias("revision"),
        F.lit(reviewed_at if reviewed else None).cast("string").alias("reviewed_at"), F.lit(annotation_confidence if reviewed else None).cast("double").alias("annotation_confidence"),
    ]
    spans = shots.select("file_path", "shot_id", F.col("start_frame").alias("_s"), F.col("end_frame").alias("_e"))
    violations = []
    out_row = lambda df, rule: df.select("file_path", "label", F.col("task_frame"), rule.alias("rule"))

    def place(shapes: DataFrame) -> DataFrame:
        split = on_source(shapes, frame_map)
        violations.append(out_row(split["unmapped"], F.lit("unmapped_task_frame")))
        rows = split["mapped"].join(spans, "file_path")
        status, broken = import_status(_text("review_status"), reviewed)
        return rows.withColumn("_inside", (F.col("source_frame") >= F.col("_s")) & (F.col("source_frame") < F.col("_e"))).withColumn("review_status", status).withColumn("_unsettled", broken)

    def disagreement(checked: Column) -> Column:
        number = lambda name, column: checked & _text(name).isNotNull() & ~_text(name).try_cast("bigint").eqNullSafe(F.col(column))
        foreign = _text("source_sha256").isNotNull() & (_text("source_sha256") != F.col("source_sha256"))
        return F.array_compact(F.array(
            F.when(~F.col("_inside"), "outside_shot"), F.when(foreign, "source_hash"), F.when(number("source_frame", "source_frame"), "source_frame_attribute"),
            F.when(number("source_pts", "source_pts"), "source_pts_attribute"), F.when(F.col("_unsettled"), "not_reviewed"),
        ))

    seen = place(boxes.filter(~F.col("outside"))).withColumn("_rules", disagreement(F.col("keyframe")))
    violations.append(seen.select("file_path", "label", "task_frame", F.explode("_rules").alias("rule")))
    good = seen.filter((F.size("_rules") == 0) & F.col("review_status").isNotNull()).withColumn("_box", K.box_to_source())
    track = _tracklet(F.concat(F.lit("cvat-track-"), F.col("track_id").cast("string")))
    undecided = [u for u in UNDECIDED_IDS if u]
    decided = lambda name: F.when(~_text(name).isin(*undecided), _text(name))
    unit = lambda name: _text(name).try_cast("double")
    for name in ("detection_score", "team_score", "ground_contact_confidence"):
        violations.append(out_row(good.filter(_text(name).isNotNull() & ~F.coalesce(unit(name).between(0.0, 1.0), F.lit(False))), F.lit(name)))
    provenance = F.from_json(_text("source_inference_row_json"), "struct<run_id:string,shot_id:string,tracklet_id:string,frame_index:bigint,pts:bigint>")
    good = good.withColumn("tracklet", track).withColumn("_row", provenance)
    from_run = F.col("_row").isNotNull()
    same_owner = F.col("_row.run_id").eqNullSafe(_text("source_run_id")) & F.col("_row.shot_id").eqNullSafe(_text("source_shot_id")) & F.col("_row.tracklet_id").eqNullSafe(F.col("tracklet"))
    same_place = F.col("_row.frame_index").eqNullSafe(F.col("source_frame")) & F.col("_row.pts").eqNullSafe(F.col("source_pts"))
    violations.append(out_row(good.filter(from_run & ~same_owner), F.lit("inference_row_owner")))
    violations.append(out_row(good.filter(from_run & F.col("keyframe") & ~same_place), F.lit("inference_row_place")))
    inside_image = (F.col("_box.x1") >= 0) & (F.col("_box.y1") >= 0) & (F.col("_box.x2") <= F.col("source_width")) & (F.col("_box.y2") <= F.col("source_height"))
    violations.append(out_row(good.filter(~inside_image), F.lit("box_outside_image")))
    record_id = F.concat_ws(":", "shot_id", "tracklet", F.col("source_frame").cast("string"))
    records = good.select(
        "file_path", record_id.alias("id"), "shot_id", "source_frame", F.col("source_pts").alias("pts"), F.col("tracklet").alias("track_id"), "label", "review_status",
        F.when(F.col("occluded"), "occluded").otherwise("visible").alias("visibility"),
        F.array("_box.x1", "_box.y1", "_box.x2", "_box.y2").alias("bbox_xyxy_px"), decided("team").alias("team"), decided("global_id").alias("global_id"),
        decided("jersey_number").try_cast("int").alias("jersey_number"), _text("team_suggestion").alias("team_suggestion"), _text("cross_shot_review_status").alias("cross_shot_review_status"),
        _text("identity_second_reviewer").alias("identity_second_reviewer"), _text("identity_second_reviewed_at").alias("identity_second_reviewed_at"),
        _text("identity_second_revision").try_cast("int").alias("identity_second_revision"), unit("identity_second_confidence").alias("identity_second_confidence"),
        unit("detection_score").alias("detection_score"), unit("team_score").alias("team_score"), unit("ground_contact_confidence").alias("ground_contact_confidence"),
        F.from_json(_text("ground_contact_xy_yards"), "array<double>").alias("ground_contact_xy_yards"), F.when(from_run & same_owner & same_place, F.col("_row.run_id")).alias("inference_run_id"),
        F.lit("cvat").alias("annotation_source"),
    )

    marks = place(points.filter("keyframe and not outside")).withColumn("_rules", disagreement(F.lit(True)))
    violations.append(marks.select("file_path", "label", "task_frame", F.explode("_rules").alias("rule")))
    usable = marks.filter((F.size("_rules") == 0) & F.col("review_status").isNotNull())
    single = usable.filter(F.size("coordinates") == 1).withColumn("_p", K.point_to_source(F.get("coordinates", F.lit(0))["x"], F.get("coordinates", F.lit(0))["y"]))
    violations.append(out_row(single.filter("_p is null"), F.lit("point_outside_task")))
    single = single.filter("_p is not null").withColumn("_landmark", F.trim(_text("landmark_id"))).withColumn("_role", F.trim(_text("role"))).withColumn("_event", F.trim(_text("event"))).withColumn("_owner", F.trim(_tracklet()))
    is_event = (F.col("label") == "timing_event") & F.col("_event").isNotNull()
    is_contact = (F.col("label") == "ground_contact") & F.col("_owner").isNotNull()
    is_landmark = (F.col("label") == "field_landmark") & F.col("_landmark").isNotNull() & F.coalesce(F.col("_role").isin("fit", "withheld"), F.lit(False))
    known = F.coalesce(is_event | is_contact | is_landmark, F.lit(False))
    proposal = lambda df: df.select("file_path", "shot_id", "source_frame", F.col("source_pts").alias("pts"), "label", F.lit("unreviewed").alias("review_status"))
    proposals = proposal(usable.filter(F.size("coordinates") != 1)).unionByName(proposal(single.filter(~known)))
    timing = single.filter(is_event).select(
        "file_path", F.concat(F.col("shot_id"), F.lit(":"), F.col("source_frame").cast("string"), F.lit(":event-"), F.col("track_id").cast("string")).alias("id"), "shot_id", "source_frame", F.col("source_pts").alias("pts"),
        F.col("_event").alias("event"), _text("play_id").alias("play_id"), unit("play_time_s").alias("play_time_s"), "review_status", *stamp,
    )
    point = landmark_point(F.col("_landmark"))
    marked = single.filter(is_landmark).withColumn("_f", point)
    violations.append(out_row(marked.filter("_f is null"), F.lit("semantic_landmark")))
    declared = F.hypot(unit("field_x_yards") - F.col("_f.x"), unit("field_y_yards") - F.col("_f.y"))
    has_declared = _text("field_x_yards").isNotNull() | _text("field_y_yards").isNotNull()
    violations.append(out_row(marked.filter(F.col("_f").isNotNull() & has_declared & ~F.coalesce(declared <= 0.01, F.lit(False))), F.lit("landmark_coordinates")))
    landmarks = marked.filter("_f is not null").select(
        "file_path", F.concat_ws(":", "shot_id", "_landmark", F.col("source_frame").cast("string")).alias("id"), "shot_id", "source_frame", F.col("source_pts").alias("pts"),
        F.array("_p.x", "_p.y").alias("image_xy_px"), F.array("_f.x", "_f.y").alias("field_xy_yards"), F.col("_landmark").alias("landmark_id"), F.col("_role").alias("role"), "review_status", *stamp,
    )
    contacts = single.filter(is_contact).select(
        "file_path", "shot_id", "source_frame", F.col("_owner").alias("track_id"), F.col("source_pts").alias("_pts"), F.array("_p.x", "_p.y").alias("ground_contact_xy_px"), unit("ground_contact_confidence").alias("_confidence"), F.col("review_status").alias("_contact_status"), "label", "task_frame",
    )
    where = ["file_path", "shot_id", "track_id", "source_frame"]
    doubled = contacts.groupBy(*where).agg(F.count(F.lit(1)).alias("n"), F.min("task_frame").alias("task_frame"), F.min("label").alias("label")).filter("n > 1")
    violations.append(out_row(doubled, F.lit("duplicate_contact")))
    once = contacts.drop("label", "task_frame").join(doubled.select(*where), where, "left_anti")
    merged = records.join(once, where, "full")
    full = merged.select(
        *[c for c in ("file_path", "shot_id", "track_id", "source_frame")], F.coalesce("id", F.concat_ws(":", "shot_id", "track_id", F.col("source_frame").cast("string"))).alias("id"),
        F.coalesce("pts", "_pts").alias("pts"), F.coalesce("label", F.lit("player")).alias("label"), F.coalesce("review_status", "_contact_status").alias("review_status"), "visibility", "bbox_xyxy_px", "team", "global_id", "jersey_number",
        "team_suggestion", "cross_shot_review_status", "identity_second_reviewer", "identity_second_reviewed_at", "identity_second_revision", "identity_second_confidence", "detection_score", "team_score",
        F.coalesce("_confidence", "ground_contact_confidence").alias("ground_contact_confidence"), "ground_contact_xy_yards", "ground_contact_xy_px", "inference_run_id", F.coalesce("annotation_source", F.lit("cvat_ground_contact")).alias("annotation_source"), *stamp,
    )

    tagged = place(tags)
    violations.append(out_row(tagged.filter(~F.col("_inside")), F.lit("outside_shot")))
    violations.append(out_row(tagged.filter(F.col("_inside") & F.col("_unsettled")), F.lit("not_reviewed")))
    yes = lambda name, default: F.coalesce(F.try_element_at("attributes", F.lit(name)), F.lit(default)).isin("true", "1")
    is_frame_tag = F.col("label").isin(*FRAME_TAGS)
    counted = tagged.filter(F.col("_inside") & F.col("review_status").isNotNull() & (is_frame_tag | yes("labeled", "")))
    frame_labels = counted.groupBy("file_path", "shot_id", "source_frame").agg(
        F.min("source_pts").alias("pts"), F.bool_or(yes("labeled", "true") | is_frame_tag).alias("labeled"),
        F.bool_or((F.col("label") == "ignored_frame") | yes("ignore", "false")).alias("ignore"), F.min_by("review_status", F.struct("task_frame", "label")).alias("review_status"),
    ).select("*", *stamp)
    found = violations[0]
    for part in violations[1:]:
        found = found.unionByName(part)
    return {"records": full, "landmarks": landmarks, "frame_labels": frame_labels, "proposals": proposals, "timing_events": timing, "violations": found}


def label_proposals(rows: DataFrame, frame_map: DataFrame, max_gap_frames: int = 2) -> dict[str, DataFrame]:
    """Observations as task-space ``boxes`` and ``contacts`` per gap-free segment, clipped to the crop.

    rows(file_path, run_id, shot_id, tracklet_id, frame_index, pts, x1..y2, detection_score, team, team_score)
    """
    mapping = frame_map.select("file_path", F.col("source_frame").alias("frame_index"), "task_frame", "source_pts", "task_width", "task_height", *K.CROP)
    joined = rows.join(mapping, ["file_path", "frame_index"])
    mismatch = joined.filter(F.col("pts") != F.col("source_pts")).select("file_path", "tracklet_id", "frame_index", F.lit("pts_mismatch").alias("rule"))
    runs = rows.groupBy("file_path", "tracklet_id").agg(F.count_distinct("run_id").alias("n"), F.count_if(F.coalesce("run_id", F.lit("")) == "").alias("blank"))
    torn = runs.filter("n <> 1 or blank > 0").select("file_path", "tracklet_id", F.lit(None).cast("bigint").alias("frame_index"), F.lit("run_id").alias("rule"))
    exact = joined.filter(F.col("pts") == F.col("source_pts"))
    exact = exact.select(*[c for c in exact.columns if c not in ("pts", "source_id", "play_time_s")])
    parts = cut_lineage(gap_segments(exact, max_gap_frames))  # boxes and contacts read them
    clipped = parts.withColumn("_c", K.clip_to_crop()).withColumn("_t", F.when(F.col("_c").isNotNull(), K.box_to_task([F.col(f"_c.{c}") for c in ("x1", "y1", "x2", "y2")])))
    boxes = clipped.filter("_t is not null").select(
        "file_path", "run_id", "shot_id", "tracklet_id", "segment_no", "frame_index", "source_pts", "task_frame", *[F.col(f"_t.{c}").alias(f"task_{c}") for c in ("x1", "y1", "x2", "y2")],
        F.bround((F.col("_c.x1") + F.col("_c.x2")) / 2.0, 3).alias("contact_proposal_x"), F.bround("_c.y2", 3).alias("contact_proposal_y"), "detection_score", F.coalesce("team", F.lit("unknown")).alias("team_suggestion"),
        F.coalesce("team_score", F.lit(0.0)).alias("team_score"), F.lit("unreviewed").alias("review_status"),
    )
    with_box = boxes.select("file_path", "tracklet_id", "segment_no").distinct()
    contacts = parts.withColumn("_p", K.point_to_task(contact_x(), contact_y())).filter("_p is not null").join(with_box, ["file_path", "tracklet_id", "segment_no"], "left_semi").select(
        "file_path", "shot_id", "tracklet_id", "segment_no", "frame_index", "source_pts", "task_frame", F.col("_p.x").alias("task_x"), F.col("_p.y").alias("task_y"), F.lit("bbox_bottom_center").alias("method"),
    )
    return {"boxes": boxes, "contacts": contacts, "violations": mismatch.unionByName(torn)}
