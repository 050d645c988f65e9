"""Annotation rules, manifest templates and merges, references from annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.functions import geometry as G
from trackspark.functions.field import landmark_point, on_field
from trackspark.functions.scalars import meaningful_id, zoned_timestamp
from trackspark.operators.calibrate import calibration_at
from trackspark.scale import adjacent_row, frame_bucket

# Fixed enumerations of the annotation contract.
LABELS = ("player", "official", "football")
VISIBILITIES = ("visible", "partially_visible", "occluded", "out_of_frame", "unknown")
SETTLED = ("reviewed", "accepted")
CROSS_SHOT_STATUSES = ("approved", "ambiguous", "rejected")
LANDMARK_SLACK_YARDS = 0.01


def _unit(name: str) -> Column:
    return F.coalesce(G.finite(name) & F.col(name).between(0.0, 1.0), F.lit(False))


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(name, F.lit(""))) == ""


def review_rules() -> dict[str, Column]:
    """Each entry is true when the record breaks the rule."""
    return {
        "reviewer": _blank("reviewer") | _blank("reviewed_at"),
        "reviewed_at": ~_blank("reviewed_at") & zoned_timestamp(F.trim("reviewed_at")).isNull(),
        "revision": F.coalesce("revision", F.lit(0)) <= 0,
        "annotation_confidence": ~_unit("annotation_confidence"),
    }


def identity_rules() -> dict[str, Column]:
    status = F.trim(F.coalesce("cross_shot_review_status", F.lit("")))
    named = meaningful_id(F.coalesce("global_id", "cross_shot_id"))
    decided = status != ""
    same_person = F.lower(F.trim(F.coalesce("identity_second_reviewer", F.lit("")))) == F.lower(F.trim(F.coalesce("reviewer", F.lit(""))))
    return {
        "global_id_needs_approval": named & (status != "approved"),
        "cross_shot_review_status": decided & ~status.isin(*CROSS_SHOT_STATUSES),
        "approved_without_global_id": (status == "approved") & ~named,
        "second_reviewer": decided & (_blank("identity_second_reviewer") | same_person),
        "second_reviewed_at": decided & zoned_timestamp(F.trim(F.coalesce("identity_second_reviewed_at", F.lit("")))).isNull(),
        "second_revision": decided & (F.coalesce("identity_second_revision", F.lit(0)) <= 0),
        "second_confidence": decided & ~_unit("identity_second_confidence"),
    }


def _explode_rules(df: DataFrame, kind: str, item: Column, rules: dict[str, Column]) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(name)) for name, hit in rules.items()]))
    return df.select("file_path", F.lit(kind).alias("kind"), item.alias("item"), F.explode(hits).alias("rule"))


def _repeated(df: DataFrame, kind: str, key: list[str], rule: str) -> DataFrame:
    return df.groupBy("file_path", *key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "file_path", F.lit(kind).alias("kind"), F.concat_ws(":", *[F.col(k).cast("string") for k in key]).alias("item"), F.lit(rule).alias("rule")
    )


def shot_violations(shots: DataFrame, require_reviewed: bool = True) -> DataFrame:
    """Bad intervals, missing camera labels, overlaps, and plays in two splits."""
    start, end = F.col("start_frame"), F.col("end_frame")
    rules = {"interval": ~F.coalesce((start >= 0) & (start < end) & (end <= F.col("frame_count")), F.lit(False))}
    if require_reviewed:
        rules["camera_label"] = _blank("camera_label")
    near = adjacent_row(
        shots.withColumn("_bucket", frame_bucket("start_frame")), ["file_path"], ["start_frame", "end_frame", "shot_id"], "_bucket", {"_previous_end": "end_frame"}
    )
    split = shots.filter("play_id is not null").groupBy("file_path", "play_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").select(
        "file_path", F.lit("shot").alias("kind"), F.col("play_id").alias("item"), F.lit("play_in_two_splits").alias("rule")
    )
    return _explode_rules(shots, "shot", F.col("shot_id"), rules).unionByName(
        _explode_rules(near, "shot", F.col("shot_id"), {"overlapping_shots": start < F.col("_previous_end")})
    ).unionByName(split)


def _in_shot(records: DataFrame, shots: DataFrame) -> DataFrame:
    spans = shots.select("file_path", "shot_id", F.col("start_frame").alias("_s"), F.col("end_frame").alias("_e"))
    return records.join(spans, ["file_path", "shot_id"], "left")


def _place_rules() -> dict[str, Column]:
    inside = (F.col("source_frame") >= F.col("_s")) & (F.col("source_frame") < F.col("_e"))
    return {
        "unknown_shot": F.col("_s").isNull(),
        "outside_shot": F.col("_s").isNotNull() & ~F.coalesce(inside, F.lit(False)),
        "pts": F.coalesce(F.col("pts") < 0, F.lit(True)),
    }


def _reviewed_rules(require_reviewed: bool) -> dict[str, Column]:
    if not require_reviewed:
        return {}
    return {"not_reviewed": ~F.coalesce(F.col("review_status").isin(*SETTLED), F.lit(False)), **review_rules()}


def annotation_violations(annotations: DataFrame, shots: DataFrame, require_reviewed: bool = True) -> DataFrame:
    rows = _in_shot(annotations, shots)
    box = [F.get("bbox_xyxy_px", F.lit(i)) for i in range(4)]
    has_box, shaped = F.col("bbox_xyxy_px").isNotNull(), F.coalesce((F.size("bbox_xyxy_px") == 4) & G.box_ok(box), F.lit(False))
    inside = (box[0] >= 0) & (box[1] >= 0) & (box[2] <= F.col("width")) & (box[3] <= F.col("height"))
    cx, cy = F.get("ground_contact_xy_px", F.lit(0)), F.get("ground_contact_xy_px", F.lit(1))
    has_contact = F.col("ground_contact_xy_px").isNotNull()
    contact_ok = F.coalesce((F.size("ground_contact_xy_px") == 2) & cx.between(F.lit(0), F.col("width")) & cy.between(F.lit(0), F.col("height")), F.lit(False))
    rules = {
        **_place_rules(),
        "box": has_box & ~shaped,
        "box_outside_image": has_box & shaped & ~inside,
        "contact_outside_image": has_contact & ~contact_ok,
        "contact_confidence": F.col("ground_contact_confidence").isNotNull() & ~_unit("ground_contact_confidence"),
        "coordinate_space": F.coalesce("coordinate_space", F.lit("source")) != "source",
        "label": ~F.coalesce("label", F.lit("player")).isin(*LABELS),
        "visibility": F.col("visibility").isNotNull() & ~F.col("visibility").isin(*VISIBILITIES),
        "team": F.col("team").isNotNull() & _blank("team"),
        **_reviewed_rules(require_reviewed),
    }
    if require_reviewed:
        rules["contact_confidence_missing"] = has_contact & F.col("ground_contact_confidence").isNull()
        rules.update(identity_rules())
    found = _explode_rules(rows, "annotation", F.col("id"), rules).unionByName(_repeated(annotations, "annotation", ["id"], "duplicate_id"))
    status = F.trim(F.coalesce("cross_shot_review_status", F.lit("")))
    given = F.coalesce("global_id", "cross_shot_id")
    decisions = annotations.filter((status != "") | given.isNotNull()).select(
        "file_path", "shot_id", F.trim(F.coalesce("track_id", "id")).alias("object_id"), F.struct(status.alias("s"), F.lower(F.trim(F.coalesce(given, F.lit("")))).alias("g")).alias("d")
    )
    torn = decisions.groupBy("file_path", "shot_id", "object_id").agg(F.count_distinct("d").alias("n")).filter("n > 1").select(
        "file_path", F.lit("annotation").alias("kind"), F.concat_ws(":", "shot_id", "object_id").alias("item"), F.lit("conflicting_identity_decisions").alias("rule")
    )
    return found.unionByName(torn)


def landmark_violations(landmarks: DataFrame, shots: DataFrame, require_reviewed: bool = True) -> DataFrame:
    rows = _in_shot(landmarks, shots)
    ix, iy, fx, fy = F.get("image_xy_px", F.lit(0)), F.get("image_xy_px", F.lit(1)), F.get("field_xy_yards", F.lit(0)), F.get("field_xy_yards", F.lit(1))
    expected = landmark_point(F.col("landmark_id"))
    named = F.col("landmark_id").isNotNull()
    off = F.hypot(fx - expected["x"], fy - expected["y"]) > LANDMARK_SLACK_YARDS
    rules = {
        **_place_rules(),
        "image_point": ~F.coalesce(ix.between(F.lit(0), F.col("width")) & iy.between(F.lit(0), F.col("height")), F.lit(False)),
        "field_point": ~on_field(fx, fy),
        "semantic_id": named & expected.isNull(),
        "semantic_mismatch": named & F.coalesce(off, F.lit(False)),
        "role": ~F.coalesce(F.col("role").isin("fit", "withheld"), F.lit(False)),
        **_reviewed_rules(require_reviewed),
    }
    return _explode_rules(rows, "landmark", F.col("id"), rules).unionByName(_repeated(landmarks, "landmark", ["id"], "duplicate_id"))


def label_violations(frame_labels: DataFrame, timing_events: DataFrame, shots: DataFrame, require_reviewed: bool = True) -> DataFrame:
    labels = _explode_rules(
        _in_shot(frame_labels, shots), "frame_label", F.concat_ws(":", "shot_id", F.col("source_frame").cast("string")), {**_place_rules(), **_reviewed_rules(require_reviewed)}
    ).unionByName(_repeated(frame_labels, "frame_label", ["shot_id", "source_frame"], "duplicate_frame_label"))
    rules = {
        **_place_rules(), "event": _blank("event"), "play_time": F.col("play_time_s").isNotNull() & ~G.finite("play_time_s"), **_reviewed_rules(require_reviewed),
    }
    events = _explode_rules(_in_shot(timing_events, shots), "timing_event", F.col("id"), rules).unionByName(_repeated(timing_events, "timing_event", ["id"], "duplicate_id"))
    return labels.unionByName(events)


def manifest_violations(tables: dict[str, DataFrame], require_reviewed: bool = True) -> DataFrame:
    """(file_path, kind, item, rule) over all child tables of a manifest."""
    shots = tables["shots"]
    found = shot_violations(shots, require_reviewed).unionByName(annotation_violations(tables["annotations"], shots, require_reviewed))
    found = found.unionByName(landmark_violations(tables["landmarks"], shots, require_reviewed))
    found = found.unionByName(label_violations(tables["frame_labels"], tables["timing_events"], shots, require_reviewed))
    if "sources" in tables:
        rules = {
            "schema_version": ~F.col("schema_version").eqNullSafe(F.lit(1)),
            "source_metadata": ~F.coalesce((F.col("width") > 0) & (F.col("height") > 0) & (F.col("frame_count") > 0) & (F.col("tb_num") > 0) & (F.col("tb_den") > 0), F.lit(False)),
        }
        if require_reviewed:
            rules["not_reviewed"] = ~F.col("reviewed")
        found = found.unionByName(_explode_rules(tables["sources"], "source", F.col("source_sha256"), rules))
    return found


def manifest_template(packs: DataFrame, shots: DataFrame) -> dict[str, DataFrame]:
    """Unreviewed shot rows per review pack plus (file_path, kind, item, rule) violations.

    packs(file_path, source_sha256, frame_count), shots(file_path, shot_id, start_frame, end_frame, play_id, split, camera_label)
    """
    joined = shots.join(packs, "file_path")
    rows = joined.select(
        "file_path", "source_sha256", "frame_count", "shot_id", "start_frame", "end_frame", "play_id", F.coalesce("split", F.lit("unassigned")).alias("split"), "camera_label", F.lit(False).alias("reviewed"),
    )
    return {"shots": rows, "violations": shot_violations(rows)}


def merge_manifest(template: DataFrame, imported: DataFrame, open_proposals: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Template records plus imported ones; reviewed only if every record carries reviewer metadata and nothing is open.

    template/imported(*keys, kind, id, review_status, reviewer, reviewed_at, revision, annotation_confidence, ..)
    """
    records = template.unionByName(imported, allowMissingColumns=True)
    complete = F.col("review_status").isin(*SETTLED)
    for hit in review_rules().values():
        complete = complete & ~F.coalesce(hit, F.lit(True))
    counts = open_proposals.groupBy(*keys).agg(F.count(F.lit(1)).alias("_open"))
    status = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), F.bool_and(F.coalesce(complete, F.lit(False))).alias("_all")).join(counts, keys, "left")
    return {
        "records": records,
        "status": status.select(*keys, "records", F.coalesce("_open", F.lit(0).cast("bigint")).alias("open_proposals"), (F.col("_all") & F.col("_open").isNull()).alias("reviewed")),
    }


def reference_from_annotations(
    annotations: DataFrame, frame_labels: DataFrame, timeline: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Reviewed player annotations to ``frames``, ``objects``, ``identities`` and ``conflicts``.

    A pixel contact is projected only through an eligible fit whose support
    polygon holds it; every contact says how its projection went. Frames exist
    only where review put a record or a label. timeline(shot_id, pts_start, pts_end, fit with support_polygon)
    """
    key = ["source_sha256", "shot_id", "frame_index"]
    players = annotations.filter(F.coalesce("label", F.lit("player")) == "player").withColumn("frame_index", F.col("source_frame")).withColumn(
        "object_id", F.trim(F.when(~_blank("track_id"), F.col("track_id")).otherwise(F.coalesce("id", F.lit(""))))
    )
    conflict = lambda df, rule: df.select(*key, "object_id", F.lit(rule).alias("rule"))
    none = F.lit(None).cast("string")
    torn_pts = players.groupBy(*key).agg(F.count_distinct("pts").alias("n")).filter("n > 1").withColumn("object_id", none)
    repeats = players.groupBy(*key, "object_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    given = F.coalesce("global_id", "cross_shot_id")
    named = players.filter(meaningful_id(given)).select("source_sha256", "shot_id", "object_id", given.alias("global_id")).distinct()
    torn_ids = named.groupBy("source_sha256", "shot_id", "object_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("frame_index", F.lit(None).cast("bigint"))
    conflicts = (
        conflict(torn_pts, "conflicting_pts").unionByName(conflict(repeats, "duplicate_object")).unionByName(conflict(torn_ids, "conflicting_global_id"))
        .unionByName(conflict(players.filter("object_id = ''"), "object_id"))
    )
    boxed = players.filter("bbox_xyxy_px is not null")
    px, py = F.get("ground_contact_xy_px", F.lit(0)), F.get("ground_contact_xy_px", F.lit(1))
    yards_x, yards_y = F.get("ground_contact_xy_yards", F.lit(0)), F.get("ground_contact_xy_yards", F.lit(1))
    in_yards, in_pixels = F.col("ground_contact_xy_yards").isNotNull(), F.col("ground_contact_xy_px").isNotNull()
    if timeline is None:
        placed = boxed.withColumn("_status", F.when(in_yards, "reviewed_field_coordinate").when(in_pixels, "not_requested")).withColumn("_point", F.lit(None).cast("struct<x:double,y:double>"))
    else:
        found = calibration_at(boxed, timeline)
        corners = F.coalesce(F.size("fit.support_polygon"), F.lit(0))
        held = G.in_polygon(px, py, F.col("fit.support_polygon"))
        point = G.project(px, py, [F.col(f"fit.{m}") for m in G.MATRIX], G.matrix_usable("fit."))
        eligible = G.identity_eligible("fit.")
        status = (
            F.when(in_yards, "reviewed_field_coordinate").when(~in_pixels, none).when(F.col("fit").isNull(), "calibration_unavailable").when(~eligible, F.col("fit.status"))
            .when(corners < 3, "calibration_support_missing").when(~held, "outside_calibration_support").when(point.isNull(), "projection_invalid").otherwise("projected")
        )
        placed = found.withColumn("_status", status).withColumn("_point", F.when(F.col("_status") == "projected", point))
    objects = placed.select(
        *key, "object_id", *[F.get("bbox_xyxy_px", F.lit(i)).alias(c) for i, c in enumerate(G.BOX)], "team", "visibility", "occluded",
        F.when(in_yards, yards_x).otherwise(F.col("_point.x")).alias("contact_x"), F.when(in_yards, yards_y).otherwise(F.col("_point.y")).alias("contact_y"),
        F.when(in_yards | in_pixels, F.col("ground_contact_confidence")).alias("contact_confidence"), F.col("_status").alias("projection_status"),
    )
    seen = boxed.groupBy(*key).agg(F.min("pts").alias("_pts"))
    labels = frame_labels.select(
        "source_sha256", "shot_id", F.col("source_frame").alias("frame_index"), F.coalesce("labeled", F.lit(True)).alias("_labeled"), F.coalesce("ignore", F.lit(False)).alias("_ignore"), F.col("pts").alias("_label_pts")
    )
    frames = seen.join(labels, key, "full").select(
        *key, F.coalesce("_labeled", F.lit(True)).alias("labeled"), F.coalesce("_ignore", F.lit(False)).alias("ignore_frame"), F.coalesce("_label_pts", "_pts").alias("pts")
    )
    return {"frames": frames, "objects": objects, "identities": named, "conflicts": conflicts}
