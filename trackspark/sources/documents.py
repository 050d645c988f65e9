"""Reviewed JSON documents: alignments, references, cues, manifests, task maps, small dimensions.

Each ``parse_*`` takes documents(file_path, value) of many games and returns
child tables; records that break a rule carry or go to a rule column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.functions.geometry import finite
from trackspark.functions.field import on_field
from trackspark.scale import adjacent_row, frame_bucket
from trackspark.session import cut_lineage

REVIEW_STATUSES = ("unreviewed", "reviewed", "accepted", "rejected")


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value")


def _parse(docs: DataFrame, ddl: str) -> DataFrame:
    return docs.select("file_path", F.from_json("value", ddl).alias("d"))


# --- play alignments -------------------------------------------------------

POINT = "struct<shot_id:string,source_pts:bigint,play_time_s:double,event:string>"
PLAY = (
    "struct<reviewed:boolean,source_sha256:string,play_id:string,"
    "anchors:array<struct<shot_id:string,source_frame:bigint,source_pts:bigint,play_time_s:double,event:string>>,"
    f"correspondences:array<{POINT}>,validation_correspondences:array<{POINT}>,shot_ranges:map<string,array<bigint>>,max_residual_ms:double>"
)
ALIGNMENT = f"reviewed boolean, source_sha256 string, plays array<{PLAY}>, play_id string, " + ", ".join(
    [
        "anchors array<struct<shot_id:string,source_frame:bigint,source_pts:bigint,play_time_s:double,event:string>>",
        f"correspondences array<{POINT}>", f"validation_correspondences array<{POINT}>", "shot_ranges map<string,array<bigint>>", "max_residual_ms double",
    ]
)


def parse_alignments(docs: DataFrame) -> dict[str, DataFrame]:
    """``plays``, ``anchors``, ``correspondences`` (anchors with PTS and time included), ``checks``, ``ranges``.

    A list of plays inherits the document's hash; a single play is its own list.
    Unreviewed documents yield no plays but a reject row.
    """
    d = lambda name: F.col(f"d.{name}")
    parsed = _parse(docs, ALIGNMENT)
    single = F.struct(*[d(n).alias(n) for n in (
        "reviewed", "source_sha256", "play_id", "anchors", "correspondences", "validation_correspondences", "shot_ranges", "max_residual_ms")])
    reviewed = parsed.filter(F.coalesce(d("reviewed"), F.lit(False)))
    plays = reviewed.select("file_path", d("source_sha256").alias("_hash"), F.explode(F.coalesce(d("plays"), F.array(single))).alias("p")).select(
        "file_path", F.coalesce("p.source_sha256", "_hash").alias("source_sha256"), F.col("p.play_id").alias("play_id"),
        F.coalesce("p.max_residual_ms", F.lit(50.0)).alias("max_residual_ms"), "p",
    )
    keys = ["file_path", "play_id"]
    anchors = plays.select(*keys, F.explode("p.anchors").alias("a")).select(
        *keys, "a.shot_id", "a.source_frame", "a.source_pts", F.col("a.play_time_s").alias("anchor_s"), F.coalesce("a.event", F.lit("snap")).alias("event")
    )
    points = lambda field: plays.select(*keys, F.explode(f"p.{field}").alias("c")).select(
        *keys, "c.shot_id", F.col("c.source_pts").alias("pts"), "c.play_time_s", "c.event"
    )
    from_anchors = anchors.filter("source_pts is not null and anchor_s is not null").select(
        *keys, "shot_id", F.col("source_pts").alias("pts"), F.col("anchor_s").alias("play_time_s"), "event"
    )
    ranges = plays.select(*keys, F.explode(F.map_entries("p.shot_ranges")).alias("r")).select(
        *keys, F.col("r.key").alias("shot_id"), F.get("r.value", F.lit(0)).alias("start_frame"), F.get("r.value", F.lit(1)).alias("end_frame")
    )
    rejects = parsed.filter(~F.coalesce(d("reviewed"), F.lit(False))).select("file_path", F.lit("not_reviewed").alias("rule"))
    return {
        "plays": plays.drop("p"), "anchors": anchors, "correspondences": from_anchors.unionByName(points("correspondences")),
        "checks": points("validation_correspondences"), "ranges": ranges, "rejects": rejects,
    }


# --- reviewed references ---------------------------------------------------

OBJECT = (
    "struct<id:string,bbox_xyxy:array<double>,ground_contact_xy_yards:array<double>,ground_contact_confidence:double,contact_confidence:double,team:string>"
)
REFERENCE = (
    f"reviewed boolean, source_sha256 string, sequences map<string,struct<frames:map<string,struct<labeled:boolean,ignore:boolean,pts:bigint,objects:array<{OBJECT}>>>>>, "
    "cross_shot_identity map<string,map<string,string>>"
)


def parse_references(docs: DataFrame) -> dict[str, DataFrame]:
    """``frames``, ``objects`` and ``rejects`` of reviewed references; evaluator frame is source frame + 1."""
    parsed = _parse(docs, REFERENCE)
    ok = F.coalesce(F.col("d.reviewed"), F.lit(False))
    reviewed = parsed.filter(ok).select("file_path", F.col("d.source_sha256").alias("source_sha256"), F.explode(F.map_entries("d.sequences")).alias("s"))
    raw = cut_lineage(reviewed.select("file_path", "source_sha256", F.col("s.key").alias("shot_id"), F.explode(F.map_entries("s.value.frames")).alias("f")).select(
        "file_path", "source_sha256", "shot_id", F.col("f.key").try_cast("bigint").alias("frame_index"), F.col("f.value").alias("v")
    ))  # documents are parsed once
    frames = raw.filter("frame_index >= 0").select(
        "file_path", "source_sha256", "shot_id", "frame_index", (F.col("frame_index") + 1).alias("evaluator_frame"),
        F.coalesce("v.labeled", F.lit(False)).alias("labeled"), F.coalesce("v.ignore", F.lit(False)).alias("ignore_frame"), F.col("v.pts").alias("pts"),
    )
    objects = raw.filter("frame_index >= 0").select("file_path", "shot_id", "frame_index", F.explode("v.objects").alias("o")).select(
        "file_path", "shot_id", "frame_index", F.trim("o.id").alias("object_id"),
        *[F.get("o.bbox_xyxy", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))], F.size("o.bbox_xyxy").alias("_size"),
        F.get("o.ground_contact_xy_yards", F.lit(0)).alias("contact_x"), F.get("o.ground_contact_xy_yards", F.lit(1)).alias("contact_y"),
        F.coalesce("o.ground_contact_confidence", "o.contact_confidence").alias("contact_confidence"), F.col("o.team").alias("team"),
    )
    box = finite("x1", "y1", "x2", "y2") & (F.col("_size") == 4) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    held = F.col("contact_x").isNotNull() | F.col("contact_y").isNotNull()
    rule = (
        F.when(F.coalesce("object_id", F.lit("")) == "", "object_id").when(~box, "box")
        .when(held & ~on_field(F.col("contact_x"), F.col("contact_y")), "ground_contact")
        .when(F.trim("team") == "", "team")
        .when(F.col("contact_confidence").isNotNull() & (~held | ~F.col("contact_confidence").between(0, 1)), "contact_confidence")
    )
    marked = objects.withColumn("rule", rule).drop("_size")
    repeats = cut_lineage(marked.groupBy("file_path", "shot_id", "frame_index", "object_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    place = ["file_path", "shot_id", "frame_index"]
    near = adjacent_row(
        frames.filter("pts is not null").withColumn("_bucket", frame_bucket("frame_index")), ["file_path", "shot_id"], ["frame_index"], "_bucket", {"_before": "pts"}
    )
    rejects = (
        marked.filter("rule is not null").select(*place, "object_id", "rule")
        .unionByName(repeats.select(*place, "object_id", F.lit("duplicate_object").alias("rule")))
        .unionByName(near.filter("pts <= _before").select(*place, F.lit(None).cast("string").alias("object_id"), F.lit("pts_not_increasing").alias("rule")))
        .unionByName(raw.filter("frame_index is null or frame_index < 0").select(*place, F.lit(None).cast("string").alias("object_id"), F.lit("frame_key").alias("rule")))
        .unionByName(parsed.filter(~ok).select("file_path", F.lit(None).cast("string").alias("shot_id"), F.lit(None).cast("bigint").alias("frame_index"), F.lit(None).cast("string").alias("object_id"), F.lit("not_reviewed").alias("rule")))
    )
    clean = marked.filter("rule is null").drop("rule").join(repeats.drop("n"), [*place, "object_id"], "left_anti")
    return {"frames": frames, "objects": clean, "rejects": rejects}


def parse_global_identity(docs: DataFrame) -> dict[str, DataFrame]:
    """``identities`` (shot, object, player), ``documents`` with whether a map was declared, ``rejects`` for blanks."""
    parsed = _parse(docs, REFERENCE).filter(F.coalesce(F.col("d.reviewed"), F.lit(False)))
    pairs = parsed.select("file_path", F.explode(F.map_entries("d.cross_shot_identity")).alias("s")).select(
        "file_path", F.col("s.key").alias("shot_id"), F.explode(F.map_entries("s.value")).alias("m")
    ).select("file_path", "shot_id", F.col("m.key").alias("object_id"), F.col("m.value").alias("global_id"))
    blank = (F.trim("object_id") == "") | (F.trim(F.coalesce("global_id", F.lit(""))) == "")
    return {
        "identities": pairs.filter(~blank),
        "documents": parsed.select("file_path", F.col("d.cross_shot_identity").isNotNull().alias("declared")),
        "rejects": pairs.filter(blank).withColumn("rule", F.lit("blank_id")),
    }


# --- identity cues ---------------------------------------------------------

QUALITY = ("crop_width_px", "crop_height_px", "bbox_height_px", "detection_score", "laplacian_variance")
READ = (
    "struct<source_frame:bigint,source_pts:bigint,bbox_xyxy_px:array<double>,review_status:string,accepted_number:int,model:string,"
    f"crop_quality:struct<{','.join(f'{q}:double' for q in QUALITY)}>,candidates:array<struct<number:int,confidence:double>>>"
)
EMBEDDING = (
    "struct<source_frame:bigint,source_pts:bigint,bbox_xyxy_px:array<double>,review_status:string,model:string,crop_quality_score:double,vector:array<double>>"
)
CUES = f"schema_version int, source_sha256 string, analysis_hash string, tracklets map<string,struct<jersey_reads:array<{READ}>,appearance_embeddings:array<{EMBEDDING}>>>"


def parse_cues(docs: DataFrame) -> dict[str, DataFrame]:
    """``reads``, ``candidates`` (ranked), ``embeddings`` and ``rejects``; a file needs version 1 and a 16-hex analysis hash."""
    parsed = _parse(docs, CUES)
    file_rule = F.when(~F.col("d.schema_version").eqNullSafe(F.lit(1)), "schema_version").when(
        ~F.lower(F.coalesce("d.analysis_hash", F.lit(""))).rlike("^[0-9a-f]{16}$"), "analysis_hash"
    )
    files = parsed.withColumn("rule", file_rule)
    tracks = files.filter("rule is null").select("file_path", F.col("d.source_sha256").alias("source_sha256"), F.explode(F.map_entries("d.tracklets")).alias("t"))
    base = ["file_path", "source_sha256", "tracklet_id"]
    boxes = lambda p: [F.get(f"{p}.bbox_xyxy_px", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    place = lambda p: [f"{p}.source_frame", f"{p}.source_pts", *boxes(p), F.coalesce(f"{p}.review_status", F.lit("unreviewed")).alias("review_status")]
    reads = tracks.select("file_path", "source_sha256", F.trim("t.key").alias("tracklet_id"), F.explode("t.value.jersey_reads").alias("r")).select(
        *base, *place("r"), "r.accepted_number", F.coalesce("r.model", F.lit("unknown")).alias("model"), *[F.col(f"r.crop_quality.{q}").alias(q) for q in QUALITY], "r.candidates"
    )
    ok_place = (F.col("source_frame") >= 0) & (F.col("source_pts") >= 0) & finite("x1", "y1", "x2", "y2") & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & F.col("review_status").isin(*REVIEW_STATUSES)
    bad_candidate = F.exists("candidates", lambda c: ~F.coalesce(c["number"].between(0, 99) & finite(c["confidence"]) & c["confidence"].between(0.0, 1.0), F.lit(False)))
    bad_quality = F.lit(False)
    for q in QUALITY:
        over = (F.col(q) > 1.0) if q == "detection_score" else F.lit(False)
        bad_quality = bad_quality | (F.col(q).isNotNull() & (~finite(q) | (F.col(q) < 0) | over))
    reads = reads.withColumn("rule", (
        F.when(~F.coalesce(ok_place, F.lit(False)), "metadata").when(F.col("accepted_number").isNotNull() & ~F.col("accepted_number").between(0, 99), "accepted_number")
        .when(bad_candidate, "candidate").when(bad_quality, "crop_quality")
    ))
    embeddings = tracks.select("file_path", "source_sha256", F.trim("t.key").alias("tracklet_id"), F.explode("t.value.appearance_embeddings").alias("e")).select(
        *base, *place("e"), F.trim(F.coalesce("e.model", F.lit(""))).alias("model"), F.coalesce("e.crop_quality_score", F.lit(-1.0)).alias("crop_quality_score"), "e.vector"
    )
    ok_vector = (F.size("vector") > 0) & F.forall("vector", lambda x: finite(x)) & (F.col("model") != "") & F.col("crop_quality_score").between(0.0, 1.0)
    embeddings = embeddings.withColumn("rule", F.when(~F.coalesce(ok_place & ok_vector, F.lit(False)), "metadata"))
    twice = lambda df: df.groupBy("file_path", "tracklet_id", "source_frame").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    read_twice, embed_twice = twice(reads), twice(embeddings)
    key = ["file_path", "tracklet_id", "source_frame"]
    reject = lambda df, kind: df.select(*key, F.lit(kind).alias("kind"), "rule")
    rejects = (
        reject(reads.filter("rule is not null"), "jersey").unionByName(reject(embeddings.filter("rule is not null"), "embedding"))
        .unionByName(reject(read_twice.withColumn("rule", F.lit("duplicate")), "jersey")).unionByName(reject(embed_twice.withColumn("rule", F.lit("duplicate")), "embedding"))
        .unionByName(files.filter("rule is not null").select("file_path", F.lit(None).cast("string").alias("tracklet_id"), F.lit(None).cast("bigint").alias("source_frame"), F.lit("file").alias("kind"), "rule"))
    )
    clean = reads.filter("rule is null").join(read_twice, key, "left_anti")
    ranked = F.array_sort("candidates", lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise((a["number"] - b["number"]).cast("int")))
    candidates = clean.select(*base, "source_frame", "review_status", F.posexplode(ranked).alias("rank", "c")).select(*base, "source_frame", "review_status", "rank", "c.number", "c.confidence")
    return {
        "reads": clean.drop("rule", "candidates"), "candidates": candidates, "embeddings": embeddings.filter("rule is null").join(embed_twice, key, "left_anti").drop("rule"), "rejects": rejects,
    }


# --- small dimensions ------------------------------------------------------

def parse_splits(docs: DataFrame) -> DataFrame:
    """Reviewed tracklet splits; a missing segment id is numbered by position."""
    ddl = "reviewed boolean, source_sha256 string, splits map<string,array<struct<segment_id:string,start_frame:bigint,end_frame:bigint>>>"
    parsed = _parse(docs, ddl).filter(F.coalesce(F.col("d.reviewed"), F.lit(False)))
    rows = parsed.select("file_path", F.col("d.source_sha256").alias("source_sha256"), F.explode(F.map_entries("d.splits")).alias("s")).select(
        "file_path", "source_sha256", F.col("s.key").alias("tracklet_id"), F.posexplode("s.value").alias("segment_no", "g")
    )
    return rows.select(
        "file_path", "source_sha256", "tracklet_id",
        F.coalesce("g.segment_id", F.concat("tracklet_id", F.lit(":segment-"), F.col("segment_no").cast("string"))).alias("segment_id"), "g.start_frame", "g.end_frame",
    )


def parse_prototypes(docs: DataFrame) -> DataFrame:
    """Team prototypes with a rule column for anything but three channels in [0, 1]."""
    rows = docs.select("file_path", F.explode(F.map_entries(F.from_json("value", "map<string,array<double>>"))).alias("t"))
    ok = (F.size("t.value") == 3) & F.forall("t.value", lambda x: finite(x) & x.between(0.0, 1.0))
    return rows.select("file_path", F.col("t.key").alias("team"), *[F.get("t.value", F.lit(i)).alias(c) for i, c in enumerate("rgb")], F.when(~F.coalesce(ok, F.lit(False)), "rgb_triple").alias("rule"))


def parse_class_mapping(docs: DataFrame) -> DataFrame:
    rows = docs.select("file_path", F.explode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("m"))
    return rows.select("file_path", F.col("m.key").alias("class_id"), F.col("m.value").alias("class_name"))


# --- task frame maps -------------------------------------------------------

TASK_MAP = (
    "schema_version int, source struct<sha256:string,width:int,height:int,frame_count:bigint,time_base:array<bigint>>, "
    "frames array<struct<task_frame:bigint,source_frame:bigint,source_pts:bigint,task_width:int,task_height:int,crop_xyxy_px:array<double>>>"
)


def parse_task_maps(docs: DataFrame) -> dict[str, DataFrame]:
    """``frames`` of task maps and (file_path, rule) ``violations``."""
    parsed = _parse(docs, TASK_MAP)
    rows = parsed.select("file_path", F.col("d.source").alias("s"), F.posexplode("d.frames").alias("position", "f")).select(
        "file_path", F.col("s.sha256").alias("source_sha256"), F.col("s.width").alias("source_width"), F.col("s.height").alias("source_height"),
        F.col("s.frame_count").alias("source_frame_count"), F.col("position").cast("bigint").alias("position"), "f.task_frame", "f.source_frame", "f.source_pts", "f.task_width", "f.task_height",
        *[F.get("f.crop_xyxy_px", F.lit(i)).alias(c) for i, c in enumerate(("cx1", "cy1", "cx2", "cy2"))],
    )
    return {"frames": rows, "violations": task_map_violations(rows).unionByName(
        parsed.filter(~F.coalesce(F.col("d.source.sha256"), F.lit("")).rlike("^[0-9a-fA-F]{64}$")).select("file_path", F.lit("source_sha256").alias("rule"))
    )}


def task_map_violations(rows: DataFrame) -> DataFrame:
    near = adjacent_row(rows.withColumn("_bucket", frame_bucket("position")), ["file_path"], ["position"], "_bucket", {"_frame": "source_frame", "_pts": "source_pts"})
    crop = (F.col("cx1") >= 0) & (F.col("cy1") >= 0) & (F.col("cx2") > F.col("cx1")) & (F.col("cy2") > F.col("cy1")) & (F.col("cx2") <= F.col("source_width")) & (F.col("cy2") <= F.col("source_height"))
    rules = F.array_compact(F.array(
        F.when(F.col("task_frame") != F.col("position"), "task_frame_not_dense"),
        F.when(F.col("source_frame") >= F.col("source_frame_count"), "source_frame_outside_video"),
        F.when(F.col("source_frame") <= F.col("_frame"), "source_frame_not_increasing"),
        F.when(F.col("source_pts") <= F.col("_pts"), "source_pts_not_increasing"),
        F.when(~F.coalesce(crop, F.lit(False)), "crop_outside_image"),
        F.when((F.col("task_width") <= 0) | (F.col("task_height") <= 0), "task_size"),
    ))
    sizes = rows.groupBy("file_path").agg(F.count_distinct("task_width", "task_height").alias("n")).filter("n > 1").select("file_path", F.lit("task_sizes_differ").alias("rule"))
    return near.select("file_path", F.explode(rules).alias("rule")).distinct().unionByName(sizes)


def build_task_map(index: DataFrame, windows: DataFrame) -> DataFrame:
    """Dense task frames over ``[start_frame, end_frame)`` of a frame index, with crop and task size.

    index(source_id, frame_index, pts), windows(source_id, start_frame, end_frame, source_width, source_height,
    cx1..cy2 or null, task_width, task_height or null); ``complete`` is false when a frame has no PTS.
    """
    from trackspark.scale import interval_join, positions, FRAME_BUCKET

    spans = windows.withColumnRenamed("start_frame", "_s").withColumnRenamed("end_frame", "_e")
    rows = interval_join(index.filter("pts is not null"), spans, ["source_id"], "frame_index", "_s", "_e", FRAME_BUCKET)
    placed = positions(rows.withColumn("_bucket", frame_bucket("frame_index")), ["source_id"], ["frame_index"], "_bucket", "task_frame")
    counts = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n"))
    cx1, cy1 = F.coalesce("cx1", F.lit(0.0)), F.coalesce("cy1", F.lit(0.0))
    cx2, cy2 = F.coalesce("cx2", F.col("source_width").cast("double")), F.coalesce("cy2", F.col("source_height").cast("double"))
    return placed.join(counts, "source_id").select(
        "source_id", "task_frame", F.col("frame_index").alias("source_frame"), F.col("pts").alias("source_pts"), cx1.alias("cx1"), cy1.alias("cy1"), cx2.alias("cx2"), cy2.alias("cy2"),
        F.coalesce("task_width", F.greatest(F.lit(1), F.rint(cx2 - cx1).cast("int"))).alias("task_width"),
        F.coalesce("task_height", F.greatest(F.lit(1), F.rint(cy2 - cy1).cast("int"))).alias("task_height"),
        (F.col("_n") == F.col("_e") - F.col("_s")).alias("complete"),
    )
