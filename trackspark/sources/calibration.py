"""Calibration documents: static fits per shot and time-keyed timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.functions.geometry import MATRIX, finite
from trackspark.functions.scalars import FIT_STATUSES, short_hash

POINTS = "array<array<double>>"
FIT_DDL = (
    f"matrix {POINTS}, fit_error_px double, median_error_px double, max_error_px double, inlier_count int, point_count int, "
    "reprojection_threshold_px double, calibration_id string, median_error_yards double, max_error_yards double, "
    "withheld_median_error_yards double, withheld_p95_error_yards double, withheld_point_count int, status string, reason string, "
    "withheld_errors_yards array<double>, inlier_indices array<int>, outlier_indices array<int>"
)
LANDMARK_DDL = (
    f"image_points {POINTS}, field_points {POINTS}, withheld_image_points {POINTS}, withheld_field_points {POINTS}"
)
ENTRY_DDL = f"{FIT_DDL}, {LANDMARK_DDL}"


def _struct(ddl: str) -> str:
    """``a int, b string`` to ``struct<a:int,b:string>``."""
    fields = []
    depth, current = 0, ""
    for char in ddl:
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            fields.append(current.strip())
            current = ""
        else:
            current += char
    fields.append(current.strip())
    return "struct<" + ",".join(":".join(f.split(" ", 1)) for f in fields) + ">"


ENTRY = _struct(ENTRY_DDL)
KEYFRAME = _struct(
    f"keyframe_id string, pts_start bigint, pts_end bigint, status string, reason string, support_polygon_px {POINTS}, "
    f"reprojection_threshold_px double, homography {_struct(FIT_DDL)}, {LANDMARK_DDL}"
)
STATIC_DDL = f"schema_version int, source_sha256 string, shots map<string,{ENTRY}>, {ENTRY_DDL}"
TIMELINE_DDL = f"schema_version int, source_sha256 string, shots map<string,struct<keyframes:array<{KEYFRAME}>>>"


def read_documents(spark, paths: list[str]) -> DataFrame:
    """One row per JSON document: (file_path, value)."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value")


def normalised_matrix(matrix: Column) -> Column:
    """Nine values divided by the last one; null unless 3x3, finite and scaled."""
    flat = F.flatten(matrix)
    shaped = (F.size(matrix) == 3) & F.forall(matrix, lambda r: F.size(r) == 3) & F.forall(flat, lambda x: finite(x))
    scale = F.get(flat, F.lit(8))
    return F.when(shaped & (F.abs(scale) > 1e-12), F.transform(flat, lambda x: x / scale))


def _fit_columns(prefix: str, default_status: Column) -> list[Column]:
    c = lambda name: F.col(f"{prefix}.{name}")
    matrix = normalised_matrix(c("matrix"))
    return [
        *[F.get(matrix, F.lit(i)).alias(m) for i, m in enumerate(MATRIX)],
        F.coalesce(c("fit_error_px"), c("median_error_px")).alias("median_error_px"),
        c("max_error_px").alias("max_error_px"),
        F.coalesce(c("inlier_count"), F.lit(0)).alias("inlier_count"),
        F.coalesce(c("point_count"), F.lit(0)).alias("point_count"),
        F.coalesce(c("reprojection_threshold_px"), F.lit(3.0)).alias("reprojection_threshold_px"),
        c("median_error_yards").alias("median_error_yards"),
        c("max_error_yards").alias("max_error_yards"),
        c("withheld_median_error_yards").alias("withheld_median_error_yards"),
        c("withheld_p95_error_yards").alias("withheld_p95_error_yards"),
        F.coalesce(c("withheld_point_count"), F.lit(0)).alias("withheld_point_count"),
        F.coalesce(c("withheld_errors_yards"), F.array().cast("array<double>")).alias("withheld_errors_yards"),
        F.coalesce(c("inlier_indices"), F.array().cast("array<int>")).alias("inlier_indices"),
        F.coalesce(c("outlier_indices"), F.array().cast("array<int>")).alias("outlier_indices"),
        F.coalesce(c("status"), default_status).alias("status"),
    ]


def fit_violations() -> Column:
    """Names of the rules a serialized fit breaks."""
    indices = F.concat("inlier_indices", "outlier_indices")
    return F.array_compact(F.array(
        F.when(F.col("m00").isNull(), "matrix"),
        F.when((F.col("inlier_count") < 0) | (F.col("inlier_count") > F.col("point_count")), "point_counts"),
        F.when(F.col("reprojection_threshold_px") <= 0, "threshold"),
        F.when(~F.col("status").isin(*FIT_STATUSES), "status"),
        F.when((F.size("withheld_errors_yards") > 0) & (F.size("withheld_errors_yards") != F.col("withheld_point_count")), "withheld_count"),
        F.when(F.exists("withheld_errors_yards", lambda e: ~finite(e) | (e < 0)), "withheld_errors"),
        F.when(F.size(F.array_distinct(indices)) != F.size(indices), "indices_not_disjoint"),
        F.when(F.exists(indices, lambda i: (i < 0) | (i >= F.col("point_count"))), "index_range"),
        F.when((F.size("inlier_indices") > 0) & (F.size("inlier_indices") != F.col("inlier_count")), "inlier_indices_count"),
    ))


def _landmarks(rows: DataFrame, keys: list[str], entry: str) -> DataFrame:
    """Landmark pairs of entries without a matrix, in the shape the fit operator takes."""
    pair = lambda image, field, role: F.transform(
        F.arrays_zip(F.col(f"{entry}.{image}").alias("i"), F.col(f"{entry}.{field}").alias("f")),
        lambda p: F.struct(p["i"].alias("image"), p["f"].alias("field"), F.lit(role).alias("role")),
    )
    empty = F.array().cast("array<struct<image:array<double>,field:array<double>,role:string>>")
    both = F.concat(
        F.coalesce(pair("image_points", "field_points", "fit"), empty),
        F.coalesce(pair("withheld_image_points", "withheld_field_points", "withheld"), empty),
    )
    return rows.select(*keys, F.posexplode(both).alias("landmark_no", "_l")).select(
        *keys, "landmark_no", F.col("_l.role").alias("role"),
        F.get("_l.image", F.lit(0)).alias("image_x"), F.get("_l.image", F.lit(1)).alias("image_y"),
        F.get("_l.field", F.lit(0)).alias("field_x"), F.get("_l.field", F.lit(1)).alias("field_y"),
    )


def parse_static(docs: DataFrame) -> dict[str, DataFrame]:
    """Static calibrations: ``fits`` (serialized matrices with rule column) and ``landmarks`` to be fitted.

    A document without ``shots`` is one shared fit under ``*``.
    """
    parsed = docs.select("file_path", F.from_json("value", STATIC_DDL).alias("d"))
    own = F.struct(*[F.col(f"d.{name}") for name in _names(ENTRY_DDL)])
    entries = parsed.select(
        "file_path", F.col("d.source_sha256").alias("source_sha256"),
        F.explode(F.map_entries(F.coalesce("d.shots", F.create_map(F.lit("*"), own)))).alias("_e"),
    ).select("file_path", "source_sha256", F.col("_e.key").alias("shot_id"), F.col("_e.value").alias("entry"))
    serialized = entries.filter(F.col("entry.matrix").isNotNull() & F.col("entry.image_points").isNull())
    fits = serialized.select(
        "file_path", "source_sha256", "shot_id",
        F.coalesce("entry.calibration_id", F.lit("serialized-calibration")).alias("calibration_id"),
        *_fit_columns("entry", F.lit("unvalidated")), F.col("entry.reason").alias("reason"),
    )
    fits = fits.withColumn("broken", fit_violations())
    to_fit = entries.filter(F.col("entry.image_points").isNotNull())
    return {"fits": fits, "landmarks": _landmarks(to_fit, ["file_path", "source_sha256", "shot_id"], "entry")}


def parse_timeline(docs: DataFrame) -> dict[str, DataFrame]:
    """Time-keyed calibrations: ``keyframes`` with rule column, ``landmarks`` for keyframes without a matrix."""
    parsed = docs.select("file_path", F.from_json("value", TIMELINE_DDL).alias("d"))
    shots = parsed.select(
        "file_path", F.coalesce("d.schema_version", F.lit(1)).alias("schema_version"), F.col("d.source_sha256").alias("source_sha256"),
        F.explode(F.map_entries("d.shots")).alias("_e"),
    )
    frames = shots.select(
        "file_path", "schema_version", "source_sha256", F.col("_e.key").alias("shot_id"), F.posexplode("_e.value.keyframes").alias("key_no", "k")
    ).withColumn("keyframe_id", F.coalesce("k.keyframe_id", F.concat("shot_id", F.lit(":k"), F.col("key_no").cast("string"))))
    base = ["file_path", "source_sha256", "shot_id", "keyframe_id"]
    points = F.coalesce("k.support_polygon_px", F.array().cast(POINTS))
    rows = frames.filter(F.col("k.homography.matrix").isNotNull()).select(
        *base, "schema_version",
        F.coalesce("k.pts_start", F.lit(0).cast("bigint")).alias("pts_start"), F.col("k.pts_end").alias("pts_end"),
        *[c for c in _fit_columns("k.homography", F.coalesce("k.status", F.lit("unvalidated")))],
        F.coalesce("k.reason", "k.homography.reason").alias("reason"),
        F.col("k.status").alias("_declared"),
        F.coalesce("k.homography.calibration_id", F.concat(F.lit("serialized-"), "shot_id", F.lit("-"), F.col("key_no").cast("string"))).alias("homography_id"),
        F.transform(points, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))).alias("support_polygon"),
    )
    from trackspark.functions.geometry import identity_eligible

    rows = rows.withColumn("eligible", identity_eligible()).withColumn("status", F.coalesce("_declared", "status"))
    broken = F.array_compact(F.concat(fit_violations(), F.array(
        F.when((F.size("support_polygon") > 0) & (F.size("support_polygon") < 3), "support_polygon"),
        F.when(F.exists("support_polygon", lambda p: ~finite(p["x"], p["y"])), "support_polygon_finite"),
        F.when((F.col("schema_version") >= 2) & F.col("source_sha256").isNull(), "source_hash_missing"),
        F.when((F.col("status") == "valid") & ~F.col("eligible"), "valid_without_evidence"),
        F.when((F.col("pts_start") < 0) | (F.col("pts_end") <= F.col("pts_start")), "interval"),
    )))
    rows = rows.withColumn("broken", broken).drop("_declared", "schema_version")
    rows = rows.withColumn("calibration_id", short_hash(F.concat_ws(":", "shot_id", "keyframe_id", "homography_id")))
    to_fit = frames.filter(F.col("k.homography.matrix").isNull())
    return {"keyframes": rows, "landmarks": _landmarks(to_fit.withColumn("pts", F.col("k.pts_start")), [*base, "pts"], "k")}


def _names(ddl: str) -> list[str]:
    return [part.split(":", 1)[0] for part in _split(_struct(ddl)[7:-1])]


def _split(text: str) -> list[str]:
    out, depth, current = [], 0, ""
    for char in text:
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            out.append(current)
            current = ""
        else:
            current += char
    return [*out, current]
