"""Calibration: interval rules, lookups, projection, quality, fitting, propagation."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackspark.functions import geometry as G
from trackspark.functions.scalars import short_hash
from trackspark.session import cut_lineage
from trackspark.scale import adjacent_row, exact_quantiles, frame_bucket, interval_join, spread

PTS_BUCKET = 4_096_000
MEDIAN_GATE_YARDS = 1.0
P95_GATE_YARDS = 2.0
FIT_FIELDS = [
    *G.MATRIX, "inlier_count", "point_count", "median_error_px", "reprojection_threshold_px", "median_error_yards",
    "withheld_point_count", "withheld_p95_error_yards", "status",
]


def close_intervals(keyframes: DataFrame, key: str = "keyframe_id") -> DataFrame:
    """Open ends take the next start of the shot; ``broken`` names invalid or overlapping intervals."""
    ordered = [ "pts_start", key ]
    bucketed = keyframes.withColumn("_bucket", frame_bucket("pts_start", PTS_BUCKET))
    ahead = adjacent_row(bucketed, ["shot_id"], ordered, "_bucket", {"_next": "pts_start"}, following=True)
    filled = ahead.withColumn("pts_end", F.coalesce("pts_end", "_next")).drop("_next")
    behind = adjacent_row(filled, ["shot_id"], ordered, "_bucket", {"_previous_end": "pts_end"})
    broken = F.array_compact(F.array(
        F.when(~F.col("status").isin("valid", "unvalidated", "invalid", "partial"), "unsupported_status"),
        F.when((F.col("status") == "valid") & ~G.identity_eligible(), "valid_without_evidence"),
        F.when((F.col("pts_start") < 0) | (F.col("pts_end") <= F.col("pts_start")), "invalid_interval"),
        F.when(F.col("pts_start") < F.col("_previous_end"), "overlapping_interval"),
    ))
    return behind.withColumn("broken", broken).drop("_bucket", "_previous_end")


def as_fit(df: DataFrame, id_column: str, extra: list[str] | None = None) -> Column:
    """One struct holding everything a projection needs."""
    return F.struct(
        F.col(id_column).alias("calibration_id"), *[F.col(c) for c in FIT_FIELDS], *[F.col(c) for c in (extra or [])]
    )


def calibration_at(rows: DataFrame, timeline: DataFrame, shot_fits: DataFrame | None = None, extent: DataFrame | None = None) -> DataFrame:
    """Adds ``fit``: the timeline estimate holding the PTS, else the shot's fit, else the shared ``*`` fit of the row's source.

    timeline(shot_id, pts_start, pts_end, fit), shot_fits([source_id,] shot_id, fit). Without source_id in both tables
    there is one shared fit for all. More than one shared fit of a source raises: which one holds would be chance.
    """
    spans = timeline.select("shot_id", F.col("pts_start").alias("_s"), F.col("pts_end").alias("_e"), "fit")
    found = interval_join(rows, spans, ["shot_id"], "pts", "_s", "_e", PTS_BUCKET, how="left", extent=extent).drop("_s", "_e")
    if shot_fits is None:
        return found
    own = shot_fits.filter("shot_id <> '*'").select("shot_id", F.col("fit").alias("_own"))
    doubled = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("more than one shared fit"))).otherwise(F.first("fit"))
    keyed = "source_id" in shot_fits.columns and "source_id" in rows.columns
    source = F.col("source_id") if keyed else F.lit("")
    shared = shot_fits.filter("shot_id = '*'").groupBy(source.alias("_source")).agg(doubled.alias("_shared"))  # a row a source
    joined = found.join(own, "shot_id", "left").withColumn("_source", source).join(shared, "_source", "left")
    return joined.withColumn("fit", F.coalesce("fit", "_own", "_shared")).drop("_own", "_shared", "_source")


def project_rows(rows: DataFrame, pixel_uncertainty_px: float | None = None) -> DataFrame:
    """Field position of each row's ground contact through its ``fit`` struct.

    Uses fit.support_polygon and fit.reason when the struct carries them.
    """
    names = rows.schema["fit"].dataType.fieldNames()
    cx, cy = G.contact_x(), G.contact_y()
    matrix = [F.col(f"fit.{c}") for c in G.MATRIX]
    usable = G.matrix_usable("fit.")
    point = G.project(cx, cy, matrix, usable)
    if "support_polygon" in names:
        polygon = F.col("fit.support_polygon")
        outside = F.coalesce(F.size(polygon) > 0, F.lit(False)) & ~G.in_polygon(cx, cy, polygon)
    else:
        outside = F.lit(False)
    reason = F.col("fit.reason") if "reason" in names else F.lit(None).cast("string")
    uncertainty = F.when(G.identity_eligible("fit."), F.col("fit.withheld_p95_error_yards"))
    if pixel_uncertainty_px is not None:
        moved = G.projection_sensitivity(cx, cy, pixel_uncertainty_px, matrix, usable)
        uncertainty = F.when(moved.isNull(), uncertainty).otherwise(F.greatest(F.coalesce(uncertainty, F.lit(0.0)), moved))
    has_fit = F.col("fit").isNotNull()
    marked = rows.withColumn("_outside", has_fit & outside).withColumn("_point", F.when(has_fit & ~F.col("_outside"), point))
    placed = F.col("_point").isNotNull()
    return marked.select(
        *[c for c in rows.columns if c != "fit"],
        F.col("_point.x").alias("field_x"),
        F.col("_point.y").alias("field_y"),
        F.when(placed, "bottom_center").alias("position_source"),
        F.col("fit.calibration_id").alias("calibration_id"),
        F.when(F.col("_outside"), "invalid").otherwise(F.col("fit.status")).alias("calibration_status"),
        F.when(F.col("_outside"), "contact point lies outside calibration support")
        .when(placed, reason)
        .when(has_fit, F.coalesce(reason, F.lit("projection_invalid")))
        .alias("calibration_reason"),
        F.when(placed, uncertainty).alias("position_uncertainty_yards"),
    )


def quality_report(fits: DataFrame, errors: DataFrame, keys: list[str], sources: DataFrame | None = None) -> DataFrame:
    """Pooled withheld error per source: no errors means unvalidated (or invalid), never valid.

    fits(*keys, status, eligible), errors(*keys, error_yards). With ``fit_id`` in both and ``withheld_median_error_yards``
    in fits, a fit without errors of its own counts with that median. ``sources`` (keys) adds a ``not_provided`` row for
    every source without a fit.
    """
    per = fits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entries"),
        F.bool_and((F.col("status") == "valid") & F.col("eligible")).alias("_all_valid"),
        F.bool_or(F.col("status") == "invalid").alias("_any_invalid"),
    )
    errors = errors.filter("error_yards is not null")
    if "fit_id" in fits.columns and "fit_id" in errors.columns:
        bare = fits.join(errors.select(*keys, "fit_id").distinct(), [*keys, "fit_id"], "left_anti").filter("withheld_median_error_yards is not null")
        errors = errors.select(*keys, "error_yards").unionByName(bare.select(*keys, F.col("withheld_median_error_yards").alias("error_yards")))
    pooled = exact_quantiles(errors, keys, "error_yards", {"median_error_yards": 0.5, "p95_error_yards": 0.95})
    counts = errors.groupBy(*keys).agg(F.count(F.lit(1)).alias("withheld_point_count"))
    joined = per.join(pooled, keys, "left").join(counts, keys, "left")
    if sources is not None:
        joined = sources.select(*keys).distinct().join(joined, keys, "left")
    median_ok = F.col("median_error_yards") <= MEDIAN_GATE_YARDS
    p95_ok = F.col("p95_error_yards") <= P95_GATE_YARDS
    empty = F.col("withheld_point_count").isNull()
    none = F.lit(0).cast("bigint")
    return joined.select(
        *keys, F.coalesce("entries", none).alias("entries"),
        F.coalesce("withheld_point_count", none).alias("withheld_point_count"),
        "median_error_yards", "p95_error_yards",
        median_ok.alias("median_at_most_1_yard"), p95_ok.alias("p95_at_most_2_yards"),
        F.when(F.col("entries").isNull(), "not_provided").when(empty & F.col("_any_invalid"), "invalid").when(empty, "unvalidated")
        .when(F.col("_all_valid") & median_ok & p95_ok, "valid").otherwise("invalid").alias("status"),
    )


def status_rollup(status: str = "status") -> Column:
    """Aggregate: one status when all agree on valid/invalid, partial when mixed, else unvalidated."""
    value = F.col(status)
    total = F.count(F.lit(1))
    return (
        F.when(F.count_if(value == "valid") == total, "valid")
        .when(F.count_if(value == "invalid") == total, "invalid")
        .when((F.count_if(value.isin("partial", "invalid")) > 0) | (F.count_distinct(value) > 1), "partial")
        .otherwise("unvalidated")
    )


# --- fitting ---------------------------------------------------------------

FIT_SCHEMA = T.StructType(
    [T.StructField("shot_id", T.StringType()), T.StructField("pts", T.LongType())]
    + [T.StructField(m, T.DoubleType()) for m in G.MATRIX]
    + [
        T.StructField("fit_count", T.IntegerType()),
        T.StructField("inlier_indices", T.ArrayType(T.IntegerType())),
        T.StructField("outlier_indices", T.ArrayType(T.IntegerType())),
        T.StructField("errors_px", T.ArrayType(T.DoubleType())),
        T.StructField("errors_yards", T.ArrayType(T.DoubleType())),
        T.StructField("withheld_errors_yards", T.ArrayType(T.DoubleType())),
        T.StructField("support_polygon", T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))),
        T.StructField("failure", T.StringType()),
    ]
)


def _spread(points: np.ndarray) -> bool:
    centred = points - points.mean(axis=0)
    s = np.linalg.svd(centred, compute_uv=False)
    return bool(s[1] > 1e-8 and s[1] / max(s[0], 1e-12) > 1e-6)


def _normaliser(points: np.ndarray) -> np.ndarray:
    centre = points.mean(axis=0)
    scale = np.sqrt(2.0) / max(np.linalg.norm(points - centre, axis=1).mean(), 1e-12)
    return np.array([[scale, 0, -scale * centre[0]], [0, scale, -scale * centre[1]], [0, 0, 1.0]])


def _apply(matrix: np.ndarray, points: np.ndarray) -> np.ndarray:
    mapped = np.c_[points, np.ones(len(points))] @ matrix.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return mapped[:, :2] / mapped[:, 2:3]


def _direct_fit(source: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """Normalised direct linear transform."""
    ts, tt = _normaliser(source), _normaliser(target)
    a, b = _apply(ts, source), _apply(tt, target)
    zero, one = np.zeros(len(a)), np.ones(len(a))
    top = np.c_[a, one, zero, zero, zero, -b[:, 0] * a[:, 0], -b[:, 0] * a[:, 1], -b[:, 0]]
    low = np.c_[zero, zero, zero, a, one, -b[:, 1] * a[:, 0], -b[:, 1] * a[:, 1], -b[:, 1]]
    null = np.linalg.svd(np.r_[top, low])[2][-1].reshape(3, 3)
    matrix = np.linalg.inv(tt) @ null @ ts
    return None if abs(matrix[2, 2]) <= 1e-12 or not np.isfinite(matrix).all() else matrix / matrix[2, 2]


#: Candidates of a consensus fit that are solved together; a fit that takes in every point ends there.
FIT_CHUNK = 50


@lru_cache(maxsize=256)
def _picks(n: int, rounds: int, seed: int) -> np.ndarray:
    """The seeded draws of four of ``n`` points; every keyframe with as many points has the same."""
    rng = np.random.default_rng(seed)
    return np.array([rng.choice(n, 4, replace=False) for _ in range(rounds)])


def _spread_each(points: np.ndarray) -> np.ndarray:
    """``_spread`` of many point sets at once."""
    s = np.linalg.svd(points - points.mean(axis=1, keepdims=True), compute_uv=False)
    return (s[:, 1] > 1e-8) & (s[:, 1] / np.maximum(s[:, 0], 1e-12) > 1e-6)


def _normalisers(points: np.ndarray) -> np.ndarray:
    centre = points.mean(axis=1)
    scale = np.sqrt(2.0) / np.maximum(np.linalg.norm(points - centre[:, None, :], axis=2).mean(axis=1), 1e-12)
    out = np.zeros((len(points), 3, 3))
    out[:, 0, 0] = out[:, 1, 1] = scale
    out[:, 0, 2], out[:, 1, 2], out[:, 2, 2] = -scale * centre[:, 0], -scale * centre[:, 1], 1.0
    return out


def _direct_fits(source: np.ndarray, target: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """``_direct_fit`` of every pick whose points span a plane, in the order of the picks."""
    a, b = source[picks], target[picks]
    usable = _spread_each(a) & _spread_each(b)
    a, b = a[usable], b[usable]
    if not len(a):
        return np.empty((0, 3, 3))
    ts, tt = _normalisers(a), _normalisers(b)
    one = np.ones((*a.shape[:2], 1))
    mapped = lambda m, p: np.concatenate([p, one], axis=2) @ m.transpose(0, 2, 1)
    a, b = mapped(ts, a), mapped(tt, b)
    a, b = a[..., :2] / a[..., 2:3], b[..., :2] / b[..., 2:3]
    zero, x, y = np.zeros_like(one), b[..., :1], b[..., 1:2]
    top = np.concatenate([a, one, zero, zero, zero, -x * a[..., :1], -x * a[..., 1:2], -x], axis=2)
    low = np.concatenate([zero, zero, zero, a, one, -y * a[..., :1], -y * a[..., 1:2], -y], axis=2)
    null = np.linalg.svd(np.concatenate([top, low], axis=1))[2][:, -1].reshape(-1, 3, 3)
    matrices = np.linalg.inv(tt) @ null @ ts
    kept = (np.abs(matrices[:, 2, 2]) > 1e-12) & np.isfinite(matrices).all(axis=(1, 2))
    return matrices[kept] / matrices[kept][:, 2:3, 2:3]


def _robust_fit(source: np.ndarray, target: np.ndarray, threshold: float, rounds: int = 400, seed: int = 7):
    """Seeded consensus fit; threshold in units of ``target``."""
    best, best_score = None, (-1, 0.0)
    n = len(source)
    picks = np.arange(4)[None, :] if n == 4 else _picks(n, rounds, seed)
    for low in range(0, len(picks), FIT_CHUNK):
        candidates = _direct_fits(source, target, picks[low:low + FIT_CHUNK])
        if not len(candidates):
            continue
        homogeneous = np.c_[source, np.ones(n)] @ candidates.transpose(0, 2, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            errors = np.linalg.norm(homogeneous[..., :2] / homogeneous[..., 2:3] - target, axis=2)
        inside = np.nan_to_num(errors, nan=np.inf) <= threshold
        held = inside.sum(axis=1)
        for i in np.flatnonzero(held == held.max()) if held.max() >= best_score[0] else []:
            score = (int(held[i]), -float(errors[i][inside[i]].sum()))
            if score > best_score:
                best, best_score = inside[i], score
            if best_score[0] == n:
                break
        if best_score[0] == n:
            break
    if best is None or best.sum() < 4:
        return None, None
    refined = _direct_fit(source[best], target[best])
    if refined is None:
        return None, None
    again = np.nan_to_num(np.linalg.norm(_apply(refined, source) - target, axis=1), nan=np.inf) <= threshold
    return (refined, again) if again.sum() >= best.sum() else (refined, best)


def _hull(points: np.ndarray) -> list[tuple[float, float]]:
    ordered = sorted({(float(x), float(y)) for x, y in points})
    if len(ordered) < 3:
        return []

    def chain(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    hull = chain(ordered)[:-1] + chain(ordered[::-1])[:-1]
    return hull if len(hull) >= 3 else []


def _fit_keyframe(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("landmark_no")
    fit, held = pdf[pdf.role == "fit"], pdf[pdf.role == "withheld"]
    image, field = fit[["image_x", "image_y"]].to_numpy(float), fit[["field_x", "field_y"]].to_numpy(float)
    row: dict = {name: None for name in FIT_SCHEMA.fieldNames()}
    row.update(shot_id=pdf.shot_id.iloc[0], pts=int(pdf.pts.iloc[0]), fit_count=len(fit))
    threshold = float(pdf.threshold_px.iloc[0])
    if len(fit) < 4:
        row["failure"] = "needs four paired landmarks"
    elif not (np.isfinite(image).all() and np.isfinite(field).all()):
        row["failure"] = "landmarks must be finite"
    elif len(np.unique(image, axis=0)) < 4 or len(np.unique(field, axis=0)) < 4:
        row["failure"] = "needs four unique points"
    elif not (_spread(image) and _spread(field)):
        row["failure"] = "landmarks are collinear"
    else:
        forward, inside = _robust_fit(field, image, threshold)
        if forward is None or abs(np.linalg.det(forward)) < 1e-15:
            row["failure"] = "fewer than four inliers"
        else:
            back = np.linalg.inv(forward)
            back = back / back[2, 2]
            row.update({m: float(x) for m, x in zip(G.MATRIX, back.reshape(-1))})
            row["inlier_indices"] = [int(i) for i in np.flatnonzero(inside)]
            row["outlier_indices"] = [int(i) for i in np.flatnonzero(~inside)]
            row["errors_px"] = np.linalg.norm(_apply(forward, field) - image, axis=1).tolist()
            row["errors_yards"] = np.linalg.norm(_apply(back, image) - field, axis=1).tolist()
            hi, hf = held[["image_x", "image_y"]].to_numpy(float), held[["field_x", "field_y"]].to_numpy(float)
            row["withheld_errors_yards"] = np.linalg.norm(_apply(back, hi) - hf, axis=1).tolist() if len(held) else []
            row["support_polygon"] = [{"x": x, "y": y} for x, y in _hull(image)]
    return pd.DataFrame([row], columns=FIT_SCHEMA.fieldNames())


def fit_keyframes(landmarks: DataFrame, threshold_px: float = 3.0) -> DataFrame:
    """Robust fit per (shot, pts); a keyframe has tens of landmarks, so a group is small by nature.

    landmarks(shot_id, pts, landmark_no, role, image_x, image_y, field_x, field_y)
    """
    raw = spread(landmarks.withColumn("threshold_px", F.lit(threshold_px)), "shot_id", "pts").groupBy("shot_id", "pts").applyInPandas(_fit_keyframe, FIT_SCHEMA)
    sorted_at = lambda name, p: F.expr(
        f"CASE WHEN size({name}) > 0 THEN "
        f"element_at(array_sort({name}), cast(floor((size({name})-1)*{p}) as int)+1) + ((size({name})-1)*{p} - floor((size({name})-1)*{p})) * "
        f"(element_at(array_sort({name}), cast(least(floor((size({name})-1)*{p})+1, size({name})-1) as int)+1) - element_at(array_sort({name}), cast(floor((size({name})-1)*{p}) as int)+1)) END"
    )
    failed = F.col("failure").isNotNull()
    finite = F.forall("errors_px", lambda e: G.finite(e)) & F.forall("errors_yards", lambda e: G.finite(e))
    median, p95 = sorted_at("withheld_errors_yards", "0.5D"), sorted_at("withheld_errors_yards", "0.95D")
    out = raw.select(
        "shot_id", "pts", *G.MATRIX, "inlier_indices", "outlier_indices", "withheld_errors_yards", "support_polygon", "failure",
        F.size("inlier_indices").alias("inlier_count"), F.col("fit_count").alias("point_count"),
        F.lit(threshold_px).alias("reprojection_threshold_px"),
        sorted_at("errors_px", "0.5D").alias("median_error_px"), F.array_max("errors_px").alias("max_error_px"),
        sorted_at("errors_yards", "0.5D").alias("median_error_yards"), F.array_max("errors_yards").alias("max_error_yards"),
        F.greatest(F.coalesce(F.size("withheld_errors_yards"), F.lit(0)), F.lit(0)).alias("withheld_point_count"),
        median.alias("withheld_median_error_yards"), p95.alias("withheld_p95_error_yards"),
        F.when(failed, "invalid").when(~finite, "invalid")
        .when(F.size("withheld_errors_yards") == 0, "unvalidated")
        .when((median <= MEDIAN_GATE_YARDS) & (p95 <= P95_GATE_YARDS), "valid").otherwise("invalid").alias("status"),
        F.when(failed, F.col("failure")).when(~finite, "nonfinite reprojection error")
        .when(F.size("withheld_errors_yards") == 0, "no withheld landmarks supplied")
        .when(~((median <= MEDIAN_GATE_YARDS) & (p95 <= P95_GATE_YARDS)), "withheld landmark error exceeds calibration gate").alias("reason"),
    )
    digits = F.concat_ws(",", *[F.format_string("%.9f", F.col(m) + F.lit(0.0)) for m in G.MATRIX])
    return out.withColumn("calibration_id", F.when(F.col("m00").isNotNull(), F.concat(F.lit("homography-"), short_hash(digits))))


def timeline_from_landmarks(landmarks: DataFrame) -> DataFrame:
    """Reviewed landmarks to a timeline: one keyframe per (shot, pts), ended by the next one.

    Keyframes without four fit and one withheld landmark carry the rule they break.
    """
    counts = landmarks.groupBy("shot_id", "pts").agg(
        F.count_if(F.col("role") == "fit").alias("_fit"), F.count_if(F.col("role") == "withheld").alias("_held")
    )
    fits = fit_keyframes(landmarks).join(counts, ["shot_id", "pts"])
    short = (F.col("_fit") < 4) | (F.col("_held") < 1)
    keyed = fits.select(
        "*", F.col("pts").alias("pts_start"), F.lit(None).cast("bigint").alias("pts_end"),
        F.concat("shot_id", F.lit(":pts-"), F.col("pts").cast("string")).alias("keyframe_id"),
        F.when(short, "needs four fit and one withheld landmark").alias("rejected"),
    ).withColumn("status", F.when(G.identity_eligible(), "valid").otherwise("invalid"))
    closed = close_intervals(keyed)
    return closed.drop("_fit", "_held", "pts")


# --- propagation -----------------------------------------------------------

_CHAIN_SCHEMA = "keyframe_id string, block bigint, pts bigint, step array<double>, total array<double>"


def _block_products(pdf: pd.DataFrame) -> pd.DataFrame:
    """Running product of inverse motions inside one block of steps."""
    pdf = pdf.sort_values("pts")
    running, steps = np.eye(3), []
    for motion in pdf.motion:
        running = running @ np.linalg.inv(np.asarray(motion, float).reshape(3, 3))
        running = running / running[2, 2]
        steps.append(running.reshape(-1).tolist())
    return pd.DataFrame({
        "keyframe_id": pdf.keyframe_id, "block": pdf.block, "pts": pdf.pts, "step": steps, "total": [running.reshape(-1).tolist()] * len(pdf),
    })


def _chain_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("block")
    running, entries = np.eye(3), []
    for total in pdf.total:
        entries.append(running.reshape(-1).tolist())
        running = running @ np.asarray(total, float).reshape(3, 3)
        running = running / running[2, 2]
    return pd.DataFrame({"keyframe_id": pdf.keyframe_id, "block": pdf.block, "entry": entries})


def _matmul(a: str, b: str) -> Column:
    cell = lambda r, c: sum(
        (F.get(F.col(a), F.lit(r * 3 + k)) * F.get(F.col(b), F.lit(k * 3 + c)) for k in range(1, 3)),
        F.get(F.col(a), F.lit(r * 3)) * F.get(F.col(b), F.lit(c)),
    )
    return F.array(*[cell(r, c) for r in range(3) for c in range(3)])


def _adjugate(name: str) -> Column:
    g = lambda i: F.get(F.col(name), F.lit(i))
    minor = lambda a, b, c, d: g(a) * g(b) - g(c) * g(d)
    return F.array(
        minor(4, 8, 5, 7), minor(2, 7, 1, 8), minor(1, 5, 2, 4),
        minor(5, 6, 3, 8), minor(0, 8, 2, 6), minor(2, 3, 0, 5),
        minor(3, 7, 4, 6), minor(1, 6, 0, 7), minor(0, 4, 1, 3),
    )


def propagate_timeline(timeline: DataFrame, motions: DataFrame, max_gap_pts: int, block_pts: int = PTS_BUCKET) -> DataFrame:
    """Carry keyframes across motion steps; a gap over ``max_gap_pts`` ends support with a bounded tail.

    Matrix products are associative, so blocks of steps multiply in parallel
    and only block totals are chained per keyframe.

    timeline(shot_id, keyframe_id, pts_start, pts_end, matrix array<double>, support_polygon),
    motions(shot_id, pts, motion array<double>) with previous-to-current image motion.
    """
    spans = timeline.select("shot_id", "keyframe_id", (F.col("pts_start") + 1).alias("_s"), F.col("pts_start").alias("_first"), F.col("pts_end").alias("_e"))
    steps = interval_join(motions, spans, ["shot_id"], "pts", "_s", "_e", PTS_BUCKET)
    steps = steps.withColumn("block", frame_bucket("pts", block_pts))
    near = adjacent_row(steps, ["keyframe_id"], ["pts"], "block", {"_before": "pts"})
    gaps = near.withColumn("_gap", F.col("pts") - F.coalesce("_before", "_first"))
    stop = gaps.filter(F.col("_gap") > max_gap_pts).groupBy("keyframe_id").agg(F.min("pts").alias("_stop"))
    taken = gaps.join(stop, "keyframe_id", "left").filter(F.col("_stop").isNull() | (F.col("pts") < F.col("_stop")))
    products = spread(taken.select("keyframe_id", "block", "pts", "motion"), "keyframe_id", "block").groupBy("keyframe_id", "block").applyInPandas(_block_products, _CHAIN_SCHEMA)
    products = cut_lineage(products)  # read by the chain of totals and by the steps
    totals = products.groupBy("keyframe_id", "block").agg(F.first("total").alias("total"))
    entries = totals.groupBy("keyframe_id").applyInPandas(_chain_blocks, "keyframe_id string, block bigint, entry array<double>")
    moved = products.join(entries, ["keyframe_id", "block"]).select("keyframe_id", "pts", _matmul("entry", "step").alias("_m"))
    identity = F.array(*[F.lit(float(r == c)) for r in range(3) for c in range(3)])
    starts = timeline.select("keyframe_id", F.col("pts_start").alias("pts"), identity.alias("_m"), F.lit(True).alias("_is_start"))
    nodes = moved.withColumn("_is_start", F.lit(False)).unionByName(starts).withColumn("_bucket", frame_bucket("pts", block_pts))
    ahead = adjacent_row(nodes, ["keyframe_id"], ["pts"], "_bucket", {"_next": "pts"}, following=True)
    base = timeline.select(
        "shot_id", "keyframe_id", F.col("pts_end").alias("_end"), F.col("matrix").alias("_h"), "support_polygon"
    ).join(stop, "keyframe_id", "left")
    joined = ahead.join(base, "keyframe_id")
    stopped = F.col("_next").isNull() & F.col("_stop").isNotNull()
    tail = F.least(F.col("pts") + max_gap_pts, F.coalesce("_end", F.col("pts") + max_gap_pts))
    untouched = F.col("_is_start") & F.col("_next").isNull() & F.col("_stop").isNull()
    shifted = joined.withColumn("_hm", _matmul("_h", "_m")).withColumn("_forward", _adjugate("_m"))
    f = lambda i: F.get(F.col("_forward"), F.lit(i))
    polygon = F.transform(
        "support_polygon",
        lambda p: F.struct(
            F.try_divide(f(0) * p["x"] + f(1) * p["y"] + f(2), f(6) * p["x"] + f(7) * p["y"] + f(8)).alias("x"),
            F.try_divide(f(3) * p["x"] + f(4) * p["y"] + f(5), f(6) * p["x"] + f(7) * p["y"] + f(8)).alias("y"),
        ),
    )
    scale = F.get(F.col("_hm"), F.lit(8))
    return shifted.select(
        "shot_id", "keyframe_id",
        F.when(untouched, F.col("keyframe_id"))
        .when(stopped, F.concat("keyframe_id", F.lit(":bounded-"), F.col("pts").cast("string")))
        .otherwise(F.concat("keyframe_id", F.lit(":prop-"), F.col("pts").cast("string"))).alias("calibration_id"),
        F.col("pts").alias("pts_start"),
        F.when(stopped, tail).otherwise(F.coalesce("_next", "_end")).alias("pts_end"),
        F.transform("_hm", lambda x: x / scale).alias("matrix"),
        F.when(F.forall(polygon, lambda p: G.finite(p["x"], p["y"])), polygon)
        .otherwise(F.array().cast("array<struct<x:double,y:double>>")).alias("support_polygon"),
    ).filter(F.col("pts_end").isNull() | (F.col("pts_end") > F.col("pts_start")))
