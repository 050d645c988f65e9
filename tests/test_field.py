"""Calibration, timing, teams, review picks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackspark.functions import geometry as G
from trackspark.functions.field import HASH_FAR_YARDS, HASH_NEAR_YARDS, FIELD_WIDTH_YARDS, landmark_point
from trackspark.operators import calibrate as CAL
from trackspark.operators import review as RV
from trackspark.operators import teams as TE
from trackspark.operators import timing as TM


def test_landmarks(spark):
    cases = {
        "yardline:20:sideline:near": (20.0, 0.0), "yardline:20:hash:far": (20.0, HASH_FAR_YARDS), "goal_line:west:hash:near": (10.0, HASH_NEAR_YARDS), "end_line:east:sideline:far": (120.0, FIELD_WIDTH_YARDS),
        "goal:line:left:sideline:near": (10.0, 0.0), "yardline:20:middle": None, "yardline:130:sideline:near": None, "goal_line:north:hash:near": None, "yardline:20": None, "": None, "yardline:x:sideline:near": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "id string").withColumn("p", landmark_point(F.col("id")))
    got = {r.id: (r.p.x, r.p.y) if r.p else None for r in df.collect()}
    assert got == cases


def test_polygon_edges_and_corners_are_inside(spark):
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    points = {(2.0, 2.0): True, (0.0, 0.0): True, (4.0, 2.0): True, (4.1, 2.0): False, (-1.0, 0.0): False, (2.0, 4.0): True}
    df = spark.createDataFrame([(float(x), float(y)) for x, y in points], "x double, y double").withColumn("i", G.in_polygon(F.col("x"), F.col("y"), square))
    assert {(r.x, r.y): r.i for r in df.collect()} == points


TRUE = np.array([[0.11, 0.02, 3.0], [0.004, 0.13, 2.0], [0.0, 0.0009, 1.0]])


def landmark_rows(shot, pts, noise=0.0, outlier=None):
    rows = []
    for i, (x, y) in enumerate([(40, 40), (500, 60), (80, 300), (520, 310), (250, 180), (330, 90), (150, 240), (420, 260)]):
        f = TRUE @ np.array([x, y, 1.0])
        fx, fy = f[:2] / f[2]
        shift = 60.0 if i == outlier else noise * ((i % 3) - 1)
        rows.append((shot, pts, i, "withheld" if i in (4, 5) else "fit", float(x + shift), float(y), float(fx), float(fy)))
    return rows


LANDMARK = "shot_id string, pts bigint, landmark_no int, role string, image_x double, image_y double, field_x double, field_y double"


def test_fit_recovers_a_known_matrix_and_names_outliers(spark):
    rows = landmark_rows("exact", 0) + landmark_rows("odd", 0, outlier=6) + [("few", 0, i, "fit", float(i), float(i * i), float(i), float(i)) for i in range(3)] + [("line", 0, i, "fit", float(i), float(i), float(i), 2.0) for i in range(5)]
    got = {r.shot_id: r for r in CAL.fit_keyframes(spark.createDataFrame(rows, LANDMARK)).collect()}
    exact = np.array([got["exact"][m] for m in G.MATRIX]).reshape(3, 3)
    assert np.allclose(exact, TRUE / TRUE[2, 2], atol=1e-8) and got["exact"].status == "valid" and got["exact"].withheld_point_count == 2
    assert got["odd"].outlier_indices == [4] and got["odd"].inlier_count == 5  # the seventh landmark is the fifth fit point
    assert got["few"].reason == "needs four paired landmarks" and got["line"].reason == "landmarks are collinear"


def test_timeline_from_landmarks_ends_at_the_next_keyframe(spark):
    rows = landmark_rows("s", 100) + landmark_rows("s", 900)
    got = sorted((r.pts_start, r.pts_end, r.status, len(r.support_polygon)) for r in CAL.timeline_from_landmarks(spark.createDataFrame(rows, LANDMARK)).collect())
    assert [(a, b, c) for a, b, c, _ in got] == [(100, 900, "valid"), (900, None, "valid")] and all(n >= 4 for *_, n in got)


@pytest.mark.parametrize("block", [3, 10**6])
def test_propagation_composes_and_a_gap_stops_it(spark, block):
    h = np.array([[0.5, 0, 1], [0, 0.5, 2], [0, 0, 1.0]])
    line = spark.createDataFrame([("s", "k", 0, 100, h.reshape(-1).tolist(), [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)]), ("s", "lone", 200, None, h.reshape(-1).tolist(), [])], "shot_id string, keyframe_id string, pts_start bigint, pts_end bigint, matrix array<double>, support_polygon array<struct<x:double,y:double>>")
    move = lambda dx: [1.0, 0.0, dx, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    steps = [(p, move(2.0)) for p in (2, 4, 6, 8)] + [(30, move(2.0))]
    motions = spark.createDataFrame([("s", p, m) for p, m in steps], "shot_id string, pts bigint, motion array<double>")
    got = sorted(CAL.propagate_timeline(line, motions, 5, block_pts=block).collect(), key=lambda r: r.pts_start)
    assert [(r.calibration_id, r.pts_start, r.pts_end) for r in got] == [("k:prop-0", 0, 2), ("k:prop-2", 2, 4), ("k:prop-4", 4, 6), ("k:prop-6", 6, 8), ("k:bounded-8", 8, 13), ("lone", 200, None)]
    for i, r in enumerate(got[:5]):
        shift = np.array([[1, 0, -2.0 * i], [0, 1, 0], [0, 0, 1]])
        assert np.allclose(np.array(r.matrix).reshape(3, 3), h @ shift)
        assert [(p.x, p.y) for p in r.support_polygon][0] == (2.0 * i, 0.0)


def test_play_clock_never_extrapolates(spark):
    known = spark.createDataFrame([("p", "s", 100, 1.0), ("p", "s", 200, 2.0), ("p", "s", 300, 5.0)], "play_id string, shot_id string, pts bigint, play_time_s double")
    rows = spark.createDataFrame([("p", "s", t) for t in (99, 100, 150, 200, 250, 300, 301)], "play_id string, shot_id string, pts bigint")
    got = {r.pts: r.t for r in TM.time_at(rows, TM.time_segments(known), "t").collect()}
    assert got == {99: None, 100: 1.0, 150: 1.5, 200: 2.0, 250: 3.5, 300: 5.0, 301: None}


def two_means(features):
    points = np.asarray(features, float)
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    second = int(np.unravel_index(np.argmax(d), d.shape)[1]) or 1
    centres = points[[0, second]]
    for _ in range(12):
        labels = np.argmin(np.linalg.norm(points[:, None] - centres[None], axis=2), axis=1)
        moved = np.vstack([points[labels == k].mean(axis=0) if (labels == k).any() else centres[k] for k in (0, 1)])
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def test_clusters_equal_the_plain_algorithm(spark):
    rng = np.random.default_rng(3)
    rows = [("run", f"shot-0:t{t}", f, *np.clip(rng.normal(0.3 + 0.35 * (t % 2), 0.08, 3), 0, 1).tolist()) for t in range(6) for f in range(15)]
    df = spark.createDataFrame(rows, "run_id string, tracklet_id string, frame_index bigint, r double, g double, b double")
    got = {r.tracklet_id: r for r in TE.team_by_clusters(df, df, ["run_id"]).collect()}
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    centres = two_means([r[3:] for r in ordered])
    for t in range(6):
        mine = np.array([r[3:] for r in rows if r[1] == f"shot-0:t{t}"])
        d = np.linalg.norm(mine[:, None] - centres[None], axis=2)
        labels = d.argmin(axis=1)
        winner = int(np.bincount(labels, minlength=2).argmax())
        r = got[f"shot-0:t{t}"]
        assert r.team == f"team_{winner}" and abs(r.score - np.mean(1 / (1 + 4 * d[labels == winner, winner]))) < 1e-9


@pytest.mark.parametrize("shape", ["cube", "ball", "sphere", "line", "twins"])
def test_farthest_pair_of_colours_that_share_a_cell(spark, shape):
    """100,000 colours inside one 64th of the colour cube: the exact pair, from a number of candidates that stays linear."""
    rng = np.random.default_rng(11)
    n = 2_000 if shape == "sphere" else 100_000
    x = rng.normal(size=(n, 3)) if shape in ("ball", "sphere") else rng.uniform(-1, 1, (n, 3))
    if shape in ("ball", "sphere"):
        x /= np.linalg.norm(x, axis=1)[:, None]
    if shape == "ball":
        x *= rng.uniform(0, 1, (n, 1)) ** (1 / 3)
    if shape == "line":
        x[:, 1:] = 0
    if shape == "twins":
        x = np.round(x, 1)  # many equal colours, and ties for the farthest pair
    rgb = 0.507 + 0.004 * x
    frame = pd.DataFrame({"k": "a", "no": np.arange(n), "r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2]})
    points = spark.createDataFrame(frame).groupBy("k", "r", "g", "b").agg(F.min(F.struct("no")).alias("_order"))
    found = TE._farthest_candidates(points, ["k"]).cache()
    assert found.count() <= n
    apart = F.sqrt(sum(F.pow(F.col(f"_p.{c}") - F.col(f"_q.{c}"), 2) for c in "rgb"))
    directed = found.withColumn("d", apart).filter("_p._order < _q._order")
    best = directed.agg(F.max("d")).first()[0]
    first = directed.filter(F.col("d") == best).agg(F.min(F.struct("_p._order", "_q._order"))).first()[0]
    # points near the middle of a ball around all of them cannot be in the pair
    middle = (rgb.max(axis=0) + rgb.min(axis=0)) / 2
    out = np.linalg.norm(rgb - middle, axis=1)
    far = np.flatnonzero(out >= best - out.max() - 1e-12)
    _, once = np.unique(rgb[far], axis=0, return_index=True)
    far = np.sort(far[once])
    top, pair = -1.0, None
    for i in range(0, len(far), 256):
        diff = rgb[far[i : i + 256], None] - rgb[None, far]
        d = np.sqrt((diff[..., 0] ** 2 + diff[..., 1] ** 2) + diff[..., 2] ** 2)
        if d.max() > top:
            a, b = np.unravel_index(d.argmax(), d.shape)
            top, pair = d.max(), (int(far[i + a]), int(far[b]))
    assert best == pytest.approx(top, rel=1e-12)
    assert tuple(x[0] for x in first) == pair


def test_separated_picks_equal_the_greedy_walk(spark):
    rng = np.random.default_rng(8)
    scores = rng.integers(0, 40, 300) / 10.0
    taken = []
    for s, f in sorted(((-s, f) for f, s in enumerate(scores))):
        if all(abs(f - g) >= 15 for g in taken) and len(taken) < 8:
            taken.append(f)
    df = spark.createDataFrame([("a", f, float(s)) for f, s in enumerate(scores)], "source_id string, frame_index bigint, score double")
    got = [r.frame_index for r in RV.separated_top(df, ["source_id"], 15, 8).orderBy("pick_no").collect()]
    assert got == taken


def test_rows_that_share_a_frame_do_not_hide_later_picks(spark):
    rows = [("a", 100, 9.0 - i / 10) for i in range(40)] + [("a", 200, 0.5)]
    df = spark.createDataFrame(rows, "source_id string, frame_index bigint, score double")
    assert [r.frame_index for r in RV.separated_top(df, ["source_id"], 2, 8).orderBy("pick_no").collect()] == [100, 200]


def test_two_shared_fits_raise(spark):
    rows = spark.createDataFrame([("s0", 5)], "shot_id string, pts bigint")
    spans = spark.createDataFrame([], "shot_id string, pts_start bigint, pts_end bigint, fit struct<calibration_id:string>")
    fits = lambda *ids: spark.createDataFrame([("*", (i,)) for i in ids], "shot_id string, fit struct<calibration_id:string>")
    assert CAL.calibration_at(rows, spans, fits("a")).first().fit.calibration_id == "a"
    assert CAL.calibration_at(rows, spans, fits()).first().fit is None
    with pytest.raises(Exception, match="more than one shared fit"):
        CAL.calibration_at(rows, spans, fits("a", "b")).collect()


def test_suppression_keeps_the_strongest(spark):
    rows = [("s", 0, 10.0, 10.0, 0, 1, 9.0), ("s", 0, 15.0, 10.0, 0, 2, 8.0), ("s", 0, 40.0, 10.0, 1, 2, 7.0), ("s", 0, 22.0, 10.0, 1, 3, 6.0)]
    df = spark.createDataFrame(rows, "source_id string, frame_index bigint, x double, y double, first_line int, second_line int, support double")
    assert [r.kx for r in RV.suppress_points(df).orderBy("point_no").collect()] == [10.0, 40.0, 22.0]


def test_gate_inputs_of_a_run(spark):
    from trackspark.plans import run as RUN

    fit = "struct<status:string,inlier_count:int,median_error_px:double,reprojection_threshold_px:double,median_error_yards:double,withheld_point_count:int,withheld_p95_error_yards:double,m00:double,m01:double,m02:double,m10:double,m11:double,m12:double,m20:double,m21:double,m22:double>"
    one = ("valid", 8, 1.0, 3.0, 0.25, 4, 0.5, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    timeline = spark.createDataFrame([("s", one), ("t", one)], f"shot_id string, fit {fit}")
    errors = spark.createDataFrame([(0.25,)] * 60 + [(3.0,)] * 40, "error_yards double")
    got = RUN.pooled_quality(timeline, errors).first()
    assert (got.withheld_point_count, got.median_error_yards, got.p95_error_yards, got.status) == (100, 0.25, 3.0, "invalid")
    assert RUN.pooled_quality(timeline, None).first().status == "unvalidated"
    sources = spark.createDataFrame([("a",), ("b",)], "source_id string")
    known = lambda *rows: spark.createDataFrame(list(rows), "source_id string, proxy boolean")
    proxy = lambda detectors: RUN.detector_state(sources, detectors).first().proxy_detector
    assert not proxy(known(("a", False), ("b", False)))
    assert proxy(None) and proxy(known(("a", False))) and proxy(known(("a", False), ("b", None))) and proxy(known(("a", False), ("b", True)))
    frames = spark.createDataFrame([("s", 1, True, True), ("s", 2, False, False)], "shot_id string, frame_index long, labeled boolean, ignore_frame boolean")
    assert RUN.standard_state(frames).first().standard_status == "not_evaluated"
    assert RUN.standard_state(frames.withColumn("labeled", frames.shot_id.isNotNull())).first().standard_status == "evaluated"
