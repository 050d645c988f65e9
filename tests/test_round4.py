"""Steps that take many small things at once give what they gave one at a time."""

import random

import numpy as np
import pandas as pd
import pytest

from trackspark.operators import calibrate as CAL
from trackspark.operators import pairs as PR
from trackspark.operators import teams as TE
from trackspark.operators.tracking import LiveTracks
from trackspark.sources import label_xml as LX


@pytest.mark.parametrize("seed", range(4))
def test_overlaps_of_few_equal_the_arrays(seed):
    rng = random.Random(seed)
    box = lambda: (x := float(rng.randrange(0, 30)), y := float(rng.randrange(0, 30)), x + rng.randrange(-2, 20), y + rng.randrange(-2, 20))
    tracks = LiveTracks(30, 0.2, [(1, d, *box()) for d in range(8)] + [(1, 8, 0.0, float("nan"), 9.0, 9.0)])
    boxes = [box() for _ in range(7)] + [(0.0, 0.0, float("nan"), 9.0), tracks.boxes[0]]
    assert tracks._overlaps_of_few(boxes) == tracks._overlaps(boxes) != []


def landmarks_with_noise(seed):
    rng = np.random.default_rng(seed)
    field = rng.uniform(0, 100, (10, 2))
    w = 1.0 + 0.002 * field[:, 0] + 0.004 * field[:, 1]
    image = np.c_[(9.0 * field[:, 0] + 1.5 * field[:, 1] + 40.0) / w, (0.5 * field[:, 0] + 11.0 * field[:, 1] + 60.0) / w] + rng.normal(0, 1, (10, 2))
    image[:2] += 40.0
    field[4:7] = field[3]  # picks of these do not span a plane
    return field, image


@pytest.mark.parametrize("seed", range(4))
def test_candidates_are_fitted_together(seed, monkeypatch):
    field, image = landmarks_with_noise(seed)
    picks = CAL._picks(10, 60, 7)
    one_by_one = [CAL._direct_fit(field[p], image[p]) for p in picks if CAL._spread(field[p]) and CAL._spread(image[p])]
    np.testing.assert_allclose(CAL._direct_fits(field, image, picks), [m for m in one_by_one if m is not None], rtol=1e-9)
    calls, real = [], np.linalg.svd
    monkeypatch.setattr(np.linalg, "svd", lambda *a, **k: calls.append(1) or real(*a, **k))
    CAL._robust_fit(field, image, 3.0)
    assert len(calls) <= 30  # 400 candidates took some 1,200


@pytest.mark.parametrize("seed", range(6))
def test_settled_walks_equal_the_walk(seed):
    rng = np.random.default_rng(seed)
    left, right = (np.sort(rng.choice(400, 60, replace=False) * 0.04 + rng.uniform(-0.02, 0.02, 60)) for _ in range(2))
    walk = PR._settled(left, right, 0.015)
    if walk is not None:
        assert walk.tolist() == PR._walk(left.tolist(), right.tolist(), 0.015, -1)
    assert PR._settled(left, np.sort(np.r_[right, right[3]]), 20.0) is None


def test_block_without_a_possible_entry_is_final():
    row = lambda key, s, own=True: ("p", 1, key, s, s, s, 0.0, own)
    columns = ["play_id", "block", "tracklet_id", "s", "x", "y", "u", "own"]
    pairs = pd.DataFrame([("p", 1, "a", "b")], columns=["play_id", "block", "left_key", "right_key"])
    run = lambda rows: PR._pair_block(0.05, 64.0)(pd.DataFrame(rows, columns=columns), pairs)
    apart = run([row("a", 64.0), row("b", 64.0), row("a", 65.0), row("b", 65.0)])
    assert apart.alone.tolist() == [True] and apart.left_s.iloc[0].tolist() == [64.0, 65.0]
    near = run([row("a", 63.99, False), row("a", 64.0), row("b", 64.0), row("b", 64.02)])
    assert near.alone.tolist() == [False] * 3  # the sample before the border may have taken either


def test_label_files_are_parsed_once(spark, tmp_path):
    (tmp_path / "labels.xml").write_text("""<annotations>
<track id="1" label="player"><attribute name="a">1</attribute><box frame="0" xtl="1" ytl="2" xbr="5" ybr="6"><attribute name="b"/></box><box frame="1" xtl="1" ytl="2" xbr="5" ybr="6"><attribute>x</attribute></box></track>
<track id="2" label="p"><attribute name="a">1</attribute><attribute name="a">2</attribute><points frame="0" points="3,4"/></track>
</annotations>""")
    t = LX.read_tracks(spark, str(tmp_path))
    for name in ("boxes", "points"):
        assert not any(f.endswith(".xml") for f in t[name].inputFiles())
    assert [r.attributes for r in t["boxes"].orderBy("task_frame").collect()] == [{"a": "1", "b": ""}, {"a": "1"}]
    assert [r.attributes for r in t["points"].collect()] == [{"a": "1"}]


def test_colours_are_counted_once(spark, monkeypatch):
    written, real = [], TE.cut_lineage
    monkeypatch.setattr(TE, "cut_lineage", lambda df: written.append(df.columns) or real(df))
    crops = spark.createDataFrame([("s", f"t{i % 2}", i, 0.1 + 0.8 * (i % 2), 0.1, 0.01 * (i // 4)) for i in range(12)], "shot_id string, tracklet_id string, frame_index bigint, r double, g double, b double")
    teams = {r.tracklet_id: r for r in TE.team_by_clusters(crops, crops, ["shot_id"]).collect()}
    assert teams["t0"].team == "team_0" and teams["t1"].team == "team_1" and teams["t0"].crop_count == 6
    assert sum({"_n", "_order"} <= set(columns) for columns in written) == 1
