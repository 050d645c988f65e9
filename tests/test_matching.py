"""Solvers, pairing, links and standard metrics against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.operators import evaluation as EV
from trackspark.operators import identity as ID
from trackspark.operators import pairs as PR
from trackspark.operators import tracks as TR
from trackspark.operators.assignment import best_matching, best_total, match_edges


def every_matching(weights):
    rows, cols = weights.shape
    options = [[-1, *np.flatnonzero(weights[r] > 0).tolist()] for r in range(rows)]
    for pick in itertools.product(*options):
        used = [c for c in pick if c >= 0]
        if len(used) == len(set(used)):
            yield pick


@pytest.mark.parametrize("seed", range(8))
def test_solvers_reach_the_best_total(seed):
    rng = np.random.default_rng(seed)
    weights = np.where(rng.random((5, 5)) < 0.6, rng.random((5, 5)).round(1), -1.0)
    weights[weights == 0] = -1.0
    best = max(sum(weights[r, c] for r, c in enumerate(p) if c >= 0) for p in every_matching(weights))
    total, chosen = best_total(weights)
    assert abs(total - best) < 1e-9 and len({c for c in chosen if c >= 0}) == sum(c >= 0 for c in chosen)
    picked = best_matching(weights)
    assert abs(sum(weights[r, c] for r, c in enumerate(picked) if c >= 0) - best) < 1e-9


def test_large_component_uses_the_same_optimum():
    rng = np.random.default_rng(1)
    weights = np.where(rng.random((15, 14)) < 0.4, rng.random((15, 14)), -1.0)
    picked = best_matching(weights)
    assert abs(sum(weights[r, c] for r, c in enumerate(picked) if c >= 0) - best_total(weights)[0]) < 1e-9


def test_ties_go_to_the_smallest_pairs():
    assert match_edges(["p1", "p1", "p2", "p2"], ["a", "b", "a", "b"], [0.6, 0.6, 0.6, 0.6]) == [0, 3]


BOX = "x1 double, y1 double, x2 double, y2 double"


def boxes(spark, rows, name):
    return spark.createDataFrame([("shot-0", f, i, float(x), 0.0, float(x + 10), 10.0) for f, i, x in rows], f"shot_id string, frame_index bigint, {name} string, {BOX}")


def frames(spark, n):
    return spark.createDataFrame([("shot-0", f, True, False) for f in range(n)], "shot_id string, frame_index bigint, labeled boolean, ignore_frame boolean")


def test_perfect_swapped_and_gapped_tracks(spark):
    truth = boxes(spark, [(f, o, x) for f in range(3) for o, x in (("p1", 0), ("p2", 40))], "object_id")
    swap = boxes(spark, [(f, t, x) for f in range(3) for t, x in (("shot-0:t1", 40 if f == 1 else 0), ("shot-0:t2", 0 if f == 1 else 40))], "tracklet_id")
    gap = boxes(spark, [(f, "shot-0:t1", 0) for f in (0, 2)] + [(f, "shot-0:t2", 40) for f in range(3)], "tracklet_id")
    a = EV.shot_metrics(truth, swap, frames(spark, 3)).first()
    b = EV.shot_metrics(truth, gap, frames(spark, 3)).first()
    assert (a.id_switches, a.fragmentation, a.matched_detections) == (4, 0, 6)
    assert (b.id_switches, b.fragmentation, b.matched_detections, b.coverage) == (0, 1, 5, 5 / 6)


def overlap(a, b):
    shared = max(0.0, min(a, b) + 10 - max(a, b)) * 10
    return shared / (200 - shared)


def published(truth, tracks, n, threshold=0.5):
    """HOTA, IDF1, switches and fragments straight from their definitions, assignments by enumeration."""
    def solve(table):
        return max(every_matching(table), key=lambda p: sum(table[r, c] for r, c in enumerate(p) if c >= 0))

    objects, ids = sorted({o for _, o, _ in truth}), sorted({t for _, t, _ in tracks})
    per = {f: ([(o, x) for g, o, x in truth if g == f], [(t, x) for g, t, x in tracks if g == f]) for f in range(n)}
    gt, tr = {o: sum(1 for _, p, _ in truth if p == o) for o in objects}, {t: sum(1 for _, p, _ in tracks if p == t) for t in ids}
    potential, together = {}, {}
    for g, h in per.values():
        sim = np.array([[overlap(x, y) for _, y in h] for _, x in g]).reshape(len(g), len(h))
        for i, (o, _) in enumerate(g):
            for j, (t, _) in enumerate(h):
                if sim[i, j] > 0:
                    potential[o, t] = potential.get((o, t), 0) + sim[i, j] / (sim[i].sum() + sim[:, j].sum() - sim[i, j])
                if sim[i, j] >= threshold:
                    together[o, t] = together.get((o, t), 0) + 1
    alphas = np.arange(0.05, 0.99, 0.05)
    hits = {a: {} for a in range(len(alphas))}
    for g, h in per.values():
        if not g or not h:
            continue
        sim = np.array([[overlap(x, y) for _, y in h] for _, x in g])
        score = np.array([[potential.get((o, t), 0) / (gt[o] + tr[t] - potential.get((o, t), 0)) for t, _ in h] for o, _ in g]) * sim
        for r, c in enumerate(solve(np.where(score > 0, score, -1.0))):
            if c >= 0:
                for a, alpha in enumerate(alphas):
                    if sim[r, c] >= alpha - 2e-16:
                        key = g[r][0], h[c][0]
                        hits[a][key] = hits[a].get(key, 0) + 1
    hota = []
    for a in range(len(alphas)):
        tp = sum(hits[a].values())
        det = tp / (len(truth) + len(tracks) - tp)
        ass = sum(c * c / (gt[o] + tr[t] - c) for (o, t), c in hits[a].items()) / max(1, tp)
        hota.append((det * ass) ** 0.5)
    table = np.array([[together.get((o, t), -1.0) for t in ids] for o in objects], float)
    best = solve(table)
    idtp = sum(table[r, c] for r, c in enumerate(best) if c >= 0)
    switches = fragments = 0
    last, previous, starts = {}, {}, {}
    for g, h in per.values():
        if not g or not h:
            continue
        table = np.array([[overlap(x, y) if overlap(x, y) >= threshold - 2e-16 else -1.0 for _, y in h] for _, x in g])
        bonus = np.array([[1000.0 if previous.get(o) == t else 0.0 for t, _ in h] for o, _ in g])
        chosen = solve(np.where(table > 0, table + bonus, -1.0))
        now = {g[r][0]: h[c][0] for r, c in enumerate(chosen) if c >= 0}
        for o, t in now.items():
            switches += o in last and last[o] != t
            starts[o] = starts.get(o, 0) + (o not in previous)
            last[o] = t
        previous = now
    fragments = sum(s - 1 for s in starts.values())
    return float(np.mean(hota)), 2 * idtp / (len(truth) + len(tracks)), switches, fragments


@pytest.mark.parametrize("seed", [4, 11])
def test_standard_metrics_follow_their_definitions(spark, seed):
    rng = random.Random(seed)
    n = 14
    truth = [(f, f"p{o}", o * 7 + 3 * rng.random()) for f in range(n) for o in range(3) if rng.random() < 0.9]
    tracks = [(f, f"shot-0:t{1 + (o + (f > 7)) % 4}", o * 7 + 5 * rng.random()) for f in range(n) for o in range(3) if rng.random() < 0.85]
    got = {r.shot_id: r for r in EV.standard_metrics(boxes(spark, truth, "object_id"), boxes(spark, tracks, "tracklet_id"), frames(spark, n)).collect()}
    hota, idf1, switches, fragments = published(truth, tracks, n)
    for key in ("shot-0", "*"):
        r = got[key]
        assert abs(r.HOTA - hota) < 1e-9 and abs(r.IDF1 - idf1) < 1e-9
        assert (r.id_switches, r.fragmentation) == (switches, fragments)


def plain_pairs(left, right, tolerance):
    used, out = -1, []
    for t in left:
        near = [(abs(right[i] - t), i) for i in range(used + 1, len(right)) if abs(right[i] - t) <= tolerance]
        if near:
            used = min(near)[1]
            out.append((t, right[used]))
    return out


@pytest.mark.parametrize("block", [0.25, 1.0, 512.0])
def test_pairing_in_blocks_equals_one_walk(spark, block):
    rng = random.Random(9)
    clock = lambda: sorted({round(rng.uniform(0, 6), 3) for _ in range(160)})
    tracks = {"shot-0:t1": clock(), "shot-0:t2": clock(), "shot-1:t1": clock(), "shot-1:t2": clock()}
    samples = spark.createDataFrame([("p", k.split(":")[0], k, t, t, 0.0, 0.1) for k, ts in tracks.items() for t in ts], "play_id string, shot_id string, tracklet_id string, play_time_s double, x double, y double, uncertainty double")
    keys = [("p", a, b) for a in tracks for b in tracks if a[:6] < b[:6]]
    got = PR.paired_samples(spark.createDataFrame(keys, "play_id string, left_key string, right_key string"), samples, 0.05, block_s=block).collect()
    for _, a, b in keys:
        mine = sorted((r.left_s, r.right_s) for r in got if (r.left_key, r.right_key) == (a, b))
        assert mine == plain_pairs(tracks[a], tracks[b], 0.05)


def test_throttle_blocks_equal_one_walk(spark):
    rng = random.Random(2)
    frames_ = sorted(rng.sample(range(900), 400))
    free, want = 0, []
    for f in frames_:
        if f >= free:
            want.append(f)
            free = f + 6
    df = spark.createDataFrame([("t", f) for f in frames_], "tracklet_id string, frame_index bigint")
    for block in (6, 16, 4096):
        assert sorted(r.frame_index for r in TR.stride_throttle(df, 6, block).collect()) == want


def links(spark, scores, **kw):
    left = sorted({l for l, _, _ in scores})
    tracks = spark.createDataFrame([("p", "a", "b", l, True) for l in left], "play_id string, left_shot string, right_shot string, left_key string, comparable boolean")
    rows = spark.createDataFrame([("p", "a", "b", *s) for s in scores], "play_id string, left_shot string, right_shot string, left_key string, right_key string, score double")
    return {r.left_key: r for r in ID.match_tracklets(tracks, rows, **kw).collect()}


def test_links_abstain_on_ties_and_keep_clear_edges(spark):
    tie = links(spark, [("a1", "b1", 0.9), ("a1", "b2", 0.9), ("a2", "b1", 0.9), ("a2", "b2", 0.9)])
    assert {r.decision for r in tie.values()} == {"insufficient_evidence"} and tie["a1"].rejection_reason == "global_assignment_ambiguous"
    clear = links(spark, [("a1", "b1", 0.95), ("a1", "b2", 0.7), ("a2", "b2", 0.9), ("a3", "b9", 0.3)])
    assert (clear["a1"].right_key, clear["a1"].decision, clear["a2"].right_key) == ("b1", "same", "b2")
    assert abs(clear["a1"].ambiguity_margin - 0.95) < 1e-9 and clear["a3"].rejection_reason == "no_eligible_edge"


def test_links_refuse_members_that_cannot_be_one_player(spark):
    proposed = spark.createDataFrame(
        [("p", "shot-0:t1", "shot-1:t1", "same"), ("p", "shot-0:t2", "shot-1:t1", "same"), ("p", "shot-0:t3", "shot-1:t3", "same"), ("p", "shot-0:t4", "shot-1:t4", "same")],
        "play_id string, left_key string, right_key string, decision string",
    )
    team = {"shot-0:t3": "A", "shot-1:t3": "B"}
    jersey = {"shot-0:t4": [7], "shot-1:t4": [7, 9]}
    ids = [f"shot-{s}:t{t}" for s in (0, 1) for t in (1, 2, 3, 4)]
    attributes = spark.createDataFrame([(i, "p", team.get(i), jersey.get(i)) for i in ids], "tracklet_id string, play_id string, team string, jerseys array<int>")
    seen = [("shot-0", f, "shot-0:t1") for f in (0, 7, 32_768, 90_001)] + [("shot-0", f, "shot-0:t2") for f in (1, 8, 32_769, 90_001)]
    seen += [("shot-1", 5, f"shot-1:t{t}") for t in (1, 3, 4)] + [("shot-0", 5 + t, f"shot-0:t{t}") for t in (3, 4)]
    rows = spark.createDataFrame(seen, "shot_id string, frame_index bigint, tracklet_id string")
    got = {(r.left_key, r.right_key): r.accepted for r in ID.safe_links(proposed, attributes, rows).collect()}
    apart = ID.safe_links(proposed, attributes, rows.filter("frame_index <> 90001")).collect()
    assert all(r.accepted for r in apart if r.right_key == "shot-1:t1")  # same chunks, no common frame
    assert got == {("shot-0:t1", "shot-1:t1"): True, ("shot-0:t2", "shot-1:t1"): False, ("shot-0:t3", "shot-1:t3"): False, ("shot-0:t4", "shot-1:t4"): True}


def test_left_out_pairs_are_counted_by_gate(spark):
    team = {f"shot-{s}:t{t}": "AABB?"[(t + s) % 5] for s in range(3) for t in range(5)}
    teams = spark.createDataFrame(
        [(i, t, 0.0 if t == "?" else 0.9, "rgb_prototype", 1.0, 0.0) for i, t in team.items() if i != "shot-2:t0"],
        "tracklet_id string, team string, score double, source string, assignment_coverage double, ambiguity double",
    )
    # every other tracklet is seen late, so that times part some pairs of one team
    rows = [("p", i.split(":")[0], i, float(k) * 0.1 + 500 * (int(i[-1]) % 2), 1.0, 2.0, 0.0) for i in team for k in range(40)]
    samples = spark.createDataFrame(rows, "play_id string, shot_id string, tracklet_id string, play_time_s double, x double, y double, uncertainty double")
    tracks = samples.select("play_id", "shot_id", "tracklet_id").distinct()
    cues = spark.createDataFrame(
        [("shot-0:t0", "shot-1:t0", True, False, None), ("shot-0:t0", "shot-1:t1", True, False, None), ("shot-0:t4", "shot-2:t3", True, False, None)],
        "left_key string, right_key string, reviewed_jersey_conflict boolean, reviewed_jersey_agreement boolean, cue_rank_score double",
    )
    for used in (None, cues):
        whole = ID.pair_evidence(ID.shot_pair_tracks(tracks)[1], samples, teams, used)
        want = {tuple(r)[:5] for r in whole.groupBy(*ID.SHOTS, "rejection_reason").count().collect()}
        part = ID.pair_evidence(ID.comparable_pairs(samples, teams, 0.05), samples, teams, used)
        got = ID.evidence_counts(tracks, teams, part, used).collect()
        assert {tuple(r)[:5] for r in got} == want and sum(r.pairs for r in got) == 75
        assert sum(r.formed for r in got) == part.count() < 75
        assert len({r.rejection_reason for r in got}) >= (4 if used is None else 5)


def test_player_ids_follow_the_smallest_member(spark):
    tracklets = spark.createDataFrame([(f"shot-{s}:t1",) for s in (0, 1, 2, 10)], "tracklet_id string")
    pair = spark.createDataFrame([("shot-1:t1", "shot-2:t1")], "left_key string, right_key string")
    got = {r.tracklet_id: r.player_id for r in ID.player_ids(tracklets, pair).collect()}
    assert got == {"shot-0:t1": "P01", "shot-10:t1": "P02", "shot-1:t1": "P03", "shot-2:t1": "P03"}


def contested_run(frames, seed, lock):
    """One long contested run; with ``lock`` two players share two tracks throughout, so the first choice lasts."""
    rng = random.Random(seed)
    rows = []
    for f in range(frames):
        edges = {("p0", "t0"), ("p0", "t1"), ("p1", "t0"), ("p1", "t1")} if lock else {("p0", "t0"), ("p0", "t1")}
        edges |= {(f"p{rng.randrange(2, 5)}", f"t{rng.randrange(2, 5)}") for _ in range(4)}
        for o, t in sorted(edges):
            share = rng.choice([0.5, 0.6, 0.7])
            rows.append(("s", 1, 10 * f, f, o, t, share, "t1" if f == 0 and o == "p0" else ("t0" if f == 0 and o == "p1" else "")))
    return rows


@pytest.mark.parametrize("frames,block,lock", [(10_000, 256, False), (600, 32, True), (90, 1, False), (40, 64, True)])
def test_contested_runs_in_blocks_equal_one_pass(spark, frames, block, lock):
    rows = contested_run(frames, frames, lock)
    by_frame, previous, want = {}, {}, set()
    for _, _, _, f, o, t, share, held in rows:
        by_frame.setdefault(f, []).append((o, t, share, held))
    for f in sorted(by_frame):
        edges = by_frame[f]
        weight = [w + 1000.0 * ((previous.get(o) == t) if previous else (held == t)) for o, t, w, held in edges]
        picks = match_edges([e[0] for e in edges], [e[1] for e in edges], weight)
        previous = {edges[i][0]: edges[i][1] for i in picks}
        want |= {(f, o, t) for o, t in previous.items()}
    work = spark.createDataFrame(rows, "shot_id string, run_no bigint, frame_index bigint, frame_no bigint, object_id string, tracklet_id string, iou double, held string")
    other = work.withColumn("shot_id", F.lit("u")).filter("frame_no < 5")
    got = EV.solve_runs(work.union(other), block).collect()
    assert {(r.frame_no, r.object_id, r.tracklet_id) for r in got if r.shot_id == "s"} == want
    assert {(r.frame_no, r.object_id, r.tracklet_id) for r in got if r.shot_id == "u"} == {w for w in want if w[0] < 5}


@pytest.mark.parametrize("seed", range(4))
def test_first_pairs_equal_a_walk_over_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(70):
        shot = f"shot-{rng.randrange(5)}"
        rows.append((f"{shot}:t{i}", shot, rng.choice(["G1", "G2", "G3"]), rng.choice(["P1", "P1", "P2", None]) if seed < 3 else rng.choice(["P1", None])))
    df = spark.createDataFrame(rows, "tracklet_id string, shot_id string, global_id string, player_id string")
    missed, wrong = [], []
    for a, b in itertools.combinations(sorted(rows), 2):
        if a[1] == b[1]:
            continue
        same_id = a[3] is not None and a[3] == b[3]
        if a[2] == b[2] and not same_id:
            missed.append((a[0], b[0], a[2]))
        if same_id and a[2] != b[2]:
            wrong.append((a[0], b[0], a[2], b[2]))
    assert [tuple(r) for r in EV.missed_link_examples(df, 9).orderBy("left", "right").collect()] == missed[:9]
    assert [tuple(r) for r in EV.false_merge_examples(df, 9).orderBy("left", "right").collect()] == wrong[:9]
