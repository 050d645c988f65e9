"""Steps that grow with their input: what a pair decides alone never reaches a group, a frame is dealt out once."""

import random

import pytest
from pyspark.sql import functions as F
from test_matching import boxes, frames, published

from trackspark.operators import evaluation as EV
from trackspark.operators import identity as ID


def plain_walk(links, traits, seen):
    """Links in order; a link joins two groups when their plays, teams, numbers and frames agree."""
    group, out = {k: {k} for k in traits}, {}
    for a, b in sorted(links):
        x, y = group[a], group[b]
        both = [[set().union(*(traits[k][i] for k in g)) for g in (x, y)] for i in range(3)]
        met = any(seen[k] & seen[m] for k in x for m in y)
        ok = x is y or not (met or (all(both[0]) and both[0][0] != both[0][1]) or any(all(s) and s[0].isdisjoint(s[1]) for s in both[1:]))
        if ok and x is not y:
            x |= y
            for k in y:
                group[k] = x
        out[a, b] = ok
    return out


@pytest.mark.parametrize("seed", range(3))
def test_links_that_their_own_ends_refuse_join_nothing(spark, monkeypatch, seed):
    rng = random.Random(seed)
    ids = [f"shot-{s}:t{t}" for s in range(12) for t in range(4)]
    traits = {k: ({f"play-{i // 24}"} if rng.random() < 0.8 else set(), {rng.choice("AB")} if rng.random() < 0.5 else set(), set(rng.sample(range(3), rng.randrange(3)))) for i, k in enumerate(ids)}
    seen = {k: {("shot" if rng.random() < 0.7 else k.split(":")[0], f) for f in rng.sample([*range(40), *range(40_000, 40_020)], 4)} for k in ids}
    links = {(k, k) for k in ids[:2]} | {tuple(sorted(rng.sample(ids, 2))) for _ in range(90)}
    attributes = spark.createDataFrame(
        [(k, min(p, default=None), min(t, default=rng.choice([None, "unknown"])), sorted(n)) for k, (p, t, n) in traits.items()],
        "tracklet_id string, play_id string, team string, jerseys array<int>",
    )
    rows = spark.createDataFrame([(s, f, k) for k, at in seen.items() for s, f in at], "shot_id string, frame_index bigint, tracklet_id string")
    proposed = spark.createDataFrame([("p", a, b, "same") for a, b in links], "play_id string, left_key string, right_key string, decision string")
    joined, real = [], ID.connected_components
    monkeypatch.setattr(ID, "connected_components", lambda vertices, edges: joined.extend(edges.collect()) or real(vertices, edges))
    got = {(r.left_key, r.right_key): r.accepted for r in ID.safe_links(proposed, attributes, rows).collect()}
    assert got == plain_walk(links, traits, seen) and {True, False} == set(got.values())
    alone = [(a, b) for a, b in links if not plain_walk([(a, b)], traits, seen)[a, b] and not (traits[a][2] and traits[b][2] and traits[a][2].isdisjoint(traits[b][2]))]
    assert alone and not {(r.src, r.dst) for r in joined} & set(alone)


def counted(spark, df):
    """The same rows, and how often any of them was read."""
    reads = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    return df.mapInArrow(read, df.schema), reads


@pytest.mark.parametrize("seed", [3, 8])
def test_boxes_are_dealt_once_and_scores_stay(spark, seed):
    rng, n, first = random.Random(seed), 14, EV.SOLVE_FRAMES - 6  # frames on both sides of a block's border
    truth = [(f, f"p{o}", o * 7 + 3 * rng.random()) for f in range(n) for o in range(3) if rng.random() < 0.85]
    tracks = [(f, f"shot-0:t{1 + (o + (f > 7)) % 4}", o * 7 + 5 * rng.random()) for f in range(n) for o in range(3) if rng.random() < 0.8]
    truth, tracks = [r for r in truth if r[0] != 4], [r for r in tracks if r[0] != 9]  # boxes of one side alone
    late = lambda df: df.withColumn("frame_index", F.col("frame_index") + first)
    other = lambda df, name: df.unionByName(df.withColumn("shot_id", F.lit("shot-1")).withColumn(name, F.concat(F.lit("1-"), name)))
    beside = [(n, i, 0.0) for i in ("x", "y")]  # in a frame without labels: counts nowhere
    objects, object_reads = counted(spark, other(late(boxes(spark, truth + beside, "object_id")), "object_id").coalesce(1))
    rows, row_reads = counted(spark, other(late(boxes(spark, tracks + beside, "tracklet_id")), "tracklet_id").coalesce(1))
    labelled = late(frames(spark, n + 1)).withColumn("labeled", F.col("frame_index") < first + n)
    labelled = labelled.unionByName(labelled.withColumn("shot_id", F.lit("shot-1")))
    got = {r.shot_id: r for r in EV.standard_metrics(objects, rows, labelled).collect()}
    hota, idf1, switches, fragments = published(truth, tracks, n)
    assert set(got) == {"shot-0", "shot-1", "*"}
    for key, times in (("shot-0", 1), ("shot-1", 1), ("*", 2)):
        r = got[key]
        assert abs(r.HOTA - hota) < 1e-9 and abs(r.IDF1 - idf1) < 1e-9
        assert (r.id_switches, r.fragmentation) == (times * switches, times * fragments)
    assert (object_reads.value, row_reads.value) == (2 * len(truth + beside), 2 * len(tracks + beside))
