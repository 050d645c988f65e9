"""Skew-proof helpers against plain windows and numpy."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from trackspark import scale as S


def keyed(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(3)}", i, rng.choice([None, rng.randrange(50)])) for i in rng.sample(range(5000), n)]
    return spark.createDataFrame(rows, "k string, at bigint, v int").withColumn("b", S.frame_bucket("at", 64))


def test_positions_and_running_sum_equal_plain_windows(spark):
    df = keyed(spark)
    w = Window.partitionBy("k").orderBy("at")
    got = S.running_sum(S.positions(df, ["k"], ["at"], "b"), ["k"], ["at"], "b", F.coalesce("v", F.lit(0)), "total")
    want = df.withColumn("pos", F.row_number().over(w) - 1).withColumn("total", F.sum(F.coalesce("v", F.lit(0))).over(w))
    pick = lambda d: sorted((r.k, r.at, r.pos, r.total) for r in d.collect())
    assert pick(got) == pick(want)


def test_adjacent_and_last_known_cross_empty_buckets(spark):
    df = keyed(spark)
    w = Window.partitionBy("k").orderBy("at")
    got = S.last_known(df, ["k"], ["at"], "b", "v", "known")
    got = S.adjacent_row(got, ["k"], ["at"], "b", {"before": "v", "at_before": "at"})
    got = S.adjacent_row(got, ["k"], ["at"], "b", {"after": "at"}, following=True)
    want = (
        df.withColumn("known", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("before", F.lag("v").over(w)).withColumn("at_before", F.lag("at").over(w)).withColumn("after", F.lead("at").over(w))
    )
    pick = lambda d: sorted((r.k, r.at, str(r.known), str(r.before), str(r.at_before), str(r.after)) for r in d.collect())
    assert pick(got) == pick(want)


def test_row_frames_have_their_halo(spark):
    df = keyed(spark)
    make = lambda w: {"s": F.sum("at").over(w.rowsBetween(-3, 2)), "n": F.count("*").over(w.rowsBetween(-3, 2))}
    got = S.row_frames(df, ["k"], ["at"], "b", 3, 2, make, block=7)
    w = Window.partitionBy("k").orderBy("at")
    want = df.select("*", *[c.alias(n) for n, c in make(w).items()])
    pick = lambda d: sorted((r.k, r.at, r.s, r.n) for r in d.collect())
    assert pick(got) == pick(want)


def test_quantiles_are_exact_however_coarse_the_cuts(spark):
    rng = np.random.default_rng(5)
    values = {"hot": np.r_[rng.normal(size=6000), np.zeros(3000)], "one": np.array([4.0]), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, float(x)) for k, xs in values.items() for x in xs], "k string, x double")
    probs = {"q0": 0.0, "q2": 0.2, "q5": 0.5, "q95": 0.95, "q1": 1.0}
    for accuracy in (10, 200, 10_000):
        got = {r.k: r for r in S.exact_quantiles(df, ["k"], "x", probs, accuracy=accuracy).collect()}
        for k, xs in values.items():
            for name, p in probs.items():
                assert abs(got[k][name] - np.percentile(xs, p * 100)) < 1e-12


def test_interval_join_open_ends_and_left_rows(spark):
    points = spark.createDataFrame([("a", i) for i in range(0, 100, 7)] + [("b", 5), ("c", 1)], "k string, at bigint")
    spans = spark.createDataFrame([("a", 10, 40, "x"), ("a", 40, None, "y"), ("b", 6, None, "z")], "k string, s bigint, e bigint, name string")
    joined = S.interval_join(points, spans, ["k"], "at", "s", "e", 16, how="left").select("k", "at", F.coalesce("name", F.lit("-")).alias("name"))
    got = sorted((r["k"], r["at"], r["name"]) for r in joined.collect())
    want = sorted([("a", i, "-" if i < 10 else "x" if i < 40 else "y") for i in range(0, 100, 7)] + [("b", 5, "-"), ("c", 1, "-")])
    assert got == want


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    hub = [("h00", f"h{i:02d}") for i in range(1, 40)]
    edges = spark.createDataFrame(chain + hub, "src string, dst string")
    ids = {x for pair in chain + hub for x in pair} | {"lone"}
    got = {r["id"]: r["component"] for r in S.connected_components(spark.createDataFrame([(i,) for i in ids], "id string"), edges).collect()}
    assert got == {i: "lone" if i == "lone" else "h00" if i[0] == "h" else "n000" for i in ids}


def test_total_order_numbers_rows_without_one_task_for_all(spark):
    rows = [(i * 7919 % 1000, f"n{i % 13}") for i in range(5000)]
    out = S.total_order(spark.createDataFrame(rows, "a int, b string"), ["a", "b"], "no")
    got = out.select("no", "a", "b").collect()
    assert [r.no for r in sorted(got, key=lambda r: (r.a, r.b, r.no))] == list(range(5000))
    assert sorted((r.a, r.b) for r in got) == sorted(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "Aggregate" in plan.split("Window")[1]  # the one window runs over counts of ranges
    assert S.total_order(spark.createDataFrame([], "a int"), ["a"]).count() == 0


def test_spread_adds_partitions_with_the_rows(spark):
    df = spark.range(10)
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert S.spread(df, "id", rows=S.TASK_ROWS).rdd.getNumPartitions() == few
    assert S.spread(df, "id", rows=S.TASK_ROWS * 3 * few + 1).rdd.getNumPartitions() == 3 * few + 1
