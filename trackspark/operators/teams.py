"""Team evidence from crop colours."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.scale import exact_quantiles
from trackspark.session import cut_lineage

RGB = ("r", "g", "b")
CLOSE_CALL = 0.05
MIN_SCORE = 0.5
MAX_AMBIGUITY = 0.5
LINKABLE_SOURCES = ("rgb_prototype", "reviewed")


def team_eligible(prefix: str = "") -> Column:
    """Only named prototypes or reviewed labels may constrain a link."""
    c = lambda name: F.col(prefix + name)
    return F.coalesce(
        c("source").isin(*LINKABLE_SOURCES)
        & (c("team") != "unknown")
        & (c("score") > 0)
        & (c("assignment_coverage") > 0)
        & (c("ambiguity") < MAX_AMBIGUITY),
        F.lit(False),
    )


def _distance(rgb: Sequence, centre: Sequence) -> Column:
    parts = [F.pow(F.col(c) - F.lit(float(v)) if not isinstance(v, Column) else F.col(c) - v, 2) for c, v in zip(rgb, centre)]
    return F.sqrt(parts[0] + parts[1] + parts[2])


def team_by_prototype(tracklets: DataFrame, crops: DataFrame, prototypes: Mapping[str, Sequence[float]]) -> DataFrame:
    """Majority prototype per tracklet, unknown when ambiguous or far; tracklets without crops stay in.

    One pass over the crops: the prototypes are literals and every count is a partial aggregate.
    """
    names = sorted(prototypes)
    for name in names:
        if len(prototypes[name]) != 3 or not all(0.0 <= float(x) <= 1.0 for x in prototypes[name]):
            raise ValueError("team prototypes must be RGB triples")
    scored = crops.select("tracklet_id", F.array(*[_distance(RGB, prototypes[n]) for n in names]).alias("_d"))
    scored = scored.withColumn("_near", F.array_min("_d")).withColumn("_winner", F.array_position("_d", F.col("_near")) - 1)
    if len(names) > 1:
        second = F.get(F.sort_array("_d"), F.lit(1))
        close = F.avg(((second - F.col("_near")) < CLOSE_CALL).cast("double"))
    else:
        close = F.lit(0.0)
    won = [F.col("_winner") == i for i in range(len(names))]
    per = scored.groupBy("tracklet_id").agg(
        F.count(F.lit(1)).alias("crop_count"),
        close.alias("_close"),
        F.array(*[F.count_if(w) for w in won]).alias("_counts"),
        F.array(*[F.sum(F.when(w, 1.0 / (1.0 + F.col("_near") * 4.0))) for w in won]).alias("_scores"),
    )
    best = F.array_position("_counts", F.array_max("_counts")) - 1
    per = per.withColumn("_best", best.cast("int"))
    runner = F.get(F.sort_array("_counts", asc=False), F.lit(1)) if len(names) > 1 else F.lit(0)
    top = F.get("_counts", F.col("_best"))
    score = F.get("_scores", F.col("_best")) / top
    ambiguity = F.greatest(runner / F.col("crop_count"), F.col("_close"))
    rated = per.select(
        "tracklet_id", "crop_count", "_best", score.alias("score"),
        (top / F.col("crop_count")).alias("assignment_coverage"), ambiguity.alias("ambiguity"),
    )
    unsure = (F.col("ambiguity") >= MAX_AMBIGUITY) | (F.col("score") < MIN_SCORE)
    seen = F.col("crop_count").isNotNull()
    return tracklets.select("tracklet_id").distinct().join(rated, "tracklet_id", "left").select(
        "tracklet_id",
        F.when(seen & ~unsure, F.get(F.array(*[F.lit(n) for n in names]), F.col("_best"))).otherwise("unknown").alias("team"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.when(~seen, "no_crops").when(unsure, "ambiguous_rgb_prototype").otherwise("rgb_prototype").alias("source"),
        F.coalesce("crop_count", F.lit(0).cast("bigint")).alias("crop_count"),
        F.coalesce("assignment_coverage", F.lit(0.0)).alias("assignment_coverage"),
        F.coalesce("ambiguity", F.lit(0.0)).alias("ambiguity"),
    )


#: Halvings at most; double precision ends before.
HALVINGS = 48
#: Share by which a bound is loosened, so that rounding can never cut off the winner.
_LOOSE = 1e-9


def _length(values: list[Column]) -> Column:
    return F.sqrt(F.pow(values[0], 2) + F.pow(values[1], 2) + F.pow(values[2], 2))


def _extreme_bound(points: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the box and ball around its points, and the best distance from a point outermost in one of 13 directions."""
    directions = [d for d in itertools.product((-1, 0, 1), repeat=3) if d > (0, 0, 0)]
    along = [F.col("r") * d[0] + F.col("g") * d[1] + F.col("b") * d[2] for d in directions]
    outermost = [pick(F.struct(*RGB), to) for to in along for pick in (F.min_by, F.max_by)]
    box = [f(c).alias(f"_{n}_{c}") for c in RGB for n, f in (("lo", F.min), ("hi", F.max))]
    held = points.groupBy(*keys).agg(F.array(*outermost).alias("_out"), *box)
    farthest = F.array_max(F.transform("_out", lambda p: _length([F.col(c) - p[c] for c in RGB])))
    middle = _length([F.col(c) - (F.col(f"_lo_{c}") + F.col(f"_hi_{c}")) / 2 for c in RGB])
    reached = points.join(held, keys).groupBy(*keys).agg(F.max(farthest).alias("_far"), F.max(middle).alias("_radius"))
    return held.drop("_out").join(reached, keys).withColumn("_best", F.col("_far") * (1 - _LOOSE)).drop("_far")


def _farthest_candidates(points: DataFrame, keys: list[str]) -> DataFrame:
    """Point pairs that may be the farthest pair of a key.

    A distance that surely exists comes from the outermost points in fixed directions. Points go that cannot be part of
    as long a pair: by the farthest corner of the key's box and by the ball around it. What is left is halved: pairs of
    cells survive while the boxes of their own points can be that far apart, and cells are halved on until the
    survivors hold no more point pairs than there are points. Colours that lie close together are told apart like any
    others, as cells are shares of the key's own box. (Points spread evenly over a sphere are the worst case: about
    n ** 1.5 cell pairs on the way.)
    """
    bound = cut_lineage(_extreme_bound(points, keys))
    reach = _length([F.greatest(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(c)) for c in RGB])
    middle = _length([F.col(c) - (F.col(f"_lo_{c}") + F.col(f"_hi_{c}")) / 2 for c in RGB])
    share = lambda c: F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(0.0)
    alive = points.join(bound, keys).filter((reach * (1 + _LOOSE) >= F.col("_best")) & ((middle + F.col("_radius")) * (1 + _LOOSE) >= F.col("_best")))
    alive = cut_lineage(alive.select(*keys, "_order", *RGB, F.array(*[share(c) for c in RGB]).alias("_at")))
    limits, many = bound.select(*keys, "_best"), alive.count()
    cell = lambda level: F.transform("_at", lambda x: F.least(F.floor(x * F.lit(2.0**level)), F.lit(2**level - 1)).cast("bigint"))
    box = [f(c).alias(f"{n}_{c}") for c in RGB for n, f in (("lo", F.min), ("hi", F.max))]
    pairs = None
    for level in range(1, HALVINGS + 1):
        cells = alive.groupBy(*keys, cell(level).alias("cell")).agg(F.count(F.lit(1)).alias("held"), *box)
        cells = cells.withColumn("parent", F.transform("cell", lambda x: F.shiftright(x, 1)))
        named = lambda side: cells.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in cells.columns if c not in keys])
        if pairs is None:
            grown = named("a").join(named("b"), keys)  # at most 8 cells on each side
        else:
            kept = pairs.select(*keys, F.col("a_cell").alias("a_parent"), F.col("b_cell").alias("b_parent"))
            grown = kept.join(named("a"), [*keys, "a_parent"]).join(named("b"), [*keys, "b_parent"])
        upper = _length([F.greatest(F.col(f"a_hi_{c}") - F.col(f"b_lo_{c}"), F.col(f"b_hi_{c}") - F.col(f"a_lo_{c}")) for c in RGB])
        near = grown.join(limits, keys).filter(upper * (1 + _LOOSE) >= F.col("_best"))
        pairs = cut_lineage(near.select(*keys, "a_cell", "b_cell", (F.col("a_held") * F.col("b_held")).alias("held")))
        if (pairs.agg(F.sum("held")).first()[0] or 0) <= many:
            break
    side_of = lambda name, alias: alive.withColumn(name, cell(level)).select(*keys, name, F.struct("_order", *RGB).alias(alias))
    return pairs.select(*keys, "a_cell", "b_cell").join(side_of("a_cell", "_p"), [*keys, "a_cell"]).join(side_of("b_cell", "_q"), [*keys, "b_cell"])


def team_by_clusters(tracklets: DataFrame, crops: DataFrame, keys: list[str], rounds: int = 12) -> DataFrame:
    """Two seeded colour clusters per key; labels are diagnostic and never link-eligible.

    Seeds: the first crop in (tracklet, frame) order and the later member of the
    farthest pair. Only the two centres of a key are carried between rounds.
    """
    ordered = crops.withColumn("_order", F.struct("tracklet_id", "frame_index"))
    weighted = cut_lineage(ordered.groupBy(*keys, *RGB).agg(F.count(F.lit(1)).alias("_n"), F.min("_order").alias("_order")))  # equal colours count once with weight; read every round
    distinct = weighted.drop("_n")
    first = distinct.groupBy(*keys).agg(F.min_by(F.struct(*RGB), "_order").alias("_c0"))
    candidates = _farthest_candidates(distinct, keys)
    apart = F.sqrt(sum((F.pow(F.col(f"_p.{c}") - F.col(f"_q.{c}"), 2) for c in RGB[1:]), F.pow(F.col("_p.r") - F.col("_q.r"), 2)))
    directed = candidates.filter(F.col("_p._order") < F.col("_q._order")).select(*keys, apart.alias("_far"), "_p", "_q")
    second = directed.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(f"_q.{c}").alias(c) for c in RGB]), F.struct("_far")).alias("_any"),
        F.max("_far").alias("_far"),
    )
    tied = directed.join(second.select(*keys, "_far"), [*keys, "_far"]).groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(f"_q.{c}").alias(c) for c in RGB]), F.struct("_p._order", "_q._order")).alias("_c1")
    )
    seeds = first.join(tied, keys, "left").withColumn("_c1", F.coalesce("_c1", "_c0"))
    centres = cut_lineage(seeds.select(*keys, "_c0", "_c1"))
    to = lambda name: _distance(RGB, [F.col(f"{name}.{c}") for c in RGB])
    for _ in range(rounds):
        labelled = weighted.join(centres, keys).withColumn("_label", F.when(to("_c1") < to("_c0"), 1).otherwise(0))
        mean = lambda label: F.when(
            F.count_if(F.col("_label") == label) > 0,
            F.struct(*[
                (F.sum(F.when(F.col("_label") == label, F.col(c) * F.col("_n"))) / F.sum(F.when(F.col("_label") == label, F.col("_n")))).alias(c)
                for c in RGB
            ]),
        )
        moved = labelled.groupBy(*keys).agg(mean(0).alias("_m0"), mean(1).alias("_m1"))
        step = centres.join(moved, keys).select(
            *keys, F.coalesce("_m0", "_c0").alias("_n0"), F.coalesce("_m1", "_c1").alias("_n1"), "_c0", "_c1"
        )
        near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.col(b))
        close = near(f"_n0.r", "_c0.r")
        for pair in ("0", "1"):
            for c in RGB:
                close = close & near(f"_n{pair}.{c}", f"_c{pair}.{c}")
        step = cut_lineage(step.withColumn("_close", close))
        # a key that has settled keeps the centres it settled with
        centres = step.select(
            *keys, F.when(F.col("_close"), F.col("_c0")).otherwise(F.col("_n0")).alias("_c0"),
            F.when(F.col("_close"), F.col("_c1")).otherwise(F.col("_n1")).alias("_c1"),
        )
        if step.filter(~F.col("_close")).isEmpty():
            break
    scored = crops.join(centres, keys).withColumn("_label", F.when(to("_c1") < to("_c0"), 1).otherwise(0))
    scored = scored.withColumn("_near", F.least(to("_c0"), to("_c1")))
    value = 1.0 / (1.0 + F.col("_near") * 4.0)
    per = scored.groupBy(*keys, "tracklet_id").agg(
        F.count(F.lit(1)).alias("crop_count"), F.count_if(F.col("_label") == 1).alias("_ones"),
        F.sum(F.when(F.col("_label") == 0, value)).alias("_s0"), F.sum(F.when(F.col("_label") == 1, value)).alias("_s1"),
    )
    winner = F.when(F.col("_ones") > F.col("crop_count") - F.col("_ones"), 1).otherwise(0)
    count = F.when(winner == 1, F.col("_ones")).otherwise(F.col("crop_count") - F.col("_ones"))
    rated = per.select(
        *keys, "tracklet_id", "crop_count", F.concat(F.lit("team_"), winner.cast("string")).alias("team"),
        (F.when(winner == 1, F.col("_s1")).otherwise(F.col("_s0")) / count).alias("score"),
        (count / F.col("crop_count")).alias("assignment_coverage"),
    )
    seen = F.col("crop_count").isNotNull()
    return tracklets.select(*keys, "tracklet_id").distinct().join(rated, [*keys, "tracklet_id"], "left").select(
        *keys, "tracklet_id", F.coalesce("team", F.lit("unknown")).alias("team"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.when(seen, "rgb_cluster").otherwise("no_crops").alias("source"),
        F.coalesce("crop_count", F.lit(0).cast("bigint")).alias("crop_count"),
        F.coalesce("assignment_coverage", F.lit(0.0)).alias("assignment_coverage"), F.lit(0.0).alias("ambiguity"),
    )


def crop_colours(pixels: DataFrame) -> DataFrame:
    """Trimmed torso mean per crop: pixels inside the 20-80 percentile band of every channel.

    pixels(crop_id, px, py, width, height, r, g, b) with channels in [0,1]; crops under 4 px are unusable.
    """
    band = lambda at, size: (F.col(at) >= F.floor(F.col(size) * 0.2)) & (F.col(at) < F.floor(F.col(size) * 0.8))
    torso = pixels.filter((F.col("width") >= 4) & (F.col("height") >= 4) & band("px", "width") & band("py", "height"))
    melted = torso.select(
        "crop_id", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in RGB])).alias("_m")
    ).select("crop_id", "_m.channel", "_m.value")
    cuts = exact_quantiles(melted, ["crop_id", "channel"], "value", {"low": 0.2, "high": 0.8})
    wide = cuts.groupBy("crop_id").agg(*[
        F.max(F.when(F.col("channel") == c, F.col(side))).alias(f"{c}_{side}") for c in RGB for side in ("low", "high")
    ])
    joined = torso.join(wide, "crop_id")
    inside = F.lit(True)
    for c in RGB:
        inside = inside & F.col(c).between(F.col(f"{c}_low"), F.col(f"{c}_high"))
    return joined.withColumn("_in", inside).groupBy("crop_id").agg(
        *[F.coalesce(F.avg(F.when(F.col("_in"), F.col(c))), F.avg(c)).alias(c) for c in RGB]
    )
