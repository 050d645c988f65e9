"""Skew-proof building blocks.

Every helper here splits one hot key over many tasks: order-dependent work runs
per ``(key, bucket)`` and only one small summary row per bucket is chained per
key. A ``bucket`` column must never decrease along the order columns, e.g.
``frame div 4096``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.session import cut_lineage

FRAME_BUCKET = 4096
TASK_ROWS = 500_000


def frame_bucket(column: str | Column, width: int = FRAME_BUCKET) -> Column:
    """Monotone bucket of an integer position."""
    value = F.col(column) if isinstance(column, str) else column
    return F.floor(value / F.lit(width)).cast("bigint")


def fresh(df: DataFrame) -> DataFrame:
    """Same columns under new ids, so both sides of a cogroup stay apart."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """Hash partitions for Python-heavy groups: small rows that take long must not be coalesced by size.

    ``rows``, if known, adds partitions so that one has about ``TASK_ROWS`` of them, whatever the input's size.
    """
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), *keys)


def _carried(df: DataFrame, keys: Sequence[str], bucket: str, summary: Column, chain: Callable) -> DataFrame:
    """One summary row per (keys, bucket), chained along the buckets of a key."""
    edges = df.groupBy(*keys, bucket).agg(summary.alias("_edge"))
    along = Window.partitionBy(*keys).orderBy(bucket)
    return edges.select(*keys, bucket, chain(F.col("_edge"), along).alias("_carry"))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: str, out: str = "pos") -> DataFrame:
    """Exact zero-based row number per key."""
    before = lambda edge, w: F.coalesce(F.sum(edge).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = _carried(df, keys, bucket, F.count(F.lit(1)), before)
    inner = Window.partitionBy(*keys, bucket).orderBy(*order)
    return (
        df.join(offsets, [*keys, bucket])
        .withColumn(out, F.col("_carry") + F.row_number().over(inner) - 1)
        .drop("_carry")
    )


def total_order(df: DataFrame, order: Sequence[str], out: str = "pos") -> DataFrame:
    """Zero-based row number over the whole table.

    The rows are dealt by ranges of the full key and written in order; the only thing that meets in one task is one
    count per range. Rows that are equal in the key lie in one range, so name enough columns.
    """
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    before = F.sum("_held").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_held")).select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    return placed.join(starts, "_range").withColumn(out, F.col("_start") + F.col("_at")).drop("_id", "_range", "_at", "_start")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: str, value: Column, out: str) -> DataFrame:
    """Inclusive running sum per key."""
    df = df.withColumn("_value", value)
    before = lambda edge, w: F.coalesce(F.sum(edge).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = _carried(df, keys, bucket, F.sum("_value"), before)
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.join(offsets, [*keys, bucket])
        .withColumn(out, F.col("_carry") + F.sum("_value").over(inner))
        .drop("_carry", "_value")
    )


def adjacent_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: str, fields: dict[str, str], following: bool = False
) -> DataFrame:
    """``lag``/``lead`` by one row: ``fields`` maps output name to source column."""
    payload = F.struct(*[F.col(source).alias(out) for out, source in fields.items()])
    by = F.struct(*[F.col(name) for name in order])
    summary = F.min_by(payload, by) if following else F.max_by(payload, by)
    chain = (lambda edge, w: F.lead(edge).over(w)) if following else (lambda edge, w: F.lag(edge).over(w))
    edges = _carried(df, keys, bucket, summary, chain)
    inner = Window.partitionBy(*keys, bucket).orderBy(*order)
    near = F.lead("_payload").over(inner) if following else F.lag("_payload").over(inner)
    joined = df.join(edges, [*keys, bucket]).withColumn("_payload", payload)
    joined = joined.withColumn("_near", F.coalesce(near, F.col("_carry")))
    return joined.select("*", *[F.col(f"_near.{out}").alias(out) for out in fields]).drop("_payload", "_near", "_carry")


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: str, value: str, out: str) -> DataFrame:
    """Last non-null ``value`` strictly before the row."""
    by = F.struct(*[F.col(name) for name in order])
    summary = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), by))
    before = lambda edge, w: F.last(edge, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    edges = _carried(df, keys, bucket, summary, before)
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(edges, [*keys, bucket])
        .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inner), F.col("_carry")))
        .drop("_carry")
    )


def row_frames(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: str,
    before: int,
    after: int,
    make: Callable[[Window], dict[str, Column]],
    block: int = FRAME_BUCKET,
) -> DataFrame:
    """Row-frame expressions in blocks; each block carries a halo of its neighbours' rows."""
    placed = positions(df, keys, order, bucket, "_pos")
    low = F.floor(F.greatest(F.col("_pos") - after, F.lit(0)) / block)
    high = F.floor((F.col("_pos") + before) / block)
    placed = placed.withColumn("_block", F.explode(F.sequence(low, high)))
    window = Window.partitionBy(*keys, "_block").orderBy("_pos")
    made = placed.select("*", *[column.alias(name) for name, column in make(window).items()])
    return made.filter(F.col("_block") == F.floor(F.col("_pos") / block)).drop("_block")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact linear-interpolated percentiles per key.

    Equal values are merged first. Cuts from a mergeable sketch split each key's
    values into ranges, narrow around the wanted ranks. Exact counts per range tell
    which ranges hold those ranks, and only they are ordered; a cut that lies
    off its rank makes a range longer, never wrong.
    """
    slack = 4.0 / accuracy
    near = {min(1.0, max(0.0, p + side * slack)) for p in probs.values() for side in (-1, 1)}
    cuts = sorted(near | {i / 32 for i in range(1, 32)})
    data = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    if not keys:
        data = data.withColumn("_all", F.lit(1))
    by = list(keys) or ["_all"]
    stats = data.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", cuts, accuracy).alias("_cuts"))
    merged = data.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = merged.join(stats, by).select(
        *by, "_v", "_c", "_n", F.size(F.filter("_cuts", lambda cut: cut < F.col("_v"))).alias("_range")
    )
    along = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = placed.groupBy(*by, "_range").agg(F.sum("_c").alias("_held"), F.max("_n").alias("_n"))
    ranges = ranges.withColumn("_start", F.sum("_held").over(along) - F.col("_held"))
    exact = {i: (F.col("_n") - 1) * F.lit(float(p)) for i, p in enumerate(probs.values())}
    ranks = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), F.least(F.floor(at).cast("bigint") + side, F.col("_n") - 1).alias("rank"))
        for i, at in exact.items() for side in (0, 1)
    ])
    wanted = F.filter(ranks, lambda r: (r["rank"] >= F.col("_start")) & (r["rank"] < F.col("_start") + F.col("_held")))
    ranges = ranges.select(*by, "_range", "_start", wanted.alias("_ranks")).filter(F.size("_ranks") > 0)
    order = Window.partitionBy(*by, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.join(ranges, [*by, "_range"]).withColumn("_upto", F.col("_start") + F.sum("_c").over(order))
    hits = F.filter("_ranks", lambda r: (r["rank"] < F.col("_upto")) & (r["rank"] >= F.col("_upto") - F.col("_c")))
    found = inside.select(*by, "_v", "_n", F.explode(hits).alias("_r")).groupBy(*by).agg(
        F.max("_n").alias("_n"),
        *[F.max(F.when((F.col("_r.i") == i) & (F.col("_r.side") == side), F.col("_v"))).alias(f"_v{i}_{side}") for i in exact for side in (0, 1)],
    )
    result = found.select(*by, *[
        (F.col(f"_v{i}_0") + (F.col(f"_v{i}_1") - F.col(f"_v{i}_0")) * (at - F.floor(at))).alias(name)
        for (i, at), name in zip(exact.items(), probs)
    ])
    return result if keys else result.drop("_all")


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    at: str,
    start: str,
    end: str,
    width: int,
    how: str = "inner",
    closed: bool = False,
    extent: DataFrame | None = None,
) -> DataFrame:
    """Range join as an equi join on (key, time bucket).

    Intervals are clipped to the span of the points and repeated once per
    bucket they touch; an open end (null) reaches to the last point.
    ``extent``, as ``extent_of`` makes it, holds all points of some of the
    keys: then the points, which may be a long plan, are read once.
    """
    if extent is None:
        by, span = list(on), points.groupBy(*on).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    else:
        by = [name for name in on if name in extent.columns]
        span = extent.select(*by, F.col(f"{at}_lo").alias("_lo"), F.col(f"{at}_hi").alias("_hi"))
    clipped_end = F.least(F.coalesce(F.col(end), F.col("_hi") + 1), F.col("_hi") + 1)
    clipped_start = F.greatest(F.col(start), F.col("_lo"))
    pieces = (
        intervals.join(span, by)
        .filter(clipped_end >= clipped_start)
        .withColumn("_b", F.explode(F.sequence(F.floor(clipped_start / width), F.floor(clipped_end / width))))
        .drop("_lo", "_hi")
    )
    renamed = pieces
    for name in on:
        renamed = renamed.withColumnRenamed(name, f"_on_{name}")
    renamed = renamed.withColumnRenamed("_b", "_on_b")
    keyed = points.withColumn("_b", F.floor(F.col(at) / width))
    upper = (F.col(at) <= F.col(end)) if closed else (F.col(at) < F.col(end))
    condition = (F.col("_b") == F.col("_on_b")) & (F.col(at) >= F.col(start)) & (F.col(end).isNull() | upper)
    for name in on:
        condition = condition & (F.col(name) == F.col(f"_on_{name}"))
    joined = keyed.join(renamed, condition, how)
    return joined.drop("_b", "_on_b", *[f"_on_{name}" for name in on])


def extent_of(points: DataFrame, keys: Sequence[str], *at: str) -> DataFrame:
    """First and last position per key, written once; rows derived from the points lie inside."""
    ends = [end for name in at for end in (F.min(name).alias(f"{name}_lo"), F.max(name).alias(f"{name}_hi"))]
    return cut_lineage(points.groupBy(*keys).agg(*ends))


def connected_components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``id -> component`` (smallest member) over ``edges(src, dst)``.

    Minimum labels travel along edges and then jump to the label's own label,
    so long chains close in logarithmically many rounds.
    """
    both = cut_lineage(
        edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    )
    labels = cut_lineage(vertices.select("id", F.col("id").alias("component")).distinct())
    for _ in range(max_rounds):
        told = (
            both.join(labels.select(F.col("id").alias("dst"), "component"), "dst")
            .groupBy(F.col("src").alias("id"))
            .agg(F.min("component").alias("_told"))
        )
        lowered = labels.join(told, "id", "left").select(
            "id", F.col("component").alias("_old"), F.least("component", "_told").alias("component")
        )
        hop = lowered.select(F.col("id").alias("component"), F.col("component").alias("_hop"))
        labels = cut_lineage(
            lowered.join(hop, "component", "left").select(
                "id", "_old", F.least("component", "_hop").alias("component")
            )
        )
        if labels.filter(F.col("component") != F.col("_old")).isEmpty():
            return labels.select("id", "component")
    raise RuntimeError("components did not settle")


def one_row(*parts: DataFrame) -> DataFrame:
    """Several one-row tables side by side, without a cross join: stacked, then folded by ``max``."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def edge_components(edges: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Bipartite edges with the connected ``component`` they belong to."""
    name = lambda side, columns: F.concat_ws("|", F.lit(side), *[F.col(c) for c in columns])
    keyed = edges.withColumn("_src", name("l", left)).withColumn("_dst", name("r", right))
    bonds = cut_lineage(keyed.select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct())
    ends = bonds.select(F.col("src").alias("id")).union(bonds.select(F.col("dst").alias("id"))).distinct()
    parts = connected_components(ends, bonds).select(F.col("id").alias("_src"), "component")
    return keyed.join(parts, "_src").drop("_src", "_dst")
