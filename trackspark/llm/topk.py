"""Exact top-k inner products by norm buckets.

Vectors fall into buckets by length. A sample of ``SEEDS`` vectors gives each query a first score that its k-th best
answer reaches at least; a bucket whose longest vector cannot reach it is never sent the query. Inside a block the
local cosine threshold picks how to prune: by length (shorter vectors end the scan) where the threshold is low, by the
feasible range of the query's largest coordinates where it is high. Products of what is left are computed exactly.

A bucket is dealt over blocks of about ``BLOCK`` vectors, so vectors of one length, or copies of one vector, spread
out; queries stream past a block. Ties go to the smaller id and survive every bound, which all are "less than".

Defined cases: vectors that are null or hold null or non-finite components take no part. Vectors of another dimension
are no candidates of a query. A zero vector scores 0 with everything. Repeated ids: equal query rows are one
query, query rows of one id with other vectors are queries of their own; a query never meets rows of its own id; repeated
candidates each count. Scores are exact while they fit 64 bits. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.session import cut_lineage

BUCKETS, BLOCK, SEEDS, FOCUS = 16, 2048, 2048, 3
COORDINATE_FROM = 0.35
_SLACK = 1e-9


def quantised(df: DataFrame, scale: int = 256, identity: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, dim, norm, q``: components as floor(scale * x), rows with unusable vectors left out."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    rows = df.filter(F.col(identity).isNotNull() & F.col(vector).isNotNull()).filter(~bad)
    rows = rows.select(F.col(identity).cast("bigint").alias("vec_id"), F.size(vector).alias("dim"), whole.alias("q"))
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return rows.select("vec_id", "dim", norm.alias("norm"), "q")


def _floors(seeds, k: int):
    """The k-th best score of each query among the seeds: no answer can be worse."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_dim = seeds.value
        for batch in batches:
            floors = []
            for vec_id, dim, q in zip(batch["vec_id"], batch["dim"], batch["q"]):
                ids, matrix = by_dim.get(dim, (np.empty(0), None))
                others = ids != vec_id
                if others.sum() < k:
                    floors.append(None)
                    continue
                scores = (matrix @ np.asarray(q, np.int64))[others]
                floors.append(float(np.partition(scores, -k)[-k]))
            batch["floor"] = pd.Series(floors, dtype="float64", index=batch.index)
            yield batch

    return run


class Block:
    """Candidates of one block, longest first."""

    def __init__(self, rows: list[tuple]) -> None:
        rows.sort(key=lambda r: (-r[1], r[0]))
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.norms = np.array([r[1] for r in rows])
        self.q = np.array([r[2] for r in rows], np.int64).reshape(len(rows), -1)
        self.unit = self.q / np.where(self.norms > 0, self.norms, 1.0)[:, None]

    def survivors(self, q: np.ndarray, norm: float, floor: float) -> np.ndarray:
        reach = norm * self.norms.max()
        if not np.isfinite(floor) or reach <= 0:
            return np.arange(len(self.ids)) if reach > 0 or not floor > 0 else np.empty(0, np.int64)
        cosine = floor / reach - _SLACK
        if cosine > 1:
            return np.empty(0, np.int64)
        upto = int(np.searchsorted(-self.norms, -(floor / norm) * (1 - _SLACK) + _SLACK, side="right")) if floor > 0 else len(self.ids)
        if cosine < COORDINATE_FROM:
            return np.arange(upto)
        unit = q / norm
        width = np.arccos(np.clip(cosine, -1, 1))
        keep = np.ones(upto, bool)
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            angle = np.arccos(np.clip(unit[f], -1, 1))
            low, high = np.cos(min(np.pi, angle + width)) - _SLACK, np.cos(max(0.0, angle - width)) + _SLACK
            keep &= (self.unit[:upto, f] >= low) & (self.unit[:upto, f] <= high)
        return np.nonzero(keep)[0]

    def best(self, vec_id: int, q: np.ndarray, norm: float, floor: float, k: int) -> list[tuple]:
        at = self.survivors(q, norm, floor)
        at = at[self.ids[at] != vec_id]
        scores = self.q[at] @ q
        if np.isfinite(floor):
            at, scores = at[scores >= floor], scores[scores >= floor]
        order = np.lexsort((self.ids[at], -scores))[:k]
        return [(vec_id, int(self.ids[at[i]]), int(scores[i])) for i in order]


def _search(k: int):
    """Rows come sorted by block, candidates before queries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows, block = None, [], None
        for batch in batches:
            found: list[tuple] = []
            for dim, bucket, part, asks, vec_id, qkey, norm, floor, q in zip(*[batch[c] for c in ("dim", "bucket", "part", "asks", "vec_id", "qkey", "norm", "floor", "q")]):
                if (dim, bucket, part) != at:
                    at, rows, block = (dim, bucket, part), [], None
                if not asks:
                    rows.append((vec_id, norm, q))
                    continue
                if block is None and rows:
                    block, rows = Block(rows), []
                if block is not None:
                    best = block.best(vec_id, np.asarray(q, np.int64), norm, floor if floor == floor and floor is not None else -np.inf, k)
                    found += [(*row, qkey) for row in best]
            yield pd.DataFrame(found, columns=["query_id", "vec_id", "score", "qkey"])

    return run


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, identity: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products of every query row (``is_query`` on vec_id)."""
    spark = df.sparkSession
    vectors = cut_lineage(quantised(df, scale, identity, vector))
    bounds = vectors.agg(F.percentile_approx("norm", [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    bucket = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b > F.col("norm"))) if bounds else F.lit(0)
    vectors = vectors.withColumn("bucket", bucket)
    sized = vectors.groupBy("dim", "bucket").agg(F.max("norm").alias("top"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    sized = cut_lineage(sized)

    seeds: dict[int, tuple] = {}
    drawn = vectors.filter(F.col("dim") <= 4096).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEDS).select("vec_id", "dim", "q").collect()
    for dim in {r["dim"] for r in drawn}:
        own = [r for r in drawn if r["dim"] == dim]
        seeds[dim] = (np.array([r["vec_id"] for r in own]), np.array([r["q"] for r in own], np.int64).reshape(len(own), -1))
    schema = "vec_id bigint, qkey bigint, dim int, norm double, q array<bigint>, floor double"
    queries = vectors.filter(is_query).select("vec_id", F.xxhash64("q").alias("qkey"), "dim", "norm", "q").distinct()
    queries = cut_lineage(queries.mapInPandas(_floors(spark.sparkContext.broadcast(seeds), k), schema))

    asks = queries.join(sized, "dim").filter(F.col("floor").isNull() | (F.col("norm") * F.col("top") * (1 + _SLACK) + _SLACK >= F.col("floor")))
    asks = asks.select("dim", "bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "vec_id", "qkey", "norm", "floor", "q")
    held = vectors.join(sized, ["dim", "bucket"]).select(
        "dim", "bucket", F.pmod(F.xxhash64("vec_id", F.lit(7)), "parts").cast("int").alias("part"), F.lit(False).alias("asks"), "vec_id", F.lit(0).cast("bigint").alias("qkey"), "norm",
        F.lit(None).cast("double").alias("floor"), "q",
    )
    blocks = held.union(asks).repartition("dim", "bucket", "part").sortWithinPartitions("dim", "bucket", "part", "asks")
    found = blocks.mapInPandas(_search(k), "query_id bigint, vec_id bigint, score bigint, qkey bigint")
    rank = F.row_number().over(Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
