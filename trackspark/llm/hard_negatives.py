"""Hard negatives of anchors by exact inner products, scored with subset-sum tables.

Candidates are dealt over blocks of about ``BLOCK`` rows; every anchor passes every block of its dimension. A block
holds the candidates' components as packed bit planes: one byte for eight dimensions and one bit of weight. For a group of
anchors and eight dimensions a table holds the sums of all 256 subsets of the anchors' components. A score is the sum
of looked-up rows, shifted by the plane's weight; the plane of the sign counts negatively. Nothing is approximated.

Two passes: the first scores the rows of an anchor's own label (a block is ordered by label) and keeps the best as
positives; the second scores the other labels and keeps, for each positive, the best rows inside its score band. What
a block returns is bounded by the numbers asked for, whatever the labels' sizes.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; neither do
rows with a component of which ``scale * x`` is 2**28 or more in size, as their scores could pass 64 bits. Rows equal in
id, label and vector are one row. Rows that share an id but differ are rows of their own, also as anchors; ties beyond
the id go by a hash of the row. Only vectors of one length meet. An anchor without positives, or a positive without
negatives, has no row. Only the three named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.session import cut_lineage

BLOCK, GROUP, STRIP = 16_384, 128, 2048
LARGEST = 1 << 28


def quantised(df: DataFrame, scale: int, identity: str, label: str, vector: str) -> DataFrame:
    """``vec_id, key, label, dim, q``; ``key`` tells rows of one id apart."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * float(scale)) >= float(LARGEST)))
    rows = df.filter(F.col(identity).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).filter(~bad)
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    rows = rows.select(F.col(identity).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), whole.alias("q")).distinct()
    return rows.select("vec_id", F.xxhash64("label", "q").alias("key"), "label", F.size("q").alias("dim"), "q")


def bit_planes(q: np.ndarray) -> np.ndarray:
    """``planes x groups x rows`` bytes: bit ``b`` of eight dimensions each, two's complement, the sign in the last plane."""
    planes = int(max(q.max(initial=0), -q.min(initial=0) - 1)).bit_length() + 1
    return np.stack([np.ascontiguousarray(np.packbits(((q >> b) & 1).astype(np.uint8), axis=1, bitorder="little").T) for b in range(planes)])


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """``groups x 256 x anchors``: sums of all subsets of eight dimensions, each made from a smaller subset."""
    k, dim = anchors.shape
    padded = np.zeros((k, -(-dim // 8) * 8), np.int64)
    padded[:, :dim] = anchors
    tables = np.zeros((padded.shape[1] // 8, 256, k), np.int64)
    for group in range(len(tables)):
        for j in range(8):
            tables[group, 1 << j : 2 << j] = tables[group, : 1 << j] + padded[:, 8 * group + j]
    return tables


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """``rows x anchors`` inner products."""
    n, k = planes.shape[2], tables.shape[2]
    narrow = np.abs(tables).max(initial=0) * len(tables) < 2**31
    tables = tables.astype(np.int32) if narrow else tables
    out = np.zeros((n, k), np.int64)
    for start in range(0, n, STRIP):
        strip = out[start : start + STRIP]
        for b, plane in enumerate(planes[:, :, start : start + STRIP]):
            held = np.zeros(strip.shape, tables.dtype)
            for table, index in zip(tables, plane):
                held += table[index]
            shifted = held.astype(np.int64) << b
            strip += -shifted if b == len(planes) - 1 else shifted
    return out


def first(at: np.ndarray, score: np.ndarray, ids: np.ndarray, keys: np.ndarray, most: int) -> np.ndarray:
    """The best ``most`` of the rows ``at``: higher scores, then smaller ids."""
    if len(at) > most:
        at = at[score[at] >= np.partition(score[at], len(at) - most)[len(at) - most]]
    return at[np.lexsort((keys[at], ids[at], -score[at]))[:most]]


class Block:
    """Candidates in the order of their labels, as bit planes."""

    def __init__(self, rows: list[tuple]) -> None:
        labels = np.array([r[2] for r in rows], np.int64)
        order = np.argsort(labels, kind="stable")
        self.labels = labels[order]
        self.ids, self.keys = (np.array([r[i] for r in rows], np.int64)[order] for i in (0, 1))
        self.planes = bit_planes(np.array([r[3] for r in rows], np.int64)[order])

    def positives(self, anchors: list[tuple], most: int) -> Iterator[tuple]:
        for label in sorted({a[2] for a in anchors}):
            a, b = np.searchsorted(self.labels, [label, label + 1])
            own = [x for x in anchors if x[2] == label]
            if a == b:
                continue
            found = scores(self.planes[:, :, a:b], subset_sums(np.array([x[3] for x in own], np.int64)))
            for j, (vec_id, key, *_) in enumerate(own):
                others = np.flatnonzero((self.ids[a:b] != vec_id) | (self.keys[a:b] != key))
                for i in first(others, found[:, j], self.ids[a:b], self.keys[a:b], most):
                    yield vec_id, key, int(self.ids[a + i]), int(self.keys[a + i]), int(found[i, j])

    def negatives(self, anchors: list[tuple], most: int, low: int, high: int) -> Iterator[tuple]:
        found = scores(self.planes, subset_sums(np.array([x[3] for x in anchors], np.int64)))
        for j, (vec_id, key, label, _, positives) in enumerate(anchors):
            other, score = np.flatnonzero(self.labels != label), found[:, j]
            for p in positives:
                value = p["score"]
                # low * value <= 100 * score <= high * value, in whole numbers
                fits = other[(score[other] >= -(-low * value // 100)) & (score[other] <= high * value // 100)]
                for i in first(fits, score, self.ids, self.keys, most):
                    yield vec_id, key, p["vec_id"], p["key"], value, int(self.ids[i]), int(self.keys[i]), int(score[i])


def _pass(answer, names: list[str]):
    """Rows come sorted by block, candidates before anchors; anchors are taken ``GROUP`` at a time."""

    def told(block: Block | None, anchors: list[tuple]) -> pa.RecordBatch:
        found = list(answer(block, anchors)) if block is not None and anchors else []
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (zip(*found) if found else [()] * len(names))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, anchors, block = None, [], [], None
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                piece = batch.slice(start, 1024)
                for dim, part, asks, *row in zip(*[piece[c].to_pylist() for c in ("dim", "part", "asks", "vec_id", "key", "label", "q", "positives")]):
                    if (dim, part) != at:
                        yield told(block, anchors)
                        at, rows, anchors, block = (dim, part), [], [], None
                    if not asks:
                        rows.append((*row[:3], np.array(row[3], np.int64)))
                        continue
                    if block is None and rows:
                        block, rows = Block(rows), []
                    anchors.append((*row[:3], np.array(row[3], np.int64), row[4]))
                    if len(anchors) == GROUP:
                        yield told(block, anchors)
                        anchors = []
        yield told(block, anchors)

    return run


def mine(
    df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    identity: str = "vec_id", label: str = "label", vector: str = "embedding", block: int = BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a column over vec_id. A negative's score lies between ``low`` and ``high`` percent of the positive's.
    """
    vectors = cut_lineage(quantised(df, scale, identity, label, vector).filter("dim > 0"))
    sized = cut_lineage(vectors.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")))
    tasks = max(int(sized.agg(F.sum("parts")).first()[0] or 1), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = "array<struct<score:bigint,vec_id:bigint,key:bigint>>"
    held = vectors.join(sized, "dim").select(
        "dim", F.pmod(F.xxhash64("vec_id", "key"), "parts").cast("int").alias("part"), F.lit(False).alias("asks"), "vec_id", "key", "label", "q",
        F.lit(None).cast(kind).alias("positives"),
    )

    def meet(anchors: DataFrame, answer, names: list[str]) -> DataFrame:
        asks = anchors.join(sized, "dim").select(
            "dim", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "vec_id", "key", "label", "q", "positives"
        )
        cells = held.union(asks).repartition(tasks, "dim", "part").sortWithinPartitions("dim", "part", "asks")
        return cells.mapInArrow(_pass(answer, names), ", ".join(f"{c} bigint" for c in names))

    anchors = vectors.filter(is_anchor)
    near = meet(
        anchors.withColumn("positives", F.lit(None).cast(kind)), lambda b, a: b.positives(a, positives), ["vec_id", "key", "positive_id", "positive_key", "score"]
    )
    best = Window.partitionBy("vec_id", "key").orderBy(F.desc("score"), "positive_id", "positive_key")
    near = near.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= positives)
    near = near.groupBy("vec_id", "key").agg(F.collect_list(F.struct("score", F.col("positive_id").alias("vec_id"), F.col("positive_key").alias("key"))).alias("positives"))
    anchors = cut_lineage(anchors.join(near, ["vec_id", "key"]))

    names = ["anchor_id", "anchor_key", "positive_id", "positive_key", "positive_score", "negative_id", "negative_key", "negative_score"]
    far = meet(anchors, lambda b, a: b.negatives(a, negatives, low, high), names)
    best = Window.partitionBy("anchor_id", "anchor_key", "positive_id", "positive_key").orderBy(F.desc("negative_score"), "negative_id", "negative_key")
    ranked = far.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
