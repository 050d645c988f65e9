"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of orders 3 to 0 with frozen counts. A symbol's code length comes from the longest
context that was seen: -log2(n / (T + D)) if the symbol was seen there, else the escape -log2(D / (T + D)) and the next
shorter context (T symbols, D different ones); below order 0 every byte costs 8 bits. The language whose tree codes the
whole text shortest wins; the score is its share of 2 ** -length among all languages.

The trees are folded into tables of finished code lengths, so coding a text is one lookup per byte: a hashed table of
seen byte quadruples, then seen triples with the escape of their context, then dense pairs.

Trees are learned from at most ``PER_LANG`` texts of a language (those with the smallest hash of doc_id), of longer ones from a
seeded piece of at most ``MOST_BYTES`` bytes; more than ``MAX_LANGS`` languages are refused. Texts are always coded whole.

Defined cases: null text, or one without a letter: ``und`` with score 0. No language learned: ``und`` for all. Rows
without doc_id belong to no fold: they are not learned from and held_out is null. Ties go to the smaller name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_LANG, MOST_BYTES, MAX_LANGS, SALTS = 300, 16_384, 256, 16
PAD = b"\n\n\n"
CHUNK = 1 << 20
_LETTER = regex.compile(r"\p{L}")
_TURN = np.uint32(2654435761)
_BITS = 20


def quads(data: bytes) -> np.ndarray:
    """Every byte with its three predecessors as one number."""
    b = np.frombuffer(PAD + data, np.uint8).astype(np.uint32)
    return (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, part in batch.groupby("lang"):
            keys, n = np.unique(np.concatenate([quads(t.encode()) for t in part["text"]]), return_counts=True)
            yield pd.DataFrame({"lang": lang, "quad": keys.astype(np.int64), "n": n})


def bounded(text: Column) -> Column:
    """The text, or a seeded piece of a long one, of at most ``MOST_BYTES`` bytes."""
    length = MOST_BYTES // 4
    start = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.greatest(F.char_length(text) - length, F.lit(1))) + 1
    return F.when(F.octet_length(text) <= MOST_BYTES, text).otherwise(F.substring(text, start.cast("int"), F.lit(length)))


def learn(docs: DataFrame, usable: Column) -> "Model":
    """Counts of byte quadruples per language, summed in Spark; their number is bounded by the sample's bytes."""
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.filter(F.octet_length("text") > 0)
    ids = rows.select("doc_id", "lang")
    by = lambda *keys: Window.partitionBy("lang", *keys).orderBy(F.xxhash64("doc_id"), "doc_id")
    # the first places of every salt first, so that a frequent language is many tasks and the last step is bounded
    drawn = ids.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).withColumn("place", F.dense_rank().over(by("salt"))).filter(F.col("place") <= PER_LANG)
    drawn = drawn.select("doc_id", "lang").distinct().withColumn("place", F.row_number().over(by())).filter(F.col("place") <= PER_LANG)
    names = [r["lang"] for r in drawn.select("lang").distinct().limit(MAX_LANGS + 1).collect()]
    if len(names) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    sample = rows.select("doc_id", "lang", "text").join(F.broadcast(drawn.select("doc_id", "lang").distinct()), ["doc_id", "lang"])
    sample = sample.select("doc_id", "lang", bounded(F.col("text")).alias("text")).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    counted = sample.select("lang", "text").repartition("lang").mapInPandas(_count, "lang string, quad bigint, n bigint").groupBy("lang", "quad").agg(F.sum("n").alias("n"))
    table = counted.toPandas()
    return Model(sorted(names), table)


class Model:
    """Finished code lengths in bits per language (columns, by name)."""

    def __init__(self, names: list[str], table: pd.DataFrame) -> None:
        self.names = names
        k = len(names)
        at = table["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(np.int64) if len(table) else np.empty(0, np.int64)
        quad, n = table["quad"].to_numpy(np.int64), table["n"].to_numpy(np.float64)
        # order 0 and the pairs are dense
        self.pairs = np.zeros((65536, k), np.float32)
        self.pair_escape = np.zeros((65536, k), np.float32)
        one = self._dense(quad & 0xFF, at, n, 256, k)
        total, kinds = one.sum(0), (one > 0).sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            cost0 = np.where(one > 0, -np.log2(one / (total + kinds)), -np.log2(kinds / (total + kinds)) + 8.0)
            two = self._dense(quad & 0xFFFF, at, n, 65536, k).reshape(256, 256, k)
            total, kinds = two.sum(1, keepdims=True), (two > 0).sum(1, keepdims=True)
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            self.pairs[:] = np.where(two > 0, -np.log2(two / (total + kinds)), escape + cost0[None]).reshape(65536, k)
        self.triples, self.triple_cost, seen3, self.pair_escape[:] = self._level(quad & 0xFFFFFF, at, n, k, lambda g: self.pairs[g & 0xFFFF], 65536)
        self.triple_escape = np.zeros((len(self.triples), k), np.float32)
        self.quads, self.quad_cost, _, sparse = self._level(quad, at, n, k, self.cost3, None)
        contexts, escapes = sparse
        where = np.searchsorted(self.triples, contexts)
        found = (where < len(self.triples)) & (self.triples[np.minimum(where, max(len(self.triples) - 1, 0))] == contexts) if len(self.triples) else np.zeros(len(contexts), bool)
        self.triple_escape[where[found]] = escapes[found]
        self._index()

    @staticmethod
    def _dense(key, at, n, size, k):
        out = np.zeros((size, k))
        np.add.at(out, (key, at), n)
        return out

    def _level(self, key, at, n, k, shorter, dense):
        """Sorted grams of one order, their costs, and the escapes of their contexts."""
        grams, where = np.unique(key, return_inverse=True)
        counts = self._dense(where, at, n, len(grams), k)
        contexts, home = np.unique(grams >> 8, return_inverse=True)
        total, kinds = np.zeros((len(contexts), k)), np.zeros((len(contexts), k))
        np.add.at(total, home, counts)
        np.add.at(kinds, home, counts > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            cost = np.where(counts > 0, -np.log2(counts / (total + kinds)[home]), escape[home] + shorter(grams))
        if dense:
            wide = np.zeros((dense, k), np.float32)
            wide[contexts] = escape
            return grams, cost.astype(np.float32), counts, wide
        return grams, cost.astype(np.float32), counts, (contexts, escape.astype(np.float32))

    def cost3(self, grams: np.ndarray) -> np.ndarray:
        """Cost of the last byte after its two predecessors."""
        last = grams & 0xFFFFFF
        out = self.pair_escape[last >> 8] + self.pairs[last & 0xFFFF]
        if len(self.triples):
            where = np.minimum(np.searchsorted(self.triples, last), len(self.triples) - 1)
            hit = self.triples[where] == last
            out[hit] = self.triple_cost[where[hit]]
        return out

    def _index(self) -> None:
        """Hashed places of the quadruples; those whose slot is taken stay in a sorted rest."""
        keys = self.quads.astype(np.uint32)
        with np.errstate(over="ignore"):
            slots = (keys * _TURN) >> np.uint32(32 - _BITS)
        self.slot = np.full(1 << _BITS, -1, np.int32)
        self.slot[slots[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        rest = np.nonzero(self.slot[slots] != np.arange(len(keys)))[0]
        self.rest_keys, self.rest_rows = keys[rest], rest.astype(np.int32)
        self.keys = keys

    def bits(self, q: np.ndarray) -> np.ndarray:
        """Code length of each position in each language."""
        with np.errstate(over="ignore"):
            row = self.slot[(q * _TURN) >> np.uint32(32 - _BITS)]
        if not len(self.keys):
            return self._unseen(q)
        miss = (row < 0) | (self.keys[row] != q)
        if len(self.rest_keys) and miss.any():
            i = np.nonzero(miss)[0]
            where = np.minimum(np.searchsorted(self.rest_keys, q[i]), len(self.rest_keys) - 1)
            hit = self.rest_keys[where] == q[i]
            row[i[hit]] = self.rest_rows[where[hit]]
            miss[i[hit]] = False
        out = self.quad_cost[row]
        if miss.any():
            out[miss] = self._unseen(q[miss])
        return out

    def _unseen(self, q: np.ndarray) -> np.ndarray:
        q = q.astype(np.int64)
        out = self.cost3(q)
        if len(self.triples):
            context = q >> 8
            where = np.minimum(np.searchsorted(self.triples, context), len(self.triples) - 1)
            hit = self.triples[where] == context
            out[hit] += self.triple_escape[where[hit]]
        return out

    def lengths(self, text: str) -> np.ndarray:
        """Bits of the whole text in each language, a stretch at a time."""
        q = quads(text.encode())
        total = np.zeros(len(self.names))
        for start in range(0, len(q), CHUNK):
            total += self.bits(q[start : start + CHUNK]).sum(0, dtype=np.float64)
        return total


def _predict(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees: Model = model.value
        for batch in batches:
            names, scores = [], []
            for text in batch["text"]:
                if text is None or not trees.names or not _LETTER.search(text):
                    names.append("und")
                    scores.append(0.0)
                    continue
                bits = trees.lengths(text)
                best = int(np.argmin(bits))
                names.append(trees.names[best])
                scores.append(float(1.0 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum()))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": names, "score": scores})

    return run


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row; trees are learned from rows that are not held out."""
    trees = docs.sparkSession.sparkContext.broadcast(learn(docs, ~held_out))
    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out.alias("held_out"), "text")
    told = slim.mapInPandas(_predict(trees), "doc_id string, held_out boolean, lang_pred string, score double")
    return told.withColumn("doc_id", F.col("doc_id").cast("bigint"))
