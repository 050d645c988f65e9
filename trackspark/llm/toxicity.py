"""Toxicity by compression distance: one zstandard dictionary of ordinary text, one of toxic text.

A window is one lower-cased word with the space before it (longer words are cut every ``LONGEST`` characters, so the
whole text is covered). Each window is compressed with both dictionaries; its distance is the number of bytes that the toxic
dictionary saves over the ordinary one. Windows at or over the calibrated threshold are hits; a logistic curve over
the hits and their share of the windows, also calibrated, gives the document's score.

Training takes at most ``MOST_TOXIC`` and ``MOST_ORDINARY`` labelled texts of any length (those with the smallest hash
of doc_id). One half fills the dictionaries (ordinary: the windows of most ordinary documents; toxic: those, and in
front of them the windows that toxic documents hold far more often); of a text over ``MOST_BYTES`` bytes it gives
``PIECES`` seeded pieces. The other half is counted whole on the executors and calibrates threshold and curve.

Texts fall into groups by the shares of their byte pairs (no language column is read). Each group has a window
threshold and a cut of its own, so that at most ``CLEAN_LIMIT`` of its ordinary calibration texts are called toxic; a
group with fewer than ``FEWEST`` of them takes the highest cut of all groups.
Every text is scored whole.

zstandard's own dictionary builder was tried and left: it makes 150 bytes of a thousand such windows. Dictionaries are
raw content and the optimal parser is used, so that text added in front does not change how other text is coded.

Defined cases: null and empty texts have no windows and get the curve's value for none. Without labelled rows of both
kinds every score is 0; with fewer than ``FEW_TOXIC`` toxic or ``FEW_ORDINARY`` ordinary ones both halves are all of them. Repeated rows are scored alike; of several labels of a document the largest counts. Rows
without doc_id are scored but never learned from. Only doc_id, text and the two label columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_TOXIC, MOST_ORDINARY, MOST_BYTES = 1500, 4500, 12_288
ORDINARY_BYTES, TOXIC_BYTES = 1 << 18, 1 << 14
LIFT, SIGMAS = 8.0, 3.0
FEW_TOXIC, FEW_ORDINARY = 4, 8
LONGEST, REMEMBERED = 256, 400_000
PIECES, THRESHOLDS = 4, (1, 2, 3, 4)
GROUPS, PROFILE, CLEAN_LIMIT, FEWEST = 8, 512, 0.01, 50
#: Ends every window and the dictionaries: zstandard stores blocks of a few bytes as they are.
PAD = b" \x00\x01\x02\x03\x04\x05\x06\x07"
#: In front of the ordinary part, so that no toxic window is followed by the padding.
GAP = b"\xff"


def windows(text: str | None) -> list[str]:
    """All words of the text, lower-cased, in pieces of bounded length."""
    words = (text or "").lower().split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [word[i : i + LONGEST] for word in words for i in range(0, len(word), LONGEST)]


def as_bytes(window: str) -> bytes:
    return b" " + window.encode("utf-8", "replace")


def _held(texts: list[str]) -> Counter:
    """Documents that hold each window."""
    counts: Counter = Counter()
    for text in texts:
        counts.update(set(windows(text)))
    return counts


def _content(counts: dict[str, int], size: int) -> bytes:
    """The first windows by count, up to ``size`` bytes, the most frequent at the end."""
    parts, used = [], 0
    for window, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        parts.append(as_bytes(window))
        used += len(parts[-1])
        if used >= size:
            break
    return b"".join(reversed(parts))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters(
        window_log=19, hash_log=18, chain_log=20, search_log=8, min_match=3, target_length=32, strategy=zstandard.STRATEGY_BTOPT,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


class Distance:
    """Distances of windows under two dictionaries; answers are remembered up to a fixed number."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.ordinary, self.toxic = _compressor(ordinary), _compressor(toxic)
        self.known: dict[str, int] = {}

    def all(self, found: list[str]) -> list[int]:
        saved = list(map(self.known.get, found))
        if None in saved:
            saved = [self._new(w) if x is None else x for w, x in zip(found, saved)]
        return saved

    def _new(self, window: str) -> int:
        data = as_bytes(window) + PAD
        saved = len(self.ordinary.compress(data)) - len(self.toxic.compress(data))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[window] = saved
        return saved


def profile(text: str | None) -> np.ndarray:
    """Square roots of the shares of the byte pairs, folded; their distance does not depend on the text's length."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "replace"), dtype=np.uint8)
    held = np.zeros(PROFILE)
    for i in range(0, len(data) - 1, 1 << 20):
        part = data[i : i + (1 << 20) + 1].astype(np.int64)
        held += np.bincount((part[:-1] * 257 + part[1:] * 31) % PROFILE, minlength=PROFILE)
    return np.sqrt(held / max(held.sum(), 1.0))


def hits(text: str | None, distance: Distance) -> list[int]:
    """Number of windows, then the hits at every threshold."""
    saved = distance.all(windows(text))
    return [len(saved), *(sum(x >= threshold for x in saved) for threshold in THRESHOLDS)]


def features(total: int, hit: int) -> tuple[float, float, float]:
    return 1.0, float(np.log1p(hit)), float(np.log1p(1000.0 * hit / max(total, 1)))


def _centres(x: np.ndarray) -> np.ndarray:
    """Groups of profiles: farthest points first, so that a rare kind gets one, then the means of the nearest."""
    chosen = [x.mean(axis=0)]
    far = ((x - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < min(GROUPS, len(x)) and far.max() > 1e-9:
        chosen.append(x[int(far.argmax())])
        far = np.minimum(far, ((x - chosen[-1]) ** 2).sum(axis=1))
    centres = np.array(chosen)
    for _ in range(20):
        near = _nearest(x, centres)
        centres = np.array([x[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centres)])
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def _cut(clean: np.ndarray) -> float:
    """The smallest cut at or over 0 that at most ``CLEAN_LIMIT`` of the clean values exceed."""
    if not len(clean):
        return 0.0
    return max(0.0, float(np.sort(clean)[::-1][int(CLEAN_LIMIT * len(clean))]))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method with a small penalty, and its mean loss."""
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [0.05] * (x.shape[1] - 1))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))), 1e-6, 1 - 1e-6)
    return beta, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


class Model:
    """Both dictionaries; after ``calibrate`` the curves, and per group of texts its threshold and cut."""

    def __init__(self, ordinary: list[str], toxic: list[str]) -> None:
        own, toxic_own = _held(ordinary), _held(toxic)
        n, m = len(ordinary), len(toxic)
        told = {}
        for window, held in toxic_own.items():
            both = (held + own[window]) / (n + m)
            spread = np.sqrt(both * (1 - both) * (1 / n + 1 / m)) or 1e-9
            if held / m >= LIFT * (own[window] + 0.5) / n and held / m - own[window] / n >= SIGMAS * spread:
                told[window] = held
        base, extra = GAP + PAD + _content(own, ORDINARY_BYTES) + PAD, _content(told, TOXIC_BYTES)
        self.ordinary, self.toxic = base, extra + base

    def calibrate(self, counts: np.ndarray, profiles: np.ndarray, y: np.ndarray) -> None:
        """counts as from ``hits``, profiles and labels of texts that did not fill the dictionaries."""
        self.betas, losses, z = [], [], []
        for i in range(len(THRESHOLDS)):
            x = np.array([features(c[0], c[1 + i]) for c in counts])
            beta, loss = _curve(x, y)
            self.betas.append(beta)
            losses.append(round(loss, 9))
            z.append(x @ beta)
        best = int(np.argmin(losses))
        self.centres = _centres(profiles)
        group = _nearest(profiles, self.centres)
        self.rules: list[tuple[int, float]] = []
        known = []
        for g in range(len(self.centres)):
            clean, toxic = (group == g) & (y == 0), (group == g) & (y == 1)
            cuts = [_cut(v[clean]) for v in z]
            found = [int((v[toxic] > cut).sum()) for v, cut in zip(z, cuts)]
            i = min(range(len(z)), key=lambda k: (-found[k], losses[k]))
            self.rules.append((i, cuts[i]))
            known.append(int(clean.sum()) >= FEWEST)
        highest = max([_cut(z[best][y == 0]), *(_cut(z[best][(group == g) & (y == 0)]) for g in range(len(known)) if known[g])])
        self.rules = [rule if sure else (best, highest) for rule, sure in zip(self.rules, known)]

    def score(self, text: str | None, distance: Distance) -> float:
        i, cut = self.rules[int(_nearest(profile(text)[None, :], self.centres)[0])]
        saved = distance.all(windows(text))
        z = float(np.dot(features(len(saved), sum(x >= THRESHOLDS[i] for x in saved)), self.betas[i])) - cut - 1e-9
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _bounded(text: Column) -> Column:
    """The text, or seeded pieces of a long one, of at most ``MOST_BYTES`` bytes together."""
    length, part = MOST_BYTES // 4 // PIECES, F.floor(F.char_length(text) / PIECES).cast("int")
    start = lambda i: (part * i + 1 + F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(part - length, F.lit(1)))).cast("int")
    pieces = [F.substring(text, start(i), F.lit(length)) for i in range(PIECES)]
    return F.when(F.octet_length(text) <= MOST_BYTES, text).otherwise(F.concat_ws(" ", *pieces))


def _counted(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        distance = Distance(model.value.ordinary, model.value.toxic)
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "toxic": batch["toxic"], "counts": [hits(t, distance) for t in batch["text"]],
                "profile": [profile(t).astype(np.float32).tobytes() for t in batch["text"]],
            })

    return run


def learn(docs: DataFrame, labels: DataFrame, usable: Column) -> Model | None:
    """The model of a bounded sample; None without labelled rows of both kinds. ``usable`` is a column over doc_id."""
    spark = docs.sparkSession
    label = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.filter(F.octet_length("text") >= 1).select("doc_id", "text")
    named = docs.filter(usable & F.col("doc_id").isNotNull()).filter(F.octet_length("text") >= 1).select("doc_id").distinct().join(label, "doc_id")
    drawn = None
    for kind, most in ((1, MOST_TOXIC), (0, MOST_ORDINARY)):
        part = named.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        drawn = part if drawn is None else drawn.union(part)
    ids = sorted(drawn.collect(), key=lambda r: r["doc_id"])
    toxic, ordinary = ([r for r in ids if r["toxic"] == kind] for kind in (1, 0))
    if not toxic or not ordinary:
        return None
    few = len(toxic) < FEW_TOXIC or len(ordinary) < FEW_ORDINARY  # both steps then learn from all of them

    def named_texts(half: int) -> DataFrame:
        part = spark.createDataFrame([tuple(r) for r in (toxic + ordinary if few else toxic[half::2] + ordinary[half::2])], drawn.schema)
        return texts.join(F.broadcast(part), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    rows = named_texts(0).select("doc_id", "toxic", _bounded(F.col("text")).alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    model = Model(*([r["text"] for r in rows if r["toxic"] == kind] for kind in (0, 1)))
    sent = spark.sparkContext.broadcast(model)
    told = named_texts(1).select(F.col("doc_id").cast("string").alias("doc_id"), "toxic", "text")
    counted = told.mapInPandas(_counted(sent), "doc_id string, toxic int, counts array<bigint>, profile binary").collect()
    counted.sort(key=lambda r: r["doc_id"])
    model.calibrate(
        np.array([r["counts"] for r in counted]), np.array([np.frombuffer(r["profile"], dtype=np.float32) for r in counted], dtype=float),
        np.array([float(r["toxic"]) for r in counted]),
    )
    return model


def _score(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trained: Model | None = model.value
        distance = Distance(trained.ordinary, trained.toxic) if trained else None
        for batch in batches:
            scores = [trained.score(t, distance) if trained else 0.0 for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "th": batch["th"], "held_out": batch["held_out"], "score": scores})

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """``doc_id, th, held_out, score, predicted`` per row; learned from labelled rows that are not held out."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, ~held_out))
    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("th"), held_out.alias("held_out"), "text")
    told = slim.mapInPandas(_score(model), "doc_id string, th bigint, held_out boolean, score double")
    told = told.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return told.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
