"""Near-duplicates by fast similarity sketching, banding and exact verification.

* Sketch: round ``i`` hashes every shingle to one bin; the first ``t`` rounds draw the bin, the next ``t`` rounds fill
  bin ``i - t`` with the smallest hash, so every coordinate fills. A coordinate keeps the smallest (round, hash).
  Long texts fill all bins in the first rounds: the work is about n + t log t, not n * t.
* Bands of ``rows`` coordinates; two sets at the limit share no band with probability
  (1 - limit ** rows) ** bands, 2.4e-7 with 26 bands of 5 at 0.85.
* Texts with equal sets are one class; everything below works on classes.
* Each class of a bucket is held against the bucket's smallest class (a star, not all pairs). Links are exact: whole
  sets of 64-bit shingle hashes are intersected. Connected components of those links come next.
* Only buckets that still hold several components are looked at again: blocks of at most ``BLOCK`` classes meet block
  by block inside a task, which answers with links between different components only. No pair list is ever written.

Defined cases: null or empty texts have an empty set, link with nothing and stand for themselves. Rows without doc_id
take no part, as nothing could name them: null component, kept. Rows that repeat a doc_id are each judged by their own
text. Only doc_id and text are read; other columns may have any name. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.llm.text import ASCII_LOWER, WORD_RE, packed
from trackspark.scale import connected_components
from trackspark.session import cut_lineage

BANDS, ROWS = 26, 5
BLOCK = 256
STAR = 4096
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public domain splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; short texts are one shingle."""
    words = WORD_RE.findall((text or "").translate(ASCII_LOWER))
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(width, len(words))
    n = len(words) - span + 1
    with np.errstate(over="ignore"):
        rolled = np.full(n, np.uint64(span) * _GOLD, np.uint64)
        for i in range(span):
            rolled = _mixed(rolled + each[i : i + n])
    return np.unique(rolled)


def sketch(shingles: np.ndarray, bins: int, seed: int = 1) -> np.ndarray:
    """``bins`` coordinates of a non-empty set; two sets agree in a coordinate with their Jaccard similarity."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(bins, top, np.uint64)
    empty = bins
    for turn in range(2 * bins):
        with np.errstate(over="ignore"):
            h = _mixed(shingles + np.uint64((seed << 32) + turn + 1) * _GOLD)
        # the round goes in front of the hash: earlier rounds always win a bin
        value = (np.uint64(turn) << np.uint64(48)) | (h >> np.uint64(16))
        if turn < bins:
            place = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(bins)) >> np.uint64(32)
            np.minimum.at(best, place.astype(np.int64), value)
        else:
            best[turn - bins] = min(best[turn - bins], value.min())
        empty = int((best == top).sum())
        if not empty:
            break
    return best


def _sketch_rows(width: int, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = np.arange(1, bands + 1, dtype=np.uint64)
        power = np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            sizes, classes, keys = [], [], []
            for text in batch["text"]:
                s = shingle_hashes(text, width)
                sizes.append(len(s))
                if not len(s):
                    classes.append(None)
                    keys.append([])
                    continue
                classes.append(xxhash.xxh3_128_digest(s.tobytes()))
                with np.errstate(over="ignore"):
                    lanes = _mixed(sketch(s, bands * rows).reshape(bands, rows) * power)
                    keys.append(_mixed(lanes.sum(axis=1, dtype=np.uint64) + salt * _GOLD).view(np.int64))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "th": batch["th"], "n_shingles": sizes, "set_id": classes, "bands": keys})

    return run


def sketches(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, th, n_shingles, set_id, bands`` per row; ``set_id`` is a 128-bit digest of the shingle set."""
    schema = "doc_id string, th bigint, n_shingles bigint, set_id binary, bands array<bigint>"
    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return slim.mapInPandas(_sketch_rows(width, bands, rows), schema).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _set_rows(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "words": [shingle_hashes(t, width).tobytes() for t in batch["text"]]})

    return run


def _star_links(percent: int):
    """Rows come sorted by hub: the hub's own set first, then its members."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, hubs = None, []
        for batch in batches:
            found = []
            for hub, member, identity, words in zip(batch["hub"], batch["member"], batch["id"], batch["words"]):
                own = np.frombuffer(words, np.uint64)
                if hub != at:
                    at, hubs = hub, []
                if not member:
                    hubs.append(own)
                elif any(similar(h, own, percent) for h in hubs):
                    found.append((hub, identity))
            yield pd.DataFrame(found, columns=["src", "dst"])

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test on sorted distinct hashes."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _links_inside(rows: list[tuple], percent: int, left: int, right: int) -> list[tuple]:
    """Links between different components among the rows of one or two blocks."""
    sets = [np.frombuffer(r[2], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets], np.int64)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(codes)
    owner = np.repeat(np.arange(len(rows)), sizes)
    wide = shared[codes] > 1
    codes, owner = codes[wide], owner[wide]
    labels = np.unique(np.array([r[1] for r in rows]), return_inverse=True)[1]
    side = np.array([r[3] for r in rows])
    both = np.zeros((len(rows), len(rows)), np.float32)
    kept, codes = np.unique(codes, return_inverse=True)
    for start in range(0, len(kept), 4096):  # columns in strips: memory stays at rows x 4096
        inside = (codes >= start) & (codes < start + 4096)
        strip = np.zeros((len(rows), 4096), np.float32)
        strip[owner[inside], codes[inside] - start] = 1
        both += strip @ strip.T
    union = sizes[:, None] + sizes[None, :] - both
    linked = (100 * both >= percent * union) & (labels[:, None] != labels[None, :])
    if left != right:
        linked &= side[:, None] != side[None, :]
    a, b = np.nonzero(np.triu(linked, 1))
    seen, found = set(), []
    for i, j in zip(a, b):  # one link between two components is enough
        pair = (min(labels[i], labels[j]), max(labels[i], labels[j]))
        if pair not in seen:
            seen.add(pair)
            found.append((rows[i][0], rows[j][0]))
    return found


def _block_links(percent: int):
    """Rows come sorted by (bucket, left, right); each such group holds two blocks at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows = None, []
        for batch in batches:
            found = []
            for bucket, left, right, identity, label, words, side in zip(*[batch[c] for c in ("bucket", "left", "right", "id", "component", "words", "side")]):
                if (bucket, left, right) != at:
                    if len(rows) > 1:
                        found += _links_inside(rows, percent, at[1], at[2])
                    at, rows = (bucket, left, right), []
                rows.append((identity, label, words, side))
            yield pd.DataFrame(found, columns=["src", "dst"])
        if len(rows) > 1:
            yield pd.DataFrame(_links_inside(rows, percent, at[1], at[2]), columns=["src", "dst"])

    return run


def _label(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members with their component; a class without links is its own."""
    return members.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _components(links: DataFrame) -> DataFrame:
    ends = links.select(F.col("src").alias("id")).union(links.select(F.col("dst").alias("id"))).distinct()
    return connected_components(ends, links)


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, th, n_shingles, component_id, kept`` per input row (``th``: xxhash64 of the text)."""
    drawn = cut_lineage(sketches(docs, width, bands, rows))
    named = drawn.filter(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    classes = named.groupBy("set_id").agg(F.min(F.struct("doc_id", "th")).alias("own"), F.max("n_shingles").alias("n"), F.max("bands").alias("bands"))
    classes = cut_lineage(classes.select("set_id", F.col("own.doc_id").alias("id"), F.col("own.th").alias("th"), "n", "bands"))

    placed = classes.select("id", "n", F.explode("bands").alias("bucket"))
    hubs = placed.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("hub"), F.count(F.lit(1)).alias("held")).filter(F.col("held") > 1)
    members = cut_lineage(placed.join(hubs, "bucket").select("bucket", "id", "n", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"), "held"))
    fits = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    stars = cut_lineage(members.filter((F.col("id") != F.col("hub")) & fits).select("hub", "id").distinct())

    wanted = members.filter(F.col("held") > 2).select("id").union(stars.select("id")).union(stars.select(F.col("hub").alias("id"))).distinct()
    owners = classes.join(wanted, "id").select(F.col("id").alias("doc_id"), "th")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    sets = texts.join(owners, ["doc_id", "th"]).select(F.col("doc_id").alias("id"), "text")
    sets = cut_lineage(sets.mapInPandas(_set_rows(width), "id bigint, words binary"))

    sized = stars.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
    spread = stars.join(sized, "hub").select("hub", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(True).alias("member"), "id")
    centres = sized.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"), F.col("hub").alias("id"))
    rays = spread.union(centres).join(sets, "id").repartition("hub", "part").sortWithinPartitions("hub", "part", "member")
    links = cut_lineage(rays.select("hub", "member", "id", "words").mapInPandas(_star_links(percent), "src bigint, dst bigint"))

    labelled = _label(members.filter(F.col("held") > 2).select("bucket", "id", "held"), _components(links))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter(F.col("low") != F.col("high"))
    open_ = labelled.join(mixed.select("bucket"), "bucket").withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int"))
    open_ = open_.withColumn("side", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    met = open_.select("bucket", "id", "component", "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("bucket", F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right"), "id", "component", "side")
    met = met.join(sets, "id").repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right")
    links = cut_lineage(links.union(met.mapInPandas(_block_links(percent), "src bigint, dst bigint")))

    parts = _label(classes.select("set_id", "id"), _components(links)).select("set_id", F.col("component").alias("found"))
    told = drawn.join(parts, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    told = told.withColumn("component_id", component)
    return told.select("doc_id", "th", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The input's rows and columns, one document of each group; identical rows stay once."""
    stay = near_duplicates(docs, width, percent).filter("kept").select(F.col("doc_id").alias("k_doc"), F.col("th").alias("k_th")).distinct()
    rows = packed(docs).select("row", F.col("row.doc_id").cast("bigint").alias("doc"), F.xxhash64("row.text").alias("th"))
    once = rows.groupBy("doc", "th").agg(F.first("row").alias("row"))
    return once.join(stay, F.col("doc").eqNullSafe(F.col("k_doc")) & (F.col("th") == F.col("k_th")), "left_semi").select("row.*")
