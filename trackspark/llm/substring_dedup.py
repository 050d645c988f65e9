"""Exact repeats of at least ``window`` words, removed from all but the smallest document that starts them.

* Anchors: the non-overlapping blocks of ``window // 2`` words of every document are indexed by a hash. A window of
  ``window`` words always holds a whole block of the document it stands in, wherever it starts.
* Probes: every rolling window of ``window // 2`` words of every document asks the index. A hit is one that is an
  anchor somewhere and occurs in two documents at least.
* Extension: hits grow word by word over all windows of ``window`` words around them. Windows are compared as 128-bit
  keys (96 bits and the part of the key space); each key learns the smallest document that starts it, so a passage
  that thousands share costs one key per block and no pairs. Neighbouring repeated windows join to maximal repeats.

Documents are written once as blocks of local word numbers (``blocks.py``) and stay there; only sorted hashes travel.
Hashes of probes are cut to the bits that keep false hits below one in a thousand; a false hit costs a comparison.

Defined cases: null and empty texts have no words, keep nothing and hash as ''. Texts shorter than a window are kept.
Documents without doc_id count as larger than all others and never remove each other's words. Rows that share a
doc_id do not remove each other's words, as none is smaller. Only doc_id and text are read; other columns may have
any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.llm.blocks import (
    BLOCK_CHARS, BLOCK_WORDS, Blocks, by_part, loosen, mixed, numbers_of, part_bits, part_slices, parts_of, rows_of, squeeze, unpack_words, word_hashes,
)
from trackspark.llm.text import WORD_RE
from trackspark.session import cut_lineage

WINDOW = 50
#: Keys of a part: probes are four bytes each, so parts may be larger than those of a dictionary.
PROBES = 1 << 21
LAST = np.iinfo(np.int64).max
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(29)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` words from every place on, put together from halves; the last places are left out."""
    if width == 1:
        return hashes
    half = rolling(hashes, width // 2)
    n = max(0, len(hashes) - width + 1)
    with np.errstate(over="ignore"):
        both = mixed((half[:n] << _TURN | half[:n] >> np.uint64(64 - 29)) + half[width // 2 :][:n] * _GOLD + np.uint64(width))
        if width % 2:
            both = mixed((both << _TURN | both >> np.uint64(64 - 29)) + hashes[width - 1 :][:n])
    return both


class Texts:
    """A block's words side by side."""

    def __init__(self, row: dict, window: int) -> None:
        self.words = unpack_words(row["words"])
        self.numbers = numbers_of(row)
        sizes = np.array(row["sizes"], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.ids = np.array([int(d) if d else LAST for d in row["docs"]], np.int64)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.left = self.ends[self.owner] - np.arange(len(self.owner))  # words from here to the end of the document
        self.window, self.anchor = window, window // 2

    def rolled(self, width: int, seed: int) -> np.ndarray:
        return rolling(word_hashes(self.words, seed)[self.numbers], width)

    def probes(self):
        """Distinct hashes in order, whether each is an anchor, whether two documents hold it; places and their entry."""
        hashes = self.rolled(self.anchor, 1)
        at = np.flatnonzero(self.left[: len(hashes)] >= self.anchor)
        order = np.argsort(hashes[at], kind="stable")
        sorted_, owner = hashes[at][order], self.owner[at][order]
        first = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])[: len(order)]
        starts = np.flatnonzero(first)
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(first) - 1
        anchored = ((at - self.starts[self.owner[at]]) % self.anchor == 0)[order]
        if not len(starts):
            return sorted_, np.zeros(0, bool), np.zeros(0, bool), at, entry
        several = np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts)
        return sorted_[starts], np.logical_or.reduceat(anchored, starts), several, at, entry

    def windows(self, row: dict):
        """Windows around hits: distinct keys in order (two lanes), smallest document of each, places and their entry."""
        keys, _, _, at, entry = self.probes()
        hit = np.zeros(len(self.owner) + 1, np.int64)
        hit[at] = answer_bits(row["answer0"], len(keys))[entry]
        upto = np.concatenate([[0], np.cumsum(hit)])
        places = np.flatnonzero(self.left >= self.window)
        reach = self.window - self.anchor + 1  # anchors that start in the window and end in it
        places = places[upto[places + reach] > upto[places]]
        if not len(places):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), places, places
        low, high = (self.rolled(self.window, seed)[places] for seed in (2, 3))
        order = np.lexsort((low, high))
        high_, low_ = high[order], low[order]
        first = np.concatenate([[True], (high_[1:] != high_[:-1]) | (low_[1:] != low_[:-1])])
        starts = np.flatnonzero(first)
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(first) - 1
        smallest = np.minimum.reduceat(self.ids[self.owner[places]][order], starts)
        return high_[starts], low_[starts], smallest, places, entry


def answer_bits(answers: list[bytes] | None, size: int) -> np.ndarray:
    """One bit per key, in the order of the keys."""
    parts = [np.unpackbits(np.frombuffer(a, np.uint8, offset=8), count=int.from_bytes(a[:8], "little")) for a in answers or []]
    bits = np.concatenate([np.zeros(0, np.uint8), *parts]).astype(bool)
    if len(bits) != size:
        raise ValueError("an answer is missing")
    return bits


def _as_answer(bits: np.ndarray) -> bytes:
    return len(bits).to_bytes(8, "little") + np.packbits(bits).tobytes()


_ASK = "part bigint, block bigint, low binary, high binary, flags binary"


def _batch(rows: list[tuple], *kinds) -> pa.RecordBatch:
    names, types = zip(*kinds)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows) if rows else [()] * len(types), types)], list(names))


_ASK_KINDS = (("part", pa.int64()), ("block", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("flags", pa.binary()))
_ANSWER_KINDS = (("part", pa.int64()), ("block", pa.int64()), ("answer", pa.binary()))
_ANSWER = "part bigint, block bigint, answer binary"


def _ask_probes(window: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            keys, anchored, several, _, _ = Texts(row, window).probes()
            low = ((keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)  # the bits behind those of the part
            flags = anchored.astype(np.uint8) | (several.astype(np.uint8) << 1)
            yield _batch([(part, row["block"], squeeze(low[a:b]), None, squeeze(flags[a:b])) for part, a, b in part_slices(keys, bits)], *_ASK_KINDS)

    return run


def _answer_probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key is a hit if it is an anchor somewhere and two documents hold it."""
    for part, rows in parts_of(batches):
        read = [(loosen(r["low"], np.uint32), loosen(r["flags"], np.uint8)) for r in rows]
        keys, flags = (np.concatenate([x[i] for x in read]) for i in (0, 1))
        order = np.argsort(keys, kind="stable")
        first = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
        starts = np.flatnonzero(first)
        anchored = np.maximum.reduceat((flags & 1)[order], starts) > 0
        held = np.add.reduceat(1 + (flags >> 1)[order].astype(np.int64), starts) > 1
        told = np.empty(len(keys), bool)
        told[order] = (anchored & held)[np.cumsum(first) - 1]
        ends = np.cumsum([len(x[0]) for x in read])
        yield _batch([(part, r["block"], _as_answer(bits)) for r, bits in zip(rows, np.split(told, ends[:-1]))], *_ANSWER_KINDS)


def _ask_windows(window: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            high, low, smallest, _, _ = Texts(row, window).windows(row)
            low = low.astype(np.uint32)
            yield _batch([(part, row["block"], squeeze(low[a:b]), squeeze(high[a:b]), squeeze(smallest[a:b])) for part, a, b in part_slices(high, bits)], *_ASK_KINDS)

    return run


def _answer_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bit per key: a document of another block, smaller than the block's own smallest, starts the window."""
    for part, rows in parts_of(batches):
        read = [(loosen(r["low"], np.uint32), loosen(r["high"], np.uint64), loosen(r["flags"], np.int64)) for r in rows]
        low, high, own = (np.concatenate([x[i] for x in read]) for i in (0, 1, 2))
        order = np.lexsort((low, high))
        l, h = low[order], high[order]
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (l[1:] != l[:-1])])
        starts = np.flatnonzero(first)
        told = np.empty(len(own), bool)
        told[order] = np.minimum.reduceat(own[order], starts)[np.cumsum(first) - 1] < own[order]
        ends = np.cumsum([len(x[0]) for x in read])
        yield _batch([(part, r["block"], _as_answer(bits)) for r, bits in zip(rows, np.split(told, ends[:-1]))], *_ANSWER_KINDS)


_OUT_KINDS = (
    ("doc_id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
    ("repeats", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string()),
)
_OUT = "doc_id bigint, th bigint, n_words bigint, n_removed bigint, repeats array<struct<start:bigint,end:bigint>>, kept_text string"


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            texts = Texts(row, window)
            keys, _, smallest, places, entry = texts.windows(row)
            elsewhere = answer_bits(row["answer1"], len(keys))
            own = texts.ids[texts.owner[places]]
            repeated = places[elsewhere[entry] | (smallest[entry] < own)]
            edge = np.zeros(len(texts.owner) + window + 1, np.int64)
            np.add.at(edge, repeated, 1)
            np.add.at(edge, repeated + window, -1)
            gone = np.cumsum(edge)[: len(texts.owner)] > 0
            words = [w.decode() for w in texts.words]
            out, size = [], 0
            for i, (a, b) in enumerate(zip(texts.starts, texts.ends)):
                lost = gone[a:b]
                turns = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(np.int8), [0]])))
                kept = " ".join([words[k] for k in texts.numbers[a:b][~lost].tolist()])
                spans = [{"start": s, "end": e} for s, e in turns.reshape(-1, 2).tolist()]
                out.append((int(row["docs"][i]) if row["docs"][i] else None, row["ths"][i], int(b - a), int(lost.sum()), spans, kept))
                size += len(kept)
                if size >= 1 << 22:
                    yield _batch(out, *_OUT_KINDS)
                    out, size = [], 0
            yield _batch(out, *_OUT_KINDS)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, chars: int = BLOCK_CHARS, words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, th, n_words, n_removed, repeats, kept_text`` per row (``th``: xxhash64 of the text).

    ``repeats`` are the maximal runs of removed words, as [start, end) word positions.
    """
    blocks = Blocks(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), WORD_RE.findall, chars=chars, words=words)
    bits = min(32, part_bits(blocks.total, PROBES))
    asks = blocks.rows.select("block", "docs", "sizes", "numbers", "words").mapInArrow(_ask_probes(window, bits), _ASK)
    hits = cut_lineage(by_part(asks.select("part", "block", "low", "flags"), bits).mapInArrow(_answer_probes, _ANSWER))

    rows = blocks.answered(hits).select("block", "docs", "sizes", "numbers", "words", "answer0")
    asks = by_part(rows.mapInArrow(_ask_windows(window, bits), _ASK), bits)
    shared = cut_lineage(asks.mapInArrow(_answer_windows, _ANSWER))

    rows = blocks.answered(hits, shared).select("block", "docs", "ths", "sizes", "numbers", "words", "answer0", "answer1")
    return rows.mapInArrow(_remove(window), _OUT)
