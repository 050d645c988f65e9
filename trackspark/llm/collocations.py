"""Phrases of two to four words that stick together, counted in counting quotient filters.

* Words are counted per language first (a dictionary a block, ``blocks.py``). A word below ``min_count`` can be in no
  candidate; every other (language, word) gets a number, so a number tells the language too.
* An n-gram is its packed numbers. A Feistel network permutes them, and can be run backwards: the top bits are the
  quotient, all other bits the remainder, so nothing is lost and the counts are exact.
* Every block is a shard with a filter of its own: sorted by quotient, run lengths per quotient, full remainders, counters.
  Parts of the quotient space are merged across shards: sorted runs of equal keys add up.
* A merged part tells each shard which of its n-grams reach ``min_count``. The next length counts only where both its
  parts of one word less do, so rare combinations are never counted.
* Cuts, scores and the absorption by longer phrases are joins over the phrases that reached ``min_count``.

Memory: one block, or one part of the words or of the filters. A phrase or word travels once per block, however frequent.

Defined cases: a null text is empty, a null language is ``und`` (and one with rows that say so). Rows that repeat a
document count each. Words hold every character but blank, tab and the separators. A language without candidates has
no row. An empty table gives no row. Only doc_id, text and lang are read; other columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.llm.blocks import (
    BLOCK_CHARS, BLOCK_WORDS, Blocks, ask_words, by_part, key_order, loosen, mixed, numbers_of, part_bits, part_slices, parts_of, rows_of, squeeze, unpack_words,
)
from trackspark.scale import total_order
from trackspark.session import cut_lineage

#: Ends a piece; no word can hold it.
STOP = "."
#: Keys of a part of the filters.
GRAMS = 1 << 20
_BREAK = re.compile(r"[.,;:!?\x0A-\x0D]+")
_WORD = re.compile(r"[^\x20\x09]+")
#: Characters that str.split() takes for white space beyond blank, tab and the separators.
_ODD = re.compile(r"[\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]")
ROUNDS = 4
SCALE = 2_000_000


def pieces(text: str) -> list[str]:
    """The words of the text, lower-cased, with ``STOP`` behind every piece."""
    cut = _BREAK.sub(f" {STOP} ", text.encode().lower().decode())  # bytes know no other letters than A-Z
    return [*(_WORD.findall(cut) if _ODD.search(cut) else cut.split()), STOP]


# Quotient filters


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def pack(grams: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of ``width`` bits side by side, as two halves of ``h`` bits each."""
    if width * len(grams) > 128:
        raise ValueError("a phrase needs more than 128 bits")
    high, low = np.zeros_like(grams[0]), np.zeros_like(grams[0])
    for g in grams:
        high = (high << np.uint64(width)) | (low >> np.uint64(64 - width))
        low = (low << np.uint64(width)) | g
    h = (width * len(grams) + 1) // 2
    if h == 64:
        return high, low, h
    return ((low >> np.uint64(h)) | (high << np.uint64(64 - h))) & _mask(h), low & _mask(h), h


def unpack(left: np.ndarray, right: np.ndarray, h: int, n: int, width: int) -> np.ndarray:
    """The numbers again, one row per n-gram."""
    low = right if h == 64 else right | (left << np.uint64(h))
    high = left if h == 64 else left >> np.uint64(64 - h)
    out = np.empty((len(left), n), np.uint64)
    for i in reversed(range(n)):
        out[:, i] = low & _mask(width)
        low = (low >> np.uint64(width)) | (high << np.uint64(64 - width))
        high = high >> np.uint64(width)
    return out


def _turned(half: np.ndarray, turn: int, h: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(half + np.uint64(0x9E3779B97F4A7C15) * np.uint64(turn + 1)) & _mask(h)


def permute(left: np.ndarray, right: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    for turn in range(ROUNDS):
        left, right = right, left ^ _turned(right, turn, h)
    return left, right


def restore(left: np.ndarray, right: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    for turn in reversed(range(ROUNDS)):
        left, right = right ^ _turned(left, turn, h), left
    return left, right


def merged(left: np.ndarray, right: np.ndarray, h: int, counts: np.ndarray | None = None):
    """Distinct keys in order with their summed counters, and the place of every input among them."""
    if 2 * h <= 64:
        key = (left << np.uint64(h)) | right
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])[: len(key)]
    else:
        order = np.lexsort((right, left))
        l, r = left[order], right[order]
        new = np.concatenate([[True], (l[1:] != l[:-1]) | (r[1:] != r[:-1])])[: len(l)]
    starts = np.flatnonzero(new)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    ones = np.ones(len(order), np.int64) if counts is None else counts[order]
    sums = np.add.reduceat(ones, starts) if len(starts) else np.zeros(0, np.int64)
    return left[order][starts], right[order][starts], sums, place


def write_filter(left: np.ndarray, right: np.ndarray, counts: np.ndarray, h: int, bits: int) -> tuple[int, bytes]:
    """Quotient bits, and a part of a filter: runs per quotient, remainders in two lanes, counters.

    The part's own ``bits`` lead the quotient and are left out; what follows them is as long as the part has entries.
    """
    q = min(h - bits, max(0, int(len(left) - 1).bit_length()))
    quotient = (left >> np.uint64(h - bits - q)) & _mask(q)
    runs = np.bincount(quotient.astype(np.int64), minlength=1 << q).astype(np.uint32)
    lanes = [runs, left & _mask(h - bits - q), right, counts.astype(np.uint64)]
    blobs = [squeeze(lane) for lane in lanes]
    return q, b"".join(len(b).to_bytes(8, "little") + b for b in blobs)


def read_filter(data: bytes, q: int, part: int, h: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blobs, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        blobs.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    runs, low, right, counts = (loosen(b, kind) for b, kind in zip(blobs, (np.uint32, np.uint64, np.uint64, np.uint64)))
    quotient = np.repeat(np.arange(len(runs), dtype=np.uint64), runs)
    left = low | (quotient << np.uint64(h - bits - q))
    if bits:
        left = left | (np.uint64(part) << np.uint64(h - bits))
    return left, right, counts.astype(np.int64)


# Words


def _vocabulary(min_count: int, bits: int):
    """Per part: numbers of the frequent words for every block, then one row that names them and counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in parts_of(batches):
            held: Counter = Counter()
            totals: Counter = Counter()
            asked = []
            for row in rows:
                owner = loosen(row["word_groups"], np.uint32).tolist()
                keys = [(row["groups"][g], w) for g, w in zip(owner, unpack_words(row["words"]))]
                for key, count in zip(keys, loosen(row["counts"], np.int64).tolist()):
                    if key[1] != STOP.encode():
                        held[key] += count
                        totals[key[0]] += count
                asked.append((row["block"], keys))
            named = sorted(key for key, count in held.items() if count >= min_count)
            number = {key: (i << bits | part) + 1 for i, key in enumerate(named)}
            for block, keys in asked:
                yield _word_rows(part, block, squeeze(np.fromiter((number.get(k, 0) for k in keys), np.uint64, len(keys))), [], [], [])
            words = [(*key, number[key], held[key]) for key in named]
            yield _word_rows(part, None, None, words, list(totals), list(totals.values()))

    return run


_WORDS = "part bigint, block bigint, answer binary, lang array<string>, word array<string>, id array<bigint>, held array<bigint>, langs array<string>, totals array<bigint>"


def _word_rows(part, block, answer, words: list[tuple], langs: list[str], totals: list[int]) -> pa.RecordBatch:
    lang, word, number, held = zip(*words) if words else ((), (), (), ())
    text, ints = pa.list_(pa.string()), pa.list_(pa.int64())
    kinds = (pa.int64(), pa.int64(), pa.binary(), text, text, ints, ints, text, ints)
    values = (part, block, answer, list(lang), [w.decode() for w in word], list(number), list(held), langs, totals)
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in _WORDS.split(", ")])


# Phrases


def _block_grams(row: dict, n: int, width: int):
    """Keys of the block's n-grams whose shorter parts all are frequent, and where they start."""
    words = unpack_words(row["words"])
    ids = np.empty(len(words), np.uint64)
    ids[key_order(words)[1]] = np.concatenate([np.zeros(0, np.uint64), *[loosen(a, np.uint64) for a in row["answer0"] or []]])
    text = ids[numbers_of(row)]
    good = text > 0
    for length in range(2, n + 1):
        at = np.flatnonzero(good[:-1] & good[1:])
        left, right, h = pack([text[at + i] for i in range(length)], width)
        left, right, counts, place = merged(*permute(left, right, h), h)
        if length == n:
            return left, right, counts, h
        told = row[f"answer{length - 1}"] or []
        bits = np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(a, np.uint8), count=None).astype(bool)[: int.from_bytes(a[-8:], "little")] for a in told]])
        good = np.zeros(len(text), bool)
        good[at] = bits[place]


def _ask_grams(n: int, width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            left, right, counts, h = _block_grams(row, n, width)
            out = []
            for part, a, b in part_slices(left << np.uint64(64 - h), bits):
                out.append((part, row["block"], *write_filter(left[a:b], right[a:b], counts[a:b], h, bits)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out) if out else [()] * 4, kinds)], ["part", "block", "q", "held"])

    return run


def _merge_grams(n: int, width: int, bits: int, min_count: int):
    """Per part: which keys of every block are frequent, then one row with the frequent n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = (width * n + 1) // 2
        for part, rows in parts_of(batches):
            read = [read_filter(r["held"], r["q"], part, h, bits) for r in rows]
            left, right, counts, place = merged(*(np.concatenate([x[i] for x in read]) for i in (0, 1)), h, np.concatenate([x[2] for x in read]))
            frequent, at = counts >= min_count, 0
            told = frequent[place]
            for row, own in zip(rows, read):
                size = len(own[0])
                yield _gram_row(part, row["block"], np.packbits(told[at : at + size]).tobytes() + size.to_bytes(8, "little"), [], [])
                at += size
            grams = unpack(*restore(left[frequent], right[frequent], h), h, n, width)
            yield _gram_row(part, None, None, grams.astype(np.int64).tolist(), counts[frequent].tolist())

    return run


_GRAMS = "part bigint, block bigint, answer binary, grams array<array<bigint>>, held array<bigint>"


def _gram_row(part, block, answer, grams: list, held: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((part, block, answer, grams, held), kinds)], ["part", "block", "answer", "grams", "held"])


class Counts:
    """Frequent words and phrases of every language with their exact counts."""

    def __init__(self, docs: DataFrame, min_count: int, longest: int, chars: int, words: int) -> None:
        blocks = Blocks(docs, pieces, F.coalesce(F.col("lang").cast("string"), F.lit("und")), chars, words)
        bits = part_bits(blocks.words)
        told = cut_lineage(by_part(ask_words(blocks, bits, counted=True), bits).mapInArrow(_vocabulary(min_count, bits), _WORDS))
        answers = [told.filter("block is not null").select("block", "part", "answer")]
        told = told.filter("block is null")
        named = told.select(F.explode(F.arrays_zip("lang", "word", "id", "held")).alias("w")).select("w.*")
        self.words = cut_lineage(named.select(F.col("id"), "lang", "word", F.col("held").alias("f")))
        self.totals = told.select(F.explode(F.arrays_zip("langs", "totals")).alias("t")).groupBy(F.col("t.langs").alias("lang")).agg(F.sum("t.totals").alias("n"))
        width = max(1, int(self.words.agg(F.max("id")).first()[0] or 1).bit_length())
        phrases = self.words.select(F.array("id").alias("ids"), "f")
        for n in range(2, longest + 1):
            h = (width * n + 1) // 2
            cut = min(h, part_bits(blocks.total, GRAMS))
            rows = blocks.answered(*answers).select("block", "numbers", "words", *[f"answer{i}" for i in range(n - 1)])
            asks = by_part(rows.mapInArrow(_ask_grams(n, width, cut), "part bigint, block bigint, q int, held binary"), cut)
            told = cut_lineage(asks.mapInArrow(_merge_grams(n, width, cut, min_count), _GRAMS))
            answers.append(told.filter("block is not null").select("block", "part", "answer"))
            found = told.filter("block is null").select(F.explode(F.arrays_zip("grams", "held")).alias("g"))
            phrases = phrases.union(found.select(F.col("g.grams"), F.col("g.held")))
        self.phrases = cut_lineage(phrases)


def mine(
    docs: DataFrame, min_count: int = 30, longest: int = 4, absorb: int = 80, top: int = 2000, chars: int = BLOCK_CHARS, words: int = BLOCK_WORDS
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases by score, count and text."""
    counts = Counts(docs, min_count, longest, chars, words)
    held = counts.phrases
    candidates = held.filter(F.size("ids") > 1).withColumnRenamed("f", "a")
    cuts = candidates.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("first"), F.slice("ids", F.col("k") + 1, F.size("ids")).alias("rest"))
    cuts = cuts.join(held.select(F.col("ids").alias("first"), F.col("f").alias("l")), "first").join(held.select(F.col("ids").alias("rest"), F.col("f").alias("r")), "rest")
    # decimals: the product may pass 64 bits, the quotient is at most SCALE / 2
    cuts = cuts.withColumn("score", F.expr(f"cast({SCALE} as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    lowest = cuts.groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inside = candidates.filter(F.size("ids") > 2).withColumn("size", F.explode(F.sequence(F.lit(2), F.size("ids") - 1)))
    inside = inside.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("ids") - F.col("size") + 1)))
    longer = inside.groupBy(F.slice("ids", F.col("at"), F.col("size")).alias("ids")).agg(F.max("a").alias("longer"))
    kept = lowest.join(longer, "ids", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < absorb * F.col("a")))

    spelled = kept.select("ids", "a", "cut", F.posexplode("ids").alias("at", "id")).join(counts.words.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("ids").agg(
        F.first("a").alias("a"), F.first("cut").alias("cut"), F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words")
    )
    spelled = spelled.select("lang", F.array_join(F.transform("words", lambda x: x["word"]), " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    # ranks come from ranges of the full order, so that a language with most of the phrases is many tasks
    ordered = total_order(spelled.withColumns({"_score": -F.col("score"), "_a": -F.col("a")}), ["lang", "_score", "_a", "phrase"], "at")
    starts = ordered.groupBy("lang").agg(F.min("at").alias("start"))
    ranked = ordered.join(starts, "lang").withColumn("rank", F.col("at") - F.col("start") + 1).filter(F.col("rank") <= top).join(counts.totals, "lang")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
