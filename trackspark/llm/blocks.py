"""Texts in blocks with dictionaries of their own, and questions of all blocks answered by parts.

A block is some documents of one input task: their words as local numbers, and the distinct words behind the numbers.
Blocks are one table in the shared folder, bucketed by block: they are read where they lie and never shuffled. What
travels are sorted lists of distinct keys (words, hashes, counters), cut into ``parts`` of the key space. The task of a
part sees a key once per block at most, however frequent it is, and returns one answer per key and block. A block
meets its answers by its number.

Block numbers come from the task and its place in it; they are read from the written table only, so a rerun task
cannot change them.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.session import shared_dir

BLOCK_CHARS, BLOCK_WORDS = 8 << 20, 400_000
#: Input bytes behind one bucket, buckets at most (Spark's own limit), and estimates that stand for "unknown".
BUCKET_BYTES, MOST_BUCKETS, UNKNOWN_SIZE = 128 << 20, 100_000, 1 << 60
#: Keys in a part, counted once per block that holds them.
PART_KEYS = 1 << 18
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ROW = pa.schema([
    ("block", pa.int64()), ("docs", pa.list_(pa.string())), ("ths", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("numbers", pa.binary()),
    ("n_words", pa.int64()), ("n_total", pa.int64()), ("words", pa.binary()), ("groups", pa.list_(pa.string())), ("word_groups", pa.binary()),
])
_DDL = (
    "block bigint, docs array<string>, ths array<bigint>, sizes array<int>, numbers binary, n_words bigint, n_total bigint, words binary, "
    "groups array<string>, word_groups binary"
)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public domain splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def squeeze(values: np.ndarray) -> bytes:
    """Compressed numbers, bytes of equal weight side by side."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def loosen(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_words(words: list[bytes]) -> bytes:
    sizes = squeeze(np.fromiter(map(len, words), np.uint32, len(words)))
    return len(sizes).to_bytes(8, "little") + sizes + zstandard.ZstdCompressor(level=3).compress(b"".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    at = 8 + int.from_bytes(data[:8], "little")
    ends = np.cumsum(loosen(data[8:at], np.uint32), dtype=np.int64).tolist()
    raw = zstandard.ZstdDecompressor().decompress(data[at:])
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


class Numbers(dict):
    """Words to numbers, in the order they are met; several may share one counter."""

    def __init__(self, count: Iterator[int]) -> None:
        self.count = count

    def __missing__(self, word: str) -> int:
        number = self[word] = next(self.count)
        return number


class _Open:
    """The block a task is filling."""

    def __init__(self) -> None:
        self.count, self.tables, self.chars, self.held = itertools.count(), {}, 0, 0
        self.docs, self.ths, self.sizes, self.numbers = [], [], [], []

    def add(self, doc: str, th: int, group: str, text: str, cut: Callable[[str], list[str]]) -> None:
        table = self.tables.get(group)
        if table is None:
            table = self.tables[group] = Numbers(self.count)
        found, before = cut(text), len(table)
        self.numbers.append(np.fromiter(map(table.__getitem__, found), np.uint32, len(found)))
        self.held += len(table) - before
        self.chars += len(text)
        self.docs.append(doc)
        self.ths.append(th)
        self.sizes.append(len(found))

    def row(self, block: int) -> pa.RecordBatch:
        words, owner, groups = [b""] * self.held, np.zeros(self.held, np.uint32), list(self.tables)
        for i, group in enumerate(groups):
            for word, number in self.tables[group].items():
                words[number] = word.encode()
                owner[number] = i
        numbers = np.concatenate(self.numbers)
        met = numbers + np.uint32(1)  # 0 is a word's first place: numbers follow the order of those
        met[np.unique(numbers, return_index=True)[1]] = 0
        values = [block, self.docs, self.ths, self.sizes, squeeze(met), self.held, len(numbers), pack_words(words), groups, squeeze(owner)]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _ROW)], schema=_ROW)


def _gather(cut, chars: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, block = TaskContext.get().partitionId(), 0, _Open()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                for doc, th, group, text in zip(*[piece[c].to_pylist() for c in ("doc", "th", "grp", "text")]):
                    block.add(doc, th, group, text or "", cut)
                    if block.chars >= chars or block.held >= words:
                        yield block.row((task << 32) + made)
                        made, block = made + 1, _Open()
        if block.docs:
            yield block.row((task << 32) + made)

    return run


def bucket_count(docs: DataFrame) -> int:
    """Buckets of the block table: two a shuffle partition, more for inputs that would fill a bucket over ``BUCKET_BYTES``.

    The size is Spark's own estimate of the input (file sizes); where it has none, the first number holds.
    """
    least = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(MOST_BUCKETS, size // BUCKET_BYTES)) if size < UNKNOWN_SIZE else least


class Blocks:
    """The written blocks and what their sizes say about parts."""

    def __init__(self, docs: DataFrame, cut: Callable[[str], list[str]], group=None, chars: int = BLOCK_CHARS, words: int = BLOCK_WORDS) -> None:
        """``docs`` needs doc_id and text; ``group`` is a column whose values keep dictionaries apart."""
        spark = docs.sparkSession
        slim = docs.select(
            F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.xxhash64("text").alias("th"),
            (F.lit("") if group is None else group).alias("grp"), "text",
        )
        self.buckets = bucket_count(docs)
        name = f"blocks_{uuid.uuid4().hex}"
        made = slim.mapInArrow(_gather(cut, chars, words), _DDL)
        made.write.bucketBy(self.buckets, "block").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
        self.rows = spark.table(name)
        told = self.rows.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("w"), F.coalesce(F.sum("n_total"), F.lit(0)).alias("t")).first()
        self.words, self.total = told["w"], told["t"]

    def answered(self, *answers: DataFrame) -> DataFrame:
        """Block rows with ``answer0``, ``answer1``, ...: for each table (block, part, answer) the answers in the order of parts."""
        rows = self.rows
        for i, told in enumerate(answers):
            whole = told.repartition(self.buckets, "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "answer"))).alias("a"))
            rows = rows.join(whole.select("block", F.transform("a", lambda x: x["answer"]).alias(f"answer{i}")), "block", "left")
        return rows


def numbers_of(row: dict) -> np.ndarray:
    """The block's words, document after document, as places in its dictionary."""
    met = loosen(row["numbers"], np.uint32)
    first = met == 0
    numbers = met.astype(np.int64) - 1
    numbers[first] = np.arange(first.sum())
    return numbers


def key_order(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a dictionary's words in their order, and the places of the words in it: the order of all answers."""
    hashes = word_hashes(words)
    order = np.argsort(hashes, kind="stable")
    return hashes[order], order


def part_bits(keys: int, each: int = PART_KEYS) -> int:
    """Bits of the key space that name a part; parts hold ``each`` keys on average at most."""
    return max(3, int(np.ceil(np.log2(max(keys, 1) / each))) if keys else 0)


def part_slices(tops: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """``part, start, end`` of every part that sorted 64-bit keys touch."""
    if not len(tops):
        return []
    part = tops >> np.uint64(64 - bits)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return list(zip(part[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(part)]))


def by_part(asks: DataFrame, bits: int) -> DataFrame:
    """Whole parts, in as many tasks as the number of keys asks for."""
    return asks.repartition(1 << bits, "part").sortWithinPartitions("part", "block")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch[c][i].as_py() for c in batch.schema.names}


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows that come sorted by part, one part after another."""
    for part, rows in itertools.groupby(rows_of(batches), key=lambda r: r["part"]):
        yield part, list(rows)


def _ask_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            words = unpack_words(row["words"])
            owner = loosen(row["word_groups"], np.uint32)
            counts = np.bincount(numbers_of(row), minlength=len(words)) if "numbers" in row else None
            hashes, order = key_order(words)
            out = [
                (part, row["block"], pack_words([words[i] for i in order[a:b]]), row["groups"], squeeze(owner[order[a:b]]), None if counts is None else squeeze(counts[order[a:b]]))
                for part, a, b in part_slices(hashes, bits)
            ]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary())
            names = ["part", "block", "words", "groups", "word_groups", "counts"]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out) if out else [()] * 6, kinds)], names)

    return run


def ask_words(blocks: Blocks, bits: int, counted: bool = False) -> DataFrame:
    """``part, block, words, groups, word_groups, counts``: every block's dictionary, cut into parts."""
    needed = ["block", "words", "groups", "word_groups", *(["numbers"] if counted else [])]
    schema = "part bigint, block bigint, words binary, groups array<string>, word_groups binary, counts binary"
    return blocks.rows.select(*needed).mapInArrow(_ask_words(bits), schema)
