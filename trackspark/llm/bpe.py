"""BPE encoding through a table of distinct words, decoding through an id-to-piece table.

A text is cut at every single space between two visible characters. The tokenizer's own splitting always starts a new
piece there, so each word (with the space before it) can be encoded alone and the ids put side by side.

* Documents are written once as blocks of local word numbers (``blocks.py``); they stay where they are.
* The blocks' dictionaries travel to the word table, cut into parts of the hash space. A part encodes each of its
  distinct words once and returns every block the ids of the words it asked for, in order.
* A block puts ids back by position.

A frequent word travels once per block, so no word is hot. Memory: one block, or one part of the word table.

Defined cases: a null text is encoded as ''. Rows that repeat a document are each encoded. A string like a special
token inside a text is treated as the tokenizers library does. An empty table gives an empty result. Only doc_id and
text are read; other columns may have any name.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trackspark.llm.blocks import BLOCK_CHARS, BLOCK_WORDS, Blocks, ask_words, by_part, key_order, loosen, numbers_of, part_bits, rows_of, squeeze, unpack_words

#: Words put into one output batch, or one document if it has more.
ROWS = 200_000
#: Documents decoded into one output batch.
DECODED = 64
_RUN = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def words_of(text: str | None) -> list[str]:
    """Table keys of a text's words: the first word is marked by a space in front, all others had one."""
    text = text or ""
    words = _CUT.split(text) if _RUN.search(text) else text.split(" ")
    words[0] = " " + words[0]
    return words


def word_text(key: str) -> str:
    """What a table key stands for: the first word of a text as it is, any other with its space."""
    return key[1:] if key.startswith(" ") else " " + key


def piece_table(path: str) -> list[bytes]:
    """Bytes of every id. Byte-level vocabularies write printable bytes as themselves, the others from U+0100 on."""
    tokenizer = load_tokenizer(path)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    pieces = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    added = {i: token.content for i, token in tokenizer.get_added_tokens_decoder().items()}
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        pieces[i] = added[i].encode() if i in added else bytes(back[c] for c in token)
    return pieces


def _encode(path: str):
    """Rows come sorted by part; each distinct word of a part is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(path)
        at, known = None, {}
        for row in rows_of(batches):
            if row["part"] != at:
                at, known = row["part"], {}
            words = unpack_words(row["words"])
            new = [w for w in words if w not in known]
            for i in range(0, len(new), 4096):
                some = new[i : i + 4096]
                found = tokenizer.encode_batch([word_text(w.decode()) for w in some], add_special_tokens=False)
                known.update(zip(some, [np.array(e.ids, np.uint32).tobytes() for e in found]))
            ids = list(map(known.__getitem__, words))
            answer = squeeze(np.concatenate([np.array([len(ids), *[len(x) // 4 for x in ids]], np.uint32), np.frombuffer(b"".join(ids), np.uint32)]))
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((row["block"], pa.int64()), (at, pa.int64()), (answer, pa.binary()))], ["block", "part", "answer"])

    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: ids of its words from the answers, then the ids of its documents by position."""
    for row in rows_of(batches):
        answers = [loosen(a, np.uint32) for a in row["answer0"] or []]
        sizes = np.concatenate([np.zeros(0, np.uint32), *[a[1 : 1 + a[0]] for a in answers]]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *[a[1 + a[0] :] for a in answers]])
        if len(sizes) != row["n_words"]:
            raise ValueError("a word is missing from the word table")
        starts = np.cumsum(sizes) - sizes
        place = np.argsort(key_order(unpack_words(row["words"]))[1])  # of each word of the dictionary among the answers
        sizes, starts, numbers = sizes[place], starts[place], numbers_of(row)
        ends = np.cumsum([0, *row["sizes"]])
        first = 0
        while first < len(row["docs"]):  # some documents at a time, by their words
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + ROWS, side="right")) - 1)
            taken = numbers[ends[first] : ends[last]]
            each = sizes[taken]
            upto = np.cumsum(each)
            places = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - each, each) + np.repeat(starts[taken], each)
            cuts = np.concatenate([[0], upto])[ends[first : last + 1] - ends[first]]
            ids = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat[places].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(row["docs"][first:last], pa.string()), pa.array(row["ths"][first:last], pa.int64()), ids], ["doc", "th", "ids"])
            first = last


def _answered(docs: DataFrame, path: str, chars: int, words: int) -> DataFrame:
    """Blocks with the ids of their dictionaries."""
    blocks = Blocks(docs, words_of, chars=chars, words=words)
    bits = part_bits(blocks.words)
    answers = by_part(ask_words(blocks, bits).select("part", "block", "words"), bits).mapInArrow(_encode(path), "block bigint, part bigint, answer binary")
    return blocks.answered(answers).select("docs", "ths", "sizes", "numbers", "n_words", "words", "answer0")


def encode(docs: DataFrame, path: str, chars: int = BLOCK_CHARS, words: int = BLOCK_WORDS) -> DataFrame:
    """``doc, th, ids`` per input row: the document's id as text ('' for null), xxhash64 of the text, its token ids."""
    return _answered(docs, path, chars, words).mapInArrow(_assemble, "doc string, th bigint, ids array<int>")


class Pieces:
    """The id-to-piece table as one byte string with places."""

    def __init__(self, table: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(table), np.uint8)
        self.sizes = np.array([len(p) for p in table], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def texts(self, lists: pa.ListArray) -> pa.Array:
        """The texts of lists of ids: pieces looked up and put side by side, bytes that are no UTF-8 replaced."""
        ids = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
        each = self.sizes[ids]
        upto = np.concatenate([[0], np.cumsum(each)])
        data = self.data[np.repeat(self.starts[ids] - upto[:-1], each) + np.arange(upto[-1])]
        cuts = upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        raw = data.tobytes()
        heads = data[cuts[:-1][cuts[:-1] < len(data)]]
        try:
            if ((heads & 0xC0) == 0x80).any():  # a text starts inside a character
                raise UnicodeError
            raw.decode("utf-8")
            return pa.StringArray.from_buffers(len(lists), pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(raw))
        except UnicodeError:
            return pa.array([raw[i:j].decode("utf-8", "replace") for i, j in zip(cuts, cuts[1:])], pa.string())


def _decode(pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Pieces(pieces.value)
        for whole in batches:
            for at in range(0, whole.num_rows, DECODED):  # a batch of ids is small, as texts it is not
                batch = whole.slice(at, DECODED)
                yield pa.RecordBatch.from_arrays([batch["doc"], batch["th"], batch["ids"], table.texts(batch["ids"])], ["doc", "th", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` to ``doc, th, ids``: a map-side join of ids with the id-to-piece table (one row per vocabulary
    entry, so its size is fixed), pieces joined in order and read as UTF-8."""
    pieces = encoded.sparkSession.sparkContext.broadcast(piece_table(path))
    return encoded.mapInArrow(_decode(pieces), "doc string, th bigint, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str, chars: int = BLOCK_CHARS, words: int = BLOCK_WORDS) -> DataFrame:
    """``decode(encode(docs))`` in one pass over the blocks: ids meet the id-to-piece table in the task that made them."""
    decoded = _decode(docs.sparkSession.sparkContext.broadcast(piece_table(path)))
    schema = "doc string, th bigint, ids array<int>, decoded string"
    return _answered(docs, path, chars, words).mapInArrow(lambda batches: decoded(_assemble(batches)), schema)
