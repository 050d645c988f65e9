"""Lines that several documents share go, except from the smallest document that holds them.

Lines are exploded, normalised and hashed (128 bits). Documents per hash are counted after (hash, document) pairs
were made distinct, so a line that half of all documents hold is summed up before it meets in one group. Only
positions travel back; each text is put together again by position.

Defined cases: a null or empty text is one empty line. A null doc_id counts as one document that comes after all
others. Rows that repeat a doc_id are the same document; each row is put together from its own text. All input
columns come back inside ``row``, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.llm.text import SPACE, ascii_lower, packed
from trackspark.session import cut_lineage


def line_key(line: Column) -> Column:
    """The line as it is compared: ASCII white space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(SPACE)))


def _rows(docs: DataFrame) -> DataFrame:
    rows = packed(docs)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return rows.select("row", F.col("row.doc_id").alias("doc"), F.xxhash64("row.text").alias("th"), text.alias("text"))


def shared_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``doc, th, drop``: positions of the lines to drop in each row's text, for rows that lose any."""
    exploded = _rows(docs).select("doc", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = exploded.select("doc", "th", "pos", line_key(F.col("line")).alias("key"))
    hashed = cut_lineage(
        keyed.filter(F.char_length("key") >= min_chars).select(
            "doc", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
        )
    )
    shared = (
        hashed.select("h1", "h2", "doc").distinct()
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.min("doc").alias("keeper"))
        .filter(F.col("docs") >= min_docs)
    )
    lost = hashed.join(shared, ["h1", "h2"]).filter(~F.col("doc").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc", "th").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``row, n_lines, n_dropped, kept_text`` per input row; ``row`` holds all input columns."""
    rows = _rows(docs)
    drops = shared_lines(docs, min_chars, min_docs).select(F.col("doc").alias("d"), F.col("th").alias("t"), "drop")
    joined = rows.join(drops, F.col("doc").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    # transform() over a one-element array names the split text once; array_except() keeps this linear
    put_together = F.transform(
        F.array(F.split("text", "\n", -1)),
        lambda lines: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop")), lambda i: F.get(lines, i)),
            "\n",
        ),
    )[0]
    n_lines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return joined.select(
        "row",
        n_lines.cast("bigint").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(put_together).alias("kept_text"),
    )
