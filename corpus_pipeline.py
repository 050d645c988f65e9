"""The corpus pipeline: toxicity, line dedup, near-duplicate removal, mixing, then token ids.

Each stage reads all its predecessor kept. A stage's result is written as Parquet to the shared folder and reread, so
a lost executor costs at most one stage. All stages but the last return the columns of documents.

Defined cases: null texts count as empty for every decision and stay null; empty tables pass through; identical rows
are one document for near-duplicate removal and stay once from there on.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trackspark.llm import bpe, line_dedup, minhash, mixing, toxicity  # noqa: E402
from trackspark.llm.queries import SEED, SHARE, WEIGHTS, domain, held_out, table, vocabulary  # noqa: E402
from trackspark.llm.text import packed  # noqa: E402
from trackspark.session import cut_lineage, ship_package  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches one half go."""
    ship_package(spark)
    told = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), held_out(5, 0))
    bad = told.filter("predicted = 1").select(F.col("doc_id").alias("b_doc"), F.col("th").alias("b_th")).distinct()
    same = F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("b_doc")) & (F.xxhash64("row.text") == F.col("b_th"))
    return packed(docs).join(bad, same, "left_anti").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share go, except from the smallest document; texts and n_chars follow."""
    ship_package(spark)
    told = line_dedup.dedup_lines(docs)
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("bigint")).otherwise(F.col("row.n_chars"))}
    return told.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more) stays."""
    ship_package(spark)
    return minhash.one_of_each(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the target weights take; texts without words take no budget."""
    ship_package(spark)
    picks = mixing.mix(docs, domain(), WEIGHTS, share=SHARE, seed=SEED)
    return mixing.taken_rows(docs, picks, domain())


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of every document."""
    ship_package(spark)
    told = bpe.round_trip(docs, vocabulary())
    return told.select(
        F.expr("try_cast(doc as bigint)").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", to_tokens),
]
#: A trained model decides the first stage, so SQL cannot express the rows; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
