"""JSON documents per run, play or source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alignment_sets(correspondences: DataFrame, keys: list[str]) -> DataFrame:
    """Plays of a source with their points; the source hash only when all plays agree on it.

    correspondences(*keys, play_id, source_sha256, shot_id, pts, play_time_s, event); a play holds
    a few reviewed events per view.
    """
    point = F.struct("shot_id", "pts", "play_time_s", "event")
    plays = correspondences.groupBy(*keys, "play_id").agg(
        F.sort_array(F.collect_list(point)).alias("correspondences"), F.min("source_sha256").alias("_low"), F.max("source_sha256").alias("_high")
    )
    return plays.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("play_id", "correspondences"))).alias("plays"),
        F.when(F.min("_low") == F.max("_high"), F.min("_low")).alias("source_sha256"),
    )


def document_table(df: DataFrame, key: list[str], kind: str, value: Column) -> DataFrame:
    """(key, kind, document) rows: one JSON text per row with fields in the given order."""
    return df.select(*key, F.lit(kind).alias("kind"), F.to_json(value).alias("document"))


def run_documents(identities: DataFrame, links: DataFrame, metrics: DataFrame, gates: DataFrame, manifests: DataFrame) -> DataFrame:
    """All JSON documents of the runs as one table (run_id, kind, item, document).

    Rows stay small: a document that the reference writes as one large object is
    one row per entry here, keyed by ``item``.
    """
    row = lambda df, kind, item, value: df.select("run_id", F.lit(kind).alias("kind"), item.alias("item"), F.to_json(value).alias("document"))
    others = lambda df, skip: F.struct(*[c for c in sorted(df.columns) if c not in skip])
    return (
        row(identities, "identities", F.col("tracklet_id"), F.struct("player_id"))
        .unionByName(row(links, "identity-links", F.concat_ws("|", "left_key", "right_key"), others(links, {"run_id"})))
        .unionByName(row(metrics, "metrics", F.col("shot_id"), others(metrics, {"run_id"})))
        .unionByName(row(gates, "review", F.lit("gate"), others(gates, {"run_id"})))
        .unionByName(row(manifests, "run-manifest", F.lit("manifest"), others(manifests, {"run_id"})))
    )


def write_run_documents(documents: DataFrame, path: str) -> None:
    documents.repartitionByRange("run_id", "kind", "item").sortWithinPartitions("run_id", "kind", "item").write.mode("overwrite").partitionBy("kind").json(path)
