"""Artifact sets of runs: listing, required names, documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed names every finished run must hold.
REQUIRED = (
    "analysis-config.json", "calibration.json", "calibration-quality.json", "tracklet-refinement.json", "identity-links.json", "tracking-evaluation.json",
    "review.json", "metrics.json", "run-manifest.json", "identities.json", "observations.csv", "observations.parquet", "trajectories.csv", "play-trajectories.csv", "shots.json",
)


def list_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, name, length) of ``root/<run_id>/<name>``; file content is never read.

    An artifact may be a folder, as Spark writes them: its files count as one. Folders named ``key=value`` go by the value.
    """
    bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    path = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    part = F.split(F.substring(path, F.lit(len(bare) + 2), F.length(path)), "/")
    named = lambda i: F.regexp_replace(F.get(part, F.lit(i)), "^[^=]+=", "")
    listed = files.select(named(0).alias("run_id"), named(1).alias("name"), "length").filter("name is not null")
    return listed.groupBy("run_id", "name").agg(F.sum("length").alias("length"))


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, name, value) of the JSON artifacts."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    return text.select(F.element_at(F.split(path, "/"), -2).alias("run_id"), F.element_at(F.split(path, "/"), -1).alias("name"), "value")


def file_hashes(spark: SparkSession, root: str) -> DataFrame:
    """SHA-256 of every artifact (files under 2 GB)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def missing_artifacts(listing: DataFrame) -> DataFrame:
    """(run_id, name) of required artifacts a run lacks."""
    wanted = listing.select("run_id").distinct().withColumn("name", F.explode(F.array(*[F.lit(n) for n in REQUIRED])))
    return wanted.join(listing.select("run_id", "name"), ["run_id", "name"], "left_anti")
