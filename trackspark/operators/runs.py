"""Run consistency, batch status and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.sources.artifacts import REQUIRED, missing_artifacts


def _as_value(text: Column) -> Column:
    """JSON text with sorted keys and no spaces, so that equal values are equal text."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def run_consistency(listing: DataFrame, documents: DataFrame, observation_counts: DataFrame) -> DataFrame:
    """One row per run: ``valid`` or ``invalid`` with the broken cross-file rules.

    Errors keep the order of the checks: missing files in the order of the required list, unreadable documents, then the
    rules between files. A run whose observation file cannot be counted has no row (or a null) in observation_counts.

    listing(run_id, name), documents(run_id, name, value), observation_counts(run_id, rows)
    """
    doc = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    wide = documents.groupBy("run_id").agg(
        doc("run-manifest.json").alias("manifest"), doc("analysis-config.json").alias("config"), doc("metrics.json").alias("metrics"), doc("identity-links.json").alias("links"),
        doc("identities.json").alias("identities"), doc("tracking-evaluation.json").alias("evaluation"), doc("review.json").alias("review"), doc("calibration.json").alias("calibration"), doc("calibration-quality.json").alias("quality"),
    )
    # missing and unreadable files in the order of the required list, which is fixed and short
    place = F.array_position(F.array(*[F.lit(n) for n in REQUIRED]), F.col("name"))
    broken = documents.filter(F.expr("try_parse_json(value)").isNull()).select("run_id", "name", F.lit("invalid JSON ").alias("rule"))
    files = missing_artifacts(listing).select("run_id", "name", F.lit("missing ").alias("rule")).unionByName(broken).distinct()
    files = files.groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("at"), "rule", "name"))), lambda e: F.concat(e["rule"], e["name"])).alias("_files"))
    joined = listing.select("run_id").distinct().join(wide, "run_id", "left").join(files, "run_id", "left").join(observation_counts, "run_id", "left")
    get = lambda doc_name, path: F.get_json_object(doc_name, path)
    differs = lambda a, b: ~a.eqNullSafe(b)
    source = get("manifest", "$.input_sha256")
    ids = F.from_json("identities", "map<string,string>")
    told = get("metrics", "$.observation_count")
    counted = told.try_cast("bigint")
    uncountable = told.isNotNull() & (counted.isNull() | F.col("rows").isNull())
    # fixed values: the sentences of the report
    rules = F.array_compact(F.array(
        F.when(differs(get("manifest", "$.config_hash"), get("config", "$.analysis_hash")), "manifest config_hash does not match analysis-config analysis_hash"),
        F.when(source.isNotNull() & differs(get("config", "$.source_sha256"), source), "analysis-config source_sha256 does not match manifest input_sha256"),
        F.when(differs(get("metrics", "$.analysis.analysis_hash"), get("config", "$.analysis_hash")), "metrics analysis hash does not match analysis-config"),
        F.when(uncountable, "unable to count observations.csv").when(told.isNotNull() & (counted != F.col("rows")), "metrics observation_count does not match observations.csv"),
        F.when(differs(get("links", "$.schema_version").try_cast("int"), F.lit(2)), "identity-links schema_version is not 2"),
        F.when(differs(get("links", "$.tracklet_count").try_cast("int"), F.coalesce(F.size(ids), F.lit(0))), "identity-links tracklet_count does not match identities.json"),
        F.when(differs(get("links", "$.player_id_count").try_cast("int"), F.coalesce(F.size(F.array_distinct(F.map_values(ids))), F.lit(0))), "identity-links player_id_count does not match identities.json"),
        F.when(differs(_as_value(get("evaluation", "$.promotion_gate")), _as_value(get("review", "$.promotion_gate"))), "review and tracking-evaluation promotion gates differ"),
        F.when(source.isNotNull() & get("calibration", "$.source_sha256").isNotNull() & differs(get("calibration", "$.source_sha256"), source), "calibration source_sha256 does not match manifest input_sha256"),
        F.when(differs(get("quality", "$.schema_version").try_cast("int"), F.lit(1)), "calibration-quality schema_version is not 1"),
    ))
    none = F.array().cast("array<string>")
    errors = F.concat(F.coalesce("_files", none), rules)
    return joined.select("run_id", errors.alias("errors")).withColumn("status", F.when(F.size("errors") == 0, "valid").otherwise("invalid"))


def batch_status(plays: DataFrame, keys: list[str]) -> DataFrame:
    """complete / complete_with_unresolved / incomplete; plays(*keys, play_id, status, manifest_status, gate_status)"""
    executed = F.bool_and(F.coalesce(F.col("status") == "complete", F.lit(False)))
    settled = F.bool_and(F.coalesce((F.col("manifest_status") == "complete") & (F.col("gate_status") == "passed"), F.lit(False)))
    return plays.groupBy(*keys).agg(F.count(F.lit(1)).alias("plays"), executed.alias("_executed"), settled.alias("_settled")).select(
        *keys, "plays", F.when(F.col("_executed") & F.col("_settled"), "complete").when(F.col("_executed"), "complete_with_unresolved").otherwise("incomplete").alias("status")
    )


def readiness(sources: DataFrame) -> DataFrame:
    """Gate status per input of a source and whether it may be evaluated.

    sources(source_id, review_pack_reviewed, calibration_status, plays, eligible_plays, reference_ok, has_global_map,
    annotations_ok, annotations_reviewed); null means the input was not supplied, ``*_ok`` false that it broke a rule.
    """
    c = F.col
    given = lambda name: c(name).isNotNull()
    out = sources.select(
        "source_id",
        F.when(~given("review_pack_reviewed"), "missing").when(c("review_pack_reviewed"), "reviewed").otherwise("unreviewed").alias("review_pack"),
        F.when(~given("annotations_ok"), "missing").when(~c("annotations_ok"), "invalid").when(c("annotations_reviewed"), "valid").otherwise("unreviewed").alias("annotations"),
        F.coalesce("calibration_status", F.lit("missing")).alias("calibration"),
        F.when(~given("plays"), "missing").when(c("plays") < 1, "invalid").when(c("eligible_plays") == c("plays"), "valid").otherwise("unvalidated").alias("timing"),
        F.when(~given("reference_ok"), "missing").when(~c("reference_ok"), "invalid").when(F.coalesce("has_global_map", F.lit(False)), "valid").otherwise("missing_cross_shot_map").alias("reference"),
    )
    ready = (c("calibration") == "valid") & (c("timing") == "valid") & (c("reference") == "valid")
    return out.withColumn("status", F.when(ready, "ready_for_evaluation").otherwise("not_ready"))
