"""Jersey and appearance cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.functions.geometry import BOX
from trackspark.scale import exact_quantiles

RELIABLE = 0.9
MIN_CROP_QUALITY = 0.6
BOX_SLACK_PX = 0.05
JERSEY_WEIGHT = 0.25
APPEARANCE_WEIGHT = 0.35
REVIEWED = ("reviewed", "accepted")


def number_distribution(reads: DataFrame, candidates: DataFrame, reviewed_only: bool = False) -> DataFrame:
    """Mean confidence per (tracklet, number); rejected reads never count.

    reads(tracklet_id, source_frame, review_status, accepted_number),
    candidates(tracklet_id, source_frame, number, confidence)
    """
    key = ["tracklet_id", "source_frame"]
    reads = reads.select(*key, "review_status", "accepted_number")
    usable = reads.filter(F.col("review_status") != "rejected")
    if not reviewed_only:
        weights = usable.join(candidates, key).select("tracklet_id", "number", "confidence")
    else:
        reviewed = usable.filter(F.col("review_status").isin(*REVIEWED))
        decided = reviewed.filter("accepted_number is not null").select(
            "tracklet_id", F.col("accepted_number").alias("number"), F.lit(1.0).alias("confidence")
        )
        open_reads = reviewed.filter("accepted_number is null").join(candidates, key).filter(F.col("confidence") >= RELIABLE)
        weights = decided.unionByName(open_reads.select("tracklet_id", "number", "confidence"))
    return weights.groupBy("tracklet_id", "number").agg(F.avg("confidence").alias("confidence"))


def mean_embeddings(embeddings: DataFrame) -> DataFrame:
    """Unit mean of unit vectors per (tracklet, model) over crops of enough quality.

    Averages travel as one partial sum per dimension; vectors of mixed length give no row.
    """
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    usable = embeddings.filter((F.col("review_status") != "rejected") & (F.col("crop_quality_score") >= MIN_CROP_QUALITY))
    unit = usable.withColumn("_norm", length).filter(F.col("_norm") > 0)
    key = ["tracklet_id", "model"]
    parts = unit.select(*key, "_norm", F.size("vector").alias("_size"), F.posexplode("vector").alias("_at", "_x"))
    means = parts.groupBy(*key, "_at").agg(
        F.avg(F.col("_x").cast("double") / F.col("_norm")).alias("_mean"), F.min("_size").alias("_low"), F.max("_size").alias("_high")
    )
    vectors = means.groupBy(*key).agg(  # one entry per dimension
        F.transform(F.sort_array(F.collect_list(F.struct("_at", "_mean"))), lambda e: e["_mean"]).alias("_v"),
        F.min("_low").alias("_low"), F.max("_high").alias("_high"),
    )
    total = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda acc, x: acc + x * x))
    return (
        vectors.filter("_low = _high").withColumn("_total", total).filter(F.col("_total") > 0)
        .select(*key, F.transform("_v", lambda x: x / F.col("_total")).alias("vector"))
    )


def median_quality(reads: DataFrame, measures: list[str]) -> DataFrame:
    """Read count and the median of each crop measure per tracklet."""
    out = reads.groupBy("tracklet_id").agg(F.count(F.lit(1)).alias("jersey_read_count"))
    for name in measures:
        out = out.join(exact_quantiles(reads, ["tracklet_id"], name, {f"median_{name}": 0.5}), "tracklet_id", "left")
    return out


def reviewed_numbers(reads: DataFrame, candidates: DataFrame) -> DataFrame:
    """(tracklet, number) pairs review has settled: accepted, or the only reliable candidate of a reviewed read."""
    key = ["tracklet_id", "source_frame"]
    reviewed = reads.select(*key, "review_status", "accepted_number").filter(F.col("review_status").isin(*REVIEWED))
    accepted = reviewed.filter("accepted_number is not null").select("tracklet_id", F.col("accepted_number").alias("number"))
    reliable = (
        reviewed.filter("accepted_number is null").join(candidates.filter(F.col("confidence") >= RELIABLE), key)
        .groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("number")).filter("n = 1")
    )
    return accepted.unionByName(reliable.select("tracklet_id", "number")).distinct()


def _on_side(df: DataFrame, side: str, *fields: str) -> DataFrame:
    return df.select(F.col("tracklet_id").alias(f"{side}_key"), *[F.col(f).alias(f"_{side}_{f}") for f in fields])


def compare_cues(pairs: DataFrame, numbers: DataFrame, reviewed: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Agreement of two tracklets: proposals for ranking plus the reviewed hard constraint.

    pairs(left_key, right_key); the number and embedding tables hold one row per tracklet and number/model.
    """
    keys = ["left_key", "right_key"]

    def common(table: DataFrame, on: str, value: Column) -> DataFrame:
        fields = [c for c in table.columns if c != "tracklet_id"]
        joined = pairs.select(*keys).join(_on_side(table, "left", *fields), "left_key").join(_on_side(table, "right", *fields), "right_key")
        return joined.filter(F.col(f"_left_{on}") == F.col(f"_right_{on}")).groupBy(*keys).agg(
            F.max(value).alias("_value"), F.count(F.lit(1)).alias("_shared")
        )

    jersey = common(numbers, "number", F.least("_left_confidence", "_right_confidence")).select(
        *keys, F.col("_value").alias("jersey_number_proposal_score")
    )
    agreed = common(reviewed, "number", F.lit(1)).select(*keys, F.col("_shared").alias("_agreed"))
    dot = F.aggregate(F.zip_with("_left_vector", "_right_vector", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    same_size = F.when(F.size("_left_vector") == F.size("_right_vector"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
    looks = common(embeddings, "model", same_size).select(*keys, F.col("_value").alias("appearance_similarity_proposal"))
    has = lambda side: reviewed.select(F.col("tracklet_id").alias(f"{side}_key"), F.lit(True).alias(f"_{side}_reviewed")).distinct()
    joined = (
        pairs.select(*keys).join(jersey, keys, "left").join(agreed, keys, "left").join(looks, keys, "left")
        .join(has("left"), "left_key", "left").join(has("right"), "right_key", "left")
    )
    agreement = F.coalesce(F.col("_agreed") > 0, F.lit(False))
    jersey_w = F.when(F.col("jersey_number_proposal_score").isNotNull(), JERSEY_WEIGHT).otherwise(0.0)
    looks_w = F.when(F.col("appearance_similarity_proposal").isNotNull(), APPEARANCE_WEIGHT).otherwise(0.0)
    score = jersey_w * F.coalesce("jersey_number_proposal_score", F.lit(0.0)) + looks_w * (
        (F.coalesce("appearance_similarity_proposal", F.lit(0.0)) + 1.0) / 2.0
    )
    return joined.select(
        *keys, "jersey_number_proposal_score", "appearance_similarity_proposal",
        agreement.alias("reviewed_jersey_agreement"),
        (F.coalesce("_left_reviewed", F.lit(False)) & F.coalesce("_right_reviewed", F.lit(False)) & ~agreement).alias("reviewed_jersey_conflict"),
        F.when(jersey_w + looks_w > 0, score / (jersey_w + looks_w)).alias("cue_rank_score"),
    )


def binding_violations(cues: DataFrame, observations: DataFrame) -> DataFrame:
    """Cues that do not hit one observation on (tracklet, frame) with equal PTS and box.

    cues(tracklet_id, source_frame, source_pts, x1..y2)
    """
    obs = observations.select("tracklet_id", F.col("frame_index").alias("source_frame"), F.col("pts").alias("_pts"), *[F.col(c).alias(f"_{c}") for c in BOX])
    joined = cues.join(obs, ["tracklet_id", "source_frame"], "left")
    gaps = F.zip_with(F.array(*BOX), F.array(*[f"_{c}" for c in BOX]), lambda a, b: F.abs(a - b))
    rule = (
        F.when(F.col("_pts").isNull(), "missing_observation")
        .when(F.col("_pts") != F.col("source_pts"), "pts_mismatch")
        .when(~F.forall(gaps, lambda d: d <= BOX_SLACK_PX), "box_mismatch")
    )
    return joined.withColumn("rule", rule).filter("rule is not null").select("tracklet_id", "source_frame", "rule")
