"""Detection logs: JSON lines with one metadata line and one line per frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackspark.scale import FRAME_BUCKET, adjacent_row, frame_bucket
from trackspark.session import cut_lineage

DETECTION = "struct<box_xyxy:array<double>,score:double,class_name:string,class_id:int>"
META = "struct<source_hash:string,detector_config_hash:string,provenance:map<string,string>>"
HEAD = f"struct<_meta:{META}>"
LINE = (
    f"struct<_meta:{META},"
    f"frame_index:bigint,detections:array<{DETECTION}>>"
)


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file_path"), "value")


def read_heads(lines: DataFrame) -> DataFrame:
    """(file_path, source_hash, detector_config_hash, provenance) of every log; only lines that name ``_meta`` are parsed."""
    named = lines.filter(F.col("value").contains('"_meta"')).select("file_path", F.from_json("value", HEAD)["_meta"].alias("m")).filter("m is not null")
    return named.select("file_path", "m.source_hash", "m.detector_config_hash", "m.provenance")


def gate_logs(lines: DataFrame, wanted: DataFrame) -> dict[str, DataFrame]:
    """Which logs carry the hashes wanted of them: ``logs`` that do, and one reject for every other file.

    wanted(file_path, source_hash, detector_config_hash); a null hash there accepts any. Rules in order:
    ``file_missing`` (wanted, but no line), ``metadata_missing``, ``hash_not_wanted`` (no row in wanted),
    ``hash_mismatch``, ``detector_config_mismatch``.
    """
    heads = read_heads(lines)
    want = wanted.select("file_path", F.col("source_hash").alias("_source"), F.col("detector_config_hash").alias("_config"), F.lit(True).alias("_wanted"))
    seen = lines.select("file_path").distinct().withColumn("_seen", F.lit(True))
    told = heads.withColumn("_head", F.lit(True)).join(seen, "file_path", "full").join(want, "file_path", "full")
    fits = lambda column, asked: F.col(asked).isNull() | F.col(column).eqNullSafe(F.col(asked))
    rule = (
        F.when(F.col("_seen").isNull(), "file_missing").when(F.col("_head").isNull(), "metadata_missing").when(F.col("_wanted").isNull(), "hash_not_wanted")
        .when(~fits("source_hash", "_source"), "hash_mismatch").when(~fits("detector_config_hash", "_config"), "detector_config_mismatch")
    )
    told = cut_lineage(told.select("file_path", "source_hash", "detector_config_hash", "provenance", rule.alias("rule")))  # one row per head: lines meet a table of known size
    return {
        "logs": told.filter("rule is null").select("file_path", "source_hash", "detector_config_hash", "provenance"),
        "rejects": told.filter("rule is not null").select("file_path", F.lit(None).cast("string").alias("value"), "rule"),
    }


def parse_logs(
    lines: DataFrame, source_hash: str | None = None, detector_config_hash: str | None = None, wanted: DataFrame | None = None
) -> dict[str, DataFrame]:
    """``logs``, ``frames``, ``detections`` and ``rejects`` of many logs at once; lines(file_path, value).

    The scan takes two steps: heads are held against the hashes wanted per file (``wanted`` as in ``gate_logs``, or one
    pair of hashes for all files), then the lines of accepted files alone are parsed. A file that is turned away is one
    reject, whatever its lines hold.
    """
    if wanted is None:
        wanted = lines.select("file_path").distinct().select(
            "file_path", F.lit(source_hash).cast("string").alias("source_hash"), F.lit(detector_config_hash).cast("string").alias("detector_config_hash")
        )
    gate = gate_logs(lines, wanted)
    kept = gate["logs"]
    accepted = lines.filter(F.trim("value") != "").join(kept.select("file_path").distinct(), "file_path", "left_semi")
    parsed = accepted.select("file_path", "value", F.explode(F.array(F.from_json("value", LINE))).alias("l"))  # filters on an exploded value do not parse the line again
    is_meta, is_frame = F.col("l._meta").isNotNull(), F.col("l.frame_index").isNotNull() & F.col("l.detections").isNotNull()
    frames = parsed.filter(is_frame & ~is_meta).select("file_path", "l.frame_index", "l.detections").join(kept.drop("provenance"), "file_path")
    detections = frames.select(
        "file_path", "source_hash", "detector_config_hash", "frame_index", F.posexplode("detections").alias("det_index", "d")
    ).select(
        "file_path", "source_hash", "detector_config_hash", "frame_index", "det_index",
        *[F.get("d.box_xyxy", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))], "d.score", "d.class_name", "d.class_id",
    )
    broken = parsed.filter(~F.coalesce(is_meta | is_frame, F.lit(False))).select("file_path", "value", F.lit("unreadable_line").alias("rule"))
    return {"logs": kept, "frames": frames, "detections": detections, "rejects": broken.unionByName(gate["rejects"])}


def missing_runs(frames: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gap_start, gap_end): runs of wanted frames without a record, ends exclusive.

    At most one row per record and one per range of ``[frame_start, frame_end)``, however long the range is.
    """
    wanted = ranges.filter(F.col("frame_end") > F.col("frame_start")).select(*keys, "frame_start", "frame_end").distinct()
    by = [*keys, "frame_start", "frame_end"]
    held = frames.select(*keys, "frame_index").distinct().join(wanted, keys).filter((F.col("frame_index") >= F.col("frame_start")) & (F.col("frame_index") < F.col("frame_end")))
    marks = held.select(*by, "frame_index").unionByName(wanted.select(*by, (F.col("frame_start") - 1).alias("frame_index")))
    near = adjacent_row(marks.withColumn("_bucket", frame_bucket("frame_index")), by, ["frame_index"], "_bucket", {"_next": "frame_index"}, following=True)
    runs = near.select(*keys, (F.col("frame_index") + 1).alias("gap_start"), F.coalesce("_next", "frame_end").alias("gap_end"))
    return runs.filter(F.col("gap_end") > F.col("gap_start"))


def run_frames(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Every frame of the runs; long runs are cut into chunks that spread over tasks."""
    chunks = runs.select(*keys, "gap_end", F.explode(F.expr(f"sequence(gap_start, gap_end - 1, {FRAME_BUCKET}L)")).alias("_from")).repartition(*keys, "_from")
    return chunks.select(*keys, F.explode(F.expr(f"sequence(_from, least(gap_end, _from + {FRAME_BUCKET}) - 1)")).alias("frame_index"))


def missing_frames(frames: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Frames of the wanted range without a record."""
    return run_frames(missing_runs(frames, ranges, keys), keys)


def completeness(frames: DataFrame, ranges: DataFrame, keys: list[str], shown: int = 5) -> DataFrame:
    """Per log: number of missing frames and the first few of them."""
    gaps = cut_lineage(missing_runs(cut_lineage(frames.select(*keys, "frame_index").distinct()), ranges, keys))
    counts = gaps.groupBy(*keys).agg(F.sum(F.col("gap_end") - F.col("gap_start")).alias("missing"))
    window = Window.partitionBy(*keys).orderBy("gap_start")
    some = F.sequence("gap_start", F.least(F.col("gap_end"), F.col("gap_start") + shown) - 1)
    first = gaps.withColumn("_no", F.row_number().over(window)).filter(F.col("_no") <= shown).groupBy(*keys).agg(
        F.slice(F.sort_array(F.flatten(F.collect_list(some))), 1, shown).alias("first_missing")
    )
    return ranges.select(*keys).join(counts, keys, "left").join(first, keys, "left").select(
        *keys, F.coalesce("missing", F.lit(0).cast("bigint")).alias("missing"),
        F.coalesce("first_missing", F.array().cast("array<bigint>")).alias("first_missing"),
    )


def _provenance_differs(expected: dict[str, str], exact: bool) -> Column:
    """Every expected key must match; ``exact`` also forbids other keys."""
    differs = F.lit(False)
    for key, value in expected.items():
        differs = differs | ~F.try_element_at("provenance", F.lit(key)).eqNullSafe(F.lit(value))
    return differs | (F.size("provenance") != len(expected)) if exact else differs


def _strict_findings(frames: DataFrame, logs: DataFrame, frame_counts: DataFrame, provenance: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(file_path, frame_index, rule) of everything found in the logs, and the runs of missing frames."""
    none = F.lit(None).cast("bigint")
    seen = cut_lineage(frames.groupBy("file_path", "frame_index").agg(F.count(F.lit(1)).alias("n")))  # lines are read and parsed once
    repeats = seen.filter("n > 1").select("file_path", "frame_index", F.lit("duplicate_frame").alias("rule"))
    unknown = logs.filter("provenance is null").select("file_path", none.alias("frame_index"), F.lit("provenance_missing").alias("rule"))
    foreign = logs.filter("provenance is not null").filter(_provenance_differs(provenance, False)).select("file_path", none.alias("frame_index"), F.lit("provenance_mismatch").alias("rule"))
    counted = seen.select("file_path", "frame_index").join(frame_counts, "file_path")
    outside = counted.filter((F.col("frame_index") < 0) | (F.col("frame_index") >= F.col("frame_count"))).select(
        "file_path", "frame_index", F.lit("out_of_range").alias("rule")
    ).distinct()
    ranges = frame_counts.select("file_path", F.lit(0).cast("bigint").alias("frame_start"), F.col("frame_count").alias("frame_end"))
    return repeats.unionByName(unknown).unionByName(foreign).unionByName(outside), missing_runs(seen, ranges, ["file_path"])


def strict_violations(frames: DataFrame, logs: DataFrame, frame_counts: DataFrame, provenance: dict[str, str]) -> DataFrame:
    """(file_path, frame_index, rule): repeats, foreign provenance, frames outside the source, missing frames.

    frame_counts(file_path, frame_count)
    """
    found, gaps = _strict_findings(frames, logs, frame_counts, provenance)
    return found.unionByName(run_frames(gaps, ["file_path"]).withColumn("rule", F.lit("missing_frame")))


def strict_counts(frames: DataFrame, logs: DataFrame, frame_counts: DataFrame, provenance: dict[str, str]) -> DataFrame:
    """(file_path, rule, n) of ``strict_violations``; missing frames are counted by runs, so a long gap costs one row."""
    found, gaps = _strict_findings(frames, logs, frame_counts, provenance)
    rules = found.groupBy("file_path", "rule").agg(F.count(F.lit(1)).alias("n"))
    missing = gaps.groupBy("file_path").agg(F.sum(F.col("gap_end") - F.col("gap_start")).alias("n"))
    return rules.unionByName(missing.select("file_path", F.lit("missing_frame").alias("rule"), "n"))


def merge_parts(frames: DataFrame, logs: DataFrame, targets: DataFrame, provenance: dict[str, str]) -> dict[str, DataFrame]:
    """Parts of one log each source: ``violations`` and the ``merged`` frames of sources without any.

    frames(file_path, source_hash, detector_config_hash, frame_index, detections),
    targets(source_hash, detector_config_hash, frame_count)
    """
    key = ["source_hash", "detector_config_hash"]
    none = F.lit(None).cast("bigint")
    repeats = frames.groupBy(*key, "frame_index").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key, "frame_index", F.lit("duplicate_frame").alias("rule"))
    different = F.coalesce(_provenance_differs(provenance, True), F.lit(True))
    foreign = logs.filter(different).select(*key, none.alias("frame_index"), F.lit("provenance_mismatch").alias("rule"))
    counted = frames.select(*key, "frame_index").join(targets, key, "left")
    extra = counted.filter(F.col("frame_count").isNull() | (F.col("frame_index") < 0) | (F.col("frame_index") >= F.col("frame_count"))).select(
        *key, "frame_index", F.lit("extra_frame").alias("rule")
    ).distinct()
    ranges = targets.select(*key, F.lit(0).cast("bigint").alias("frame_start"), F.col("frame_count").alias("frame_end"))
    gaps = missing_runs(frames, ranges, key)
    found = repeats.unionByName(foreign).unionByName(extra)
    violations = found.unionByName(run_frames(gaps, key).withColumn("rule", F.lit("missing_frame")))
    merged = frames.join(found.select(*key).unionByName(gaps.select(*key)).distinct(), key, "left_anti")
    return {"violations": violations, "merged": merged}
