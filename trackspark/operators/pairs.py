"""Cross-shot evidence: field tracks, time pairing, pair scores."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.operators.teams import team_eligible
from trackspark.scale import adjacent_row, exact_quantiles, fresh, spread
from trackspark.session import cut_lineage

PAIR = ["play_id", "left_key", "right_key"]
START = float("-inf")
#: Added to a tolerance where samples are only collected, so that rounding loses none.
SLACK_S = 1e-6
#: Samples of a pair that may be ordered in one row.
HELD_SAMPLES = 16_384


def field_samples(rows: DataFrame, timeline_mode: bool = True) -> DataFrame:
    """Samples fit for cross-shot evidence; missing uncertainty counts as 0.

    In timeline mode only ``valid`` calibration enters, otherwise anything but ``invalid``.
    """
    status = F.col("calibration_status")
    allowed = (status == "valid") if timeline_mode else F.coalesce(status != "invalid", F.lit(True))
    kept = rows.filter(
        F.col("play_id").isNotNull() & F.col("field_x").isNotNull() & F.col("field_y").isNotNull()
        & F.col("play_time_s").isNotNull() & allowed
    )
    return kept.select(
        "play_id", "shot_id", "tracklet_id", "play_time_s", F.col("field_x").alias("x"), F.col("field_y").alias("y"),
        F.coalesce("position_uncertainty_yards", F.lit(0.0)).alias("uncertainty"),
    )


def unordered_samples(samples: DataFrame, bucket_s: float = 256.0) -> DataFrame:
    """Samples that do not come strictly after the one before them."""
    bucketed = samples.withColumn("_bucket", F.floor(F.col("play_time_s") / bucket_s))
    near = adjacent_row(bucketed, ["play_id", "tracklet_id"], ["play_time_s"], "_bucket", {"_before": "play_time_s"})
    return near.filter(F.col("_before") >= F.col("play_time_s")).drop("_bucket", "_before")


def _walk(left: list[float], right: list[float], tolerance: float, used: int) -> list[int]:
    """Right index per left sample (or -1): nearest later unused sample, ties to the earlier one."""
    out = []
    for time in left:
        at = bisect_left(right, time, used + 1)
        best, gap = -1, tolerance
        for index in (at - 1, at):
            if used < index < len(right):
                distance = abs(right[index] - time)
                if distance <= tolerance and (best < 0 or distance < gap):
                    best, gap = index, distance
        if best >= 0:
            used = best
        out.append(best)
    return out


_PICKS = ["left_s", "right_s", "lx", "ly", "rx", "ry", "uncertainty"]
_OUT = (
    "play_id string, left_key string, right_key string, block bigint, entry double, alone boolean, exit double, merge_s double, "
    + ", ".join(f"{name} array<double>" for name in _PICKS)
)


def _settled(left: np.ndarray, right: np.ndarray, tolerance: float) -> np.ndarray | None:
    """The walk where no sample has two partners in reach, so that the order of use does not matter; else None."""
    low = np.searchsorted(right, left - (tolerance + SLACK_S), "left")
    reach = np.searchsorted(right, left + (tolerance + SLACK_S), "right") - low
    near = np.flatnonzero(reach > 0)
    if (reach > 1).any() or (np.diff(low[near]) <= 0).any():
        return None
    walk = np.full(len(left), -1)
    walk[near] = np.where(np.abs(right[low[near]] - left[near]) <= tolerance, low[near], -1)
    return walk


def _pair_block(tolerance: float, block_s: float):
    """Pairings of one block of a play for every way earlier blocks may have left them.

    The only thing a block inherits is the last right sample used, and that
    sample lies within the tolerance of the block's start and of a left sample
    before it; a block that can inherit none is final (``alone``). Walks from different
    entries soon coincide, so other entries only list where they differ.
    """

    def run(samples: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        names = [f.split()[0] for f in _OUT.split(", ")]
        if samples.empty or pairs.empty:
            return pd.DataFrame(columns=names)
        play, block = pairs.play_id.iloc[0], int(pairs.block.iloc[0])
        begin = block * block_s
        codes, keys = pd.factorize(samples.tracklet_id)
        columns = [samples[c].to_numpy() for c in ("s", "x", "y", "u", "own")]
        order = np.lexsort((columns[0], codes))
        cuts = np.searchsorted(codes[order], np.arange(len(keys) + 1))
        held = {key: [c[order[low:high]] for c in columns] for key, low, high in zip(keys, cuts, cuts[1:])}
        rows = []
        for left_key, right_key in zip(pairs.left_key, pairs.right_key):
            if left_key not in held or right_key not in held:
                continue
            all_s, *rest, own = held[left_key]
            ls, (lx, ly, lu) = all_s[own], [c[own] for c in rest]
            rs, rx, ry, ru, _ = held[right_key]
            if not len(ls):
                continue
            before = all_s[all_s < begin]
            main = _settled(ls, rs, tolerance)
            left, right = ls.tolist(), rs.tolist()
            if main is None:
                main = np.array(_walk(left, right, tolerance, -1))
            early = np.flatnonzero(rs <= begin + tolerance + SLACK_S)
            entries = [(START, -1)] + [(right[i], int(i)) for i in early if len(before) and np.abs(before - rs[i]).min() <= tolerance + SLACK_S]
            for entry, used in entries:
                walk = main if used < 0 else np.array(_walk(left, right, tolerance, used))
                last = max(int(walk.max()), used)
                merge = len(walk)
                if used >= 0:
                    # from the sample where both walks agree and hold the same last partner
                    hold_a, hold_b = np.maximum(np.maximum.accumulate(main), -1), np.maximum(np.maximum.accumulate(walk), used)
                    differ = np.flatnonzero((main != walk) | (hold_a != hold_b))
                    merge = int(differ[-1]) + 1 if len(differ) else 0
                i = np.flatnonzero(walk[:merge] >= 0)
                j = walk[i]
                rows.append((
                    play, left_key, right_key, block, entry, len(entries) == 1, right[last] if last >= 0 else START, left[merge] if merge < len(left) else float("inf"),
                    ls[i], rs[j], lx[i], ly[i], rx[j], ry[j], lu[i] + ru[j],
                ))
        return pd.DataFrame(rows, columns=names)

    return run


def _chain_entries(pdf: pd.DataFrame) -> pd.DataFrame:
    state, out = START, []
    for block, table in pdf.sort_values("block").groupby("block", sort=True):
        known = dict(zip(table.entry, zip(table.exit, table.merge_s)))
        entry = state if state in known else START
        out.append((*[pdf[c].iloc[0] for c in PAIR], int(block), entry, known[entry][1]))
        left_over = known[entry][0]
        state = max(state, left_over)
    return pd.DataFrame(out, columns=[*PAIR, "block", "chosen", "merge_at"])


def paired_samples(pairs: DataFrame, samples: DataFrame, tolerance_s: float = 0.05, block_s: float = 64.0) -> DataFrame:
    """Monotone nearest-time pairs of each tracklet pair, one row per paired sample.

    pairs(play_id, left_key, right_key), samples as from ``field_samples``. The play clock is cut into blocks that are solved
    side by side; a task sees the samples of one block once, not once per pair they are in.
    """
    base = cut_lineage(pairs.select(*PAIR))
    wanted = base.select("play_id", F.explode(F.array("left_key", "right_key")).alias("tracklet_id")).distinct()
    samples = samples.join(wanted, ["play_id", "tracklet_id"], "left_semi")
    samples = cut_lineage(samples.select("play_id", "tracklet_id", F.col("play_time_s").alias("s"), "x", "y", F.col("uncertainty").alias("u")))
    # a sample used from before the block may be a tolerance away from the one that used it, and that as far before the border
    home, slack = F.floor(F.col("s") / block_s), 2 * (tolerance_s + SLACK_S)
    placed = samples.withColumn("block", F.explode(F.sequence(F.floor((F.col("s") - slack) / block_s), F.floor((F.col("s") + slack) / block_s)))).withColumn("own", F.col("block") == home)
    spans = samples.select("play_id", F.col("tracklet_id").alias("left_key"), home.alias("block")).distinct()
    key, rows = ["play_id", "block"], samples.count()
    walked = cut_lineage(
        spread(fresh(placed), *key, rows=rows).groupBy(*key).cogroup(spread(base.join(spans, ["play_id", "left_key"]), *key, rows=rows).groupBy(*key)).applyInPandas(_pair_block(tolerance_s, block_s), _OUT)
    )
    each = lambda df, *more: df.select(*PAIR, *more, F.inline(F.arrays_zip(*_PICKS)))
    final, open_ = walked.filter("alone"), walked.filter("not alone")
    if open_.isEmpty():
        return each(final)
    chained = walked.join(open_.select(*PAIR).distinct(), PAIR, "left_semi").select(*PAIR, "block", "entry", "exit", "merge_s")
    entries = spread(chained, *PAIR).groupBy(*PAIR).applyInPandas(
        _chain_entries, "play_id string, left_key string, right_key string, block bigint, chosen double, merge_at double"
    )
    chosen = F.col("entry") == F.col("chosen")
    tail = (F.col("entry") == F.lit(START)) & (F.col("left_s") >= F.col("merge_at"))
    picked = each(spread(open_, *PAIR, "block", rows=rows).join(entries, [*PAIR, "block"]), "entry", "chosen", "merge_at").filter(chosen | tail)
    return each(final).unionByName(picked.drop("entry", "chosen", "merge_at"))


def _pair_cuts(joined: DataFrame, per_pair: DataFrame) -> DataFrame:
    """Median and 90th percentile of the distance and median uncertainty of each pair; per_pair has its number of samples.

    Up to ``HELD_SAMPLES`` of a pair are ordered where they are counted, longer pairs go by ranges. Both are exact.
    """
    def at(values, p: float):
        rank = (F.size(values) - 1) * F.lit(p)
        low = F.floor(rank).cast("int")
        below, above = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
        return below + (above - below) * (rank - low)

    long = per_pair.filter(F.col("_n") > HELD_SAMPLES).select(*PAIR)
    some = not long.isEmpty()
    held = (joined.join(long, PAIR, "left_anti") if some else joined).groupBy(*PAIR).agg(
        F.sort_array(F.collect_list("distance")).alias("_d"), F.sort_array(F.collect_list("uncertainty")).alias("_u")  # at most HELD_SAMPLES
    )
    cuts = held.select(*PAIR, at(F.col("_d"), 0.5).alias("_d50"), at(F.col("_d"), 0.9).alias("_d90"), at(F.col("_u"), 0.5).alias("_u50"))
    if not some:
        return cuts
    melted = joined.join(long, PAIR, "left_semi").select(*PAIR, F.explode(F.array(
        F.struct(F.lit("d").alias("m"), F.col("distance").alias("v")), F.struct(F.lit("u").alias("m"), F.col("uncertainty").alias("v"))
    )).alias("_e")).select(*PAIR, F.col("_e.m").alias("m"), F.col("_e.v").alias("v"))
    return cuts.unionByName(exact_quantiles(melted, [*PAIR, "m"], "v", {"q50": 0.5, "q90": 0.9}).groupBy(*PAIR).agg(
        F.max(F.when(F.col("m") == "d", F.col("q50"))).alias("_d50"), F.max(F.when(F.col("m") == "d", F.col("q90"))).alias("_d90"),
        F.max(F.when(F.col("m") == "u", F.col("q50"))).alias("_u50"),
    ))


def shape_agreement(first_left, last_left, first_right, last_right, count):
    """Cosine of net displacements in [0, 1]; 0 under two points, 0.5 when a side stands still."""
    lx, ly = last_left["x"] - first_left["x"], last_left["y"] - first_left["y"]
    rx, ry = last_right["x"] - first_right["x"], last_right["y"] - first_right["y"]
    ln, rn = F.sqrt(lx * lx + ly * ly), F.sqrt(rx * rx + ry * ry)
    cosine = (lx * rx + ly * ry) / (ln * rn)
    return (
        F.when(count < 2, 0.0).when((ln < 1e-6) | (rn < 1e-6), 0.5)
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine + 1.0) / 2.0)))
    )


def pair_evidence(
    pairs: DataFrame,
    samples: DataFrame,
    teams: DataFrame,
    cues: DataFrame | None = None,
    max_field_distance_yards: float = 6.0,
    min_overlap_samples: int = 5,
    sample_tolerance_s: float = 0.05,
    min_overlap_duration_s: float = 0.4,
    max_position_uncertainty_yards: float = 2.0,
) -> DataFrame:
    """Evidence for every cross-shot pair and the first gate it fails.

    Team and jersey gates come before any sample is joined.

    pairs(play_id, left_shot, right_shot, left_key, right_key),
    teams(tracklet_id, team, score, source, assignment_coverage, ambiguity),
    cues as from ``compare_cues``.
    """
    rated = teams.select("tracklet_id", "team", "score", team_eligible().alias("ok"))
    on = lambda side: rated.select(
        F.col("tracklet_id").alias(f"{side}_key"), F.col("team").alias(f"_{side}_team"), F.col("score").alias(f"_{side}_score"), F.col("ok").alias(f"_{side}_ok")
    )
    gated = pairs.join(on("left"), "left_key", "left").join(on("right"), "right_key", "left")
    if cues is None:
        gated = gated.select(
            "*", F.lit(False).alias("reviewed_jersey_conflict"), F.lit(False).alias("reviewed_jersey_agreement"), F.lit(None).cast("double").alias("cue_rank_score")
        )
    else:
        gated = gated.join(
            cues.select("left_key", "right_key", "reviewed_jersey_conflict", "reviewed_jersey_agreement", "cue_rank_score"), ["left_key", "right_key"], "left"
        )
    no = lambda name: ~F.coalesce(F.col(name), F.lit(False))
    gated = gated.withColumn(
        "_gate",
        F.when(F.coalesce("reviewed_jersey_conflict", F.lit(False)), "reviewed_jersey_mismatch")
        .when(no("_left_ok"), "left_team_ineligible").when(no("_right_ok"), "right_team_ineligible")
        .when(F.col("_left_team") != F.col("_right_team"), "team_mismatch"),
    )
    joined = paired_samples(gated.filter("_gate is null"), samples, sample_tolerance_s)
    joined = joined.withColumn("distance", F.sqrt(F.pow(F.col("lx") - F.col("rx"), 2) + F.pow(F.col("ly") - F.col("ry"), 2)))
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    shape = cut_lineage(joined.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("_n"), F.min("left_s").alias("_from"), F.max("left_s").alias("_to"),
        F.min_by(point("lx", "ly"), "left_s").alias("_fl"), F.max_by(point("lx", "ly"), "left_s").alias("_ll"),
        F.min_by(point("rx", "ry"), "left_s").alias("_fr"), F.max_by(point("rx", "ry"), "left_s").alias("_lr"),
    ))  # a row per pair
    cuts = _pair_cuts(joined, shape)
    full = gated.join(shape, PAIR, "left").join(cuts, PAIR, "left")
    n = F.coalesce("_n", F.lit(0).cast("bigint"))
    span = F.col("_to") - F.col("_from")
    few, short = n < min_overlap_samples, span < min_overlap_duration_s
    vague, far = F.col("_u50") > max_position_uncertainty_yards, F.col("_d90") > max_field_distance_yards
    reason = (
        F.when(F.col("_gate").isNotNull(), F.col("_gate")).when(few, "insufficient_overlap_samples").when(short, "insufficient_overlap_duration")
        .when(vague, "position_uncertainty_exceeds_limit").when(far, "field_distance_exceeds_limit")
    )
    agreement = shape_agreement(F.col("_fl"), F.col("_ll"), F.col("_fr"), F.col("_lr"), n)
    if max_position_uncertainty_yards > 0:
        penalty = F.exp(-F.col("_u50") / max(1e-6, max_position_uncertainty_yards))
    else:
        penalty = F.lit(1.0)
    raw = (
        0.55 * (1.0 - F.col("_d50") / max_field_distance_yards) + 0.30 * agreement + 0.15 * F.col("_left_score") * F.col("_right_score")
    ) * penalty
    marked = full.withColumn("rejection_reason", reason)
    open_ = F.col("rejection_reason").isNull()
    timed = F.col("_gate").isNull() & ~few
    measured = timed & ~short
    placed = measured & ~vague
    score = F.when(open_, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    out = marked.select(
        *pairs.columns,
        F.coalesce("_left_team", F.lit("unknown")).alias("left_team"), F.coalesce("_right_team", F.lit("unknown")).alias("right_team"),
        F.coalesce("_left_score", F.lit(0.0)).alias("left_team_score"), F.coalesce("_right_score", F.lit(0.0)).alias("right_team_score"),
        F.when(F.col("_gate").isNull(), n).otherwise(F.lit(0).cast("bigint")).alias("paired_sample_count"),
        F.when(timed, F.col("_from")).alias("overlap_start_s"), F.when(timed, F.col("_to")).alias("overlap_end_s"),
        F.when(timed, span).otherwise(0.0).alias("overlap_span_s"),
        F.when(measured, F.col("_u50")).alias("combined_uncertainty_yards"),
        F.when(placed, F.col("_d50")).alias("median_distance_yards"), F.when(placed, F.col("_d90")).alias("p90_distance_yards"),
        F.when(open_, agreement).alias("shape_agreement"), score.alias("score"), open_.alias("eligible"), "rejection_reason",
        F.coalesce("reviewed_jersey_conflict", F.lit(False)).alias("reviewed_jersey_conflict"),
        F.coalesce("reviewed_jersey_agreement", F.lit(False)).alias("reviewed_jersey_agreement"), "cue_rank_score",
    )
    rank = F.when(F.col("cue_rank_score").isNotNull(), F.bround(0.75 * F.col("score") + 0.25 * F.col("cue_rank_score"), 6)).otherwise(F.col("score"))
    return out.withColumn("review_rank_score", rank)


def eligible_scores(evidence: DataFrame) -> DataFrame:
    return evidence.filter("eligible").select("play_id", "left_shot", "right_shot", "left_key", "right_key", "score")
