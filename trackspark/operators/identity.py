"""Links with abstention, safe components, player ids, play resolution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions.scalars import shot_of
from trackspark.operators.assignment import best_matching, best_total, components
from trackspark.operators.pairs import eligible_scores, pair_evidence
from trackspark.operators.teams import team_eligible
from trackspark.scale import connected_components, edge_components, fresh, total_order
from trackspark.session import cut_lineage

SHOTS = ["play_id", "left_shot", "right_shot"]
LINK_FIELDS = ["left_key", "right_key", "decision", "score", "alternative_score", "ambiguity_margin", "rejection_reason"]


def _solve_links(margin: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["left_key", "right_key"]).reset_index(drop=True)
        rows = []
        for group in components(zip(pdf.left_key, pdf.right_key)):
            part = pdf.iloc[group]
            lefts, rights = sorted(set(part.left_key)), sorted(set(part.right_key))
            at_l, at_r = {k: i for i, k in enumerate(lefts)}, {k: i for i, k in enumerate(rights)}
            table = np.full((len(lefts), len(rights)), -1.0)
            for l, r, s in zip(part.left_key, part.right_key, part.score):
                table[at_l[l], at_r[r]] = s
            chosen = best_matching(table)
            total = sum(table[r, c] for r, c in enumerate(chosen) if c >= 0)
            for r, c in enumerate(chosen):
                if c < 0:
                    continue
                without = table.copy()
                without[r, c] = -1.0
                gap = max(0.0, float(total - best_total(without)[0]))
                gap = 0.0 if gap < 1e-12 else gap
                score = float(table[r, c])
                alternative = max(0.0, min(1.0, score - gap))
                rows.append((lefts[r], rights[c], score, alternative, gap, gap < margin))
        out = pd.DataFrame(rows, columns=["left_key", "right_key", "score", "alternative_score", "ambiguity_margin", "ambiguous"])
        for name in SHOTS:
            out.insert(0, name, pdf[name].iloc[0])
        return out[[*SHOTS, "left_key", "right_key", "score", "alternative_score", "ambiguity_margin", "ambiguous"]]

    return run


def match_tracklets(tracks: DataFrame, scores: DataFrame, threshold: float = 0.65, margin: float = 0.1) -> DataFrame:
    """One link per left tracklet and shot pair: best one-to-one assignment over scores >= threshold.

    A link is only ``same`` when forbidding it costs the assignment at least
    ``margin``. Edges without a rival are decided in place; the rest is solved
    per connected component.

    tracks(play_id, left_shot, right_shot, left_key, comparable), scores(.., right_key, score)
    """
    edges = scores.filter(F.col("score") >= threshold)
    per = lambda end: F.count(F.lit(1)).over(Window.partitionBy(*SHOTS, end))
    marked = edges.withColumn("_degree", F.greatest(per("left_key"), per("right_key")))
    alone = marked.filter("_degree = 1").select(
        *SHOTS, "left_key", "right_key", "score", F.lit(0.0).alias("alternative_score"), F.col("score").alias("ambiguity_margin"),
        (F.col("score") < margin).alias("ambiguous"),
    )
    schema = (
        "play_id string, left_shot string, right_shot string, left_key string, right_key string, score double, "
        "alternative_score double, ambiguity_margin double, ambiguous boolean"
    )
    contested = cut_lineage(marked.filter("_degree > 1").select(*SHOTS, "left_key", "right_key", "score"))
    grouped = edge_components(contested, [*SHOTS, "left_key"], [*SHOTS, "right_key"])
    solved = grouped.groupBy("component").applyInPandas(_solve_links(margin), schema)
    with_edge = edges.select(*SHOTS, "left_key").distinct().withColumn("_has_edge", F.lit(True))
    joined = tracks.join(with_edge, [*SHOTS, "left_key"], "left").join(alone.unionByName(solved), [*SHOTS, "left_key"], "left")
    found = F.col("right_key").isNotNull()
    return joined.select(
        *SHOTS, "left_key", "right_key",
        F.when(found & ~F.col("ambiguous"), "same").otherwise("insufficient_evidence").alias("decision"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "alternative_score", "ambiguity_margin",
        F.when(~F.col("comparable"), "no_comparison_tracklets").when(found & F.col("ambiguous"), "global_assignment_ambiguous")
        .when(~found & F.col("_has_edge").isNull(), "no_eligible_edge").when(~found, "unmatched_by_global_assignment").alias("rejection_reason"),
    )


def dedupe_links(links: DataFrame) -> DataFrame:
    """One link per (left, right): accepted first, then the higher score."""
    best = F.struct((F.col("decision") == "same").cast("int").alias("accepted"), F.col("score"))
    fields = F.struct(*[c for c in links.columns if c not in ("play_id", "left_key", "right_key")])
    return links.groupBy("play_id", "left_key", "right_key").agg(F.max_by(fields, best).alias("_f")).select(
        "play_id", "left_key", "right_key", "_f.*"
    )


def frame_sets(rows: DataFrame, tracklets: DataFrame) -> DataFrame:
    """(shot_id, tracklet_id, chunk, frames): the frames of each given tracklet as bitmaps of 32,768 frames.

    Whether two tracklets share a frame is a bitwise and of their bitmaps, so no pairs are formed to find out.
    """
    kept = rows.select("shot_id", "frame_index", "tracklet_id").join(tracklets.select("tracklet_id").distinct(), "tracklet_id", "left_semi")
    chunked = kept.groupBy("shot_id", "tracklet_id", F.bitmap_bucket_number("frame_index").alias("chunk"))
    return chunked.agg(F.bitmap_construct_agg(F.bitmap_bit_position("frame_index")).alias("frames"))


def _accept_in_order(links: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    """Take links in order; refuse one that would join incompatible members."""
    links = links.sort_values(["left_key", "right_key"]).reset_index(drop=True)
    seen: dict[str, dict[tuple, np.ndarray]] = {}
    for shot, key, chunk, frames in zip(sets.shot_id, sets.tracklet_id, sets.chunk, sets.frames):
        seen.setdefault(key, {})[(shot, chunk)] = np.frombuffer(frames, np.uint64)
    members: dict[str, set[str]] = {}
    taken: dict[str, dict[tuple, np.ndarray]] = {}  # frames of all members together
    traits: dict[str, tuple[set, set, set]] = {}
    for side in ("left", "right"):
        for key, play, team, jerseys in zip(links[f"{side}_key"], links[f"{side}_play"], links[f"{side}_team"], links[f"{side}_jerseys"]):
            members[key] = {key}
            taken[key] = dict(seen.get(key, {}))
            traits[key] = (
                {play} - {None}, {team} - {None, "unknown"}, set() if jerseys is None else {int(j) for j in jerseys},
            )
    home = {key: key for key in members}

    def compatible(a: str, b: str) -> bool:
        plays, teams, numbers = zip(traits[a], traits[b])
        if plays[0] and plays[1] and plays[0] != plays[1]:
            return False
        if teams[0] and teams[1] and teams[0].isdisjoint(teams[1]):
            return False
        if numbers[0] and numbers[1] and numbers[0].isdisjoint(numbers[1]):
            return False
        return not any((taken[a][at] & taken[b][at]).any() for at in taken[a].keys() & taken[b].keys())

    accepted = []
    for left, right in zip(links.left_key, links.right_key):
        a, b = home[left], home[right]
        ok = a == b or compatible(a, b)
        accepted.append(ok)
        if ok and a != b:
            keep, gone = (a, b) if len(members[a]) >= len(members[b]) else (b, a)
            for key in members[gone]:
                home[key] = keep
            members[keep] |= members.pop(gone)
            for at, frames in taken.pop(gone).items():
                taken[keep][at] = taken[keep][at] | frames if at in taken[keep] else frames
            traits[keep] = tuple(x | y for x, y in zip(traits[keep], traits.pop(gone)))
    return pd.DataFrame({"play_id": links.play_id, "left_key": links.left_key, "right_key": links.right_key, "accepted": accepted})


def _meeting_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct (left_key, right_key) that share a frame; bitmaps travel only where both have one."""
    keys, at = ["left_key", "right_key"], ["shot_id", "chunk"]
    on = lambda side: sets.select(F.col("tracklet_id").alias(f"{side}_key"), *at)
    near = pairs.join(on("left"), "left_key").join(on("right"), ["right_key", *at])
    sides = near.select(*keys, *at, F.explode(F.array(*keys)).alias("tracklet_id")).join(sets, ["tracklet_id", *at])
    common = sides.groupBy(*keys, *at).agg(F.bitmap_count(F.bitmap_and_agg("frames")).alias("_common"))
    return common.filter("_common > 0").select(*keys).distinct()


def _contested_components(parts: DataFrame, known: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components in which some pair of members may be incompatible, their (component, shot, chunk) with two members or more)."""
    numbers = F.when(F.size("jerseys") > 0, F.array_sort("jerseys"))
    differ = [F.coalesce(F.min(c) != F.max(c), F.lit(False)) for c in (F.col("play"), F.col("team"), numbers)]
    unlike = parts.join(known, "id").groupBy("component").agg((differ[0] | differ[1] | differ[2]).alias("_unlike")).filter("_unlike").select("component")
    places = parts.join(sets.select(F.col("tracklet_id").alias("id"), "shot_id", "chunk"), "id")
    crowded = cut_lineage(places.groupBy("component", "shot_id", "chunk").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    return cut_lineage(unlike.union(crowded.select("component")).distinct()), crowded


def safe_links(links: DataFrame, attributes: DataFrame, rows: DataFrame) -> DataFrame:
    """``same`` links with ``accepted``: order decides, so each connected component is walked on its own.

    A group never holds two plays, two teams or two tracklets of one frame, so a link whose own ends differ in one of them
    is refused whatever was taken before, and joins nothing. Components of the other links never interact, so a
    group is one player's candidate views, not a play or a run; where all members agree, every link is taken, and only the
    rest is walked.

    attributes(tracklet_id, play_id, team, jerseys array<int>), rows(shot_id, frame_index, tracklet_id)
    """
    keys = ["left_key", "right_key"]
    same = cut_lineage(links.filter("decision = 'same'").select("play_id", *keys).distinct())
    ids = lambda df: df.select(F.explode(F.array(*keys)).alias("id")).distinct()
    traits = attributes.select(
        F.col("tracklet_id").alias("id"), F.col("play_id").alias("play"), F.when(F.col("team") != "unknown", F.col("team")).alias("team"), "jerseys"
    )
    known = cut_lineage(ids(same).join(traits, "id", "left"))
    sets = cut_lineage(frame_sets(rows, ids(same).withColumnRenamed("id", "tracklet_id")))
    on = lambda side: known.select(F.col("id").alias(f"{side}_key"), *[F.col(c).alias(f"{side}_{c}") for c in ("play", "team", "jerseys")])
    unlike = F.coalesce(F.col("left_play") != F.col("right_play"), F.lit(False)) | F.coalesce(F.col("left_team") != F.col("right_team"), F.lit(False))
    keyed = same.join(on("left"), "left_key").join(on("right"), "right_key").withColumn("_refused", unlike)
    met = _meeting_pairs(keyed.filter("not _refused and left_key <> right_key").select(*keys).distinct(), sets).withColumn("_met", F.lit(True))
    judged = keyed.join(met, keys, "left").withColumn("_refused", F.col("_refused") | F.col("_met").isNotNull()).drop("_met")
    judged = cut_lineage(judged)
    out = ["play_id", *keys]
    refused = judged.filter("_refused").select(*out, F.lit(False).alias("accepted"))

    free = judged.filter("not _refused").drop("_refused")
    parts = connected_components(ids(free), free.select(F.col("left_key").alias("src"), F.col("right_key").alias("dst")))
    contested, crowded = _contested_components(parts, known, sets)
    placed = free.join(parts.select(F.col("id").alias("left_key"), "component"), "left_key")
    taken = placed.join(contested, "component", "left_anti").select(*out, F.lit(True).alias("accepted"))
    walked = placed.join(contested, "component", "left_semi")
    inside = sets.join(parts.withColumnRenamed("id", "tracklet_id"), "tracklet_id").join(crowded, ["component", "shot_id", "chunk"], "left_semi")
    decided = fresh(walked).groupBy("component").cogroup(fresh(inside).groupBy("component")).applyInPandas(
        lambda l, o: _accept_in_order(l, o) if len(l) else pd.DataFrame(columns=["play_id", "left_key", "right_key", "accepted"]),
        "play_id string, left_key string, right_key string, accepted boolean",
    )
    return refused.unionByName(taken).unionByName(decided)


def player_ids(tracklets: DataFrame, links: DataFrame) -> DataFrame:
    """Anonymous ids P01, P02, .. per connected component, numbered by smallest member.

    tracklets(tracklet_id), links(left_key, right_key) already accepted.
    """
    parts = connected_components(
        tracklets.select(F.col("tracklet_id").alias("id")), links.select(F.col("left_key").alias("src"), F.col("right_key").alias("dst"))
    )
    named = total_order(parts.select("component").distinct(), ["component"], "_no").select("component", (F.col("_no") + 1).alias("_no"))
    digits = F.when(F.col("_no") < 100, F.lpad(F.col("_no").cast("string"), 2, "0")).otherwise(F.col("_no").cast("string"))
    return parts.join(named, "component").select(F.col("id").alias("tracklet_id"), F.concat(F.lit("P"), digits).alias("player_id"))


def identity_coverage(identities: DataFrame) -> DataFrame:
    """Tracklets, player ids, and ids seen in more than one shot."""
    per = identities.groupBy("player_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(shot_of("tracklet_id")).alias("shots")
    )
    return per.agg(
        F.sum("n").alias("tracklet_count"), F.count(F.lit(1)).alias("player_id_count"), F.count_if(F.col("shots") > 1).alias("cross_shot_player_ids")
    )


def resolution_ladder(plays: DataFrame) -> DataFrame:
    """Why a play may not be resolved, or ``resolve``.

    plays(play_id, present_shots, has_timeline, has_static, has_shared, timing_eligible, uncalibrated_shots)
    """
    static = ~F.col("has_timeline") & F.col("has_static")
    reason = (
        F.when(F.col("present_shots") < 2, "no calibrated field positions for the aligned shots")
        .when(static & F.col("has_shared"), "cross-shot resolution requires shot-specific calibration")
        .when(static, "legacy static calibration is unvalidated for cross-shot identity; supply a schema-v2 timeline with withheld landmarks")
        .when(~F.col("timing_eligible"), "play-time map or alignment source hash has no passing validation")
        .when(F.col("uncalibrated_shots") > 0, "cross-shot resolution requires shot-specific calibration")
    )
    return plays.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNotNull(), "abstained").otherwise("resolve"))


def shot_pair_tracks(tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(left tracklets per shot pair, all cross-shot tracklet pairs) of each play. tracks(play_id, shot_id, tracklet_id)"""
    shots = tracks.select("play_id", "shot_id").distinct()
    pairs = shots.select("play_id", F.col("shot_id").alias("left_shot")).join(
        shots.select("play_id", F.col("shot_id").alias("right_shot")), "play_id"
    ).filter("left_shot < right_shot")
    left = pairs.join(
        tracks.select("play_id", F.col("shot_id").alias("left_shot"), F.col("tracklet_id").alias("left_key")), ["play_id", "left_shot"]
    )
    right = tracks.select("play_id", F.col("shot_id").alias("right_shot"), F.col("tracklet_id").alias("right_key"))
    return left.withColumn("comparable", F.lit(True)), left.join(right, ["play_id", "right_shot"])


def comparable_pairs(samples: DataFrame, teams: DataFrame, tolerance_s: float) -> DataFrame:
    """Cross-shot pairs that can still be eligible: same eligible team and overlapping play time.

    Every other pair fails a gate without any measurement, so leaving it out
    changes no score and keeps the pair table close to the candidates.
    """
    rated = teams.filter(team_eligible()).select("tracklet_id", "team")
    spans = samples.groupBy("play_id", "shot_id", "tracklet_id").agg(F.min("play_time_s").alias("_lo"), F.max("play_time_s").alias("_hi")).join(rated, "tracklet_id")
    left = spans.select("play_id", "team", F.col("shot_id").alias("left_shot"), F.col("tracklet_id").alias("left_key"), F.col("_lo").alias("_llo"), F.col("_hi").alias("_lhi"))
    right = spans.select("play_id", "team", F.col("shot_id").alias("right_shot"), F.col("tracklet_id").alias("right_key"), "_lo", "_hi")
    met = (F.col("left_shot") < F.col("right_shot")) & (F.col("_llo") <= F.col("_hi") + tolerance_s) & (F.col("_lo") <= F.col("_lhi") + tolerance_s)
    return left.join(right, ["play_id", "team"]).filter(met).select("play_id", "left_shot", "right_shot", "left_key", "right_key")


def evidence_counts(tracks: DataFrame, teams: DataFrame, evidence: DataFrame, cues: DataFrame | None = None) -> DataFrame:
    """(play_id, left_shot, right_shot, rejection_reason, pairs, formed): every cross-shot pair by the first gate it fails.

    ``formed`` pairs are rows of ``evidence``; the others come from counts per team, as comparable pairs lack
    nothing but an ineligible or another team, or any common time. A null reason means eligible.
    """
    rated = teams.filter(team_eligible()).select("tracklet_id", "team")
    known = tracks.select("play_id", "shot_id", "tracklet_id").distinct().join(rated, "tracklet_id", "left")
    per = known.groupBy("play_id", "shot_id").agg(F.count(F.lit(1)).alias("n"), F.count("team").alias("ok"))
    on = lambda df, side: df.select("play_id", *[F.col(c).alias(f"{side}_shot" if c == "shot_id" else c if c == "team" else f"{side}_{c}") for c in df.columns if c != "play_id"])
    both = on(per, "left").join(on(per, "right"), "play_id").filter("left_shot < right_shot")
    by_team = known.filter("team is not null").groupBy("play_id", "shot_id", "team").agg(F.count(F.lit(1)).alias("n"))
    same = on(by_team, "left").join(on(by_team, "right"), ["play_id", "team"]).filter("left_shot < right_shot").groupBy(*SHOTS).agg(
        F.sum(F.col("left_n") * F.col("right_n")).alias("_same")
    )
    full = both.join(same, SHOTS, "left").withColumn("_same", F.coalesce("_same", F.lit(0).cast("bigint")))
    part = lambda reason, n: F.struct(F.lit(reason).alias("rejection_reason"), n.alias("pairs"), F.lit(0).cast("bigint").alias("formed"))
    l, lok, r, rok = (F.col(c) for c in ("left_n", "left_ok", "right_n", "right_ok"))
    listed = full.select(*SHOTS, F.explode(F.array(
        part("left_team_ineligible", (l - lok) * r), part("right_team_ineligible", lok * (r - rok)),
        part("team_mismatch", lok * rok - F.col("_same")), part("insufficient_overlap_samples", F.col("_same")),
    )).alias("_e")).select(*SHOTS, "_e.*")
    # what evidence or a jersey conflict decides moves from the count that held it to its own reason
    base = lambda rows: rows.join(rated.select(F.col("tracklet_id").alias("left_key"), F.col("team").alias("_l")), "left_key", "left").join(
        rated.select(F.col("tracklet_id").alias("right_key"), F.col("team").alias("_r")), "right_key", "left"
    ).withColumn("_held", F.when(F.col("_l").isNull(), "left_team_ineligible").when(F.col("_r").isNull(), "right_team_ineligible").when(
        F.col("_l") != F.col("_r"), "team_mismatch").otherwise("insufficient_overlap_samples"))
    moved = base(evidence.select(*SHOTS, "left_key", "right_key", "rejection_reason")).withColumn("_formed", F.lit(1).cast("bigint"))
    if cues is not None:
        at = lambda side: tracks.select("play_id", F.col("shot_id").alias(f"{side}_shot"), F.col("tracklet_id").alias(f"{side}_key"))
        clash = cues.filter("reviewed_jersey_conflict").select("left_key", "right_key").distinct().join(at("left"), "left_key").join(
            at("right"), ["play_id", "right_key"]).filter("left_shot < right_shot").join(evidence, [*SHOTS, "left_key", "right_key"], "left_anti")
        moved = moved.unionByName(base(clash.select(*SHOTS, "left_key", "right_key", F.lit("reviewed_jersey_mismatch").alias("rejection_reason"))).withColumn("_formed", F.lit(0).cast("bigint")))
    one = F.lit(1).cast("bigint")
    steps = moved.select(*SHOTS, F.explode(F.array(
        F.struct(F.col("_held").alias("rejection_reason"), (-one).alias("pairs"), F.lit(0).cast("bigint").alias("formed")),
        F.struct("rejection_reason", one.alias("pairs"), F.col("_formed").alias("formed")),
    )).alias("_e")).select(*SHOTS, "_e.*")
    return listed.unionByName(steps).groupBy(*SHOTS, "rejection_reason").agg(F.sum("pairs").alias("pairs"), F.sum("formed").alias("formed")).filter("pairs > 0")


def resolve_plays(
    plays: DataFrame, samples: DataFrame, teams: DataFrame, rows: DataFrame, attributes: DataFrame,
    cues: DataFrame | None = None, threshold: float = 0.65, margin: float = 0.1, full_evidence: bool = True, **limits,
) -> dict[str, DataFrame]:
    """All shot pairs of every play at once: evidence, links, accepted links and one status row per play.

    plays(play_id, shot_id) lists the aligned shots; a shot without samples cannot take part.
    ``full_evidence`` keeps a record for every pair; without it only pairs that can be eligible are formed, and
    ``evidence_counts`` tells how many others fail which gate.
    """
    tracks = cut_lineage(samples.select("play_id", "shot_id", "tracklet_id").distinct())
    lefts, pairs = shot_pair_tracks(tracks)
    if not full_evidence:
        pairs = comparable_pairs(samples, teams, limits.get("sample_tolerance_s", 0.05))
    evidence = cut_lineage(pair_evidence(pairs, samples, teams, cues, **limits))  # one row per tracklet pair, read often
    scores = eligible_scores(evidence)
    links = match_tracklets(lefts, scores, threshold, margin)
    agreed = evidence.filter("reviewed_jersey_agreement").select("play_id", "left_key", "right_key", F.lit(True).alias("_agreed"))
    keys = F.when(F.col("right_key").isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(
        F.lit("team_agreement"), F.lit("calibrated_field_position"), F.lit("trajectory_shape"), F.when(F.col("_agreed"), "reviewed_jersey_agreement"),
    )))
    links = links.join(agreed, ["play_id", "left_key", "right_key"], "left").withColumn("evidence_keys", keys).drop("_agreed")
    links = cut_lineage(links)
    decided = safe_links(links, attributes, rows)
    joined = links.join(decided, ["play_id", "left_key", "right_key"], "left")
    final = joined.withColumn("decision", F.when(F.col("accepted").isNotNull() & ~F.col("accepted"), "insufficient_evidence").otherwise(F.col("decision"))).withColumn(
        "rejection_reason", F.when(F.col("accepted").isNotNull() & ~F.col("accepted"), "component_conflict").otherwise(F.col("rejection_reason"))
    ).drop("accepted")
    final = cut_lineage(final)
    counts = evidence_counts(tracks, teams, evidence, cues)
    return {"evidence": evidence, "evidence_counts": counts, "links": final, "status": play_status(plays, tracks, scores, final)}


def play_status(plays: DataFrame, tracks: DataFrame, scores: DataFrame, links: DataFrame) -> DataFrame:
    """resolved / partially_resolved / abstained per play, with what stayed open."""
    shots = plays.select("play_id", "shot_id").distinct()
    present = shots.join(tracks.select("play_id", "shot_id").distinct(), ["play_id", "shot_id"], "left_semi")
    missing = shots.join(present, ["play_id", "shot_id"], "left_anti")
    counts = shots.groupBy("play_id").agg(F.count(F.lit(1)).alias("shots")).join(
        present.groupBy("play_id").agg(F.count(F.lit(1)).alias("present")), "play_id", "left"
    ).withColumn("present", F.coalesce("present", F.lit(0).cast("bigint")))
    per_pair = links.groupBy(*SHOTS).agg(F.count_if(F.col("decision") == "same").alias("_kept"), F.count_if((F.col("decision") == "same") | (F.col("rejection_reason") == "component_conflict")).alias("_same"))
    failed = per_pair.filter("_same = 0").select(*SHOTS)
    # with three or more views a failed pair leaves both of its shots open
    from_failed = failed.join(counts.filter("present > 2"), "play_id", "left_semi").select("play_id", F.explode(F.array("left_shot", "right_shot")).alias("shot_id"))
    sparse = counts.filter("present < 2").select("play_id")
    whole = shots.join(sparse, "play_id", "left_semi").join(missing.select("play_id").distinct(), "play_id", "left_anti")
    unresolved = missing.unionByName(from_failed).unionByName(whole).distinct().groupBy("play_id").agg(
        F.sort_array(F.collect_list("shot_id")).alias("unresolved_shots")  # at most the views of a play
    )
    accepted = links.filter("decision = 'same'")
    linked = accepted.select("play_id", F.explode(F.array("left_key", "right_key")).alias("tracklet_id")).distinct()
    loose = tracks.join(linked, ["play_id", "tracklet_id"], "left_anti").groupBy("play_id").agg(F.count_distinct("tracklet_id").alias("unmatched_tracklets"))
    sums = links.groupBy("play_id").agg(
        F.count_if(F.col("decision") == "same").alias("accepted_links"), F.count_if(F.col("rejection_reason") == "component_conflict").alias("rejected_links")
    )
    cands = scores.groupBy("play_id").agg(F.count(F.lit(1)).alias("candidate_pairs"))
    fails = failed.groupBy("play_id").agg(F.count(F.lit(1)).alias("failed_pairs"))
    out = counts
    for part in (unresolved, loose, sums, cands, fails):
        out = out.join(part, "play_id", "left")
    zero = F.lit(0).cast("bigint")
    for name in ("unmatched_tracklets", "accepted_links", "rejected_links", "candidate_pairs", "failed_pairs"):
        out = out.withColumn(name, F.coalesce(name, zero))
    out = out.withColumn("unresolved_shots", F.coalesce("unresolved_shots", F.array().cast("array<string>")))
    clean = (F.size("unresolved_shots") == 0) & (F.col("rejected_links") == 0) & (F.col("unmatched_tracklets") == 0)
    some = F.col("accepted_links") > 0
    return out.withColumn("status", F.when(some & clean, "resolved").when(some, "partially_resolved").otherwise("abstained")).withColumn(
        "reason",
        F.when(F.col("present") < 2, "fewer than two shots have calibrated field tracks")
        .when(some & clean, "all present shot pairs cleared the reviewed policy")
        .when(some, "some aligned shots or segments lacked an eligible link").otherwise("no candidate pair cleared the reviewed policy"),
    )
