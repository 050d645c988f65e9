"""Small scalar helpers: ids, hashes, time, rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed class names that count as a player.
PLAYER_NAMES = ("player", "person", "football_player", "athlete")
# Fixed words that mean "no decision".
UNDECIDED_IDS = ("", "unknown", "ambiguous", "unresolved")
CALIBRATION_STATUSES = ("not_provided", "unvalidated", "valid", "partial", "invalid")
FIT_STATUSES = ("valid", "unvalidated", "invalid", "partial")
RUN_STATUSES = ("complete", "complete_with_unresolved", "incomplete", "failed")


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def config_hash(*fields: Column) -> Column:
    """16 hex digits over the compact JSON of fields given in key order."""
    return short_hash(F.to_json(F.struct(*fields)))


def review_item_id(play: Column, left: Column, right: Column, kind: Column) -> Column:
    blank = F.lit("")
    return short_hash(F.concat_ws("\0", play, F.coalesce(left, blank), F.coalesce(right, blank), kind))


def shot_of(tracklet: str | Column) -> Column:
    return F.substring_index(F.col(tracklet) if isinstance(tracklet, str) else tracklet, ":", 1)


def is_player(class_id: Column, class_name: Column) -> Column:
    return (class_id == 0) | F.lower(class_name).isin(*PLAYER_NAMES)


def seconds(pts: Column, num: Column, den: Column) -> Column:
    return pts * num / den


def zoned_timestamp(text: Column) -> Column:
    """ISO-8601 with an explicit offset, else null."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))


def meaningful_id(value: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(value, F.lit("")))).isin(*UNDECIDED_IDS)


def broken_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks, in the order given; an undecided rule counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def split_rejects(df, rules: dict[str, Column]):
    """(rows that keep every rule, one reject row per broken rule)."""
    marked = df.withColumn("broken", broken_rules(rules))
    good = df.filter(reduce(lambda a, b: a & b, [F.coalesce(ok, F.lit(False)) for ok in rules.values()], F.lit(True)))  # the same, without a list a row
    return good, marked.filter(F.size("broken") > 0).withColumn("rule", F.explode("broken")).drop("broken")
