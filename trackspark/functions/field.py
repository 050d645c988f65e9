"""Field constants and semantic landmarks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the field, in yards.
FIELD_LENGTH_YARDS = 120.0
FIELD_WIDTH_YARDS = 160.0 / 3.0
GOAL_LINES_X = (10.0, 110.0)
HASH_NEAR_YARDS = 70.75 / 3.0
HASH_FAR_YARDS = FIELD_WIDTH_YARDS - HASH_NEAR_YARDS

# Fixed words of landmark ids.
HASH_WORDS = ("hash", "hashmark", "hashmarks")
NEAR_WORDS = ("near", "home", "a")
FAR_WORDS = ("far", "away", "b")
WEST_WORDS = ("west", "left", "home", "a")
EAST_WORDS = ("east", "right", "away", "b")


def on_field(x: Column, y: Column) -> Column:
    return F.coalesce(x.between(0.0, FIELD_LENGTH_YARDS) & y.between(0.0, FIELD_WIDTH_YARDS), F.lit(False))


def landmark_point(landmark: Column) -> Column:
    """``struct(x, y)`` of a landmark id, null when the id is not specific enough."""
    words = F.filter(F.transform(F.split(landmark, r"[:/\-]+"), lambda w: F.lower(F.trim(w))), lambda w: w != "")
    head = F.get(words, F.lit(0))
    spelled_line = head.isin("goal", "end") & F.replace(
        F.coalesce(F.get(words, F.lit(1)), F.lit("")), F.lit("_"), F.lit("")
    ).isin("line", "lines")
    tokens = F.when(spelled_line, F.concat(F.slice(words, 1, 1), F.slice(words, 3, 1000))).otherwise(words)
    count = F.size(tokens)
    kind = F.replace(head, F.lit("_"), F.lit(""))
    second = F.get(tokens, F.lit(1))
    row = F.get(tokens, count - 1)
    marked_hash = (count >= 4) & F.get(tokens, count - 2).isin(*HASH_WORDS)
    hash_row = F.when(row.isin(*NEAR_WORDS), HASH_NEAR_YARDS).when(row.isin(*FAR_WORDS), HASH_FAR_YARDS)

    yard = F.expr("1.0D") * second.try_cast("double")
    yard_row = F.when(marked_hash, hash_row).otherwise(
        F.when(row.isin("near", "sideline"), 0.0)
        .when(row == "far", FIELD_WIDTH_YARDS)
        .when(row == "hash_near", HASH_NEAR_YARDS)
        .when(row == "hash_far", HASH_FAR_YARDS)
    )
    west_x, east_x = GOAL_LINES_X
    goal = F.when(second.isin(*WEST_WORDS), west_x).when(second.isin(*EAST_WORDS), east_x)
    end = F.when(second.isin(*WEST_WORDS), 0.0).when(second.isin(*EAST_WORDS), FIELD_LENGTH_YARDS)
    line_row = F.coalesce(
        F.when(marked_hash, hash_row),
        F.when(row.isin("near", "sideline"), 0.0)
        .when(row == "far", FIELD_WIDTH_YARDS)
        .when(row.isin("hash_near", "hash", "home"), HASH_NEAR_YARDS)
        .when(row.isin("hash_far", "away"), HASH_FAR_YARDS),
    )
    x = (
        F.when(kind.isin("yardline", "yard") & yard.between(0.0, FIELD_LENGTH_YARDS), yard)
        .when(kind.isin("goal", "goalline") & (count >= 4), goal)
        .when((kind == "endline") & (count >= 4), end)
    )
    y = F.when(kind.isin("yardline", "yard"), yard_row).otherwise(line_row)
    return F.when((F.size(words) >= 3) & x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))
