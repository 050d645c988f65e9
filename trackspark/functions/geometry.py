"""Box, homography and polygon arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackspark.functions.field import FIELD_LENGTH_YARDS, FIELD_WIDTH_YARDS

BOX = ("x1", "y1", "x2", "y2")
MATRIX = tuple(f"m{row}{column}" for row in range(3) for column in range(3))


def cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(name) if isinstance(name, str) else name for name in names]


def finite(*values: str | Column) -> Column:
    result = F.lit(True)
    for value in cols(values):
        number = value.cast("double")
        result = result & number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    return result


def box_ok(box: Sequence[str | Column] = BOX) -> Column:
    x1, y1, x2, y2 = cols(box)
    return finite(x1, y1, x2, y2) & (x2 > x1) & (y2 > y1)


def iou(left: Sequence[str | Column], right: Sequence[str | Column]) -> Column:
    """Intersection over union; 0 when the union is empty."""
    ax1, ay1, ax2, ay2 = cols(left)
    bx1, by1, bx2, by2 = cols(right)
    zero = F.lit(0.0)
    side = lambda low, high: F.greatest(zero, high - low)
    shared = side(F.greatest(ax1, bx1), F.least(ax2, bx2)) * side(F.greatest(ay1, by1), F.least(ay2, by2))
    union = side(ax1, ax2) * side(ay1, ay2) + side(bx1, bx2) * side(by1, by2) - shared
    return F.when(union == 0, zero).otherwise(shared / union)


def contact_x(box: Sequence[str | Column] = BOX) -> Column:
    x1, _, x2, _ = cols(box)
    return (x1 + x2) / F.lit(2.0)


def contact_y(box: Sequence[str | Column] = BOX) -> Column:
    return cols(box)[3]


def matrix_usable(prefix: str = "") -> Column:
    """A fit may project: four inliers and a bounded median pixel error."""
    c = lambda name: F.col(prefix + name)
    return (
        (c("inlier_count") >= 4)
        & finite(c("median_error_px"))
        & (c("median_error_px") <= c("reprojection_threshold_px") * 2.0)
        & finite(c("median_error_yards"))
    )


def identity_eligible(prefix: str = "") -> Column:
    c = lambda name: F.col(prefix + name)
    return F.coalesce(
        matrix_usable(prefix)
        & (c("status") == "valid")
        & (c("withheld_point_count") > 0)
        & c("withheld_p95_error_yards").isNotNull(),
        F.lit(False),
    )


def project(x: Column, y: Column, matrix: Sequence[str | Column] = MATRIX, usable: Column | None = None) -> Column:
    """Image point to ``struct(x, y)`` in yards, null off the field or without a usable fit."""
    m = cols(matrix)
    w = m[6] * x + m[7] * y + m[8]
    safe = F.when(F.abs(w) > 1e-9, w)
    fx = (m[0] * x + m[1] * y + m[2]) / safe
    fy = (m[3] * x + m[4] * y + m[5]) / safe
    on_field = fx.between(0.0, FIELD_LENGTH_YARDS) & fy.between(0.0, FIELD_WIDTH_YARDS)  # false for NaN as well
    if usable is not None:
        on_field = usable & on_field
    return F.when(on_field, F.struct(F.bround(fx, 12).alias("x"), F.bround(fy, 12).alias("y")))


def projection_sensitivity(
    x: Column, y: Column, radius: float = 1.0, matrix: Sequence[str | Column] = MATRIX, usable: Column | None = None
) -> Column:
    """Largest yard shift over four pixel offsets; 0 when no neighbour projects, null without a base."""
    offsets = F.array(*[
        F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
        for dx, dy in ((0.0, 0.0), (radius, 0.0), (-radius, 0.0), (0.0, radius), (0.0, -radius))
    ])
    m = cols(matrix)
    raw = F.transform(offsets, lambda o: F.struct(
        (m[0] * (x + o["dx"]) + m[1] * (y + o["dy"]) + m[2]).alias("nx"),
        (m[3] * (x + o["dx"]) + m[4] * (y + o["dy"]) + m[5]).alias("ny"),
        (m[6] * (x + o["dx"]) + m[7] * (y + o["dy"]) + m[8]).alias("w"),
    ))
    mapped = F.transform(raw, lambda r: F.when(
        F.abs(r["w"]) > 1e-9, F.struct(F.bround(r["nx"] / r["w"], 12).alias("x"), F.bround(r["ny"] / r["w"], 12).alias("y"))
    ))
    inside = lambda p: p["x"].between(0.0, FIELD_LENGTH_YARDS) & p["y"].between(0.0, FIELD_WIDTH_YARDS)
    points = F.transform(mapped, lambda p: F.when(inside(p) if usable is None else usable & inside(p), p))
    shift = lambda points: F.transform(
        F.slice(points, 2, 4), lambda p: F.hypot(p["x"] - F.get(points, F.lit(0))["x"], p["y"] - F.get(points, F.lit(0))["y"])
    )
    largest = F.transform(
        F.array(points),
        lambda ps: F.when(F.get(ps, F.lit(0)).isNotNull(), F.coalesce(F.array_max(F.array_compact(shift(ps))), F.lit(0.0))),
    )
    return F.get(largest, F.lit(0))


def in_polygon(x: Column, y: Column, polygon: str | Column) -> Column:
    """Inside or on an edge of ``array<struct<x,y>>`` (at least three points)."""
    points = F.col(polygon) if isinstance(polygon, str) else polygon
    turned = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    edges = F.zip_with(points, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    cross = lambda e: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])
    on_edge = F.exists(
        edges,
        lambda e: (F.abs(cross(e)) < 1e-9)
        & x.between(F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"]))
        & y.between(F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"])),
    )
    crossed = F.filter(
        edges,
        lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y))
        & (
            x
            < (e["b"]["x"] - e["a"]["x"])
            * (y - e["a"]["y"])
            / F.when(e["b"]["y"] != e["a"]["y"], e["b"]["y"] - e["a"]["y"])
            + e["a"]["x"]
        ),
    )
    return F.coalesce(on_edge, F.lit(False)) | (F.size(crossed) % 2 == 1)
