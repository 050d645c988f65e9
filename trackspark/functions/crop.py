"""Boxes and points between source image, crop and labelling task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackspark.functions.geometry import BOX, box_ok, cols, finite

EDGE_SLACK = 1e-6
CROP = ("cx1", "cy1", "cx2", "cy2")
TASK = ("task_width", "task_height")


def _box(values: Sequence[Column]) -> Column:
    return F.struct(*[v.alias(n) for v, n in zip(values, BOX)])


def box_to_task(box=BOX, crop=CROP, task=TASK) -> Column:
    """Source box in task pixels, null when the box is broken or leaves the crop."""
    x1, y1, x2, y2 = cols(box)
    a, b, c, d = cols(crop)
    w, h = cols(task)
    sx, sy = w / (c - a), h / (d - b)
    out = ((x1 - a) * sx, (y1 - b) * sy, (x2 - a) * sx, (y2 - b) * sy)
    inside = (out[0] >= -EDGE_SLACK) & (out[1] >= -EDGE_SLACK) & (out[2] <= w + EDGE_SLACK) & (out[3] <= h + EDGE_SLACK)
    return F.when(box_ok(box) & box_ok(crop) & inside, _box(out))


def box_to_source(box=BOX, crop=CROP, task=TASK) -> Column:
    """Task box in source pixels, six places."""
    x1, y1, x2, y2 = cols(box)
    a, b, c, d = cols(crop)
    w, h = cols(task)
    sx, sy = (c - a) / w, (d - b) / h
    out = (a + x1 * sx, b + y1 * sy, a + x2 * sx, b + y2 * sy)
    return F.when(box_ok(box), _box([F.bround(v, 6) for v in out]))


def point_to_task(x: Column, y: Column, crop=CROP, task=TASK) -> Column:
    a, b, c, d = cols(crop)
    w, h = cols(task)
    inside = finite(x, y) & x.between(a, c) & y.between(b, d)
    return F.when(inside, F.struct(((x - a) * w / (c - a)).alias("x"), ((y - b) * h / (d - b)).alias("y")))


def point_to_source(x: Column, y: Column, crop=CROP, task=TASK) -> Column:
    a, b, c, d = cols(crop)
    w, h = cols(task)
    inside = finite(x, y) & x.between(F.lit(0.0), w) & y.between(F.lit(0.0), h)
    return F.when(
        inside,
        F.struct(F.bround(a + x * (c - a) / w, 6).alias("x"), F.bround(b + y * (d - b) / h, 6).alias("y")),
    )


def crop_box_to_source(box=BOX, crop=CROP, resize=TASK) -> Column:
    """Box of a crop (optionally resized) in source pixels; null resize keeps the scale."""
    x1, y1, x2, y2 = cols(box)
    a, b, c, d = cols(crop)
    w, h = cols(resize)
    ok = box_ok(box) & box_ok(crop) & (w.isNull() | ((w > 0) & (h > 0)))
    sx, sy = F.coalesce((c - a) / w, F.lit(1.0)), F.coalesce((d - b) / h, F.lit(1.0))
    return F.when(ok, _box([a + x1 * sx, b + y1 * sy, a + x2 * sx, b + y2 * sy]))


def clip_to_crop(box=BOX, crop=CROP) -> Column:
    """Box cut to the crop, null when nothing is left."""
    x1, y1, x2, y2 = cols(box)
    a, b, c, d = cols(crop)
    out = (F.greatest(x1, a), F.greatest(y1, b), F.least(x2, c), F.least(y2, d))
    return F.when((out[2] > out[0]) & (out[3] > out[1]), _box(out))
