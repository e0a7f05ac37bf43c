"""Bounding boxes on the 0..1000 canvas, as arrays of four integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CANVAS = 1000


def is_box(box: Column) -> Column:
    """Four numbers on the canvas, in order."""
    inside = F.forall(box, lambda v: v.isNotNull() & (v >= 0) & (v <= CANVAS))
    return F.coalesce((F.size(box) == 4) & inside & (box[0] <= box[2]) & (box[1] <= box[3]), F.lit(False))


def to_canvas(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """A pixel box scaled to the canvas, half to even, clamped and put in order. Sizes must be over 0."""

    def scale(v: Column, size: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(CANVAS), F.bround(v * float(CANVAS) / size).cast("int")))

    ok = (width > 0) & (height > 0)
    a, b, c, d = scale(x1, width), scale(y1, height), scale(x2, width), scale(y2, height)
    return F.when(ok, F.array(F.least(a, c), F.least(b, d), F.greatest(a, c), F.greatest(b, d))).otherwise(F.raise_error(F.lit("page size must be over 0")).cast("array<int>"))


def short_side(box: Column) -> Column:
    return F.least(box[2] - box[0], box[3] - box[1])


def union_of(box: Column) -> Column:
    """Aggregate: the least box that holds all."""
    return F.when(F.count(box) > 0, F.array(F.min(box[0]), F.min(box[1]), F.max(box[2]), F.max(box[3])))
