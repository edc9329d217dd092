"""Boxes and crops as column expressions; a box is a struct of x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_CROP = 8
MOST_AREA_RATIO = 40.0


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """With its corners in order; null if one is missing."""
    own = F.struct(F.least(x1, x2).alias("x1"), F.least(y1, y2).alias("y1"), F.greatest(x1, x2).alias("x2"), F.greatest(y1, y2).alias("y2"))
    return F.when(x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull(), own)


def box_of(points: Column) -> Column:
    """The box around an array of (x, y) arrays; null for fewer than two points."""
    xs, ys = F.transform(points, lambda p: F.get(p, 0)), F.transform(points, lambda p: F.get(p, 1))
    return F.when(F.size(points) >= 2, box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def area(b: Column) -> Column:
    return F.greatest(b.x2 - b.x1, F.lit(0.0)) * F.greatest(b.y2 - b.y1, F.lit(0.0))


def text_coverage(boxes: Column, width: Column, height: Column) -> Column:
    """(area, height): share of the picture covered by boxes, and the tallest box by the picture's shorter side; zeros without boxes."""
    own = F.filter(boxes, lambda b: b.isNotNull())
    covered = F.aggregate(own, F.lit(0.0), lambda s, b: s + area(b)) / F.greatest(width * height, F.lit(1))
    tallest = F.array_max(F.transform(own, lambda b: b.y2 - b.y1)) / F.greatest(F.least(width, height), F.lit(1))
    return F.struct(F.coalesce(covered, F.lit(0.0)).alias("area"), F.coalesce(tallest, F.lit(0.0)).alias("height"))


def center_crop(width: Column, height: Column, ratio: float) -> Column:
    """The centred box of a share of each side, rounded half to even, of one pixel at least."""
    side = lambda n: F.greatest(F.lit(1), F.least(n, F.bround(n * ratio).cast("int")))
    w, h = side(width), side(height)
    left, top = F.floor((width - w) / 2).cast("int"), F.floor((height - h) / 2).cast("int")
    return F.struct(left.alias("x1"), top.alias("y1"), (left + w).alias("x2"), (top + h).alias("y2"))


def clipped(b: Column, width: Column, height: Column) -> Column:
    """A box in whole pixels inside the picture; null if a side is below LEAST_CROP."""
    low = lambda x: F.greatest(F.lit(0.0), x).cast("int")
    x1, y1, x2, y2 = low(b.x1), low(b.y1), F.least(width.cast("double"), b.x2).cast("int"), F.least(height.cast("double"), b.y2).cast("int")
    return F.when((x2 - x1 >= LEAST_CROP) & (y2 - y1 >= LEAST_CROP), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def comparable(crop: Column, reference: Column) -> Column:
    """True if the crop's area is between 1/40 and 40 times the reference box's (1 at least)."""
    ratio = (crop.x2 - crop.x1) * (crop.y2 - crop.y1) / F.greatest((reference.x2 - reference.x1) * (reference.y2 - reference.y1), F.lit(1.0))
    return ratio.between(1 / MOST_AREA_RATIO, MOST_AREA_RATIO)


def thumbnail_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two byte arrays of one length, 0 to 1."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / (F.size(a) * 255)
