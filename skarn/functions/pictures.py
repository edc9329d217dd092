"""Measures of pictures held as arrays of numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import apart, with_overlap

#: Limits of near-duplicate pictures.
MOST_ASPECT, MOST_HAMMING, MOST_THUMBNAIL, MOST_CONTENT = 0.03, 48, 0.055, 0.03


def laplacian(gray: Column, width: Column) -> Column:
    """The 4-neighbour Laplacian at every inner pixel of a picture given row by row."""
    height = F.floor(F.size(gray) / width).cast("int")
    at = lambda i: F.get(gray, i)
    inner = F.filter(F.sequence(F.lit(0), F.greatest(F.size(gray) - 1, F.lit(0))), lambda i: (i % width > 0) & (i % width < width - 1) & (i >= width) & (i < (height - 1) * width))
    return F.transform(inner, lambda i: at(i - 1) + at(i + 1) + at(i - width) + at(i + width) - 4 * at(i))


def sharpness(gray: Column, width: Column) -> Column:
    """Variance of the Laplacian; 0 without inner pixels."""
    l = laplacian(gray, width)
    n = F.greatest(F.size(l), F.lit(1))
    mean = F.aggregate(l, F.lit(0.0), lambda s, x: s + x) / n
    return F.aggregate(l, F.lit(0.0), lambda s, x: s + x * x) / n - mean * mean


def photo_state(width: Column, height: Column, sharp: Column, least_side: int = 640, least: float = 12.0) -> Column:
    """unreadable, resolution, blur or ok."""
    return F.when(width.isNull() | height.isNull(), "unreadable").when(F.greatest(width, height) < least_side, "resolution").when(sharp < least, "blur").otherwise("ok")


def unit(v: Column) -> Column:
    """A vector of length 1; a zero vector is an error."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.raise_error(F.lit("a zero vector has no direction")).cast("array<double>"))


def near_duplicate(aspect: Column, hamming: Column, thumbnail: Column, content: Column) -> Column:
    """Alike in shape, and in hash or in thumbnail and content."""
    return (aspect <= MOST_ASPECT) & ((hamming <= MOST_HAMMING) | ((thumbnail <= MOST_THUMBNAIL) & (content <= MOST_CONTENT)))


#: Limits of copies among collected pictures (fixed values); those of hashes are for 1024 bits.
COPY_ASPECT, COPY_HAMMING, COPY_THUMBNAIL, COPY_CONTENT, COPY_CENTRE_HAMMING, COPY_CENTRE_THUMBNAIL = 0.02, 180, 0.06, 0.03, 240, 0.12


def same_picture(aspect: Column, hamming: Column, thumbnail: Column, content: Column, centre_hamming: Column, centre_thumbnail: Column, bits: int = 1024) -> Column:
    """Alike in shape, and in hash, or in the shape of the content and either the thumbnail or hash and thumbnail of the centre."""
    centre = (centre_hamming <= COPY_CENTRE_HAMMING * bits / 1024) & (centre_thumbnail <= COPY_CENTRE_THUMBNAIL)
    return (aspect <= COPY_ASPECT) & ((hamming <= COPY_HAMMING * bits / 1024) | ((content <= COPY_CONTENT) & ((thumbnail <= COPY_THUMBNAIL) | centre)))


def with_homography_state(df: DataFrame, transform: str, width: Column, height: Column, least: float = 0.03, most: float = 8.0, seen_width: Column | None = None, seen_height: Column | None = None) -> DataFrame:
    """Adds state and area_ratio of a 3 by 3 transform given row by row.

    state: missing, bad shape, singular, corners at infinity, not convex, area out
    of range, outside the other picture (of ``seen_width`` by ``seen_height``, if they
    are given; then also the column overlap, the area inside it) or valid. The steps are columns of their own, as each is used many times.
    """
    h = F.col(transform)
    g = lambda i: F.get(h, i)
    det = g(0) * (g(4) * g(8) - g(5) * g(7)) - g(1) * (g(3) * g(8) - g(5) * g(6)) + g(2) * (g(3) * g(7) - g(4) * g(6))
    right, low, zero = width.cast("double") - 1, height.cast("double") - 1, F.lit(0.0)
    row = lambda i, x, y: g(3 * i) * x + g(3 * i + 1) * y + g(3 * i + 2)
    corner = lambda x, y: F.array(F.try_divide(row(0, x, y), row(2, x, y)), F.try_divide(row(1, x, y), row(2, x, y)))
    out = df.withColumn("__det", det).withColumn("__q", F.array(corner(zero, zero), corner(right, zero), corner(right, low), corner(zero, low)))
    x, y = (lambda i, c=c: F.get(F.get("__q", F.lit(i % 4)), c) for c in (0, 1))
    turn = lambda i: (x(i + 1) - x(i)) * (y(i + 2) - y(i + 1)) - (y(i + 1) - y(i)) * (x(i + 2) - x(i + 1))
    edge = lambda i: x(i) * y(i + 1) - x(i + 1) * y(i)
    out = out.withColumn("__turns", F.array(*map(turn, range(4)))).withColumn("__ratio", F.abs(edge(0) + edge(1) + edge(2) + edge(3)) / 2 / F.greatest(width * height, F.lit(1)))
    convex = (F.array_min("__turns") >= 0) | (F.array_max("__turns") <= 0)
    ratio = F.col("__ratio")
    state = (
        F.when(h.isNull(), "homography_missing")
        .when((F.size(h) != 9) | F.exists(h, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), "homography_non_finite_or_bad_shape")
        .when(F.abs("__det") < 1e-12, "homography_singular")
        .when(F.exists("__q", lambda c: F.get(c, 0).isNull() | F.get(c, 1).isNull()), "projected_corners_non_finite")
        .when(~convex, "projected_polygon_not_convex")
        .when((ratio < least) | (ratio > most), "projected_area_out_of_range")
        .otherwise("valid")
    )
    out = out.withColumn("state", state)
    if seen_width is not None:
        out = with_overlap(out.withColumn("__q", F.when(F.col("state") == "valid", F.col("__q"))), "__q", seen_width, seen_height)
        out = out.withColumn("state", F.when((F.col("state") == "valid") & apart(F.col("__q"), seen_width, seen_height), "projection_outside_query").otherwise(F.col("state")))
    return out.withColumn("area_ratio", F.when(F.col("state").isin("valid", "projected_area_out_of_range", "projection_outside_query"), ratio)).drop("__det", "__q", "__turns", "__ratio")
