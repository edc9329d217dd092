"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if an element is null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if either norm is 0, an error if sizes differ."""
    size = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in size")).cast("double")).otherwise(norm(a) * norm(b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def is_normalized(a: Column, tolerance: float = 0.002) -> Column:
    """Finite elements and a norm of 1 within ``tolerance``."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return finite & (F.abs(norm(a) - 1) <= tolerance)


def sign_bits(a: Column, bits: int = 64) -> Column:
    """Signs of the first ``bits`` elements as one bigint."""
    flags = F.transform(F.slice(a, 1, bits), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(flags, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
