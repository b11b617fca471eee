"""Vector functions on arrays of doubles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0 or the lengths differ."""
    under = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (under == 0), 0.0).otherwise(dot(a, b) / F.nullif(under, F.lit(0.0)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: x / F.nullif(n, F.lit(0.0))))


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def variance(a: Column) -> Column:
    m = mean(a)
    return F.try_divide(total(F.transform(a, lambda x: (x - m) * (x - m))), F.size(a))


def sparsity(a: Column, under: float = 0.01) -> Column:
    return F.try_divide(F.size(F.filter(a, lambda x: F.abs(x) < under)), F.size(a))


def entropy(a: Column) -> Column:
    """Shannon entropy of the absolute weights, by its most."""
    weight = total(F.transform(a, F.abs))
    bits = total(F.transform(a, lambda x: F.when(x == 0, 0.0).otherwise(-(F.abs(x) / weight) * F.log2(F.nullif(F.abs(x) / weight, F.lit(0.0))))))
    return F.when((weight == 0) | (F.size(a) < 2), 0.0).otherwise(bits / F.log2(F.size(a).cast("double")))


def nearly_equal(a: Column, b: Column, within: float = 1e-4) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= within), lambda ok: ok)


def half_up(x: Column) -> Column:
    """Rounds halves toward plus infinity."""
    return F.floor(x + 0.5)


def quantised(a: Column, bits: int = 8) -> Column:
    """struct(codes, scale, zero): affine codes; a constant vector has scale 0 and codes 0."""
    low, high = -(2 ** (bits - 1)), 2 ** (bits - 1) - 1
    least, most = F.array_min(a), F.array_max(a)
    scale = (most - least) / float(high - low)
    safe = F.nullif(scale, F.lit(0.0))
    zero = F.coalesce(half_up(F.lit(float(low)) - least / safe), F.lit(0)).cast("long")
    inside = lambda code: F.greatest(F.lit(low).cast("long"), F.least(F.lit(high).cast("long"), code))
    codes = F.transform(a, lambda x: F.when(scale == 0, F.lit(0).cast("long")).otherwise(inside(half_up(x / safe + zero))))
    return F.struct(codes.alias("codes"), scale.alias("scale"), zero.alias("zero"))


def restored(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: (c - q["zero"]) * q["scale"])
