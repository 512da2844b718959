"""Difference hashes and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_hash(vector: Column, bits: int = 63) -> Column:
    """A difference hash of a vector: bit i says whether component i exceeds component i+1, the first bit highest."""
    step = lambda a, i: a * 2 + (F.get(vector, i - 1) > F.get(vector, i)).cast("bigint")
    return F.aggregate(F.sequence(F.lit(1), F.lit(bits)), F.lit(0).cast("bigint"), step)


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits; null if either is null."""
    return F.bit_count(a.bitwiseXOR(b))


def hash_hex(h: Column) -> Column:
    """16 lowercase hex digits of a 64-bit hash, read as unsigned."""
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, 0 for a null vector."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.coalesce(F.aggregate(products, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def mean_abs_delta(a: Column, b: Column) -> Column:
    """Mean absolute difference of two equally long arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x.cast("double"))
    p = F.filter(F.transform(counts, lambda c: c.cast("double") / total), lambda x: x > 0)
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - x * F.log2(x))
