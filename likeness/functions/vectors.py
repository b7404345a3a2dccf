"""Vectors, hashes and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in order."""
    terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)


def l2_normalise(v: Column, least: float = 1e-12) -> Column:
    """``v`` over its norm, the norm at least ``least``."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(least))
    return F.element_at(F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x.cast("double") / n)), 1)


def hex_to_long(digits: Column) -> Column:
    """Up to 16 hex digits as a signed 64-bit number; the sign plays no part in bit operations."""
    return F.conv(digits, 16, -10).cast("long")


def sign_hash(v: Column) -> Column:
    """One bit per component, set where it is positive: a 64-bit hash of a 64-component vector."""
    return F.aggregate(
        F.transform(v, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b),
    )


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def safe_divide(a: Column, b: Column) -> Column:
    """a/b, and 0 where b is not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def lucene_idf(n: Column, df: Column) -> Column:
    """Always positive, so that common terms add a little instead of taking away."""
    return F.log1p((n - df + 0.5) / (df + 0.5))


def pool_idf(n: Column, df: Column) -> Column:
    return F.log1p(n.cast("double") / df)


def bm25_weight(idf: Column, tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
