"""Numeric expressions over columns and array vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(value: Column) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(value, 6) + F.lit(0.0)


def ratio(num: Column, den: Column) -> Column:
    """0.0 where the denominator is zero or null."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def non_negative_long(value: Column) -> Column:
    number = value.cast("string").try_cast("bigint")
    return F.when(number >= 0, number)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)
