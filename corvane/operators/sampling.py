"""Samples and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import hash_fraction, hash_order
from corvane.plans.ranking import top_k_per_group


def bernoulli(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def fixed_size(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n random rows."""
    return df.orderBy(F.rand(seed)).limit(n)


def per_class_exact(df: DataFrame, label_col: str, key: str, per_class: int = 1000, seed: object = 42) -> DataFrame:
    """At most ``per_class`` rows of each class, chosen by hash: the same rows on every run."""
    order = [hash_order(F.col(key), seed), F.col(key)]
    return top_k_per_group(df, [label_col], order, per_class, "__rank").drop("__rank")


def per_class_approximate(df: DataFrame, label_col: str, per_class: int = 1000, seed: int = 42) -> DataFrame:
    """About ``per_class`` rows of each class, one pass and no sort: every class is thinned by its own rate."""
    rates = (df.groupBy(label_col).agg(F.count("*").alias("__n"))
             .select(label_col, F.least(F.lit(1.0), F.lit(float(per_class)) / F.col("__n")).alias("__rate")))
    return df.join(rates, label_col).where(F.rand(seed) < F.col("__rate")).drop("__rate")


def hash_split(df: DataFrame, key: str, train: float = 0.8, seed: object = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by key hash: stable under repartitioning and recomputation."""
    chosen = hash_fraction(F.col(key), seed, train)
    return df.where(chosen), df.where(~chosen)


def random_split(df: DataFrame, train: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    first, second = df.randomSplit([train, 1.0 - train], seed=seed)
    return first, second
