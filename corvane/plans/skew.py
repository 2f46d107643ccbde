"""Join a large table to one row per key when a few keys hold much of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_PARTS of the rows, so there are fewer than HOT_PARTS hot keys.
HOT_PARTS = 1000


def hot_key_join(big: DataFrame, per_key: DataFrame, key: str, weight: str, total: int | Column) -> DataFrame:
    """Inner join of ``big`` with ``per_key``, which has one row per key and in ``weight`` (at least) the number
    of ``big`` rows of that key; ``total`` is the number of ``big`` rows.

    Rows of hot keys are joined where they lie, against a broadcast of fewer than HOT_PARTS rows (the weights add
    up to ``total``), and never shuffled. The others go through the ordinary shuffle join.
    """
    hot = per_key.where(F.col(weight) * HOT_PARTS > total)
    cold = per_key.where(F.col(weight) * HOT_PARTS <= total)
    in_place = big.join(F.broadcast(hot), key)
    shuffled = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return in_place.unionByName(shuffled)
