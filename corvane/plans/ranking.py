"""Ranking patterns that stay distributed when one key, or the whole table, is large."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.plans.runtime import cut_lineage


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k in each group, ``order`` deciding.

    Up to the optimizer's group-limit threshold Catalyst prunes each task to k rows a group before the
    shuffle. Beyond it the same pruning is done here: first k per (group, salt), then k per group, so a group
    holding a third of the table never lands whole in one task.
    """
    conf = df.sparkSession.conf
    threshold = int(conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > threshold:
        salts = max(2, int(conf.get("spark.sql.shuffle.partitions", "200")))
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
        inner = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = (salted.withColumn("__rn", F.row_number().over(inner))
              .where(F.col("__rn") <= k).drop("__rn", "__salt"))
    window = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(window))
            .where(F.col(rank_col) <= k)
            .withColumn(rank_col, F.col(rank_col).cast("bigint")))


def best_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the greatest ``order`` tuple in each group, as an aggregate: map-side combined, so a hot
    group costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, "__best.*").select(*df.columns)


def running_total(df: DataFrame, order: Sequence[Column], value: Column,
                  out_col: str = "running_total") -> DataFrame:
    """Running sum of ``value`` over a total order without a single-task window.

    The range-sorted frame is written once, each partition sums its own rows, and only one total per partition
    meets in the offset window.
    """
    pieces = cut_lineage(
        df.withColumn("__value", value).orderBy(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__pos", F.monotonically_increasing_id())
    )
    local = Window.partitionBy("__part").orderBy("__pos")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (pieces.groupBy("__part").agg(F.sum("__value").alias("__total"))
               .select("__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset")))
    return (pieces.withColumn("__local", F.sum("__value").over(local))
            .join(offsets, "__part")
            .withColumn(out_col, F.col("__local") + F.col("__offset"))
            .drop("__value", "__part", "__pos", "__local", "__offset"))


def global_rank(df: DataFrame, order: Sequence[Column], out_col: str = "rank") -> DataFrame:
    """1-based position of every row in a total order."""
    return running_total(df, order, F.lit(1).cast("bigint"), out_col)


def first_rows(df: DataFrame, order: Sequence[Column], coarse: Column, k: int) -> DataFrame:
    """The first ``k`` rows of a total order without any task or the driver holding k rows.

    ``coarse`` never falls along the order. Rows are counted per value of it; those before the value at which the k-th row
    stands are all in, and only the rows of that one value are ranked, over range partitions.
    """
    keyed = cut_lineage(df.withColumn("__coarse", coarse))
    sizes = keyed.groupBy("__coarse").agg(F.count("*").alias("__n"))
    sums = running_total(sizes, [F.col("__coarse")], F.col("__n"), "__upto")
    edge = sums.where(F.col("__upto") >= k).orderBy("__coarse").first()
    if edge is None:
        return keyed.drop("__coarse")
    before = keyed.where(F.col("__coarse") < edge["__coarse"]).drop("__coarse")
    there = keyed.where(F.col("__coarse") == edge["__coarse"]).drop("__coarse")
    if edge["__upto"] == k:
        return before.unionByName(there)
    rest = k - (edge["__upto"] - edge["__n"])
    return before.unionByName(global_rank(there, order, "__place").where(F.col("__place") <= rest).drop("__place"))
