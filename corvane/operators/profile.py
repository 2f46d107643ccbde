"""Profiling: uniqueness, missing values, duplicate differences, value profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators.records import frequency
from corvane.plans.ranking import best_per_group


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def uniqueness(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows, distinct keys and keys that occur more than once, in one pass over the per-key counts."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
                       F.count(key).alias("distinct_ids"),
                       count_if(F.col("n") > 1).alias("duplicated_ids"))


def duplicated(df: DataFrame, key: str = "id") -> DataFrame:
    return frequency(df, key).where(F.col("n") > 1)


def latest_per_key(df: DataFrame, key: str = "id", order: Sequence[Column] = ()) -> DataFrame:
    """The newest row of each key; ``order`` lists the columns that decide, the most important first."""
    return best_per_group(df, [key], order or [F.col("update_date")])


def null_counts(df: DataFrame) -> DataFrame:
    """One row: nulls per column, all columns in one pass."""
    return df.agg(*[count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: null or empty values per flat column."""
    flat = columns or [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "struct", "map")]
    return df.agg(*[count_if(~F.coalesce(tx.present(F.col(f"`{c}`").cast("string")), F.lit(False))).alias(c)
                    for c in flat])


def missing_author_parts(df: DataFrame) -> DataFrame:
    """Missing values inside the nested author lists, and the most parts any author has."""
    author = df.select("authors_parsed", F.explode_outer("authors_parsed").alias("a"))

    def part(i: int) -> Column:
        return ~F.coalesce(tx.present(F.get("a", F.lit(i))), F.lit(False))

    return author.agg(
        count_if(F.col("authors_parsed").isNull()).alias("lists_null"),
        count_if(F.col("a").isNull()).alias("authors_null"),
        count_if(part(0)).alias("surname_missing"),
        count_if(part(1)).alias("first_names_missing"),
        count_if(part(2)).alias("suffix_missing"),
        F.max(F.size("a")).cast("bigint").alias("max_parts"),
    )


def missing_version_parts(df: DataFrame) -> DataFrame:
    version = df.select("versions", F.explode_outer("versions").alias("v"))

    def part(name: str) -> Column:
        return ~F.coalesce(tx.present(F.col("v")[name]), F.lit(False))

    return version.agg(
        count_if(F.col("versions").isNull()).alias("lists_null"),
        count_if(F.col("v").isNull()).alias("versions_null"),
        count_if(part("created")).alias("created_missing"),
        count_if(part("version")).alias("version_missing"),
    )


def duplicate_differences(df: DataFrame, key: str = "id", columns: Sequence[str] | None = None) -> DataFrame:
    """(key, column, distinct values) for duplicated keys and the columns in which their rows differ.

    Null is a value of its own. One aggregate finds the keys and columns that differ (smallest and largest value, or
    some but not all null); only their cells are stacked, combined before the shuffle, and counted.
    """
    columns = list(columns or [c for c in df.columns if c != key])
    differs = F.array(*[F.when((F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count("*"))), F.lit(c)) for c in columns])
    found = (df.groupBy(key).agg(F.array_compact(differs).alias("__differ"), F.count("*").alias("__n"))
             .where((F.col("__n") > 1) & (F.size("__differ") > 0)))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    wanted = F.filter(cells, lambda cell: F.array_contains("__differ", cell["column"]))
    distinct = (df.join(found.select(key, "__differ"), key).select(key, F.explode(wanted).alias("cell"))
                .select(key, "cell.*").distinct())
    return distinct.groupBy(key, "column").agg(F.count("*").alias("n_values"))


def value_profile(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """Present values, distinct values and the ``top`` most frequent ones: rows (measure, value, n)."""
    counts = frequency(df.where(tx.present(F.col(column).cast("string"))), column)
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("present"), F.count("*").alias("distinct"))
    measures = totals.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.lit(None).cast("string").alias("value"), F.col(m).alias("n"))
        for m in ("present", "distinct")])).alias("m")).select("m.*")
    most = (counts.orderBy(F.desc("n"), column).limit(top)
            .select(F.lit("top").alias("measure"), F.col(column).cast("string").alias("value"), "n"))
    return measures.unionByName(most)


def distinctness(df: DataFrame, *columns: str) -> DataFrame:
    """(column, present rows, distinct values). The cells are stacked, so all columns share one shuffle, as digests of
    256 bits where they are longer than that."""
    def short(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.when(F.length(text) > 64, F.sha2(text, 256)).otherwise(text)

    cells = F.array(*[F.struct(F.lit(c).alias("column"), short(c).alias("value")) for c in columns])
    counts = (df.select(F.explode(cells).alias("cell")).select("cell.*")
              .groupBy("column", "value").agg(F.count("*").alias("n")))
    return counts.where(F.col("value").isNotNull()).groupBy("column").agg(
        F.sum("n").alias("present"), F.count("*").alias("distinct_values"))
