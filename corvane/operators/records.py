"""Record-level operators: labels, dates, authors, categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import people
from corvane.functions import text as tx
from corvane.plans.skew import hot_key_join


def with_clean_text(df: DataFrame, parts: Sequence[str] = ("title", "abstract"), min_chars: int = 50) -> DataFrame:
    """``text_clean`` of the joined parts; documents shorter than ``min_chars`` after cleaning are dropped."""
    cleaned = df.withColumn("text_clean", tx.clean(tx.joined_text(*parts)))
    return cleaned.where(F.length("text_clean") >= min_chars)


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def with_primary_label(df: DataFrame, label_col: str = "label_str") -> DataFrame:
    return df.withColumn(label_col, tx.primary_category(F.col("categories")))


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Value counts."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, ties to the smaller value."""
    return frequency(df, column).orderBy(F.desc("n"), column).limit(k)


def keep_top_labels(df: DataFrame, k: int, label_col: str = "label_str") -> DataFrame:
    return df.join(top_values(df, label_col, k).select(label_col), label_col, "left_semi")


def fold_rare_labels(df: DataFrame, k: int, label_col: str = "label_str", other: str = "OTHER",
                     out_col: str = "label_folded") -> DataFrame:
    """Labels outside the k most frequent become ``other``."""
    top = top_values(df, label_col, k).select(label_col, F.lit(True).alias("__top"))
    return (df.join(top, label_col, "left")
            .withColumn(out_col, F.when(F.col("__top"), F.col(label_col)).otherwise(F.lit(other)))
            .drop("__top"))


def exploded_categories(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(tx.category_list(F.col("categories"))).alias("category"))


def exploded_authors(df: DataFrame, name=people.short_name, keep: Sequence[str] = ("id",)) -> DataFrame:
    """One row per non-empty author name. ``name`` is ``people.short_name`` or ``people.long_name``."""
    return (df.select(*keep, F.explode("authors_parsed").alias("__parts"))
            .select(*keep, name(F.col("__parts")).alias("author"))
            .where(tx.present(F.col("author"))))


def with_created_year(df: DataFrame) -> DataFrame:
    """``year`` of the first version; rows without one are kept with null."""
    return df.withColumn("year", people.first_version_year(F.col("versions")))


def in_periods(df: DataFrame, periods: Sequence[tuple[int, int]], min_docs: int = 5000,
               year: str | Column = "year") -> DataFrame:
    """Rows repeated once per year window that holds them; windows with fewer than ``min_docs`` rows are left
    out. The windows are a literal array, so no join is needed, and those kept go to every task: a shuffle would bring each
    window's rows to one."""
    windows = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in periods])
    column = F.col(year) if isinstance(year, str) else year
    sliced = (df.withColumn("__period", F.explode(
                  F.filter(windows, lambda p: (column >= p["start"]) & (column <= p["end"]))))
              .withColumn("period", F.concat_ws("_", "__period.start", "__period.end")).drop("__period"))
    big_enough = sliced.groupBy("period").agg(F.count("*").alias("__n")).where(F.col("__n") >= min_docs)
    return sliced.join(F.broadcast(big_enough.select("period")), "period", "left_semi")


def with_pretty_categories(df: DataFrame, category_map: DataFrame, out_col: str = "pretty_categories") -> DataFrame:
    """Category codes replaced by their names (the code itself when unknown), repeats dropped, in order.

    Every distinct ``categories`` string is named once and joined back on the string, strings of very many papers in
    place. Of several names of one code the smallest counts.
    """
    names = (category_map.select("category_id", "pretty_name").na.drop()
             .groupBy("category_id").agg(F.min("pretty_name").alias("pretty_name")))
    given = df.where(F.col("categories").isNotNull())
    strings = given.groupBy("categories").agg(F.count("*").alias("__n"))
    codes = F.filter(F.split(F.trim("categories"), r"\s+"), lambda c: c != "")
    parts = strings.select("categories", F.posexplode(codes).alias("__pos", "category_id")).join(names, "category_id", "left")
    entry = F.struct("__pos", F.coalesce("pretty_name", "category_id").alias("name"))
    named = parts.groupBy("categories").agg(F.array_join(F.array_distinct(F.transform(
        F.array_sort(F.collect_list(entry)), lambda e: e["name"])), "; ").alias(out_col))
    per_string = (strings.join(named, "categories", "left")
                  .select("categories", "__n", F.coalesce(out_col, F.lit("")).alias(out_col)))
    total = given.agg(F.count("*")).scalar()
    done = hot_key_join(given, per_string, "categories", "__n", total).select(*df.columns, out_col)
    return done.unionByName(df.where(F.col("categories").isNull()).withColumn(out_col, F.lit(None).cast("string")))
