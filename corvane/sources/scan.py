"""Readers: explicit schemas, pruned columns, edge text, adjacency lists and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import schemas
from corvane.functions.text import hash_fraction, hash_order
from corvane.plans.ranking import running_total

# Header line of an edge file, folder part of a reference-list id, names a citation count may have.
EDGE_HEADER = "src,"
FOLDER = r"^([^/]+)/"
CITATION_COLUMNS = ("citation_count", "citations", "num_citations", "n_citation", "cited_by_count")


def read_papers(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """JSON-lines snapshot; naming columns keeps the parser from materialising the others."""
    papers = spark.read.schema(schemas.PAPER).json(path)
    return papers.select(*[F.col(f"`{c}`") for c in columns]) if columns else papers


def read_category_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CATEGORY_MAP).option("header", True).csv(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """``src,dst`` lines: header dropped, split on the first comma, lines without a comma dropped."""
    line, comma = F.col("value"), F.instr("value", ",")
    return (spark.read.text(path)
            .where(~line.startswith(EDGE_HEADER) & (comma > 0))
            .select(F.substring(line, F.lit(1), comma - 1).alias("src"),
                    F.substring(line, comma + 1, F.length(line)).alias("dst")))


def read_embeddings(spark: SparkSession, path: str, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    return spark.read.parquet(path).select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))


def folder_of(doc_id: Column) -> Column:
    """Category folder of an id like ``cat/0001``; null when it has none."""
    found = F.regexp_extract(doc_id, FOLDER, 1)
    return F.when(found != "", found)


def kept_lists(lists: DataFrame, keep: Sequence[str] | None) -> DataFrame:
    lists = lists.where(F.col("refs").isNotNull())
    return lists if keep is None else lists.where(folder_of(F.col("src")).isin(*keep))


def adjacency_edges(lists: DataFrame, keep: Sequence[str] | None = None,
                    max_edges: int | None = None) -> DataFrame:
    """One row per reference; with ``max_edges`` the first so many in ``src`` order."""
    lists = kept_lists(lists, keep).select(
        "src", F.filter("refs", lambda r: r.isNotNull()).alias("refs"))
    if max_edges is not None:
        counted = running_total(lists, [F.col("src")], F.size("refs").cast("bigint"), "upto")
        left = F.lit(max_edges) - (F.col("upto") - F.size("refs"))
        taken = F.greatest(F.least(F.size("refs").cast("bigint"), left), F.lit(0)).cast("int")
        lists = counted.where(left > 0).select("src", F.slice("refs", F.lit(1), taken).alias("refs"))
    return lists.select("src", F.explode("refs").alias("dst"))


def source_categories(lists: DataFrame) -> DataFrame:
    return (lists.select(folder_of(F.col("src")).alias("category"))
            .where(F.col("category").isNotNull()).distinct())


def out_degree_sample(lists: DataFrame, keep: Sequence[str] | None, stop_at: int) -> DataFrame:
    """Average, largest and total list length over lists in ``src`` order, up to the one that reaches
    ``stop_at`` references."""
    sizes = kept_lists(lists, keep).select("src", F.size("refs").cast("bigint").alias("n"))
    counted = running_total(sizes, [F.col("src")], F.col("n"), "upto")
    return (counted.where(F.col("upto") - F.col("n") < stop_at)
            .agg(F.avg("n").alias("avg_out_degree"), F.coalesce(F.max("n"), F.lit(0)).alias("max_out_degree"),
                 F.coalesce(F.sum("n"), F.lit(0)).alias("total_edges")))


def hash_sample(df: DataFrame, key: str, fraction: float, seed: object) -> DataFrame:
    """Sample fixed by key and seed, whatever the partitioning."""
    return df.where(hash_fraction(F.col(key), seed, fraction))


def shuffled(df: DataFrame, key: str, seed: object) -> DataFrame:
    return df.orderBy(hash_order(F.col(key), seed), key)


def citation_column(df: DataFrame) -> str | None:
    """The first column that holds a citation count, if any does."""
    return next((c for c in CITATION_COLUMNS if c in df.columns), None)
