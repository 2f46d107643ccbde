"""A training corpus from the documents: reject toxic ones, take repeated lines out, keep one of near-duplicates, drop
those that hold benchmark passages, and mix the sources to their target weights.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is written as Parquet and
read again as the next one's docs. All but the last return the columns they got. The last returns one row per kept
document with the words the mix takes of it.

Defined results, beside those of the operators: a text that lost lines has its ``n_chars`` counted again; a document
whose last words went as repeated lines goes with them; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import lines, mixing, simhash, spaced, toxicity
from corvane.llm.common import fresh, table
from corvane.plans.runtime import new_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.given_categories())
    return toxicity.reject(docs, chain, "toxic")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    removed = fresh(docs, "n_removed")
    changed = lines.dedup_lines(docs, drop_emptied=True, count_col=removed)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("bigint"))
                                     .otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs, shingle=4, max_distance=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spaced.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
]

# Fitted models, hashes of texts and ball hashing have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
