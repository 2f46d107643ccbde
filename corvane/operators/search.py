"""Similar documents: inverted index, TF-IDF cosine, embedding neighbours, two-stage reranking, method comparison. BM25 on
a stored index is in ``textindex``, neighbours by a stored index of vectors in ``neighbours``.

Queries come as a frame and are answered together. Frames of hits are ``(query_id, doc_id, score, rank)``; scores
are compared at nine decimals and ties go to the smaller id, so equal documents rank the same in every run.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import numeric
from corvane.functions import text as tx
from corvane.operators import features
from corvane.plans.ranking import top_k_per_group
from corvane.plans.runtime import cut_lineage, cut_lineage_dealt, stored

# Saturation and length normalisation of BM25.
K1 = 1.2
B = 0.75
COMMON = 1 << 16  # terms whose weights go to every task
QUERY_BLOCK = 4096  # query vectors that a task multiplies at once
ROWS_AT_ONCE = 2048  # rows that they are multiplied with


def ranked(scores: DataFrame, k: int) -> DataFrame:
    order = [F.desc(F.round("score", 9)), F.col("doc_id")]
    return top_k_per_group(scores.select("query_id", "doc_id", "score"), ["query_id"], order, k)


def without_self(hits: DataFrame) -> DataFrame:
    return hits.where(F.col("query_id") != F.col("doc_id"))


def query_terms(queries: DataFrame, text_col: str = "text", min_length: int = 1,
                drop_stop_words: bool = False) -> DataFrame:
    """(query_id, term, qtf) of cleaned query texts."""
    cleaned = queries.select("query_id", tx.clean(F.col(text_col)).alias("text_clean"))
    tokens = features.tokenised(cleaned, min_length=min_length, drop_stop_words=drop_stop_words)
    return features.term_counts(tokens, "query_id").withColumnRenamed("tf", "qtf")


# ---- inverted index ---------------------------------------------------------------------------------

def inverted_index(docs: DataFrame, key: str = "id", text_col: str = "text") -> DataFrame:
    """(term, doc_id, tf, doc_length), documents without tokens left out."""
    tokens = features.tokenised(docs.select(F.col(key).alias("doc_id"), F.col(text_col).alias("text_clean")))
    sized = tokens.withColumn("doc_length", F.size("tokens").cast("bigint")).where(F.col("doc_length") > 0)
    return features.term_counts(sized, "doc_id", keep=["doc_length"]).select("term", "doc_id", "tf", "doc_length")


def write_index(index: DataFrame, path: str) -> DataFrame:
    """Range-partitioned and sorted by term, so that a query's terms touch few row groups. A term in a third of
    the documents is split over files by document; adaptive execution sets the number of files by their size."""
    (index.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
     .write.mode("overwrite").parquet(path))
    return index.sparkSession.read.parquet(path)


def stored_texts(docs: DataFrame, ids: Sequence, key: str, text_col: str) -> DataFrame:
    """(query_id, text) of the named documents; an unknown id is an error. The list bounds what reaches the driver."""
    queries = cut_lineage(docs.where(F.col(key).isin(list(ids))).select(F.col(key).alias("query_id"), F.col(text_col).alias("text")))
    missing = set(ids) - {r["query_id"] for r in queries.select("query_id").distinct().collect()}
    if missing:
        raise KeyError(f"no document {sorted(missing)}")
    return queries


# ---- TF-IDF cosine -------------------------------------------------------------------------------------------

def tfidf_cosine(docs: DataFrame, queries: DataFrame, key: str = "id", text_col: str = "text_clean",
                 min_doc_freq: int = 0) -> DataFrame:
    """(query_id, doc_id, score) of every document sharing a weighted term with the query."""
    # Dealt by document once: its terms are counted there, its scores added up there, and its length but for rare terms.
    dealt = docs.select(F.col(key).alias("doc_id"), F.col(text_col).alias("text_clean")).repartition("doc_id")
    postings = cut_lineage_dealt(features.term_counts(features.tokenised(dealt), "doc_id"))
    n_docs = docs.agg(F.count("*")).scalar()
    idf = stored(features.document_frequency(postings).where(F.col("df") >= min_doc_freq)
                 .select("term", "df", features.smoothed_idf(n_docs, F.col("df")).alias("idf")), "idf")
    asked = stored(query_terms(queries).join(idf, "term")
                   .select("query_id", "term", "idf", (F.col("qtf") * F.col("idf")).alias("qw")), "asked")
    asked_size = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("q_size"))
    size = squared_lengths(postings, idf).select("doc_id", F.sqrt("squares").alias("size"))
    dots = (postings.join(asked, "term").groupBy("query_id", "doc_id")
            .agg(F.sum(F.col("tf") * F.col("idf") * F.col("qw")).alias("dot")))
    lengths = F.col("size") * F.col("q_size")
    return (dots.join(size, "doc_id").join(asked_size, "query_id").where(lengths > 0)
            .select("query_id", "doc_id", (F.col("dot") / lengths).alias("score")))


def squared_lengths(postings: DataFrame, idf: DataFrame) -> DataFrame:
    """(doc_id, squares) with the sum of squared weights. Postings of the ``COMMON`` most frequent terms meet their idf in
    place and leave as one sum for each document and task; only the others are shuffled by term."""
    common = stored(idf.orderBy(F.desc("df"), "term").limit(COMMON), "common").select("term", "idf")
    rare = idf.join(F.broadcast(common.select("term")), "term", "left_anti").select("term", "idf")
    left = postings.join(F.broadcast(common.select("term")), "term", "left_anti")
    square = (F.col("tf") * F.col("idf")) * (F.col("tf") * F.col("idf"))
    sums = [p.groupBy("doc_id").agg(F.sum(square).alias("squares"))
            for p in (postings.join(F.broadcast(common), "term"), left.join(rare, "term"))]
    return sums[0].union(sums[1]).groupBy("doc_id").agg(F.sum("squares").alias("squares"))


def tfidf_search(docs: DataFrame, queries: DataFrame, k: int = 20, **options) -> DataFrame:
    return ranked(tfidf_cosine(docs, queries, **options), k)


def tfidf_like(docs: DataFrame, ids: Sequence, k: int = 20, key: str = "id", text_col: str = "text_clean",
               **options) -> DataFrame:
    """Top k documents for given documents, themselves and documents without a score left out."""
    queries = stored_texts(docs, ids, key, text_col)
    return ranked(without_self(tfidf_cosine(docs, queries, key=key, text_col=text_col, **options)), k)


# ---- embeddings ----------------------------------------------------------------------------------------------

def stored_vectors(embeddings: DataFrame, ids: Sequence, key: str = "id", vector: str = "embedding") -> pd.DataFrame:
    """Query vectors of the named documents; an unknown id is an error. The list bounds what reaches the driver."""
    found = (embeddings.where(F.col(key).isin(list(ids)))
             .select(F.col(key).alias("query_id"), F.col(vector).alias("vector")).toPandas())
    missing = set(ids) - set(found["query_id"])
    if missing:
        raise KeyError(f"no embedding for {sorted(missing)}")
    return found


def nearest(embeddings: DataFrame, queries: pd.DataFrame, k: int = 20, key: str = "id", vector: str = "embedding",
            exclude_self: bool = False) -> DataFrame:
    """Exact cosine neighbours of a bounded set of query vectors (``query_id``, ``vector``).

    The query matrix goes to every task, which multiplies it with its Arrow batches and hands on its own best k
    per query, so k rows per query and task are shuffled, however large the table.
    """
    if len(queries) > QUERY_BLOCK:
        blocks = [nearest(embeddings, queries.iloc[i:i + QUERY_BLOCK], k, key, vector, exclude_self)
                  for i in range(0, len(queries), QUERY_BLOCK)]
        return reduce(DataFrame.union, blocks)
    query_ids = queries["query_id"].to_numpy()
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in queries["vector"]])
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    id_type = embeddings.schema[key].dataType.simpleString()

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = (np.empty(0, np.int64), np.empty(0, object), np.empty(0))  # query, id, score
        for batch in batches:
            for lo in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.iloc[lo:lo + ROWS_AT_ONCE]
                kept = best_of(kept, part["doc_id"].to_numpy(), np.stack([np.asarray(v, dtype=np.float64) for v in part["vector"]]))
        yield pd.DataFrame({"query_id": query_ids[kept[0]], "doc_id": kept[1], "score": kept[2]})

    def best_of(kept, ids: np.ndarray, rows: np.ndarray):
        """The best k of each query among those kept and some more rows."""
        sizes = np.linalg.norm(rows, axis=1)
        scores = (rows[sizes > 0] @ matrix.T / sizes[sizes > 0, None]).T
        ids = ids[sizes > 0]
        keys = np.round(scores, 9)
        if exclude_self:
            keys[query_ids[:, None] == ids[None, :]] = -np.inf
        keys[np.isnan(keys)] = -np.inf
        k_here = min(k, keys.shape[1])
        if k_here:
            worst = np.partition(keys, -k_here, axis=1)[:, -k_here]
            query, at = np.nonzero((keys >= worst[:, None]) & (keys > -np.inf))
            kept = tuple(np.concatenate(x) for x in zip(kept, (query, ids[at], scores[query, at])))
        _, place = np.unique(kept[1], return_inverse=True)
        order = np.lexsort((place, -np.round(kept[2], 9), kept[0]))
        query = kept[0][order]
        order = order[np.arange(len(query)) - np.searchsorted(query, query) < k]
        return tuple(x[order] for x in kept)

    local = embeddings.select(F.col(key).alias("doc_id"), F.col(vector).alias("vector")).mapInPandas(
        best, f"query_id {id_type}, doc_id {id_type}, score double")
    return ranked(local, k)


def nearest_to(embeddings: DataFrame, ids: Sequence, k: int = 20, **names) -> DataFrame:
    """Neighbours of stored documents, themselves left out."""
    return nearest(embeddings, stored_vectors(embeddings, ids, **names), k, exclude_self=True, **names)


def reranked(candidates: DataFrame, embeddings: DataFrame, query_vectors: DataFrame, k: int = 20,
             key: str = "id", vector: str = "embedding") -> DataFrame:
    """Candidates of a first stage ordered by cosine in a second space; those without a vector there drop out.
    ``query_vectors`` is (query_id, vector)."""
    stored = embeddings.select(F.col(key).alias("doc_id"), F.col(vector).alias("vector"))
    pairs = (candidates.select("query_id", "doc_id").join(stored, "doc_id")
             .join(query_vectors.withColumnRenamed("vector", "query_vector"), "query_id"))
    scored = pairs.select("query_id", "doc_id", numeric.cosine(F.col("vector"), F.col("query_vector")).alias("score"))
    return ranked(scored.where(F.col("score").isNotNull()), k)


# ---- results -------------------------------------------------------------------------------------------------

def enriched(hits: DataFrame, papers: DataFrame, key: str = "id",
             columns: Sequence[str] = ("title", "abstract", "categories")) -> DataFrame:
    """Hits with their documents' metadata; the paper scan is first reduced to the hit ids."""
    wanted = hits.select(F.col("doc_id").alias(key)).distinct()
    meta = papers.select(key, *columns).join(wanted, key, "left_semi").withColumnRenamed(key, "doc_id")
    return hits.join(meta, "doc_id", "left")


def hit_records(hits: DataFrame, papers: DataFrame, query_type: str, key: str = "id") -> DataFrame:
    """Hits as they are exported: what was asked (its type, value, title and abstract) beside rank, score and metadata."""
    asked = papers.select(F.col(key).alias("query_id"), F.col("title").alias("query_title"), F.col("abstract").alias("query_abstract"))
    asked = asked.join(hits.select("query_id").distinct(), "query_id", "left_semi")
    return (enriched(hits, papers, key).join(asked, "query_id", "left")
            .withColumns({"query_type": F.lit(query_type), "query_value": F.col("query_id").cast("string")}))


def overlap_at_k(hits: DataFrame, k: int = 20) -> DataFrame:
    """Share of common documents for every two methods that answered a query, 0 included.
    ``hits`` is (query_id, method, doc_id, rank)."""
    top = hits.where(F.col("rank") <= k).select("query_id", "method", "doc_id").distinct()
    answered = top.select("query_id", "method").distinct()
    one = answered.withColumnRenamed("method", "method_1")
    two = answered.withColumnRenamed("method", "method_2")
    pairs = one.join(two, "query_id").where(F.col("method_1") < F.col("method_2"))
    shared = (top.withColumnRenamed("method", "method_1")
              .join(top.withColumnRenamed("method", "method_2"), ["query_id", "doc_id"])
              .where(F.col("method_1") < F.col("method_2"))
              .groupBy("query_id", "method_1", "method_2").agg(F.count("*").alias("n")))
    return (pairs.join(shared, ["query_id", "method_1", "method_2"], "left")
            .select("query_id", "method_1", "method_2",
                    (F.coalesce("n", F.lit(0)) / F.lit(float(k))).alias("overlap")))


def category_diversity(hits: DataFrame, k: int = 20) -> DataFrame:
    """Distinct main and sub categories among the top k, over all categories and over primary ones only.
    ``hits`` is (query_id, method, rank, categories)."""
    listed = (hits.where(F.col("rank") <= k)
              .select("query_id", "method", F.posexplode(tx.category_list(F.col("categories"))).alias("pos", "sub"))
              .where(F.col("sub") != "").withColumn("main", tx.main_category(F.col("sub"))))
    first = F.col("pos") == 0
    return listed.groupBy("query_id", "method").agg(
        F.count_distinct("main").alias("main_all"), F.count_distinct("sub").alias("sub_all"),
        F.count_distinct(F.when(first, F.col("main"))).alias("main_primary"),
        F.count_distinct(F.when(first, F.col("sub"))).alias("sub_primary"))
