"""Non-negative matrix factorisation of a document-term matrix.

Documents stay where they are. Each round one pass solves every document's topic weights for the current topics (a small
non-negative least squares problem per row, vectorised over Arrow batches) and adds up W'W and, by blocks of terms, W'X;
the blocks are summed by Spark and each is solved for its terms' topic weights in a task. The driver sees W'W and the
residual. The topics go to every task as a broadcast of k times ``max_features`` numbers; no state per document is
kept between rounds, so nothing grows with the rounds and a lost executor only repeats its own batches.

Topics start from the singular vectors of the matrix (non-negative double SVD): a randomised subspace iteration with the
same passes gives the first k, each is split into its positive and negative part, the larger pair of parts is taken, and
zeros become the matrix's mean. It stands nearer to the result than random topics do, and is the same on every run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, IDF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import features
from corvane.plans.runtime import cut_lineage, stored

TERMS = 512  # terms in a block
OVERSAMPLING, POWERS = 10, 4  # of the subspace iteration


@dataclass
class Factorisation:
    topics: np.ndarray
    vocabulary: list[str]
    residuals: list[float]


def tfidf_rows(docs: DataFrame, key: str = "id", tokens_col: str = "tokens", max_df: float = 0.9,
               min_df: float = 0.001, max_features: int = 30_000) -> tuple[DataFrame, list[str]]:
    """(id, indices, values) rows of length 1 over the most used terms, weight tf * (idf + 1)."""
    counter = CountVectorizer(inputCol=tokens_col, outputCol="tf", vocabSize=max_features, minDF=min_df, maxDF=max_df)
    counts = features.fit_vocabulary(counter, docs)
    counted = counts.transform(docs)
    idf = IDF(inputCol="tf", outputCol="unused").fit(counted).idf.toArray() + 1.0
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="tf", outputCol="scaled").transform(counted)
    unit = Normalizer(p=2.0, inputCol="scaled", outputCol="unit").transform(scaled)
    stored = F.unwrap_udt("unit")
    rows = unit.select(F.col(key).alias("id"), stored["indices"].alias("indices"), stored["values"].alias("values"))
    return rows.where(F.size("indices") > 0), list(counts.vocabulary)


def descend(target: np.ndarray, gram: np.ndarray, start: np.ndarray | None = None, sweeps: int = 60) -> np.ndarray:
    """Rows w >= 0 minimising w gram w' - 2 w target' by cyclic coordinate descent, from ``start`` or zero; the
    objective cannot rise. Ends early when a sweep changes nothing to speak of."""
    weights = np.zeros_like(target) if start is None else start.copy()
    for _ in range(sweeps):
        moved = 0.0
        for j in range(gram.shape[0]):
            if gram[j, j] > 0:
                new = np.maximum(0.0, weights[:, j] + (target[:, j] - weights @ gram[:, j]) / gram[j, j])
                moved = max(moved, float(np.abs(new - weights[:, j]).max(initial=0.0)))
                weights[:, j] = new
        if moved <= 1e-12:
            break
    return weights


# ---- passes over the documents -------------------------------------------------------------------------------

class Cells:
    """The stored cells of some documents, sorted by document."""

    def __init__(self, frame: pd.DataFrame):
        lengths = frame["indices"].str.len().to_numpy()
        self.n = len(frame)
        self.row = np.repeat(np.arange(self.n), lengths)
        self.column = np.concatenate(frame["indices"].to_numpy())
        self.value = np.concatenate(frame["values"].to_numpy())

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """X M for M with a row for each term."""
        return np.stack([np.bincount(self.row, weights=self.value * matrix[self.column, j], minlength=self.n) for j in range(matrix.shape[1])], axis=1)

    def transposed_times(self, matrix: np.ndarray, width: int) -> np.ndarray:
        """X' M for M with a row for each document."""
        return np.stack([np.bincount(self.column, weights=self.value * matrix[self.row, j], minlength=width) for j in range(matrix.shape[1])], axis=1)


def summed(rows: DataFrame, width: int, k: int, head: int, of_batch: Callable[[Cells], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(block, cells): sums over all documents of what ``of_batch`` gives: ``head`` numbers (block -1), and k numbers for
    each term in blocks of TERMS terms. Each task adds up its own batches first."""
    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = np.zeros(head), np.zeros((width, k))
        for frame in frames:
            if not frame.empty:
                a, b = of_batch(Cells(frame))
                first += a
                second += b
        yield pd.DataFrame({"block": [-1], "cells": [first]})
        for lo in range(0, width, TERMS):
            part = second[lo:lo + TERMS]
            if part.any():
                yield pd.DataFrame({"block": [lo // TERMS], "cells": [part.ravel()]})

    parts = rows.select("indices", "values").mapInPandas(partial, "block int, cells array<double>")
    vectors = parts.select("block", array_to_vector("cells").alias("v"))
    return cut_lineage(vectors.groupBy("block").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("cells")))


def head_of(sums: DataFrame, size: int) -> np.ndarray:
    row = sums.where("block = -1").first()
    return np.zeros(size) if row is None else np.asarray(row["cells"])


def terms_of(blocks: DataFrame, width: int, k: int) -> np.ndarray:
    """The blocks as one matrix with a row for each term, to be broadcast again."""
    out = np.zeros((width, k))
    for r in blocks.where("block >= 0").collect():
        part = np.asarray(r["cells"]).reshape(-1, k)
        out[r["block"] * TERMS:r["block"] * TERMS + len(part)] = part
    return out


# ---- start ---------------------------------------------------------------------------------------------------

def singular(rows: DataFrame, width: int, k: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The first k singular values and right singular vectors (as columns), by randomised subspace iteration."""
    size = min(width, k + OVERSAMPLING)
    spark = rows.sparkSession
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0]
    for step in range(POWERS + 1):
        held = spark.sparkContext.broadcast(basis)

        def of_batch(cells: Cells, held=held) -> tuple[np.ndarray, np.ndarray]:
            image = cells.times(held.value)
            return (image.T @ image).ravel(), cells.transposed_times(image, width)

        sums = summed(rows, width, size, size * size, of_batch)
        if step < POWERS:
            basis = np.linalg.qr(terms_of(sums, width, size))[0]
    value, turn = np.linalg.eigh(head_of(sums, size * size).reshape(size, size))
    order = np.argsort(-value)[:k]
    return np.sqrt(np.maximum(value[order], 0.0)), basis @ turn[:, order]


def double_svd(rows: DataFrame, width: int, k: int, seed: int = 42) -> np.ndarray:
    """Topics to start from (k x terms): non-negative double SVD, zeros filled with the mean of the matrix."""
    values, right = singular(rows, width, k, seed)
    k_found = len(values)
    held = rows.sparkSession.sparkContext.broadcast(right)

    def of_batch(cells: Cells) -> tuple[np.ndarray, np.ndarray]:
        image = cells.times(held.value)  # left singular vectors times their values
        halves = [(np.maximum(0.0, side * image) ** 2).sum(axis=0) for side in (1.0, -1.0)]
        return np.concatenate([*halves, [cells.value.sum(), cells.n]]), np.zeros((width, 1))

    told = head_of(summed(rows, width, 1, 2 * k_found + 2, of_batch), 2 * k_found + 2)
    total, n = told[-2:]
    topics = np.zeros((k, width))
    for j in range(k_found):
        if values[j] <= 0:
            continue
        parts = [np.maximum(0.0, side * right[:, j]) for side in (1.0, -1.0)]
        left = np.sqrt(told[[j, k_found + j]]) / values[j]
        size = [left[i] * np.linalg.norm(parts[i]) for i in (0, 1)]
        side = int(size[1] > size[0])
        if size[side] > 0:
            topics[j] = np.sqrt(values[j] * size[side]) * parts[side] / np.linalg.norm(parts[side])
    mean = total / max(1.0, n * width)
    return np.where(topics > 1e-10, topics, mean)


# ---- rounds --------------------------------------------------------------------------------------------------

def one_round(rows: DataFrame, topics: np.ndarray) -> tuple[DataFrame, np.ndarray, float]:
    """W'X by blocks of terms, W'W, and the squared residual for the best W given the topics."""
    k, width = topics.shape
    gram = topics @ topics.T
    held = rows.sparkSession.sparkContext.broadcast(topics.T.copy())

    def of_batch(cells: Cells) -> tuple[np.ndarray, np.ndarray]:
        target = cells.times(held.value)
        weights = descend(target, gram)
        loss = float(cells.value @ cells.value - 2.0 * np.sum(weights * target) + np.sum((weights @ gram) * weights))
        return np.append((weights.T @ weights).ravel(), loss), cells.transposed_times(weights, width)

    sums = summed(rows, width, k, k * k + 1, of_batch)
    told = head_of(sums, k * k + 1)
    return sums, told[:-1].reshape(k, k), float(told[-1])


def improved(sums: DataFrame, own: np.ndarray, topics: np.ndarray) -> np.ndarray:
    """The best topics for the summed W'X and W'W, a block of terms in a task; scaled to length 1."""
    k, width = topics.shape
    held = sums.sparkSession.sparkContext.broadcast(topics.T.copy())

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, cells in zip(frame["block"], frame["cells"]):
                start = held.value[block * TERMS:(block + 1) * TERMS]
                yield pd.DataFrame({"block": [block], "cells": [descend(np.asarray(cells).reshape(-1, k), own, start).ravel()]})

    solved = terms_of(sums.where("block >= 0").mapInPandas(solve, "block int, cells array<double>"), width, k).T
    sizes = np.linalg.norm(solved, axis=1, keepdims=True)
    return solved / np.where(sizes > 0, sizes, 1.0)


def factorise(rows: DataFrame, vocabulary: list[str], k: int = 5, max_iter: int = 400, tolerance: float = 1e-4,
              seed: int = 42, start: np.ndarray | None = None) -> Factorisation:
    """Topics H >= 0 of X ~ W H by alternating exact steps from ``start`` (the double SVD by default); the residual never
    rises. Stops when it falls by less than ``tolerance`` of the first one."""
    rows = stored(rows.select("indices", "values"), "term-weights")
    topics = double_svd(rows, len(vocabulary), k, seed) if start is None else start
    residuals: list[float] = []
    for _ in range(max_iter):
        sums, own, loss = one_round(rows, topics)
        residuals.append(loss)
        if len(residuals) > 1 and residuals[-2] - loss < tolerance * residuals[0]:
            break
        topics = improved(sums, own, topics)
    return Factorisation(topics, vocabulary, residuals)


def topic_terms(spark, result: Factorisation) -> DataFrame:
    """(topic, term, weight), zero weights left out."""
    topic, column = np.nonzero(result.topics)
    frame = pd.DataFrame({"topic": topic.astype("int64"), "term": [result.vocabulary[c] for c in column],
                          "weight": result.topics[topic, column]})
    return spark.createDataFrame(frame, "topic long, term string, weight double")


def document_topics(rows: DataFrame, result: Factorisation) -> DataFrame:
    """(id, topic, weight): the strongest topic of each document."""
    topics, gram = result.topics, result.topics @ result.topics.T
    id_type = rows.schema["id"].dataType.simpleString()

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            weights = descend(Cells(frame).times(topics.T), gram)
            best = weights.argmax(axis=1)
            yield pd.DataFrame({"id": frame["id"].to_numpy(), "topic": best.astype("int64"),
                                "weight": weights[np.arange(len(frame)), best]})

    return rows.mapInPandas(assign, f"id {id_type}, topic long, weight double")
