"""Toxicity by a classifier chain.

One linear model per category, in the order given; each later model also reads the probabilities of all earlier ones.
In training these are out-of-fold, so a later model sees them as uncertain as they will be on new texts. Features are
the presence of words and of word beginnings (``PREFIXES`` letters); those that tell a category's rows apart best, by
chi-square over the training rows and not by chance, make the vocabulary.

Training rows are a bounded sample of the labelled ones: those whose ids hash lowest, ``max_rows`` of them. Scoring
covers every document and whole texts. The model (a vocabulary of bounded size and one weight each per category) goes
to the tasks.

Defined results: null and empty texts have no features and get the models' base rates; labelled rows with a null label
or without a document are not trained on; repeated rows count as often as they stand; without training rows, or
with one class only, a category's probability is its share in the training rows (0 if there are none).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import fresh

MAX_ROWS = 6000  # labelled rows that the models are fitted on
VOCABULARY = 2000  # features over all categories
EVIDENCE = 15.0  # the least chi-square of a feature with a category
FOLDS = 3
PREFIXES = (3, 4, 5)
ROUNDS = 100
RIDGE = 3e-6
WORDS = re.compile(r"\w+|[^\w\s]{2,}")  # words, and runs of punctuation
MEMORY = 200_000  # words whose features a task remembers


def word_features(word: str) -> list[str]:
    return [word, *("<" + word[:n] for n in PREFIXES if len(word) >= n)]


def text_features(text: str | None) -> set[str]:
    return {f for word in set(WORDS.findall((text or "").lower())) for f in word_features(word)}


# ---- linear models -------------------------------------------------------------------------------------------

def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by limited-memory quasi-Newton steps; the last weight is the intercept."""
    w = np.zeros(x.shape[1] + 1)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9))
        w[-1] = np.log(share / (1 - share))
        return w
    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ w[:-1].astype(x.dtype) + w[-1]
        error = (sigmoid(z) - y) / len(y)
        value = float((np.logaddexp(0, z) - y * z).mean() + RIDGE / 2 * w[:-1] @ w[:-1])
        return value, np.append(x.T @ error.astype(x.dtype) + RIDGE * w[:-1], error.sum())

    value, slope = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []  # the last moves and changes of slope
    for _ in range(ROUNDS):
        way, parts = -slope, []
        for move, change in reversed(steps):
            part = move @ way / (move @ change)
            parts.append(part)
            way = way - part * change
        if steps:
            move, change = steps[-1]
            way = way * (move @ change) / (change @ change)
        for (move, change), part in zip(steps, reversed(parts)):
            way = way + (part - change @ way / (move @ change)) * move
        size = 1.0 if steps else 1.0 / max(1.0, float(np.abs(slope).sum()))
        while (new := loss(w + size * way))[0] > value + 1e-4 * size * (slope @ way) and size > 1e-8:
            size /= 2
        move, change = size * way, new[1] - slope
        if size <= 1e-8 or value - new[0] < 1e-9:
            break
        w, (value, slope) = w + move, new
        if move @ change > 1e-12:
            steps = [*steps[-9:], (move, change)]
    return w


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on to say yes, so that F1 is greatest; halfway (in odds) between two rows."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    at = int(f1.argmax())
    high, low = p[order[at]], p[order[at + 1]] if at + 1 < len(y) else 0.0
    odds = np.log(np.clip([high, low], 1e-9, 1 - 1e-9) / (1 - np.clip([high, low], 1e-9, 1 - 1e-9)))
    return float(sigmoid(odds.mean()))


@dataclass
class Chain:
    """``weights[k]``: one weight per vocabulary entry, one per earlier category, the intercept. ``cuts[k]``: the
    probability from which on a text is said to be of the category, chosen on out-of-fold probabilities."""

    categories: list[str]
    vocabulary: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)
    cuts: list[float] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Chain:
        earlier = np.empty((len(x), 0), x.dtype)
        for k in range(len(self.categories)):
            inputs, out = np.hstack([x, earlier]), np.zeros(len(x), x.dtype)
            for f in range(FOLDS):
                rest, mine = fold != f, fold == f
                w = fit_linear(inputs[rest], y[rest, k])
                out[mine] = sigmoid(inputs[mine] @ w[:-1] + w[-1])
            self.weights.append(fit_linear(inputs, y[:, k]))
            self.cuts.append(best_cut(out, y[:, k]))
            earlier = np.hstack([earlier, out[:, None]])
        return self

    def scorer(self) -> TextScorer:
        return TextScorer(self)


class TextScorer:
    """Scores texts in a task, remembering the features of words it has met."""

    def __init__(self, chain: Chain):
        self.chain, self.size = chain, len(chain.vocabulary)
        self.table = np.stack([w[:self.size] for w in chain.weights]) if chain.weights else np.zeros((0, 0))
        self.known: dict[str, tuple[int, ...]] = {}

    def ids(self, text: str | None) -> set[int]:
        known, vocabulary, found = self.known, self.chain.vocabulary, set()
        for word in set(WORDS.findall((text or "").lower())):
            at = known.get(word)
            if at is None:
                if len(known) >= MEMORY:
                    known.clear()
                at = known[word] = tuple(vocabulary[f] for f in word_features(word) if f in vocabulary)
            if at:
                found.update(at)
        return found

    def __call__(self, text: str | None) -> list[float]:
        base = self.table[:, sorted(self.ids(text))].sum(axis=1)
        probabilities: list[float] = []
        for k, w in enumerate(self.chain.weights):
            z = base[k] + w[-1] + sum(p * q for p, q in zip(probabilities, w[self.size:-1]))
            probabilities.append(float(sigmoid(np.float64(z))))
        return probabilities


# ---- training ------------------------------------------------------------------------------------------------

def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str, text_col: str,
                  max_rows: int) -> DataFrame:
    """(row, text, y): the labelled rows whose ids hash lowest, at most ``max_rows``."""
    y = F.array(*[c.cast("int") for c in categories.values()])
    chosen = (labels.select(F.col(id_col).alias("row"), y.alias("y"))
              .where(F.col("row").isNotNull() & ~F.exists("y", F.isnull))
              .orderBy(F.xxhash64("row"), "row", "y").limit(max_rows))
    texts = docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "row").orderBy(F.xxhash64("row"), "row", F.xxhash64("text")).limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id",
        text_col: str = "text", max_rows: int = MAX_ROWS, vocabulary: int = VOCABULARY) -> Chain:
    """A chain over ``categories`` (name -> condition on ``labels``, in chain order)."""
    names = list(categories)
    features = F.udf(lambda text: sorted(text_features(text)), "array<string>")
    rows = (training_rows(docs, labels, categories, id_col, text_col, max_rows)
            .select("row", "y", features("text").alias("features")).persist())
    total = rows.agg(F.count("*"), *[F.sum(F.col("y")[k]) for k in range(len(names))]).first()
    n, positives = total[0], [t or 0 for t in total[1:]]
    chain = Chain(names)
    if not n:
        chain.weights = [fit_linear(np.zeros((0, k)), np.zeros(0)) for k in range(len(names))]
        chain.cuts = [0.5] * len(names)
        return chain
    counts = (rows.select("y", F.explode("features").alias("feature")).groupBy("feature")
              .agg(F.count("*").alias("n"), *[F.sum(F.col("y")[k]).alias(f"n{k}") for k in range(len(names))])
              .where("n > 2").persist())
    each = max(1, vocabulary // len(names))
    best: set[str] = set()
    for k, p in enumerate(positives):  # chi-square of presence against category
        contrast = F.col(f"n{k}") / max(1, p) - (F.col("n") - F.col(f"n{k}")) / max(1, n - p)
        chi = contrast * contrast * p * (n - p) * n / (F.col("n") * (n + 1 - F.col("n")))
        best |= {r.feature for r in counts.where(chi >= EVIDENCE).orderBy(chi.desc(), "feature").limit(each).collect()}
    chain.vocabulary = {f: i for i, f in enumerate(sorted(best))}
    index = chain.vocabulary
    present = F.udf(lambda found: [index[f] for f in found if f in index], "array<int>")
    data = rows.select("row", "y", present("features").alias("at")).collect()
    rows.unpersist(), counts.unpersist()
    data.sort(key=lambda r: (r.row, r.at))
    x = np.zeros((n, len(index)), np.float32)
    for i, r in enumerate(data):
        x[i, r.at] = 1
    y = np.array([r.y for r in data], np.float64)
    return chain.fit(x, y, np.arange(n) % FOLDS)


# ---- scoring -------------------------------------------------------------------------------------------------

def probabilities(chain: Chain, text: Column) -> Column:
    """array<double>: the probability of each category, in chain order."""

    @F.pandas_udf("array<double>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = chain.scorer()
        for series in texts:
            yield pd.Series([score(t) for t in series])

    return of(text)


def score(docs: DataFrame, chain: Chain, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the probabilities in column ``out``."""
    return docs.withColumn(out, probabilities(chain, F.col(text_col)))


def reject(docs: DataFrame, chain: Chain, category: str, threshold: float | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose probability of ``category`` is ``threshold`` (the chain's cut) or more."""
    out, k = fresh(docs, "toxicity"), chain.categories.index(category)
    kept = score(docs, chain, text_col, out).where(F.col(out)[k] < (chain.cuts[k] if threshold is None else threshold))
    return kept.select(*docs.columns)


# The categories of the given labels, in chain order: text of low quality is told apart first.
def given_categories() -> dict[str, Column]:
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
