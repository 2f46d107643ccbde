"""Topics: LDA, embedding clusters, topic words, diversity, coherence. Topics are ``(topic, term, weight)`` rows."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from math import lgamma
from threading import Lock

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.errors import IllegalArgumentException, PySparkException
from pyspark.ml import Pipeline
from pyspark.ml.clustering import LDA, KMeans, LDAModel
from pyspark.ml.feature import PCA, CountVectorizer, PCAModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corvane.functions import numeric
from corvane.functions import text as tx
from corvane.operators import density, features, neighbours, nmf
from corvane.operators.records import in_periods
from corvane.plans.ranking import top_k_per_group
from corvane.plans.runtime import cut_lineage, new_path, stored
from corvane.plans.skew import hot_key_join
from corvane.sources.scan import hash_sample

# Sliding-window widths of the two window-based coherences, and the smoothing of their logarithms.
NPMI_WINDOW = 10
CV_WINDOW = 110
EPSILON = 1e-12
MAX_CENTROIDS = 20_000
CELLS = 8_000_000  # of the matrix of segments and words that a task works on at once
JOBS = 8  # fits that go on at the same time
DECOMPOSING = Lock()  # the driver's singular value decomposition fails at times when two fits are in it

log = logging.getLogger(__name__)


# ---- topic words ---------------------------------------------------------------------------------------------

def top_terms(weights: DataFrame, k: int = 10) -> DataFrame:
    """(topic, rank, term, weight) of the k heaviest terms, ties to the smaller term."""
    order = [F.desc(F.round("weight", 9)), F.col("term")]
    return top_k_per_group(weights.select("topic", "term", "weight"), ["topic"], order, k)


def topic_similarity(weights: DataFrame) -> DataFrame:
    """Cosine of every two different topics over all their terms, 0 where they share none."""
    sizes = weights.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("size"))
    left = weights.select(F.col("topic").alias("topic_1"), "term", F.col("weight").alias("w1"))
    right = weights.select(F.col("topic").alias("topic_2"), "term", F.col("weight").alias("w2"))
    dots = (left.join(right, "term").where(F.col("topic_1") < F.col("topic_2"))
            .groupBy("topic_1", "topic_2").agg(F.sum(F.col("w1") * F.col("w2")).alias("dot")))
    listed = sizes.agg(F.collect_list(F.struct("topic", "size"))).scalar()  # one entry per topic
    pairs = (sizes.select(F.col("topic").alias("topic_1"), F.col("size").alias("s1"), F.explode(listed).alias("t"))
             .select("topic_1", "s1", F.col("t.topic").alias("topic_2"), F.col("t.size").alias("s2"))
             .where(F.col("topic_1") < F.col("topic_2")))
    return (pairs.join(dots, ["topic_1", "topic_2"], "left")
            .select("topic_1", "topic_2", numeric.ratio(F.coalesce("dot", F.lit(0.0)),
                                                        F.col("s1") * F.col("s2")).alias("cosine")))


def diversity(words: DataFrame, fixed_top: int | None = None) -> DataFrame:
    """Distinct words over all top words, or over topics x ``fixed_top``."""
    slots = F.count("*") if fixed_top is None else F.count_distinct("topic") * fixed_top
    return words.agg((F.count_distinct("term") / slots).alias("diversity"))


def class_tfidf(docs: DataFrame, topic: str = "topic", tokens_col: str = "tokens", noise: int = -1) -> DataFrame:
    """Class-based TF-IDF: tf of a term in a topic times ln(1 + A / f), f its total count and A the mean number
    of words per topic. Noise counts towards f and A as a topic of its own but gets no words."""
    counts = cut_lineage(tx.exploded(docs.withColumn("topic", F.col(topic)), tokens_col, "term", "topic")
                         .groupBy("topic", "term").agg(F.count("*").alias("tf")))
    totals = counts.groupBy("term").agg(F.sum("tf").alias("f"), F.count("*").alias("topics"))
    mean_words = counts.agg(F.sum("tf") / F.count_distinct("topic")).scalar()
    return (hot_key_join(counts.where(F.col("topic") != noise), totals, "term", "topics", counts.agg(F.count("*")).scalar())
            .select("topic", "term", (F.col("tf") * F.log(1.0 + mean_words / F.col("f"))).alias("weight")))


# ---- coherence -----------------------------------------------------------------------------------------------

class WindowCounts:
    """In how many windows of a width each wanted word, and each pair of a topic's words, occurs: sums over batches.

    The windows of all documents lie on one line. A word's places become stretches of windows that hold it; between the
    ends of stretches nothing changes, so counting is over segments, by a small matrix product for each topic."""

    def __init__(self, width: int | None, topics: list[np.ndarray], n_words: int):
        self.width, self.topics = width, topics
        self.total = 0
        self.own = np.zeros(n_words, np.int64)
        self.joint = [np.zeros((len(t), len(t)), np.int64) for t in topics]

    def add(self, length: np.ndarray, doc: np.ndarray, place: np.ndarray, word: np.ndarray) -> None:
        """Documents of ``length``, and the wanted words in them: document, place, word."""
        last = np.zeros(len(length), np.int64) if self.width is None else np.maximum(0, length - self.width)
        windows = np.where(length > 0, last + 1, 0)
        start = np.cumsum(windows) - windows
        self.total += int(windows.sum())
        if not len(doc):
            return
        low = np.zeros(len(doc), np.int64) if self.width is None else np.maximum(0, place - self.width + 1)
        high = np.zeros(len(doc), np.int64) if self.width is None else np.minimum(place, last[doc])
        low, high = low + start[doc], high + start[doc] + 1
        ends = np.unique(np.concatenate([low, high]))
        held = np.zeros((len(ends), len(self.own)), np.int32)
        np.add.at(held, (np.searchsorted(ends, low), word), 1)
        np.add.at(held, (np.searchsorted(ends, high), word), -1)
        held = (np.cumsum(held, axis=0)[:-1] > 0).astype(np.float64)
        size = np.diff(ends).astype(np.float64)
        self.own += np.rint(size @ held).astype(np.int64)
        for t, codes in enumerate(self.topics):
            mine = held[:, codes]
            self.joint[t] += np.rint((mine * size[:, None]).T @ mine).astype(np.int64)


def window_counts(words: DataFrame, docs: DataFrame, windows: Sequence[int | None], tokens_col: str = "tokens") -> DataFrame:
    """(width, topic, word_1, word_2, n): in how many windows of each width (null: whole documents) the words of a topic
    occur together, in order of rank, a word with itself included; the row without a topic has the number of windows.
    All widths come from one pass over the texts. The wanted words, a few for each topic, are with every task."""
    listed = words.select("topic", "rank", "term").toPandas().sort_values(["topic", "rank"])
    names = sorted(set(listed["term"]))
    code = {w: i for i, w in enumerate(names)}
    topics = [(int(t), part["term"].tolist()) for t, part in listed.groupby("topic")]
    codes = [np.array([code[w] for w in terms]) for _, terms in topics]
    wanted = pa.array(names, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [WindowCounts(w, codes, len(names)) for w in windows]
        for batch in batches:
            tokens = batch.column(0)
            length = np.diff(tokens.offsets.to_numpy())
            at = pc.index_in(tokens.flatten(), value_set=wanted)
            hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            offsets = np.append(0, np.cumsum(length))
            doc = np.searchsorted(offsets, hit, side="right") - 1
            word = at.take(pa.array(hit)).to_numpy()
            most = max(1, CELLS // max(1, len(names)))
            lo = 0
            while lo < len(length):  # so many documents that their matrix stays small
                first = np.searchsorted(doc, lo)
                hi = len(length) if first + most >= len(doc) else max(lo + 1, int(doc[first + most]))
                part = slice(first, np.searchsorted(doc, hi))
                for c in counts:
                    c.add(length[lo:hi], doc[part] - lo, hit[part] - offsets[doc[part]], word[part])
                lo = hi
        rows = []
        for width, c in zip(windows, counts):
            rows.append((width, None, None, None, c.total))
            for (topic, terms), joint in zip(topics, c.joint):
                rows += [(width, topic, terms[i], terms[j], int(joint[i, j])) for i in range(len(terms)) for j in range(i, len(terms)) if joint[i, j]]
        cols = list(zip(*rows))
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], ["width", "topic", "word_1", "word_2", "n"])

    parts = docs.select(tokens_col).where(F.col(tokens_col).isNotNull()).mapInArrow(run, "width int, topic long, word_1 string, word_2 string, n long")
    return cut_lineage(parts.groupBy("width", "topic", "word_1", "word_2").agg(F.sum("n").alias("n")))


def word_pairs(words: DataFrame) -> DataFrame:
    """(topic, rank_1, rank_2, word_1, word_2) with rank_1 < rank_2 inside each topic's word list."""
    one = words.select("topic", F.col("rank").alias("rank_1"), F.col("term").alias("word_1"))
    two = words.select("topic", F.col("rank").alias("rank_2"), F.col("term").alias("word_2"))
    return one.join(two, "topic").where(F.col("rank_1") < F.col("rank_2"))


def counted_pairs(words: DataFrame, counts: DataFrame, window: int | None) -> tuple[DataFrame, Column]:
    """Pairs with the counts n_1, n_2 and n_12 of ``window_counts``, and the number of windows."""
    counts = counts.where(F.col("width").eqNullSafe(F.lit(window).cast("int"))).drop("width")
    own = counts.where(F.col("word_1") == F.col("word_2"))
    first = own.select("topic", "word_1", F.col("n").alias("n_1"))
    second = own.select("topic", "word_2", F.col("n").alias("n_2"))
    both = counts.where(F.col("word_1") != F.col("word_2")).withColumnRenamed("n", "n_12")
    pairs = (word_pairs(words).join(first, ["topic", "word_1"], "left").join(second, ["topic", "word_2"], "left")
             .join(both, ["topic", "word_1", "word_2"], "left").fillna(0, ["n_1", "n_2", "n_12"]))
    return pairs, counts.where(F.col("topic").isNull()).agg(F.sum("n")).scalar()


def npmi(n_1: Column, n_2: Column, n_12: Column, total: Column) -> Column:
    """Normalised pointwise mutual information; 0 where a word never occurs."""
    together = n_12 / total + F.lit(EPSILON)
    value = F.log(together * total * total / (n_1 * n_2)) / -F.log(together)
    return F.when((n_1 > 0) & (n_2 > 0), value).otherwise(F.lit(0.0))


def u_mass(words: DataFrame, docs: DataFrame, tokens_col: str = "tokens", counts: DataFrame | None = None) -> DataFrame:
    """(topic, coherence): mean of ln((D(earlier, later) + 1) / D(earlier)) over the pairs of a topic's words, the
    earlier word being the heavier one. This and the others count for themselves unless given ``counts``."""
    words = cut_lineage(words)
    pairs, _ = counted_pairs(words, counts or window_counts(words, docs, [None], tokens_col), None)
    score = F.log((F.col("n_12") + 1.0) / F.col("n_1"))
    return pairs.where(F.col("n_1") > 0).groupBy("topic").agg(F.avg(score).alias("coherence"))


def c_npmi(words: DataFrame, docs: DataFrame, window: int = NPMI_WINDOW, tokens_col: str = "tokens", counts: DataFrame | None = None) -> DataFrame:
    words = cut_lineage(words)
    pairs, total = counted_pairs(words, counts or window_counts(words, docs, [window], tokens_col), window)
    score = npmi(F.col("n_1"), F.col("n_2"), F.col("n_12"), total)
    return pairs.groupBy("topic").agg(F.avg(score).alias("coherence"))


def c_v(words: DataFrame, docs: DataFrame, window: int = CV_WINDOW, tokens_col: str = "tokens", counts: DataFrame | None = None) -> DataFrame:
    """Mean cosine between each word's vector of NPMI with all the topic's words and the sum of those vectors
    (Roeder et al. 2015)."""
    words = cut_lineage(words)
    pairs, total = counted_pairs(words, counts or window_counts(words, docs, [window], tokens_col), window)
    value = npmi(F.col("n_1"), F.col("n_2"), F.col("n_12"), total)
    half = pairs.select("topic", "word_1", "word_2", value.alias("m"), "n_1", "n_2")
    own = npmi(F.col("n"), F.col("n"), F.col("n"), total)
    single = (half.select("topic", F.col("word_1").alias("w"), F.col("n_1").alias("n"))
              .union(half.select("topic", "word_2", "n_2")).distinct())
    cells = (half.select("topic", F.col("word_1").alias("w"), F.col("word_2").alias("v"), "m")
             .union(half.select("topic", "word_2", "word_1", "m"))
             .union(single.select("topic", "w", F.col("w").alias("v"), own)))
    sums = cells.groupBy("topic", "v").agg(F.sum("m").alias("s"))
    joined = cells.join(sums, ["topic", "v"])
    per_word = joined.groupBy("topic", "w").agg(
        F.sum(F.col("m") * F.col("s")).alias("dot"), F.sum(F.col("m") * F.col("m")).alias("m2"),
        F.sum(F.col("s") * F.col("s")).alias("s2"))
    size = F.sqrt(F.col("m2") * F.col("s2"))
    return per_word.groupBy("topic").agg(F.avg(numeric.ratio(F.col("dot"), size)).alias("coherence"))


def with_quality(row: DataFrame, words: DataFrame, docs: DataFrame, **parameters) -> DataFrame:
    """A one-row record with the quality of its topics and the parameters of the fit."""
    found = cut_lineage(quality(cut_lineage(words), docs))
    out = row
    for name in found.columns:
        out = out.withColumn(name, found.select(name).scalar())
    return out.withColumns({name: F.lit(value) for name, value in parameters.items()})


def quality(words: DataFrame, docs: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """One row: mean c_v, c_npmi and u_mass over the topics, all from one pass over the texts, and diversity with a fixed
    denominator."""
    words = cut_lineage(words)
    top = words.agg(F.max("rank")).first()[0] or 1
    counts = window_counts(words, docs, [CV_WINDOW, NPMI_WINDOW, None], tokens_col)
    row = diversity(words, int(top))
    for name, measure in (("c_v", c_v), ("c_npmi", c_npmi), ("u_mass", u_mass)):
        row = row.withColumn(name, measure(words, docs, tokens_col=tokens_col, counts=counts).agg(F.avg("coherence")).scalar())
    return row


# ---- LDA -----------------------------------------------------------------------------------------------------

def lda_stages(k: int, vocab_size: int, min_df: float, max_df: float, max_iter: int, seed: int) -> Pipeline:
    return Pipeline(stages=[
        CountVectorizer(inputCol="tokens", outputCol="counts", vocabSize=vocab_size, minDF=min_df, maxDF=max_df),
        LDA(k=k, maxIter=max_iter, optimizer="online", seed=seed, featuresCol="counts"),
    ])


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 10, and the asymptotic series beyond."""
    x = np.array(x, np.float64)
    shift = np.zeros_like(x)
    while (low := x < 10.0).any():
        shift[low] += 1.0 / x[low]
        x[low] += 1.0
    f = 1.0 / (x * x)
    return np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132)))) - shift


def log_gamma(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(lgamma, np.ravel(x)), np.float64, np.size(x))


def lda_bound(model: LDAModel, counted: DataFrame) -> tuple[float, float]:
    """(bound, words): the lower bound of the log likelihood of the corpus as Spark's ``logLikelihood`` defines it, and the
    number of words counted. Spark's own call takes the exponential of all topics anew for every document, and its
    ``logPerplexity`` does so again. Here ``transform`` infers each document's topics once (their parameters add up to those
    of the prior and the document's words), and the bound is summed over batches with the topics at every task."""
    alpha = np.asarray(model.estimatedDocConcentration().toArray())
    topics = np.asarray(model.topicsMatrix().toArray())
    size, k = topics.shape
    if not size:  # no vocabulary: the library's own error
        return model.logLikelihood(counted), float("nan")
    eta = 1.0 / k  # the estimator's default
    expected = digamma(topics) - digamma(topics.sum(axis=0))
    own = (float(((eta - topics) * expected).sum()) + float(log_gamma(topics).sum()) - size * k * lgamma(eta)
           + k * lgamma(eta * size) - float(log_gamma(topics.sum(axis=0)).sum()))
    held = counted.sparkSession.sparkContext.broadcast(expected)
    prior = lgamma(float(alpha.sum())) - float(log_gamma(alpha).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = words = 0.0
        for batch in batches:
            indices, values, shares = (batch.column(name) for name in ("indices", "values", "shares"))
            lengths = pc.list_value_length(indices).to_numpy(zero_copy_only=False)
            if not len(lengths):
                continue
            column, count = indices.flatten().to_numpy(), values.flatten().to_numpy()
            row = np.repeat(np.arange(len(lengths)), lengths)
            total = np.bincount(row, weights=count, minlength=len(lengths))
            gamma = shares.flatten().to_numpy().reshape(-1, k) * (total + alpha.sum())[:, None]
            theta = digamma(gamma) - digamma(gamma.sum(axis=1))[:, None]
            bound += float(((alpha - gamma) * theta).sum() + log_gamma(gamma).sum() - log_gamma(gamma.sum(axis=1)).sum()) + len(gamma) * prior
            words += float(total.sum())
            for at in range(0, len(row), CELLS // k):
                part = slice(at, at + CELLS // k)
                cells = theta[row[part]] + held.value[column[part]]
                most = cells.max(axis=1)
                bound += float(count[part] @ (most + np.log(np.exp(cells - most[:, None]).sum(axis=1))))
        yield pa.RecordBatch.from_pydict({"bound": [bound], "words": [words]})

    stored = F.unwrap_udt("counts")
    rows = (model.transform(counted).select(stored["indices"].alias("indices"), stored["values"].alias("values"),
                                            vector_to_array(model.getTopicDistributionCol()).alias("shares"))
            .where(F.size("indices") > 0))
    sums = rows.mapInArrow(run, "bound double, words double").agg(F.sum("bound"), F.sum("words")).first()
    return own + (sums[0] or 0.0), sums[1] or 0.0


def lda(docs: DataFrame, k: int = 5, max_iter: int = 20, vocab_size: int = 50_000, min_df: float = 5000.0,
        max_df: float = 2 ** 63 - 1.0, min_tokens: int = 5, top: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Topic words and one row of metrics over documents with more than ``min_tokens`` tokens."""
    usable = cut_lineage(docs.where(F.size("tokens") > min_tokens).select("tokens"))
    counter, estimator = lda_stages(k, vocab_size, min_df, max_df, max_iter, seed).getStages()
    vectoriser = features.fit_vocabulary(counter, usable)
    counted = vectoriser.transform(usable)
    model = estimator.fit(counted)
    spark, vocabulary = docs.sparkSession, vectoriser.vocabulary
    described = model.describeTopics(top)
    names = spark.createDataFrame([(i, w) for i, w in enumerate(vocabulary)], "code int, term string")
    words = (described.select(F.col("topic").cast("bigint").alias("topic"),
                              F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("pos", "t"))
             .select("topic", (F.col("pos") + 1).cast("bigint").alias("rank"), F.col("t.termIndices").alias("code"),
                     F.col("t.termWeights").alias("weight"))
             .join(names, "code").select("topic", "rank", "term", "weight"))
    bound, counted_words = lda_bound(model, counted)
    metrics = spark.createDataFrame(
        [(usable.count(), k, len(vocabulary), bound, -bound / counted_words)],
        "docs long, topics int, vocabulary int, log_likelihood double, log_perplexity double")
    return words, metrics


def concurrently(tasks: Sequence[Callable[[], object]], most: int = JOBS) -> list:
    """The results of ``tasks`` in order, up to ``most`` at a time, each thread's jobs in a scheduler pool of its own (fair
    where the session schedules fairly). Fits of small groups are mostly waiting for small jobs; the first error raises,
    and what has not begun by then does not."""
    if not tasks:
        return []
    spark = SparkSession.active()

    def pooled(number: int, task: Callable[[], object]) -> Callable[[], object]:
        @inheritable_thread_target(spark)
        def run():
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fits-{number}")
            return task()
        return run

    with ThreadPoolExecutor(min(most, len(tasks))) as threads:
        running = [threads.submit(pooled(number, task)) for number, task in enumerate(tasks)]
        try:
            return [r.result() for r in running]
        finally:
            for r in running:
                r.cancel()


def per_group(docs: DataFrame, group: str, min_docs: int,
              fit: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """``fit`` for every group with enough documents; words and metrics carry the group's name. The documents are
    written once, a folder for each group, and every fit reads its own and runs over the cluster, several fits at a time.
    A group that cannot be fitted, such as one without a vocabulary, keeps its row, with the error as ``status``; failed
    Spark jobs raise. The names of the groups are what reaches the driver."""
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "groups")
    large = docs.groupBy(group).agg(F.count("*").alias("n")).where((F.col("n") >= min_docs) & F.col(group).isNotNull())
    named = F.broadcast(large.select(group))  # a shuffle would bring each group to one task
    docs.join(named, group, "left_semi").withColumn("__group", F.col(group)).write.partitionBy("__group").parquet(path)
    schema = StructType([*docs.schema.fields, StructField("__group", docs.schema[group].dataType)])
    parts = spark.read.option("basePath", path).schema(schema).parquet(path)
    names = [r[0] for r in large.orderBy(F.desc("n"), group).collect()]

    def one(name) -> tuple[DataFrame | None, DataFrame]:
        named = F.lit(name).alias("group")
        try:
            found, row = fit(parts.where(F.col("__group") == name).drop("__group"))
        except (IllegalArgumentException, ValueError, RuntimeError) as error:  # such as an empty vocabulary
            if isinstance(error, PySparkException) and not isinstance(error, IllegalArgumentException):
                raise
            log.exception("no topics for %s", name)
            return None, spark.range(1).select(named, F.lit(type(error).__name__).alias("status"))
        return found.select(named, "*"), row.select(named, F.lit("ok").alias("status"), "*")

    done = concurrently([partial(one, name) for name in names])
    words = [w for w, _ in done if w is not None]
    if not words:
        raise ValueError("no group could be fitted")
    return union_all(words), union_all(sorted((m for _, m in done), key=lambda m: -len(m.columns)))


def with_status(words: DataFrame, metrics: DataFrame) -> DataFrame:
    """Topic words with their group's status, and a row without words for every group that has no topics."""
    failed = metrics.where(F.col("status") != "ok").select("group", "status")
    return words.withColumn("status", F.lit("ok")).unionByName(failed, allowMissingColumns=True)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def lda_per_category(docs: DataFrame, group: str = "main_category", min_docs: int = 5, k: int = 5,
                     vocab_size: int = 30_000, min_df: float = 0.001, max_df: float = 0.9,
                     max_iter: int = 20) -> tuple[DataFrame, DataFrame]:
    def fit(part: DataFrame) -> tuple[DataFrame, DataFrame]:
        words, row = lda(part, k, max_iter, vocab_size, min_df, max_df)
        return words, with_quality(row, words, part, vocab_size=vocab_size, min_df=float(min_df), max_df=float(max_df), max_iter=max_iter)

    return per_group(docs, group, min_docs, fit)


def lda_per_period(docs: DataFrame, periods: Sequence[tuple[int, int]], min_docs: int = 5000, k: int = 5,
                   vocab_size: int = 50_000, min_df: float = 20.0, max_df: float = 0.9,
                   max_iter: int = 20) -> tuple[DataFrame, DataFrame]:
    """``docs`` has year and tokens; windows may overlap."""
    sliced = in_periods(docs, periods, min_docs)

    def fit(part: DataFrame) -> tuple[DataFrame, DataFrame]:
        words, row = lda(part, k, max_iter, vocab_size, min_df, max_df)
        return words, with_quality(row, words, part, vocab_size=vocab_size, min_df=float(min_df), max_df=float(max_df), max_iter=max_iter)

    return per_group(sliced, "period", 1, fit)


def nmf_topics(docs: DataFrame, key: str = "id", k: int = 5, max_iter: int = 400, max_df: float = 0.9,
               min_df: float = 0.001, max_features: int = 30_000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Topic weights and one row with the number of rounds and the first and last residual."""
    tokens = stored(docs.select(key, "tokens"), "tokens")
    rows, vocabulary = nmf.tfidf_rows(tokens, key, "tokens", max_df, min_df, max_features)
    result = nmf.factorise(rows, vocabulary, k, max_iter, seed=seed)
    spark = docs.sparkSession
    row = spark.createDataFrame([(k, len(vocabulary), len(result.residuals), result.residuals[0], result.residuals[-1])],
                                "topics int, vocabulary int, rounds int, first_residual double, last_residual double")
    return nmf.topic_terms(spark, result), row


def nmf_per_group(docs: DataFrame, group: str, min_docs: int, key: str = "id", **options) -> tuple[DataFrame, DataFrame]:
    def fit(part: DataFrame) -> tuple[DataFrame, DataFrame]:
        weights, row = nmf_topics(part, key, **options)
        words = cut_lineage(top_terms(weights, 10))
        return words, with_quality(row, words, part)

    return per_group(docs, group, min_docs, fit)


def category_texts(papers: DataFrame, main: str) -> DataFrame:
    """Texts of the papers that have a category in the main category ``main``."""
    mains = F.transform(tx.category_list(F.col("categories")), tx.main_category)
    return (papers.where(F.array_contains(mains, main)).na.drop(subset=["title", "abstract"])
            .select("id", tx.joined_text("title", "abstract").alias("text")))


# ---- embedding clusters --------------------------------------------------------------------------------------

def centroids(rows: DataFrame, topic: str = "topic", vector: str = "embedding", noise: int = -1) -> DataFrame:
    """(topic, centroid): mean embedding per topic, noise excluded; summed map-side."""
    vectors = features.array_as_vector(rows.where(F.col(topic) != noise), vector, "__v")
    return vectors.groupBy(F.col(topic).cast("bigint").alias("topic")).agg(
        vector_to_array(Summarizer.mean(F.col("__v"))).alias("centroid"))


def assign_nearest(rows: DataFrame, centers: DataFrame, threshold: float = 0.3, key: str = "id",
                   vector: str = "embedding") -> DataFrame:
    """(id, topic, similarity): the most similar centroid by cosine, topic -1 unless above ``threshold``; ties to
    the smaller topic. The centroids, a checked number of them, travel with the tasks."""
    table = centers.limit(MAX_CENTROIDS + 1).toPandas().sort_values("topic")
    if len(table) > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids")
    topics = table["topic"].to_numpy()
    matrix = np.stack([np.asarray(c, dtype=np.float64) for c in table["centroid"]])
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    id_type = rows.schema[key].dataType.simpleString()

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            vectors = np.stack([np.asarray(v, dtype=np.float64) for v in frame["vector"]])
            sizes = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
            scores = np.round((vectors / sizes) @ matrix.T, 9)
            best = scores.argmax(axis=1)
            top = scores[np.arange(len(frame)), best]
            yield pd.DataFrame({"id": frame["id"].to_numpy(), "topic": np.where(top > threshold, topics[best], -1),
                                "similarity": top})

    return rows.select(F.col(key).alias("id"), F.col(vector).alias("vector")).mapInPandas(
        assign, f"id {id_type}, topic long, similarity double")


def fitted_pca(vectors: DataFrame, dims: int) -> PCAModel:
    with DECOMPOSING:
        return PCA(k=dims, inputCol="full", outputCol="reduced").fit(vectors)


def embedding_clusters(rows: DataFrame, k: int = 10, dims: int = 5, threshold: float = 0.3, min_size: int = 150,
                       key: str = "id", vector: str = "embedding", seed: int = 42) -> DataFrame:
    """(id, topic): k-means on the first principal components. Documents not above ``threshold`` cosine to their
    cluster's mean embedding, and clusters left with fewer than ``min_size`` documents, are noise (-1)."""
    given = rows.select(F.col(key).alias("id"), F.col(vector).alias("embedding"))
    return cluster_assignment(given, k, dims, threshold, min_size, seed)(given).select("id", "topic")


def cluster_assignment(rows: DataFrame, k: int = 10, dims: int = 5, threshold: float = 0.3, min_size: int = 150,
                       seed: int = 42) -> Callable[[DataFrame], DataFrame]:
    """The clusters of ``rows`` as a function that gives rows with an embedding their topic where they lie: what it needs are
    the models and figures of k clusters, so neither vectors nor topics are stored."""
    vectors = features.array_as_vector(rows, "embedding", "full")
    components = fitted_pca(vectors, dims)
    means = KMeans(k=k, featuresCol="reduced", predictionCol="topic", seed=seed).fit(components.transform(vectors))

    def nearest(df: DataFrame) -> DataFrame:
        return means.transform(components.transform(features.array_as_vector(df, "embedding", "full"))).select(*df.columns, "topic")

    centers = cut_lineage(centroids(nearest(rows)))

    def near(df: DataFrame) -> DataFrame:
        close = F.when(numeric.cosine(F.col("embedding"), F.col("centroid")) > threshold, F.col("topic")).otherwise(-1)
        return nearest(df).join(F.broadcast(centers), "topic").select(*df.columns, close.cast("bigint").alias("topic"))

    large = near(rows).groupBy("topic").agg(F.count("*").alias("n")).where((F.col("n") >= min_size) & (F.col("topic") >= 0))
    large = cut_lineage(large.select("topic", F.lit(True).alias("large")))

    def assigned(df: DataFrame) -> DataFrame:
        topic = F.when(F.col("large"), F.col("topic")).otherwise(F.lit(-1).cast("bigint"))
        return near(df).join(F.broadcast(large), "topic", "left").select(*df.columns, topic.alias("topic"))

    return assigned


def density_topics(rows: DataFrame, dims: int = 5, samples: int = 30, least: int = 150, recall: float = 0.95, key: str = "id",
                   vector: str = "embedding", seed: int = 42) -> DataFrame:
    """(id, topic): stable density clusters on the first principal components, noise -1. Every document's neighbours come
    from an index of vectors, probed as far as the wanted share of true neighbours takes by its own measure."""
    vectors = features.array_as_vector(rows.select(F.col(key).alias("id"), F.col(vector).alias("embedding")), "embedding", "full")
    model = fitted_pca(vectors, dims)
    reduced = cut_lineage(model.transform(vectors).select("id", vector_to_array("reduced").cast("array<float>").alias("embedding")))
    index = neighbours.build(reduced, new_path(rows.sparkSession, "density"), seed=seed, k=samples)
    queries = reduced.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = neighbours.search(index, queries, samples, index.probes(recall), exclude_self=True).hits
    return density.density_clusters(cut_lineage(hits), reduced, samples, least).select("id", F.col("cluster").cast("bigint").alias("topic"))


def topic_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("topic").agg(F.count("*").alias("n"))


def topic_overview(assigned: DataFrame) -> DataFrame:
    """Number of topics without noise, and the share of noise."""
    sizes = topic_sizes(assigned)
    noise = F.sum(F.when(F.col("topic") == -1, F.col("n")).otherwise(0))
    return sizes.agg(F.count_if(F.col("topic") != -1).alias("n_topics"),
                     (noise / F.sum("n")).alias("noise_fraction"))


def representatives(rows: DataFrame, k: int = 3, topic: str = "topic", key: str = "id",
                    vector: str = "embedding") -> DataFrame:
    """(topic, doc_id, score, rank) of the k documents closest to their topic's centroid."""
    inside = rows.where(F.col(topic) != -1).select(F.col(topic).cast("bigint").alias("topic"),
                                                   F.col(key).alias("doc_id"), F.col(vector).alias("embedding"))
    scored = inside.join(centroids(inside), "topic").select(
        "topic", "doc_id", numeric.cosine(F.col("embedding"), F.col("centroid")).alias("score"))
    return top_k_per_group(scored, ["topic"], [F.desc(F.round("score", 9)), F.col("doc_id")], k)


def cluster_topic_run(docs: DataFrame, top: int = 10, seed: int = 42, clusters: Callable[..., DataFrame] = embedding_clusters,
                      **options) -> tuple[DataFrame, DataFrame]:
    """Clusters, their words and one row of metrics. ``docs`` has id, tokens and embedding; ``clusters`` is
    ``embedding_clusters`` or ``density_topics``."""
    named = None
    if clusters is embedding_clusters and not {"key", "vector"} & set(options):
        rows, ids = docs.agg(F.count("id"), F.count_distinct("id")).first()
        assigned = cluster_assignment(docs.select("id", "embedding"), seed=seed, **options)
        found = cut_lineage(assigned(docs.select("id", "embedding")).select("id", "topic"))
        if rows == ids:  # every document finds its own topic only, which needs no join
            named = assigned(docs.where(F.col("id").isNotNull()))
    else:
        found = cut_lineage(clusters(docs, seed=seed, **options))
    words = cut_lineage(top_terms(class_tfidf(docs.join(found, "id") if named is None else named), top))
    row = topic_overview(found)
    return words, (row.withColumn("coherence", c_v(words, docs).agg(F.avg("coherence")).scalar())
                   .withColumn("diversity", diversity(words).scalar()))


def repeated_runs(docs: DataFrame, seeds: Sequence[int], fraction: float = 1.0, **options) -> DataFrame:
    """Metrics of one run per seed, each on its own hash sample; the runs go on at the same time and read one stored copy of
    ``docs``."""
    docs = stored(docs, "runs")

    def one(seed: int) -> DataFrame:
        _, row = cluster_topic_run(hash_sample(docs, "id", fraction, seed), seed=seed, **options)
        return cut_lineage(row.select(F.lit(seed).alias("seed"), "*"))

    return union_all(concurrently([partial(one, seed) for seed in seeds]))


def cluster_topics_per_period(docs: DataFrame, periods: Sequence[tuple[int, int]], min_docs: int = 5000,
                              **options) -> tuple[DataFrame, DataFrame]:
    sliced = in_periods(docs, periods, min_docs)
    return per_group(sliced, "period", 1, lambda part: cluster_topic_run(part, **options))
