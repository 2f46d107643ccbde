"""Spark ML features, classifiers and clusterings."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.numeric import r6
from corvane.operators import classify, encode, evaluate, features
from corvane.plans.runtime import cut_lineage, new_path
from corvane.queries.registry import query
from corvane.queries.views import Tables
from corvane.sources import sink


def cleaned_docs(t: Tables):
    """Clean documents with their language as label."""
    return t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("label_str"),
                              tx.clean(F.col("text")).alias("text_clean"))


def language_docs(t: Tables):
    """The same, cleaned once for all the passes of a fit."""
    return cut_lineage(cleaned_docs(t))


def hashed_rows(t: Tables, num_features: int = 1 << 16):
    docs = language_docs(t)
    rows = features.tfidf_stages(num_features).fit(docs).transform(docs)
    return cut_lineage(features.feature_rows(rows))


def scores(outcome):
    row = outcome.metrics
    return row.select(*[r6(F.col(c)).alias(c) for c in row.columns])


@query("T04_hashed_counts")
def _(t):
    tokens = features.tokenised(t.clean_docs(), output_col="kept")
    counter = features.HashingTF(inputCol="kept", outputCol="tf", numFeatures=1 << 20)
    return features.feature_summary(counter.transform(tokens), "tf")


@query("T05_vocabulary_counts")
def _(t):
    tokens = features.tokenised(t.clean_docs(), output_col="kept")
    counter = features.CountVectorizer(inputCol="kept", outputCol="tf", vocabSize=10_000, minDF=2.0, maxDF=0.9)
    return features.feature_summary(features.fit_vocabulary(counter, tokens).transform(tokens), "tf")


@query("T08_tfidf_features")
def _(t):
    return features.feature_summary(hashed_rows(t, 1 << 18))


@query("T09_unit_length", "SELECT id, CAST(1.0 AS DOUBLE) AS size FROM clean_docs WHERE text_clean <> ''")
def _(t):
    docs = t.clean_docs().where(F.col("text_clean") != "")
    counted = features.HashingTF(inputCol="tokens", outputCol="features", numFeatures=1 << 18).transform(
        features.tokenised(docs))
    unit = features.unit_length().transform(counted)
    squares = F.transform(F.unwrap_udt("unit")["values"], lambda v: v * v)
    return unit.select("id", r6(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, v: a + v))).alias("size"))


@query("T10_word_vectors")
def _(t):
    docs = language_docs(t)
    model = features.word2vec_stages(partitions=t.spark.sparkContext.defaultParallelism, label=False).fit(docs)
    return features.components(model.transform(docs), "features", ["x", "y"]).select("id", r6(F.col("x")).alias("x"),
                                                                                     r6(F.col("y")).alias("y"))


@query("T12_embedded_texts")
def _(t):
    vectors = encode.embedded(t.documents, "hashed-384", key="doc_id")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    return vectors.select("id", F.size("embedding").alias("width"), F.round(F.sqrt(square), 4).alias("size"))


@query("M01_logistic_regression")
def _(t):
    return scores(classify.run_classifier(hashed_rows(t), classify.logistic_regression()))


@query("M02_naive_bayes")
def _(t):
    return scores(classify.run_classifier(hashed_rows(t), classify.naive_bayes()))


VOCABULARY = 10_000


def small_rows(t: Tables):
    """Vocabulary features: trees bin every column, so they get a fitted vocabulary instead of hash buckets."""
    docs = language_docs(t)
    rows = features.vocabulary_stages(VOCABULARY, 2.0).fit(docs).transform(docs)
    return cut_lineage(features.feature_rows(rows))


@query("M03_decision_tree")
def _(t):
    return scores(classify.run_classifier(small_rows(t), classify.decision_tree(), width=VOCABULARY))


@query("M04_random_forest")
def _(t):
    return scores(classify.run_classifier(small_rows(t), classify.random_forest(), width=VOCABULARY))


@query("M05_word_vectors_logistic")
def _(t):
    return scores(classify.run_classifier(language_docs(t), classify.word2vec_logistic(200, max_iter=60, reg=0.1, partitions=t.spark.sparkContext.defaultParallelism)))


def trained_and_evaluated(t: Tables, stages, classifier, width=None):
    """Train, evaluate, save, and decode the most frequent confusions."""
    outcome = classify.run_classifier(language_docs(t), Pipeline(stages=[*stages.getStages(), classifier]), width=width)
    classify.save_outcome(outcome, new_path(t.spark, "outcome"))
    named = classify.named_confusions(outcome, classify.label_names(outcome.model))
    kept = evaluate.top_confusions(outcome.confusion)
    return kept.join(named.select("label", "prediction", "label_name", "prediction_name"),
                     ["label", "prediction"], "left")


@query("M06_train_and_evaluate")
def _(t):
    return trained_and_evaluated(t, features.tfidf_stages(1 << 16), classify.naive_bayes())


@query("M06_train_and_evaluate_logistic_regression")
def _(t):
    return trained_and_evaluated(t, features.tfidf_stages(1 << 16), classify.logistic_regression())


@query("M06_train_and_evaluate_decision_tree")
def _(t):
    return trained_and_evaluated(t, features.vocabulary_stages(VOCABULARY, 2.0), classify.decision_tree(), VOCABULARY)


@query("M06_train_and_evaluate_random_forest")
def _(t):
    return trained_and_evaluated(t, features.vocabulary_stages(VOCABULARY, 2.0), classify.random_forest(), VOCABULARY)


@query("M07_ablation")
def _(t):
    first = classify.ABLATION[:1]
    docs = classify.ablation_tokens(cleaned_docs(t))
    return sink.read_log(t.spark, classify.ablation(docs, classify.ablation(docs, settings=first)), "config")


@query("M08_kmeans")
def _(t):
    rows = features.array_as_vector(t.embeddings.withColumn("label_str", F.col("label").cast("string")),
                                    "embedding", "features")
    return classify.clustering_scores(cut_lineage(classify.clustered(rows, 10).select("features", "cluster", "label_str")))


@query("M08_kmeans_tfidf")
def _(t):
    rows = hashed_rows(t).select("features", "label_str")
    return evaluate.cluster_summary(evaluate.contingency(classify.clustered(rows, 30)))


@query("M09_plane")
def _(t):
    rows = features.array_as_vector(t.embeddings, "embedding", "features").select("vec_id", "label", "features")
    return classify.plane(rows).select("vec_id", "label", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query("M10_chi_square")
def _(t):
    return features.feature_summary(classify.chi_square_features(small_rows(t)), "selected")


@query("M02_quality_labels")
def _(t):
    """Quality labels as classes: skewed, and only some documents have one."""
    rated = (t.labels.join(t.documents, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("label_str"),
        tx.clean(F.col("text")).alias("text_clean")))
    rows = cut_lineage(features.feature_rows(features.tfidf_stages(1 << 16).fit(rated).transform(rated)))
    return scores(classify.run_classifier(rows, classify.naive_bayes()))
