"""Invariants and brute force for models, topics and search."""

import itertools
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from corvane.operators import classify, encode, evaluate, features, nmf, search, topics
from corvane.plans import runtime
from corvane.plans.runtime import new_path
from corvane.queries import QUERIES

WORDS = {"a": "sun moon star sky orbit", "b": "cell gene protein tissue enzyme"}


def values(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(120):
        label = "a" if i % 3 else "b"
        pool = WORDS[label].split()
        rows.append((i, label, " ".join(pool[(i * j + j) % 5] for j in range(1, 8)) + " shared"))
    return spark.createDataFrame(rows, "id long, label_str string, text_clean string")


def test_classifier_beats_majority_and_reloads(spark, docs):
    model = features.tfidf_stages(1 << 10).fit(docs)
    outcome = classify.run_classifier(model.transform(docs), classify.logistic_regression())
    assert outcome.metrics.first()["accuracy"] > 0.9
    path = new_path(spark, "m")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path).transform(docs)
    assert values(features.feature_summary(again)) == values(features.feature_summary(model.transform(docs)))


def test_ablation_resumes(spark, docs):
    settings = (("one", 10, False), ("two", 20, True))
    path = classify.ablation(docs, settings=settings[:1], estimator=classify.naive_bayes)
    path = classify.ablation(docs, path, settings=settings, estimator=classify.naive_bayes)
    assert [r.config for r in spark.read.parquet(path).orderBy("config").collect()] == ["one", "two"]


def test_ablation_makes_tokens_once_and_counts_words_once_for_all_sizes(spark, monkeypatch):
    """The scores are those of a fit of its own for each setting."""
    rows = [(i, "ab"[i % 2], " ".join(f"w{j:02}" for j in range(12) if i >= 5 * j) + " odd" * (i % 2) * (i % 3))
            for i in range(70)]
    docs = spark.createDataFrame(rows, "id long, label_str string, text_clean string")
    settings = (("five", 5, False), ("eight", 8, False), ("all", 100, False), ("grams", 100, True))
    wanted = {}
    for name, size, bigrams in settings:
        stages = features.vocabulary_stages(size, 2.0, bigrams=bigrams, min_length=2).getStages()
        outcome = classify.run_classifier(docs, Pipeline(stages=[*stages, classify.naive_bayes()]))
        wanted[name] = tuple(outcome.metrics.first())
    calls = {"tokens": 0, "fits": 0}

    def told(what, given):
        def call(*args, **kwargs):
            calls[what] += 1
            return given(*args, **kwargs)
        return call

    monkeypatch.setattr(features, "token_stages", told("tokens", features.token_stages))
    monkeypatch.setattr(CountVectorizer, "fit", told("fits", CountVectorizer.fit))
    log = spark.read.parquet(classify.ablation(docs, settings=settings, estimator=classify.naive_bayes))
    assert calls == {"tokens": 1, "fits": 2}
    got = {r["config"]: tuple(v for c, v in r.asDict().items() if c not in ("config", "vocab_size", "bigrams"))
           for r in log.select("config", "vocab_size", "bigrams", *outcome.metrics.columns).collect()}
    assert got == {name: pytest.approx(row) for name, row in wanted.items()}


def test_report_keeps_labels_never_predicted(spark):
    counts = spark.createDataFrame([("x", "y", 3), ("y", "y", 2)], "label string, prediction string, n long")
    report = {r.label: (r.precision, r.recall, r.f1, r.support) for r in evaluate.class_report(counts).collect()}
    assert report["x"] == (0.0, 0.0, 0.0, 3)
    assert report["y"] == (0.4, 1.0, pytest.approx(4 / 7), 2)
    empty = counts.limit(0)
    assert evaluate.overall(empty).first()["accuracy"] == 0.0


def test_single_cluster_has_no_information(spark):
    table = spark.createDataFrame([(1, "x", 3), (1, "y", 2)], "cluster int, label_str string, n long")
    assert evaluate.mutual_information(table).first()["nmi"] == 0.0
    assert evaluate.purity(table).first()["purity"] == pytest.approx(0.6)


def test_nmf_residual_never_rises(spark, docs):
    tokens = features.tokenised(docs)
    rows, vocabulary = nmf.tfidf_rows(tokens, max_df=0.95)
    result = nmf.factorise(rows, vocabulary, 2, max_iter=20, tolerance=0.0)
    assert (result.topics >= 0).all()
    assert all(b <= a + 1e-9 for a, b in itertools.pairwise(result.residuals))
    found = {r.id: r.topic for r in nmf.document_topics(rows, result).collect()}
    assert len({found[i] for i in found if i % 3}) == 1 and len(set(found.values())) == 2


def dense(rows, width):
    out = []
    for r in rows.collect():
        line = np.zeros(width)
        line[r["indices"]] = r["values"]
        out.append(line)
    return np.array(out)


def test_singular_vectors_and_double_svd_start(spark, docs):
    rows, vocabulary = nmf.tfidf_rows(features.tokenised(docs), max_df=0.95)
    matrix, k = dense(rows, len(vocabulary)), 2
    left, values, right = np.linalg.svd(matrix, full_matrices=False)
    got, vectors = nmf.singular(rows, len(vocabulary), k)
    assert got == pytest.approx(values[:k], rel=1e-6) and abs(np.sum(vectors.T * right[:k], axis=1)) == pytest.approx(np.ones(k), abs=1e-6)
    want = np.zeros((k, len(vocabulary)))
    for j in range(k):
        u, v = left[:, j], right[j]
        pairs = [(np.maximum(s * u, 0), np.maximum(s * v, 0)) for s in (1, -1)]
        u, v = max(pairs, key=lambda p: np.linalg.norm(p[0]) * np.linalg.norm(p[1]))
        want[j] = np.sqrt(values[j] * np.linalg.norm(u) * np.linalg.norm(v)) * v / np.linalg.norm(v)
    assert nmf.double_svd(rows, len(vocabulary), k) == pytest.approx(np.where(want > 1e-10, want, matrix.mean()), abs=1e-6)


def test_double_svd_ends_below_a_random_start(spark):
    rng = np.random.default_rng(0)
    pools = [[f"t{j}w{i}" for i in range(12)] for j in range(6)]
    texts = [" ".join(rng.choice(pools[i % 6] + pools[(i + 1) % 6][:3], 15)) for i in range(180)]
    tokens = features.tokenised(spark.createDataFrame(list(enumerate(texts)), "id long, text_clean string"))
    rows, vocabulary = nmf.tfidf_rows(tokens)
    random = np.random.default_rng(42).uniform(0.1, 1.0, (6, len(vocabulary)))
    one = nmf.factorise(rows, vocabulary, 6, max_iter=6, tolerance=0.0)
    other = nmf.factorise(rows, vocabulary, 6, max_iter=6, tolerance=0.0, start=random)
    assert one.residuals[-1] <= other.residuals[-1] + 1e-9 and one.residuals[0] < other.residuals[0]


def brute_counts(texts, words, window):
    own, both, total = {}, {}, 0
    for tokens in texts:
        if not tokens:
            continue
        size = len(tokens) if window is None else min(window, len(tokens))
        for s in range(len(tokens) - size + 1):
            total += 1
            seen = sorted(set(tokens[s:s + size]) & set(words))
            for w in seen:
                own[w] = own.get(w, 0) + 1
            for pair in itertools.combinations(seen, 2):
                both[pair] = both.get(pair, 0) + 1
    return own, both, total


@pytest.mark.parametrize("window", [None, 1, 3, 50])
def test_presence_counts(spark, window):
    texts = ["a b c a d e f a", "b", "", "c c c a", "x y z"]
    docs = features.tokenised(spark.createDataFrame([(t,) for t in texts], "text_clean string").repartition(3))
    topic_words = {0: ["b", "a", "q"], 1: ["c", "a"], 2: ["q"]}
    words = spark.createDataFrame([(t, i + 1, w) for t, ws in topic_words.items() for i, w in enumerate(ws)], "topic long, rank long, term string")
    own, both, total = brute_counts([t.split() for t in texts], ["a", "b", "c", "q"], window)
    for widths in ([window], [2, window, 7]):
        rows = [r for r in topics.window_counts(words, docs, widths).collect() if r.width == window]
        got = {(r.topic, r.word_1, r.word_2): r.n for r in rows}
        assert got.pop((None, None, None)) == total
        want = {(t, x, y): own.get(x, 0) if x == y else both.get((min(x, y), max(x, y)), 0)
                for t, ws in topic_words.items() for i, x in enumerate(ws) for y in ws[i:]}
        assert got == {k: n for k, n in want.items() if n}


def test_c_v_against_brute_force(spark, docs):
    tokens = features.tokenised(docs)
    chosen = ["sun", "moon", "cell", "shared"]
    words = spark.createDataFrame([(0, i + 1, w) for i, w in enumerate(chosen)], "topic long, rank long, term string")
    own, both, total = brute_counts([r.text_clean.split() for r in docs.collect()], chosen, 3)

    def npmi(a, b):
        n = own[a] if a == b else both.get((min(a, b), max(a, b)), 0)
        p = n / total + 1e-12
        return math.log(p * total * total / (own[a] * own[b])) / -math.log(p)

    matrix = np.array([[npmi(a, b) for b in chosen] for a in chosen])
    summed = matrix.sum(axis=0)
    want = np.mean([row @ summed / np.linalg.norm(row) / np.linalg.norm(summed) for row in matrix])
    assert topics.c_v(words, tokens, 3).first()["coherence"] == pytest.approx(want)


def test_nearest_is_the_same_for_any_partitioning(spark):
    rows = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(100)] + [(100, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    want = values(search.nearest_to(df.repartition(1), [5, 9], 7).drop("score"))
    assert want == values(search.nearest_to(df.repartition(9), [5, 9], 7).drop("score"))
    with pytest.raises(KeyError):
        search.nearest_to(df, [5, 1234])


def test_embedding_is_unit_norm_and_stable(spark, docs):
    one = values(encode.embedded(docs, "hashed-128", text="text_clean"))
    assert one == values(encode.embedded(docs.repartition(5), "hashed-128", text="text_clean"))
    assert all(np.linalg.norm(v) == pytest.approx(1.0, abs=1e-5) for _, v in one)


def test_failed_group_does_not_stop_the_others(spark, docs):
    def fit(part):
        if part.first()["label_str"] == "b":
            raise RuntimeError("cannot fit")
        return part.select(F.lit(0).alias("topic")), part.groupBy().count()

    words, metrics = topics.per_group(docs, "label_str", 1, fit)
    assert {r.group for r in words.collect()} == {"a"}
    assert {r.group: r.status for r in metrics.collect()} == {"a": "ok", "b": "RuntimeError"}


def test_fits_go_on_at_the_same_time_and_the_first_error_raises(spark):
    import threading
    together = threading.Barrier(4, timeout=60)

    def one(i):
        together.wait()  # four at a time, or it breaks
        return spark.range(i).count()

    assert topics.concurrently([lambda i=i: one(i) for i in range(8)], 4) == list(range(8))
    begun = []

    def bad(i):
        begun.append(i)
        if i == 0:
            raise ValueError("no")
        return spark.range(5).count()

    with pytest.raises(ValueError):
        topics.concurrently([lambda i=i: bad(i) for i in range(50)], 1)
    assert len(begun) < 50


def test_density_topics_of_two_pools(spark, docs):
    rows = encode.embedded(docs, "hashed-128", text="text_clean")
    found = {r.id: r.topic for r in topics.density_topics(rows, samples=3, least=8).collect()}
    assert len(found) == 120
    clusters = {found[i] for i in range(120) if found[i] >= 0}
    assert clusters and all(len({i % 3 > 0 for i in range(120) if found[i] == c}) == 1 for c in clusters)


def test_silhouette_range(spark, docs):
    rows = features.tfidf_stages(1 << 8).fit(docs).transform(docs).select("features", "label_str")
    row = classify.clustering_scores(classify.clustered(rows, 2)).first()
    assert -1 <= row.silhouette <= 1 and 0 < row.purity <= 1


def test_group_without_vocabulary_is_told_and_failed_jobs_raise(spark, docs):
    tokens = docs.select("label_str", F.split("text_clean", " ").alias("tokens"))
    words, metrics = topics.per_group(tokens, "label_str", 1, lambda part: topics.lda(part, 2, 1, min_df=50.0))
    rows = topics.with_status(words, metrics).collect()  # b has 40 documents
    assert [(r.status, r.term) for r in rows if r.group == "b"] == [("IllegalArgumentException", None)]
    assert {r.status for r in rows if r.group == "a"} == {"ok"} and all(r.term for r in rows if r.group == "a")

    def lost(part):
        if part.first()["label_str"] == "b":
            part.select(F.udf(lambda x: 1 // 0, "int")("label_str")).collect()
        return part.select(F.lit(0).alias("topic")), part.groupBy().count()

    with pytest.raises(PySparkException):
        topics.per_group(docs, "label_str", 1, lost)


@pytest.mark.parametrize("kind", ["logistic_regression", "decision_tree", "random_forest"])
def test_runner_decodes_confusions(spark, kind):
    rows = QUERIES[f"M06_train_and_evaluate_{kind}"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.label_name and r.prediction_name for r in rows if r.label != r.prediction)


def test_lda_bound_is_the_library_s(spark, docs):
    tokens = features.tokenised(docs).select("tokens").union(spark.createDataFrame([(["elsewhere"],), ([],)], "tokens array<string>"))
    vectoriser, model = topics.lda_stages(3, 100, 2.0, 2 ** 63 - 1.0, 5, 42).fit(tokens).stages
    counted = vectoriser.transform(tokens)
    bound, words = topics.lda_bound(model, counted)
    assert bound == pytest.approx(model.logLikelihood(counted), rel=1e-5)
    assert -bound / words == pytest.approx(model.logPerplexity(counted), rel=1e-5)


def test_shares_of_documents_become_numbers(spark):
    rows = spark.createDataFrame([(["all", "half", "rare"],), (["all", "half"],), (["all"],), (["all", "all"],)], "tokens array<string>")
    counter = features.CountVectorizer(inputCol="tokens", outputCol="tf", vocabSize=10, minDF=0.5, maxDF=0.9)
    model = features.fit_vocabulary(counter, rows)
    assert model.vocabulary == counter.fit(rows).vocabulary == ["half"]
    assert (model.getMinDF(), model.getMaxDF()) == (2.0, 3.6)  # bounds that need no kept tokens
    one = rows.limit(1)
    assert features.fit_vocabulary(counter.copy({counter.maxDF: 1.0}), one).vocabulary
    assert features.fit_vocabulary(counter, one).vocabulary == counter.fit(one).vocabulary == []


def test_rows_that_trees_keep_are_dealt_over_partitions(spark, docs, monkeypatch):
    rows = features.feature_rows(features.vocabulary_stages(100).fit(docs).transform(docs)).coalesce(1)
    monkeypatch.setattr(classify, "ROW_NUMBERS", 2000)
    fitted = []

    class Tree(classify.DecisionTreeClassifier):
        def fit(self, training):
            fitted.append(training.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
            return super().fit(training)

    outcome = classify.run_classifier(rows, Tree(maxDepth=3), width=100)
    assert fitted[0] <= 1.2 * 2000 / 100 and outcome.metrics.first()["accuracy"] > 0.9
    same = runtime.spread(rows, F.lit(1), 1000)
    assert same is rows


def test_rows_in_one_of_many_partitions_are_dealt(spark):
    """A scan has as many partitions as its bytes ask for, and all rows in those where row groups begin."""
    rows = spark.range(0, 8000, 1, 20).where(F.col("id") < 400)
    dealt = runtime.spread(rows, F.lit(10), 1000)
    sizes = dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] <= 110 and sizes[1] == 400
    assert runtime.spread(rows, F.lit(10), 4000) is rows and runtime.spread(rows.limit(0), F.lit(10), 5).count() == 0


def test_one_decomposition_at_a_time(spark, monkeypatch):
    seen = []

    class Watched(topics.PCA):
        def fit(self, vectors):
            seen.append(topics.DECOMPOSING.locked())
            return super().fit(vectors)

    monkeypatch.setattr(topics, "PCA", Watched)
    rows = spark.createDataFrame([(i, [float(i % 2), float(i % 3), 1.0]) for i in range(40)], "id long, embedding array<float>")
    found = topics.repeated_runs(rows.withColumn("tokens", F.array(F.lit("w"))), (1, 2), k=2, dims=2, min_size=1)
    assert found.count() == 2 and seen == [True, True]


@pytest.fixture(scope="module")
def embedded(spark):
    rows = [(i, f"w{i % 3} w{i % 5} common".split(), [float(i % 3 == 0) + 0.01 * (i % 7), float(i % 3 == 1) + 0.02 * (i % 5), 0.3]) for i in range(90)]
    return spark.createDataFrame(rows, "id long, tokens array<string>, embedding array<float>")


@pytest.mark.parametrize("again", [0, 1])
def test_run_has_the_words_of_a_join_by_id(spark, embedded, again):
    """Documents get their topics in place; those that come twice, and those without an id, as the join has them."""
    docs = embedded.unionByName(embedded.where("id % 4 = 0")) if again else embedded
    docs = runtime.cut_lineage(docs.unionByName(embedded.where("id < 5").withColumn("id", F.lit(None).cast("long"))).coalesce(1))
    options = dict(k=3, dims=2, min_size=2, seed=3)
    words, row = topics.cluster_topic_run(docs, **options)
    found = topics.embedding_clusters(docs, **options)
    assert values(words) == values(topics.top_terms(topics.class_tfidf(docs.join(found, "id")), 10))
    assert row.first()["n_topics"] == found.where("topic <> -1").select("topic").distinct().count()


def test_runs_keep_no_copies_of_texts_and_vectors(spark, embedded, monkeypatch):
    kept = []
    monkeypatch.setattr(topics, "cut_lineage", lambda df: kept.append(df.dtypes) or runtime.cut_lineage(df))
    monkeypatch.setattr(topics, "stored", lambda df, name: kept.append(df.dtypes) or runtime.stored(df, name))
    assert topics.repeated_runs(embedded, range(3), 0.8, k=3, dims=2, min_size=2).count() == 3
    assert sum(("tokens", "array<string>") in columns for columns in kept) == 1
    assert sum(("embedding", "array<float>") in columns for columns in kept) == 1
