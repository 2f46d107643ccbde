"""Word vectors against a plain loop, a heap's code lengths and a sum over words; parts, saving and odd texts."""

import heapq

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from corvane.operators import classify, features, wordvectors
from corvane.plans.runtime import new_path

WORDS = {"a": "sun moon star sky orbit", "b": "cell gene protein tissue enzyme"}


@pytest.fixture(scope="module")
def docs(spark):
    draw = np.random.default_rng(1)
    rows = [(i, label, " ".join(draw.choice(WORDS[label].split(), 12)) + " shared") for i in range(240) for label in ["ab"[i % 3 == 0]]]
    return spark.createDataFrame(rows, "id long, label_str string, text_clean string")


def vectors_by_id(df):
    return {r["id"]: np.array(r["features"]) for r in df.select("id", "features").collect()}


@pytest.mark.parametrize("n", [1, 2, 3, 50, 1000])
def test_code_is_as_short_as_a_heap_makes_it(n):
    counts = np.sort(np.random.default_rng(n).zipf(1.5, n).clip(1, 10 ** 6))[::-1]
    parent, right = wordvectors.huffman(counts)
    start, _, _ = wordvectors.paths(np.arange(n), parent, right)
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert (np.diff(start) * counts).sum() == cost
    assert parent[-1] == -1 and (parent[:-1] >= n).all()
    for inner in range(n, 2 * n - 1):
        assert right[parent == inner].tolist() in ([False, True], [True, False])


def test_block_of_one_word_is_the_plain_loop(monkeypatch):
    monkeypatch.setattr(wordvectors, "BLOCK", 1)
    draw = np.random.default_rng(3)
    words, sentence = draw.integers(0, 9, 400), np.arange(400) // 37
    counts = np.sort(np.bincount(words))[::-1]
    parent, right = wordvectors.huffman(counts)
    own, moved, got = wordvectors.learned(words, sentence, parent, right, 6, 3, 0.5, 7, 2)
    vectors, outer = wordvectors.first_vectors(np.arange(9), 6, 7).astype(np.float64), np.zeros((17, 6))
    reach = np.random.default_rng([7, 2]).integers(1, 4, 400)
    for j in range(400):
        around = [i for i in range(max(0, j - reach[j]), min(400, j + reach[j] + 1)) if i != j and sentence[i] == sentence[j]]
        node, path = words[j], []
        while parent[node] >= 0:
            path.append((parent[node], right[node]))
            node = parent[node]
        before, nodes_before = vectors.copy(), outer.copy()
        for i in around:
            for up, code in path:
                score = before[words[i]] @ nodes_before[up]
                step = 0.5 * (1 - code - 1 / (1 + np.exp(-score))) if abs(score) < 6 else 0.0
                vectors[words[i]] += step * nodes_before[up]
                outer[up] += step * before[words[i]]
    assert own.tolist() == list(range(9)) and moved.all()
    assert np.allclose(got, vectors, rtol=1e-2, atol=1e-3)


def test_blocks_stay_close_to_single_words(monkeypatch):
    draw = np.random.default_rng(5)
    words, sentence = (draw.zipf(1.3, 30_000) - 1).clip(0, 499), np.arange(30_000) // 100
    parent, right = wordvectors.huffman(np.sort(np.bincount(words, minlength=500) + 1)[::-1])
    found = []
    for block in (1, wordvectors.BLOCK):
        monkeypatch.setattr(wordvectors, "BLOCK", block)
        vectors = wordvectors.learned(words, sentence, parent, right, 20, 5, 0.025, 1, 0)[2]
        found.append(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
    assert (found[0] * found[1]).sum(axis=1)[:50].mean() > 0.97


def test_one_word_again_and_again_stays_finite():
    words = np.zeros(20_000, np.int64)
    parent, right = wordvectors.huffman(np.array([20_000, 5]))
    vectors = wordvectors.learned(words, words, parent, right, 20, 5, 0.025, 1, 0)[2]
    assert np.isfinite(vectors).all() and np.abs(vectors).max() < 100


def test_long_sentences_are_cut_and_runs_bounded():
    import pyarrow as pa

    parent, _ = wordvectors.huffman(np.arange(200, 0, -1))
    texts = [list(range(100)), [], list(range(100, 200)), [5] * 2500]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.list_(pa.int32()))], ["words"])
    (words, sentence), = wordvectors.runs(iter([batch]), parent, 10 ** 6)
    assert words.tolist() == sum(texts, [])
    assert np.unique(sentence, return_counts=True)[1].tolist() == [100, 100, 1000, 1000, 500]
    both = list(wordvectors.runs(iter([batch, batch]), parent, 1))
    assert [len(w) for w, _ in both] == [2700, 2700]


def test_texts_are_means_of_their_words_and_equal_ones_equal(spark, docs, monkeypatch):
    monkeypatch.setattr(wordvectors, "PART_TEXTS", 7)
    monkeypatch.setattr(wordvectors, "ROWS", 20)  # many runs
    model = features.word2vec_stages(16, partitions=3).fit(docs)
    odd = spark.createDataFrame([(1000, "a", "sun gene unheard"), (1001, "a", ""), (1002, "b", "unheard"), (1003, "b", "sun gene unheard"), (1003, "b", "sun")],
                                "id long, label_str string, text_clean string")
    out = model.transform(odd)
    got = sorted((r["id"], r["text_clean"], tuple(r["features"])) for r in out.collect())
    assert [r[0] for r in got] == [1000, 1001, 1002, 1003, 1003]
    stage = next(s for s in model.stages if isinstance(s, wordvectors.WordVectorsModel))
    words = {r["hash"]: n for n, r in enumerate(spark.read.parquet(f"{stage.getOrDefault('path')}/words").orderBy(F.desc("n"), "hash").collect())}
    table = {r["word"]: np.array(r["vector"]) for r in stage.vectors(spark).collect()}
    hashes = spark.range(1).select(F.xxhash64(F.lit("sun")).alias("sun"), F.xxhash64(F.lit("gene")).alias("gene")).first()
    assert len(table) == len(words) == 11
    assert np.allclose(got[0][2], (table[words[hashes["sun"]]] + table[words[hashes["gene"]]]) / 3, atol=1e-6)
    assert set(got[1][2]) == set(got[2][2]) == {0.0}
    assert got[0][2] == next(r[2] for r in got if r[:2] == (1003, "sun gene unheard"))


def test_words_of_one_subject_are_near_and_the_classifier_finds_it(spark, docs):
    outcome = classify.run_classifier(docs, classify.word2vec_logistic(16, max_iter=30, reg=0.01, partitions=2))
    assert outcome.metrics.first()["accuracy"] > 0.95


def test_saved_vectors_are_the_same(spark, docs):
    model = Pipeline(stages=features.word2vec_stages(8, partitions=2, label=False).getStages()).fit(docs)
    path = new_path(spark, "vectors")
    model.write().overwrite().save(path)
    first, second = vectors_by_id(model.transform(docs)), vectors_by_id(PipelineModel.load(path).transform(docs))
    assert all((first[i] == second[i]).all() for i in first) and len(first) == 240


def test_no_vocabulary_is_an_error(spark, docs):
    with pytest.raises(ValueError):
        features.word2vec_stages(8, min_count=10 ** 9).fit(docs)


def test_vectors_are_not_collected(spark, docs, monkeypatch):
    """Neither numbers nor strings of the vocabulary come to the driver, only hashes and counts."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen = []
    for name in ("collect", "toPandas", "toArrow", "toLocalIterator"):
        monkeypatch.setattr(DataFrame, name, lambda self, *a, f=getattr(DataFrame, name), **b: seen.append(self.dtypes) or f(self, *a, **b))
    features.word2vec_stages(8, partitions=2, label=False).fit(docs)
    assert [kind for columns in seen for _, kind in columns if kind != "bigint"] == []
    assert seen
