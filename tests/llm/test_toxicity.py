import numpy as np

from corvane.llm import toxicity
from corvane.llm.queries import QUERIES
from tests.llm import cases

LABELS = "doc_id long, quality int, toxic int, text string"


def labelled(n):
    """Texts, a tenth toxic by a word, a tenth by a word's beginning, a fifth of low quality by marks."""
    rows, labels = [], []
    for i in range(n):
        text, toxic, low = cases.prose(i, 40), i % 5 == 0, i % 7 == 0
        if toxic:
            text += " dolt" if i % 2 else f" grumb{'aeiou'[i % 5]}{i % 3}"
        if low:
            text = text.replace(" ", " ### ")
        rows.append((i, text, None, None, 0))
        labels.append((i, int(not low), int(toxic), "label"))
    return rows, labels


def test_chain_learns_words_beginnings_and_earlier_categories(spark):
    rows, labels = labelled(600)
    docs, table = cases.documents(spark, rows, extra=True), spark.createDataFrame(labels[:400] + labels[:10], LABELS)
    chain = toxicity.fit(docs, table, toxicity.given_categories())
    assert chain.categories == ["low_quality", "toxic"] and len(chain.weights[1]) == len(chain.weights[0]) + 1
    scored = toxicity.score(docs, chain, out="p").collect()
    told = {r.doc_id: r.p for r in scored}
    for (i, *_), (_, quality, toxic, _) in zip(rows[400:], labels[400:]):
        assert (told[i][1] >= chain.cuts[1]) == bool(toxic) and (told[i][0] >= chain.cuts[0]) == (quality == 0)
    kept = toxicity.reject(docs, chain, "toxic")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, t, _ in labels if not t}


def test_later_models_read_out_of_fold_probabilities():
    rng = np.random.default_rng(1)
    x = (rng.random((300, 6)) < 0.5).astype(np.float32)
    y = np.stack([x[:, 0], x[:, 0]], axis=1).astype(float)
    chain = toxicity.Chain(["a", "b"], {f"f{i}": i for i in range(6)}).fit(x, y, np.arange(300) % 3)
    assert chain.weights[1][6] > 0.3  # the second category leans on the first


def test_odd_documents_and_few_labels(spark):
    docs = cases.documents(spark, extra=True)
    labels = spark.createDataFrame([(0, 1, 0, "x"), (6, 1, 1, "x"), (7, None, 1, "x"), (None, 1, 1, "x"), (999, 1, 1, "x")], LABELS)
    chain = toxicity.fit(docs, labels, toxicity.given_categories())
    scored = toxicity.score(docs, chain)
    assert scored.count() == len(cases.odd_documents())
    assert all(len(r.p) == 2 and all(0 <= v <= 1 for v in r.p) for r in toxicity.score(docs, chain, out="p").collect())
    none = toxicity.fit(docs, spark.createDataFrame([], LABELS), toxicity.given_categories())
    assert toxicity.reject(docs, none, "toxic").count() == len(cases.odd_documents())
    assert toxicity.reject(cases.documents(spark, []), chain, "toxic").collect() == []


def test_query_as_one_text_at_a_time_and_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op3_toxicity_chain"](spark, sf).collect()
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, labels, toxicity.given_categories())
    names = sorted(chain.vocabulary, key=chain.vocabulary.get)
    for r in docs.orderBy("doc_id").limit(60).collect():
        present = toxicity.text_features(r.text)
        x = np.array([f in present for f in names], float)
        p = []
        for w in chain.weights:
            p.append(float(toxicity.sigmoid(np.append(x, p) @ w[:-1] + w[-1])))
        got = next(g for g in rows if g.doc_id == r.doc_id)
        np.testing.assert_allclose([got.p_low_quality, got.p_toxic], p, atol=1e-6)
    toxic = {r.doc_id: r.toxic for r in rows}
    told = labels.collect()
    assert sum(toxic[r.doc_id] == bool(r.toxic) for r in told) >= 0.98 * len(told)
