"""Stored indexes of texts and vectors, by brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.operators import neighbours, search, textindex
from corvane.plans.runtime import new_path


def values(df):
    return sorted(tuple(r) for r in df.collect())


# ---- texts ---------------------------------------------------------------------------------------------------

def bm25(docs, queries, k):
    """Top k (query, document, score at nine decimals, rank) by scoring everything."""
    words = {d: t.split() for d, t in docs if t.split()}
    mean = sum(map(len, words.values())) / len(words)
    df = {w: sum(w in v for v in words.values()) for w in {w for v in words.values() for w in v}}
    out = []
    for q, text in queries:
        score = {}
        for term in text.lower().split():
            for d, v in words.items():
                if term in v:
                    tf, idf = v.count(term), math.log(1 + (len(words) - df[term] + 0.5) / (df[term] + 0.5))
                    score[d] = score.get(d, 0.0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(v) / mean))
        best = sorted((-round(s, 9), d) for d, s in score.items())[:k]
        out += [(q, d, -s, rank) for rank, (s, d) in enumerate(best, 1)]
    return sorted(out)


def texts(seed, n, common=0.5):
    rng = random.Random(seed)
    return [" ".join((rng.choice(["the", "of", "and"]) if rng.random() < common else f"w{int(rng.paretovariate(0.7)) % 400}")
                     for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def searched(index, queries, k):
    return sorted((q, d, round(s, 9), r) for q, d, s, r in textindex.search(index, queries, k).collect())


def test_shards_are_bounded_by_words(spark, monkeypatch):
    for name, value in (("TOKENS", 500), ("GROUP", 2000), ("BATCH", 4)):
        monkeypatch.setattr(textindex, name, value)
    docs = [(i, f"w{i % 7} " * (100 if i % 2 else 3)) for i in range(200)]
    path = new_path(spark, "texts")
    index = textindex.build(spark.createDataFrame(docs, "id long, text_clean string").repartition(2), path)
    shards = spark.read.parquet(f"{path}/shards")
    assert shards.agg(F.max("tokens")).first()[0] < 500 + 400 and shards.agg(F.sum("documents")).first()[0] == 200
    assert shards.groupBy("group").agg(F.sum("tokens").alias("n")).agg(F.max("n")).first()[0] < 2000 + 900
    asked = [("q", "w1 w2")]
    assert searched(index, spark.createDataFrame(asked, "query_id string, text string"), 9) == bm25(docs, asked, 9)


@pytest.mark.parametrize("ids", ["long", "string"])
def test_bm25_as_scoring_everything(spark, monkeypatch, ids):
    """Several shards, blocks of queries and blocks of a term; words of half of all places; equal texts."""
    for name, value in (("SHARD", 30), ("QUERIES", 20)):
        monkeypatch.setattr(textindex, name, value)
    docs = [(i if ids == "long" else f"d{i:04d}", t) for i, t in enumerate(texts(1, 300) + ["the w1 w2"] * 30)]
    asked = [(f"q{i}", t) for i, t in enumerate(texts(2, 50) + ["the", "zebra", "", "W1 w1 the"])]
    built = textindex.build(spark.createDataFrame(docs, f"id {ids}, text_clean string").repartition(4), new_path(spark, "texts"))
    index = textindex.opened(spark, built.blocks.inputFiles()[0].split("/blocks/")[0])
    queries = spark.createDataFrame(asked, "query_id string, text string")
    for k in (1, 7, 1000):
        assert searched(index, queries, k) == bm25(docs, asked, k)


def posting_table(rows):
    """Blocks of (term, tf, documents); every document has 10 tokens."""
    return pa.table({"term": [t for t, *_ in rows], "n": pa.array([len(d) for *_, d in rows], pa.int32()),
                     "most_tf": pa.array([f for _, f, _ in rows], pa.int32()), "least_length": pa.array([10] * len(rows), pa.int32()),
                     "docs": [np.sort(d).tolist() for *_, d in rows], "tfs": pa.array([[f] * len(d) for _, f, d in rows], pa.list_(pa.int32())),
                     "lengths": pa.array([[10] * len(d) for *_, d in rows], pa.list_(pa.int32()))})


def test_terms_that_cannot_help_are_not_added_up():
    rng = np.random.default_rng(4)
    n = 4000
    rows = [("rare", 5, rng.choice(n, 60, replace=False)), ("rarer", 9, rng.choice(n, 40, replace=False)), ("the", 1, np.arange(n)), ("of", 1, np.arange(n))]
    shard = textindex.Shard(posting_table(rows), 10.0, 1.2, 0.75)
    weights = np.array([5.0, 6.0, 0.1, 0.1])
    doc, score, added = shard.top(np.arange(4), weights, 10)
    assert len(doc) == 10 and added < 400
    full, _, everything = shard.top(np.arange(4), weights, n)
    assert everything == 2 * n + 100 and full[:10].tolist() == doc.tolist()


@pytest.mark.parametrize("rare", [0, 6, 40])
def test_best_of_a_shard_as_adding_everything(monkeypatch, rare):
    """Common terms only, some rare ones, and only rare ones; ties; fewer documents than asked."""
    monkeypatch.setattr(textindex, "RARE", rare)
    rng = np.random.default_rng(rare)
    for _ in range(60):
        n = int(rng.integers(5, 60))
        rows = [(f"t{i}", int(rng.integers(1, 6)), rng.choice(n, int(rng.integers(1, n + 1)), replace=False)) for i in range(int(rng.integers(1, 12)))]
        shard = textindex.Shard(posting_table(rows), 10.0, 1.2, 0.75)
        codes = np.sort(rng.choice(len(rows), int(rng.integers(1, len(rows) + 1)), replace=False))
        weights = np.round(rng.exponential(2.0, len(codes)), 1) + 0.1
        score = np.zeros(n)
        for c, w in zip(codes, weights):
            score[rows[c][2]] += w * textindex.impact(rows[c][1], 10, 10.0, 1.2, 0.75)
        k = int(rng.integers(1, 9))
        wanted = [int(d) for d in np.lexsort((np.arange(n), -np.round(score, 9))) if score[d] > 0][:k]
        doc, found, _ = shard.top(codes, weights, k)
        assert shard.ids[doc].tolist() == wanted and found == pytest.approx(score[wanted])


def test_empty_index_and_no_queries(spark):
    empty = textindex.build(spark.createDataFrame([], "id long, text_clean string"), new_path(spark, "texts"))
    queries = spark.createDataFrame([("q", "word")], "query_id string, text string")
    assert textindex.search(empty, queries).collect() == []
    index = textindex.build(spark.createDataFrame([(1, "word"), (None, "word"), (2, None)], "id long, text_clean string"), new_path(spark, "texts"))
    assert [r.doc_id for r in textindex.search(index, queries).collect()] == [1] and index.documents == 1
    assert textindex.search(index, queries.limit(0)).collect() == []


# ---- vectors -------------------------------------------------------------------------------------------------

def clustered(seed, n, d=16, centres=40, spread=0.12):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, d))
    return [(int(i), [float(x) for x in middle[i % centres] + spread * rng.standard_normal(d)]) for i in range(n)]


def nearest(rows, queries, k, skip=True):
    unit = {i: np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) for i, v in rows}
    out = []
    for q in queries:
        best = sorted((-round(float(unit[q] @ v), 9), i) for i, v in unit.items() if not skip or i != q)[:k]
        out += [(q, i, rank) for rank, (_, i) in enumerate(best, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)


@pytest.fixture(scope="module")
def vectors(spark):
    rows = clustered(1, 2000)
    return rows, neighbours.build(frame(spark, rows), new_path(spark, "vectors"), cells=40)


def asked(spark, rows, every=50):
    return frame(spark, [r for r in rows if r[0] % every == 0]).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


def test_all_cells_are_exact_and_bounds_spare_most_rows(spark, vectors):
    rows, index = vectors
    found = neighbours.search(index, asked(spark, rows), 10, exclude_self=True)
    assert values(found.hits.select("query_id", "doc_id", "rank")) == nearest(rows, [i for i, _ in rows if i % 50 == 0], 10)
    assert found.compared.agg(F.avg("candidates")).first()[0] < 0.3 * len(rows)


def test_measured_probes_reach_the_recall(spark, vectors):
    rows, index = vectors
    probes = index.probes(0.95)
    found = neighbours.search(index, asked(spark, rows), 10, probes, exclude_self=True)
    exact = search.nearest_to(frame(spark, rows), [i for i, _ in rows if i % 50 == 0], 10)
    assert probes < 10 and neighbours.recall(found.hits, exact).first()["recall"] >= 0.95
    assert found.compared.agg(F.avg("candidates")).first()[0] < 0.2 * len(rows)


def test_equal_vectors_and_small_parts(spark, monkeypatch):
    """A third of the rows have one vector: its shell is cut into parts, ties go to the smaller id."""
    monkeypatch.setattr(neighbours, "PART", 40)
    monkeypatch.setattr(neighbours, "QUERIES", 5)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else v) for i, v in clustered(3, 600, d=3)]
    index = neighbours.build(frame(spark, rows), new_path(spark, "vectors"))
    found = neighbours.search(index, asked(spark, rows, 10), 7, exclude_self=True)
    assert values(found.hits.select("query_id", "doc_id", "rank")) == nearest(rows, [i for i, _ in rows if i % 10 == 0], 7)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]),
            (8, [-1.0, 0.0]), (9, [1.0, None])]
    index = neighbours.build(frame(spark, rows), new_path(spark, "vectors"))
    found = neighbours.search(index, asked(spark, [(0, [1.0, 0.0]), (50, None), (100, [1.0, 2.0, 3.0])]), 10)
    assert [(r.query_id, r.doc_id) for r in found.hits.orderBy("rank").collect()] == [(0, 1), (0, 2), (0, 8)]
    with pytest.raises(ValueError):
        neighbours.build(frame(spark, [(1, None)]), new_path(spark, "vectors"))


# ---- TF-IDF cosine -------------------------------------------------------------------------------------------

@pytest.mark.parametrize("common", [1, 3, 1 << 16])
def test_tfidf_cosine_as_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(search, "COMMON", common)  # the others meet their weights by a shuffle
    rng = random.Random(common)
    docs = [(i % 35, " ".join(f"t{int(rng.paretovariate(0.7)) % 25}" for _ in range(rng.randrange(0, 12)))) for i in range(40)]
    docs += [(50, None), (51, "")]
    queries = [(1, "t1 t2 t2"), (2, "t4 t9 unknown"), (3, ""), (4, docs[0][1] + " t3")]
    words = {}
    for d, text in docs:  # rows of one key are one document
        for w in (text or "").split():
            words.setdefault(d, []).append(w)
    df = {w: sum(w in v for v in words.values()) for v in words.values() for w in v}
    idf = {w: math.log((len(docs) + 1) / (n + 1)) for w, n in df.items() if n >= 2}

    def weights(tokens):
        return {w: tokens.count(w) * idf[w] for w in tokens if w in idf}

    def size(x):
        return math.sqrt(sum(v * v for v in x.values()))

    wanted = {}
    for q, text in queries:
        asked = weights(text.split())
        for d, tokens in words.items():
            here = weights(tokens)
            if (lengths := size(asked) * size(here)) > 0 and asked.keys() & here.keys():
                wanted[q, d] = sum(v * here.get(w, 0) for w, v in asked.items()) / lengths
    frames = spark.createDataFrame(docs, "id long, text_clean string"), spark.createDataFrame(queries, "query_id long, text string")
    got = {(r.query_id, r.doc_id): r.score for r in search.tfidf_cosine(*frames, min_doc_freq=2).collect()}
    assert got == pytest.approx(wanted, abs=1e-9)


def test_tfidf_scores_are_added_up_where_documents_are(spark):
    docs = spark.createDataFrame([(i, f"a b{i % 3} c{i % 5}") for i in range(60)], "id long, text_clean string")
    queries = spark.createDataFrame([(1, "a b1"), (2, "c2")], "query_id long, text string")
    plan = search.tfidf_cosine(docs, queries)._jdf.queryExecution().sparkPlan().toString()
    prepared = search.tfidf_cosine(docs, queries)._jdf.queryExecution().executedPlan().toString()
    assert "dot" in plan and not any("hashpartitioning(query_id" in x and "doc_id" in x for x in prepared.splitlines())


def test_queries_and_postings_are_not_repeated(spark, monkeypatch):
    """Ten blocks of queries on many groups: what is shuffled before they meet doesn't grow with either number."""
    for name, value in (("SHARD", 30), ("TERMS", 30), ("GROUP", 200)):
        monkeypatch.setattr(textindex, name, value)
    docs, asked = list(enumerate(texts(5, 200))), [(f"q{i}", t) for i, t in enumerate(texts(6, 40))]
    index = textindex.build(spark.createDataFrame(docs, "id long, text_clean string").repartition(4), new_path(spark, "texts"))
    assert index.shards.agg(F.count_distinct("group")).first()[0] > 5
    hits = textindex.search(index, spark.createDataFrame(asked, "query_id string, text string"), 5)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") > 5 and "FlatMapCoGroups" not in plan and "Generate" not in plan
    assert sorted((q, d, round(s, 9), r) for q, d, s, r in hits.collect()) == bm25(docs, asked, 5)


def test_rows_beaten_by_nearer_ones_are_not_handed_on(spark, monkeypatch):
    """Rows beyond a query's reach stay in the task; copies of parts and blocks of queries change nothing."""
    monkeypatch.setattr(neighbours, "VISITORS", 30)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    draw = np.random.default_rng(4).normal(size=(200, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draw)], "id long, embedding array<float>")
    index = neighbours.build(df, new_path(spark, "vectors"), cells=6)
    asked = df.selectExpr("id AS query_id", "embedding AS vector")
    visits = neighbours.located(asked, index, 6).withColumn("reach", F.lit(0.3))
    hits = neighbours.met(visits, index, 10, True).where("doc_id IS NOT NULL").collect()
    unit = draw.astype(np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosine = unit @ unit.T - 9 * np.eye(200)
    near = {(q, d) for q, d in zip(*np.nonzero(cosine >= 1 - 0.3 ** 2 / 2)) if (cosine[q] > cosine[q, d]).sum() < 10}
    assert near <= {(h.query_id, h.doc_id) for h in hits}
    assert min(h.score for h in hits) > 1 - 0.3 ** 2 / 2 - 1e-7
    exact = [(r.query_id, r.doc_id, r["rank"]) for r in neighbours.search(index, asked, 10, exclude_self=True).hits.collect()]
    want = [(q, d, r) for q in range(200) for r, d in enumerate(np.lexsort((np.arange(200), -np.round(cosine[q], 9)))[:10], 1)]
    assert sorted(exact) == sorted(want)
