import math

import numpy as np

from corvane.llm import pstable
from corvane.llm.queries import QUERIES
from tests.llm import cases

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, bucket int, n_links string"


def brute(rows, threshold=0.93):
    """(id, links, component) by all pairs; rows are (id, vector, label)."""
    def usable(v, label):
        return v is not None and label is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if usable(v, label) else None for _, v, label in rows]

    def linked(i, j):
        a, b = unit[i], unit[j]
        return a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= threshold

    roots = cases.components(len(rows), linked)
    least = {}
    for r, (i, *_) in zip(roots, rows):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    links = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    return sorted(str((row[0], int(n), least.get(r))) for row, n, r in zip(rows, links, roots))


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "x") for r in rows], SCHEMA).repartition(4)


def told(df):
    rows = df.collect()
    assert all(r.kept == (r.id == r.component_id) for r in rows)
    return sorted(str((r.id, r.n_links, r.component_id)) for r in rows)


def clusters(seed, centres, most, spread):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(centres):
        centre = rng.standard_normal(24)
        for _ in range(rng.integers(1, most)):
            v = centre / np.linalg.norm(centre) + rng.standard_normal(24) * spread * rng.random()
            out.append((len(out), (v * rng.choice([1.0, 3.0])).astype(np.float32).tolist(), int(c % 3)))
    return out


def test_links_and_components_as_all_pairs(spark):
    rows = clusters(4, 40, 12, 0.09)
    rows += [(1000 + i, v, label) for i, (_, v, label) in enumerate(rows[:30])]  # exact copies
    assert told(pstable.near_duplicates(vectors(spark, rows))) == brute(rows)


def test_blocks_of_large_buckets(spark):
    rows = clusters(5, 4, 130, 0.05)
    assert told(pstable.near_duplicates(vectors(spark, rows), block=20)) == brute(rows)


def test_odd_vectors(spark):
    a = [1.0, 2.0, 3.0]
    rows = [(1, a, 0), (2, a, 0), (2, a, 0), (3, a, 1), (4, a, None), (5, None, 0), (6, [], 0), (7, [0.0, -0.0, 0.0], 0),
            (8, [1.0, None, 3.0], 0), (9, [1.0, float("nan"), 3.0], 0), (10, [1.0, float("inf"), 3.0], 0), (None, a, 0),
            (None, [3.0, 0.0, 0.0], 0), (11, [1e30, 2e30, 3e30], 0), (12, [1.0, 2.0], 0), (13, [1.0, 2.0, 3.1], 0)]
    assert told(pstable.near_duplicates(vectors(spark, rows))) == brute(rows)


def test_empty(spark):
    assert pstable.near_duplicates(vectors(spark, [])).collect() == []


def test_found_at_the_threshold_itself(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        a, b = rng.standard_normal(64), rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, (0.931 * a + math.sqrt(1 - 0.931**2) * b).tolist(), 0)]
    found = pstable.near_duplicates(vectors(spark, rows)).where("n_links = 1").count()
    assert found >= 0.99 * len(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert told(QUERIES["op8_embedding_near_dedup"](spark, sf).withColumnRenamed("vec_id", "id")) == brute(rows)
