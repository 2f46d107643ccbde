import numpy as np

from corvane.llm import negatives

SCHEMA = "id long, vector array<long>, label int, vec string, share int, rank string"


def brute(rows, every=50, positives=5, k=3, least=50, most=95):
    """rows are distinct (id, vector, label)."""
    def usable(i, v, label):
        return i is not None and v and label is not None and all(x is not None for x in v)

    rows = [r for r in {(i, tuple(v) if v is not None else None, label) for i, v, label in rows} if usable(*r)]
    out = []
    for anchor, u, label in rows:
        if anchor % every:
            continue
        scored = [(-sum(x * y for x, y in zip(u, v)), i, other == label) for i, v, other in rows if i != anchor and len(v) == len(u)]
        same = sorted(x[:2] for x in scored if x[2])[:positives]
        for p, positive in ((-s, i) for s, i in same):
            fit = sorted((s, i) for s, i, alike in scored if not alike and least * p <= -100 * s <= most * p)[:k]
            out += [(anchor, positive, rank, i, p, -s) for rank, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "x") for r in rows], SCHEMA).repartition(4)


def told(df):
    return sorted(tuple(r) for r in df.collect())


def clusters(seed, n, d=12, labels=4, spread=0.5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, d))
    own = rng.integers(0, 6, n)
    v = np.floor(256 * (centres[own] + spread * rng.standard_normal((n, d)))).astype(int)
    label = np.where(rng.random(n) < 0.6, own % labels, rng.integers(0, labels, n))
    return [(int(i), v[i].tolist(), int(label[i])) for i in range(n)]


def test_as_all_pairs(spark):
    rows = clusters(1, 700)
    wanted = brute(rows, every=10)
    assert told(negatives.hard_negatives(frame(spark, rows), every=10)) == wanted and len(wanted) > 500


def test_groups_shares_and_short_stretches(spark, monkeypatch):
    for name, value in (("ANCHORS", 9), ("CANDIDATES", 60), ("PER_CLUSTER", 5)):
        monkeypatch.setattr(negatives, name, value)
    rows = clusters(2, 400)
    assert told(negatives.hard_negatives(frame(spark, rows), every=10)) == brute(rows, every=10)


def test_ties_and_a_vector_that_a_third_of_the_rows_have(spark):
    rows = clusters(3, 300, d=3)
    rows = [(i, [100, 50, 20] if i % 3 == 0 else v, label if i % 9 else 1) for i, v, label in rows] + [(1000 + i, [90, 50, 20], 2) for i in range(20)]
    assert told(negatives.hard_negatives(frame(spark, rows), every=5)) == brute(rows, every=5)


def test_odd_rows(spark):
    a, b = [10, 20, 30], [9, 18, 25]
    rows = [(0, a, 0), (0, a, 0), (0, b, 1), (1, b, 0), (1, b, 0), (2, b, 1), (3, a, None), (None, a, 0), (50, None, 0), (50, [], 0), (50, [1, None, 2], 0),
            (100, [0, 0, 0], 0), (4, [0, 0, 0], 1), (150, [-5, -5, -5], 3), (5, [1, 1, 1], 3), (6, [1 << 24, 1 << 25, -(1 << 24)], 0),
            (200, [1 << 26, 1 << 25, 0], 5), (7, [1 << 26, 1 << 25, 1], 5), (8, [1 << 25, 1 << 25, 7], 6), (250, [1, 2], 0), (9, [1, 2], 0), (10, [1, 1], 4),
            (300, [1 << 40, 3], 1)]
    assert told(negatives.hard_negatives(frame(spark, rows))) == brute(rows)
    assert negatives.hard_negatives(frame(spark, [])).collect() == []


def test_walks_end_early_and_keep_the_best():
    rng = np.random.default_rng(5)
    theirs = np.floor(256 * rng.standard_normal((20_000, 8)) * rng.random((20_000, 1)) ** 3).astype(np.int64)
    members = np.floor(256 * (np.ones(8) + 0.1 * rng.standard_normal((30, 8)))).astype(np.int64)
    ids, their_ids = np.arange(30) + 10**6, np.arange(20_000)
    low, high = np.full(30, negatives.LOWEST + 1), np.full(30, -negatives.LOWEST)
    centre = negatives.unit(members.sum(axis=0, keepdims=True).astype(float))[0]
    found, work = negatives.walked(members, ids, low, high, centre, theirs, their_ids, 5)
    scores = members @ theirs.T
    wanted = [[int(x) for x in np.lexsort((their_ids, -s))[:5]] for s in scores]
    assert [[int(i) for w, _, i in found if w == m] for m in range(30)] == wanted
    assert work < 0.5 * scores.size
