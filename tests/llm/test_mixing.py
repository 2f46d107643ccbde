import re
from collections import defaultdict

import pytest

from corvane.llm import mixing
from corvane.llm.queries import QUERIES
from tests.llm import cases


def water(sizes, weights=mixing.WEIGHTS, share=1.5, most=2):
    """Targets by resharing until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, goal = {}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        rest = goal - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if target[s] >= most * sizes[s]}
        if not over:
            return target
        full |= over
        if len(full) == len(names):
            return {s: most * sizes[s] for s in names}


def seats(weights, n):
    """Sainte-Lague, one seat at a time."""
    won = [0] * len(weights)
    for _ in range(n):
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


@pytest.mark.parametrize("weights, n", [((5.0, 3.0, 1.0), 7), ((1.0,) * 6, 4), ((1000.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), 60),
                                        ((0.0, 2.0), 3), ((7.0,), 12), ((3.0, 3.0, 3.0), 0), ((53.0, 24.0, 23.0), 100),
                                        (tuple(float(i) for i in range(1, 40)), 333)])
def test_seats_are_those_of_highest_quotients(spark, weights, n):
    rows = [(g, i, w, n) for g in ("a", "b") for i, w in enumerate(weights)]
    parties = spark.createDataFrame(rows, "g string, i long, w double, n long")
    from pyspark.sql import functions as F
    won = mixing.apportion(parties, ["g"], "w", "n", [F.col("i")], "won").collect()
    for g in ("a", "b"):
        assert [r.won for r in sorted((r for r in won if r.g == g), key=lambda r: r.i)] == seats(weights, n)


def check(rows, texts_and_sources):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for text, source in texts_and_sources:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(rows) == len(texts_and_sources)
    for source, t in water(sizes).items():
        assert target[source] == pytest.approx(t) and abs(taken[source] - t) <= max(3, 0.003 * t)


def test_odd_documents(spark):
    docs = cases.documents(spark, extra=True)
    rows = mixing.mix(docs).collect()
    check(rows, [(r[1], r[3]) for r in cases.odd_documents()])
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_many_shards_and_one_large_source(spark):
    rows = [(i, cases.prose(i, 1 + i % 90), None, "hot" if i % 3 == 0 else f"s{i % 11}", 0) for i in range(900)]
    check(mixing.mix(cases.documents(spark, rows), shard_words=500).collect(), [(r[1], r[3]) for r in rows])


def test_empty(spark):
    assert mixing.mix(cases.documents(spark, [])).collect() == []
    nothing = mixing.mix(cases.documents(spark, [(1, None, None, "a", 0), (2, "", None, None, 0)])).collect()
    assert [(r["size"], r.taken) for r in nothing] == [(0, 0), (0, 0)]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(QUERIES["op6_source_mixing"](spark, sf).collect(), docs)


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op6_source_mixing"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
