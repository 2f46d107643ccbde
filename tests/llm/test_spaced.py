from itertools import combinations

import numpy as np

from corvane.llm import spaced
from corvane.llm.queries import QUERIES
from tests.llm import cases

ITEMS = "item_id long, text string, label string"


def shared_items(text, items):
    """The items with a stretch of aligned tokens that agrees in four fifths, by trying every alignment."""
    t, out = spaced.tokens(text), set()
    for item, q in items:
        n = min(spaced.WINDOW, len(q))
        if len(q) < spaced.LEAST:
            continue
        for shift in range(-len(q) + n, len(t) - n + 1):
            a, b = max(0, -shift), min(len(q), len(t) - shift)
            same = q[a:b] == t[a + shift:b + shift]
            if b - a >= n and np.convolve(same, np.ones(n, int), "valid").max() >= n - spaced.allowed(n):
                out.add(item)
                break
    return out


def found(spark, docs, items):
    keyed = {r.key: r.doc_id for r in docs.select("doc_id", spaced.row_key("doc_id", "text").alias("key")).collect()}
    out = {}
    for r in spaced.overlaps(docs, items).collect():
        out.setdefault(keyed[r.key], set()).add(r.item)
    return out


def test_masks_meet_every_stretch():
    for n in range(spaced.SHORT, spaced.WINDOW + 1):
        for differ in combinations(range(n), spaced.allowed(n)):
            assert any(all(s + p not in differ for p in m) for m in spaced.MASKS for s in range(n - m[-1]))


def test_parts_of_short_items_leave_one_whole():
    for n in range(spaced.LEAST, spaced.SHORT):
        for differ in combinations(range(n), spaced.allowed(n)):
            assert any(all(s + p not in differ for p in m) for s, m in spaced.parts(n))


def test_changed_passages_as_brute_force(spark):
    items = [(i, cases.prose(900 + i, 6 + 3 * i), "x") for i in range(12)] + [(50, None, "x"), (51, "", "x"), (52, "w1 w2", "x")]
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        w = items[i % 12][1].split()
        cut = w[:rng.integers(3, len(w) + 1)] if i % 3 else w
        for _ in range(rng.integers(0, len(cut) // 4 + 1)):
            cut[rng.integers(len(cut))] = "other"
        rows.append((i, cases.prose(i, 15) + " " + " ".join(cut) + ", " + cases.prose(i + 500, 10), None, None, 0))
    docs = cases.documents(spark, rows)
    hashed = [(i, spaced.tokens(t)) for i, t, _ in items]
    wanted = {r[0]: s for r in rows if (s := shared_items(r[1], hashed))}
    assert 20 < len(wanted) < 150
    assert found(spark, docs, spark.createDataFrame(items, ITEMS)) == wanted


def test_odd_documents(spark):
    docs = cases.documents(spark, extra=True)
    items = spark.createDataFrame([(1, cases.odd_documents()[0][1], "x"), (1, cases.odd_documents()[0][1], "x"), (None, None, "x")], ITEMS)
    kept = spaced.decontaminate(docs, items)
    assert kept.columns == docs.columns
    gone = {r[1] for r in cases.odd_documents() if r[1] and r[1].lower().split()[1:] == cases.odd_documents()[0][1].split()[1:]}
    assert sorted(map(str, (r.text for r in kept.collect()))) == sorted(str(r[1]) for r in cases.odd_documents() if r[1] not in gone)


def test_empty(spark):
    none = spark.createDataFrame([], ITEMS)
    assert spaced.overlaps(cases.documents(spark, []), none).collect() == []
    assert spaced.decontaminate(cases.documents(spark), none).count() == len(cases.odd_documents())


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    items = [(r.item_id, spaced.tokens(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r["items"] for r in QUERIES["op4_spaced_seed_decontamination"](spark, sf).collect()}
    assert got == {i: ",".join(map(str, sorted(shared_items(t, items)))) for i, t in texts.items()}
