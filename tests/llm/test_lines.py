import random

import numpy as np
import pyarrow as pa

from corvane.llm import lines
from corvane.llm.queries import QUERIES
from tests.llm import cases


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_odd_documents(spark):
    rows = [r for r in cases.odd_documents() if r[0] is not None][:18]
    docs = cases.documents(spark, rows, extra=True)
    done = lines.dedup_lines(docs)
    assert done.columns == docs.columns
    assert texts_of(done) == cases.deduplicated([(r[0], r[1]) for r in rows])


def test_repeated_rows_and_null_ids(spark):
    docs = cases.documents(spark)
    done = lines.dedup_lines(docs, count_col="n").collect()
    assert len(done) == len(cases.odd_documents())
    first = [r for r in done if r.doc_id == 0]
    assert len(first) == 3 and all(r.text == cases.odd_documents()[0][1] and r.n == 0 for r in first)
    assert sorted(str(r.text) for r in done if r.doc_id is None) == ["", "None"]  # null ids come last


def test_random_lines_as_brute_force(spark):
    rng = random.Random(5)
    pool = [cases.prose(100 + i, rng.randrange(1, 40), 30) for i in range(40)]

    def changed(line):
        w = line.split()
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(50)}"
        return " ".join(w)

    rows = [(i, "\n".join(changed(rng.choice(pool)) for _ in range(rng.randrange(1, 6))), None, None, 0) for i in range(150)]
    assert texts_of(lines.dedup_lines(cases.documents(spark, rows))) == cases.deduplicated([r[:2] for r in rows])


def test_emptied_documents_go_if_asked(spark):
    text = cases.prose(1, 30)
    rows = [(1, text, None, None, 0), (2, text + "\n", None, None, 0), (3, "\n", None, None, 0), (4, None, None, None, 0)]
    done = lines.dedup_lines(cases.documents(spark, rows), drop_emptied=True)
    assert texts_of(done) == {1: text, 3: "\n", 4: None}


def test_empty(spark):
    assert lines.dedup_lines(cases.documents(spark, [])).collect() == []


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = QUERIES["op9_line_dedup"](spark, "/root/testdata/sf0.001")
    assert texts_of(got) == cases.deduplicated([(r.doc_id, r.text) for r in rows])


def test_shared_rows_over_any_batches():
    rng = random.Random(2)
    names = ["shingle", "class", "n", "at", "odd"]
    for _ in range(300):
        rows = sorted((rng.randrange(6), rng.randrange(4)) for _ in range(rng.randrange(30)))
        per = {s: {c for t, c in rows if t == s} for s, _ in rows}
        wanted = sorted({(s, c) for s, c in rows if len(per[s]) > 1})
        batches, i = [], 0
        while i < len(rows):
            j = i + rng.randrange(1, 5)
            cols = [pa.array([r[k] for r in rows[i:j]], pa.int64()) for k in (0, 1, 1, 1, 1)]
            batches.append(pa.RecordBatch.from_arrays(cols, names))
            i = j
        got = [(s, c) for b in lines.shared_rows(iter(batches)) for s, c in zip(b[0].to_pylist(), b[1].to_pylist())]
        assert got == wanted


def packed_rows(rng, n):
    """(shingle, class, n, at, odd) of n prefix rows; a class has one size."""
    rows = []
    for _ in range(n):
        own = rng.randrange(1, 9)
        rows.append((rng.randrange(12) << 32 | rng.randrange(2), own, 40 + 10 * own, rng.randrange(5), (own << 40) + own))
    return rows


def test_packed_rows_come_back():
    rng = random.Random(3)
    rows = [(rng.randrange(-1 << 63, 1 << 63), rng.randrange(-1 << 63, 1 << 63), rng.randrange(1, 300), rng.randrange(60),
             rng.randrange(-1 << 63, 1 << 63)) for _ in range(500)]
    batch = lines.packed([tuple(np.array(c, np.int64) for c in zip(*part)) for part in (rows[:200], rows[200:])], 64)
    got = sorted(r for part in lines.unpacked(batch) for r in zip(*(c.tolist() for c in part)))
    low = lines.LOW

    def known(shingle, own, n, at, odd):
        odd = odd if n > lines.LONG else (odd ^ odd >> 32) & low
        return (shingle >> 32 & 63) << 32 | shingle & low, own, n, at, odd

    assert batch.num_rows <= 64 and got == sorted(known(*r) for r in rows)


def test_packed_rows_that_meet(monkeypatch):
    rng = random.Random(4)
    for at_once in (1 << 21, 1, 7):  # all rows together, or few at a time
        monkeypatch.setattr(lines, "AT_ONCE", at_once)
        for _ in range(50):
            rows = packed_rows(rng, rng.randrange(1, 40))
            parts = [rows[i:i + 6] for i in range(0, len(rows), 6)]
            batches = [lines.packed([tuple(np.array(c, np.int64) for c in zip(*p))], 64) for p in parts]
            got = {(s, c) for b in lines.shared_packed(iter(batches)) for s, c in zip(b[0].to_pylist(), b[1].to_pylist())}
            per = {s: {c for t, c, *_ in rows if t == s} for s, *_ in rows}
            met = {(s, c) for s, c, *_ in rows if len(per[s]) > 1}
            assert got == met if at_once == 1 << 21 and not any(r[3] > r[2] // 9 for r in rows) else got <= met
            if at_once < 1 << 21:
                assert got == met


def test_lines_of_many_words_as_brute_force(spark):
    rng = random.Random(8)
    pool = [cases.prose(300 + i, rng.randrange(30, 140), 60).split() for i in range(12)]

    def changed(w):
        w = list(w)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(9)}"
        return " ".join(w[:len(w) - rng.randrange(0, 8)])

    rows = [(i, "\n".join(changed(rng.choice(pool)) for _ in range(3)), None, None, 0) for i in range(60)]
    assert texts_of(lines.dedup_lines(cases.documents(spark, rows))) == cases.deduplicated([r[:2] for r in rows])


def test_texts_are_split_once(spark):
    plan = lines.dedup_lines(cases.documents(spark))._jdf.queryExecution().optimizedPlan().toString()
    lambdas = [part.split("lambdafunction(")[1] for part in plan.splitlines() if "lambdafunction(" in part]
    assert lambdas and not any("split(" in x for x in lambdas)
