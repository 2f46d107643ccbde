import hashlib
from collections import Counter

import numpy as np
import pytest

from corvane.llm import superkmers
from corvane.llm.queries import QUERIES
from tests.llm import cases


def brute(texts, window):
    """(kept words, words, removed words) of each text."""
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((b" ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return out


def check(spark, rows, window, extra=False):
    docs = cases.documents(spark, rows, extra)
    done = superkmers.remove_repeats(docs, window=window)
    assert done.columns[:len(docs.columns)] == docs.columns
    kept, total, gone = done.columns[-3:]
    told = sorted(str((r.doc_id, r.text, r[kept], r[total], r[gone])) for r in done.collect())
    wanted = [(r[0], r[1], None if r[1] is None else k.decode(), n, g) for r, (k, n, g) in zip(rows, brute([r[1] for r in rows], window))]
    assert told == sorted(map(str, wanted))
    return wanted


def corpus(seed, n=60):
    """Texts that share passages of many lengths, copies, and texts that repeat themselves."""
    rng = np.random.default_rng(seed)
    passages = [cases.prose(1000 + i, int(rng.integers(5, 120)), 60) for i in range(6)]
    texts = []
    for i in range(n):
        parts = [cases.prose(i, int(rng.integers(0, 60)), 60)]
        for _ in range(rng.integers(0, 4)):
            parts += [passages[rng.integers(0, 6)], cases.prose(5000 + i, int(rng.integers(0, 30)), 60)]
        texts.append("\n ".join(parts))
    texts += [texts[0], texts[3], "a b " * 200, "z " * 90, "z " * 34, "z " * 35, " ".join(passages[1].split()[:20]), passages[1].upper()]
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("window", [5, 12, 35])
def test_as_brute_force(spark, window):
    assert any(g for *_, g in check(spark, corpus(window), window))


def test_odd_documents(spark):
    check(spark, cases.odd_documents(), 35, extra=True)
    check(spark, cases.odd_documents(), 5)


def test_empty(spark):
    assert superkmers.remove_repeats(cases.documents(spark, [])).collect() == []


def test_common_passages_and_small_flushes(spark, monkeypatch):
    """A third of the rows hold one passage; groups, segments and gathered strings are so small that all are cut."""
    monkeypatch.setattr(superkmers, "GROUP", 50)
    passage = cases.prose(9, 70)
    rows = corpus(4) + [(100 + i, f"{cases.prose(300 + i, 20)} {passage} {cases.prose(900 + i, 20)}", "en", "s", 1) for i in range(40)]
    check(spark, rows, 12)
    monkeypatch.setattr(superkmers, "FILTER_BYTES", 0)  # beyond the filter's bound all texts join
    check(spark, rows, 12)


def test_long_texts_in_segments_and_cut_strings(monkeypatch):
    monkeypatch.setattr(superkmers, "SEGMENT", 64)
    texts = [cases.prose(1, 500).encode(), b"", b"q " * 300, cases.prose(1, 90).encode()]
    words = superkmers.Words(texts)
    for window in (5, 35):
        starts = []
        for text, start, n, _ in superkmers.super_kmers(words, window, np.empty(0, np.uint64)):
            assert (n <= superkmers.PIECE).all()
            starts += [(int(t), i) for t, s, m in zip(text, start, n) for i in range(s, s + m)]
        bounds = words.bounds
        assert starts == [(t, i) for t in range(4) for i in range(bounds[t], bounds[t + 1] - window + 1)]


def test_common_runs_come_last():
    words = superkmers.Words([cases.prose(2, 200).encode()])
    _, _, _, least = next(superkmers.super_kmers(words, 35, np.empty(0, np.uint64)))
    common = np.unique(least)[:1]
    _, _, n, again = next(superkmers.super_kmers(words, 35, common))
    assert common[0] not in again and n.sum() == 200 - 35 + 1


def test_equal_hash_other_second_hash():
    first, second = np.array([5, 5, 5, 7], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    assert superkmers.repeated(first, second).tolist() == [True, False, True, False]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    wanted = {i: (n, g, hashlib.sha256(k).hexdigest()) for (i, _), (k, n, g) in zip(rows, brute([t for _, t in rows], 35))}
    told = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op12_substring_dedup"](spark, sf).collect()}
    assert told == wanted and any(g for _, g, _ in wanted.values())
