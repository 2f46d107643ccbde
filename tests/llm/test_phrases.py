import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corvane.llm import phrases
from tests.llm import cases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", low) if (w := re.findall(r"[^\x20\x09]+", p))]


def counted(rows, depth):
    """Occurrences by (language, words)."""
    f = Counter()
    for lang, text in rows:
        for w in pieces(text):
            for n in range(1, depth + 1):
                f.update((lang or "und", tuple(w[i:i + n])) for i in range(len(w) - n + 1))
    return f


def brute(rows, depth=3, least=10, inside=50, k=2000):
    f = counted(rows, depth)
    total = Counter()
    for (lang, w), n in f.items():
        total[lang] += n * (len(w) == 1)
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    dropped = {(lang, w[i:i + n]) for (lang, w), long in candidates.items() for n in range(2, len(w)) for i in range(len(w) - n + 1)
               if 100 * long >= inside * f[lang, w[i:i + n]]}
    found = defaultdict(list)
    for (lang, w), a in candidates.items():
        if (lang, w) in dropped:
            continue
        score, _, l, r = min((1_000_000 * a * a // (f[lang, w[:c]] * f[lang, w[c:]]), c, f[lang, w[:c]], f[lang, w[c:]]) for c in range(1, len(w)))
        found[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, total[lang], -s) for lang, rows in found.items()
                  for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:k], 1))


def told(docs, least, k, **options):
    counts = phrases.phrase_counts(docs, least=least, **options)
    return sorted(tuple(r[c] for c in COLUMNS) for r in phrases.collocations(counts, k=k).collect())


def corpus(seed, n=80):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.integers(0, 30)):
            text += [f"W{rng.integers(0, 12)}" for _ in range(rng.integers(0, 9))] + [str(rng.choice([",", ". ", "\n", " New York City ", " à B\t", "!x"]))]
        rows.append(((None, "en", "de", "en", "und")[i % 5], " ".join(text)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(l, t, "p", "s", 1, 1) for l, t in rows],
                                 "lang string, text string, phrase string, first string, length int, n long").repartition(4)


@pytest.mark.parametrize("shard", [phrases.SHARD, 40])
def test_as_brute_force(spark, shard):
    rows = corpus(3)
    for least, k in ((10, 2000), (2, 7)):
        wanted = brute(rows, least=least, k=k)
        assert told(frame(spark, rows), least, k, shard_words=shard) == wanted and wanted


def test_longer_phrases(spark):
    rows = corpus(5, 30)
    assert told(frame(spark, rows), 3, 2000, depth=5, shard_words=100) == brute(rows, 5, 3)


def test_odd_documents(spark):
    docs = cases.documents(spark, extra=True)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert told(docs, 2, 2000) == brute(rows, least=2)
    assert told(cases.documents(spark, []), 2, 2000) == []


def test_index_holds_every_phrase_in_both_directions():
    rng = np.random.default_rng(1)
    text = np.append(0, rng.integers(0, 6, 400))
    text[-1] = 0
    follow, precede = (sorted(range(len(text)), key=lambda i: [text[(i + s * k) % len(text)] for k in range(4)]) for s in (1, -1))
    for length, level in enumerate(phrases.enumerate_phrases(text, 4), 1):
        wanted = Counter(tuple(text[i:i + length]) for i in range(len(text) - length + 1) if (text[i:i + length] > 0).all())
        assert {tuple(w): n for w, n in zip(level.words, level.n)} == wanted
        for w, f, p, n in zip(level.words, level.follow, level.precede, level.n):
            assert all((text[i:i + length] == w).all() for i in follow[f:f + n])
            assert all((text[i - length + 1:i + 1] == w).all() for i in precede[p:p + n])


def test_many_symbols_are_sorted_alike(monkeypatch):
    symbols = [np.random.default_rng(s).integers(0, 1 << 40, 500) % 7 for s in range(3)]
    order = phrases.sequence_order(symbols)
    symbols[0][0] += 1 << 40
    again = phrases.sequence_order(symbols)
    rows = np.column_stack(symbols)
    assert sorted(map(tuple, rows)) == [tuple(r) for r in rows[again]] and len(order) == 500
