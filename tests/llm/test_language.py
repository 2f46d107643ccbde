import numpy as np

from corvane.llm import language
from corvane.llm.queries import QUERIES
from tests.llm import cases


def bundle(text, dimensions):
    """One trigram at a time."""
    grams, out = language.Grams(dimensions), np.zeros(dimensions)
    codes = [ord(c) if c.isalpha() else 0 for c in f" {text.lower()} "]
    codes = [c for i, c in enumerate(codes) if c or i == 0 or codes[i - 1]]
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if b:
            out += np.roll(grams.letter(a), 2).astype(int) * np.roll(grams.letter(b), 1) * grams.letter(c)
    return out


def test_bundles_are_sums_of_bound_trigrams(monkeypatch):
    texts = ["Hello, World", "", "123", "É漢 ab", cases.prose(1, 50) + " abc déf", "".join(map(chr, range(0x4E00, 0x4F80)))]
    for known, at_once in ((40_000, 4096), (50, 7)):
        monkeypatch.setattr(language, "KNOWN", known)
        monkeypatch.setattr(language, "GRAMS_AT_ONCE", at_once)
        got = language.bundles(np.arange(len(texts)), len(texts), texts, language.Grams(64))
        np.testing.assert_array_equal(got, [bundle(t, 64) for t in texts])
        both = language.bundles(np.array([0, 1, 0, 1, 0, 1]), 2, texts, language.Grams(64))
        np.testing.assert_array_equal(both, [got[::2].sum(axis=0), got[1::2].sum(axis=0)])


def test_odd_documents(spark):
    docs = cases.documents(spark, extra=True)
    learned = language.prototypes(docs, "text", "lang", 64)
    wanted = {}
    for _, text, lang, *_ in cases.odd_documents():
        if lang and text:
            wanted[lang] = wanted.get(lang, 0) + bundle(text, 64)
    assert list(learned) == sorted(wanted)
    for lang, row in learned.items():
        np.testing.assert_array_equal(row, wanted[lang])
    rows = language.identify(docs, learned, out="told").collect()
    assert len(rows) == len(cases.odd_documents())
    for r in rows:
        row = bundle(r.text or "", 64)
        if not row.any():
            assert (r.told.lang, r.told.score) == ("und", 0.0)
            continue
        cosines = {k: row @ p / np.linalg.norm(row) / np.linalg.norm(p) for k, p in learned.items()}
        best = max(cosines.values())
        assert abs(cosines[r.told.lang] - best) < 1e-9 and abs(r.told.score - min(1, max(0, best))) < 1e-6


def test_nothing_learned_and_empty(spark):
    docs = cases.documents(spark)
    assert language.prototypes(cases.documents(spark, []), "text", "lang") == {}
    assert {(r.told.lang, r.told.score) for r in language.identify(docs, {}, out="told").collect()} == {("und", 0.0)}
    assert language.identify(cases.documents(spark, []), {}).collect() == []


def test_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_language_profiles"](spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and 100 < len(held) < 300
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held)
