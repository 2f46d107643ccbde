import random

from tokenizers import Tokenizer, models, pre_tokenizers

from corvane.llm import tokens
from corvane.llm.queries import QUERIES
from tests.llm import cases


def reference(vocabulary):
    """The public unigram tokenizer over the same pieces."""
    made = Tokenizer(models.Unigram(list(vocabulary.pieces), unk_id=0, byte_fallback=True))
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokens.MARK, prepend_scheme="always", split=True)
    return lambda text: len(made.encode(text or "", add_special_tokens=False).ids)


def test_small_vocabularies_with_ties():
    rng = random.Random(1)
    for _ in range(600):
        pieces = {"<unk>": 0.0}
        for _ in range(rng.randrange(3, 25)):
            piece = "".join(rng.choice("abc▁") for _ in range(rng.randrange(1, 5)))
            pieces[piece] = -float(rng.choice([1, 2, 3, 0.5, 1.25, rng.random()]))
        vocabulary = tokens.Vocabulary(tuple(pieces.items()))
        counter, wanted = tokens.Counter(vocabulary), reference(vocabulary)
        for _ in range(10):
            text = "".join(rng.choice("abcd \n") for _ in range(rng.randrange(15)))
            assert counter.of_text(text) == wanted(text), (pieces, text)


def test_odd_documents(spark):
    vocabulary = tokens.read_vocabulary(tokens.VOCABULARY)
    wanted = reference(vocabulary)
    rows = tokens.with_counts(cases.documents(spark, extra=True), vocabulary, out="n").collect()
    assert len(rows) == len(cases.odd_documents())
    assert all(r.n == wanted(r.text) for r in rows)
    assert tokens.with_counts(cases.documents(spark, []), vocabulary).collect() == []


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 3)
    vocabulary = tokens.read_vocabulary(tokens.VOCABULARY)
    text = cases.prose(1, 200) + "\n\nÉé 漢字 <0x41>"
    assert tokens.Counter(vocabulary).of_text(text) == reference(vocabulary)(text)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    wanted = reference(tokens.read_vocabulary(tokens.VOCABULARY))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in QUERIES["op5_token_counts"](spark, sf).collect()}
    assert got == {i: wanted(t) for i, t in texts.items()}
