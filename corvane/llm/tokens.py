"""Token counts of a unigram tokenizer, without its tokens.

A text becomes words as the "metaspace" rule has it: each space turns into the mark that starts a word, and a text
that starts without one gets it. An Aho-Corasick automaton over the vocabulary finds all pieces in a word; going over
the places where pieces end, dynamic programming keeps the best score up to each place and the number of pieces on
that path. The rules are those of the public unigram implementation: a place keeps the path found first, and paths
come in the order of where their last piece starts, so that of equal scores the longer piece wins; a character without
a piece of its own may be taken as unknown at the lowest score less 10; unknown characters count their UTF-8 bytes if
the vocabulary has pieces for them, else a run of them counts one. Scores are added in double precision.

Words recur, so a task remembers the counts of up to ``MEMORY`` words. Where every score is a whole number and no piece
holds a line feed, the sum is exact in any order, and words are cut at line feeds first.

There is no unigram vocabulary among the public files here: the query reads the pieces and scores of the 32k piece
model (a merge list whose scores are negative ranks) as one. Any list of (piece, score) will do.

Defined results: null and empty texts have 0 tokens; repeated rows are counted alike; a text without spaces is one word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"  # a parameter of read_vocabulary
MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value
MEMORY = 400_000


@dataclass(frozen=True)
class Vocabulary:
    """The pieces with their scores, in the order of their ids."""

    pieces: tuple[tuple[str, float], ...]


def read_vocabulary(path: str) -> Vocabulary:
    """The pieces of a sentencepiece model file; read on the driver, as large as the vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Vocabulary(tuple((model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())))


def words_of(text: str) -> list[str]:
    marked = text.replace(" ", MARK)
    return [MARK + w for w in (marked if marked.startswith(MARK) else MARK + marked).split(MARK)[1:]] if text else []


class Counter(dict):
    """word -> number of its tokens, filled as words are met."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        super().__init__()
        scores = dict(vocabulary.pieces)
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        self.bytes = {i for i in range(256) if f"<0x{i:02X}>" in scores}
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        whole = all(s == math.floor(s) and abs(s) < 1 << 30 for s in scores.values())
        self.by_lines = whole and len(self.bytes) == 256 and not any("\n" in p for p in scores)

    def __missing__(self, word: str) -> int:
        count = self.count(word)
        if len(self) >= MEMORY:
            self.clear()
        self[word] = count
        return count

    def unknown_tokens(self, part: str) -> int:
        raw = part.encode("utf-8", "surrogatepass")
        return len(raw) if self.bytes.issuperset(raw) else 1

    def count(self, word: str) -> int:
        """The number of tokens on the best path through one word."""
        n = len(word)
        best, pieces, since = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)  # since: where a run of unknowns began
        done = 0
        alone = False  # whether the character before place ``done`` is a piece

        def close(end: int) -> None:
            """The unknown path to ``end``, last of those that end there."""
            if not alone:
                score = best[end - 1] + self.unknown
                if score > best[end] or pieces[end] == 0:
                    start = since[end - 1] if since[end - 1] >= 0 else end - 1
                    before = pieces[start]
                    best[end], pieces[end], since[end] = score, before + self.unknown_tokens(word[start:end]), start

        for last, (length, score) in self.automaton.iter(word):
            end = last + 1
            while done + 1 < end:
                done += 1
                close(done)
                alone = False
            start = end - length
            score += best[start]
            if pieces[end] == 0 or score > best[end]:  # pieces of one end come longest first
                best[end], pieces[end], since[end] = score, pieces[start] + 1, -1
            if length == 1:
                alone = True
        while done < n:
            done += 1
            close(done)
            alone = False
        return pieces[n]

    def of_text(self, text: str | None) -> int:
        words = words_of(text or "")
        if not self.by_lines:
            return sum(map(self.__getitem__, words))
        total = 0
        for word in words:
            if "\n" in word:
                parts = word.split("\n")
                total += len(parts) - 1 + sum(self[p] for p in parts if p)
            else:
                total += self[word]
        return total


def token_count(text: Column, vocabulary: Vocabulary) -> Column:
    @F.pandas_udf("long")
    def of(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(vocabulary)
        for texts in series:
            yield pd.Series([counter.of_text(t) for t in texts], dtype="int64")

    return of(text)


def with_counts(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of ``text_col`` in column ``out``."""
    return docs.withColumn(out, token_count(F.col(text_col), vocabulary))
