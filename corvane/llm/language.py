"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point alone. A letter trigram is bound from its
letters' vectors, the first rotated twice and the second once, by multiplying them; the space around a word counts as a
letter. A text's vector is the sum (bundle) of its trigrams' vectors, a language's prototype that of all its training
texts, and a text is given the language whose prototype has the greatest cosine.

Both passes read whole texts, every one of them. A task counts the trigrams of some texts at a time and multiplies the
counts with the trigrams' vectors; in training, it sends one vector per language.

Defined results: null texts and texts without a letter are "und" with score 0, as is every text if nothing was
learned; rows with a null language teach nothing; of equal cosines the language first in code point order wins;
negative cosines score 0; repeated rows are judged alike and teach as often as they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
SEED = 42
CHARACTERS_AT_ONCE = 1 << 20
GRAMS_AT_ONCE = 4096
KNOWN = 40_000  # trigram vectors that a task remembers
NONE = "und"


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Grams:
    """The vectors of trigrams, given as three code points of 21 bits, 0 being the space."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.of_letter: dict[int, np.ndarray] = {}
        self.keys, self.rows = np.empty(0, np.int64), np.empty((0, dimensions), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.of_letter:
            if len(self.of_letter) >= KNOWN:
                self.of_letter.clear()
            bits = np.random.default_rng([SEED, code]).integers(0, 2, self.dimensions, dtype=np.int8)
            self.of_letter[code] = bits * np.int8(2) - np.int8(1)
        return self.of_letter[code]

    def bound(self, keys: np.ndarray) -> np.ndarray:
        codes = [((keys >> shift) & 0x1FFFFF) for shift in (42, 21, 0)]
        out = np.ones((len(keys), self.dimensions), np.int8)
        for turns, code in zip((2, 1, 0), codes):
            some, at = np.unique(code, return_inverse=True)
            out *= np.stack([np.roll(self.letter(int(c)), turns) for c in some])[at]
        return out

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The vectors of sorted distinct keys."""
        if not len(keys):
            return np.empty((0, self.dimensions), np.int8)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        if known.all():
            return self.rows[at]
        new = keys[~known]
        if len(self.keys) + len(new) > KNOWN:
            self.keys, self.rows = np.empty(0, np.int64), np.empty((0, self.dimensions), np.int8)
            if len(keys) > KNOWN:
                return self.bound(keys)
            new = keys
        allkeys = np.concatenate([self.keys, new])
        order = np.argsort(allkeys)
        self.keys, self.rows = allkeys[order], np.concatenate([self.rows, self.bound(new)])[order]
        return self.rows[np.searchsorted(self.keys, keys)]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, distinct trigram's number, distinct trigrams sorted) for each trigram around a letter."""
    low = [t.lower() for t in texts]
    joined = "\n".join(["", *low, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(low) + 1), [len(t) + 1 for t in low] + [1])  # the newline before a text is its own
    codes[~letters()[codes]] = 0
    keep = (codes != 0) | np.concatenate([[True], codes[:-1] != 0])
    codes, text = codes[keep], text[keep]
    middle = np.flatnonzero(codes[1:-1]) + 1 if len(codes) > 2 else np.empty(0, np.int64)
    used = np.flatnonzero(np.bincount(codes)) if len(codes) else np.empty(0, np.int64)
    m = len(used)
    if m <= 256:  # few letters: number the trigrams by table
        dense = np.zeros(int(used[-1]) + 1 if m else 1, np.int64)
        dense[used] = np.arange(m)
        small = dense[codes]
        number = (small[middle - 1] * m + small[middle]) * m + small[middle + 1]
        there = np.zeros(m ** 3 if m else 1, bool)
        there[number] = True
        some = np.flatnonzero(there)
        place = np.zeros(len(there), np.int32)
        place[some] = np.arange(len(some))
        keys = (used[some // (m * m)] << 42) | (used[some // m % m] << 21) | used[some % m] if m else some
        return text[middle], place[number], keys
    keys, number = np.unique((codes[middle - 1] << 42) | (codes[middle] << 21) | codes[middle + 1], return_inverse=True)
    return text[middle], number, keys


def bundles(groups: np.ndarray, n: int, texts: list[str], grams: Grams) -> np.ndarray:
    """The sums of the trigram vectors of the texts of each group: n rows. ``groups`` has the group of each text."""
    text, number, keys = trigrams(texts)
    out = np.zeros((n, grams.dimensions))
    order = np.argsort(number, kind="stable")
    group, number = groups[text[order]], number[order]
    for lo in range(0, len(keys), GRAMS_AT_ONCE):
        i, j = np.searchsorted(number, (lo, lo + GRAMS_AT_ONCE))
        width = min(GRAMS_AT_ONCE, len(keys) - lo)
        counts = np.bincount(group[i:j] * width + number[i:j] - lo, minlength=n * width).reshape(n, width)
        out += counts.astype(np.float32) @ grams(keys[lo:lo + width]).astype(np.float32)
    return out


def in_parts(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """The texts a few at a time: (number of the first, texts)."""
    start, part, size = 0, [], 0
    for i, text in enumerate(texts):
        part.append(text or "")
        size += len(part[-1])
        if size >= CHARACTERS_AT_ONCE:
            yield start, part
            start, part, size = i + 1, [], 0
    if part:
        yield start, part


# ---- training ------------------------------------------------------------------------------------------------

def prototypes(docs: DataFrame, text_col: str, lang_col: str, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The bundle of each language's texts; as many vectors as there are languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        grams = Grams(dimensions)
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for start, part in in_parts(batch.column(0).to_pylist()):
                here = sorted(set(langs[start:start + len(part)]))
                place = {lang: k for k, lang in enumerate(here)}
                group = np.array([place[lang] for lang in langs[start:start + len(part)]])
                for lang, row in zip(here, bundles(group, len(here), part, grams)):
                    sums[lang] = sums.get(lang, 0) + row
        for lang, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([row], pa.list_(pa.float64()))], ["lang", "sums"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        "lang is not null and text is not null")
    found = (rows.mapInArrow(run, "lang string, sums array<double>").select("lang", F.posexplode("sums").alias("at", "x"))
             .groupBy("lang", "at").agg(F.sum("x").alias("x")).collect())
    out: dict[str, np.ndarray] = {}
    for r in found:
        out.setdefault(r["lang"], np.zeros(dimensions))[r["at"]] = r["x"]
    return {lang: row for lang, row in sorted(out.items()) if row.any()}


# ---- prediction ----------------------------------------------------------------------------------------------

def predicted(text: Column, learned: dict[str, np.ndarray]) -> Column:
    """struct(lang, score)."""
    names = list(learned)
    dimensions = len(next(iter(learned.values()))) if names else 0
    table = np.stack([learned[n] / np.linalg.norm(learned[n]) for n in names]) if names else None

    @F.pandas_udf("lang string, score double")
    def of(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams = Grams(dimensions)
        for texts in series:
            langs, scores = np.full(len(texts), NONE, object), np.zeros(len(texts))
            for start, part in in_parts(texts.tolist()) if names else ():
                rows = bundles(np.arange(len(part)), len(part), part, grams)
                length = np.linalg.norm(rows, axis=1)
                cosine = rows @ table.T / np.maximum(length, 1e-300)[:, None]
                best = cosine.argmax(axis=1)
                for i in np.flatnonzero(length > 0):
                    langs[start + i] = names[best[i]]
                    scores[start + i] = min(1.0, max(0.0, cosine[i, best[i]]))
            yield pd.DataFrame({"lang": langs, "score": scores})

    return of(text)


def identify(docs: DataFrame, learned: dict[str, np.ndarray], text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with struct(lang, score) in column ``out``."""
    return docs.withColumn(out, predicted(F.col(text_col), learned))
