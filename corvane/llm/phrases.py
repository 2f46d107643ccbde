"""Phrase collocations: an FM-index over word ids for each shard, its counts summed over shards.

A shard is up to ``SHARD`` words of one language that a task gathers. Its index is bidirectional: the words' positions
sorted by what follows and by what precedes, each with its column of the neighbouring words (the two BWTs). Sorting stops
at the wanted depth, which leaves the intervals of all phrases up to that depth exact. Starting from the words' intervals
each step extends all intervals of a level at once, to the right in one index and to the left in the other; the smaller
neighbours inside an interval give the extended phrase's place in the index that was not searched, and counting the
added word before the interval gives it in the other.

The phrases of a shard and their counts are dealt into groups by hash, a compressed row for each shard and group, and
added up there, so that a word of every sentence is one number a shard. Phrases of at least ``least`` occurrences are
kept; all parts of such a phrase are among them.

Defined results: null texts have no words; a null language is ``UNKNOWN``; phrases never cross a piece's end, so neither
a document's; equal documents count each; words are compared as they stand, but for A-Z; the empty table gives an
empty table. A score is an exact whole number: products are decimals of 38 digits (counts to 10 ** 15).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import stored
from corvane.llm.lines import BYTE_BACK, BYTE_BASE, chunks, mixed, run_hashes
from corvane.plans.ranking import top_k_per_group

SHARD = 1 << 20  # words; three of their ids fit into 63 bits
GROUP_BYTES = 4_000_000  # bytes of text for each group of phrases
UNKNOWN = "und"
# What ends a piece and what separates words.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
PIECE = np.isin(np.arange(256), list(PIECE_ENDS))
GAP = PIECE | np.isin(np.arange(256), list(BLANKS))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


# ---- words ---------------------------------------------------------------------------------------------------

def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts, and for each the number of the piece that it stands in."""
    data = np.frombuffer(b".".join(texts).translate(LOWER) + b".", np.uint8)
    gap = GAP[data]
    edge = np.diff(np.concatenate([[True], gap]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    piece = np.cumsum(PIECE[data], dtype=np.int64)[start] if len(start) else np.empty(0, np.int64)
    offsets = np.append(0, np.cumsum(end - start))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start),
                                            [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[~gap])]), piece


class Shard:
    """The gathered words of one language."""

    def __init__(self):
        self.texts: list[pa.Array] = []
        self.pieces: list[np.ndarray] = []
        self.n = 0

    def add(self, words: pa.Array, piece: np.ndarray) -> None:
        last = self.pieces[-1][-1] + 1 if self.pieces else 0
        self.texts.append(words)
        self.pieces.append(piece - piece[0] + last)
        self.n += len(words)

    def symbols(self) -> tuple[list[bytes], np.ndarray]:
        """The distinct words in byte order, and the sequence of their ids from 1, a 0 between pieces and at both ends."""
        coded = pc.dictionary_encode(pa.concat_arrays(self.texts))
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        piece = np.concatenate(self.pieces)
        text = np.zeros(self.n + int((np.diff(piece) > 0).sum()) + 2, np.int64)
        text[np.arange(1, self.n + 1) + np.append(0, np.cumsum(np.diff(piece) > 0))] = rank[coded.indices.to_numpy()]
        return coded.dictionary.take(pa.array(order)), text


# ---- index ---------------------------------------------------------------------------------------------------

def sequence_order(symbols: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their symbols, the first symbol first."""
    bits = max(int(column.max(initial=0)).bit_length() for column in symbols)
    if bits * len(symbols) >= 64:
        return np.lexsort(symbols[::-1])
    key = np.zeros(len(symbols[0]), np.uint64)
    for column in symbols:
        key = (key << np.uint64(bits)) | column.astype(np.uint64)
    return np.argsort(key)


class Side:
    """One direction of the index: the column of neighbours (``bwt``) in the sorted order of positions, and the places of
    each word in it."""

    def __init__(self, text: np.ndarray, depth: int, step: int):
        """``step`` 1 sorts by what follows and looks before; -1 sorts by what precedes and looks behind."""
        def shifted(k: int) -> np.ndarray:
            return np.roll(text, -k * step)

        order = sequence_order([shifted(k) for k in range(depth)])
        self.bwt = shifted(-1)[order]
        self.places = np.sort((self.bwt << 32) | np.arange(len(text)))
        self.first = np.searchsorted(self.places, np.arange(int(text.max()) + 2) << 32)  # places before each word's

    def before(self, word: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each word stands in the column before each row."""
        return np.searchsorted(self.places, (word << 32) | row) - self.first[word]


class Phrases:
    """All phrases of one length: their words, interval in both directions, and number of occurrences."""

    def __init__(self, words: np.ndarray, follow: np.ndarray, precede: np.ndarray, n: np.ndarray):
        self.words, self.follow, self.precede, self.n = words, follow, precede, n


def extended(level: Phrases, side: Side, starts: np.ndarray, right: bool, begin: np.ndarray) -> Phrases:
    """Every phrase lengthened by each word beside it. ``side`` is the direction searched, where the phrases start at
    ``starts``; ``begin`` is the first row of each word."""
    size = level.n
    phrase = np.repeat(np.arange(len(size)), size)
    rows = np.arange(len(phrase)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    pair = np.sort((phrase << 32) | side.bwt[rows])
    new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.empty(0, np.int64)
    n = np.diff(np.append(new, len(pair)))
    phrase, word = pair[new] >> 32, pair[new] & 0xFFFFFFFF
    smaller = new - (np.cumsum(size) - size)[phrase]  # neighbours in the interval that come before this word
    real = word > 0
    phrase, word, n, smaller = phrase[real], word[real], n[real], smaller[real]
    searched = begin[word] + side.before(word, starts[phrase])
    other = (level.follow if right else level.precede)[phrase] + smaller
    words = level.words[phrase]
    words = np.column_stack([words, word] if right else [word, words])
    return Phrases(words, *((other, searched) if right else (searched, other)), n)


def enumerate_phrases(text: np.ndarray, depth: int) -> Iterator[Phrases]:
    """All phrases of 1 to ``depth`` words of a sequence of ids that starts and ends with 0."""
    count = np.bincount(text)
    begin = np.append(0, np.cumsum(count))
    ids = np.flatnonzero(count[1:]) + 1
    level = Phrases(ids[:, None], begin[ids], begin[ids], count[ids])
    yield level
    sides = {True: Side(text, depth, -1), False: Side(text, depth, 1)} if depth > 1 else {}
    for length in range(2, depth + 1):
        right = length % 2 == 0
        level = extended(level, sides[right], level.precede if right else level.follow, right, begin)
        yield level


# ---- shards --------------------------------------------------------------------------------------------------

def sent(shard: Shard, lang: str, depth: int, groups: int) -> Iterator[tuple]:
    """Rows (group, lang, length, phrases, counts) of a shard."""
    names, text = shard.symbols()
    press = zstandard.ZstdCompressor(level=3)
    offsets = np.frombuffer(names.buffers()[1], np.int64)[names.offset:names.offset + len(names) + 1]
    data = np.frombuffer(names.buffers()[2], np.uint8)
    hashes = np.concatenate([np.zeros(1, np.uint64)] + [
        run_hashes(data[a:b], offsets[i:j] - a, offsets[i + 1:j + 1] - a, BYTE_BASE, BYTE_BACK)
        for i, j, a, b in chunks(offsets[:-1], offsets[1:])])
    for level in enumerate_phrases(text, depth):
        h = np.zeros(len(level.n), np.uint64)
        for k in range(level.words.shape[1]):
            h = mixed(h * MIX + hashes[level.words[:, k]])
        group = (h % np.uint64(groups)).astype(np.uint16 if groups <= 1 << 16 else np.int64)
        order = sequence_order([level.words[:, k] for k in range(level.words.shape[1])])
        order = order[np.argsort(group[order], kind="stable")]
        for mine in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            if len(mine):
                parts = [names.take(pa.array(level.words[mine, k] - 1)) for k in range(level.words.shape[1])]
                joined = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if len(parts) > 1 else parts[0]
                yield (int(group[mine[0]]), lang, len(parts), press.compress(b"\n".join(joined.to_pylist())),
                       press.compress(level.n[mine].astype(np.int64).tobytes()))


def shard_phrases(docs: DataFrame, depth: int, groups: int, shard_words: int) -> DataFrame:
    """(group, lang, length, phrases, counts) of the rows (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}

        def out(lang: str) -> Iterator[pa.RecordBatch]:
            rows = list(sent(shards.pop(lang), lang, depth, groups))
            for lo in range(0, len(rows), 64):
                cols = list(zip(*rows[lo:lo + 64]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()))],
                    ["group", "lang", "length", "phrases", "counts"])

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            order = sorted(range(len(langs)), key=langs.__getitem__)
            for lang, mine in groupby(order, key=langs.__getitem__):
                words, piece = words_of([(texts[i] or "").encode() for i in mine])
                lo = 0
                while lo < len(words):  # a shard is cut between pieces, or before a piece that is longer than a shard
                    shard = shards.setdefault(lang, Shard())
                    room = shard_words - shard.n
                    hi = len(words) if len(words) - lo <= room else int(np.searchsorted(piece, piece[lo + room]))
                    if hi <= lo and shard.n == 0:
                        hi = int(np.searchsorted(piece, piece[lo], side="right"))
                    if hi > lo:
                        shard.add(words.slice(lo, hi - lo), piece[lo:hi])
                        lo = hi
                    if lo < len(words) or shard.n >= shard_words:
                        yield from out(lang)
            while sum(s.n for s in shards.values()) > 2 * shard_words:  # many languages
                yield from out(max(shards, key=lambda k: shards[k].n))
        for lang in list(shards):
            yield from out(lang)

    return docs.mapInArrow(run, "group int, lang string, length int, phrases binary, counts binary")


def added_up(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, length, f): the phrases of each group with at least ``least`` occurrences, and for words (length 1)
    a row without a phrase with the sum of all. Rows come sorted by group."""
    unpress = zstandard.ZstdDecompressor()
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for (_, lang, length), mine in groupby(rows, key=lambda r: r[:3]):
        phrases, counts = [], []
        for *_, p, n in mine:
            data = np.frombuffer(unpress.decompress(p) + b"\n", np.uint8)
            ends = np.flatnonzero(data == 10)
            offsets = np.append(0, ends - np.arange(len(ends)))
            phrases.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [
                None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[data != 10])]))
            counts.append(np.frombuffer(unpress.decompress(n), np.int64))
        count = np.concatenate(counts)
        total = pa.table([pa.concat_arrays(phrases), pa.array(count)], ["phrase", "n"]).group_by("phrase").aggregate([("n", "sum")])
        total = total.filter(pc.greater_equal(total["n_sum"], least))
        names = total["phrase"].combine_chunks().cast(pa.binary()).cast(pa.string())
        sums = total["n_sum"].combine_chunks()
        if length == 1:
            names, sums = pa.concat_arrays([names, pa.nulls(1, pa.string())]), pa.concat_arrays([sums, pa.array([int(count.sum())])])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), names, pa.array([length] * len(names), pa.int32()), sums],
                                         ["lang", "phrase", "length", "f"])


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", depth: int = 3, least: int = 10,
                  shard_words: int = SHARD) -> DataFrame:
    """(lang, phrase, length, f) of all phrases of 1 to ``depth`` words with at least ``least`` occurrences; a row without
    a phrase holds the number of all words of its language (in parts, to be added up)."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    rows = shard_phrases(texts, depth, size // GROUP_BYTES + 1, shard_words)
    dealt = rows.repartition("group").sortWithinPartitions("group", "lang", "length")
    return stored(dealt.mapInArrow(lambda b: added_up(b, least), "lang string, phrase string, length int, f long"), "phrases")


# ---- collocations --------------------------------------------------------------------------------------------

def collocations(counts: DataFrame, inside: int = 50, k: int = 2000) -> DataFrame:
    """The first ``k`` phrases of each language: lang, rank, phrase, a, l, r, n, score. ``counts`` are those of
    ``phrase_counts``. A phrase goes when a longer one holds it in at least ``inside`` percent of its occurrences."""
    words = counts.where("phrase is null").groupBy("lang").agg(F.sum("f").alias("n"))
    known = counts.where("phrase is not null")
    candidates = known.where("length > 1").withColumnRenamed("f", "a")
    depth = F.col("length") - 1
    cuts = (candidates.select("lang", "phrase", "length", "a", F.explode(F.sequence(F.lit(1), depth)).alias("cut"))
            .withColumn("first", F.expr("substring_index(phrase, ' ', cut)"))
            .withColumn("rest", F.expr("substring_index(phrase, ' ', cut - length)")))
    part = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    other = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(part, ["lang", "first"]).join(other, ["lang", "rest"])
    a, l, r = (F.col(c).cast("decimal(15,0)") for c in "alr")
    whole = scored.select("*", (F.lit(1_000_000).cast("decimal(7,0)") * (a * a)).alias("over"), (l * r).alias("under"))
    best = whole.withColumn("score", F.expr("over div under")).groupBy("lang", "phrase", "length", "a").agg(
        F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("best")).select("lang", "phrase", "length", "a", "best.*")
    longer = (candidates.where("length > 2").withColumn("start", F.explode(F.sequence(F.lit(1), depth)))
              .withColumn("size", F.explode(F.sequence(F.lit(2), depth))).where(F.col("start") + F.col("size") - 1 <= F.col("length"))
              .select("lang", F.expr("array_join(slice(split(phrase, ' '), start, size), ' ')").alias("phrase"), F.col("a").alias("longest"))
              .groupBy("lang", "phrase").agg(F.max("longest").alias("longest")))
    kept = (best.join(longer, ["lang", "phrase"], "left")
            .where(F.coalesce(100 * F.col("longest") < inside * F.col("a"), F.lit(True))))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    top = top_k_per_group(kept.select("lang", "phrase", "a", "l", "r", "score"), ["lang"], order, k)
    return top.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
