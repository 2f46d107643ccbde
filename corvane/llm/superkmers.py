"""Substring deduplication by super-k-mers: words covered by a window of ``WINDOW`` words that occurs elsewhere go.

A window's minimiser is the least hash of its runs of ``MER`` words. Consecutive windows of one minimiser (a super-k-mer:
about 16 windows in 50 words) travel as one packed string to the minimiser's group, and equal windows have equal
minimisers, so each group sorts its windows and knows every one that occurs twice. A window is known by 128 bits (two
independent hashes); strings that a task holds twice are compared as bytes.

Groups stay small whatever repeats. A first pass over all documents counts minimisers; runs that are a noticeable share
of any task's come last in the order, so a window that leaves a common passage is dealt by its uncommon words. A task
sends a string that it holds many times once, marked as repeated, and has the words of its occurrences at hand.

The strings of a task and group are one compressed row. What comes back are stretches of words to remove, which meet
the texts by a 128-bit key of id and text; texts without any are not moved as long as a filter over the keys of the
others, sized by their number, has at most ``FILTER_BYTES``; beyond that all texts join.

Defined results: null texts have no words and stay null, texts without words become empty; kept words are joined by one
space, also where nothing goes; equal rows hold each other's windows, so both lose them; overlapping occurrences within
a text count as two; the empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import fresh, short_batches, stored
from corvane.llm.lines import BYTE_BACK, BYTE_BASE, SPACE, WORD_BACK, WORD_BASE, chunks, run_hashes

WINDOW = 35
MER = 4
PIECE = 64  # windows that a packed string holds at most
SHARE = 2000  # a run is common when it is the minimiser of more than 1/SHARE of a task's super-k-mers
GROUP = 1 << 20  # windows in a group, on average
FLUSH = 24_000_000  # bytes of packed strings that a task gathers before it sends them
TEXTS_AT_ONCE = 1_000_000  # bytes
SEGMENT = 1 << 19  # words of one text that are hashed together
FILTER_BYTES = 1 << 26
# A second pair of odd bases for the second hash, and their inverses.
BYTE_BASE_2, WORD_BASE_2 = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
BYTE_BACK_2, WORD_BACK_2 = pow(BYTE_BASE_2, -1, 1 << 64), pow(WORD_BASE_2, -1, 1 << 64)
TOP = np.uint64(1 << 63)
SPACES = r"[\x20\x09-\x0D]+"


class Words:
    """The words of some byte strings, joined by one space each: bytes ``data``, ``start`` and ``end`` of each word, and
    ``bounds``, the number of words before each string."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        space = SPACE[data]
        first = ~space & np.append(True, space[:-1])
        self.bounds = np.searchsorted(np.flatnonzero(first), offsets)
        data = data[~space | np.append(False, ~space[:-1])]
        self.data = np.where(SPACE[data], np.uint8(32), data)
        self.end = np.flatnonzero(self.data == 32)
        self.start = np.append(0, self.end + 1)[:len(self.end)]

    def hashes(self, lo: int, hi: int, base: int = BYTE_BASE, back: int = BYTE_BACK) -> np.ndarray:
        start, end = self.start[lo:hi], self.end[lo:hi]
        found = [run_hashes(self.data[a:b], start[i:j] - a, end[i:j] - a, base, back) for i, j, a, b in chunks(start, end)]
        return np.concatenate(found) if found else np.empty(0, np.uint64)


def least_of(values: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every n consecutive values: of a block's tail and the next block's head."""
    m = len(values) - n + 1
    if m <= 0:
        return np.empty(0, values.dtype)
    blocks = np.pad(values, (0, -len(values) % n), constant_values=np.iinfo(values.dtype).max).reshape(-1, n)
    heads = np.minimum.accumulate(blocks, axis=1).ravel()
    tails = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tails[:m], heads[n - 1:n - 1 + m])


def segments(words: Words, window: int) -> Iterator[tuple[int, int]]:
    """Stretches of words that are hashed together: many texts, or a part of a long one with the next window's words."""
    total = len(words.start)
    for lo in range(0, max(0, total - window + 1), SEGMENT):
        yield lo, min(total, lo + SEGMENT + window - 1)


def super_kmers(words: Words, window: int, common: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, first word counted over all texts, windows, minimiser) of the super-k-mers."""
    for lo, hi in segments(words, window):
        h = words.hashes(lo, hi)
        at = np.arange(len(h) - MER + 1)
        mers = run_hashes(h, at, at + MER, WORD_BASE, WORD_BACK) >> np.uint64(1)
        if len(common):
            mers[common[np.minimum(np.searchsorted(common, mers), len(common) - 1)] == mers] |= TOP
        least = least_of(mers, window - MER + 1)
        start = np.arange(lo, lo + len(least))
        text = np.searchsorted(words.bounds, start, side="right") - 1
        whole = start + window <= words.bounds[text + 1]
        least, start, text = least[whole], start[whole], text[whole]
        if not len(start):
            continue
        new = np.append(True, (least[1:] != least[:-1]) | (text[1:] != text[:-1]))
        run = np.flatnonzero(new)
        place = np.arange(len(start)) - np.repeat(run, np.diff(np.append(run, len(start))))
        cut = np.flatnonzero(place % PIECE == 0)
        yield text[cut], start[cut], np.diff(np.append(cut, len(start))), least[cut]


def parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, Words]]:
    """The texts of a batch a few at a time: (row of the first, words)."""
    texts = [(t or "").encode() for t in batch.column(column).to_pylist()]
    lo = size = 0
    for hi, text in enumerate(texts):
        if size and size + len(text) > TEXTS_AT_ONCE:
            yield lo, Words(texts[lo:hi])
            lo, size = hi, 0
        size += len(text)
    if lo < len(texts):
        yield lo, Words(texts[lo:])


# ---- common runs ---------------------------------------------------------------------------------------------

def counted(docs: DataFrame, window: int) -> tuple[int, np.ndarray]:
    """The number of windows, and the sorted hashes of the runs that are common minimisers: SHARE at most."""
    none = np.empty(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, seen, held = 0, [], 0
        names, n = [none], [np.empty(0, np.int64)]
        for batch in batches:
            for _, words in parts(batch, 0):
                for _, _, size, least in super_kmers(words, window, none):
                    windows += int(size.sum())
                    seen.append(least)
                    held += len(least)
                if held > 1 << 20:
                    value, count = np.unique(np.concatenate(seen), return_counts=True)
                    often = count * SHARE > held
                    names.append(value[often])
                    n.append(count[often])
                    seen, held = [], 0
        if seen:
            value, count = np.unique(np.concatenate(seen), return_counts=True)
            often = (count * SHARE > held) & (count > SHARE // 100)
            names.append(value[often])
            n.append(count[often])
        mer, count = np.concatenate(names).view(np.int64), np.concatenate(n)
        yield pa.RecordBatch.from_arrays([pa.array(mer), pa.array(count), pa.nulls(len(mer), pa.int64())], ["mer", "n", "windows"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([windows], pa.int64())],
                                         ["mer", "n", "windows"])

    told = docs.select("text").mapInArrow(run, "mer long, n long, windows long").groupBy("mer").agg(
        F.sum("n").alias("n"), F.sum("windows").alias("windows")).orderBy(F.col("mer").isNotNull(), F.desc("n"), "mer").limit(SHARE + 1)
    with short_batches(docs.sparkSession):
        rows = told.collect()
    windows = sum(r["windows"] for r in rows if r["mer"] is None)
    return windows, np.sort(np.array([r["mer"] for r in rows if r["mer"] is not None], np.int64).view(np.uint64))


# ---- packing -------------------------------------------------------------------------------------------------

class Pack:
    """The strings of a task on their way to their groups, each once, and the stretches already known to repeat."""

    def __init__(self, groups: int):
        self.groups = groups
        self.clear()

    def clear(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.strings: list[bytes] = []
        self.group: list[int] = []
        self.place: list[tuple[int, int, int, int]] = []  # key, key_2, first word and behind the last of the first occurrence
        self.twice: list[bool] = []
        self.known: list[tuple[int, int, int, int]] = []
        self.size = 0

    def add(self, piece: bytes, group: int, place: tuple[int, int, int, int]) -> None:
        i = self.seen.setdefault(piece, len(self.strings))
        if i == len(self.strings):
            self.strings.append(piece)
            self.group.append(group)
            self.place.append(place)
            self.twice.append(False)
            self.size += len(piece) + 150
        else:
            if not self.twice[i]:
                self.twice[i] = True
                self.known.append(self.place[i])
            self.known.append(place)
            self.size += 100

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(group, kind, blob): strings with their place (key 0: repeated), and stretches of words to remove."""
        press = zstandard.ZstdCompressor(level=3)
        group, place = np.array(self.group, np.int64), np.array(self.place, np.int64).reshape(-1, 4)
        place[np.array(self.twice, bool)] = (0, 0, -1, -1)
        out = []
        order = np.argsort(group, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            if len(mine):
                text = press.compress(b"".join(self.strings[i] for i in mine))
                size = np.array([len(self.strings[i]) for i in mine], np.int32).tobytes()
                head = np.array([len(mine)], np.int64).tobytes()
                out.append((int(group[mine[0]]), 0, head + size + place[mine].tobytes() + text))
        if self.known:
            known = merged(np.array(self.known, np.int64))
            group = known[:, 0] % self.groups
            order = np.argsort(group, kind="stable")
            out += [(int(group[mine[0]]), 1, known[mine].tobytes())
                    for mine in np.split(order, np.flatnonzero(np.diff(group[order])) + 1)]
        self.clear()
        for lo in range(0, len(out), 64):
            cols = list(zip(*out[lo:lo + 64]))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()),
                                              pa.array(cols[2], pa.binary())], ["group", "kind", "blob"])


def merged(spans: np.ndarray) -> np.ndarray:
    """Rows (key, key_2, start, end) with touching stretches of a key made one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    key = np.append(True, (spans[1:, :2] != spans[:-1, :2]).any(axis=1))
    lift = (np.cumsum(key) - 1) * (int(spans[:, 3].max()) + 2)  # each key on a line of its own
    reach = np.maximum.accumulate(spans[:, 3] + lift)
    first = np.flatnonzero(np.append(True, (spans[1:, 2] + lift[1:]) > reach[:-1]))
    last = np.append(first[1:], len(spans)) - 1
    out = spans[first].copy()
    out[:, 3] = reach[last] - lift[first]
    return out


def packed(docs: DataFrame, window: int, groups: int, common) -> DataFrame:
    """(group, kind, blob) of the rows (key, key_2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Pack(groups)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            keys_2 = batch.column(1).to_pylist()
            for row, words in parts(batch, 2):
                data = words.data.tobytes()
                for text, start, n, least in super_kmers(words, window, common.value):
                    at = start - words.bounds[text]
                    last = start + n + window - 2
                    group = (least % np.uint64(groups)).astype(np.int64)
                    for t, a, b, g, i, m in zip(text.tolist(), words.start[start].tolist(), (words.end[last] + 1).tolist(),
                                                group.tolist(), at.tolist(), n.tolist()):
                        pack.add(data[a:b], g, (keys[row + t], keys_2[row + t], i, i + m + window - 1))
                    if pack.size > FLUSH:
                        yield from pack.rows()
        yield from pack.rows()

    return docs.select("key", "key_2", "text").mapInArrow(run, "group int, kind int, blob binary")


# ---- counting ------------------------------------------------------------------------------------------------

def repeated(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether the pair (first, second) of each row occurs in another row as well."""
    order = np.argsort(first)
    a, b = first[order], second[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    out = np.zeros(len(first), bool)
    out[order] = np.append(False, same) | np.append(same, False)
    return out


def opened(blobs: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Strings of a group and their places, about TEXTS_AT_ONCE bytes at a time."""
    unpress = zstandard.ZstdDecompressor()
    texts, places, held = [], [], 0
    for blob in blobs:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        places.append(np.frombuffer(blob, np.int64, 4 * n, 8 + 4 * n).reshape(n, 4))
        data, at = unpress.decompress(blob[8 + 36 * n:]), 0
        for size in np.frombuffer(blob, np.int32, n, 8).tolist():
            texts.append(data[at:at + size - 1])
            at += size
        held += at
        if held > TEXTS_AT_ONCE:
            yield texts, np.concatenate(places)
            texts, places, held = [], [], 0
    if texts:
        yield texts, np.concatenate(places)


def spans_of(blobs: list[bytes], window: int) -> np.ndarray:
    """The stretches (key, key_2, start, end) of the windows that a group holds more than once."""
    firsts, seconds, strings, offsets, places, held = [], [], [], [], [], 0
    for texts, place in opened(blobs):
        words = Words(texts)
        n = np.diff(words.bounds) - window + 1
        total = len(words.start)
        text = np.repeat(np.arange(len(texts)), n)
        offset = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        start = words.bounds[text] + offset
        firsts.append(run_hashes(words.hashes(0, total), start, start + window, WORD_BASE, WORD_BACK))
        seconds.append(run_hashes(words.hashes(0, total, BYTE_BASE_2, BYTE_BACK_2), start, start + window, WORD_BASE_2, WORD_BACK_2))
        strings.append((text + held).astype(np.int32))
        offsets.append(offset.astype(np.int32))
        places.append(place)
        held += len(texts)
    first, second, text, offset, place = (np.concatenate(x) for x in (firsts, seconds, strings, offsets, places))
    known = place[text, 2] < 0  # their windows count twice
    hit = repeated(np.append(first, first[known]), np.append(second, second[known]))[:len(first)] & ~known
    place, at = place[text[hit]], offset[hit]
    return merged(np.column_stack([place[:, :2], place[:, 2] + at, place[:, 2] + at + window]))


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, key_2, start, end): the stretches of words to remove from the rows (key, key_2, text)."""
    spark = docs.sparkSession
    windows, common = counted(docs, window)
    groups = windows // GROUP + 1
    held = spark.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((g, k, b) for batch in batches for g, k, b in zip(*(c.to_pylist() for c in batch.columns)))
        for (_, kind), mine in groupby(rows, lambda r: r[:2]):
            blobs = [b for _, _, b in mine]
            spans = spans_of(blobs, window) if kind == 0 else np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 4) for b in blobs])
            yield pa.RecordBatch.from_arrays(
                [pa.array(spans[:, 0]), pa.array(spans[:, 1]), pa.array(spans[:, 2].astype(np.int32)),
                 pa.array(spans[:, 3].astype(np.int32))], ["key", "key_2", "start", "end"])

    sent = packed(docs, window, groups, held).repartition("group").sortWithinPartitions("group", "kind")
    return stored(sent.mapInArrow(run, "key long, key_2 long, start int, end int"), "repeats")


# ---- removing ------------------------------------------------------------------------------------------------

def per_text(spans: DataFrame) -> DataFrame:
    """(key, key_2, stretches, gone): the disjoint stretches of a text in order, and how many words they have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            start, end = (lists.flatten().field(k).to_numpy().astype(np.int64) for k in (0, 1))
            all_of = merged(np.column_stack([row, row, start, end]))
            first = np.searchsorted(all_of[:, 0], np.arange(batch.num_rows + 1))
            total = np.append(0, np.cumsum(all_of[:, 3] - all_of[:, 2]))
            pairs = pa.StructArray.from_arrays([pa.array(all_of[:, k].astype(np.int32)) for k in (2, 3)], ["start", "end"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pairs),
                 pa.array(total[first[1:]] - total[first[:-1]])], ["key", "key_2", "stretches", "gone"])

    lists = spans.groupBy("key", "key_2").agg(F.collect_list(F.struct("start", "end")).alias("list"))
    return lists.mapInArrow(run, "key long, key_2 long, stretches array<struct<start:int,end:int>>, gone long")


def outside(words: Column, stretches: Column) -> Column:
    """The words before, between and behind the stretches."""
    behind = F.concat(F.array(F.lit(0)), F.transform(stretches, lambda s: s["end"]))
    ahead = F.concat(F.transform(stretches, lambda s: s["start"]), F.array(F.size(words)))
    return F.flatten(F.transform(F.arrays_zip(behind.alias("a"), ahead.alias("b")), lambda z: F.slice(words, z["a"] + 1, z["b"] - z["a"])))


def bits_of(n: int) -> int:
    """Filter bits for n keys: a power of two, at least 16 a key."""
    return 1 << max(16, (16 * n - 1).bit_length())


def key_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """Marks of both halves of the keys, as packed bits, gathered in slices."""
    slots = keys.select(F.explode(F.array(*(F.col(k).bitwiseAND(F.lit(bits - 1)) for k in ("key", "key_2")))).alias("slot"))
    width = min(bits, 1 << 18)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((s, x) for b in batches for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for s, mine in groupby(rows, lambda r: r[0]):
            marks = np.zeros(width, bool)
            marks[np.fromiter((x for _, x in mine), np.int64) % width] = True
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())],
                                             ["slice", "marks"])

    sliced = (slots.distinct().select(F.floor(F.col("slot") / width).alias("slice"), "slot").repartition("slice")
              .sortWithinPartitions("slice").mapInArrow(pack, "slice long, marks binary"))
    out = np.zeros(bits // 8, np.uint8)
    for r in sliced.toLocalIterator():
        out[r["slice"] * width // 8:(r["slice"] + 1) * width // 8] = np.frombuffer(r["marks"], np.uint8)
    return out


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, kept_col: str = "kept",
                   words_col: str = "n_words", removed_col: str = "n_removed") -> DataFrame:
    """``docs`` with the words left of each text (``kept_col``) and its numbers of words and of removed words."""
    spark = docs.sparkSession
    kept, n_words, n_removed = fresh(docs, kept_col), fresh(docs, words_col), fresh(docs, removed_col)
    keys = (F.xxhash64(id_col, text_col), F.xxhash64(F.lit(1), text_col, id_col))
    texts = docs.select(keys[0].alias("key"), keys[1].alias("key_2"), F.col(text_col).alias("text"))
    own = [fresh(docs, k) for k in ("key", "key_2", "stretches", "gone")]
    spans = stored(per_text(repeats(texts, window)), "stretches")
    per_key = spans.withColumnsRenamed(dict(zip(("key", "key_2", "stretches", "gone"), own)))
    joined = F.btrim(F.regexp_replace(text_col, SPACES, " "))
    total = F.when(joined == "", 0).otherwise(F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) + 1)

    def shown(df: DataFrame, text: Column, gone: Column) -> DataFrame:
        return df.select(*docs.columns, text.alias(kept), F.coalesce(total, F.lit(0)).cast("bigint").alias(n_words), gone.alias(n_removed))

    def without(df: DataFrame) -> DataFrame:
        found = df.join(per_key, own[:2], "left")
        left = F.array_join(outside(F.split(joined, " "), F.col(own[2])), " ")
        return shown(found, F.when(F.col(own[2]).isNull(), joined).otherwise(left), F.coalesce(F.col(own[3]), F.lit(0).cast("bigint")))

    keyed = docs.select("*", keys[0].alias(own[0]), keys[1].alias(own[1]))
    bits = bits_of(max(1, spans.count()))
    if bits > 8 * FILTER_BYTES:
        return without(keyed)
    marks = spark.sparkContext.broadcast(key_filter(spans, bits))

    @F.pandas_udf("boolean")
    def marked(key: pd.Series, key_2: pd.Series) -> pd.Series:
        slots = [k.to_numpy() & (bits - 1) for k in (key, key_2)]
        return pd.Series(np.logical_and.reduce([(marks.value[s >> 3] >> (s & 7).astype(np.uint8) & 1) > 0 for s in slots]))

    touched = marked(F.col(own[0]), F.col(own[1]))
    return without(keyed.where(touched)).unionByName(shown(keyed.where(~touched), joined, F.lit(0).cast("bigint")))
