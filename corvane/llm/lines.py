"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its five-word shingles (fewer words: the whole line). Two lines match when the Jaccard similarity
of their sets is 0.8 or more; a line goes when an earlier one (by document id, then line number) matches it.

Lines of equal words are one class, so only classes are joined. A class orders its shingles by rarity and sends its
prefix, the part without which no 0.8 match is possible: any two matching classes share a prefix shingle. Rarity comes
from counts over all documents in tables of ``COUNTERS`` counters, which words and shingles share by hash: their size
is fixed, so they can go to every task. Any common order keeps the join exact; the counts only make it cheap. A shingle
with a word counted once occurs nowhere else: it comes first and needs no row.

Classes that meet in a prefix shingle pass the length and positional filters and a bound on their difference, first
against the earliest and the most frequent class of that shingle, which settles groups of copies without their pairs.
Only classes that found no earlier match there are then compared with the rest of their shingles' classes, a pair where
it first meets. Sets are compared whole (``array_intersect``).

Defined results: null texts stay null and blank lines stay; a line is split off at each newline; rows with equal ids
are ordered by their text's hash, and equal rows count as one document; null ids come last; a document whose every
word was on removed lines keeps its blank lines, unless ``drop_emptied``; the empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import WORD, fresh, row_key, stored

SHINGLE = 5
WORD_BITS, SHINGLE_BITS = 24, 20  # counters of words and of shingles, one byte each where they are used
WORD_COUNTERS = 1 << WORD_BITS
COUNTERS = WORD_COUNTERS + (1 << SHINGLE_BITS)
SLICES = COUNTERS >> 18
SIEVE_BITS, SIEVE_SLICES = 1 << 22, 16
SLOTS = 1 << 20
BEFORE = 64  # meeting shingles of a class that are listed as preceding another
PER_SLICE = COUNTERS // SLICES
# Similarity 4/5, as the whole numbers in overlap >= 4/9 of both sizes and in the prefix length.
SAME, OF = 4, 5
TEXTS_AT_ONCE = 1_000_000  # bytes
BYTES_AT_ONCE = 1 << 16
PACKED = 1 << 20  # prefix shingles that a task packs at once
AT_ONCE = 1 << 21  # prefix shingles that wait before those that meet are given
WORDS_IN_A_BUCKET = 1 << 21
LONG = 48  # shingles of a set up to which 32 bits of ``odd`` do
LOW = (1 << 32) - 1
MEETING = ["shingle", "class", "n", "at", "odd"]
MIX = np.uint64(0x9E3779B97F4A7C15)


# Fixed values of the hashes: an odd base for bytes within a word, one for words within a line, and their inverses.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
BYTE_BACK, WORD_BACK = pow(BYTE_BASE, -1, 1 << 64), pow(WORD_BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


@cache
def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, back: int) -> np.ndarray:
    """A hash of each run values[start:end], the same wherever it stands: a polynomial in ``base``, from running sums."""
    n = 1 << max(10, int(len(values)).bit_length())  # few sizes of table
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(base, n)[:len(values)])])
    return mixed((sums[ends] - sums[starts]) * powers(back, n)[starts])


class Words:
    """The words of some whole texts, as arrays: hash, line (counted over all texts), and for each line with words its
    text ``row``, its number ``number`` there, its first word ``first`` and its number of words ``n``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.hash, self.line, self.row, self.number, self.first, self.n = (np.empty(0, t) for t in (
            np.uint64, np.int64, np.int64, np.int32, np.int64, np.int64))
        space = SPACE[data]
        before = np.concatenate([[True], space[:-1]])
        inner = offsets[:-1][offsets[:-1] < len(data)]
        before[inner] = True
        starts = np.flatnonzero(~space & before)
        if not len(starts):
            return
        after = np.concatenate([space[1:], [True]])
        after[inner[inner > 0] - 1] = True
        ends = np.flatnonzero(~space & after) + 1
        self.hash = np.concatenate([
            run_hashes(LOWER[data[lo:hi]], starts[i:j] - lo, ends[i:j] - lo, BYTE_BASE, BYTE_BACK)
            for i, j, lo, hi in chunks(starts, ends)])
        newlines = np.flatnonzero(data == 10)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
        bounds = np.concatenate([[0], np.searchsorted(starts, newlines), [len(starts)]])
        line = np.repeat(np.arange(len(newlines) + 1), np.diff(bounds))  # newlines before the word
        new = np.concatenate([[True], (line[1:] != line[:-1]) | (row[1:] != row[:-1])])
        self.line = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        self.n = np.diff(np.append(self.first, len(starts)))
        self.row = row[self.first]
        self.number = (line[self.first] - np.searchsorted(newlines, offsets[self.row])).astype(np.int32)

    def classes(self) -> np.ndarray:
        """A hash of each line's sequence of words, as a signed long."""
        return run_hashes(self.hash, self.first, self.first + self.n, WORD_BASE, WORD_BACK).view(np.int64)

    def shingles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(line, hash, first word, behind the last) of every shingle, repeats included."""
        room = np.repeat(self.first + self.n, self.n) - np.arange(len(self.hash))  # words from here to the line's end
        at = np.flatnonzero((room >= SHINGLE) | (room == self.n[self.line]))
        end = at + np.minimum(room[at], SHINGLE)
        return self.line[at], run_hashes(self.hash, at, end, WORD_BASE, WORD_BACK), at, end

    def only(self, lines: np.ndarray) -> Words:
        """The given lines alone, in order; their row and number are dropped."""
        part = Words(np.empty(0, np.uint8), np.zeros(1, np.int64))
        part.n = self.n[lines]
        part.first = np.cumsum(part.n) - part.n
        part.line = np.repeat(np.arange(len(lines)), part.n)
        part.hash = self.hash[np.arange(len(part.line)) - np.repeat(part.first, part.n) + np.repeat(self.first[lines], part.n)]
        return part


def chunks(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Runs of words of BYTES_AT_ONCE bytes or one longer word: (first word, behind the last, first byte, behind the last)."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BYTES_AT_ONCE)))
        yield i, j, int(starts[i]), int(ends[j - 1])
        i = j


def in_parts(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    """The texts a few at a time: (row of the first, words). A part has TEXTS_AT_ONCE bytes, or one longer text."""
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + TEXTS_AT_ONCE, side="right")) - 1)
        yield i, Words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        i = j


def word_counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def shingle_counter(h: np.ndarray) -> np.ndarray:
    return WORD_COUNTERS + (h >> np.uint64(64 - SHINGLE_BITS)).astype(np.int64)


# ---- counts ---------------------------------------------------------------------------------------------

def first_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (id, key, class, line_no) for every line with words; last, rows (slice, counts) of words and shingles."""
    counts = np.zeros(COUNTERS, np.uint32)
    names = ["id", "key", "class", "line_no", "slice", "counts"]
    for batch in batches:
        ids, keys = batch.column(0), batch.column(1)
        for start, words in in_parts(batch.column(2)):
            np.add.at(counts, word_counter(words.hash), np.uint32(1))
            np.add.at(counts, shingle_counter(words.shingles()[1]), np.uint32(1))
            row, n = pa.array(words.row + start), len(words.row)
            yield pa.RecordBatch.from_arrays(
                [ids.take(row), keys.take(row), pa.array(words.classes()), pa.array(words.number),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
    for s in range(SLICES):
        mine = counts[s * PER_SLICE:(s + 1) * PER_SLICE]
        slot = np.flatnonzero(mine)
        if len(slot):
            # Gaps and counts byte by byte, low bytes first: the high ones are nearly all zero.
            pair = np.stack([np.diff(slot, prepend=0).astype("<u4"), mine[slot].astype("<u4")])
            blob = zlib.compress(pair.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32())]
                + [pa.array([s], pa.int32()), pa.array([blob], pa.binary())], names)


FIRST = "id long, key long, class long, line_no int, slice int, counts binary"


def add_counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds up the slices of a task; a slice meets in one task, its counters are of fixed size."""
    sums: dict[int, np.ndarray] = {}
    for part in parts:
        for s, blob in zip(part["slice"], part["counts"]):
            pair = np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1).T).view("<u4").reshape(2, -1)
            sums.setdefault(int(s), np.zeros(PER_SLICE, np.int64))[np.cumsum(pair[0])] += pair[1]
    for s, total in sums.items():
        n = int(total[:max(0, WORD_COUNTERS - s * PER_SLICE)].sum())
        rank = np.minimum(255, np.rint(8 * np.log2(np.maximum(total, 1))))
        rank[total == 1] = 0
        rank[total > 1] = np.maximum(rank[total > 1], 1)
        yield pd.DataFrame({"slice": [s], "ranks": [rank.astype(np.uint8).tobytes()], "words": [n]})


def rarities(slices: DataFrame) -> tuple[np.ndarray, int]:
    """For each counter 8 * log2(count), 0 where the count is 1: COUNTERS bytes; and the number of words."""
    found = (slices.select("slice", "counts").repartition("slice")
             .mapInPandas(add_counts, "slice int, ranks binary, words long").collect())
    ranks = np.zeros(COUNTERS, np.uint8)
    for r in found:
        ranks[r["slice"] * PER_SLICE:(r["slice"] + 1) * PER_SLICE] = np.frombuffer(r["ranks"], np.uint8)
    return ranks, sum(r["words"] for r in found)


# ---- shingles ------------------------------------------------------------------------------------------------

def shingles(words: Words, ranks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, shingle, rarity) of the distinct shingles, sorted by line, rarity, shingle. Rarity 0: occurs once."""
    line, value, at, end = words.shingles()
    rarity = np.zeros(len(at), np.int32)
    if ranks is not None:
        singles = np.append(0, np.cumsum(ranks[word_counter(words.hash)] == 0, dtype=np.int32))
        rarity = np.where(singles[end] > singles[at], 0, ranks[shingle_counter(value)].astype(np.int32) + 1)
    key = (line.astype(np.uint64) << np.uint64(43)) | (rarity.astype(np.uint64) << np.uint64(32)) | (value >> np.uint64(32))
    order = np.argsort(key) if len(words.n) < 1 << 20 else np.lexsort((value, rarity, line))
    tied = key[order]
    tied = tied[1:] == tied[:-1]
    if (value[order][1:][tied] != value[order][:-1][tied]).any():  # one key, two shingles
        order = np.lexsort((value, rarity, line))
    line, value, rarity = line[order], value[order], rarity[order]
    new = np.append(True, (line[1:] != line[:-1]) | (value[1:] != value[:-1])) if len(line) else np.zeros(0, bool)
    return line[new], value[new], rarity[new]


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (n * SAME + OF - 1) // OF + 1


def prefix_task(ranks: np.ndarray, buckets: int):
    """(bucket, shingle, class, n, at, odd) for the prefix of every class in the task, its certain singles left out: packed
    by ``bucket`` of the shingle, a row for each bucket and ``PACKED`` or so of them. Bit b of ``odd`` is set where the set
    has an odd number of shingles whose hash ends in b (of 64, or of 32 for up to ``LONG`` shingles): two sets differ in at
    least as many shingles as their ``odd`` in bits, of the fewer bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for batch in batches:
            for _, words in in_parts(batch.column(0)):
                own, where = np.unique(words.classes(), return_index=True)
                line, value, rarity = shingles(words.only(where), ranks)
                n = np.bincount(line, minlength=len(own))
                pos = np.arange(len(line)) - (np.cumsum(n) - n)[line]
                odd = (np.bitwise_xor.reduceat(np.uint64(1) << (value & np.uint64(63)), np.cumsum(n) - n).view(np.int64)
                       if len(line) else np.empty(0, np.int64))
                keep = (pos < prefix_length(n)[line]) & (rarity > 0)
                line, value, pos = line[keep], value[keep], pos[keep]
                held.append((value.view(np.int64), own[line], n[line], pos, odd[line]))
                n_held += len(line)
                if n_held >= PACKED:
                    yield packed(held, buckets)
                    held, n_held = [], 0
        if n_held:
            yield packed(held, buckets)
    return run


def packed(parts: list[tuple[np.ndarray, ...]], buckets: int) -> pa.RecordBatch:
    """Rows of longs, as arrays by column (``MEETING``), as one row of packed columns for each bucket of their shingles.

    Of a shingle's hash its bucket and 32 bits are kept. Two shingles that become one make classes meet in vain, but lose
    no pair: before the first shingle that both classes have, or where it stands, they meet at a place whose filters hold.
    """
    columns = [np.concatenate(c) for c in zip(*parts)]
    bucket = columns[0] >> 32 & (buckets - 1)
    order = np.argsort(bucket, kind="stable")  # a class's shingles stay in order
    found, start = np.unique(bucket[order], return_index=True)
    shingle, own, n, at, odd = (c[order] for c in columns)
    bounds, long_before = np.append(start, len(order)), np.append(0, np.cumsum(n > LONG))
    blobs = []
    for c, ends in ((shingle.astype(np.int32), bounds), (own, bounds), (n.astype(narrow(n)), bounds), (at.astype(narrow(at)), bounds),
                    (folded(odd, n).astype(np.int32), bounds), ((odd >> 32)[n > LONG].astype(np.int32), long_before[bounds])):
        blobs.append(pa.Array.from_buffers(pa.binary(), len(found), [
            None, pa.py_buffer((ends * c.itemsize).astype(np.int32).tobytes()), pa.py_buffer(c.tobytes())]))
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), *blobs], ["bucket", *MEETING, "odd_high"])


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """The rows that ``packed`` packed, as arrays of longs by column."""
    for i in range(batch.num_rows):
        blobs = [batch.column(c)[i].as_buffer() for c in range(1, batch.num_columns)]
        rows = blobs[1].size // 8
        shingle, own, n, at, odd = (np.frombuffer(b, f"i{b.size // rows}").astype(np.int64) for b in blobs[:-1])
        odd &= LOW
        odd[n > LONG] |= np.frombuffer(blobs[-1], np.int32).astype(np.int64) << 32
        yield batch.column(0)[i].as_py() << 32 | shingle & LOW, own, n, at, odd


def folded(odd: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``odd`` of 64 bits for more than ``LONG`` shingles, of 32 for fewer."""
    return np.where(n > LONG, odd, (odd ^ odd >> 32) & LOW)


def narrow(c: np.ndarray) -> type:
    """The least signed type that all values, not negative, fit in."""
    return next(t for t in (np.int8, np.int16, np.int32, np.int64) if int(c.max(initial=0)) <= np.iinfo(t).max)


def set_task(sieve: np.ndarray):
    """(class, set) of the lines whose classes pass the sieve, each once for a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in in_parts(batch.column(0)):
                own, where = np.unique(words.classes(), return_index=True)
                passed = sieve[own & (SIEVE_BITS - 1)]
                own, where = own[passed], where[passed]
                line, value, _ = shingles(words.only(where), None)
                offsets = np.append(0, np.cumsum(np.bincount(line, minlength=len(own)))).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), sets], ["class", "set"])
    return run


def sieve_of(classes: DataFrame) -> np.ndarray:
    """Marks of the classes by their low bits: a table of fixed size, collected in slices of packed bits."""
    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks: dict[int, np.ndarray] = {}
        width = SIEVE_BITS // SIEVE_SLICES
        for part in parts:
            slot = part["slot"].to_numpy()
            for s in np.unique(slot // width):
                marks.setdefault(int(s), np.zeros(width, bool))[slot[slot // width == s] % width] = True
        yield from (pd.DataFrame({"slice": [s], "bits": [np.packbits(m).tobytes()]}) for s, m in marks.items())

    slots = classes.select(F.col("class").bitwiseAND(F.lit(SIEVE_BITS - 1)).alias("slot"))
    sliced = slots.distinct().repartition(F.floor(F.col("slot") / (SIEVE_BITS // SIEVE_SLICES)))
    sieve = np.zeros(SIEVE_BITS, bool)
    for r in sliced.mapInPandas(pack, "slice int, bits binary").collect():
        marks = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
        sieve[r["slice"] * len(marks):(r["slice"] + 1) * len(marks)] |= marks
    return sieve


def slot_of(key: Column) -> Column:
    """One of ``SLOTS`` marks of a document, few enough to send to every task."""
    return F.pmod(key, F.lit(SLOTS))


# ---- the join ------------------------------------------------------------------------------------------------

def may_match(x: str, y: str) -> Column:
    """Length filter, and two bounds: on the overlap, from the positions of a shared shingle, and on the difference.

    Before their first shared shingle two sets share nothing; before a later one, at most what precedes it in both.
    """
    nx, ny, i, j = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.at"), F.col(f"{y}.at")
    odd = F.col(f"{x}.odd").bitwiseXOR(F.col(f"{y}.odd"))
    odd = F.when(F.least(nx, ny) > LONG, odd).otherwise(odd.bitwiseXOR(F.shiftrightunsigned(odd, 32)).bitwiseAND(F.lit(LOW)))
    so_far = F.when(first_shared(x, y), 0).otherwise(F.least(i, j))
    bound = so_far + F.least(nx - i, ny - j)
    return ((F.least(nx, ny) * OF >= F.greatest(nx, ny) * SAME)
            & (bound * (SAME + OF) >= (nx + ny) * SAME)
            & (F.bit_count(odd) * (SAME + OF) <= (nx + ny) * (OF - SAME)))


def first_shared(x: str, y: str) -> Column:
    """Whether nothing precedes this shingle in both; null where that isn't known."""
    return ~F.arrays_overlap(F.col(f"{x}.before"), F.col(f"{y}.before"))


def fetched_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, set) of the wanted (class, first), from the documents where they first stand. Which documents and lines
    to look at goes to the tasks as marks of fixed number; a few others are looked at in vain."""
    slots = wanted.select(slot_of(F.col("first.key")).alias("slot")).distinct()
    sieve = texts.sparkSession.sparkContext.broadcast(sieve_of(wanted))
    there = (texts.withColumn("slot", slot_of(F.col("key"))).join(F.broadcast(slots), "slot", "left_semi").select("text"))
    sets = there.mapInArrow(lambda batches: set_task(sieve.value)(batches), "class long, set array<long>")
    return sets.join(wanted.select("class"), "class", "left_semi").groupBy("class").agg(F.first("set").alias("set"))


def shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle and class, those whose shingle has several classes, each class once: after dropping
    repeats, a row stays if a neighbour has its shingle. One row waits for the next batch."""
    waiting: pa.RecordBatch | None = None
    joined = False  # whether the waiting row's shingle is also the row's before it
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.concat_batches([waiting, batch]) if waiting is not None else batch
        shingle, own = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        new = np.append(True, (shingle[1:] != shingle[:-1]) | (own[1:] != own[:-1]))
        at = np.flatnonzero(new)
        same = shingle[at][1:] == shingle[at][:-1]
        stays = np.append(joined, same) | np.append(same, False)
        yield rows.take(pa.array(at[:-1][stays[:-1]]))
        joined = bool(same[-1]) if len(same) else joined
        waiting = rows.slice(int(at[-1]), 1)
    if waiting is not None and joined:
        yield waiting


def shared_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed rows in any order, those whose shingle has several classes. Whenever many rows wait, those found go, and
    one row for each shingle stays, so that memory follows the shingles, not their rows; a class that comes again later
    can then be given again. Where all rows wait together, those go as well that can't be where a pair first meets."""
    waiting, n_waiting, most, whole = [], 0, AT_ONCE, True
    for batch in batches:
        for columns in unpacked(batch):
            waiting.append((*columns, np.zeros(len(columns[0]), bool)))
            n_waiting += len(columns[0])
            if n_waiting >= most:
                given, kept = sifted(waiting)
                yield given
                waiting, n_waiting = [kept], len(kept[0])
                most, whole = max(AT_ONCE, 2 * n_waiting), False
    if n_waiting:
        given, _ = sifted(waiting)
        yield where_pairs_meet(given) if whole else given


def sifted(waiting: list[tuple[np.ndarray, ...]]) -> tuple[pa.RecordBatch, tuple[np.ndarray, ...]]:
    """(rows of shingles with several classes that were not given yet, the first row of each shingle). The last column
    tells of a kept row whether its shingle's rows so far, itself included, were given."""
    columns = [np.concatenate(c) for c in zip(*waiting)]
    order = np.lexsort((~columns[-1], columns[1], columns[0])) if columns[-1].any() else np.lexsort((columns[1], columns[0]))
    columns = [c[order] for c in columns]
    rows = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*MEETING, "given"])
    shared = pa.concat_batches([rows.slice(0, 0), *shared_rows(iter([rows]))])
    shingle, own, given = columns[0], columns[1], columns[-1]
    start = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
    end = np.append(start[1:], len(shingle)) - 1
    given = np.logical_or.reduceat(given, start) | (own[end] != own[start])
    return shared.filter(pc.invert(shared.column("given"))).select(MEETING), (*(c[start] for c in columns[:-1]), given)


def where_pairs_meet(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Of all rows of some shingles, sorted by shingle, those where a match can have its first common shingle. The smaller
    of two sets that match has eight ninths of its shingles in common with the other, so the first is among its first
    ninth and one more; behind that a row only serves as the greater set of a pair."""
    shingle, n, at = (rows.column(c).to_numpy() for c in (0, 2, 3))
    if not len(shingle):
        return rows
    as_smaller = at <= n - (n * 2 * SAME + SAME + OF - 1) // (SAME + OF)
    start = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
    rows_each = np.diff(np.append(start, len(shingle)))
    smallest = np.minimum.reduceat(np.where(as_smaller, n, np.iinfo(np.int64).max), start)
    stays = as_smaller | (n > np.repeat(smallest, rows_each))
    return rows.filter(pa.array(stays & np.repeat(np.add.reduceat(stays.astype(int), start) > 1, rows_each)))


def meeting_classes(texts: DataFrame, ranks: np.ndarray, n_words: int) -> DataFrame:
    """(shingle, class, n, at, odd): the classes that share a prefix shingle with another. Packed rows take less room to
    shuffle than rows of longs, and are sorted as arrays; the number of buckets grows with the number of words."""
    ranks = texts.sparkSession.sparkContext.broadcast(ranks)
    buckets = max(64, 1 << (n_words // WORDS_IN_A_BUCKET).bit_length())
    blobs = texts.select("text").mapInArrow(lambda batches: prefix_task(ranks.value, buckets)(batches),
                                            ", ".join(["bucket int", *(f"{c} binary" for c in (*MEETING, "odd_high"))]))
    return stored(blobs.repartition(buckets // 2, "bucket").mapInArrow(
        shared_packed, "shingle long, class long, n long, at long, odd long"), "meeting")


def later_classes(texts: DataFrame, met: DataFrame, classes: DataFrame) -> DataFrame:
    """(class,) of the classes that an earlier one matches. ``classes``: class, first (its first place), lines."""
    there = Window.partitionBy("shingle")
    places = F.sort_array(F.collect_set(F.struct("at", "shingle")))  # a class's meeting shingles, part of its prefix
    by_class = met.groupBy("class", "n", "odd").agg(places.alias("places")).join(classes, "class")
    placed = by_class.select("*", F.posexplode("places").alias("nth", "place"))
    before = F.when(F.col("nth") <= BEFORE, F.transform(F.slice("places", F.lit(1), F.col("nth")), lambda p: p["shingle"]))
    x = F.struct("first", "class", "n", F.col("place.at").alias("at"), "odd", before.alias("before"))
    grouped = (placed.select(F.col("place.shingle").alias("shingle"), "lines", x.alias("x"))
               .withColumn("early", F.min("x").over(there))
               .withColumn("common", F.min(F.struct(-F.col("lines"), "x")).over(there)["x"])
               .withColumn("classes", F.count("*").over(there)))

    def compared(y: str) -> Column:  # what a star needs of its centre, where the pair may match
        fit = (F.col("x.class") != F.col(f"{y}.class")) & may_match("x", y)
        return F.when(fit, F.struct(F.col(f"{y}.first").alias("first"), F.col(f"{y}.class").alias("class")))

    met = stored(grouped.select("shingle", "classes", "x", compared("early").alias("early"), compared("common").alias("common"),
                                F.col("early.class").alias("early_class"), F.col("common.class").alias("common_class"))
                 .where("classes > 2 or early is not null or common is not null"), "met")
    stars = met.select("x", F.explode(F.array_distinct(F.array("early", "common"))).alias("y"))
    settled = later_of(stars.where("y is not null"), texts)
    left = met.where("classes > 2").select("shingle", "x", F.col("x.class").alias("class"), "early_class", "common_class")
    unsettled = left.join(settled, "class", "left_anti")
    rest = (unsettled.join(left.select("shingle", F.col("x").alias("y")), "shingle")
            .where((F.col("y.first") < F.col("x.first")) & (F.col("y.class") != F.col("early_class"))
                   & (F.col("y.class") != F.col("common_class")) & (F.col("x.class") != F.col("y.class"))
                   & F.coalesce(first_shared("x", "y"), F.lit(True)) & may_match("x", "y")))
    return settled.union(later_of(rest.select("x", "y"), texts)).distinct()


def later_of(met: DataFrame, texts: DataFrame) -> DataFrame:
    """(class,) of the later class of each row (x, y) of ``met`` whose sets match."""
    x, y = (F.struct(F.col(f"{s}.first").alias("first"), F.col(f"{s}.class").alias("class")) for s in "xy")
    pairs = stored(met.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).distinct(), "pairs")
    wanted = pairs.select("x.*").union(pairs.select("y.*")).distinct()
    sets = stored(fetched_sets(texts, stored(wanted, "wanted")), "sets")
    left = sets.select(F.col("class").alias("earlier"), F.col("set").alias("other"))
    both = F.size(F.array_intersect("set", "other"))
    return stored(pairs.select(F.col("y.class").alias("class"), F.col("x.class").alias("earlier"))
                  .join(sets, "class").join(left, "earlier")
                  .where(both * (SAME + OF) >= (F.size("set") + F.size("other")) * SAME).select("class").distinct(), "later")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, removed): the numbers of a document's lines to remove, counted from 0. ``key`` is
    ``row_key(id_col, text_col)``; documents without such lines have no row."""
    last = F.lit((1 << 63) - 1)  # null ids come last
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("id"), row_key(id_col, text_col).alias("key"),
                        F.col(text_col).alias("text"))
    scanned = stored(texts.mapInArrow(first_task, FIRST), "lines")
    lines = scanned.where("slice is null").select("id", "key", "class", "line_no")
    met = meeting_classes(texts, *rarities(scanned.where("slice is not null")))
    place = F.struct("id", "key", "line_no")
    classes = lines.groupBy("class").agg(F.min(place).alias("first"), F.count("*").alias("lines"))
    classes = stored(classes.join(met.select("class", F.lit(True).alias("meets")).distinct(), "class", "left")
                     .where("lines > 1 or meets"), "classes")  # the others stay, whatever comes
    later = later_classes(texts.select("key", "text"), met, classes.where("meets").select("class", "first", "lines"))
    told = (classes.join(later.withColumn("later", F.lit(True)), "class", "left").where("later or lines > 1")
            .select("class", "first", F.coalesce("later", F.lit(False)).alias("later")))
    gone = lines.join(told, "class").where(F.col("later") | (place != F.col("first")))
    return gone.groupBy("key").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False,
                count_col: str | None = None) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text_col``; ``count_col`` gets how many went."""
    key, removed, slot = (fresh(docs, n) for n in ("row_key", "removed_lines", "slot"))
    found = stored(repeated_lines(docs, id_col, text_col)
                   .select(F.col("key").alias(key), F.col("removed").alias(removed)), "removed")
    keyed = docs.withColumn(key, row_key(id_col, text_col)).withColumn(slot, slot_of(F.col(key)))
    slots = F.broadcast(found.select(slot_of(F.col(key)).alias(slot)).distinct())
    # Only documents that may lose lines are shuffled.
    joined = keyed.join(slots, slot, "left_semi").join(found.hint("shuffle_hash"), key, "left")  # texts aren't sorted
    untouched = keyed.join(slots, slot, "left_anti").withColumn(removed, F.lit(None).cast("array<int>"))
    joined = joined.unionByName(untouched)
    # Split once, in a column of its own: in a lambda it would be split anew for each line.
    split = fresh(joined, "split_lines")
    joined = joined.withColumn(split, F.when(F.col(removed).isNotNull(), F.split(F.col(text_col), "\n", -1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(removed))
    text = F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col(split), i)), "\n"))
    count = [] if count_col is None else [F.coalesce(F.size(removed), F.lit(0)).alias(count_col)]
    done = joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in [*docs.columns, removed]], *count)
    if drop_emptied:
        done = done.where(F.col(removed).isNull() | F.col(text_col).rlike(WORD))
    return done.drop(removed)
