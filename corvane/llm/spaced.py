"""Benchmark decontamination by spaced-seed hashing.

Texts are compared as sequences of lower-case words without punctuation. A seed mask names the token positions that a
hash reads; the positions it skips may differ. Every mask is laid on every position of the benchmark items and of the
documents, and equal hashes are joined. Around a hit both token sequences lie side by side, and the hit counts when
some stretch of ``WINDOW`` aligned tokens that covers it (the whole item, if that is shorter) agrees in at least
four fifths of its positions.

The masks leave no such stretch out: whichever fifth of the positions differs, one of the masks fits between
(``tests`` try every placement). Items too short for the masks are cut into one more part than the tokens that
may differ, so that one part is whole; these parts are further masks.

Before the shuffle, a document's hashes pass a sieve of the benchmark's hashes: 16 MB of marks however long the
benchmark is. What passes is joined with the benchmark's table as Spark sees fit, hot hashes included, and carries the
token hashes around the hit, so that no text moves.

Defined results: null and empty texts and items have no tokens and match nothing; nor do items of under ``LEAST`` tokens; a document is reported once for each
item, with its best stretch; equal documents each; an empty benchmark rejects nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import fresh, row_key, stored
from corvane.plans.runtime import cut_lineage

TOKEN = re.compile(r"\w+")
WINDOW = 20  # aligned tokens that are judged together
SHORT = 14  # items with fewer tokens are cut into parts
# The positions that each seed reads. Together they meet every stretch of 14 to 20 tokens of which at
# most a fifth differ.
MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 3, 4, 5), (0, 5, 6, 7, 8))
LEAST = 5  # tokens without which an item is too short to be told from chance
SIEVE_BITS = 27
SLICES = 64
MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> np.ndarray:
    """The hashes of a text's tokens."""
    words = TOKEN.findall((text or "").lower())
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def allowed(n: int) -> int:
    """How many of n aligned tokens may differ."""
    return n // 5


@cache
def parts(n: int) -> tuple[tuple[int, tuple[int, ...]], ...]:
    """(start, mask) of the whole parts that a short item of n tokens is cut into."""
    cuts = np.linspace(0, n, allowed(n) + 2).astype(int)
    return tuple((int(a), tuple(range(int(b - a)))) for a, b in zip(cuts, cuts[1:]) if b > a)


def masked(t: np.ndarray, mask: tuple[int, ...], starts: np.ndarray | None = None) -> np.ndarray:
    """The hash under ``mask`` at every position where it fits, or at ``starts``."""
    n = max(0, len(t) - mask[-1])
    at = slice(0, n) if starts is None else starts
    value = np.full(n if starts is None else len(starts), xxhash.xxh64_intdigest(repr(mask).encode()), np.uint64)
    for p in mask:
        piece = t[p:p + n] if starts is None else t[at + p]
        value = (value ^ piece) * MIX
        value ^= value >> np.uint64(29)
    return value


def around(t: np.ndarray, at: int) -> tuple[int, np.ndarray]:
    """The token hashes from WINDOW before ``at`` to twice WINDOW behind it, and how many of them come before."""
    start = max(0, at - WINDOW)
    return at - start, t[start:at + 2 * WINDOW]


def seeds(t: np.ndarray) -> Iterator[tuple[int, np.uint64, tuple[int, ...]]]:
    """(position, hash, mask) of an item."""
    if len(t) < LEAST:
        return
    if len(t) < SHORT:
        for start, mask in parts(len(t)):
            yield start, masked(t, mask, np.array([start]))[0], mask
    else:
        for mask in MASKS:
            yield from ((i, h, mask) for i, h in enumerate(masked(t, mask)))


def item_rows(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(hash, mask, item, n, at, before, tokens): a row for each mask and position of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = tokens(text)
                found = [(int(h.astype(np.int64)), list(mask), item, len(t), i, *around(t, i)) for i, h, mask in seeds(t)]
                if found:
                    cols = list(zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.int64()),
                         pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.int32()),
                         pa.array([x.view(np.int64) for x in cols[6]], pa.list_(pa.int64()))],
                        ["hash", "mask", "item", "n", "at", "before", "tokens"])

    return items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).mapInArrow(
        run, "hash long, mask array<int>, item long, n int, at int, before int, tokens array<long>")


def probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two marks of a hash."""
    return (h >> np.uint64(64 - SIEVE_BITS)).astype(np.int64), (h & np.uint64((1 << SIEVE_BITS) - 1)).astype(np.int64)


def sieve_of(rows: DataFrame) -> np.ndarray:
    """The items' marks as packed bits, 2 ** SIEVE_BITS of them, collected in slices."""
    width = (1 << SIEVE_BITS) // SLICES

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks: dict[int, np.ndarray] = {}
        for frame in frames:
            slot = frame["slot"].to_numpy()
            for s in np.unique(slot // width):
                marks.setdefault(int(s), np.zeros(width, bool))[slot[slot // width == s] % width] = True
        yield from (pd.DataFrame({"slice": [s], "slots": [np.flatnonzero(m).astype(np.uint32).tobytes() if m.sum() < width // 64
                                                          else np.packbits(m, bitorder="little").tobytes()],
                                  "packed": [bool(m.sum() >= width // 64)]}) for s, m in marks.items())

    slots = F.array(F.shiftrightunsigned("hash", 64 - SIEVE_BITS), F.col("hash").bitwiseAND(F.lit((1 << SIEVE_BITS) - 1)))
    sliced = rows.select(F.explode(slots).alias("slot")).distinct().repartition(F.floor(F.col("slot") / width))
    sieve = np.zeros((1 << SIEVE_BITS) // 8, np.uint8)
    for r in sliced.mapInPandas(pack, "slice int, slots binary, packed boolean").collect():
        if r["packed"]:
            sieve[r["slice"] * width // 8:(r["slice"] + 1) * width // 8] |= np.frombuffer(r["slots"], np.uint8)
        else:
            slot = np.frombuffer(r["slots"], np.uint32).astype(np.int64) + r["slice"] * width
            np.bitwise_or.at(sieve, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
    return sieve


def passing(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The positions of the hashes that have both marks."""
    first, second = probes(h)
    at = np.flatnonzero(sieve[first >> 3] >> (first & 7).astype(np.uint8) & 1)
    second = second[at]
    return at[(sieve[second >> 3] >> (second & 7).astype(np.uint8) & 1) > 0]


def document_hits(texts: DataFrame, sieve, masks: list[tuple[int, ...]]) -> DataFrame:
    """(hash, key, at, before, tokens) of the document positions that the sieve lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = sieve.value
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for key, text in zip(keys, batch.column(1)):
                t = tokens(text.as_py())
                for mask in masks:
                    h = masked(t, mask)
                    for i in passing(marks, h):
                        out.append((int(h[i].astype(np.int64)), key, int(i), *around(t, int(i))))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                     pa.array(cols[3], pa.int32()), pa.array([x.view(np.int64) for x in cols[4]], pa.list_(pa.int64()))],
                    ["hash", "key", "at", "before", "tokens"])

    return texts.mapInArrow(run, "hash long, key long, at int, before int, tokens array<long>")


def best_stretch(span: int, n: int, at: int, item: np.ndarray, item_before: int, doc: np.ndarray,
                 doc_before: int) -> tuple[int, int, int]:
    """(agreeing tokens, length, start in the item) of the best stretch covering ``span`` tokens from the hit on;
    (0, 0, 0) if the document ends within the item's stretch everywhere."""
    length = min(WINDOW, n)
    lo = -min(item_before, doc_before)
    hi = min(len(item) - item_before, len(doc) - doc_before)
    same = item[item_before + lo:item_before + hi] == doc[doc_before + lo:doc_before + hi]
    best = (0, 0, 0)
    total = np.r_[0, np.cumsum(same)]
    for start in range(max(lo, span - length), min(0, hi - length) + 1):
        agree = int(total[start - lo + length] - total[start - lo])
        if agree > best[0]:
            best = (agree, length, at + start)
    return best


def verify(joined: DataFrame) -> DataFrame:
    """(key, item, agree, length, at): the hits that hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                agree, length, start = best_stretch(r["span"], r["n"], r["item_at"], np.array(r["item_tokens"]),
                                                    r["item_before"], np.array(r["tokens"]), r["before"])
                if length and length - agree <= allowed(length):
                    out.append((r["key"], r["item"], agree, length, start))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
                ["key", "item", "agree", "length", "item_at"])

    return joined.mapInArrow(run, "key long, item long, agree int, length int, item_at int")


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(key, item, agree, length, item_at): the best stretch of every document and item that share one.
    ``key`` is ``row_key(id_col, text_col)``."""
    spark = docs.sparkSession
    rows = cut_lineage(item_rows(items, item_col, item_text_col))
    short = rows.where(F.col("n") < SHORT).select("mask").distinct().collect()  # SHORT * 4 masks at most
    masks = sorted({tuple(r["mask"]) for r in short} | set(MASKS))
    sieve = spark.sparkContext.broadcast(sieve_of(rows))
    texts = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    hits = stored(document_hits(texts, sieve, masks), "hits")
    span = F.element_at("mask", -1) + 1
    wanted = rows.select("hash", "item", "n", F.col("at").alias("item_at"), F.col("before").alias("item_before"),
                         F.col("tokens").alias("item_tokens"), span.alias("span"))
    found = verify(hits.join(wanted, "hash"))
    best = F.max_by(F.struct("agree", "length", "item_at"), F.struct(F.col("agree") / F.col("length"), -F.col("item_at")))
    return found.groupBy("key", "item").agg(best.alias("best")).select("key", "item", "best.*")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without those that share a stretch with an item."""
    key = fresh(docs, "row_key")
    bad = (overlaps(docs, items, id_col, text_col, item_col, item_text_col)
           .select(F.col("key").alias(key)).distinct())
    return docs.withColumn(key, row_key(id_col, text_col)).join(bad, key, "left_anti").select(*docs.columns)
