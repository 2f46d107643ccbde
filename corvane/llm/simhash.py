"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at distance d <= 2r share a value within r of both. So every distinct fingerprint stands for
all its variants within r bits, and fingerprints that share a variant are linked; the triangle inequality makes every
such pair a link, and the bit distance is checked all the same.

The variants are shuffled on their first ``PREFIX`` bits. All variants of a fingerprint that share those bits travel as
one row, (bits, fingerprint), and the receiving task writes them out again: 79 rows instead of 2081 for r = 2, nothing
lost. A prefix holding more than ``HOT`` rows is dealt on by the next ``MORE`` bits in the same way; the list of such
prefixes has at most 2 ** PREFIX rows. A task sorts variants in slices of bounded size, those of a prefix that has more by
their next bits, and sends one row per linked fingerprint (a spanning forest of what it saw), never the pairs of a group.

Defined results: null, empty and blank texts have fingerprint zero, linked like any other; fewer words than a shingle
make one shingle; rows with equal ids or texts are rows of their own; a null id is never a component's name unless the
component has no other; the empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import forest, fresh, row_key, stored
from corvane.operators.graph import connected_components
from corvane.plans.runtime import cut_lineage

BITS = 64
PREFIX = 12
MORE = 8
HOT = 200_000
SEED = 42  # fixed value of the fingerprint's definition
HASHES_AT_ONCE = 1 << 15
VARIANTS_AT_ONCE = 500_000


# ---- fingerprints --------------------------------------------------------------------------------------------

def simhash(text: str | None, shingle: int) -> int:
    """The unsigned fingerprint of one text: XXH64 of each shingle, a bit set where over half the hashes set it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() touches A-Z alone
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        pieces = [joined[i:j] for i, j in zip(first[at:at + HASHES_AT_ONCE], last[at:at + HASHES_AT_ONCE])]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = 4) -> Column:
    """The fingerprint as a (signed) long."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series(np.array([simhash(t, shingle) for t in series], np.uint64).view(np.int64))

    return of(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---- ball hashing --------------------------------------------------------------------------------------------

@cache
def flips(bits: int, most: int) -> list[int]:
    """All masks over ``bits`` bits with up to ``most`` set, by number of set bits."""
    return [sum(1 << i for i in chosen) for w in range(most + 1) for chosen in combinations(range(bits), w)]


def mask_column(bits: int, most: int, kind: str) -> Column:
    return F.array(*[F.lit(m).cast(kind) for m in flips(bits, most)])


def spread_balls(distinct: DataFrame, radius: int, hot: int) -> DataFrame:
    """(key, fp): a row for each prefix under which a fingerprint has variants. key = prefix << 9 | next bits + 1,
    the next bits being given where the prefix is hot."""
    prefix = F.shiftrightunsigned("fp", BITS - PREFIX)
    masks = F.explode(mask_column(PREFIX, radius, "bigint")).alias("m")
    rows = (distinct.select("fp", prefix.alias("own"), masks)
            .select("fp", F.col("own").bitwiseXOR(F.col("m")).alias("prefix"),
                    (F.lit(radius) - F.bit_count("m")).alias("left")))
    sizes = (distinct.groupBy(prefix.alias("own")).count()  # at most 2 ** PREFIX rows from here on
             .select("count", F.col("own"), masks)
             .groupBy(F.col("own").bitwiseXOR(F.col("m")).alias("prefix")).agg(F.sum("count").alias("rows"))
             .where(F.col("rows") > hot).select("prefix", F.lit(True).alias("hot")))
    rows = rows.join(F.broadcast(sizes), "prefix", "left")
    more = F.shiftrightunsigned("fp", BITS - PREFIX - MORE).bitwiseAND(F.lit((1 << MORE) - 1))
    nexts = F.filter(mask_column(MORE, radius, "bigint"), lambda m: F.bit_count(m) <= F.col("left"))
    parts = F.when(F.col("hot"), F.transform(nexts, lambda m: more.bitwiseXOR(m) + 1)).otherwise(
        F.array(F.lit(0).cast("bigint")))
    return (rows.select("fp", "prefix", F.explode(parts).alias("part"))
            .select((F.col("prefix") * (1 << (MORE + 1)) + F.col("part")).alias("key"), "fp"))


def ball(want: np.ndarray, fixed: int, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(variant, fingerprint) for every variant that starts with the ``fixed`` bits ``want``, one for all or one a row."""
    moved = (fps >> np.uint64(BITS - fixed)) ^ want
    left = radius - np.bitwise_count(moved).astype(np.int64)
    base = fps ^ (moved << np.uint64(BITS - fixed))
    for budget in range(radius + 1):
        mine = left == budget
        if mine.any():
            masks = np.array(flips(BITS - fixed, budget), np.uint64)
            yield ((base[mine][:, None] ^ masks[None, :]).ravel(), np.repeat(fps[mine], len(masks)))


def first_bits(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(rows, first bits, their number) for the keys without next bits, and for those with them."""
    prefix, part = keys >> np.uint64(MORE + 1), keys & np.uint64((1 << (MORE + 1)) - 1)
    for refined in (False, True):
        rows = np.flatnonzero((part > 0) == refined)
        if len(rows):
            yield (rows, (prefix[rows] << np.uint64(MORE)) | (part[rows] - np.uint64(1)) if refined else prefix[rows],
                   PREFIX + (MORE if refined else 0))


def counted(want: np.ndarray, fixed: int, fps: np.ndarray, radius: int) -> np.ndarray:
    """The number of variants in ``ball`` of each row."""
    left = radius - np.bitwise_count((fps >> np.uint64(BITS - fixed)) ^ want).astype(np.int64)
    sizes = np.array([len(flips(BITS - fixed, budget)) for budget in range(radius + 1)] + [0])
    return sizes[np.maximum(left, -1)]


def linked(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(child, root) of the fingerprints that share a variant."""
    return met([made for rows, want, fixed in first_bits(keys) for made in ball(want, fixed, fps[rows], radius)], radius)


def linked_within(want: np.uint64, fixed: int, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for the variants that start with the ``fixed`` bits ``want``, too many of them by the bits that follow."""
    if counted(want, fixed, fps, radius).sum() <= VARIANTS_AT_ONCE or fixed + MORE > BITS:
        return met(list(ball(want, fixed, fps, radius)), radius)
    found = []
    for bits in range(1 << MORE):
        longer = (want << np.uint64(MORE)) | np.uint64(bits)
        mine = fps[np.bitwise_count((fps >> np.uint64(BITS - fixed - MORE)) ^ longer) <= radius]
        if len(mine) > 1:
            found.append(linked_within(longer, fixed + MORE, mine, radius))
    if not found:
        return fps[:0], fps[:0]
    return forest(np.concatenate([root for _, root in found]), np.concatenate([child for child, _ in found]))


def met(made: list[tuple[np.ndarray, np.ndarray]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(child, root) of the fingerprints that share one of these variants."""
    value, owner = np.concatenate([v for v, _ in made]), np.concatenate([o for _, o in made])
    ordered = np.sort(value)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(shared):
        return shared, shared
    seen = np.zeros(1 << 20, bool)  # a cheap sieve before the exact search
    slot = np.uint64(0x9E3779B97F4A7C15)
    seen[(shared * slot) >> np.uint64(44)] = True
    maybe = np.flatnonzero(seen[(value * slot) >> np.uint64(44)])
    value, owner = value[maybe], owner[maybe]
    at = np.minimum(np.searchsorted(shared, value), len(shared) - 1)
    hit = shared[at] == value
    at, owner = at[hit], owner[hit]
    order = np.lexsort((owner, at))
    at, owner = at[order], owner[order]
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    low = np.repeat(owner[start], np.diff(np.r_[start, len(at)]))  # the group's smallest fingerprint
    pair = (low != owner) & (np.bitwise_count(low ^ owner) <= 2 * radius)
    return forest(low[pair], owner[pair])


def collide(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links within a task whose rows come sorted by key."""
    keys, fps, sizes = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)

    def out(upto: int) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.r_[True, keys[1:upto] != keys[:upto - 1], True])  # of each key, and the end
        before = np.r_[0, np.cumsum(sizes[:upto])][first]
        at = 0
        while at < len(first) - 1:
            end = int(np.searchsorted(before, before[at] + VARIANTS_AT_ONCE, "right")) - 1
            if end > at:
                child, root = linked(keys[first[at]:first[end]], fps[first[at]:first[end]], radius)
            else:  # one key has more variants than that
                end = at + 1
                (_, want, fixed), = first_bits(keys[first[at]:first[at] + 1])
                child, root = linked_within(want[0], fixed, fps[first[at]:first[end]], radius)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(root.view(np.int64))], ["src", "dst"])
            at = end

    for batch in batches:
        more, owners = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
        count = np.zeros(len(more), np.int64)
        for rows, want, fixed in first_bits(more):
            count[rows] = counted(want, fixed, owners[rows], radius)
        keys, fps, sizes = np.concatenate([keys, more]), np.concatenate([fps, owners]), np.concatenate([sizes, count])
        whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on in the next batch
        if sizes[:whole].sum() >= VARIANTS_AT_ONCE:
            yield from out(whole)
            keys, fps, sizes = keys[whole:], fps[whole:], sizes[whole:]
    if len(keys):
        yield from out(len(keys))


def fingerprint_links(distinct: DataFrame, max_distance: int = 4, hot: int = HOT) -> DataFrame:
    """(src, dst) links that connect the distinct fingerprints in ``fp`` exactly as all pairs within
    ``max_distance`` bits do."""
    if max_distance < 2 or max_distance % 2:
        raise ValueError("an even distance is asked for: variants reach half of it")
    radius = max_distance // 2
    rows = spread_balls(distinct, radius, hot).repartition("key").sortWithinPartitions("key").select("key", "fp")
    return rows.mapInArrow(lambda batches: collide(batches, radius), "src long, dst long").distinct()


# ---- groups of documents -------------------------------------------------------------------------------------

def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
               max_distance: int = 4) -> DataFrame:
    """One row per document: id, row_key, fp, component_id (smallest id reachable), keep_key (the row_key of the
    component's row with the smallest id, then the smallest key)."""
    rows = stored(docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row_key"),
                              fingerprint(F.col(text_col), shingle).alias("fp")), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key")).alias("first")
    groups = rows.groupBy("fp").agg(first)
    links = cut_lineage(fingerprint_links(groups.select("fp"), max_distance))
    roots = connected_components(links).withColumnRenamed("id", "fp")
    named = groups.join(roots, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    best = named.groupBy("component").agg(F.min("first").alias("best"))
    names = named.join(best, "component").select("fp", F.col("best.id").alias("component_id"),
                                                 F.col("best.row_key").alias("keep_key"))
    return rows.join(names, "fp").select("id", "row_key", "fp", "component_id", "keep_key")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
               max_distance: int = 4) -> DataFrame:
    """``docs`` with one row left of every component: the one with the smallest id; of equal rows, one."""
    found = components(docs, id_col, text_col, shingle, max_distance)
    key, turn = fresh(docs, "row_key"), fresh(docs, "turn")
    kept = (found.where(F.col("row_key") == F.col("keep_key"))
            .select(F.col("row_key").alias(key)).distinct())
    equal_rows = Window.partitionBy(key).orderBy(F.lit(0))
    return (docs.withColumn(key, row_key(id_col, text_col)).join(kept, key, "left_semi")
            .withColumn(turn, F.row_number().over(equal_rows)).where(F.col(turn) == 1).select(*docs.columns))
