"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are scaled to length 1, so a cosine of c is a distance of sqrt(2 - 2c). A hash is floor((a . v + b) / WIDTH)
for a Gaussian a and a uniform b; a table's key is the tuple of ``per_table`` hashes, and vectors that share a table's
key (and label) are compared by exact cosine in double precision. ``settings`` derives the number of hashes from the
largest label, so that a random vector shares a table's key with about ``COMPANY`` unrelated ones, and the number of
tables from the recall asked for at the threshold itself; closer pairs are missed far more rarely.

Equal vectors of a label are one row with its number of copies. Keys held by one row alone go before any vector moves.
A key held by more than ``BLOCK`` rows is cut into blocks and every pair of blocks compared in a group of its own, so a
task holds two blocks at most. A pair counts in the first table whose key it shares; what leaves a task is the number
of links of each row and a spanning forest of them, never the pairs.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component, and those without a label,
link with nothing; vectors of different lengths neither; rows with equal ids are vectors of their own; a null id names
a component only if no other id is there; the empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import forest
from corvane.operators.graph import connected_components
from corvane.plans.runtime import cut_lineage

WIDTH = 2.5
COMPANY = 0.1
RECALL = 0.999
BLOCK = 4096
SMALL = 64  # groups of up to this many rows are compared together with others
ROWS_AT_ONCE = 20_000
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    per_table: int
    tables: int
    seed: int = 42


def collision(distance: float, width: float = WIDTH) -> float:
    """The probability that one hash is equal for two vectors at ``distance`` (Datar et al. 2004)."""
    r = width / max(distance, 1e-9)
    return 1 - 2 * NormalDist().cdf(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def settings(largest: int, threshold: float, recall: float = RECALL, company: float = COMPANY) -> Settings:
    near, far = collision(math.sqrt(max(0.0, 2 - 2 * threshold))), collision(math.sqrt(2))
    per_table = max(1, math.ceil(math.log(max(2, largest) / company) / -math.log(far)))
    return Settings(per_table, max(1, math.ceil(math.log(1 - recall) / math.log1p(-near ** per_table))))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def table_keys(rows: np.ndarray, s: Settings) -> np.ndarray:
    """A 32-bit key for each row and table."""
    rng = np.random.default_rng([s.seed, rows.shape[1]])
    keys = np.empty((len(rows), s.tables), np.uint32)
    for t in range(s.tables):
        a, b = rng.standard_normal((rows.shape[1], s.per_table)), rng.uniform(0, WIDTH, s.per_table)
        odd = rng.integers(0, 1 << 63, s.per_table, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        cells = np.floor((rows @ a + b) / WIDTH).astype(np.int64).view(np.uint64)
        keys[:, t] = (((cells * odd).sum(axis=1, dtype=np.uint64) * MIX) >> np.uint64(32)).astype(np.uint32)
    return keys


# ---- hashing -------------------------------------------------------------------------------------------------

def hashed(distinct: DataFrame, s: Settings) -> DataFrame:
    """(rep, copies, vector, keys, buckets) of the rows (rep, copies, part, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            sizes = np.diff(np.asarray(lists.offsets))
            parts = batch.column(2).to_numpy().view(np.uint64)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                rows = unit(np.asarray(lists.take(pa.array(at)).flatten(), np.float64).reshape(len(at), d))
                keys = table_keys(rows, s)
                mark = keys.astype(np.uint64) | (np.arange(s.tables, dtype=np.uint64) << np.uint64(32))
                bucket = (mark * MIX) ^ parts[at][:, None] ^ np.uint64(d)
                bucket = (bucket ^ (bucket >> np.uint64(31))) * MIX
                pick = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick), batch.column(1).take(pick),
                     pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary()),
                     pa.array(list(bucket.view(np.int64)), pa.list_(pa.int64()))],
                    ["rep", "copies", "vector", "keys", "buckets"])

    return distinct.select("rep", "copies", "part", F.col("embedding").cast("array<double>")).mapInArrow(
        run, "rep long, copies long, vector binary, keys binary, buckets array<long>")


def meetings(rows: DataFrame, block: int) -> DataFrame:
    """(bucket, lo, hi, at, table, rep): who meets whom. A group (bucket, lo, hi) holds the blocks lo and hi."""
    met = (rows.select("rep", F.posexplode("buckets").alias("table", "bucket"))
           .withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).where("n > 1"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    at = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    return (met.withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .select("bucket", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"), "at", "table", "rep"))


# ---- comparing -----------------------------------------------------------------------------------------------

def group_pairs(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers within each of the consecutive groups, a bounded number at a time."""
    small = size <= SMALL
    if small.any():
        end = np.repeat((start + size)[small], size[small])
        first = np.concatenate([np.arange(a, a + n) for a, n in zip(start[small], size[small])])
        for step in range(1, SMALL):
            i = first[first + step < end]
            if not len(i):
                break
            yield i, i + step
    for a, n in zip(start[~small], size[~small]):
        rows = np.arange(a, a + n)
        for lo in range(0, n, 256):
            i, j = np.meshgrid(rows[lo:lo + 256], rows[lo + 1:], indexing="ij")
            ahead = j > i
            yield i[ahead], j[ahead]


class Group:
    """Rows that came together: arrays over rows, sorted by group."""

    def __init__(self, batch: pa.Table):
        self.key = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
        self.at, self.table = batch.column(3).to_numpy(), batch.column(4).to_numpy()
        self.rep, self.copies = batch.column(5).to_numpy(), batch.column(6).to_numpy()
        vectors, keys = batch.column(7).to_pylist(), batch.column(8).to_pylist()
        width = max(map(len, vectors))  # rows of one group have one width; others are filled up
        self.vector = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in vectors), np.float64).reshape(len(vectors), -1)
        self.keys = np.frombuffer(b"".join(keys), np.uint32).reshape(len(keys), -1)

    def links(self, threshold: float) -> pa.RecordBatch:
        new = np.append(True, (self.key[1:] != self.key[:-1]).any(axis=1))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(new)))
        count = np.zeros(len(new), np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in group_pairs(start, size):
            across = (self.key[i, 1] == self.key[i, 2]) | (self.at[i] != self.at[j])
            i, j = i[across], j[across]
            for lo in range(0, len(i), 50_000):
                a, b = i[lo:lo + 50_000], j[lo:lo + 50_000]
                close = np.einsum("ij,ij->i", self.vector[a], self.vector[b]) >= threshold
                a, b = a[close], b[close]
                earlier = np.arange(self.keys.shape[1])[None, :] < self.table[a][:, None]
                counted = ((self.keys[a] == self.keys[b]) & earlier).any(axis=1)
                a, b = a[~counted], b[~counted]
                np.add.at(count, a, self.copies[b])
                np.add.at(count, b, self.copies[a])
                ends.append((self.rep[a], self.rep[b]))
        child, root = forest(*(np.concatenate([e[k] for e in ends]) if ends else np.empty(0, np.int64) for k in (0, 1)))
        linked = np.flatnonzero(count)
        none = pa.nulls(len(linked), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(self.rep[linked]), pa.array(child)]), pa.concat_arrays([none, pa.array(root)]),
             pa.concat_arrays([pa.array(count[linked]), pa.nulls(len(child), pa.int64())])], ["rep", "root", "links"])


def compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of the groups of a task whose rows come sorted by group."""
    waiting: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
            waiting.append(batch.slice(lo, ROWS_AT_ONCE))
            rows += waiting[-1].num_rows
            if rows < ROWS_AT_ONCE:
                continue
            table = pa.Table.from_batches(waiting)
            key = np.stack([table.column(k).to_numpy() for k in range(3)], axis=1)
            whole = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1 if (key != key[-1]).any() else 0
            if whole:
                yield Group(table.slice(0, whole)).links(threshold)
                waiting = table.slice(whole).combine_chunks().to_batches()
                rows = table.num_rows - whole
    if rows:
        yield Group(pa.Table.from_batches(waiting)).links(threshold)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = 0.93, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly), component_id (smallest id reachable), kept."""
    odd = F.exists(F.col("embedding"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = (F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(odd, F.lit(True))
           & F.exists("embedding", lambda x: x != 0))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    rows = rows.select("*", F.coalesce(fit, F.lit(False)).alias("fit"))
    usable = rows.where("fit").withColumn("rep", F.xxhash64("label", "embedding"))
    distinct = (usable.groupBy("rep").agg(F.count("*").alias("copies"), F.first("embedding").alias("embedding"),
                                          F.first(F.xxhash64("label")).alias("part")))
    distinct = cut_lineage(distinct)
    largest = distinct.groupBy("part", F.size("embedding")).count().agg(F.max("count")).first()[0] or 0
    held = cut_lineage(hashed(distinct, settings(largest, threshold, recall)))
    met = meetings(held, block).join(held.select("rep", "copies", "vector", "keys"), "rep")
    group = ["bucket", "lo", "hi"]
    found = (met.select(*group, "at", "table", "rep", "copies", "vector", "keys").repartition(*group)
             .sortWithinPartitions(*group)
             .mapInArrow(lambda batches: compare(batches, threshold), "rep long, root long, links long"))
    found = cut_lineage(found)
    roots = connected_components(found.where("root is not null").select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    counts = found.where("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    least = usable.groupBy("rep").agg(F.min("id").alias("least"))
    reps = (distinct.select("rep", "copies").join(least, "rep").join(counts, "rep", "left")
            .join(roots.withColumnRenamed("id", "rep"), "rep", "left")
            .withColumn("component", F.coalesce("component", "rep")))
    named = reps.groupBy("component").agg(F.min("least").alias("component_id"))
    told = reps.join(named, "component").select(
        "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = usable.select("id", "rep").join(told, "rep").select("id", "n_links", "component_id")
    alone = rows.where(~F.col("fit")).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
