"""A stored index of vectors: k-means cells cut into shells by distance, written sorted, probed cell by cell.

``build`` fits the cells on a bounded share of the rows, places every row, and gathers near cells into groups. Files are
sorted by group, cell and distance to the cell's centroid, so a few cells touch few row groups; a group of many rows is
cut into parts by hash, so what meets in a task does not grow with a cell.

``search`` visits each query's nearest cell first, which gives a distance that the k-th neighbour does not exceed, then
its next cells. A query goes once to every group it visits; there it is compared only with those stretches of a cell's
rows that the triangle inequality leaves within its distance, which shrinks on the way. With all cells allowed the
result is exact. How many cells a wanted recall takes is measured while building: for sampled rows, the place of their
true neighbours' cells in their own order of cells.

Distances are between vectors of length 1. Vectors that are null, empty or zero, or hold a null or non-finite component,
are left out, as are those whose length differs from the indexed ones'. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.search import nearest, ranked
from corvane.plans.runtime import cut_lineage

MOST_CELLS = 16_384
FIT_PER_CELL = 256  # rows that the fit sees for each cell
GROUP_CELLS = 16  # cells in a group, on average
PART = 32_768  # rows of a group that meet queries at once
QUERIES = 4096  # queries that are compared with a part at once
VISITORS = 1 << 14  # queries that a copy of a part is made for
STRETCH = 512  # rows of a cell that are compared at once
MEASURED = 512  # rows whose true neighbours set the number of cells to probe
SLACK = 1e-6  # of distances, for rounding


@dataclass(frozen=True)
class VectorIndex:
    rows: DataFrame  # id, vector, cell, distance, group, part
    groups: DataFrame  # group, n, parts
    centroids: np.ndarray
    group_of: np.ndarray  # of each cell
    places: np.ndarray  # sorted: where measured neighbours' cells stand in the order of cells

    def probes(self, recall: float) -> int:
        """Cells to probe for the wanted share of true neighbours."""
        if not len(self.places):
            return len(self.centroids)
        return int(self.places[min(len(self.places) - 1, math.ceil(recall * len(self.places)) - 1)]) + 1


def usable(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(column: pa.Array) -> np.ndarray:
    rows = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (rows @ centroids.T)))


def fitted(vectors: DataFrame, n: int, cells: int, seed: int) -> np.ndarray:
    """Unit centroids from FIT_PER_CELL rows a cell, chosen by hash."""
    share = min(1.0, cells * FIT_PER_CELL / max(1, n))
    chosen = vectors.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    points = chosen.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    centres = np.array(KMeans(k=cells, maxIter=10, seed=seed, distanceMeasure="cosine", initMode="random").fit(points).clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)


def gathered(centroids: np.ndarray, seed: int) -> np.ndarray:
    """The group of each cell: k-means over the centroids."""
    n = math.ceil(len(centroids) / GROUP_CELLS)
    middle = centroids[np.random.default_rng(seed).choice(len(centroids), n, replace=False)]
    for _ in range(10):
        own = (centroids @ middle.T).argmax(axis=1)
        for g in range(n):
            if (own == g).any():
                middle[g] = centroids[own == g].mean(axis=0)
    return (centroids @ middle.T).argmax(axis=1)


def placed(vectors: DataFrame, centroids) -> DataFrame:
    """(id, vector, cell, distance) of the rows (id, vector)."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                far = distances(unit_rows(part.column(1)), centroids.value)
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])],
                    ["id", "vector", "cell", "distance"])

    return vectors.mapInArrow(run, f"id {kind}, vector array<float>, cell int, distance double")


def build(embeddings: DataFrame, path: str, key: str = "id", vector: str = "embedding", cells: int | None = None, k: int = 10,
          seed: int = 42) -> VectorIndex:
    """Writes the index under ``path`` and returns it. ``cells`` defaults to the root of the number of rows."""
    spark = embeddings.sparkSession
    given = embeddings.select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    vectors = given.where(F.col("id").isNotNull() & usable(F.col("vector")))
    common = vectors.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        raise ValueError("no vector to index")
    vectors = vectors.where(F.size("vector") == common["d"])
    cells = cells or min(MOST_CELLS, math.ceil(math.sqrt(common["count"])))
    centroids = fitted(vectors, common["count"], cells, seed)
    held = spark.sparkContext.broadcast(centroids)
    rows = cut_lineage(placed(vectors, held))
    group_of = spark.createDataFrame([(i, int(g)) for i, g in enumerate(gathered(centroids, seed))], "cell int, group int")
    grouped = rows.join(F.broadcast(group_of), "cell")
    groups = cut_lineage(grouped.groupBy("group").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int")))
    parted = grouped.join(F.broadcast(groups.select("group", "parts")), "group").select(
        "id", "vector", "cell", "distance", "group", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    order = ["group", "part", "cell", "distance"]
    parted.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{path}/rows")
    groups.repartition(1).write.parquet(f"{path}/groups")
    middle = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    middle.join(group_of, "cell").repartition(1).write.parquet(f"{path}/centroids")
    places = measured(spark.read.parquet(f"{path}/rows"), centroids, k)
    spark.createDataFrame([(int(p),) for p in places], "place int").repartition(1).write.parquet(f"{path}/places")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> VectorIndex:
    """A stored index. Its centroids have a bounded number; the rest stays where it is."""
    centroids = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    places = spark.read.parquet(f"{path}/places").orderBy("place").collect()
    return VectorIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/groups"),
                       np.array([c["centroid"] for c in centroids]), np.array([c["group"] for c in centroids]),
                       np.array([p["place"] for p in places], np.int64))


def measured(rows: DataFrame, centroids: np.ndarray, k: int) -> np.ndarray:
    """Where the cells of the true neighbours of MEASURED rows, chosen by hash, stand in those rows' order of cells."""
    chosen = rows.orderBy(F.xxhash64("id", F.lit("measured")), "id").limit(MEASURED).select(F.col("id").alias("query_id"), "vector").toPandas()
    found = nearest(rows, chosen, k, "id", "vector", exclude_self=True).select("query_id", F.col("doc_id").alias("id"))
    cells = found.join(rows.select("id", "cell"), "id").select("query_id", "cell").collect()
    unit = np.stack(chosen["vector"].to_numpy()).astype(np.float64)
    order = distances(unit / np.linalg.norm(unit, axis=1, keepdims=True), centroids).argsort(axis=1).argsort(axis=1)
    row = {q: i for i, q in enumerate(chosen["query_id"])}
    return np.sort([order[row[c["query_id"]], c["cell"]] for c in cells]).astype(np.int64)


# ---- searching -----------------------------------------------------------------------------------------------

def located(queries: DataFrame, index: VectorIndex, probes: int) -> DataFrame:
    """(query_id, vector, group, first, cells): the ``probes`` nearest cells of each query, by group; ``first`` is the
    nearest cell in its own group's row, else null."""
    held = queries.sparkSession.sparkContext.broadcast((index.centroids, index.group_of))
    kind = queries.schema["query_id"].dataType.simpleString()
    probes = min(probes, len(index.centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, group_of = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                near = np.argsort(distances(unit_rows(part.column(1)), centroids), axis=1, kind="stable")[:, :probes]
                row, group, cell = np.repeat(np.arange(len(part)), probes), group_of[near].ravel(), near.ravel()
                order = np.lexsort((cell, group, row))
                row, group, cell = row[order], group[order], cell[order]
                start = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (group[1:] != group[:-1]))) if len(row) else np.empty(0, np.int64)
                nearest_cell = near[row[start], 0]
                own = group_of[nearest_cell] == group[start]
                pick = pa.array(row[start])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pick), part.column(1).take(pick), pa.array(group[start].astype(np.int32)),
                     pa.array(nearest_cell.astype(np.int32), mask=~own),
                     pa.ListArray.from_arrays(pa.array(np.append(start, len(row)).astype(np.int32)), pa.array(cell.astype(np.int32)))],
                    ["query_id", "vector", "group", "first", "cells"])

    d = index.centroids.shape[1]
    fit = queries.select("query_id", F.col("vector").cast("array<float>").alias("vector")).where(usable(F.col("vector")) & (F.size("vector") == d))
    return fit.mapInArrow(run, f"query_id {kind}, vector array<float>, group int, first int, cells array<int>")


class Pool:
    """The best rows of each query so far. Rows farther than ``reach`` are beaten by k others of another part."""

    def __init__(self, n: int, k: int, reach: np.ndarray):
        self.k, self.reach = k, reach
        self.worst = 1.0 - reach * reach / 2 - 1e-8
        self.query, self.at, self.score = [], [], []

    def add(self, queries: np.ndarray, score: np.ndarray, start: int, own: np.ndarray) -> None:
        """``score`` of ``queries`` and the rows from ``start`` on; ``own`` marks rows that do not count."""
        keys = np.where(own, -np.inf, np.round(score, 9))
        if keys.shape[1] >= self.k:
            self.worst[queries] = np.maximum(self.worst[queries], np.partition(keys, -self.k, axis=1)[:, -self.k])
            self.reach[queries] = np.minimum(self.reach[queries], np.sqrt(np.maximum(0.0, 2 + 4e-9 - 2 * self.worst[queries])))
        row, col = np.nonzero((keys >= self.worst[queries, None]) & (keys > -np.inf))
        self.query.append(queries[row])
        self.at.append(start + col)
        self.score.append(score[row, col])

    def best(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score); ties by the rows' ``rank``."""
        if not self.query:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        query, at, score = (np.concatenate(x) for x in (self.query, self.at, self.score))
        order = np.lexsort((rank[at], -np.round(score, 9), query))
        query = query[order]
        keep = order[np.arange(len(query)) - np.searchsorted(query, query) < self.k]
        return tuple(x[keep] for x in (np.concatenate(self.query), at, score))


def met(visits: DataFrame, index: VectorIndex, k: int, exclude_self: bool) -> DataFrame:
    """(query_id, doc_id, score): the best ``k`` rows of every part that a query visits, and a row without ``doc_id`` with
    the number of rows it was compared with. ``visits`` is (query_id, vector, group, cells, reach). Queries and rows meet by
    part and block of queries, so both sides of a meeting are bounded."""
    asked = visits.groupBy("group").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("blocks"))
    sizes = cut_lineage(asked.join(index.groups.select("group", "parts"), "group"))
    dealt = visits.join(F.broadcast(sizes), "group").select(
        "group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), "query_id", "vector", "cells", "reach")
    rows = index.rows.join(F.broadcast(sizes.drop("parts")), "group").select(
        "group", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "vector", "cell", "distance")
    asks, holds = visits.schema["query_id"].dataType.simpleString(), index.rows.schema["id"].dataType.simpleString()
    held = visits.sparkSession.sparkContext.broadcast(index.centroids)

    at_once = QUERIES

    def best(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        cell, away, ids = theirs["cell"].to_numpy(), theirs["distance"].to_numpy(), theirs["id"].combine_chunks()
        order = np.lexsort((away, cell))
        cell, away, ids = cell[order], away[order], ids.take(pa.array(order))
        rows = unit_rows(theirs["vector"].combine_chunks())[order] if len(ids) else None
        names = np.array(ids.to_pylist())
        _, rank = np.unique(names, return_inverse=True)
        found = [pa.table([mine["query_id"].combine_chunks().slice(0, 0), ids.slice(0, 0), pa.array([], pa.float64())], ["query_id", "doc_id", "score"])]
        for first in range(0, len(mine) if len(ids) else 0, at_once):
            found.append(compared_with(mine.slice(first, at_once), cell, away, ids, names, rank, rows))
        return pa.concat_tables(found)

    def compared_with(mine: pa.Table, cell, away, ids, names, rank, rows) -> pa.Table:
        q = mine["query_id"].combine_chunks()
        asking = unit_rows(mine["vector"].combine_chunks())
        own_names = np.array(q.to_pylist())
        lists = mine["cells"].combine_chunks()
        visitor, visited = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        by_cell = np.argsort(visited, kind="stable")
        visitor, visited = visitor[by_cell], visited[by_cell]
        pool = Pool(len(q), k, mine["reach"].to_numpy().copy())
        compared = np.zeros(len(q), np.int64)
        for c in np.unique(cell):
            of = np.sort(visitor[np.searchsorted(visited, c):np.searchsorted(visited, c, side="right")])
            if not len(of):
                continue
            far = distances(asking[of], held.value[c:c + 1])[:, 0]
            lo, hi = np.searchsorted(cell, [c, c + 1])
            for a in range(lo, hi, STRETCH):
                z = min(hi, a + STRETCH)
                least = np.maximum(np.maximum(0.0, away[a] - far), far - away[z - 1])
                near = of[least <= pool.reach[of] + SLACK]
                if len(near):
                    compared[near] += z - a
                    own = own_names[near][:, None] == names[None, a:z] if exclude_self else np.zeros((len(near), z - a), bool)
                    pool.add(near, asking[near] @ rows[a:z].T, a, own)
        query, at, score = pool.best(rank)
        none = pa.nulls(len(q), ids.type)
        return pa.table([pa.concat_arrays([q.take(pa.array(query)), q]), pa.concat_arrays([ids.take(pa.array(at)), none]),
                         pa.array(np.concatenate([score, compared.astype(np.float64)]))], ["query_id", "doc_id", "score"])

    group = ["group", "part", "block"]
    return cut_lineage(dealt.groupBy(*group).cogroup(rows.groupBy(*group)).applyInArrow(best, f"query_id {asks}, doc_id {holds}, score double"))


@dataclass(frozen=True)
class Found:
    hits: DataFrame  # query_id, doc_id, score, rank
    compared: DataFrame  # query_id, candidates: rows that the query was compared with


def search(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = None, exclude_self: bool = False) -> Found:
    """The best ``k`` rows for each query (query_id, vector) among its ``probes`` nearest cells; all cells by default,
    which is exact."""
    probed = cut_lineage(located(queries, index, probes or len(index.centroids)))
    nearest_cell = probed.where("first is not null").select("query_id", "vector", "group", F.array("first").alias("cells"), F.lit(2.1).alias("reach"))
    near = met(nearest_cell, index, k, exclude_self)
    hits = cut_lineage(ranked(near.where("doc_id is not null"), k))
    reach = hits.where(F.col("rank") == k).select("query_id", F.sqrt(F.greatest(F.lit(0.0), 2 + 4e-9 - 2 * F.col("score"))).alias("reach"))
    others = F.filter("cells", lambda c: F.col("first").isNull() | (c != F.col("first")))
    rest = probed.join(reach, "query_id", "left").select("query_id", "vector", "group", others.alias("cells"), F.coalesce("reach", F.lit(2.1)).alias("reach"))
    far = met(rest.where(F.size("cells") > 0), index, k, exclude_self)
    both = near.unionByName(far)
    seen = both.where("doc_id is null").groupBy("query_id").agg(F.sum("score").cast("bigint").alias("candidates"))
    return Found(ranked(hits.drop("rank").unionByName(far.where("doc_id is not null")), k), seen)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the hits of ``exact`` that ``found`` has."""
    both = exact.select("query_id", "doc_id").join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return both.agg(F.count("*").alias("neighbours"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
