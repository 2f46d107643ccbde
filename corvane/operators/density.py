"""Clusters by density: a minimum spanning forest of the neighbour graph, and its stable clusters.

The distance of two rows is their mutual reachability: at least either row's distance to its ``samples``-th neighbour. The
forest comes by Borůvka rounds: every component picks its lightest edge, picked edges merge components, and only the
lightest edge between two components goes on, so the edges shrink with the rounds. Merging along the forest in order
of distance, a cluster begins where ``least`` rows are together, loses its name where it meets another one, and gathers
smaller neighbours until then. Of a cluster and those inside it, the more stable side is kept: stability adds up, over
the rows, how much longer (in 1 / distance) they are in the cluster than the cluster is by itself. Rows in no kept
cluster are noise.

The merges are a sequence by nature. They are done in slices of ``SLICE`` edges, each in one task that sees its own edges
and the clusters they touch; between slices Spark moves rows to the merged components. What reaches the driver are the
clusters' figures, at most two for each ``least`` rows.

Defined results: edges of equal weight count in order of their ends; rows without neighbours are noise; a neighbour graph
of several components has no cluster of all; a single cluster that holds everything is not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.graph import connected_components
from corvane.plans.ranking import global_rank
from corvane.plans.runtime import cut_lineage

SLICE = 1 << 20
NEAREST = 1e-9  # smaller distances count as this


def reachability(hits: DataFrame, samples: int) -> DataFrame:
    """(u, v, weight), u < v: neighbours (query_id, doc_id, score, rank) at their mutual reachability. Scores are cosines
    of vectors that are compared at length 1."""
    far = hits.where(F.col("rank") <= samples).select(
        "query_id", "doc_id", F.greatest(F.lit(NEAREST), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.round("score", 9)))).alias("far"))
    core = cut_lineage(far.groupBy("query_id").agg(F.max("far").alias("core")))
    ends = [core.select(F.col("query_id").alias(name), F.col("core").alias(f"{name}_core")) for name in ("u", "v")]
    pairs = far.groupBy(F.least("query_id", "doc_id").alias("u"), F.greatest("query_id", "doc_id").alias("v")).agg(F.min("far").alias("far"))
    return (pairs.join(ends[0], "u", "left").join(ends[1], "v", "left")
            .select("u", "v", F.greatest("far", "u_core", "v_core").alias("weight")))


# ---- forest --------------------------------------------------------------------------------------------------

def spanning_forest(edges: DataFrame) -> DataFrame:
    """(u, v, weight): the minimum spanning forest, edges of equal weight in order of their ends."""
    left = cut_lineage(edges.where("u <> v").groupBy("u", "v").agg(F.min("weight").alias("weight"))
                       .select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct("weight", "u", "v").alias("e")))
    chosen: list[DataFrame] = []
    while not left.isEmpty():  # every round at least halves the components that have an edge
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("c"), "e"), F.struct(F.col("b").alias("c"), "e"))).alias("x")).select("x.*")
        lightest = ends.groupBy("c").agg(F.min("e").alias("e")).select("e").distinct()
        picked = cut_lineage(left.join(lightest, "e", "left_semi"))
        chosen.append(picked.select("e.u", "e.v", "e.weight"))
        roots = cut_lineage(connected_components(picked.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
        moved = left
        for end in ("a", "b"):
            own = roots.select(F.col("id").alias(end), F.col("component").alias(f"{end}_root"))
            moved = moved.join(own, end, "left").withColumn(end, F.coalesce(f"{end}_root", end)).drop(f"{end}_root")
        across = moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "e")
        left = cut_lineage(across.groupBy("a", "b").agg(F.min("e").alias("e")))
    out = edges.select("u", "v", "weight").limit(0)
    for part in chosen:
        out = out.unionByName(part)
    return out


# ---- merging -------------------------------------------------------------------------------------------------

class Merging:
    """The components that a slice touches, while its edges are taken in order. ``events`` are rows (kind, node, cluster,
    parent, size, at): a node is now in a cluster ("in"), a cluster ended in its parent ("end"), a node became another
    ("node", in ``parent``), and what components are after the slice ("now")."""

    def __init__(self, least: int, first: int):
        self.least, self.next = least, first
        self.root: dict[int, int] = {}
        self.size: dict[int, int] = {}
        self.cluster: dict[int, int | None] = {}
        self.loose: dict[int, list[int]] = {}  # nodes of a component that is no cluster yet
        self.events: list[tuple] = []

    def see(self, node: int, size: int, cluster: int | None) -> None:
        if node not in self.root:
            self.root[node], self.size[node], self.cluster[node] = node, size, cluster
            self.loose[node] = [] if cluster is not None else [node]

    def find(self, node: int) -> int:
        while self.root[node] != node:
            self.root[node] = node = self.root[self.root[node]]
        return node

    def merge(self, a: int, b: int, at: float) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        named = [c for c in (self.cluster[a], self.cluster[b]) if c is not None]
        size = self.size[a] + self.size[b]
        loose = self.loose.pop(a) + self.loose.pop(b)
        cluster = named[0] if len(named) == 1 else None
        if len(named) == 2 or (not named and size >= self.least):
            cluster, self.next = self.next, self.next + 1
            for child, node in zip(named, (a, b)):
                self.events.append(("end", node, child, cluster, self.size[node], at))
        if cluster is not None:
            self.events += [("in", node, cluster, None, None, at) for node in loose]
            loose = []
        self.root[b] = a
        self.size[a], self.cluster[a], self.loose[a] = size, cluster, loose

    def finish(self) -> list[tuple]:
        for node in self.root:
            root = self.find(node)
            if root != node:
                self.events.append(("node", node, None, root, None, None))
            else:
                self.events.append(("now", node, self.cluster[node], None, self.size[node], None))
        return self.events


EVENTS = "kind string, node long, cluster long, parent long, size long, at double"


def merged(slice_edges: DataFrame, least: int, first: int) -> DataFrame:
    """The events of a slice: edges (pos, weight, u, u_size, u_cluster, v, v_size, v_cluster), all in one task."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        if not parts:
            return
        edges = pd.concat(parts).sort_values("pos")
        state = Merging(least, first)
        for end in ("u", "v"):
            for node, size, cluster in zip(edges[end].tolist(), edges[f"{end}_size"].tolist(), edges[f"{end}_cluster"].tolist()):
                state.see(node, int(size), None if cluster != cluster or cluster is None else int(cluster))
        for u, v, weight in zip(edges["u"].tolist(), edges["v"].tolist(), edges["weight"].tolist()):
            state.merge(u, v, 1.0 / weight)
        kind, node, cluster, parent, size, at = zip(*state.finish())
        whole = [pd.array(x, "Int64") for x in (node, cluster, parent, size)]
        yield pd.DataFrame({"kind": kind, "node": whole[0], "cluster": whole[1], "parent": whole[2], "size": whole[3], "at": pd.array(at, "Float64")})

    return slice_edges.repartition(1).mapInPandas(run, EVENTS)


def merge_history(forest: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, cluster, at): the first cluster of each row and when it came in; and (cluster, parent, size, at): where
    clusters ended."""
    order = [F.col("weight"), F.col("u"), F.col("v")]
    ordered = cut_lineage(global_rank(forest, order, "pos").withColumn("slice", F.floor((F.col("pos") - 1) / SLICE)))
    at = cut_lineage(ordered.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("node", F.col("id")))
    spark = forest.sparkSession
    now = spark.createDataFrame([], "node long, cluster long, size long")
    inside = spark.createDataFrame([], "id long, cluster long, at double")
    ends = spark.createDataFrame([], "cluster long, parent long, size long, at double")
    last = ordered.agg(F.max("slice")).first()[0]
    for number in range(0 if last is None else last + 1):
        part = ordered.where(F.col("slice") == number).select("pos", "weight", "u", "v")
        for end in ("u", "v"):
            own = at.withColumnsRenamed({"id": end, "node": f"{end}_node"})
            state = now.select(F.col("node").alias(f"{end}_node"), F.col("cluster").alias(f"{end}_cluster"), F.col("size").alias(f"{end}_size"))
            part = (part.join(own, end).join(state, f"{end}_node", "left").drop(end).withColumnRenamed(f"{end}_node", end)
                    .withColumn(f"{end}_size", F.coalesce(f"{end}_size", F.lit(1))))
        events = cut_lineage(merged(part, least, number * 2 * SLICE))
        moves = events.where("kind = 'node'").select("node", F.col("parent").alias("to"))
        joined = events.where("kind = 'in'").select("node", "cluster", "at")
        inside = cut_lineage(inside.unionByName(at.join(joined, "node").select("id", "cluster", "at")))
        ends = ends.unionByName(events.where("kind = 'end'").select("cluster", "parent", "size", "at"))
        touched = events.where("kind in ('node', 'now')").select("node")
        now = cut_lineage(now.join(touched, "node", "left_anti").unionByName(events.where("kind = 'now'").select("node", "cluster", "size")))
        at = cut_lineage(at.join(moves, "node", "left").select("id", F.coalesce("to", "node").alias("node")))
    return inside, cut_lineage(ends)


# ---- selection -----------------------------------------------------------------------------------------------

def kept_clusters(figures: dict[int, tuple[float, int]], ends: dict[int, tuple[int, int, float]]) -> dict[int, int]:
    """The kept cluster of every cluster that is in one. ``figures`` are (sum of entries, rows) of the rows that a cluster
    is the first of; ``ends`` are (parent, size, end) of the clusters that ended in another."""
    children: dict[int, list[int]] = {}
    for c, (parent, _, _) in ends.items():
        children.setdefault(parent, []).append(c)
    clusters = set(figures) | set(ends) | set(children)
    tops = sorted(clusters - set(ends))
    order = list(tops)
    for c in order:
        order += children.get(c, [])
    size: dict[int, int] = {}
    best: dict[int, float] = {}
    chosen: set[int] = set()
    for c in reversed(order):
        total, size[c] = figures.get(c, (0.0, 0))
        inside = 0.0
        for child in children.get(c, []):
            total += ends[child][1] * ends[child][2]
            size[c] += size[child]
            inside += best[child]
        own = total - size[c] * (ends[c][2] if c in ends else 0.0)
        all_of_it = len(tops) == 1 and c == tops[0]
        if not all_of_it and own >= inside:
            chosen.add(c)
        best[c] = inside if all_of_it else max(own, inside)
    out: dict[int, int] = {}
    for c in order:
        above = out.get(ends[c][0]) if c in ends else None
        if above is not None or c in chosen:
            out[c] = above if above is not None else c
    return out


def density_clusters(hits: DataFrame, points: DataFrame, samples: int = 10, least: int = 150) -> DataFrame:
    """(id, cluster) of every row of ``points`` (id): clusters are numbered from 0 by size, ties by their smallest id; noise
    is -1. ``hits`` are the neighbours (query_id, doc_id, score, rank) of all points, themselves left out."""
    forest = cut_lineage(spanning_forest(reachability(hits, samples)))
    inside, ends = merge_history(forest, least)
    figures = {r["cluster"]: (r["total"], r["n"]) for r in inside.groupBy("cluster").agg(F.sum("at").alias("total"), F.count("*").alias("n")).collect()}
    ended = {r["cluster"]: (r["parent"], r["size"], r["at"]) for r in ends.collect()}
    kept = kept_clusters(figures, ended)
    spark = hits.sparkSession
    names = spark.createDataFrame(list(kept.items()), "cluster long, kept long")
    found = cut_lineage(inside.join(F.broadcast(names), "cluster").select("id", "kept"))
    sizes = found.groupBy("kept").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    numbers = sizes.select("kept", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).cast("int").alias("cluster"))
    return points.select("id").join(found.join(F.broadcast(numbers), "kept").select("id", "cluster"), "id", "left").select(
        "id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
