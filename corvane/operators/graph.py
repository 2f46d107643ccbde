"""Graph analytics on edge frames ``(src, dst)``.

Iterations write their state to shared storage every round (``cut_lineage``): plans stay small and a lost executor
costs at most one round. Joins of edges with per-vertex state go through ``hot_key_join``, or through lists of edges that
are dealt once (``outgoing``), aggregates combine map-side, so a vertex with a third of all edges is neither shuffled to
one task nor collected.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.people import year_prefix
from corvane.operators.records import with_pretty_categories
from corvane.plans.ranking import global_rank
from corvane.plans.runtime import cut_lineage, cut_lineage_dealt, stored
from corvane.plans.skew import HOT_PARTS, hot_key_join

# Damping of the rank iteration and the share every vertex starts each round with.
DAMPING = 0.85
RESET = 0.15
TASK_EDGES = 1 << 22  # edges that a task counts triangles in
PAIRS = 1 << 20  # pairs of edges that it looks at together
OPENS, CLOSES = 1, 2  # parts of an edge in a task, if not both


# ---- edges and degrees ---------------------------------------------------------------------------------------

def vertices(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array("src", "dst")).alias("id")
    return edges.select(ends).distinct()


def numbered_vertices(edges: DataFrame) -> DataFrame:
    """Vertices with dense long numbers from 0, in id order."""
    return global_rank(vertices(edges), [F.col("id")], "rank").select("id", (F.col("rank") - 1).alias("vid"))


def numbered_edges(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """Both endpoints replaced by their numbers."""
    first = numbers.select(F.col("id").alias("src"), F.col("vid").alias("src_vid"))
    second = numbers.select(F.col("id").alias("dst"), F.col("vid").alias("dst_vid"))
    return edges.join(first, "src").join(second, "dst").select("src_vid", "dst_vid")


def clean_edges(edges: DataFrame) -> DataFrame:
    """No self-loops, no repeats. Vertices that only have self-loops remain vertices of the raw edges."""
    return edges.where(F.col("src") != F.col("dst")).distinct()


def distinct_links(raw_edges: DataFrame) -> DataFrame:
    """Every link once, loops too, written for the analyses that read them."""
    return stored(raw_edges.distinct(), "links")


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once each."""
    return both_ways(edges).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.where(F.col("src") != F.col("dst")).select(F.explode(both).alias("e")).select("e.*")


def graph_size(raw_edges: DataFrame) -> DataFrame:
    n_vertices = vertices(raw_edges).agg(F.count("*")).scalar()
    return clean_edges(raw_edges).agg(F.count("*").alias("n_edges")).select(
        n_vertices.alias("n_vertices"), "n_edges")


def degrees(edges: DataFrame, end: str, name: str = "degree") -> DataFrame:
    return edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias(name))


def top_degrees(edges: DataFrame, end: str, k: int = 20) -> DataFrame:
    return degrees(edges, end).orderBy(F.desc("degree"), "id").limit(k)


def degree_distribution(edges: DataFrame, end: str = "dst") -> DataFrame:
    return degrees(edges, end).groupBy("degree").agg(F.count("*").alias("n"))


def mean_degree(edges: DataFrame, end: str = "dst") -> DataFrame:
    """Average over vertices that have the degree at all."""
    return degrees(edges, end).agg(F.avg("degree").alias("mean_degree"), F.count("*").alias("n_vertices"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both endpoints among ``ids``, a bounded set such as a top-k list."""
    return (edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
            .join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
            .select("src", "dst"))


@dataclass(frozen=True)
class Outgoing:
    """Edges dealt by ``src`` once for all rounds: lists (src, dsts) that stay where they are, and the edges of hot vertices."""
    lists: DataFrame
    hot: DataFrame | None

    def passed(self, state: DataFrame) -> DataFrame:
        """``dst`` of every edge with the columns of ``state`` (one row per id) of its ``src``. Only ``state`` is shuffled."""
        rest = [c for c in state.columns if c != "id"]
        named = state.withColumnRenamed("id", "src")
        out = self.lists.join(named, "src").select(F.explode("dsts").alias("dst"), *rest)
        if self.hot is None:
            return out
        few = named.join(F.broadcast(self.hot.select("src").distinct()), "src", "left_semi")
        return out.unionByName(self.hot.join(F.broadcast(few), "src").select("dst", *rest))

    def per_vertex(self, of_list: Column, of_rows: Column) -> DataFrame:
        """(id, value) of the vertices with edges, from ``dsts`` or as an aggregate of ``dst``."""
        own = self.lists.select(F.col("src").alias("id"), of_list.alias("value"))
        return own if self.hot is None else own.unionByName(self.hot.groupBy(F.col("src").alias("id")).agg(of_rows.alias("value")))


def outgoing(edges: DataFrame) -> Outgoing:
    """``edges`` for rounds of ``passed``, repeats left out; stored ones, as they are read more than once. The checkpoint keeps
    the partitioning of the lists. The edges of a vertex that has more than a thousandth of all stay rows."""
    degree = cut_lineage(degrees(edges, "src", "n"))
    total = degree.agg(F.sum("n")).first()[0] or 0
    hot = degree.where(F.col("n") * HOT_PARTS > total).select(F.col("id").alias("src"))
    some = not hot.isEmpty()
    cold = edges.join(F.broadcast(hot), "src", "left_anti") if some else edges
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    lists = cut_lineage_dealt(cold.repartition(parts, "src").groupBy("src").agg(F.collect_set("dst").alias("dsts"))
                              .sortWithinPartitions("src"))
    return Outgoing(lists, stored(edges.join(F.broadcast(hot), "src", "left_semi").distinct(), "hot") if some else None)


# ---- components ----------------------------------------------------------------------------------------------

def connected_components(raw_edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component), the component named by its smallest member, edge direction ignored.

    Alternating large-star and small-star steps (Kiveris et al. 2014) turn every component into a star around
    its smallest vertex in a logarithmic number of rounds, long chains included.
    """
    links = cut_lineage(clean_edges(raw_edges).select(F.greatest("src", "dst").alias("v"),
                                                      F.least("src", "dst").alias("p")).distinct())
    total = links.count()  # neither step adds links, so this bounds every later round
    for _ in range(max_rounds):
        if is_star_forest(links):
            break
        links = cut_lineage(large_star(links, total))
        links = cut_lineage(small_star(links, total))
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    everyone = vertices(raw_edges)
    return (everyone.join(links.select(F.col("v").alias("id"), "p"), "id", "left")
            .select("id", F.coalesce("p", "id").alias("component")))


def is_star_forest(links: DataFrame) -> bool:
    """Every vertex has one parent and no parent is a child."""
    roles = F.array(F.struct(F.col("v").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("parent")),
                    F.struct(F.col("p").alias("id"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    per_vertex = (links.select(F.explode(roles).alias("r")).select("r.*").groupBy("id")
                  .agg(F.sum("child").alias("child"), F.max("parent").alias("parent")))
    return per_vertex.where((F.col("child") > 1) | ((F.col("child") > 0) & (F.col("parent") > 0))).isEmpty()


def large_star(links: DataFrame, total: int) -> DataFrame:
    """Connect every larger neighbour of u to the smallest vertex of u's closed neighbourhood."""
    both = F.array(F.struct(F.col("v").alias("u"), F.col("p").alias("w")),
                   F.struct(F.col("p").alias("u"), F.col("v").alias("w")))
    around = links.select(F.explode(both).alias("e")).select("e.*")
    low = around.groupBy("u").agg(F.least(F.col("u"), F.min("w")).alias("m"), F.count("*").alias("n"))
    met = hot_key_join(around.where(F.col("w") > F.col("u")), low, "u", "n", 2 * total)
    return met.select(F.col("w").alias("v"), F.col("m").alias("p")).distinct()


def small_star(links: DataFrame, total: int) -> DataFrame:
    """Connect u and its smaller neighbours to the smallest of them."""
    low = links.groupBy("v").agg(F.min("p").alias("m"), F.count("*").alias("n"))
    met = hot_key_join(links, low, "v", "n", total).select(F.col("p").alias("v"), F.col("m").alias("p"))
    return (met.where(F.col("v") != F.col("p")).union(low.select("v", F.col("m").alias("p")))).distinct()


def group_sizes(members: DataFrame, group: str, k: int = 10) -> DataFrame:
    return (members.groupBy(group).agg(F.count("*").alias("size"))
            .orderBy(F.desc("size"), group).limit(k))


# ---- rank ----------------------------------------------------------------------------------------------------

def page_rank(raw_edges: DataFrame, tolerance: float = 1e-4, iterations: int | None = None,
              max_rounds: int = 200) -> DataFrame:
    """(id, rank), ranks adding up to the number of vertices.

    ``iterations`` runs that many rounds; without it rounds go on until no rank moves by ``tolerance`` or more.
    Vertices without outgoing edges pass nothing on; the final scaling makes up for it.
    """
    lists = outgoing(raw_edges.where(F.col("src") != F.col("dst")))
    out = lists.per_vertex(F.size("dsts").cast("bigint"), F.count("dst")).withColumnRenamed("value", "n")
    ranks = cut_lineage(vertices(raw_edges).join(out, "id", "left")
                        .select("id", F.coalesce("n", F.lit(0)).alias("n"), F.lit(1.0).alias("rank")))
    for _ in range(iterations if iterations is not None else max_rounds):
        giving = ranks.where(F.col("n") > 0).select("id", (F.col("rank") / F.col("n")).alias("share"))
        given = lists.passed(giving).select(
            F.col("dst").alias("id"), "share", F.lit(None).cast("bigint").alias("n"),
            F.lit(None).cast("double").alias("old"))
        kept = ranks.select("id", F.lit(0.0).alias("share"), "n", F.col("rank").alias("old"))
        ranks = cut_lineage(given.unionByName(kept).groupBy("id").agg(
            F.max("n").alias("n"), (RESET + DAMPING * F.sum("share")).alias("rank"), F.max("old").alias("old")))
        if iterations is None:
            moved = ranks.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if moved is None or moved < tolerance:
                break
    else:
        if iterations is None:
            raise RuntimeError(f"ranks not settled after {max_rounds} rounds")
    scale = ranks.agg(F.count("*") / F.sum("rank")).scalar()
    return ranks.select("id", (F.col("rank") * scale).alias("rank"))


def top_ranked(ranks: DataFrame, k: int) -> DataFrame:
    """Ranks are compared at nine decimals, so ties do not depend on the order of summation."""
    return ranks.orderBy(F.desc(F.round("rank", 9)), "id").limit(k)


# ---- triangles -----------------------------------------------------------------------------------------------

def triangle_counts(raw_edges: DataFrame) -> DataFrame:
    """(id, triangles) for every vertex, edge direction ignored.

    Edges point from the end with fewer edges to the one with more, so that no vertex has more of them than the root of
    twice their number, whatever its degree. Vertices get one of c colours by hash, every two colours a few tasks. A
    triangle is counted from its least vertex: the edges out of it go, as lists by colour, to the tasks of their
    colour, and the edge that closes it to those of its own two colours. Only edges out of a vertex that others
    point to can close one; c and the number of tasks for two colours follow from both numbers of edges.
    """
    ends = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    edges = stored(raw_edges.where(F.col("src") != F.col("dst")).select(*ends).distinct(), "edges")
    total = edges.count()
    degree = stored(edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n")), "degrees")
    one, two = (degree.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}")) for end in ("src", "dst"))
    sized = hot_key_join(hot_key_join(edges, one, "src", "n_src", total), two, "dst", "n_dst", total)
    first = F.struct("n_src", "src") < F.struct("n_dst", "dst")
    pointed = stored(sized.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("src"),
                                  F.when(first, F.col("dst")).otherwise(F.col("src")).alias("dst")), "pointed")
    heads = stored(pointed.select(F.col("dst").alias("src")).distinct(), "heads").withColumn("head", F.lit(True))
    closing = degrees(pointed, "src").withColumnRenamed("id", "src").join(heads, "src").agg(F.sum("degree")).first()[0] or 0
    colours, slices = shares(total, closing)

    def colour(end: str) -> Column:
        return F.pmod(F.xxhash64(end), F.lit(colours)).cast("int")

    lists = stored(pointed.groupBy("src", colour("dst").alias("b")).agg(F.collect_list("dst").alias("dst"))
                   .join(heads, "src", "left"), "lists")
    slice_of = F.pmod(F.xxhash64("src", F.lit(1)), F.lit(slices)).cast("int")
    out = lists.select("src", "dst", F.lit(OPENS).alias("a"), "b", slice_of.alias("third"),
                       F.explode(F.sequence(F.lit(0), F.lit(colours - 1))).alias("c"))
    closes = lists.where("head").select("src", "dst", F.lit(CLOSES).alias("a"), "b", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("third"),
                                        colour("src").alias("c"))
    dealt = out.unionByName(closes).select("src", "dst", "a", "b", F.least("b", "c").alias("first"), F.greatest("b", "c").alias("second"), "third")
    kind = edges.schema["src"].dataType.simpleString()
    found = dealt.groupBy("first", "second", "third").applyInArrow(lambda t: triangles_of(listed_edges(t)), f"id {kind}, t long")
    zero = vertices(raw_edges).select("id", F.lit(0).cast("bigint").alias("t"))
    return found.union(zero).groupBy("id").agg(F.sum("t").alias("triangles"))


def shares(total: int, closing: int) -> tuple[int, int]:
    """Numbers of colours and of tasks for two colours: those that move least, with up to half of TASK_EDGES of either kind
    in a task."""
    best = None
    for colours in range(1, 1 + max(2, math.ceil(math.sqrt(8 * max(total, 1) / TASK_EDGES)))):
        if closing / (colours * (colours + 1) / 2) <= TASK_EDGES / 2:
            slices = max(1, math.ceil(4 * total / ((colours + 1) * TASK_EDGES)))
            moved = colours * total + slices * closing
            best = min(best or (moved, colours, slices), (moved, colours, slices))
    return best[1], best[2]


def listed_edges(lists: pa.Table) -> pa.Table:
    """One row per edge from lists of the edges out of a vertex."""
    dst = lists["dst"].combine_chunks()
    row = pc.list_parent_indices(dst)
    flat = {c: lists[c].combine_chunks().take(row) for c in ("src", "a", "b")}
    own = {c: pa.repeat(lists[c][0], len(row)) for c in ("first", "second")}
    return pa.table({**flat, "dst": dst.flatten(), **own})


def triangles_of(edges: pa.Table) -> pa.Table:
    """(id, t): how many triangles each vertex is in, of those with a first vertex whose edges ``src`` to ``dst`` are here (``a``
    is not CLOSES), and a third edge that is here (``a`` is not OPENS) between ends of the task's two colours."""
    n = edges.num_rows
    ends = pc.dictionary_encode(pa.concat_arrays([edges["src"].combine_chunks(), edges["dst"].combine_chunks()]))
    code = ends.indices.to_numpy().astype(np.int64)
    size = len(ends.dictionary)
    src, dst = code[:n], code[n:]
    role, colour = edges["a"].to_numpy(), edges["b"].to_numpy()
    own = [edges[c][0].as_py() for c in ("first", "second")]
    count = np.zeros(size, np.int64)
    closes = role != OPENS
    key = np.sort(np.minimum(src, dst)[closes] * size + np.maximum(src, dst)[closes])
    mask = (1 << max(10, int(8 * len(key)).bit_length())) - 1
    marks = np.zeros(mask + 1, bool)  # of the keys by their hash: most pairs that don't close are told by it
    marks[spot(key, mask)] = True
    opens = np.flatnonzero(role != CLOSES)
    order = opens[np.lexsort((colour[opens], src[opens]))]
    src, dst, colour = src[order], dst[order], colour[order]
    n = len(src)
    last = np.searchsorted(src, src, side="right")
    if own[0] == own[1]:
        start = np.arange(n) + 1  # with the later edges out of the same vertex
    else:  # an end of the first colour with all of the second
        later = np.append(0, np.cumsum(colour == own[0]))
        start = np.where(colour == own[0], np.searchsorted(src, src) + later[last] - later[np.searchsorted(src, src)], last)
    behind = last - start
    total = np.append(0, np.cumsum(behind))
    at = 0
    while at < n and len(key):
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
        one = np.repeat(np.arange(at, to), behind[at:to])
        two = np.arange(len(one)) + np.repeat(start[at:to] - total[at:to] + total[at], behind[at:to])
        left, right = dst[one], dst[two]
        wanted = np.minimum(left, right) * size + np.maximum(left, right)
        likely = np.flatnonzero(marks[spot(wanted, mask)])
        wanted = wanted[likely]
        closed = likely[key[np.minimum(np.searchsorted(key, wanted), len(key) - 1)] == wanted]
        count += np.bincount(np.concatenate([src[one[closed]], left[closed], right[closed]]), minlength=size)
        at = to
    hit = np.flatnonzero(count)
    return pa.table([ends.dictionary.take(pa.array(hit)), pa.array(count[hit])], ["id", "t"])


def spot(key: np.ndarray, mask: int) -> np.ndarray:
    """A place for a number, by its hash."""
    mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - mask.bit_length())).astype(np.int64)


def top_triangles(counts: DataFrame, k: int = 5) -> DataFrame:
    return counts.orderBy(F.desc("triangles"), "id").limit(k)


# ---- communities ---------------------------------------------------------------------------------------------

def label_propagation(raw_edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, label) after synchronous rounds in which every vertex takes the most frequent label among its
    neighbours, ties to the smallest label. Vertices without neighbours keep their own."""
    lists = outgoing(both_ways(raw_edges))
    labels = cut_lineage(vertices(raw_edges).withColumn("label", F.col("id")))
    for i in range(rounds):
        if i:
            heard = (lists.passed(labels)
                     .groupBy(F.col("dst").alias("id"), "label").agg(F.count("*").alias("votes")))
            chosen = heard.groupBy("id").agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col("label").alias("l"))
                                                   ).alias("best")).select("id", F.col("best.l").alias("new"))
        else:  # all labels differ, so each has one vote
            chosen = lists.per_vertex(F.array_min("dsts"), F.min("dst")).withColumnRenamed("value", "new")
        labels = cut_lineage(labels.join(chosen, "id", "left").select("id", F.coalesce("new", "label").alias("label")))
    return labels.select("id", "label")


def largest_community_members(labels: DataFrame, k: int = 5) -> DataFrame:
    """The k smallest ids of the largest community."""
    biggest = group_sizes(labels, "label", 1).select("label")
    return labels.join(biggest, "label", "left_semi").orderBy("id").limit(k)


# ---- distances -----------------------------------------------------------------------------------------------

def most_cited(edges: DataFrame) -> DataFrame:
    return top_degrees(edges, "dst", 1).select("id")


def distances(raw_edges: DataFrame, source: DataFrame) -> DataFrame:
    """(id, distance) of every vertex reachable from the one-row frame ``source``, direction ignored."""
    sym = cut_lineage(symmetric(raw_edges))
    total = sym.count()
    start = source.select("id", F.lit(0).cast("bigint").alias("distance"))
    state = cut_lineage(vertices(raw_edges).join(degrees(sym, "src", "n"), "id", "left")
                        .join(start, "id", "left")
                        .select("id", F.coalesce("n", F.lit(0)).alias("n"), "distance"))
    for hop in count():  # ends when a hop reaches nothing new
        frontier = state.where((F.col("distance") == hop) & (F.col("n") > 0)).select(F.col("id").alias("src"), "n")
        met = (hot_key_join(sym, frontier, "src", "n", total).select(F.col("dst").alias("id")).distinct()
               .withColumn("met", F.lit(True)))
        state = cut_lineage(state.join(met, "id", "left").select(
            "id", "n", F.coalesce("distance", F.when(F.col("met"), F.lit(hop + 1).cast("bigint"))).alias("distance")))
        if state.where(F.col("distance") == hop + 1).isEmpty():
            break
    return state.where(F.col("distance").isNotNull()).select("id", "distance")


def distance_summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("reachable"), F.max("distance").alias("max_hops"),
                     F.avg("distance").alias("mean_hops"))


def distance_histogram(found: DataFrame, first: int = 30) -> DataFrame:
    return found.groupBy("distance").agg(F.count("*").alias("n")).orderBy("distance").limit(first)


# ---- cores and bridges ---------------------------------------------------------------------------------------

def k_core(raw_edges: DataFrame, k: int) -> DataFrame:
    """Vertices left after removing those with fewer than k neighbours until none is left to remove."""
    edges = cut_lineage(symmetric(raw_edges))
    left = edges.count()
    while True:  # every round but the last removes edges
        degree = degrees(edges, "src", "n")
        strong = cut_lineage(degree.where(F.col("n") >= k))
        kept = hot_key_join(edges, strong.withColumnRenamed("id", "src"), "src", "n", left).select("src", "dst")
        edges = cut_lineage(hot_key_join(kept, strong.withColumnRenamed("id", "dst"), "dst", "n", left)
                            .select("src", "dst"))
        before, left = left, edges.count()
        if left == before:
            break
    return edges.select(F.col("src").alias("id")).distinct()


def node_attributes(nodes: DataFrame, edges: DataFrame, labels: DataFrame, base_url: str,
                    label: Callable[[Column], Column] | None = None) -> DataFrame:
    """Node list with rank, degrees (0 when none), community (-1 when none), label and link. ``label`` makes the
    label's part in brackets from the in-degree."""
    wanted = nodes.select("id")

    def own(df: DataFrame) -> DataFrame:
        return df.join(wanted, "id", "left_semi")

    degree_in = degrees(edges.join(wanted.withColumnRenamed("id", "dst"), "dst", "left_semi"), "dst", "in_degree")
    degree_out = degrees(edges.join(wanted.withColumnRenamed("id", "src"), "src", "left_semi"), "src", "out_degree")
    joined = (nodes.join(degree_in, "id", "left").join(degree_out, "id", "left")
              .join(own(labels), "id", "left"))
    in_degree = F.coalesce("in_degree", F.lit(0))
    in_brackets = label(in_degree) if label else F.concat(F.lit("in="), in_degree.cast("string"))
    return joined.select(
        *nodes.columns, in_degree.alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"),
        F.coalesce(F.col("label"), F.lit(-1)).alias("community"),
        F.concat(F.col("id").cast("string"), F.lit(" ("), in_brackets, F.lit(")")).alias("viz_label"),
        tx.link(F.col("id"), base_url).alias("url"))


def community_map(raw_edges: DataFrame, ranks: DataFrame, labels: DataFrame, n: int = 20,
                  base_url: str = "https://example.org/abs/") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the subgraph induced by the n highest-ranked vertices."""
    edges = clean_edges(raw_edges)
    top = cut_lineage(top_ranked(ranks, n))
    return node_attributes(top, edges, labels, base_url), induced(edges, top)


def backbone(raw_edges: DataFrame, ranks: DataFrame, labels: DataFrame, n: int = 20, k: int = 2,
             base_url: str = "https://example.org/abs/") -> tuple[DataFrame, DataFrame]:
    """The k-core of the top-n subgraph; degrees are counted inside it."""
    edges = clean_edges(raw_edges)
    top = cut_lineage(top_ranked(ranks, n))
    inside = cut_lineage(induced(edges, top))
    core = k_core(inside, k)
    core_edges = cut_lineage(induced(inside, core))
    nodes = top.join(core, "id", "left_semi")
    return node_attributes(nodes, core_edges, labels, base_url), core_edges


def bridges(raw_edges: DataFrame, ranks: DataFrame, labels: DataFrame, n: int = 40,
            base_url: str = "https://example.org/abs/") -> tuple[DataFrame, DataFrame]:
    """Top-n vertices scored by rank times the number of communities among their neighbours in the top-n set."""
    edges = clean_edges(raw_edges)
    top = cut_lineage(top_ranked(ranks, n))
    inside = cut_lineage(induced(edges, top))
    around = symmetric(inside).select(F.col("src").alias("id"), F.col("dst").alias("other"))
    seen = around.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(
        F.count_distinct("label").alias("neighbour_communities"))
    nodes = (top.join(seen, "id", "left")
             .withColumn("neighbour_communities", F.coalesce("neighbour_communities", F.lit(0)))
             .withColumn("bridge_score", F.col("neighbour_communities") * F.col("rank")))
    told = F.format_string("nComm=%d, bScore=%.3f", "neighbour_communities", "bridge_score")
    return node_attributes(nodes, edges, labels, base_url, lambda _: told), inside


def top_bridges(nodes: DataFrame, k: int = 20) -> DataFrame:
    return (nodes.where(F.col("neighbour_communities") > 0)
            .orderBy(F.desc(F.round("bridge_score", 9)), "id").limit(k).select("id", "bridge_score"))


# ---- report --------------------------------------------------------------------------------------------------

def report_rows(lists: dict[str, DataFrame], papers: DataFrame, category_map: DataFrame,
                authors: DataFrame | None = None) -> DataFrame:
    """Named id lists of bounded length with the papers' metadata; ids without a paper keep nulls. With ``authors``,
    rows (id, author), also the listed papers' authors in order of name."""
    parts = [df.select(F.lit(name).alias("list"), "id") for name, df in lists.items()]
    wanted = parts[0]
    for part in parts[1:]:
        wanted = wanted.unionByName(part)
    wanted = cut_lineage(wanted)
    ids = wanted.select("id").distinct()
    meta = papers.select("id", "title", "categories", "update_date").join(ids, "id", "left_semi")
    meta = with_pretty_categories(meta, category_map).withColumn("year", year_prefix(F.col("update_date")))
    columns = ["list", "id", "title", "pretty_categories", "year"]
    if authors is not None:
        own = authors.join(ids, "id", "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("author")).alias("names"))
        meta = meta.join(own.select("id", F.array_join("names", ", ").alias("authors")), "id", "left")
        columns.insert(3, "authors")
    return wanted.join(meta, "id", "left").select(*columns)
