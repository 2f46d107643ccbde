"""Hard negatives by anchor-clustered shared lists.

Anchors are the rows whose id is divisible by ``every``; scores are inner products of whole-number vectors. An anchor's
positives are its best rows of its own label; a positive's negatives are the best rows of other labels whose score lies
between two percentages of the positive's score.

Anchors are clustered by direction around centroids fitted on ``FIT_ROWS`` anchors at most. For a cluster whose members lie
within an angle t of the centroid, no member u scores a candidate i above |u| |i| cos(max(0, angle(i, centroid) - t)).
Each cluster sorts the candidates by |i| cos(...) once, and every member walks that list a stretch at a time, until the
bound is below its own worst kept score or below the least score that counts. Until then all scores are exact, so the
result is that of comparing everything.

Anchors are dealt into groups of at most ``ANCHORS`` and candidates into shares of about ``CANDIDATES`` rows; a group and
a share meet in one task, which hands on what each walk kept. The best of all shares are the result. A label or an
equal vector that a third of the rows have is spread over the shares like any other. The walk for negatives follows the
one for positives, whose scores are its bounds.

Defined results: rows with a null id, label or vector, an empty vector or a null component take no part; equal rows count
once; an anchor never meets rows of its own id; vectors of different lengths never meet; no positives, or none with a
possible negative, give no rows, nor does a positive with a score below 0; the empty table gives an empty table. Scores
have to stay below 2 ** 56.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import stored
from corvane.plans.ranking import top_k_per_group

FIT_ROWS = 4096
PER_CLUSTER = 128  # anchors of the fit for each centroid
ROUNDS = 8
ANCHORS = 16_384
CANDIDATES = 65_536
STRETCH = 512  # candidates that the members of a cluster meet at once
MEMBERS = 1024  # walks of a cluster that go on together
LOWEST = -(1 << 62)
EXACT = 1 << 53  # whole numbers that doubles hold


def fitted(vectors: list[np.ndarray], seed: int = 42) -> dict[int, np.ndarray]:
    """Unit centroids by vector length: k-means on directions."""
    out = {}
    for d in {len(v) for v in vectors}:
        rows = unit(np.stack([v for v in vectors if len(v) == d]).astype(np.float64))
        rng = np.random.default_rng(seed)
        centre = rows[rng.choice(len(rows), math.ceil(len(rows) / PER_CLUSTER), replace=False)]
        for _ in range(ROUNDS):
            own = (rows @ centre.T).argmax(axis=1)
            sums = np.zeros_like(centre)
            np.add.at(sums, own, rows)
            centre = np.where(np.bincount(own, minlength=len(centre))[:, None] > 0, unit(sums), centre)
        out[d] = centre
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def angles(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit(rows) @ centre, -1.0, 1.0))


class Kept:
    """The best ``k`` candidates of each walk so far: rows (walk, score, id), scores falling, ids rising."""

    def __init__(self, walks: int, k: int):
        self.k = k
        self.rows = np.empty((0, 3), np.int64)
        self.worst = np.full(walks, LOWEST)  # the k-th best score, once there are k

    def add(self, walk: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.column_stack([walk, score, ids])])
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        start = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0])) if len(rows) else np.empty(0, np.int64)
        n = np.diff(np.append(start, len(rows)))
        place = np.arange(len(rows)) - np.repeat(start, n)
        self.rows = rows[place < self.k]
        full = rows[place == self.k - 1]
        self.worst[full[:, 0]] = full[:, 1]


def walked(members: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, centre: np.ndarray, theirs: np.ndarray,
           their_ids: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """Rows (walk, score, id): the best ``k`` candidates of every walk with a score from ``low`` to ``high`` and another id,
    and how many scores were computed. ``members`` and ``theirs`` are whole numbers."""
    sizes = np.linalg.norm(members.astype(np.float64), axis=1)
    norms = np.linalg.norm(theirs.astype(np.float64), axis=1)
    # Angles err by less than this; the slack keeps the bounds above every true score.
    spread = float(angles(members.astype(np.float64), centre).max()) + 1e-6
    bound = norms * np.cos(np.maximum(0.0, angles(theirs.astype(np.float64), centre) - spread))
    order = np.argsort(-bound)
    theirs, their_ids, bound = theirs[order], their_ids[order], bound[order]
    if sizes.max() * norms.max(initial=0) < EXACT:
        members, theirs = members.astype(np.float64), theirs.astype(np.float64)
    kept = Kept(len(members), k)
    work = 0
    for lo in range(0, len(theirs), STRETCH):
        most = sizes * bound[lo] * (1 + 1e-9) + 1
        walking = np.flatnonzero(most >= np.maximum(kept.worst, low))
        if not len(walking):
            break
        score = (members[walking] @ theirs[lo:lo + STRETCH].T).astype(np.int64)
        work += score.size
        fits = (score >= np.maximum(low, kept.worst)[walking, None]) & (score <= high[walking, None])
        fits &= their_ids[None, lo:lo + STRETCH] != ids[walking, None]
        if score.shape[1] > k:  # what is below the stretch's own k-th best is out
            best = np.partition(np.where(fits, score, LOWEST), -k, axis=1)[:, -k]
            fits &= score >= best[:, None]
        walk, at = np.nonzero(fits)
        kept.add(walking[walk], score[walk, at], their_ids[lo + at])
    return kept.rows, work


def vectors_of(column: pa.Array, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The vectors of the rows ``which``, all of one length."""
    d = int(lengths[which[0]])
    blobs = column.take(pa.array(which)).to_pylist()
    return np.stack([np.frombuffer(b, np.int32 if len(b) == 4 * d else np.int64) for b in blobs]).astype(np.int64)


def meet(anchors: pa.Table, rows: pa.Table, centres: dict[int, np.ndarray], k: int, same_label: bool) -> pa.Table:
    """What the walks of a group keep of a share: (anchor_id, anchor, walk, id, score)."""
    out = []
    d_a, d_r = anchors["d"].to_numpy(), rows["d"].to_numpy()
    label_a, label_r = (np.array(t["label"].to_pylist(), object) for t in (anchors, rows))
    ids_a, ids_r = anchors["id"].to_numpy(), rows["id"].to_numpy()
    vec_a, vec_r = (t["vec"].combine_chunks() for t in (anchors, rows))
    low, high = (anchors[c].to_pylist() for c in ("low", "high"))
    for d in np.unique(d_a):
        mine, theirs = np.flatnonzero(d_a == d), np.flatnonzero(d_r == d)
        if not len(theirs):
            continue
        u, v = vectors_of(vec_a, d_a, mine), vectors_of(vec_r, d_r, theirs)
        centre = centres.get(int(d), unit(u.sum(axis=0, keepdims=True).astype(np.float64)))
        cluster = (u.astype(np.float64) @ centre.T).argmax(axis=1)
        for label in set(label_a[mine]):
            mask = (label_r[theirs] == label) == same_label
            if not mask.any():
                continue
            share, share_ids = v[mask], ids_r[theirs[mask]]
            for c in np.unique(cluster[label_a[mine] == label]):
                of = np.flatnonzero((label_a[mine] == label) & (cluster == c))
                walks = [(i, w, a, b) for i in of for w, (a, b) in enumerate(zip(low[mine[i]], high[mine[i]])) if a <= b]
                for lo in range(0, len(walks), MEMBERS):
                    at, w, a, b = (np.array(x, np.int64) for x in zip(*walks[lo:lo + MEMBERS]))
                    found, _ = walked(u[at], ids_a[mine[at]], a, b, centre[c], share, share_ids, k)
                    out.append(np.column_stack([mine[at[found[:, 0]]], w[found[:, 0]], found[:, 2], found[:, 1]]))
    found = np.concatenate(out) if out else np.empty((0, 4), np.int64)
    who = pa.array(found[:, 0])
    return pa.table([anchors["id"].take(who), anchors["anchor"].take(who), pa.array(found[:, 1].astype(np.int32)), pa.array(found[:, 2]),
                     pa.array(found[:, 3])], ["anchor_id", "anchor", "walk", "id", "score"])


def searched(anchors: DataFrame, rows: DataFrame, groups: int, shares: int, centres, k: int, same_label: bool) -> DataFrame:
    """(anchor_id, anchor, walk, id, score, rank): the best ``k`` rows of every walk. Anchors bring arrays ``low`` and
    ``high`` with the least and greatest score of each walk."""
    def each(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    mine = anchors.select("id", "anchor", "label", "d", "vec", "low", "high", F.pmod("anchor", F.lit(groups)).cast("int").alias("group"),
                          each(shares).alias("share"))
    theirs = rows.select("id", "label", "d", "vec", F.pmod(F.xxhash64("id", "vec"), F.lit(shares)).cast("int").alias("share"),
                         each(groups).alias("group"))
    found = mine.groupBy("group", "share").cogroup(theirs.groupBy("group", "share")).applyInArrow(
        lambda a, r: meet(a, r, centres.value, k, same_label), "anchor_id long, anchor long, walk int, id long, score long")
    return top_k_per_group(stored(found, "walks"), ["anchor_id", "anchor", "walk"], [F.desc("score"), F.col("id")], k)


def packed(rows: DataFrame) -> DataFrame:
    """(id, label, d, vec): vectors as bytes of 32 or, where they need it, 64 bits a component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets, flat = lists.offsets.to_numpy(), np.asarray(lists.values, np.int64)
            vec = [flat[a:b] for a, b in zip(offsets, offsets[1:])]
            blobs = [(v.astype(np.int32) if (v == v.astype(np.int32)).all() else v).tobytes() for v in vec]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int32)),
                                              pa.array(blobs, pa.binary())], ["id", "label", "d", "vec"])
    return rows.mapInArrow(run, "id long, label string, d int, vec binary")


def hard_negatives(vectors: DataFrame, id_col: str = "id", vector_col: str = "vector", label_col: str = "label", every: int = 50,
                   positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), ``least`` and ``most`` in percent."""
    spark = vectors.sparkSession
    usable = (F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~F.exists("v", F.isnull))
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                           F.col(vector_col).cast("array<bigint>").alias("v"))
    rows = stored(packed(given.where(F.coalesce(usable, F.lit(False)))).distinct(), "rows")
    anchors = stored(rows.where(F.col("id") % every == 0).withColumn("anchor", F.xxhash64("id", "label", "vec")), "anchors")
    n_rows, n_anchors = rows.count(), anchors.count()
    sample = anchors.orderBy("anchor", "id").limit(FIT_ROWS).select("d", "vec").collect()
    centres = spark.sparkContext.broadcast(fitted(
        [np.frombuffer(r["vec"], np.int32 if len(r["vec"]) == 4 * r["d"] else np.int64) for r in sample]))
    groups = max(1, math.ceil(n_anchors / ANCHORS))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, math.ceil(n_rows / CANDIDATES), min(tasks // groups, math.ceil(n_rows / (CANDIDATES // 16))))
    everything = anchors.select("*", F.array(F.lit(LOWEST + 1)).alias("low"), F.array(F.lit(-LOWEST)).alias("high"))
    first = searched(everything, rows, groups, shares, centres, positives, True)
    own = stored(first.groupBy("anchor_id", "anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives")), "positives")
    bounds = anchors.join(own.withColumnRenamed("anchor_id", "id"), ["id", "anchor"]).select(
        "*", F.expr(f"transform(positives, p -> (p.score * {least} + 99) div 100)").alias("low"),
        F.expr(f"transform(positives, p -> if(p.score < 0, {LOWEST}, p.score * {most} div 100))").alias("high"))
    second = searched(bounds, rows, groups, shares, centres, negatives, False)
    named = own.select("anchor_id", "anchor", F.posexplode("positives").alias("walk", "positive"))
    return second.join(named, ["anchor_id", "anchor", "walk"]).select(
        "anchor_id", F.col("positive.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))
