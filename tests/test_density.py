"""Density clusters by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import density, neighbours
from corvane.plans.runtime import new_path


def graph_of(vectors, samples):
    """Edges (weight, u, v) of the neighbour graph, by all pairs."""
    unit = np.float32(vectors).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    far = np.maximum(density.NEAREST, np.sqrt(np.maximum(0, 2 - 2 * np.round(unit @ unit.T, 9))))
    near = [sorted((far[i, j], j) for j in range(len(far)) if j != i)[:samples] for i in range(len(far))]
    core = [n[-1][0] for n in near]
    return sorted({(max(d, core[i], core[j]), min(i, j), max(i, j)) for i, n in enumerate(near) for d, j in n})


def forest_of(edges, n):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    out = []
    for w, u, v in edges:
        a, b = find(u), find(v)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((w, u, v))
    return out, [find(i) for i in range(n)]


def brute(vectors, samples, least):
    """The clusters as sets of rows, from the top: every edge is taken out in turn, longest first."""
    n = len(vectors)
    forest, roots = forest_of(graph_of(vectors, samples), n)

    def parts(members, edges):
        inside = [e for e in edges if e[1] in members]
        return forest_of(inside, n)[1]

    def stable(members, edges, birth, whole):
        """(stability, kept clusters) of a component that is a cluster from ``birth`` on."""
        start, total, edges = set(members), 0.0, sorted(e for e in edges if e[1] in members)
        while edges:
            w = edges.pop()[0]
            where = parts(members, edges)
            halves = {}
            for m in members:
                halves.setdefault(where[m], set()).add(m)
            halves = list(halves.values())
            big = [h for h in halves if len(h) >= least]
            gone = sum(len(h) for h in halves if len(h) < least)
            total += gone / w
            if len(big) == 2:
                total += len(members) / w
                below = [stable(h, edges, 1 / w, False) for h in big]
                inside = sum(s for s, _ in below)
                own = total - len(start) * birth
                if whole or inside > own:
                    return inside, [c for _, kept in below for c in kept]
                return own, [start]
            if not big:
                break
            members = big[0]
        own = total - len(start) * birth
        return (0.0, []) if whole else (own, [start])

    trees = {}
    for i, r in enumerate(roots):
        trees.setdefault(r, set()).add(i)
    trees = [t for t in trees.values() if len(t) >= least]
    return sorted(sorted(c) for t in trees for c in stable(t, forest, 0.0, len(trees) == 1)[1])


def blobs(seed, n=300, noise=60, d=6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, d)) * 2
    spread = [0.1, 0.25, 0.15, 0.4, 0.1]
    rows = [centres[i % 5] + spread[i % 5] * rng.standard_normal(d) + (0.35 * rng.choice([-1, 1]) if i % 5 == 3 else 0) for i in range(n - noise)]
    return np.array(rows + list(rng.standard_normal((noise, d)) * 2))


def clustered(spark, vectors, samples, least):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, embedding array<float>").repartition(3)
    index = neighbours.build(df, new_path(spark, "vectors"))
    hits = neighbours.search(index, df.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), samples, exclude_self=True).hits
    found = density.density_clusters(hits, df, samples, least).collect()
    assert sorted(r.id for r in found) == list(range(len(vectors)))
    groups = {}
    for r in found:
        groups.setdefault(r.cluster, []).append(r.id)
    groups.pop(-1, None)
    assert [len(groups[c]) for c in sorted(groups)] == sorted(map(len, groups.values()), reverse=True)
    return sorted(sorted(g) for g in groups.values())


@pytest.mark.parametrize(("seed", "samples", "least"), [(1, 5, 8), (2, 4, 15)])
def test_as_brute_force(spark, seed, samples, least):
    vectors = blobs(seed)
    wanted = brute(vectors, samples, least)
    assert clustered(spark, vectors, samples, least) == wanted and len(wanted) > 1


def test_slices_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(density, "SLICE", 60)
    vectors = blobs(3, 200, 40)
    vectors[::4] = vectors[0]  # a quarter of the rows are equal
    assert clustered(spark, vectors, 5, 8) == brute(vectors, 5, 8)


def test_forest(spark):
    rng = np.random.default_rng(5)
    edges = sorted({(float(rng.integers(1, 6)), *sorted(map(int, rng.choice(80, 2, replace=False)))) for _ in range(150)})
    light = {}
    for w, u, v in edges:
        light[u, v] = min(w, light.get((u, v), w))
    edges = sorted((w, u, v) for (u, v), w in light.items())
    df = spark.createDataFrame([(u, v, w) for w, u, v in edges], "u long, v long, weight double")
    assert sorted((r.weight, r.u, r.v) for r in density.spanning_forest(df).collect()) == forest_of(edges, 80)[0]
