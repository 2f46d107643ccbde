import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import simhash
from corvane.llm.queries import QUERIES
from tests.llm import cases


def expected_components(ids, fps):
    roots = cases.components(len(ids), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    least = {}
    for r, i in zip(roots, ids):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [least.get(r) for r in roots]


def test_fingerprint_is_as_defined():
    for _, text, *_ in cases.odd_documents():
        assert simhash.simhash(text, 4) == cases.fingerprint(text)


def test_odd_documents(spark):
    rows = simhash.components(cases.documents(spark, extra=True)).collect()
    docs = cases.odd_documents()
    assert len(rows) == len(docs)
    fps = [cases.fingerprint(r[1]) for r in docs]
    wanted = sorted(map(str, zip([r[0] for r in docs], fps, expected_components([r[0] for r in docs], fps))))
    assert sorted(str((r.id, r.fp % (1 << 64), r.component_id)) for r in rows) == wanted


@pytest.mark.parametrize("hot", [200_000, 40])
def test_links_are_those_of_all_pairs(spark, hot):
    rng = random.Random(hot)
    fps = set()
    for _ in range(60):
        centre = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            near = centre
            for _ in range(rng.randrange(0, 6)):
                near ^= 1 << rng.randrange(64)
            fps.add(near)
    fps = sorted(fps | {0, 1, (1 << 64) - 1})
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(4), 4, hot).collect()
    place = {f: i for i, f in enumerate(signed)}
    pairs = {frozenset((place[r.src], place[r.dst])) for r in links}
    got = cases.components(len(fps), lambda i, j: frozenset((i, j)) in pairs)
    assert got == cases.components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)


@pytest.mark.parametrize("one_key", [False, True])
def test_variants_are_made_in_bounded_slices(one_key):
    """However many rows a task or one of its keys has; the links stay those of all pairs."""
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << (52 if one_key else 63), 4_000, np.uint64))
    near = fps[:500] ^ (np.uint64(1) << rng.integers(0, 52, 500).astype(np.uint64))
    fps = np.concatenate([fps, np.setdiff1d(near, fps)])
    keys = (fps >> np.uint64(52)) << np.uint64(simhash.MORE + 1)
    order = np.argsort(keys, kind="stable")
    batch = pa.RecordBatch.from_arrays([pa.array(x[order].view(np.int64)) for x in (keys, fps)], ["key", "fp"])
    whole = simhash.linked(keys[order], fps[order], 2)
    tracemalloc.start()
    made = list(simhash.collide((batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)), 2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    child, root = (np.concatenate([b.column(i).to_numpy().view(np.uint64) for b in made]) for i in (0, 1))
    assert len(whole[0]) >= 400
    assert all((a == b).all() for a, b in zip(simhash.forest(root, child), whole))
    assert peak < 60e6


def test_one_of_each_group_stays(spark):
    docs = cases.documents(spark, extra=True)
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    told = simhash.components(docs).collect()
    assert len(rows) == len({r.component_id for r in told})
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted({r.component_id for r in told if r.component_id is not None})


def test_empty(spark):
    assert simhash.components(cases.documents(spark, [])).collect() == []
    assert simhash.near_dedup(cases.documents(spark, [])).collect() == []


def test_query(spark):
    rows = QUERIES["op1_simhash_near_dedup"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    fps = [int(r.fingerprint, 16) for r in rows]
    assert fps == [cases.fingerprint(texts[r.doc_id]) for r in rows]
    assert [r.component_id for r in rows] == expected_components([r.doc_id for r in rows], fps)
