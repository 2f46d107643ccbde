
import __spark_entry__ as entry
import corpus_pipeline as pipeline
from corvane.llm import spaced, toxicity
from tests.llm import cases
from tests.llm.test_mixing import check
from tests.llm.test_spaced import ITEMS, shared_items

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute(rows, score, cut, items):
    """The documents (id, text, ...) that each stage leaves, in order of ids; ids are distinct."""
    rows = sorted(rows, key=lambda r: r[0])
    out = {"toxicity": (rows := [r for r in rows if score(r[1])[1] < cut])}
    texts = cases.deduplicated([r[:2] for r in rows])
    rows = [(r[0], texts[r[0]], *r[2:4], r[4] if texts[r[0]] == r[1] else len(texts[r[0]])) for r in rows
            if texts[r[0]] == r[1] or cases.words(texts[r[0]])]
    out["line_dedup"] = rows
    fps = [cases.fingerprint(r[1]) for r in rows]
    roots = cases.components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    out["simhash_near_dedup"] = rows = [r for i, r in enumerate(rows) if roots[i] == i]
    out["benchmark_decontamination"] = [r for r in rows if not shared_items(r[1], items)]
    return out


def test_stages_as_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chain = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), toxicity.given_categories())
    items = [(r.item_id, spaced.tokens(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    wanted = brute([tuple(r) for r in docs.collect()], chain.scorer(), chain.cuts[1], items)
    for name, stage in pipeline.STAGES[:-1]:
        done = stage(spark, docs, SF)
        assert done.columns == COLUMNS
        rows = sorted((tuple(r) for r in done.collect()), key=lambda r: r[0])
        assert rows == wanted[name], name
        docs = spark.createDataFrame(rows, docs.schema)
    check(pipeline.STAGES[-1][1](spark, docs, SF).collect(), [(r[1], r[3]) for r in rows])


def test_run_is_the_registered_query(spark):
    assert entry.queries()["pipeline"] is pipeline.run
    rows = pipeline.run(spark, SF).collect()
    assert 0 < len(rows) < 200 and len({r.doc_id for r in rows}) == len(rows)


def tables(spark, folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_odd_documents_extra_columns_and_empty_tables(spark, tmp_path):
    item = cases.prose(77, 40)
    rows = [*cases.odd_documents(), (50, cases.prose(3, 40) + " " + item, "en", "a", 0)]
    docs = cases.documents(spark, rows, extra=True)
    folder = tables(spark, tmp_path / "odd", docs, [(0, 1, 0), (None, None, 1)], [(1, item, "x"), (None, None, None)])
    for name, stage in pipeline.STAGES:
        done = stage(spark, docs, folder)
        if name != pipeline.STAGES[-1][0]:
            assert done.columns == docs.columns
            docs = done
    assert 50 not in {r.doc_id for r in done.collect()}
    folder = tables(spark, tmp_path / "empty", cases.documents(spark, []), [], [])
    assert pipeline.run(spark, folder).collect() == []
