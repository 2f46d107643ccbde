"""Hand-built rows for text, record, source and profile operators."""

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from corvane.functions import numeric, people
from corvane.functions import text as tx
from corvane.functions.stopwords import ENGLISH
from corvane.operators import graph, features, profile, records, sampling, stats
from corvane.plans import ranking, skew
from corvane.plans.runtime import new_path
from corvane.sources import scan, sink


def values(df):
    return [tuple(r) for r in df.collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, cleaned", [
    ("See http://x.org/a?b=1 and www.y.com now", "see and now"),
    ("the mass $m_{x}^2$ is", "the mass is"),
    ("bold \\textbf{word} and \\alpha here", "bold and here"),
    ("  A--B\n\tC\x0bD  ", "a b c d"),
    ("", ""),
    (None, None),
])
def test_clean(spark, raw, cleaned):
    assert one(spark, tx.clean(F.lit(raw).cast("string"))) == cleaned


def test_small_text_functions(spark):
    assert one(spark, tx.clean_alpha(F.lit("Ab1\ncd  E"))) == "ab cd e"
    assert one(spark, tx.squeeze(F.lit(" A \n b "))) == "a b"
    assert one(spark, tx.truncated(F.lit("aaa  bbb ccc"), 8)) == "aaa bbb…"
    assert one(spark, tx.truncated(F.lit(None).cast("string"), 8)) == ""
    assert one(spark, tx.html_escaped(F.lit("a<b & c>"))) == "a&lt;b &amp; c&gt;"
    assert one(spark, tx.csv_quoted(F.lit('a "b"'))) == '"a ""b"""'
    assert one(spark, tx.safe_file_name(F.lit("é/x y.z"))) == "é_x_y.z"
    assert one(spark, tx.word_grams(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == ["a", "b", "c", "a b", "b c"]
    assert one(spark, tx.word_grams(F.array(F.lit("a")))) == ["a"]
    assert one(spark, tx.main_category(F.lit("math.AG"))) == "math"


def test_stop_words_are_sparks(spark):
    assert list(ENGLISH) == StopWordsRemover.loadDefaultStopWords("english")


@pytest.mark.parametrize("created, year", [
    ("Mon, 2 Apr 2007 19:18:42 GMT", 2007), ("Tue, 12 Dec 1995 00:00:00 GMT", 1995), ("yesterday", None), (None, None)])
def test_created_year(spark, created, year):
    assert one(spark, people.created_year(F.lit(created).cast("string"))) == year


def test_ragged_authors(spark):
    df = spark.createDataFrame([(1, [["Ng", "A.", "Jr"], ["Li"], []]), (2, [["", ""]]), (3, None)],
                               "id int, authors_parsed array<array<string>>")
    assert sorted(values(records.exploded_authors(df))) == [(1, "Li"), (1, "Ng A."), (2, " ")]
    assert (1, "Ng A. Jr") in values(records.exploded_authors(df, people.long_name))
    row = profile.missing_author_parts(df).first()
    assert (row.lists_null, row.authors_null, row.surname_missing, row.max_parts) == (1, 1, 3, 3)


def test_missing_values(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "", "x"), (3, None, "y")], "id int, a string, b string")
    assert values(profile.null_counts(df)) == [(0, 1, 1)]
    assert values(profile.missing_counts(df)) == [(0, 2, 1)]
    differing = spark.createDataFrame([(1, "a", None), (1, "b", None), (2, "a", "x"), (2, "a", None)], df.schema)
    assert sorted(values(profile.duplicate_differences(differing))) == [(1, "a", 2), (2, "b", 2)]


def test_non_negative_long(spark):
    df = spark.createDataFrame([("5",), ("-1",), ("x",), (None,)], "c string")
    assert [r[0] for r in df.select(numeric.non_negative_long(F.col("c"))).collect()] == [5, None, None, None]


def test_edge_lines_and_adjacency(spark):
    path = new_path(spark, "edges")
    spark.createDataFrame([("src,dst",), ("a,b,c",), ("nocomma",), ("x,",)], "value string").coalesce(1).write.text(path)
    assert sorted(values(scan.read_edges(spark, path))) == [("a", "b,c"), ("x", "")]
    lists = spark.createDataFrame([("p/1", ["a", None, "b"]), ("q/1", None), ("q/2", ["c"]), ("plain", ["d"])],
                                  "src string, refs array<string>")
    assert sorted(values(scan.adjacency_edges(lists))) == [("p/1", "a"), ("p/1", "b"), ("plain", "d"), ("q/2", "c")]
    assert values(scan.adjacency_edges(lists, keep=["q"])) == [("q/2", "c")]
    assert scan.adjacency_edges(lists, max_edges=1).count() == 1
    assert sorted(values(scan.source_categories(lists))) == [("p",), ("q",)]
    assert scan.citation_column(lists) is None


def test_append_log_new_row_wins(spark):
    first = spark.createDataFrame([("a", 1), ("b", 2)], "config string, n int")
    second = spark.createDataFrame([("b", 3, 0.5)], "config string, n int, f double")
    path = sink.append_log(spark, sink.append_log(spark, None, first, "config"), second, "config")
    assert sorted(values(sink.read_log(spark, path, "config").select("config", "n", "f"))) == [("a", 1, None), ("b", 3, 0.5)]
    parts = spark.read.option("mergeSchema", True).parquet(path)
    assert parts.count() == 3  # an append writes its own rows only


def test_materialised_builds_once(spark):
    path, calls = new_path(spark, "once"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert sink.materialised(spark, path, build).count() == sink.materialised(spark, path, build).count() == 3
    assert len(calls) == 1


def test_a_write_that_was_killed_is_built_again(spark):
    """Between the files and the marker, and between the files of one write."""
    path = new_path(spark, "killed")
    spark.range(2).write.parquet(path)
    assert not sink.committed(spark, path)
    assert sink.materialised(spark, path, lambda: spark.range(3)).count() == 3
    assert sink.committed(spark, path) and sink.materialised(spark, path, lambda: spark.range(9)).count() == 3


def test_kept_once_follows_its_sources(spark):
    source, built = new_path(spark, "source"), []

    def build(folder):
        built.append(folder)
        if len(built) == 1:
            raise RuntimeError("lost")
        spark.read.parquet(source).write.parquet(folder)

    spark.range(4).write.parquet(source)
    with pytest.raises(RuntimeError):
        sink.kept_once(spark, "derived", [source], build)
    first = sink.kept_once(spark, "derived", [source], build)
    assert sink.kept_once(spark, "derived", [source], build) == first and len(built) == 2
    spark.range(6).write.mode("overwrite").parquet(source)
    second = sink.kept_once(spark, "derived", [source], build)
    assert second != first and spark.read.parquet(second).count() == 6


def test_partitioned_csv_round_trip(spark):
    path = new_path(spark, "csv")
    df = spark.createDataFrame([("x", 'he said "a, b"'), ("y", "z")], "c string, text string")
    sink.write_partitioned_csv(df, path, "c")
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert sorted(values(back.select("c", "text"))) == sorted(values(df))


def test_running_total_and_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    rows = values(ranking.running_total(df, [F.col("k")], F.col("k"), "t").select("k", "t"))
    assert all(t == k * (k + 1) // 2 for k, t in rows)
    assert all(k + 1 == r for k, r in values(ranking.global_rank(df, [F.col("k")])))


@pytest.mark.parametrize("k", [3, 1200])
def test_top_k_per_group_with_hot_group(spark, k):
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(99).alias("g"), "id")
    got = ranking.top_k_per_group(df, ["g"], [F.desc("id")], k)
    expected = {}
    for g, i in values(df):
        expected.setdefault(g, []).append(i)
    for g, ids in expected.items():
        want = sorted(ids, reverse=True)[:k]
        assert [r.id for r in got.where(F.col("g") == g).orderBy("rank").collect()] == want


def test_hot_key_join_equals_join(spark):
    big = spark.range(5000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 2000).alias("k"), "id")
    per_key = big.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    got = skew.hot_key_join(big, per_key, "k", "n", 5000).select("k", "id", "v")
    assert sorted(values(got)) == sorted(values(big.join(per_key, "k").select("k", "id", "v")))


def test_pairs_of_a_large_group(spark):
    rows = [(1, f"a{i:04d}") for i in range(600)] + [(2, "a0001"), (2, "a0002"), (2, "a0002"), (3, "a0001")]
    df = spark.createDataFrame(rows, "g int, m string")
    counts = {(a, b): n for a, b, n in values(stats.pair_counts(df, "g", "m"))}
    assert len(counts) == 600 * 599 // 2
    assert counts[("a0001", "a0002")] == 2 and counts[("a0003", "a0599")] == 1
    assert values(stats.top_pairs(df, "g", "m", 1, probe=5)) == [("a0001", "a0002", 2)]
    assert stats.pair_counts(df, "g", "m", max_size=50).count() == 1


def test_pretty_categories(spark):
    df = spark.createDataFrame([(1, "a.x  b a.x"), (2, None), (3, "")], "id int, categories string")
    names = spark.createDataFrame([("a.x", "Alpha", "A"), ("c", None, "C")],
                                  "category_id string, pretty_name string, group_name string")
    shown = records.with_pretty_categories(df, names).orderBy("id")
    assert [r.pretty_categories for r in shown.collect()] == ["Alpha; b", None, ""]


def test_pretty_categories_with_repeated_keys_and_a_hot_string(spark):
    df = spark.createDataFrame([("x", "a b"), ("x", "c a")] + [("y", "a b")] * 3000, "id string, categories string")
    names = spark.createDataFrame([("a", "Z", "g"), ("a", "A", "g")], "category_id string, pretty_name string, group_name string")
    shown = records.with_pretty_categories(df, names).groupBy("id", "pretty_categories").count()
    assert sorted(values(shown)) == [("x", "A; b", 1), ("x", "c; A", 1), ("y", "A; b", 3000)]


def test_samples(spark):
    df = spark.range(2000).select("id", (F.col("id") % 2).alias("c"))
    kept = sampling.per_class_exact(df, "c", "id", 100)
    assert values(kept.groupBy("c").count().orderBy("c")) == [(0, 100), (1, 100)]
    train, test = sampling.hash_split(df, "id")
    assert train.count() + test.count() == 2000 and train.join(test, "id").isEmpty()
    assert sorted(values(train)) == sorted(values(sampling.hash_split(df.repartition(13), "id")[0]))
    assert sampling.fixed_size(df, 10).count() == 10


def test_lemmas(spark):
    docs = spark.createDataFrame([(1, "The cats running x9 far"), (2, ""), (3, "cats")], "id int, text_clean string")
    lemmas = spark.createDataFrame([("cats", "cat"), ("running", "run")], "form string, lemma string")
    assert sorted(values(features.lemmatised(docs, lemmas))) == [(1, "cat run far"), (2, ""), (3, "cat")]


def test_lemmas_with_repeated_keys_a_hot_form_and_two_lemmas(spark):
    rows = [(1, "cats run"), (1, "dogs"), (1, "dogs"), (None, "cats")] + [(i, "cats " * 40) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "id int, text_clean string")
    lemmas = spark.createDataFrame([("cats", "zat"), ("cats", "cat"), ("dogs", "dog")], "form string, lemma string")
    got = sorted(values(features.lemmatised(docs, lemmas)), key=str)
    want = [(1, "cat run"), (1, "dog"), (1, "dog"), (None, "cat")] + [(i, " ".join(["cat"] * 40)) for i in range(2, 60)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("most", [1, 2, 1000])
def test_lemmas_of_a_dictionary_larger_than_a_task_gets(spark, monkeypatch, most):
    """Some slices; lemmas that are forms themselves, empty, null, with a space, or not better than the form."""
    monkeypatch.setattr(features, "LEMMAS", most)
    docs = spark.createDataFrame([(1, "cats dogs mice geese oxen fish x9"), (2, None), (None, "mice mice"), (3, "unlisted")], "id int, text_clean string")
    lemmas = [("cats", "dogs"), ("dogs", "mice"), ("mice", " mouse"), ("geese", ""), ("oxen", None), ("fish", "zish"), ("fish", "fish"), ("x9", "x"), (None, "none")]
    lemmas += [(f"absent{chr(97 + i)}", "present") for i in range(20)]
    got = sorted(values(features.lemmatised(docs, spark.createDataFrame(lemmas, "form string, lemma string"))), key=str)
    assert got == sorted([(1, "dogs mice  mouse  oxen fish"), (2, ""), (None, " mouse  mouse"), (3, "unlisted")], key=str)


def test_lemmas_leave_texts_where_they_are(spark):
    docs = spark.range(50).selectExpr("id", "concat('cats ', id, ' run') AS text_clean")
    lemmas = spark.createDataFrame([("cats", "cat")], "form string, lemma string")
    plan = features.lemmatised(docs, lemmas)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_loops_settle(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long")
    assert graph.k_core(path, 2).isEmpty()
    with pytest.raises(RuntimeError):
        graph.page_rank(path, tolerance=1e-12, max_rounds=2)


def test_clipped_histogram_counts_every_kept_value(spark):
    df = spark.range(5000).select("id", (F.col("id") % 40).cast("string").alias("c"))
    bins = stats.clipped_histogram(df, F.col("c"), "id", fraction=1.0)
    assert bins.agg(F.sum("n")).first()[0] == 5000 and bins.agg(F.max("high")).first()[0] == pytest.approx(39.0)


@pytest.mark.parametrize("k", [0, 1, 9, 10, 57, 200, 201, 500])
def test_first_rows_as_a_sort(spark, k):
    """Ties in the coarse key at the cut, none there, and more asked than there is."""
    rows = [(i, i * i % 7, f"t{i * 37 % 200:03d}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, total long, term string").repartition(5)
    found = ranking.first_rows(df, [F.desc("total"), F.col("term")], -F.col("total"), k)
    assert sorted(values(found)) == sorted(sorted(rows, key=lambda r: (-r[1], r[2]))[:k])
    assert found.columns == df.columns


def test_rows_of_a_period_are_not_brought_to_one_task(spark):
    docs = spark.range(100).withColumn("year", F.lit(2000)).repartition(4)
    kept = records.in_periods(docs, [(1999, 2001), (2005, 2006)], 5)
    assert kept.count() == 100
    assert kept.select(F.spark_partition_id()).distinct().count() == 4


def test_pairs_decide_the_number_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(stats, "TASK_PAIRS", 100)
    rows = spark.createDataFrame([(g, m) for g in range(10) for m in range(20)], "g long, m long").coalesce(1)
    found = stats.member_pairs(rows, "g", "m")  # 1900 pairs
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 1900 and max(sizes) < 1900 / 2
    assert {r["n"] for r in stats.pair_counts(rows, "g", "m").collect()} == {10}
