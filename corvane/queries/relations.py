"""Joins, windows, top-k, sampling, set operations (J, W, K, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import people
from corvane.functions import text as tx
from corvane.operators import profile, records, sampling, stats
from corvane.plans.ranking import best_per_group, top_k_per_group
from corvane.queries.registry import query


@query("J01_docs_lemmas", """
    SELECT c.id, c.label_str, d.n_chars FROM clean_docs c JOIN documents d ON c.id = d.doc_id WHERE c.text_clean <> ''""")
def _(t):
    lemmas = t.documents.select(F.col("doc_id").alias("id"), "n_chars")
    docs = t.clean_docs().where(F.col("text_clean") != "").select("id", "label_str")
    return docs.join(lemmas, "id")


@query("J02_left_join_years", """
    SELECT a.id, a.author, CAST(y.yr AS INTEGER) AS year FROM paper_authors a LEFT JOIN paper_years y ON a.id = y.id""")
def _(t):
    years = records.with_created_year(t.dated_papers()).select("id", "year")
    return t.paper_authors().join(years, "id", "left")


@query("J03_right_join_ids", """
    SELECT w.id, p.categories FROM dated_papers p RIGHT JOIN (
      SELECT l_partkey AS id FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 100) w ON p.id = w.id""")
def _(t):
    wanted = records.top_values(t.lineitem.select(F.col("l_partkey").alias("id")), "id", 100).select("id")
    return t.dated_papers().select("id", "categories").join(wanted, "id", "right").select("id", "categories")


@query("J04_authors_categories", """
    SELECT author, c AS category, CAST(count(*) AS BIGINT) AS n FROM paper_authors
    JOIN (SELECT id, unnest(string_split(categories, ' ')) AS c FROM dated_papers) USING (id) GROUP BY 1, 2""")
def _(t):
    cats = records.exploded_categories(t.dated_papers(), "id")
    return t.paper_authors().join(cats, "id").groupBy("author", "category").agg(F.count("*").alias("n"))


@query("J05_double_dictionary", """
    SELECT e.event_type AS label, coalesce(n.n_name, 'none') AS label_name, r.r_name AS prediction_name,
           CAST(count(*) AS BIGINT) AS n
    FROM events e LEFT JOIN nation n ON n.n_nationkey = e.user_id LEFT JOIN region r ON r.r_regionkey = e.event_id % 5
    GROUP BY 1, 2, 3""")
def _(t):
    pairs = (t.events.groupBy(F.col("event_type").alias("label"), F.col("user_id"),
                              (F.col("event_id") % 5).alias("guess")).agg(F.count("*").alias("n")))
    named = (pairs.join(t.nation.select(F.col("n_nationkey").alias("user_id"), "n_name"), "user_id", "left")
             .join(t.region.select(F.col("r_regionkey").alias("guess"), "r_name"), "guess", "left"))
    return (named.groupBy("label", F.coalesce("n_name", F.lit("none")).alias("label_name"),
                          F.col("r_name").alias("prediction_name")).agg(F.sum("n").alias("n")))


@query("J07_metadata_lookup", """
    SELECT d.doc_id AS id, d.source, d.n_chars FROM documents d
    JOIN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) h ON d.doc_id = h.doc_id""")
def _(t):
    hits = t.labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")
    found = t.documents.join(hits, "doc_id", "left_semi")
    return found.select(F.col("doc_id").alias("id"), "source", "n_chars")


@query("J11_group_pairs", """
    SELECT a.author AS a1, b.author AS a2, CAST(count(*) AS BIGINT) AS n
    FROM paper_authors a JOIN paper_authors b ON a.id = b.id AND a.author < b.author GROUP BY 1, 2""")
def _(t):
    return stats.pair_counts(t.paper_authors(), "id", "author")


@query("J12_aligned_by_key", """
    SELECT d.doc_id AS id, d.lang, e.label, c.label_str FROM documents d
    JOIN embeddings e ON e.vec_id = d.doc_id JOIN clean_docs c ON c.id = d.doc_id""")
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), "lang")
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), "label")
    return docs.join(vectors, "id").join(t.clean_docs().select("id", "label_str"), "id")


@query("W01_latest_version", """
    SELECT id, update_date, l_partkey, l_suppkey, l_returnflag, l_linestatus FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY update_date DESC, l_partkey DESC, l_suppkey DESC) AS rn
      FROM paper_versions) WHERE rn = 1""")
def _(t):
    order = [F.col("update_date"), F.col("l_partkey"), F.col("l_suppkey")]
    return profile.latest_per_key(t.paper_versions(), "id", order)


@query("W03_rank_in_group", """
    SELECT * FROM (SELECT user_id, event_id, value,
      CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS BIGINT) AS rank FROM events)
    WHERE rank <= 5""")
def _(t):
    scored = t.events.select("user_id", "event_id", "value")
    return top_k_per_group(scored, ["user_id"], [F.desc("value"), F.col("event_id")], 5)


@query("W03_rank_in_group_deep", """
    SELECT * FROM (SELECT event_type, event_id, value,
      CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS BIGINT) AS rank FROM events)
    WHERE rank <= 1500""")
def _(t):
    scored = t.events.select("event_type", "event_id", "value")
    return top_k_per_group(scored, ["event_type"], [F.desc("value"), F.col("event_id")], 1500)


@query("K01_top_values", """
    SELECT token, CAST(count(*) AS BIGINT) AS n FROM tokens GROUP BY token ORDER BY n DESC, token LIMIT 50""")
def _(t):
    tokens = tx.exploded(t.clean_docs(), F.split("text_clean", " "), "token").where(F.col("token") != "")
    return records.top_values(tokens, "token", 50)


@query("K02_top_degrees", """
    SELECT src, CAST(count(*) AS BIGINT) AS n FROM citations GROUP BY src ORDER BY n DESC, src LIMIT 20""")
def _(t):
    return records.top_values(t.citations(), "src", 20)


@query("K03_top_papers", """
    (SELECT 'authors' AS kind, id, CAST(len(authors_parsed) AS BIGINT) AS n FROM nested_papers ORDER BY n DESC, id LIMIT 50)
    UNION ALL (SELECT 'categories', id, CAST(len(string_split(categories, ' ')) AS BIGINT) AS n FROM papers ORDER BY n DESC, id LIMIT 50)
    UNION ALL (SELECT 'citations', id, CAST(citations AS BIGINT) AS n FROM dated_papers ORDER BY n DESC, id LIMIT 50)""")
def _(t):
    def top(kind, df, value):
        sized = df.select(F.lit(kind).alias("kind"), "id", value.cast("bigint").alias("n"))
        return sized.orderBy(F.desc("n"), "id").limit(50)

    return (top("authors", t.nested_papers(), F.size("authors_parsed"))
            .union(top("categories", t.papers(), F.size(tx.category_list(F.col("categories")))))
            .union(top("citations", t.dated_papers(), F.col("citations").try_cast("bigint"))))


@query("K04_sorted", "SELECT id, update_date, citations FROM dated_papers ORDER BY update_date, id")
def _(t):
    return t.dated_papers().select("id", "update_date", "citations").orderBy("update_date", "id")


@query("K05_bernoulli_sample")
def _(t):
    return sampling.bernoulli(t.events, 0.25).groupBy("event_type").agg(F.count("*").alias("n"))


@query("K06_fixed_size_sample")
def _(t):
    return sampling.fixed_size(t.events.select("event_id", "event_type"), 500)


@query("K07_per_class_sample", """
    SELECT event_id, event_type FROM (
      SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type
             ORDER BY md5(concat('42:', CAST(event_id AS VARCHAR))), event_id) AS rn FROM events) WHERE rn <= 200""")
def _(t):
    return sampling.per_class_exact(t.events.select("event_id", "event_type"), "event_type", "event_id", 200)


@query("K07_per_class_sample_approximate")
def _(t):
    kept = sampling.per_class_approximate(t.events.select("event_id", "event_type"), "event_type", 200)
    return kept.groupBy("event_type").agg(F.count("*").alias("n"))


@query("K08_hash_split", """
    SELECT event_type, CAST(count(*) FILTER (p < 'cccccccd') AS BIGINT) AS train,
           CAST(count(*) FILTER (p >= 'cccccccd') AS BIGINT) AS test
    FROM (SELECT event_type, substring(md5(concat('42:', CAST(event_id AS VARCHAR))), 1, 8) AS p FROM events)
    GROUP BY event_type""")
def _(t):
    train, test = sampling.hash_split(t.events.select("event_id", "event_type"), "event_id")
    both = train.withColumn("side", F.lit("train")).union(test.withColumn("side", F.lit("test")))
    return both.groupBy("event_type").agg(F.count_if(F.col("side") == "train").alias("train"),
                                          F.count_if(F.col("side") == "test").alias("test"))


@query("K08_random_split")
def _(t):
    train, test = sampling.random_split(t.events)
    return (train.groupBy("event_type").agg(F.count("*").alias("train"))
            .join(test.groupBy("event_type").agg(F.count("*").alias("test")), "event_type"))


@query("U01_union_by_name", """
    SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""")
def _(t):
    people_rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                                    F.col("c_mktsegment").alias("segment"))
    others = t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return people_rows.unionByName(others, allowMissingColumns=True)


@query("U02_distinct_edges", "SELECT DISTINCT src, dst FROM citations")
def _(t):
    return t.citations().distinct()


@query("U02_first_seen", """
    SELECT category, id FROM (SELECT id, c AS category, row_number() OVER (PARTITION BY c ORDER BY id) AS rn
      FROM (SELECT id, unnest(string_split(categories, ' ')) AS c FROM papers)) WHERE rn = 1""")
def _(t):
    cats = records.exploded_categories(t.papers(), "id")
    return best_per_group(cats.select("category", "id"), ["category"], [-F.col("id")])
