"""Text features with SQL twins and similar-document search."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.numeric import r6
from corvane.functions.stopwords import ENGLISH
from corvane.operators import features, neighbours, search, textindex
from corvane.plans.runtime import new_path
from corvane.queries.registry import query
from corvane.queries.views import Tables, clean_sql
from corvane.sources import sink

QUERY_DOCS = (3, 41, 128, 150, 177)  # in the tables of every size
IDS = ", ".join(map(str, QUERY_DOCS))


def stop_list() -> str:
    quoted = ["'" + w.replace("'", "''") + "'" for w in ENGLISH]
    return "(" + ", ".join(quoted) + ")"


def named_queries(t: Tables):
    """The benchmark passages as query texts."""
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


# ---- features ------------------------------------------------------------------------------------------------

@query("T01_tokens", "SELECT id, token, CAST(count(*) AS BIGINT) AS tf FROM tokens WHERE length(token) >= 3 GROUP BY 1, 2")
def _(t):
    tokens = features.tokenised(t.clean_docs(), min_length=3)
    return features.term_counts(tokens).withColumnRenamed("term", "token")


@query("T02_stop_words", f"""
    SELECT id, CAST(count(token) AS BIGINT) AS n FROM (
      SELECT c.id, k.token FROM clean_docs c LEFT JOIN tokens k ON k.id = c.id AND k.token NOT IN {stop_list()}) GROUP BY id""")
def _(t):
    kept = features.tokenised(t.clean_docs(), drop_stop_words=True)
    return kept.select("id", F.size("tokens").cast("bigint").alias("n"))


@query("T03_grams", """
    WITH w AS (SELECT id, list_filter(string_split(text_clean, ' '), lambda x: x <> '') AS words FROM clean_docs),
         pos AS (SELECT id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
         grams AS (SELECT id, word AS gram FROM pos UNION ALL
                   SELECT a.id, concat(a.word, ' ', b.word) FROM pos a JOIN pos b ON a.id = b.id AND b.i = a.i + 1)
    SELECT gram, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT id) AS BIGINT) AS df FROM grams GROUP BY gram""")
def _(t):
    grams = features.tokenised(t.clean_docs()).select("id", tx.word_grams(F.col("tokens")).alias("tokens"))
    counts = features.term_counts(grams)
    return counts.groupBy(F.col("term").alias("gram")).agg(F.sum("tf").alias("n"), F.count("*").alias("df"))


@query("T06_idf", """
    SELECT token AS term, CAST(count(DISTINCT id) AS BIGINT) AS df,
           round(ln(((SELECT count(*) FROM clean_docs) + 1.0) / (count(DISTINCT id) + 1.0)), 6) AS idf
    FROM tokens GROUP BY token""")
def _(t):
    docs = features.tokenised(t.clean_docs())
    df = features.document_frequency(features.term_counts(docs))
    idf = features.smoothed_idf(docs.agg(F.count("*")).scalar(), F.col("df"))
    return df.select("term", "df", r6(idf).alias("idf"))


@query("T06_term_weights", """
    WITH tf AS (SELECT id, token AS term, count(*) AS tf FROM tokens GROUP BY 1, 2),
         df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 5)
    SELECT id, term, CAST(tf AS BIGINT) AS tf,
           round(tf * ln(((SELECT count(*) FROM clean_docs) + 1.0) / (df + 1.0)), 6) AS weight FROM tf JOIN df USING (term)""")
def _(t):
    weights = features.term_weights(features.tokenised(t.clean_docs()), min_doc_freq=5)
    return weights.withColumn("weight", r6(F.col("weight")))


@query("T07_label_index", """
    SELECT id, label_str, CAST(i AS DOUBLE) AS label FROM clean_docs JOIN (
      SELECT label_str AS l, row_number() OVER (ORDER BY count(*) DESC, label_str) - 1 AS i FROM clean_docs
      GROUP BY label_str) ON l = label_str""")
def _(t):
    docs = t.clean_docs().select("id", "label_str")
    return features.label_indexer().fit(docs).transform(docs)


LEMMA_SQL = f"""
    SELECT c.id, coalesce(string_agg(coalesce(d.lemma, w.word), ' ' ORDER BY w.i), '') AS text
    FROM clean_docs c LEFT JOIN (
      SELECT id, word, i FROM (SELECT id, unnest(words) AS word, generate_subscripts(words, 1) AS i
                               FROM (SELECT id, string_split(text_clean, ' ') AS words FROM clean_docs))
      WHERE regexp_matches(word, '^[a-z]+$') AND word NOT IN {stop_list()}) w ON w.id = c.id
    LEFT JOIN lemma_dict d ON d.form = w.word GROUP BY c.id"""


@query("T11_lemmatised", LEMMA_SQL)
def _(t):
    return features.lemmatised(t.clean_docs(), t.lemma_dict())


@query("T11_lemmatised_large_dictionary", LEMMA_SQL)
def _(t):
    return features.lemmatised(t.clean_docs().repartition("id"), t.lemma_dict())


@query("T13_max_term_weights", """
    WITH tf AS (SELECT id, token AS term, count(*) AS tf FROM tokens GROUP BY 1, 2),
         n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM clean_docs),
         vocab AS (SELECT term, ln((n + 1.0) / (df + 1.0)) + 1.0 AS idf FROM (
             SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term), n
           WHERE df <= 0.9 * n AND df >= 0.001 * n ORDER BY total DESC, term LIMIT 30000),
         raw AS (SELECT id, term, tf * idf AS w FROM tf JOIN vocab USING (term)),
         len AS (SELECT id, sqrt(sum(w * w)) AS l FROM raw GROUP BY id)
    SELECT id, term, round(w / l, 6) AS weight FROM raw JOIN len USING (id)""")
def _(t):
    weights = features.max_term_weights(features.tokenised(t.clean_docs()))
    return weights.withColumn("weight", r6(F.col("weight")))


# ---- TF-IDF and BM25 -----------------------------------------------------------------------------------------

QTOKENS = {
    "named": f"""qtok AS MATERIALIZED (SELECT query_id, k.term FROM (
        SELECT item_id AS query_id, {clean_sql('text')} AS q FROM benchmark), unnest(string_split(q, ' ')) AS k(term)
        WHERE k.term <> '')""",
    "docs": f"qtok AS MATERIALIZED (SELECT id AS query_id, token AS term FROM tokens WHERE id IN ({IDS}))",
}


def cosine_sql(source: str, k: int, min_df: int, where: str = "true") -> str:
    return f"""
    WITH {QTOKENS[source]},
      tf AS MATERIALIZED (SELECT id, token AS term, count(*) AS tf FROM tokens GROUP BY 1, 2),
      idf AS MATERIALIZED (SELECT term, ln(((SELECT count(*) FROM clean_docs) + 1.0) / (count(*) + 1.0)) AS idf
                           FROM tf GROUP BY term HAVING count(*) >= {min_df}),
      w AS MATERIALIZED (SELECT id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
      qw AS MATERIALIZED (SELECT query_id, term, count(*) * any_value(idf) AS qw FROM qtok JOIN idf USING (term) GROUP BY 1, 2),
      len AS (SELECT id, sqrt(sum(w * w)) AS l FROM w GROUP BY id),
      qlen AS (SELECT query_id, sqrt(sum(qw * qw)) AS ql FROM qw GROUP BY query_id),
      scored AS MATERIALIZED (SELECT query_id, id AS doc_id, dot / (l * ql) AS score FROM (
          SELECT query_id, id, sum(w * qw) AS dot FROM w JOIN qw USING (term) GROUP BY 1, 2)
        JOIN len USING (id) JOIN qlen USING (query_id) WHERE l * ql > 0)
    SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
      FROM scored WHERE {where}) WHERE rank <= {k}"""


def bm25_ctes(source: str) -> str:
    return f"""{QTOKENS[source]},
      tf AS MATERIALIZED (SELECT id, token AS term, count(*) AS tf FROM tokens GROUP BY 1, 2),
      dl AS MATERIALIZED (SELECT id, sum(tf) AS dl FROM tf GROUP BY id),
      st AS MATERIALIZED (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
      df AS MATERIALIZED (SELECT term, count(*) AS df FROM tf GROUP BY term),
      qw AS MATERIALIZED (SELECT query_id, term, count(*) * any_value(ln(1.0 + (n - df + 0.5) / (df + 0.5))) AS w
                          FROM qtok JOIN df USING (term), st GROUP BY 1, 2),
      scored AS MATERIALIZED (SELECT query_id, id AS doc_id,
          sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
        FROM tf JOIN qw USING (term) JOIN dl USING (id), st GROUP BY 1, 2)"""


def hits_sql(scored: str, k: int, where: str = "true") -> str:
    return f"""SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
      FROM {scored} WHERE {where}) WHERE rank <= {k}"""


def shown(hits):
    return hits.withColumn("score", r6(F.col("score")))


@query("V01_tfidf_by_text", cosine_sql("named", 20, 3))
def _(t):
    return shown(search.tfidf_search(t.clean_docs(), named_queries(t), 20, min_doc_freq=3))


@query("V02_tfidf_by_document", cosine_sql("docs", 20, 3, "query_id <> doc_id"))
def _(t):
    return shown(search.tfidf_like(t.clean_docs(), QUERY_DOCS, 20, min_doc_freq=3))


def text_index(t: Tables) -> textindex.TextIndex:
    """The stored index of the clean documents: built when the tables are new, then only read."""
    files = [f"{t.sf_dir}/{name}.parquet" for name in ("documents", "labels")]
    return textindex.opened(t.spark, sink.kept_once(t.spark, "text-index-4", files, lambda path: textindex.build(t.clean_docs(), path)))


def bm25_like(t: Tables, k: int):
    """Top k documents for the texts of the query documents, themselves left out and ranks closed up."""
    queries = search.stored_texts(t.clean_docs(), QUERY_DOCS, "id", "text_clean")
    return search.ranked(search.without_self(textindex.search(text_index(t), queries, k + 1)), k)


@query("V03_bm25_by_text", f"WITH {bm25_ctes('named')} " + hits_sql("scored", 20))
def _(t):
    return shown(textindex.search(text_index(t), named_queries(t), 20))


@query("V04_bm25_by_document", f"WITH {bm25_ctes('docs')} " + hits_sql("scored", 20, "query_id <> doc_id"))
def _(t):
    return shown(bm25_like(t, 20))


@query("V05_inverted_index", """
    WITH tf AS (SELECT id, token AS term, count(*) AS tf FROM tokens GROUP BY 1, 2)
    SELECT term, id AS doc_id, CAST(tf AS BIGINT) AS tf, CAST(sum(tf) OVER (PARTITION BY id) AS BIGINT) AS doc_length FROM tf""")
def _(t):
    return search.write_index(search.inverted_index(t.clean_docs(), "id", "text_clean"), new_path(t.spark, "index"))


# ---- embeddings ----------------------------------------------------------------------------------------------

def dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def cos_sql(a: str, b: str) -> str:
    return f"{dot_sql(a, b)} / (sqrt({dot_sql(a, a)}) * sqrt({dot_sql(b, b)}))"


KNN = f"""scored AS MATERIALIZED (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, {cos_sql('q.embedding', 'e.embedding')} AS score
    FROM embeddings q, embeddings e WHERE q.vec_id IN ({IDS}))"""
HALF = "embedding[1:32]"


def half_space(t: Tables):
    """A second embedding space over the same documents: the first 32 dimensions at length 1."""
    part = F.slice("embedding", 1, 32)
    return t.embeddings.select("vec_id", F.transform(part, lambda v: v.cast("double")).alias("embedding"))


def stored(t: Tables):
    return search.stored_vectors(t.embeddings, QUERY_DOCS, "vec_id")


@query("V06_nearest_by_vector", f"WITH {KNN} " + hits_sql("scored", 20))
def _(t):
    return shown(search.nearest(t.embeddings, stored(t), 20, "vec_id"))


@query("V07_nearest_by_document", f"WITH {KNN} " + hits_sql("scored", 20, "query_id <> doc_id"))
def _(t):
    return shown(search.nearest_to(t.embeddings, QUERY_DOCS, 20, key="vec_id"))


def vector_index(t: Tables) -> neighbours.VectorIndex:
    """The stored index of the embeddings: built when the table is new, then only read."""
    return neighbours.opened(t.spark, sink.kept_once(
        t.spark, "vector-index-2", [f"{t.sf_dir}/embeddings.parquet"], lambda path: neighbours.build(t.embeddings, path, "vec_id")))


def fiftieth(t: Tables):
    """Every row whose id is divisible by 50, as queries against all rows."""
    return t.embeddings.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


RECALL = 0.95

ALL_KNN = f"""scored AS MATERIALIZED (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, {cos_sql('q.embedding', 'e.embedding')} AS score
    FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id)"""


@query("V08_approximate_neighbours")
def _(t):
    index = vector_index(t)
    return shown(neighbours.search(index, fiftieth(t), 10, index.probes(RECALL), exclude_self=True).hits)


@query("V08_exact_neighbours", f"WITH {ALL_KNN} " + hits_sql("scored", 10))
def _(t):
    return shown(neighbours.search(vector_index(t), fiftieth(t), 10, exclude_self=True).hits)


@query("V08_recall")
def _(t):
    index = vector_index(t)
    probes = index.probes(RECALL)
    found = neighbours.search(index, fiftieth(t), 10, probes, exclude_self=True)
    exact = neighbours.search(index, fiftieth(t), 10, exclude_self=True)
    compared = found.compared.agg(F.avg("candidates")).scalar() / index.groups.agg(F.sum("n")).scalar()
    return neighbours.recall(found.hits, exact.hits).select(
        "neighbours", r6(F.col("recall")).alias("recall"), F.lit(probes).alias("probes"), F.lit(len(index.centroids)).alias("cells"), r6(compared).alias("compared"))


@query("V09_bm25_reranked", f"""WITH {bm25_ctes('docs')},
    first AS MATERIALIZED (SELECT query_id, doc_id FROM ({hits_sql('scored', 1000, 'query_id <> doc_id')})),
    second AS MATERIALIZED (SELECT f.query_id, f.doc_id, {cos_sql('q.embedding', 'e.embedding')} AS score
      FROM first f JOIN embeddings e ON e.vec_id = f.doc_id JOIN embeddings q ON q.vec_id = f.query_id)
    """ + hits_sql("second", 20))
def _(t):
    candidates = bm25_like(t, 1000)
    vectors = t.embeddings.where(F.col("vec_id").isin(*QUERY_DOCS)).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return shown(search.reranked(candidates, t.embeddings, vectors, 20, "vec_id"))


@query("V10_nearest_reranked", f"""WITH {KNN},
    first AS MATERIALIZED (SELECT query_id, doc_id FROM ({hits_sql('scored', 1000, 'query_id <> doc_id')})),
    second AS MATERIALIZED (SELECT f.query_id, f.doc_id, {cos_sql('q.' + HALF, 'e.' + HALF)} AS score
      FROM first f JOIN embeddings e ON e.vec_id = f.doc_id JOIN embeddings q ON q.vec_id = f.query_id)
    """ + hits_sql("second", 20))
def _(t):
    candidates = search.nearest_to(t.embeddings, QUERY_DOCS, 1000, key="vec_id")
    space = half_space(t)
    vectors = space.where(F.col("vec_id").isin(*QUERY_DOCS)).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return shown(search.reranked(candidates, space, vectors, 20, "vec_id"))


# ---- batches, enrichment, comparison -------------------------------------------------------------------------

TURNS = f"""qtok AS MATERIALIZED (SELECT query_id, k.term FROM (
    SELECT concat(conv_id, ':', turn) AS query_id, {clean_sql('text')} AS q FROM conversations),
    unnest(string_split(q, ' ')) AS k(term) WHERE k.term <> '')"""


@query("V11_batch_queries", f"WITH {bm25_ctes('named').replace(QTOKENS['named'], TURNS)} " + hits_sql("scored", 5))
def _(t):
    turns = t.conversations.select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), "text")
    return shown(textindex.search(text_index(t), turns, 5))


@query("V12_enriched_hits", f"""WITH {bm25_ctes('docs')}, hits AS ({hits_sql('scored', 20, 'query_id <> doc_id')})
    SELECT h.*, p.title, p.abstract, p.categories, 'id' AS query_type, CAST(h.query_id AS VARCHAR) AS query_value,
           q.title AS query_title, q.abstract AS query_abstract
    FROM hits h LEFT JOIN papers p ON p.id = h.doc_id LEFT JOIN papers q ON q.id = h.query_id""")
def _(t):
    return search.hit_records(shown(bm25_like(t, 20)), t.papers(), "id")


def method_hits(t: Tables):
    methods = {"bm25": bm25_like(t, 20),
               "nearest": search.nearest_to(t.embeddings, QUERY_DOCS, 20, key="vec_id"),
               "tfidf": search.tfidf_like(t.clean_docs(), QUERY_DOCS, 20, min_doc_freq=3)}
    frames = [df.select("query_id", F.lit(m).alias("method"), "doc_id", "rank") for m, df in methods.items()]
    return frames[0].union(frames[1]).union(frames[2])


METHOD_HITS = f"""bm AS MATERIALIZED (WITH {bm25_ctes('docs')} {hits_sql('scored', 20, 'query_id <> doc_id')}),
    kn AS MATERIALIZED (WITH {KNN} {hits_sql('scored', 20, 'query_id <> doc_id')}),
    ti AS MATERIALIZED ({cosine_sql('docs', 20, 3, 'query_id <> doc_id')}),
    hits AS MATERIALIZED (SELECT query_id, 'bm25' AS method, doc_id, rank FROM bm UNION ALL SELECT query_id, 'nearest', doc_id, rank FROM kn
             UNION ALL SELECT query_id, 'tfidf', doc_id, rank FROM ti)"""

OVERLAP_SQL = f"""WITH {METHOD_HITS},
    m AS (SELECT DISTINCT query_id, method FROM hits)
    SELECT a.query_id, a.method AS method_1, b.method AS method_2,
           (SELECT count(*) FROM hits x JOIN hits y ON x.query_id = y.query_id AND x.doc_id = y.doc_id
            WHERE x.query_id = a.query_id AND x.method = a.method AND y.method = b.method) / 20.0 AS overlap
    FROM m a JOIN m b ON a.query_id = b.query_id AND a.method < b.method"""


@query("V13_overlap", OVERLAP_SQL.replace("/ 20.0 AS overlap", "/ CAST(20.0 AS DOUBLE) AS overlap"))
def _(t):
    return search.overlap_at_k(method_hits(t), 20)


@query("U03_common_documents", f"""WITH {METHOD_HITS}
    SELECT query_id, doc_id, CAST(count(DISTINCT method) AS BIGINT) AS methods FROM hits GROUP BY 1, 2
    HAVING count(DISTINCT method) >= 2""")
def _(t):
    hits = method_hits(t)
    return (hits.groupBy("query_id", "doc_id").agg(F.count_distinct("method").alias("methods"))
            .where(F.col("methods") >= 2))


@query("V14_category_diversity", f"""WITH {METHOD_HITS},
    listed AS (SELECT query_id, method, unnest(string_split(categories, ' ')) AS sub,
                      generate_subscripts(string_split(categories, ' '), 1) AS pos FROM hits JOIN papers p ON p.id = doc_id)
    SELECT query_id, method, CAST(count(DISTINCT string_split(sub, '.')[1]) AS BIGINT) AS main_all,
           CAST(count(DISTINCT sub) AS BIGINT) AS sub_all,
           CAST(count(DISTINCT string_split(sub, '.')[1]) FILTER (pos = 1) AS BIGINT) AS main_primary,
           CAST(count(DISTINCT sub) FILTER (pos = 1) AS BIGINT) AS sub_primary FROM listed GROUP BY 1, 2""")
def _(t):
    hits = search.enriched(method_hits(t), t.papers(), columns=["categories"])
    return search.category_diversity(hits, 20)
