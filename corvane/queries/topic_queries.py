"""Topic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.numeric import r6
from corvane.operators import encode, features, topics
from corvane.queries.registry import query
from corvane.queries.views import Tables


def token_docs(t: Tables, min_length: int = 2, drop_stop_words: bool = True):
    """Documents with tokens, language and main category."""
    docs = t.documents.select(F.col("doc_id").alias("id"), "lang", tx.clean(F.col("text")).alias("text_clean"))
    return features.tokenised(docs, min_length=min_length, drop_stop_words=drop_stop_words).select("id", "lang", "tokens")


def labelled_docs(t: Tables):
    """All documents with the number of their source as topic, every third one noise."""
    noise = F.when(F.col("id") % 3 == 0, -1).otherwise(F.regexp_extract("label_str", "([0-9]+)$", 1).cast("bigint"))
    docs = features.tokenised(t.clean_docs(), output_col="tokens")
    return docs.select("id", noise.cast("bigint").alias("topic"), "tokens")


LABELLED = """lab AS MATERIALIZED (
    SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) END AS topic
    FROM documents)"""
CTFIDF = f"""{LABELLED},
    tt AS MATERIALIZED (SELECT topic, token AS term, count(*) AS tf FROM lab JOIN tokens USING (id) GROUP BY 1, 2),
    ff AS (SELECT term, sum(tf) AS f FROM tt GROUP BY term),
    avgw AS (SELECT sum(tf) / count(DISTINCT topic) AS a FROM tt),
    weights AS MATERIALIZED (SELECT CAST(topic AS BIGINT) AS topic, term, tf * ln(1.0 + a / f) AS weight
                             FROM tt JOIN ff USING (term), avgw WHERE topic <> -1)"""


def words_sql(k: int) -> str:
    return f"""words AS MATERIALIZED (SELECT topic, term, weight, CAST(rank AS BIGINT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term) AS rank FROM weights)
        WHERE rank <= {k})"""


@query("C15_class_tfidf", f"WITH {CTFIDF} SELECT topic, term, round(weight, 6) AS weight FROM weights")
def _(t):
    return topics.class_tfidf(labelled_docs(t)).withColumn("weight", r6(F.col("weight")))


def words_of(t: Tables, k: int = 10):
    return topics.top_terms(topics.class_tfidf(labelled_docs(t)), k)


@query("C05_top_terms", f"WITH {CTFIDF}, {words_sql(10)} SELECT topic, rank, term, round(weight, 6) AS weight FROM words")
def _(t):
    return words_of(t).withColumn("weight", r6(F.col("weight")))


@query("C06_word_weights", f"WITH {CTFIDF}, {words_sql(15)} SELECT topic, rank, term, round(weight, 6) AS weight FROM words")
def _(t):
    return words_of(t, 15).withColumn("weight", r6(F.col("weight")))


@query("C07_topic_similarity", f"""WITH {CTFIDF},
    size AS (SELECT topic, sqrt(sum(weight * weight)) AS s FROM weights GROUP BY topic)
    SELECT a.topic AS topic_1, b.topic AS topic_2, round(coalesce((SELECT sum(x.weight * y.weight) FROM weights x
             JOIN weights y USING (term) WHERE x.topic = a.topic AND y.topic = b.topic), 0.0) / (a.s * b.s), 6) AS cosine
    FROM size a JOIN size b ON a.topic < b.topic""")
def _(t):
    pairs = topics.topic_similarity(topics.class_tfidf(labelled_docs(t)))
    return pairs.withColumn("cosine", r6(F.col("cosine")))


@query("C08_diversity", f"""WITH {CTFIDF}, {words_sql(10)}
    SELECT round(count(DISTINCT term) / count(*), 6) AS diversity,
           round(count(DISTINCT term) / (count(DISTINCT topic) * 10), 6) AS diversity_fixed FROM words""")
def _(t):
    words = words_of(t)
    fixed = topics.diversity(words, 10).scalar()
    return topics.diversity(words).select(r6(F.col("diversity")).alias("diversity"), r6(fixed).alias("diversity_fixed"))


PAIRS = """pr AS (SELECT a.topic, a.term AS w1, b.term AS w2 FROM words a JOIN words b
           ON a.topic = b.topic AND a.rank < b.rank)"""


@query("C09_u_mass", f"""WITH {CTFIDF}, {words_sql(10)}, {PAIRS},
    seen AS MATERIALIZED (SELECT DISTINCT id, token AS w FROM tokens WHERE token IN (SELECT term FROM words)),
    own AS MATERIALIZED (SELECT w, count(*) AS n FROM seen GROUP BY w),
    joint AS MATERIALIZED (SELECT a.w AS w1, b.w AS w2, count(*) AS n FROM seen a JOIN seen b USING (id) GROUP BY 1, 2)
    SELECT topic, round(avg(ln((coalesce(joint.n, 0) + 1.0) / own.n)), 6) AS coherence
    FROM pr JOIN own ON own.w = pr.w1 LEFT JOIN joint ON joint.w1 = pr.w1 AND joint.w2 = pr.w2 GROUP BY topic""")
def _(t):
    docs = features.tokenised(t.clean_docs())
    return topics.u_mass(words_of(t), docs).withColumn("coherence", r6(F.col("coherence")))


def windows_sql(width: int) -> str:
    """CTEs of the windows of ``width`` tokens: ``total``, ``own`` and ``joint`` counts of the wanted words."""
    return f"""listed AS (SELECT id, list_filter(string_split(text_clean, ' '), lambda x: x <> '') AS ws FROM clean_docs),
    total AS (SELECT sum(greatest(1, len(ws) - {width - 1})) AS n FROM listed WHERE len(ws) > 0),
    placed AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p, greatest(0, len(ws) - {width}) AS last FROM listed),
    seen AS MATERIALIZED (SELECT DISTINCT id, w, unnest(range(greatest(0, p - {width - 1}), least(p, last) + 1)) AS s FROM placed
                          WHERE w IN (SELECT term FROM words)),
    own AS MATERIALIZED (SELECT w, count(*) AS n FROM seen GROUP BY w),
    need AS (SELECT DISTINCT w1, w2 FROM pr),
    joint AS MATERIALIZED (SELECT a.w AS w1, b.w AS w2, count(*) AS n FROM seen a JOIN seen b ON a.id = b.id AND a.s = b.s
                          JOIN need ON need.w1 = a.w AND need.w2 = b.w GROUP BY 1, 2)"""


@query("C09_npmi", f"""WITH {CTFIDF}, {words_sql(10)}, {PAIRS}, {windows_sql(10)},
    sc AS (SELECT pr.topic, coalesce(joint.n, 0) / total.n + 1e-12 AS p, x.n AS n1, y.n AS n2, total.n AS t
           FROM pr JOIN own x ON x.w = pr.w1 JOIN own y ON y.w = pr.w2
           LEFT JOIN joint ON joint.w1 = pr.w1 AND joint.w2 = pr.w2, total)
    SELECT topic, round(avg(ln(p * t * t / (CAST(n1 AS DOUBLE) * n2)) / -ln(p)), 6) AS coherence FROM sc GROUP BY topic""")
def _(t):
    docs = features.tokenised(t.clean_docs())
    return topics.c_npmi(words_of(t), docs).withColumn("coherence", r6(F.col("coherence")))


@query("C09_c_v", f"""WITH {CTFIDF}, {words_sql(10)}, {PAIRS}, {windows_sql(110)},
    sc AS (SELECT pr.topic, pr.w1, pr.w2, coalesce(joint.n, 0) / total.n + 1e-12 AS p, x.n AS n1, y.n AS n2, total.n AS t
           FROM pr JOIN own x ON x.w = pr.w1 JOIN own y ON y.w = pr.w2
           LEFT JOIN joint ON joint.w1 = pr.w1 AND joint.w2 = pr.w2, total),
    half AS (SELECT topic, w1, w2, ln(p * t * t / (CAST(n1 AS DOUBLE) * n2)) / -ln(p) AS m FROM sc),
    self AS (SELECT topic, w, ln(p * t * t / (CAST(n AS DOUBLE) * n)) / -ln(p) AS m FROM (
      SELECT words.topic, own.w, own.n, total.n AS t, own.n / total.n + 1e-12 AS p FROM words JOIN own ON own.w = words.term, total)),
    cell AS MATERIALIZED (SELECT topic, w1 AS w, w2 AS v, m FROM half UNION ALL SELECT topic, w2, w1, m FROM half
                          UNION ALL SELECT topic, w, w, m FROM self),
    sums AS (SELECT topic, v, sum(m) AS s FROM cell GROUP BY 1, 2),
    per_word AS (SELECT topic, w, sum(m * s) / sqrt(sum(m * m) * sum(s * s)) AS c FROM cell JOIN sums USING (topic, v) GROUP BY 1, 2)
    SELECT topic, round(avg(c), 6) AS coherence FROM per_word GROUP BY topic""")
def _(t):
    docs = features.tokenised(t.clean_docs())
    return topics.c_v(words_of(t), docs).withColumn("coherence", r6(F.col("coherence")))


@query("C01_lda")
def _(t):
    words, _ = topics.lda(token_docs(t, 3), min_df=5.0)
    return words


@query("C10_lda_fit_scores")
def _(t):
    _, metrics = topics.lda(token_docs(t, 3), min_df=5.0)
    return metrics


@query("C02_lda_per_category")
def _(t):
    return topics.with_status(*topics.lda_per_category(token_docs(t, 3, drop_stop_words=False), "lang"))


@query("C11_category_metrics")
def _(t):
    _, metrics = topics.lda_per_category(token_docs(t, 3, drop_stop_words=False), "lang")
    return metrics


def dated_docs(t: Tables):
    """Documents dated by the order of the same number."""
    years = t.orders.select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"))
    return token_docs(t).join(years, "id")


PERIODS = ((1995, 1997), (1997, 1999), (2000, 2001))


@query("C03_lda_per_period")
def _(t):
    return topics.with_status(*topics.lda_per_period(dated_docs(t), PERIODS, min_docs=20, min_df=2.0))


@query("C04_nmf")
def _(t):
    weights, _ = topics.nmf_topics(token_docs(t))
    return topics.top_terms(weights, 10)


@query("C04_nmf_per_category")
def _(t):
    _, metrics = topics.nmf_per_group(token_docs(t), "lang", 5)
    return metrics


@query("C12_embedding_clusters")
def _(t):
    return topics.embedding_clusters(t.embeddings, key="vec_id", min_size=10)


@query("C12_density_clusters")
def _(t):
    return topics.density_topics(encode.embedded(t.documents, "hashed-384", key="doc_id"))


def vector_rows(t: Tables):
    noise = F.when(F.col("vec_id") % 3 == 0, -1).otherwise(F.col("label"))
    return t.embeddings.select(F.col("vec_id").alias("id"), noise.cast("bigint").alias("topic"), "embedding")


CENTERS = """lab AS (SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE label END AS topic, embedding FROM embeddings),
    dims AS MATERIALIZED (SELECT topic, i, avg(v) AS m FROM (SELECT topic, CAST(unnest(embedding) AS DOUBLE) AS v,
             generate_subscripts(embedding, 1) AS i FROM lab WHERE topic <> -1) GROUP BY 1, 2),
    cent AS MATERIALIZED (SELECT topic, list(m ORDER BY i) AS c FROM dims GROUP BY topic)"""


def cosine_sql(a: str, b: str) -> str:
    def dot(x, y):
        return f"list_sum(list_transform(list_zip({x}, {y}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
    return f"{dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"


@query("C13_centroids", f"WITH {CENTERS} SELECT CAST(topic AS BIGINT) AS topic, CAST(i - 1 AS INTEGER) AS dim, round(m, 6) AS mean FROM dims")
def _(t):
    return topics.centroids(vector_rows(t)).select("topic", F.posexplode("centroid").alias("dim", "mean")).withColumn(
        "mean", r6(F.col("mean")))


@query("C14_assign_nearest", f"""WITH {CENTERS}
    SELECT id, CASE WHEN s > 0.3 THEN topic ELSE CAST(-1 AS BIGINT) END AS topic, round(s, 6) AS similarity FROM (
      SELECT id, CAST(t AS BIGINT) AS topic, s, row_number() OVER (PARTITION BY id ORDER BY s DESC, t) AS rn FROM (
        SELECT lab.id, cent.topic AS t, round({cosine_sql('lab.embedding', 'cent.c')}, 9) AS s FROM lab, cent)) WHERE rn = 1""")
def _(t):
    rows = vector_rows(t)
    return topics.assign_nearest(rows, topics.centroids(rows)).withColumn("similarity", r6(F.col("similarity")))


@query("C16_topic_sizes", f"WITH {CENTERS} SELECT CAST(topic AS BIGINT) AS topic, CAST(count(*) AS BIGINT) AS n FROM lab GROUP BY topic")
def _(t):
    return topics.topic_sizes(vector_rows(t))


@query("C16_topic_overview", f"""WITH {CENTERS}
    SELECT CAST(count(DISTINCT topic) FILTER (topic <> -1) AS BIGINT) AS n_topics,
           round(avg(CASE WHEN topic = -1 THEN 1.0 ELSE 0.0 END), 6) AS noise_fraction FROM lab""")
def _(t):
    return topics.topic_overview(vector_rows(t)).withColumn("noise_fraction", r6(F.col("noise_fraction")))


@query("C17_representatives", f"""WITH {CENTERS}
    SELECT topic, doc_id, round(s, 6) AS score, CAST(rank AS BIGINT) AS rank FROM (
      SELECT CAST(topic AS BIGINT) AS topic, id AS doc_id, s,
             row_number() OVER (PARTITION BY topic ORDER BY round(s, 9) DESC, id) AS rank
      FROM (SELECT lab.topic, lab.id, {cosine_sql('lab.embedding', 'cent.c')} AS s FROM lab JOIN cent USING (topic)))
    WHERE rank <= 3""")
def _(t):
    return topics.representatives(vector_rows(t)).withColumn("score", r6(F.col("score")))


def embedded_docs(t: Tables):
    """Every document with the vector its text encodes to; a document without an order of its number has no year."""
    vectors = encode.embedded(t.documents, "hashed-384", key="doc_id")
    years = t.orders.select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"))
    return token_docs(t).join(vectors, "id").join(years, "id", "left")


@query("C18_repeated_runs")
def _(t):
    return topics.repeated_runs(embedded_docs(t), range(5), 0.8, k=5, min_size=5)


@query("C19_cluster_topics_per_period")
def _(t):
    return topics.with_status(*topics.cluster_topics_per_period(embedded_docs(t), PERIODS, min_docs=5, k=3, min_size=2))


@query("C20_category_texts", """
    SELECT id, concat_ws(' ', title, abstract) AS text FROM papers
    WHERE list_contains(list_transform(string_split(categories, ' '), lambda c: string_split(c, '.')[1]), 'en')
      AND title IS NOT NULL AND abstract IS NOT NULL""")
def _(t):
    return topics.category_texts(t.papers(), "en")
