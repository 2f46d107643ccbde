"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import language, lines, mixing, negatives, phrases, pii, pstable, simhash, spaced, superkmers, tokens, toxicity, urls
from corvane.llm.common import row_key, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (simhash.components(table(spark, sf_dir, "documents"))
            .select(F.col("id").alias("doc_id"), simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id"))


@query("op3_toxicity_chain")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.given_categories())
    p = F.col("toxicity")
    return (toxicity.score(docs, chain).select("doc_id", *[p[k].alias(f"p_{c}") for k, c in enumerate(chain.categories)])
            .withColumn("toxic", F.col("p_toxic") >= chain.cuts[chain.categories.index("toxic")]))


@query("op9_line_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, count_col="n_removed")


@query("op4_spaced_seed_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = spaced.overlaps(docs, table(spark, sf_dir, "benchmark"))
    per_document = found.groupBy("key").agg(
        F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_set("item")), ",").alias("items"))
    flagged = docs.select("doc_id", row_key("doc_id", "text").alias("key")).join(per_document, "key", "left")
    return flagged.select("doc_id", F.coalesce("n_items", F.lit(0)).alias("n_items"),
                          F.coalesce("items", F.lit("")).alias("items"), F.col("n_items").isNotNull().alias("contaminated"))


@query("op6_source_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (mixing.mix(table(spark, sf_dir, "documents"))
            .select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken"))


@query("op8_embedding_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op10_url_filter")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).withColumnRenamed("id", "page_id")


@query("op7_language_profiles")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fifth = F.crc32(F.col("doc_id").cast("string")) % 5
    docs = docs.withColumn("held_out", F.coalesce(fifth == 0, F.lit(False)))
    learned = language.prototypes(docs.where(fifth != 0), "text", "lang")
    told = language.identify(docs.select("doc_id", "held_out", "text"), learned)
    return told.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokens.read_vocabulary(tokens.VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return tokens.with_counts(docs, vocabulary, out="n_tokens").select("doc_id", "source", "n_tokens")


@query("op2_personal_data")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    return found.select("doc_id", *[f"personal.n_{k}" for k in pii.KINDS], "personal.base_sha256", "personal.spans",
                        "personal.n_added")


@query("op12_substring_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return superkmers.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


GRAMS_SQL = """
    WITH piece AS (SELECT lang, p, row_number() OVER () AS id FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
    word AS (SELECT lang, id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
      SELECT lang, id, list_filter(regexp_split_to_array(p, '[ \\t]+'), lambda x: x <> '') AS ws FROM piece)),
    place AS (SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM word WINDOW o AS (PARTITION BY id ORDER BY i)),
    gram AS (SELECT lang, 1 AS length, w AS phrase FROM place
      UNION ALL SELECT lang, 2, concat(w, ' ', w2) FROM place WHERE w2 IS NOT NULL
      UNION ALL SELECT lang, 3, concat(w, ' ', w2, ' ', w3) FROM place WHERE w3 IS NOT NULL),
    f AS MATERIALIZED (SELECT lang, length, phrase, count(*) AS f FROM gram GROUP BY ALL),
    n AS (SELECT lang, sum(f) AS n FROM f WHERE length = 1 GROUP BY lang),
    cand AS MATERIALIZED (SELECT lang, length, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE length > 1 AND f >= 10),
    cut AS MATERIALIZED (SELECT *, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:], ' ') AS rest
      FROM (SELECT *, unnest(range(1, length)) AS k FROM cand)),
    half AS MATERIALIZED (SELECT c.*, f.f AS l FROM cut c JOIN f ON f.lang = c.lang AND f.phrase = c.first),
    scored AS (SELECT h.lang, h.phrase, h.length, a, k, l, f.f AS r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(l AS HUGEINT) * f.f) AS BIGINT) AS score
      FROM half h JOIN f ON f.lang = h.lang AND f.phrase = h.rest),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inner2 AS (SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM cand WHERE length = 3
      UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM cand WHERE length = 3),
    longest AS (SELECT lang, phrase, max(a) AS longest FROM inner2 GROUP BY ALL),
    kept AS (SELECT b.* FROM best b LEFT JOIN longest USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 50 * a)
    SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank FROM kept)
    JOIN n USING (lang) WHERE rank <= 2000"""


@query("op11_phrase_collocations", GRAMS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(phrases.phrase_counts(table(spark, sf_dir, "documents").select("lang", "text")))


NEGATIVES_SQL = """
    WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
        CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS MATERIALIZED (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
    n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
        id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
    SELECT * FROM n WHERE rank <= 3"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding")
    whole = F.transform(x, lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.floor(256 * c.cast("double"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", whole.alias("vector"), label.alias("label"))
    return negatives.hard_negatives(rows, "vec_id")
