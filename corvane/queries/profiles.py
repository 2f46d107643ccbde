"""Aggregations, distributions and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import people
from corvane.functions import text as tx
from corvane.functions.numeric import r6
from corvane.operators import profile, records, stats
from corvane.queries.registry import query
from corvane.queries.views import Tables


@query("A01_uniqueness", """
    SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(count(*) AS BIGINT) AS distinct_ids,
           CAST(count(*) FILTER (n > 1) AS BIGINT) AS duplicated_ids
    FROM (SELECT id, count(*) AS n FROM paper_versions GROUP BY id)""")
def _(t):
    return profile.uniqueness(t.paper_versions())


@query("A01_duplicated_ids",
       "SELECT id, CAST(count(*) AS BIGINT) AS n FROM paper_versions GROUP BY id HAVING count(*) > 1")
def _(t):
    return profile.duplicated(t.paper_versions())


def with_gaps(t: Tables):
    """Lines of documents left-joined to labels: real nulls and empty strings."""
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"), "lang")
    return lines.join(t.labels, "doc_id", "left")


GAPS = """(SELECT d.doc_id, d.line, d.lang, l.quality, l.toxic
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, lang FROM documents) d
           LEFT JOIN labels l USING (doc_id))"""


@query("A02_null_counts", "SELECT " + ", ".join(
    f"CAST(count(*) FILTER ({c} IS NULL) AS BIGINT) AS {c}" for c in ("doc_id", "line", "lang", "quality", "toxic")
) + f" FROM {GAPS}")
def _(t):
    return profile.null_counts(with_gaps(t))


@query("A03_missing_counts", "SELECT " + ", ".join(
    f"CAST(count(*) FILTER ({c} IS NULL OR CAST({c} AS VARCHAR) = '') AS BIGINT) AS {c}"
    for c in ("doc_id", "line", "lang", "quality", "toxic")) + f" FROM {GAPS}")
def _(t):
    return profile.missing_counts(with_gaps(t))


@query("A04_author_parts", """
    SELECT CAST(0 AS BIGINT) AS lists_null, CAST(0 AS BIGINT) AS authors_null,
           CAST(count(*) FILTER (coalesce(a[1], '') = '') AS BIGINT) AS surname_missing,
           CAST(count(*) FILTER (coalesce(a[2], '') = '') AS BIGINT) AS first_names_missing,
           CAST(count(*) FILTER (coalesce(a[3], '') = '') AS BIGINT) AS suffix_missing,
           CAST(max(len(a)) AS BIGINT) AS max_parts
    FROM (SELECT unnest(authors_parsed) AS a FROM nested_papers)""")
def _(t):
    return profile.missing_author_parts(t.nested_papers())


@query("A04_version_parts", """
    SELECT CAST(0 AS BIGINT) AS lists_null, CAST(0 AS BIGINT) AS versions_null,
           CAST(count(*) FILTER (created IS NULL) AS BIGINT) AS created_missing,
           CAST(0 AS BIGINT) AS version_missing FROM dated_papers""")
def _(t):
    return profile.missing_version_parts(t.dated_papers())


VERSION_COLUMNS = ("update_date", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")


@query("A05_duplicate_differences", " UNION ALL ".join(
    f"SELECT id, '{c}' AS column, CAST(count(DISTINCT {c}) AS BIGINT) AS n_values FROM paper_versions "
    f"GROUP BY id HAVING count(DISTINCT {c}) > 1" for c in VERSION_COLUMNS))
def _(t):
    return profile.duplicate_differences(t.paper_versions())


@query("A06_value_profile", """
    WITH counts AS (SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
                    WHERE line <> '' GROUP BY line)
    SELECT 'present' AS measure, NULL AS value, CAST(sum(n) AS BIGINT) AS n FROM counts
    UNION ALL SELECT 'distinct', NULL, count(*) FROM counts
    UNION ALL (SELECT 'top', line, n FROM counts ORDER BY n DESC, line LIMIT 20)""")
def _(t):
    return profile.value_profile(t.documents.select(F.explode(F.split("text", "\n")).alias("line")), "line")


@query("A07_distinctness", " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count({c}) AS BIGINT) AS present, "
    f"CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_values FROM documents" for c in ("text", "source", "lang")))
def _(t):
    return profile.distinctness(t.documents, "text", "source", "lang")


@query("A08_distinct_categories", """
    SELECT CAST(count(DISTINCT c) AS BIGINT) AS categories,
           CAST(count(DISTINCT string_split(c, '.')[1]) AS BIGINT) AS main_categories
    FROM (SELECT unnest(string_split(categories, ' ')) AS c FROM papers)""")
def _(t):
    distinct = records.exploded_categories(t.papers()).distinct()
    return distinct.agg(F.count("*").alias("categories"),
                        F.count_distinct(tx.main_category(F.col("category"))).alias("main_categories"))


@query("A09_category_frequency", """
    SELECT 'category' AS kind, c AS value, CAST(count(*) AS BIGINT) AS n
    FROM (SELECT unnest(string_split(categories, ' ')) AS c FROM papers) GROUP BY c
    UNION ALL SELECT 'main', string_split(c, '.')[1], count(*)
    FROM (SELECT unnest(string_split(categories, ' ')) AS c FROM papers) GROUP BY 2""")
def _(t):
    counts = records.frequency(records.exploded_categories(t.papers()), "category")
    main = (counts.groupBy(tx.main_category(F.col("category")).alias("value")).agg(F.sum("n").alias("n"))
            .select(F.lit("main").alias("kind"), "value", "n"))
    return counts.select(F.lit("category").alias("kind"), F.col("category").alias("value"), "n").union(main)


@query("A09_author_frequency", "SELECT author, CAST(count(*) AS BIGINT) AS n FROM nested_authors GROUP BY author")
def _(t):
    return records.frequency(records.exploded_authors(t.nested_papers()), "author")


@query("A10_size_distribution", """
    SELECT CAST(len(authors_parsed) AS BIGINT) AS num_authors, CAST(count(*) AS BIGINT) AS n
    FROM nested_papers WHERE len(authors_parsed) BETWEEN 0 AND 20 GROUP BY 1""")
def _(t):
    return stats.size_distribution(t.nested_papers(), F.size("authors_parsed"), "num_authors", cap=20)


@query("A11_size_summary", """
    SELECT round(avg(s), 6) AS mean, CAST(median(s) AS DOUBLE) AS median,
           CAST(min(s) AS BIGINT) AS min, CAST(max(s) AS BIGINT) AS max
    FROM (SELECT len(authors_parsed) AS s FROM nested_papers)""")
def _(t):
    return (stats.size_summary(t.nested_papers(), F.size("authors_parsed"))
            .withColumn("mean", r6(F.col("mean"))))


def dated(t: Tables):
    return records.with_created_year(t.dated_papers())


@query("A12_papers_per_year", """
    SELECT CAST(yr AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS n FROM paper_years GROUP BY yr""")
def _(t):
    return records.frequency(dated(t).where(F.col("year").isNotNull()), "year")


@query("A13_means_per_year", """
    SELECT CAST(yr AS INTEGER) AS year, round(avg(len(string_split(categories, ' '))), 6) AS mean_categories,
           round(avg(length(title)), 6) AS mean_title_len, round(avg(CAST(citations AS BIGINT)), 6) AS mean_cit
    FROM dated_papers JOIN paper_years USING (id) GROUP BY yr""")
def _(t):
    means = stats.means_per_year(dated(t), {
        "mean_categories": F.size(tx.category_list(F.col("categories"))), "mean_title_len": F.length("title"),
        "mean_cit": F.col("citations").try_cast("bigint")})
    return means.select("year", *[r6(F.col(c)).alias(c) for c in means.columns[1:]])


@query("A14_top_authors_over_time", """
    SELECT author, CAST(yr AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS n
    FROM paper_authors JOIN paper_years USING (id)
    WHERE author IN (SELECT author FROM paper_authors GROUP BY author ORDER BY count(*) DESC, author LIMIT 5)
    GROUP BY author, yr""")
def _(t):
    years = dated(t).select("id", "year")
    return stats.top_over_time(t.paper_authors().join(years, "id", "left"), "author", 5)


@query("A14_top_categories_over_time", """
    WITH cats AS (SELECT id, unnest(string_split(categories, ' ')) AS category FROM dated_papers)
    SELECT category, CAST(yr AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS n FROM cats JOIN paper_years USING (id)
    WHERE category IN (SELECT category FROM cats GROUP BY category ORDER BY count(*) DESC, category LIMIT 5)
    GROUP BY category, yr""")
def _(t):
    return stats.top_over_time(records.exploded_categories(dated(t), "year"), "category", 5)


PAIRS = """SELECT a.author AS a1, b.author AS a2, CAST(count(*) AS BIGINT) AS n
    FROM {src} a JOIN {src} b ON a.id = b.id AND a.author < b.author GROUP BY 1, 2"""


@query("A15_top_coauthors", PAIRS.format(src="paper_authors") + " ORDER BY n DESC, a1, a2 LIMIT 20")
def _(t):
    return stats.top_pairs(t.paper_authors(), "id", "author", 20)


@query("A16_sampled_coauthors", f"""
    WITH kept AS (SELECT id, author FROM paper_authors
                  WHERE substring(md5(concat('42:', CAST(id AS VARCHAR))), 1, 8) < '40000000'
                    AND id IN (SELECT id FROM paper_authors GROUP BY id HAVING count(*) BETWEEN 2 AND 50))
    {PAIRS.format(src='kept')} ORDER BY n DESC, a1, a2 LIMIT 15""")
def _(t):
    pairs = stats.sampled_pairs(t.paper_authors(), "id", "author")
    return pairs.orderBy(F.desc("n"), "a1", "a2").limit(15)


@query("A17_author_category_matrix", """
    WITH cats AS (SELECT id, unnest(string_split(categories, ' ')) AS category FROM dated_papers
                  WHERE substring(md5(concat('42:', CAST(id AS VARCHAR))), 1, 8) < '5999999a'),
         auth AS (SELECT * FROM paper_authors WHERE substring(md5(concat('42:', CAST(id AS VARCHAR))), 1, 8) < '5999999a'),
         ta AS (SELECT author FROM auth GROUP BY author ORDER BY count(*) DESC, author LIMIT 10),
         tc AS (SELECT category FROM cats GROUP BY category ORDER BY count(*) DESC, category LIMIT 12)
    SELECT ta.author, tc.category, CAST(count(x.id) AS BIGINT) AS n
    FROM ta CROSS JOIN tc LEFT JOIN (SELECT id, author, category FROM auth JOIN cats USING (id)) x
      ON x.author = ta.author AND x.category = tc.category GROUP BY 1, 2""")
def _(t):
    from corvane.sources.scan import hash_sample
    authors = hash_sample(t.paper_authors(), "id", 0.35, 42)
    cats = records.exploded_categories(hash_sample(t.dated_papers(), "id", 0.35, 42), "id")
    return stats.top_cross_table(authors, cats, "id", "author", "category", 10, 12)


@query("A18_author_citations", """
    SELECT author, CAST(sum(CAST(citations AS BIGINT)) AS BIGINT) AS cit_sum,
           round(avg(CAST(citations AS BIGINT)), 6) AS cit_mean, CAST(count(DISTINCT id) AS BIGINT) AS papers
    FROM paper_authors JOIN dated_papers USING (id) GROUP BY author""")
def _(t):
    totals = stats.citation_totals(t.paper_authors(), t.dated_papers(), "citations")
    return totals.withColumn("cit_mean", r6(F.col("cit_mean")))


@query("A19_citations_per_category", """
    SELECT c AS category, round(avg(CAST(citations AS BIGINT)), 6) AS mean_cit, CAST(count(*) AS BIGINT) AS papers
    FROM (SELECT citations, unnest(string_split(categories, ' ')) AS c FROM dated_papers)
    GROUP BY c HAVING count(*) >= 500""")
def _(t):
    means = stats.mean_citations_per_category(t.dated_papers(), "citations")
    return means.withColumn("mean_cit", r6(F.col("mean_cit")))


@query("A20_citation_histogram", """
    WITH v AS (SELECT CAST(citations AS BIGINT) AS c FROM dated_papers
               WHERE CAST(citations AS BIGINT) >= 0
                 AND substring(md5(concat('42:', CAST(id AS VARCHAR))), 1, 8) < '33333333'),
         cut AS (SELECT greatest(1, CASE WHEN count(*) > 1000 THEN floor(quantile_cont(c, 0.995)) ELSE max(c) END)
                        AS m FROM v)
    SELECT CAST(bin AS BIGINT) AS bin, round(bin * w, 6) AS low, round((bin + 1) * w, 6) AS high,
           CAST(count(*) AS BIGINT) AS n
    FROM (SELECT least(floor(c / (m / 50.0)), 49) AS bin, m / 50.0 AS w FROM v, cut WHERE c <= m) GROUP BY bin, w""")
def _(t):
    bins = stats.clipped_histogram(t.dated_papers(), F.col("citations"), "id")
    return bins.select("bin", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"), "n")


@query("A21_label_coverage", """
    WITH counts AS (SELECT label_str, count(*) AS n FROM clean_docs WHERE length(text_clean) >= 50 GROUP BY label_str),
         r AS (SELECT n, row_number() OVER (ORDER BY n DESC, label_str) AS k FROM counts)
    SELECT CAST(ks.k AS BIGINT) AS top_k, CAST(sum(r.n) AS BIGINT) AS covered,
           round(sum(r.n) / (SELECT sum(n) FROM counts), 6) AS coverage
    FROM (VALUES (1), (5), (10), (20), (30), (1000)) AS ks(k) JOIN r ON r.k <= ks.k GROUP BY ks.k""")
def _(t):
    docs = records.with_clean_text(records.with_primary_label(t.papers()))
    curve = stats.coverage(docs, "label_str", (1, 5, 10, 20, 30, 1000))
    return curve.withColumn("coverage", r6(F.col("coverage")))


@query("A22_coverage_curve", """
    SELECT CAST(k AS BIGINT) AS k, label_str, CAST(n AS BIGINT) AS n, CAST(covered AS BIGINT) AS covered,
           round(covered / total, 6) AS coverage
    FROM (SELECT label_str, n, row_number() OVER w AS k, sum(n) OVER w AS covered, sum(n) OVER () AS total
          FROM (SELECT label_str, count(*) AS n FROM clean_docs GROUP BY label_str)
          WINDOW w AS (ORDER BY n DESC, label_str ROWS UNBOUNDED PRECEDING)) WHERE k <= 12""")
def _(t):
    counts = records.frequency(t.clean_docs(), "label_str")
    curve = stats.cumulative_coverage(counts, "label_str", 12, counts.agg(F.sum("n")).scalar())
    return curve.select("k", "label_str", "n", "covered", r6(F.col("coverage")).alias("coverage"))


@query("A23_long_tail", """
    SELECT author, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY n DESC, author) AS BIGINT) AS rank
    FROM (SELECT author, count(*) AS n FROM nested_authors GROUP BY author)""")
def _(t):
    return stats.long_tail(records.exploded_authors(t.nested_papers()), "author")


@query("A24_summary_records", """
    WITH cats AS (SELECT id, unnest(string_split(categories, ' ')) AS c FROM dated_papers),
         na AS (SELECT id, count(*) AS n FROM paper_authors GROUP BY id),
         cit AS (SELECT id, CAST(citations AS BIGINT) AS n FROM dated_papers)
    SELECT 'rows_total' AS key, NULL AS entity, CAST(count(*) AS BIGINT) AS value FROM dated_papers
    UNION ALL (SELECT 'year_with_most_papers', CAST(yr AS VARCHAR) AS e, count(*) AS v FROM paper_years GROUP BY 2 ORDER BY v DESC, e LIMIT 1)
    UNION ALL (SELECT 'paper_with_most_authors', CAST(id AS VARCHAR) AS e, n AS v FROM na ORDER BY v DESC, e LIMIT 1)
    UNION ALL (SELECT 'paper_with_most_categories', CAST(id AS VARCHAR) AS e, count(*) AS v FROM cats GROUP BY 2 ORDER BY v DESC, e LIMIT 1)
    UNION ALL (SELECT 'most_common_category', c AS e, count(*) AS v FROM cats GROUP BY 2 ORDER BY v DESC, e LIMIT 1)
    UNION ALL (SELECT 'most_prolific_author', author AS e, count(*) AS v FROM paper_authors GROUP BY 2 ORDER BY v DESC, e LIMIT 1)
    UNION ALL (SELECT 'most_cited_paper', CAST(id AS VARCHAR) AS e, n AS v FROM cit ORDER BY v DESC, e LIMIT 1)
    UNION ALL (SELECT 'most_cited_author', author AS e, CAST(sum(n) AS BIGINT) AS v FROM paper_authors JOIN cit USING (id)
               GROUP BY 2 ORDER BY v DESC, e LIMIT 1)""")
def _(t):
    authors = t.paper_authors()
    sizes = authors.groupBy("id").agg(F.count("*").alias("num_authors"))
    papers = dated(t).join(sizes, "id", "left")
    return stats.summary_records(papers, authors, F.col("num_authors"), "citations")


@query("A25_title_length_sample", """
    SELECT id, CAST(len(authors_parsed) AS INTEGER) AS num_authors, CAST(length(title) AS INTEGER) AS title_len
    FROM nested_papers JOIN papers USING (id)
    ORDER BY md5(concat('42:', CAST(id AS VARCHAR))), id LIMIT 300""")
def _(t):
    both = t.papers().join(t.nested_papers(), "id")
    return stats.length_against_authors(both, F.size("authors_parsed"), sample_rows=300)
