"""Projections, predicates and scalar expressions."""

from __future__ import annotations

from pyspark.ml.feature import IndexToString
from pyspark.sql import functions as F

from corvane.functions import numeric, people
from corvane.functions import text as tx
from corvane.operators import features, records
from corvane.plans.runtime import new_path
from corvane.queries.registry import query
from corvane.queries.views import clean_sql
from corvane.sources import scan, sink


@query("P01_joined_text", "SELECT id, concat_ws('. ', title, abstract) AS text_raw FROM papers")
def _(t):
    return t.papers().select("id", tx.joined_text("title", "abstract", sep=". ").alias("text_raw"))


@query("P02_clean_text", f"SELECT doc_id AS id, {clean_sql('text')} AS text_clean FROM documents")
def _(t):
    return t.documents.select(F.col("doc_id").alias("id"), tx.clean(F.col("text")).alias("text_clean"))


@query("P03_alpha_text", """
    SELECT doc_id AS id, trim(regexp_replace(regexp_replace(replace(lower(text), chr(10), ' '),
           '[^a-z ]', ' ', 'g'), '\\s+', ' ', 'g')) AS text_alpha FROM documents""")
def _(t):
    return t.documents.select(F.col("doc_id").alias("id"), tx.clean_alpha(F.col("text")).alias("text_alpha"))


@query("P04_squeezed_text", """
    SELECT page_id AS id, trim(regexp_replace(lower(html), '\\s+', ' ', 'g')) AS text_norm FROM pages
    UNION ALL SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) FROM documents""")
def _(t):
    both = (t.pages.select(F.col("page_id").alias("id"), F.col("html").alias("raw"))
            .union(t.documents.select("doc_id", "text")))
    return both.select("id", tx.squeeze(F.col("raw")).alias("text_norm"))


@query("P05_long_enough", """
    SELECT id, label_str, length(text_clean) AS n FROM clean_docs WHERE length(text_clean) >= 50
    """.replace("length(text_clean) AS n", "CAST(length(text_clean) AS INTEGER) AS n"))
def _(t):
    kept = records.with_clean_text(records.with_primary_label(t.papers()))
    return kept.select("id", "label_str", F.length("text_clean").alias("n"))


@query("P06_complete_rows", """
    SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)
    WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL""")
def _(t):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return records.complete(joined, ["quality", "toxic"])


@query("P07_present", """
    SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE line IS NOT NULL AND line <> ''""")
def _(t):
    lines = t.documents.select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(tx.present(F.col("line"))).agg(F.count("*").alias("n"))


@query("P08_text_or_empty", """
    SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '') AS quality FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(t):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return joined.select("doc_id", tx.text_or_empty(F.col("quality")).alias("quality"))


@query("P09_primary_label", "SELECT id, string_split(categories, ' ')[1] AS label_str FROM papers")
def _(t):
    return records.with_primary_label(t.papers()).select("id", "label_str")


@query("P10_main_category", """
    SELECT id, string_split(c, '.')[1] AS main_category
    FROM (SELECT id, unnest(string_split(categories, ' ')) AS c FROM papers)""")
def _(t):
    cats = records.exploded_categories(t.papers(), "id")
    return cats.select("id", tx.main_category(F.col("category")).alias("main_category"))


@query("P11_keep_top_labels", """
    SELECT id, label_str FROM clean_docs WHERE label_str IN (
      SELECT label_str FROM clean_docs GROUP BY label_str ORDER BY count(*) DESC, label_str LIMIT 15)""")
def _(t):
    labelled = records.with_primary_label(t.papers()).select("id", "label_str")
    return records.keep_top_labels(labelled, 15).select("id", "label_str")


@query("P12_created_year", "SELECT id, CAST(substring(update_date, 1, 4) AS INTEGER) AS year FROM dated_papers")
def _(t):
    return records.with_created_year(t.dated_papers()).select("id", "year")


@query("P13_year_prefix", "SELECT id, substring(update_date, 1, 4) AS year FROM dated_papers")
def _(t):
    return t.dated_papers().select("id", people.year_prefix(F.col("update_date")).alias("year"))


PERIODS = ((1995, 1997), (1996, 1998), (1999, 2001), (2030, 2040))


@query("P14_periods", """
    WITH sliced AS (
      SELECT p.id, concat(w.a, '_', w.b) AS period FROM paper_years p
      JOIN (VALUES (1995, 1997), (1996, 1998), (1999, 2001), (2030, 2040)) AS w(a, b) ON p.yr BETWEEN w.a AND w.b)
    SELECT id, period FROM sliced
    WHERE period IN (SELECT period FROM sliced GROUP BY period HAVING count(*) >= 50)""")
def _(t):
    return records.in_periods(records.with_created_year(t.dated_papers()), PERIODS, 50).select("id", "period")


@query("P15_list_sizes", """
    SELECT n.id, CAST(len(authors_parsed) AS INTEGER) AS num_authors,
           CAST(len(string_split(categories, ' ')) AS INTEGER) AS num_categories
    FROM nested_papers n JOIN papers p ON n.id = p.id""")
def _(t):
    both = t.nested_papers().join(t.papers(), "id")
    return both.select("id", F.size("authors_parsed").alias("num_authors"),
                       F.size(tx.category_list(F.col("categories"))).alias("num_categories"))


@query("P16_text_lengths", """
    SELECT id, CAST(length(title) AS INTEGER) AS title_len, CAST(length(abstract) AS INTEGER) AS abs_len FROM papers""")
def _(t):
    return t.papers().select("id", F.length("title").alias("title_len"), F.length("abstract").alias("abs_len"))


@query("P17_author_names", "SELECT id, author, CAST(count(*) AS BIGINT) AS n FROM nested_authors GROUP BY id, author")
def _(t):
    return records.exploded_authors(t.nested_papers()).groupBy("id", "author").agg(F.count("*").alias("n"))


@query("P18_author_names_full", """
    SELECT id, author FROM (SELECT id, array_to_string(unnest(authors_parsed), ' ') AS author FROM nested_papers)
    WHERE author <> ''""")
def _(t):
    return records.exploded_authors(t.nested_papers(), people.long_name)


@query("P19_exploded_categories", "SELECT id, unnest(string_split(categories, ' ')) AS category FROM papers")
def _(t):
    return records.exploded_categories(t.papers(), "id")


PRETTY_SQL = """
    SELECT p.id, string_agg(coalesce(m.pretty_name, p.c), '; ' ORDER BY p.pos) AS pretty_categories
    FROM (SELECT id, unnest(string_split(categories, ' ')) AS c,
                 generate_subscripts(string_split(categories, ' '), 1) AS pos FROM papers) p
    LEFT JOIN category_map m ON p.c = m.category_id GROUP BY p.id"""


@query("P20_pretty_categories", PRETTY_SQL)
def _(t):
    return records.with_pretty_categories(t.papers(), t.category_map()).select("id", "pretty_categories")


@query("P20_pretty_categories_large_map", PRETTY_SQL)
def _(t):
    shown = records.with_pretty_categories(t.papers().repartition(3), t.category_map().repartition(3))
    return shown.select("id", "pretty_categories")


@query("P21_truncated_title", """
    SELECT id, CASE WHEN length(f) > 30 THEN concat(substring(f, 1, 29), '…') ELSE f END AS title
    FROM (SELECT id, trim(regexp_replace(abstract, '\\s+', ' ', 'g')) AS f FROM papers)""")
def _(t):
    return t.papers().select("id", tx.truncated(F.col("abstract"), 30).alias("title"))


@query("P22_link_and_escape", """
    SELECT id, concat('https://example.org/abs/', id) AS url,
           replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS title FROM dated_papers""")
def _(t):
    return t.dated_papers().select("id", tx.link(F.col("id"), "https://example.org/abs/").alias("url"),
                                   tx.html_escaped(F.col("title")).alias("title"))


@query("P23_csv_quoting", "SELECT page_id, concat('\"', replace(html, '\"', '\"\"'), '\"') AS quoted, html FROM pages")
def _(t):
    path = new_path(t.spark, "quoted")
    quoted = t.pages.select("page_id", tx.csv_quoted(F.col("html")).alias("quoted"), "html")
    quoted.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return (t.spark.read.schema("page_id BIGINT, quoted STRING, html STRING").option("header", True)
            .option("multiLine", True).option("quote", '"').option("escape", '"').csv(path))


@query("P24_citation_column", "SELECT id, citations AS cit FROM dated_papers")
def _(t):
    papers = t.dated_papers()
    return papers.select("id", F.col(scan.citation_column(papers)).alias("cit"))


@query("P25_valid_counts", """
    SELECT id, CAST(citations AS BIGINT) AS cit FROM dated_papers WHERE TRY_CAST(citations AS BIGINT) >= 0""")
def _(t):
    counts = t.dated_papers().select("id", numeric.non_negative_long(F.col("citations")).alias("cit"))
    return counts.where(F.col("cit").isNotNull())


@query("P26_safe_file_name",
       "SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{N}_.-]', '_', 'g') AS name FROM pages")
def _(t):
    return t.pages.select("page_id", tx.safe_file_name(F.col("url")).alias("name"))


@query("P27_label_decode", """
    SELECT id, label_str, CAST(i AS DOUBLE) AS label, label_str AS decoded
    FROM clean_docs JOIN (SELECT label_str AS l, row_number() OVER (ORDER BY count(*) DESC, label_str) - 1 AS i
                          FROM clean_docs GROUP BY label_str) ON l = label_str""")
def _(t):
    docs = t.clean_docs().select("id", "label_str")
    model = features.label_indexer().fit(docs)
    back = IndexToString(inputCol="label", outputCol="decoded", labels=model.labels)
    return back.transform(model.transform(docs))


@query("P28_vector_components", """
    SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y
    FROM embeddings""")
def _(t):
    vectors = features.array_as_vector(t.embeddings.withColumnRenamed("vec_id", "id"), "embedding", "v")
    return features.components(vectors.select("id", "v"), "v", ["x", "y"]).select(
        "id", numeric.r6(F.col("x")).alias("x"), numeric.r6(F.col("y")).alias("y"))


@query("P29_densified", """
    SELECT doc_id AS id, CAST(sum(CASE WHEN w = 'the' THEN 1 ELSE 0 END) AS DOUBLE) AS n_the, 3 AS width
    FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM documents) GROUP BY doc_id""")
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), F.split(F.lower("text"), r"\s+").alias("words"))
    counted = features.fixed_vocabulary_counts(docs, "words", ["the", "of", "and"], "sparse")
    dense = features.densified(counted, "sparse", "dense")
    return features.components(dense, "dense", ["n_the"]).select("id", "n_the", F.lit(3).alias("width"))


@query("P30_folded_labels", """
    SELECT id, CASE WHEN label_str IN (SELECT label_str FROM clean_docs GROUP BY label_str
                                       ORDER BY count(*) DESC, label_str LIMIT 5)
                    THEN label_str ELSE 'OTHER' END AS label_folded FROM clean_docs""")
def _(t):
    return records.fold_rare_labels(t.clean_docs(), 5).select("id", "label_folded")
