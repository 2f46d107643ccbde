"""The data model as views over the given tables, once as DataFrames and once as SQL.

Every view covers its whole tables. ``papers`` are the documents; ``dated_papers`` are the orders (they carry
dates and numbers); ``paper_authors`` are the suppliers of an order; ``citations`` link customers to suppliers;
``order_links`` link an order to the same customer's previous one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as tx

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
         "embeddings", "pages", "benchmark", "labels", "conversations")


def clean_sql(expr: str) -> str:
    """SQL twin of ``text.clean``."""
    out = f"lower({expr})"
    for pattern in tx.CLEANING_ORDER:
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    return f"trim({out})"


VIEW_SQL: dict[str, str] = {
    "papers": """
        SELECT d.doc_id AS id, substring(d.text, 1, 60) AS title, d.text AS abstract,
               concat_ws(' ', concat(d.lang, '.', d.source), d.source,
                         CASE WHEN l.quality = 1 THEN 'q.hi' WHEN l.quality = 0 THEN 'q.lo' END) AS categories
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "clean_docs": f"""
        SELECT id, string_split(categories, ' ')[1] AS label_str,
               {clean_sql("concat_ws(' ', title, abstract)")} AS text_clean
        FROM papers""",
    "tokens": """
        SELECT id, label_str, t.token FROM clean_docs, unnest(string_split(text_clean, ' ')) AS t(token)
        WHERE t.token <> ''""",
    "nested_papers": """
        SELECT doc_id AS id, list_transform(string_split(text, chr(10)), lambda x: string_split(x, ' ')) AS authors_parsed
        FROM documents""",
    "nested_authors": """
        SELECT id, concat_ws(' ', a[1], a[2]) AS author
        FROM (SELECT id, unnest(authors_parsed) AS a FROM nested_papers)
        WHERE concat_ws(' ', a[1], a[2]) <> ''""",
    "dated_papers": """
        SELECT o_orderkey AS id, concat(o_orderpriority, '  <', o_orderstatus, '> & ', o_orderkey) AS title,
               concat_ws(' ', concat('pri.', substring(o_orderpriority, 1, 1)), concat('st.', o_orderstatus),
                         CASE WHEN o_totalprice > 200000 THEN 'val.hi' END) AS categories,
               strftime(o_orderdate, '%a, %-d %b %Y %H:%M:%S GMT') AS created,
               strftime(o_orderdate, '%Y-%m-%d') AS update_date,
               CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) - 20 AS VARCHAR) AS citations
        FROM orders""",
    "paper_years": """
        SELECT id, CAST(substring(update_date, 1, 4) AS BIGINT) AS yr FROM dated_papers""",
    "paper_authors": """
        SELECT DISTINCT l.l_orderkey AS id, s.s_name AS author
        FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey""",
    "paper_versions": """
        SELECT concat(l_orderkey, '/', l_linenumber) AS id, l_shipdate AS update_date,
               l_partkey, l_suppkey, l_returnflag, l_linestatus
        FROM lineitem""",
    "citations": """
        SELECT CAST(o.o_custkey AS BIGINT) AS src, l.l_suppkey AS dst
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""",
    "clean_edges": "SELECT DISTINCT src, dst FROM citations WHERE src <> dst",
    "sym_edges": "SELECT src, dst FROM clean_edges UNION SELECT dst, src FROM clean_edges",
    "vertices": "SELECT src AS id FROM citations UNION SELECT dst FROM citations",
    "order_links": """
        SELECT o_orderkey AS src, prev AS dst
        FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev
              FROM orders) WHERE prev IS NOT NULL""",
    "order_sym": "SELECT src, dst FROM order_links UNION SELECT dst, src FROM order_links",
    "predictions": """
        SELECT event_id, event_type AS label,
               CASE event_id % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase'
                                 WHEN 3 THEN 'error' ELSE event_type END AS prediction
        FROM events""",
    "clusters": """
        SELECT vec_id, CAST(label AS VARCHAR) AS label_str,
               CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS cluster
        FROM embeddings""",
    "reference_lists": """
        SELECT concat(source, '/', doc_id) AS src, string_split(text, ' ') AS refs FROM documents""",
    "category_map": """
        SELECT DISTINCT concat(lang, '.', source) AS category_id,
               concat(upper(lang), ' collection ', source) AS pretty_name, lang AS group_name
        FROM documents""",
    "lemma_dict": """
        SELECT DISTINCT token AS form, regexp_replace(token, '(ing|ed|s)$', '') AS lemma FROM tokens
        WHERE regexp_matches(token, '^[a-z]{2,}(ing|ed|s)$')""",
}


class Tables:
    """Lazily read tables of one scale-factor folder, and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in GIVEN:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def papers(self) -> DataFrame:
        quality = F.when(F.col("quality") == 1, "q.hi").when(F.col("quality") == 0, "q.lo")
        return (self.documents.join(self.labels, "doc_id", "left")
                .select(F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("title"),
                        F.col("text").alias("abstract"),
                        F.concat_ws(" ", F.concat_ws(".", "lang", "source"), "source", quality).alias("categories")))

    def clean_docs(self) -> DataFrame:
        return self.papers().select("id", tx.primary_category(F.col("categories")).alias("label_str"),
                                    tx.clean(tx.joined_text("title", "abstract")).alias("text_clean"))

    def nested_papers(self) -> DataFrame:
        lines = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
        return self.documents.select(F.col("doc_id").alias("id"), lines.alias("authors_parsed"))

    def dated_papers(self) -> DataFrame:
        o = self.orders
        created = F.concat(F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT"))
        return o.select(
            F.col("o_orderkey").alias("id"),
            F.concat("o_orderpriority", F.lit("  <"), "o_orderstatus", F.lit("> & "), "o_orderkey").alias("title"),
            F.concat_ws(" ", F.concat(F.lit("pri."), F.substring("o_orderpriority", 1, 1)),
                        F.concat(F.lit("st."), "o_orderstatus"),
                        F.when(F.col("o_totalprice") > 200000, "val.hi")).alias("categories"),
            F.array(F.struct(F.lit("v1").alias("version"), created.alias("created"))).alias("versions"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("update_date"),
            (F.floor(F.col("o_totalprice") / 1000) - 20).cast("string").alias("citations"),
        )

    def paper_authors(self) -> DataFrame:
        s = self.supplier.select("s_suppkey", F.col("s_name").alias("author"))
        return (self.lineitem.select(F.col("l_orderkey").alias("id"), "l_suppkey")
                .join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("id", "author").distinct())

    def paper_versions(self) -> DataFrame:
        return self.lineitem.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id"),
                                    F.col("l_shipdate").alias("update_date"),
                                    "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")

    def citations(self) -> DataFrame:
        o = self.orders.select("o_orderkey", F.col("o_custkey").cast("bigint").alias("src"))
        return (self.lineitem.select("l_orderkey", F.col("l_suppkey").alias("dst"))
                .join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("src", "dst"))

    def order_links(self) -> DataFrame:
        w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        return (self.orders.select(F.col("o_orderkey").alias("src"), F.lag("o_orderkey").over(w).alias("dst"))
                .where(F.col("dst").isNotNull()))

    def predictions(self) -> DataFrame:
        turn = F.col("event_id") % 5
        guess = (F.when(turn == 0, "click").when(turn == 1, "view").when(turn == 2, "purchase")
                 .when(turn == 3, "error").otherwise(F.col("event_type")))
        return self.events.select("event_id", F.col("event_type").alias("label"), guess.alias("prediction"))

    def clusters(self) -> DataFrame:
        cluster = F.when(F.col("vec_id") % 3 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
        return self.embeddings.select("vec_id", F.col("label").cast("string").alias("label_str"),
                                      cluster.alias("cluster"))

    def reference_lists(self) -> DataFrame:
        return self.documents.select(F.concat_ws("/", "source", "doc_id").alias("src"),
                                     F.split("text", " ").alias("refs"))

    def category_map(self) -> DataFrame:
        return self.documents.select(
            F.concat_ws(".", "lang", "source").alias("category_id"),
            F.concat(F.upper("lang"), F.lit(" collection "), "source").alias("pretty_name"),
            F.col("lang").alias("group_name")).distinct()

    def lemma_dict(self) -> DataFrame:
        forms = tx.exploded(self.clean_docs(), F.split("text_clean", " "), "form")
        return (forms.where(F.col("form").rlike("^[a-z]{2,}(ing|ed|s)$")).distinct()
                .withColumn("lemma", F.regexp_replace("form", "(ing|ed|s)$", "")))
