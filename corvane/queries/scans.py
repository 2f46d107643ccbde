"""Sources, sinks, samples."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.numeric import r6
from corvane.operators import features
from corvane.plans.runtime import new_path
from corvane.queries.registry import query
from corvane.queries.views import Tables
from corvane.sources import scan, sink


def snapshot(t: Tables) -> str:
    """The papers written as JSON lines, the shape the readers expect."""
    path = new_path(t.spark, "snapshot")
    t.papers().withColumn("id", F.col("id").cast("string")).write.json(path)
    return path


PAPER_SQL = "SELECT CAST(id AS VARCHAR) AS id, title, abstract, categories FROM papers"


@query("S01_json_snapshot", PAPER_SQL)
def _(t):
    return scan.read_papers(t.spark, snapshot(t)).select("id", "title", "abstract", "categories")


@query("S02_projected_scan", "SELECT CAST(id AS VARCHAR) AS id, categories FROM papers")
def _(t):
    return scan.read_papers(t.spark, snapshot(t), ["id", "categories"])


@query("S03_edge_text", """
    SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM citations
    UNION ALL SELECT n_name, concat(n_name, ',', n_nationkey) FROM nation""")
def _(t):
    lines = (t.citations().select(F.concat_ws(",", "src", "dst").alias("value"))
             .union(t.nation.select(F.concat_ws(",", "n_name", "n_name", "n_nationkey")))
             .union(t.region.select("r_name"))
             .union(t.region.select(F.lit("src,dst"))))
    path = new_path(t.spark, "edges")
    lines.write.text(path)
    return scan.read_edges(t.spark, path)


@query("S04_category_csv", "SELECT category_id, pretty_name, group_name FROM category_map")
def _(t):
    path = new_path(t.spark, "categories")
    sink.write_single_csv(t.category_map(), path)
    return scan.read_category_map(t.spark, path)


@query("S05_parquet_scan", """
    SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS qty
    FROM lineitem GROUP BY l_returnflag""")
def _(t):
    return (t.lineitem.groupBy("l_returnflag")
            .agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")))


@query("S06_embedding_scan", """
    SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dims,
           round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 5) AS norm2 FROM embeddings""")
def _(t):
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return (scan.read_embeddings(t.spark, f"{t.sf_dir}/embeddings.parquet", "vec_id")
            .select("id", F.size("embedding").alias("dims"), F.round(square, 5).alias("norm2")))


KEPT = ("src0", "src3", "src7")
KEPT_SQL = "regexp_extract(src, '^([^/]+)/', 1) IN ('src0', 'src3', 'src7')"


@query("S07_adjacency_edges",
       f"SELECT src, unnest(refs) AS dst FROM reference_lists WHERE {KEPT_SQL}")
def _(t):
    return scan.adjacency_edges(t.reference_lists(), KEPT)


@query("S07_adjacency_edges_limited", """
    SELECT src, dst FROM (
      SELECT src, dst, row_number() OVER (ORDER BY src, pos) AS rn FROM (
        SELECT src, unnest(refs) AS dst, generate_subscripts(refs, 1) AS pos FROM reference_lists))
    WHERE rn <= 5000""")
def _(t):
    return scan.adjacency_edges(t.reference_lists(), max_edges=5000)


@query("S08_source_categories",
       "SELECT DISTINCT regexp_extract(src, '^([^/]+)/', 1) AS category FROM reference_lists")
def _(t):
    return scan.source_categories(t.reference_lists()).orderBy("category")


@query("S09_out_degree_sample", f"""
    SELECT round(avg(n), 6) AS avg_out_degree, CAST(max(n) AS BIGINT) AS max_out_degree,
           CAST(sum(n) AS BIGINT) AS total_edges
    FROM (SELECT n, sum(n) OVER (ORDER BY src) AS upto
          FROM (SELECT src, len(refs) AS n FROM reference_lists WHERE {KEPT_SQL}))
    WHERE upto - n < 5000""")
def _(t):
    stats = scan.out_degree_sample(t.reference_lists(), KEPT, 5000)
    return stats.withColumn("avg_out_degree", r6(F.col("avg_out_degree")))


@query("S10_hash_sample", """
    SELECT id, abstract FROM papers
    WHERE substring(md5(concat('42:', CAST(id AS VARCHAR))), 1, 8) < '40000000'""")
def _(t):
    return scan.shuffled(scan.hash_sample(t.papers().select("id", "abstract"), "id", 0.25, 42), "id", 42)


@query("S11_parquet_sink", "SELECT id, label_str, text_clean FROM clean_docs")
def _(t):
    return sink.write_parquet(t.clean_docs(), new_path(t.spark, "clean"), files=8)


@query("S12_partitioned_csv", "SELECT id, categories, label_str FROM "
       "(SELECT id, categories, string_split(categories, ' ')[1] AS label_str FROM papers)")
def _(t):
    path = new_path(t.spark, "by-category")
    labelled = t.papers().select("id", "categories", F.get(F.split("categories", " "), F.lit(0)).alias("label_str"))
    sink.write_partitioned_csv(labelled, path, "label_str")
    return t.spark.read.schema("id BIGINT, categories STRING, label_str STRING").option("header", True).csv(path)


@query("S13_single_csv", """
    SELECT category, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(categories, ' ')) AS category FROM papers)
    GROUP BY category""")
def _(t):
    path = new_path(t.spark, "export")
    counts = (t.papers().select(F.explode(F.split("categories", " ")).alias("category"))
              .groupBy("category").agg(F.count("*").alias("n")))
    sink.write_single_csv(counts, path, quote_all=True)
    return t.spark.read.schema("category STRING, n BIGINT").option("header", True).csv(path)


@query("S14_top_lists", """
    SELECT author, CAST(count(*) AS BIGINT) AS n FROM paper_authors GROUP BY author ORDER BY n DESC, author LIMIT 50""")
def _(t):
    path = new_path(t.spark, "top50")
    top = (t.paper_authors().groupBy("author").agg(F.count("*").alias("n"))
           .orderBy(F.desc("n"), "author").limit(50))
    sink.write_single_csv(top, path)
    return t.spark.read.schema("author STRING, n BIGINT").option("header", True).csv(path)


@query("S15_key_value_summary", """
    SELECT 'papers' AS key, CAST(count(*) AS VARCHAR) AS value FROM papers
    UNION ALL SELECT 'longest', CAST(max(length(abstract)) AS VARCHAR) FROM papers""")
def _(t):
    path = new_path(t.spark, "summary")
    one = t.papers().agg(F.count("*").alias("papers"), F.max(F.length("abstract")).alias("longest"))
    sink.write_key_values(sink.key_values(one), path)
    return t.spark.read.schema("key STRING, value STRING").json(f"{path}/json")


@query("S16_model_save_load")
def _(t):
    docs, path = t.clean_docs(), new_path(t.spark, "model")
    model = features.tfidf_stages(num_features=1 << 16).fit(docs)
    model.write().overwrite().save(path)
    assert isinstance(features.tfidf_stages(), Pipeline)
    return features.feature_summary(PipelineModel.load(path).transform(docs))


@query("S17_skip_if_present", "SELECT id, label_str FROM clean_docs")
def _(t):
    path = new_path(t.spark, "labels")

    def build() -> DataFrame:
        return t.clean_docs().select("id", "label_str")

    sink.materialised(t.spark, path, build)
    return sink.materialised(t.spark, path, build)


@query("S18_append_log", """
    SELECT CAST(event_type AS VARCHAR) AS config, CAST(count(*) AS BIGINT) AS n,
           CASE WHEN event_type IN ('click', 'view') THEN round(avg(value), 6) END AS mean_value
    FROM events GROUP BY event_type""")
def _(t):
    groups = t.events.groupBy(F.col("event_type").alias("config"))
    first = groups.agg(F.count("*").alias("n"))
    again = (groups.agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean_value"))
             .where(F.col("config").isin("click", "view")))
    path = sink.append_log(t.spark, None, first, "config")
    return sink.read_log(t.spark, sink.append_log(t.spark, path, again, "config"), "config")
