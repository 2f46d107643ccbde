"""Evaluation of classifiers and clusterings."""

from __future__ import annotations

from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import functions as F

from corvane.functions.numeric import r6
from corvane.operators import evaluate, features
from corvane.queries.registry import query

METRICS = ("precision", "recall", "f1")

REPORT_SQL = """
    marg AS (SELECT label AS c FROM conf UNION SELECT prediction FROM conf),
    rep0 AS (SELECT m.c AS label, coalesce((SELECT sum(n) FROM conf WHERE label = m.c), 0) AS support,
                    coalesce((SELECT sum(n) FROM conf WHERE prediction = m.c), 0) AS predicted,
                    coalesce((SELECT sum(n) FROM conf WHERE label = m.c AND prediction = m.c), 0) AS tp FROM marg m),
    rep1 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
                    CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM rep0 WHERE support > 0),
    rep AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                           ELSE 0.0 END AS f1 FROM rep1)"""
CONF = "WITH conf AS (SELECT label, prediction, count(*) AS n FROM predictions GROUP BY 1, 2)"
CLUSTER_CONF = """WITH cont AS (SELECT cluster, label_str, count(*) AS n FROM clusters GROUP BY 1, 2),
    maj AS (SELECT cluster, label_str AS pred FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label_str) AS rn
            FROM cont) WHERE rn = 1),
    conf AS (SELECT label_str AS label, pred AS prediction, sum(n) AS n FROM cont JOIN maj USING (cluster) GROUP BY 1, 2)"""


def rounded(df, *columns):
    return df.withColumns({c: r6(F.col(c)) for c in columns})


@query("E01_accuracy_f1", f"""{CONF}, {REPORT_SQL}
    SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM rep""")
def _(t):
    counts = evaluate.confusion(t.predictions())
    return rounded(evaluate.overall(counts).select("accuracy", "f1_weighted"), "accuracy", "f1_weighted")


@query("E01_accuracy_f1_evaluator", f"""{CONF}, {REPORT_SQL}
    SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM rep""")
def _(t):
    model = features.label_indexer("label", "label_id").fit(t.predictions())
    guess = StringIndexerModel.from_labels(model.labels, inputCol="prediction", outputCol="guess_id",
                                           handleInvalid="skip")
    indexed = guess.transform(model.transform(t.predictions()))
    scores = {}
    for name, metric in (("accuracy", "accuracy"), ("f1_weighted", "f1")):
        scores[name] = MulticlassClassificationEvaluator(
            labelCol="label_id", predictionCol="guess_id", metricName=metric).evaluate(indexed)
    return rounded(t.spark.createDataFrame([scores], "accuracy DOUBLE, f1_weighted DOUBLE"), "accuracy", "f1_weighted")


@query("E02_weighted_precision_recall", f"""{CONF}, {REPORT_SQL}
    SELECT round(sum(precision * support) / sum(support), 6) AS precision_weighted,
           round(sum(recall * support) / sum(support), 6) AS recall_weighted FROM rep""")
def _(t):
    row = evaluate.overall(evaluate.confusion(t.predictions())).select("precision_weighted", "recall_weighted")
    return rounded(row, "precision_weighted", "recall_weighted")


@query("E03_confusions", f"{CONF} SELECT label, prediction, CAST(n AS BIGINT) AS n FROM conf ORDER BY n DESC, 1, 2 LIMIT 50")
def _(t):
    return evaluate.top_confusions(evaluate.confusion(t.predictions()))


@query("E04_off_diagonal_named", f"""{CONF}, names AS (SELECT event_type AS label, upper(event_type) AS name
      FROM (SELECT DISTINCT event_type FROM events))
    SELECT c.label, c.prediction, CAST(n AS BIGINT) AS n, a.name AS label_name, b.name AS prediction_name
    FROM conf c LEFT JOIN names a ON a.label = c.label LEFT JOIN names b ON b.label = c.prediction
    WHERE c.label <> c.prediction ORDER BY n DESC, 1, 2 LIMIT 50""")
def _(t):
    names = t.events.select(F.col("event_type").alias("label"), F.upper("event_type").alias("name")).distinct()
    worst = evaluate.top_confusions(evaluate.confusion(t.predictions()), 50, off_diagonal=True)
    return evaluate.decoded(worst, names)


@query("E05_confusion_matrix", f"""{CONF},
    mass AS (SELECT c FROM (SELECT label AS c, n FROM conf UNION ALL SELECT prediction, n FROM conf)
             GROUP BY c ORDER BY sum(n) DESC, c LIMIT 4)
    SELECT a.c AS label, b.c AS prediction, CAST(coalesce(n, 0) AS BIGINT) AS n
    FROM mass a CROSS JOIN mass b LEFT JOIN conf ON label = a.c AND prediction = b.c""")
def _(t):
    return evaluate.confusion_matrix(evaluate.confusion(t.predictions()), 4)


@query("J06_class_report", f"""{CONF}, {REPORT_SQL}
    SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
           CAST(support AS BIGINT) AS support FROM rep""")
def _(t):
    return rounded(evaluate.class_report(evaluate.confusion(t.predictions())).drop("tp"), *METRICS)


@query("A27_contingency", "SELECT cluster, label_str, CAST(count(*) AS BIGINT) AS n FROM clusters GROUP BY 1, 2")
def _(t):
    return evaluate.contingency(t.clusters())


@query("W02_majority_label", f"{CLUSTER_CONF} SELECT cluster, pred AS pred_label_str FROM maj")
def _(t):
    return evaluate.majority_labels(evaluate.contingency(t.clusters())).select("cluster", "pred_label_str")


@query("E06_purity", """
    SELECT round(sum(m) / sum(s), 6) AS purity FROM (SELECT max(n) AS m, sum(n) AS s FROM
      (SELECT cluster, label_str, count(*) AS n FROM clusters GROUP BY 1, 2) GROUP BY cluster)""")
def _(t):
    return rounded(evaluate.purity(evaluate.contingency(t.clusters())), "purity")


@query("E07_mutual_information", """
    WITH cont AS (SELECT cluster AS k, label_str AS c, count(*) AS n FROM clusters GROUP BY 1, 2),
         nc AS (SELECT c, sum(n) AS nc FROM cont GROUP BY c), nk AS (SELECT k, sum(n) AS nk FROM cont GROUP BY k),
         tot AS (SELECT sum(n) AS t FROM cont),
         hc AS (SELECT -sum(nc / t * ln(nc / t)) AS h FROM nc, tot), hk AS (SELECT -sum(nk / t * ln(nk / t)) AS h FROM nk, tot),
         mi AS (SELECT sum(n / t * ln(t * n / (nc * nk))) AS m FROM cont JOIN nc USING (c) JOIN nk USING (k), tot)
    SELECT round(m / sqrt(hc.h * hk.h), 6) AS nmi FROM mi, hc, hk""")
def _(t):
    return rounded(evaluate.mutual_information(evaluate.contingency(t.clusters())), "nmi")


SUMMARY_SQL = f"""{CLUSTER_CONF}
    SELECT cluster, CAST(sum(n) AS BIGINT) AS cluster_size, round(max(n) / sum(n), 6) AS purity, min(pred) AS pred_label_str
    FROM cont JOIN maj USING (cluster) GROUP BY cluster"""


@query("E08_cluster_summary", SUMMARY_SQL)
def _(t):
    return rounded(evaluate.cluster_summary(evaluate.contingency(t.clusters())), "purity")


@query("E08_relabelled_rows", f"""{CLUSTER_CONF}
    SELECT vec_id, label_str, cluster, pred AS pred_label_str FROM clusters LEFT JOIN maj USING (cluster)""")
def _(t):
    return evaluate.relabelled(t.clusters())


@query("E09_cluster_class_report", f"""{CLUSTER_CONF}, {REPORT_SQL}
    SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
           CAST(support AS BIGINT) AS support FROM rep""")
def _(t):
    counts = evaluate.cluster_confusion(evaluate.contingency(t.clusters()))
    return rounded(evaluate.class_report(counts).drop("tp"), *METRICS)


@query("E09_overall", f"""{CLUSTER_CONF}, {REPORT_SQL}
    SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS f1_macro,
           round(sum(precision * support) / sum(support), 6) AS precision_weighted,
           round(sum(recall * support) / sum(support), 6) AS recall_weighted,
           round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM rep""")
def _(t):
    row = evaluate.overall(evaluate.cluster_confusion(evaluate.contingency(t.clusters())))
    return rounded(row, *row.columns)


@query("E10_silhouette")
def _(t):
    vectors = features.array_as_vector(t.embeddings, "embedding", "features").select("features", "label")
    score = ClusteringEvaluator(predictionCol="label", featuresCol="features", metricName="silhouette",
                                distanceMeasure="squaredEuclidean").evaluate(vectors)
    return t.spark.createDataFrame([(score,)], "silhouette DOUBLE")


@query("E11_cluster_table", SUMMARY_SQL + " ORDER BY cluster")
def _(t):
    return rounded(evaluate.cluster_summary(evaluate.contingency(t.clusters())), "purity").orderBy("cluster")


@query("E11_largest_classes", f"""{CONF}, {REPORT_SQL}
    SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
           CAST(support AS BIGINT) AS support FROM rep ORDER BY support DESC, label LIMIT 20""")
def _(t):
    report = evaluate.class_report(evaluate.confusion(t.predictions())).drop("tp")
    return rounded(evaluate.largest_classes(report), *METRICS)
