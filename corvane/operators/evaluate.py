"""Classification and clustering metrics as aggregates over small count tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.numeric import ratio
from corvane.operators.stats import zero_filled


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n): the only pass over the predictions, everything else reads this."""
    return pred.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("n"))


def top_confusions(counts: DataFrame, k: int = 50, off_diagonal: bool = False) -> DataFrame:
    if off_diagonal:
        counts = counts.where(F.col("label") != F.col("prediction"))
    return counts.orderBy(F.desc("n"), "label", "prediction").limit(k)


def decoded(counts: DataFrame, names: DataFrame, key: str = "label", name: str = "name") -> DataFrame:
    """Label and prediction ids replaced by names; unknown ids stay null."""
    first = names.select(F.col(key).alias("label"), F.col(name).alias("label_name"))
    second = names.select(F.col(key).alias("prediction"), F.col(name).alias("prediction_name"))
    return counts.join(first, "label", "left").join(second, "prediction", "left")


def class_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every label that occurs. One union of the marginals and one
    aggregate; a label nothing was predicted as keeps its row with zeros."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = (counts.select("label", F.col("n").alias("support"), zero.alias("predicted"), hit.alias("tp"))
             .union(counts.select("prediction", zero, "n", zero)))
    totals = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    scored = (totals.where(F.col("support") > 0)
              .withColumn("precision", ratio(F.col("tp"), F.col("predicted")))
              .withColumn("recall", ratio(F.col("tp"), F.col("support"))))
    both = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both)).select(
        "label", "precision", "recall", "f1", "support", "tp")


def overall(counts: DataFrame) -> DataFrame:
    """Accuracy, macro F1 and the support-weighted precision, recall and F1 in one row."""
    report = class_report(counts)

    def weighted(column: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.col(column) * F.col("support")), F.sum("support")), F.lit(0.0))

    return report.agg(
        F.coalesce(F.try_divide(F.sum("tp"), F.sum("support")), F.lit(0.0)).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        weighted("precision").alias("precision_weighted"),
        weighted("recall").alias("recall_weighted"),
        weighted("f1").alias("f1_weighted"),
    )


def confusion_matrix(counts: DataFrame, classes: int = 30) -> DataFrame:
    """Cells of the classes with the most rows plus columns, zero filled, from the full counts."""
    mass = (counts.select(F.col("label").alias("c"), "n").union(counts.select("prediction", "n"))
            .groupBy("c").agg(F.sum("n").alias("mass")).orderBy(F.desc("mass"), "c").limit(classes))
    rows = mass.select(F.col("c").alias("label"))
    cols = mass.select(F.col("c").alias("prediction"))
    return zero_filled(counts, rows, "label", cols, "prediction", "n")


# ---- clusterings ---------------------------------------------------------------------------------------------

def contingency(df: DataFrame, cluster: str = "cluster", label: str = "label_str") -> DataFrame:
    return df.groupBy(F.col(cluster).alias("cluster"), F.col(label).alias("label_str")).agg(F.count("*").alias("n"))


def purity(table: DataFrame) -> DataFrame:
    """Share of rows that carry their cluster's most frequent label; 0 for no rows."""
    best = table.groupBy("cluster").agg(F.max("n").alias("top"), F.sum("n").alias("size"))
    return best.agg(F.coalesce(F.try_divide(F.sum("top"), F.sum("size")), F.lit(0.0)).alias("purity"))


def mutual_information(table: DataFrame) -> DataFrame:
    """Normalised mutual information: natural log, square root of the entropies' product, 0 when that is 0."""
    table = table.where(F.col("n") > 0)
    by_label = table.groupBy("label_str").agg(F.sum("n").alias("n_label"))
    by_cluster = table.groupBy("cluster").agg(F.sum("n").alias("n_cluster"))
    total = table.agg(F.sum("n")).scalar()

    def entropy(marginal: DataFrame, column: str) -> Column:
        share = F.col(column) / total
        return marginal.agg(F.coalesce(-F.sum(share * F.log(share)), F.lit(0.0))).scalar()

    cells = table.join(by_label, "label_str").join(by_cluster, "cluster")
    gain = (F.col("n") / total) * F.log(total * F.col("n") / (F.col("n_label") * F.col("n_cluster")))
    spread = F.sqrt(entropy(by_label, "n_label") * entropy(by_cluster, "n_cluster"))
    return (cells.agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias("mi"))
            .select(F.when(spread > 0, F.col("mi") / spread).otherwise(F.lit(0.0)).alias("nmi")))


def majority_labels(table: DataFrame) -> DataFrame:
    """The most frequent label of each cluster, ties to the smaller label."""
    best = table.groupBy("cluster").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("label_str").alias("l"))).alias("best"),
        F.sum("n").alias("cluster_size"))
    return best.select("cluster", F.col("best.l").alias("pred_label_str"), (-F.col("best.neg")).alias("top_count"),
                       "cluster_size")


def cluster_summary(table: DataFrame) -> DataFrame:
    """Size, purity and majority label per cluster."""
    return majority_labels(table).select(
        "cluster", "cluster_size", (F.col("top_count") / F.col("cluster_size")).alias("purity"), "pred_label_str")


def relabelled(df: DataFrame, cluster: str = "cluster", label: str = "label_str") -> DataFrame:
    """Every row with its cluster's majority label as prediction."""
    mapping = majority_labels(contingency(df, cluster, label)).select(F.col("cluster").alias(cluster), "pred_label_str")
    return df.join(mapping, cluster, "left")


def cluster_confusion(table: DataFrame) -> DataFrame:
    """Label against majority label, from the contingency table alone."""
    mapping = majority_labels(table).select("cluster", F.col("pred_label_str").alias("prediction"))
    return (table.join(mapping, "cluster").groupBy(F.col("label_str").alias("label"), "prediction")
            .agg(F.sum("n").alias("n")))


def largest_classes(report: DataFrame, k: int = 20) -> DataFrame:
    return report.orderBy(F.desc("support"), "label").limit(k)


