"""Scores of predictions: confusion, metrics, curves, reports and comparisons.

Predictions are (y_true, y_pred, y_proba) rows. Curves work on the counts per distinct score,
ordered by range buckets, so no task sees all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.ranks import running_totals

CLASS_NAMES = {0: "Clean (0)", 1: "Buggy (1)"}


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def score_counts(predictions: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score."""
    return predictions.groupBy("y_proba").agg(
        F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg")
    )


def roc_auc(predictions: DataFrame) -> DataFrame:
    """Area under the ROC curve with average ranks for ties; 0.5 when a class is missing."""
    ranked = running_totals(score_counts(predictions), [], "y_proba", ["neg"])
    # Each positive beats the negatives below it and half of those with its own score.
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.agg(F.when(pairs > 0, won / pairs).otherwise(0.5).alias("roc_auc"))


def confusion_counts(predictions: DataFrame) -> DataFrame:
    true, pred = F.col("y_true") == 1, F.col("y_pred") == 1
    return predictions.agg(
        F.count("*").alias("n"),
        F.count_if(true & pred).alias("tp"),
        F.count_if(~true & pred).alias("fp"),
        F.count_if(true & ~pred).alias("fn"),
        F.count_if(F.col("y_true") == F.col("y_pred")).alias("hits"),
    )


def classification_metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 (0 on an empty denominator), and ROC AUC if scored."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scores = confusion_counts(predictions).select(
        _ratio(F.col("hits"), F.col("n")).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
    if "y_proba" in predictions.columns:
        scores = scores.withColumn("roc_auc", roc_auc(predictions).scalar())
    return scores


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """The four cells, zeros included."""
    grid = predictions.sparkSession.createDataFrame(
        [(t, p) for t in (0, 1) for p in (0, 1)], "y_true int, y_pred int"
    )
    cells = predictions.groupBy("y_true", "y_pred").agg(F.count("*").alias("count"))
    return grid.join(cells, ["y_true", "y_pred"], "left").fillna(0, ["count"])


def cumulative_counts(predictions: DataFrame) -> DataFrame:
    """Per threshold, from high to low: true and false positives at or above it, and totals."""
    ranked = running_totals(
        score_counts(predictions), [], "y_proba", ["pos", "neg"], descending=True
    )
    return ranked.select(
        F.col("y_proba").alias("threshold"),
        (F.col("pos_before") + F.col("pos")).alias("tp"),
        (F.col("neg_before") + F.col("neg")).alias("fp"),
        F.col("pos_total").alias("all_pos"),
        F.col("neg_total").alias("all_neg"),
    )


def roc_points(predictions: DataFrame) -> DataFrame:
    """(fpr, tpr, threshold) for every distinct score, and the origin at infinity.

    Points on a straight line between neighbours are kept. A rate of a class without rows is null.
    """
    points = cumulative_counts(predictions).select(
        F.try_divide("fp", "all_neg").alias("fpr"),
        F.try_divide("tp", "all_pos").alias("tpr"),
        "threshold",
    )
    origin = predictions.sparkSession.createDataFrame(
        [(0.0, 0.0, float("inf"))], "fpr double, tpr double, threshold double"
    )
    return points.unionByName(origin)


def precision_recall_points(predictions: DataFrame) -> DataFrame:
    """(precision, recall, threshold), and the end point precision 1, recall 0; without positives
    recall is null."""
    points = cumulative_counts(predictions).select(
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide("tp", "all_pos").alias("recall"),
        "threshold",
    )
    end = predictions.sparkSession.createDataFrame(
        [(1.0, 0.0, None)], "precision double, recall double, threshold double"
    )
    return points.unionByName(end)


def classification_report(predictions: DataFrame) -> DataFrame:
    """Per class precision, recall, F1 and support, then accuracy, macro and weighted means."""
    cells = predictions.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    classes = F.explode(F.array(*[F.lit(c) for c in CLASS_NAMES])).alias("c")
    by_class = (
        cells.select("y_true", "y_pred", "n", classes)
        .groupBy("c")
        .agg(
            F.sum(F.when((F.col("y_true") == F.col("c")) & (F.col("y_pred") == F.col("c")), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("y_pred") == F.col("c"), F.col("n")).otherwise(0)).alias("predicted"),
            F.sum(F.when(F.col("y_true") == F.col("c"), F.col("n")).otherwise(0)).alias("support"),
        )
    )
    names = F.create_map(*[F.lit(x) for pair in CLASS_NAMES.items() for x in pair])
    rows = by_class.select(
        F.element_at(names, F.col("c")).alias("label"),
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        F.col("support").cast("bigint").alias("support"),
        "tp",
    )
    scores = ["precision", "recall", "f1"]
    total = F.sum("support")
    accuracy = F.sum("tp") / total
    summary = rows.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("label"),
                *[accuracy.alias(s) for s in scores],
                total.alias("support"),
            ),
            F.struct(
                F.lit("macro avg").alias("label"),
                *[F.avg(s).alias(s) for s in scores],
                total.alias("support"),
            ),
            F.struct(
                F.lit("weighted avg").alias("label"),
                *[(F.sum(F.col(s) * F.col("support")) / total).alias(s) for s in scores],
                total.alias("support"),
            ),
        ).alias("r")
    ).select(F.inline("r"))
    return rows.drop("tp").unionByName(summary)


def compare_models(runs: list[DataFrame]) -> DataFrame:
    """Runs side by side, best ROC AUC (else F1) first."""
    table = runs[0]
    for run in runs[1:]:
        table = table.unionByName(run, allowMissingColumns=True)
    by = "roc_auc" if "roc_auc" in table.columns else "f1"
    return table.orderBy(F.col(by).desc_nulls_last())


def compare_with_baseline(baseline: DataFrame, fused: DataFrame) -> DataFrame:
    """Difference and percent improvement of each (metric, value) present in both."""
    joined = baseline.withColumnRenamed("value", "base").join(
        fused.withColumnRenamed("value", "new"), "metric"
    )
    diff = F.col("new") - F.col("base")
    return joined.select(
        "metric",
        diff.alias("diff"),
        F.when(F.col("base") > 0, diff / F.col("base") * 100).otherwise(0.0).alias("percent_improvement"),
    )


def as_long(metrics: DataFrame) -> DataFrame:
    """One-row metrics as (metric, value) rows."""
    return metrics.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                    for c in metrics.columns
                ]
            )
        )
    )
