"""Classifier metrics from prediction tables.

All functions take ``actual_label`` (0/1), ``predicted_label`` and ``predicted_probability`` and group by optional
key columns such as model and split. Rank metrics are exact: predictions are first merged to one row per distinct
score, then cumulated along the score.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from augury.functions.numbers import clip, safe_div, significance_stars
from augury.operators.ordered import null_safe_join, ordered, small
from augury.session import materialise

# Fixed value: distance from 0 and 1 at which the log loss is cut off (machine epsilon of doubles).
EPSILON = 2.220446049250313e-16


def _join(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    return null_safe_join(a, b, by, how)


def score_steps(predictions: DataFrame, by: list[str] | None = None, limit: int | None = None, times: str | None = None) -> DataFrame:
    """Per distinct score: its positives and negatives, those at or above it (tp, fp), and the totals.

    ``times``: a column that says how many predictions a row stands for.
    """
    by = list(by or [])
    positive = F.col("actual_label") == 1
    times = F.lit(1) if times is None else F.col(times)
    counted = lambda is_one: F.sum(F.when(is_one, times).otherwise(0)).cast("bigint")
    # Written once: its readers are the count of groups, their totals and the ordered scan.
    steps = materialise(
        predictions.groupBy(*by, F.col("predicted_probability").alias("score")).agg(
            counted(positive).alias("pos"), counted(~positive).alias("neg")
        ),
        "steps",
    )
    totals = steps.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    if by:  # joined by shuffle, a group would be one task
        totals = materialise(totals, "totals")
        totals = small(totals, totals.count())
    cumulated = ordered(steps, by, ["score"], limit)
    cumulated = cumulated.running("sum", F.col("pos"), "pos_upto").running("sum", F.col("neg"), "neg_upto").df
    return _join(cumulated, totals, by).select(
        *by, "score", "pos", "neg", "all_pos", "all_neg",
        (F.col("all_pos") - F.col("pos_upto") + F.col("pos")).alias("tp"),
        (F.col("all_neg") - F.col("neg_upto") + F.col("neg")).alias("fp"),
    )


def rank_metrics(predictions: DataFrame, by: list[str] | None = None, limit: int | None = None, times: str | None = None) -> DataFrame:
    """Exact area under the ROC curve and average precision; 0.5 and 0 where only one class is present."""
    by = list(by or [])
    steps = score_steps(predictions, by, limit, times)
    # A positive beats all negatives with lower scores and half of those with its own.
    beaten = F.col("pos") * (F.col("all_neg") - F.col("fp") + F.col("neg") / 2.0)
    area = safe_div(F.sum(beaten), F.first("all_pos").cast("double") * F.first("all_neg"))
    precision = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    one_class = (F.first("all_pos") == 0) | (F.first("all_neg") == 0)
    return steps.groupBy(*by).agg(
        F.when(one_class, 0.5).otherwise(area).alias("auc_roc"),
        F.when(one_class, 0.0).otherwise(safe_div(precision, F.first("all_pos"))).alias("avg_precision"),
    )


def _confusion_counts() -> list[Column]:
    actual, predicted = F.col("actual_label") == 1, F.col("predicted_label") == 1
    return [
        F.count_if(actual & predicted).alias("tp"),
        F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"),
        F.count_if(~actual & ~predicted).alias("tn"),
    ]


def _log_loss() -> Column:
    p = clip(F.col("predicted_probability"), F.lit(EPSILON), F.lit(1 - EPSILON))
    return F.avg(-F.when(F.col("actual_label") == 1, F.log(p)).otherwise(F.log1p(-p)))


def _brier() -> Column:
    gap = F.col("predicted_probability") - F.col("actual_label")
    return F.avg(gap * gap)


def _f1(precision: Column, recall: Column) -> Column:
    return safe_div(2 * precision * recall, precision + recall)


def threshold_metrics(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1, log loss and Brier score in one aggregate; undefined ratios are 0."""
    by = list(by or [])
    counts = predictions.groupBy(*by).agg(
        F.count("*").alias("n"), *_confusion_counts(), _log_loss().alias("log_loss"), _brier().alias("brier_score")
    )
    precision = safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(
        *by,
        safe_div(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1"),
        "log_loss",
        "brier_score",
    )


def evaluate(predictions: DataFrame, by: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """All eight test metrics per group."""
    by = list(by or [])
    return _join(threshold_metrics(predictions, by), rank_metrics(predictions, by, limit), by)


def class_report(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class that occurs in the actual labels."""
    by = list(by or [])
    counts = predictions.groupBy(*by).agg(*_confusion_counts())
    row = lambda name, hit, false, miss: F.struct(
        F.lit(name).alias("class"), F.col(hit).alias("hit"), F.col(false).alias("false"), F.col(miss).alias("miss")
    )
    rows = counts.select(*by, F.inline(F.array(row("Noise", "tn", "fn", "fp"), row("Informed", "tp", "fp", "fn"))))
    precision = safe_div(F.col("hit"), F.col("hit") + F.col("false"))
    recall = safe_div(F.col("hit"), F.col("hit") + F.col("miss"))
    return rows.where(F.col("hit") + F.col("miss") > 0).select(
        *by, "class", precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"),
        (F.col("hit") + F.col("miss")).alias("support"),
    )


def confusion_matrix(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Four cells per group, zeros included."""
    by = list(by or [])
    counts = predictions.groupBy(*by).agg(*_confusion_counts())
    cell = lambda a, p, c: F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n"))
    return counts.select(*by, F.inline(F.array(cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp"))))


def roc_points(predictions: DataFrame, by: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """False and true positive rate at every distinct score, and the start at (0, 0) with an infinite threshold."""
    by = list(by or [])
    steps = score_steps(predictions, by, limit)
    points = steps.select(
        *by,
        F.col("score").alias("threshold"),
        F.try_divide("fp", "all_neg").alias("fpr"),
        F.try_divide("tp", "all_pos").alias("tpr"),
    )
    start = predictions.select(*by).distinct() if by else predictions.agg(F.count("*").alias("_n")).drop("_n")
    zero = F.lit(0.0)
    start = start.select(*by, F.lit(float("inf")).alias("threshold"), zero.alias("fpr"), zero.alias("tpr"))
    return points.unionByName(start)


def pr_points(predictions: DataFrame, by: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Precision and recall at every distinct score."""
    by = list(by or [])
    return score_steps(predictions, by, limit).select(
        *by,
        F.col("score").alias("threshold"),
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide("tp", "all_pos").alias("recall"),
    )


def calibration_bins(predictions: DataFrame, by: list[str] | None = None, bins: int = 8) -> DataFrame:
    """Mean probability and observed rate per bin of equal width, closed on the right; empty bins are absent."""
    by = list(by or [])
    place = F.greatest(F.ceil(F.col("predicted_probability") * bins).cast("int") - 1, F.lit(0))
    return predictions.groupBy(*by, place.alias("bin")).agg(
        F.count("*").alias("n"),
        F.avg("predicted_probability").alias("mean_predicted"),
        F.avg(F.col("actual_label").cast("double")).alias("observed_rate"),
    )


@F.pandas_udf(T.DoubleType())
def _chi2_tail(chi2: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution with one degree of freedom."""
    return chi2.map(lambda x: math.erfc(math.sqrt(x / 2.0)))


def mcnemar(a: DataFrame, b: DataFrame, key: str = "address") -> DataFrame:
    """Continuity-corrected McNemar test of two models on the same rows."""
    left = a.select(key, (F.col("predicted_label") == F.col("actual_label")).alias("a_right"))
    right = b.select(key, (F.col("predicted_label") == F.col("actual_label")).alias("b_right"))
    counts = left.join(right, key).agg(
        F.count_if(F.col("a_right") & ~F.col("b_right")).alias("a_only"),
        F.count_if(~F.col("a_right") & F.col("b_right")).alias("b_only"),
    )
    n = F.col("a_only") + F.col("b_only")
    gap = F.abs(F.col("a_only") - F.col("b_only")) - 1
    tested = counts.withColumn("chi2", safe_div(gap * gap, n)).withColumn(
        "p_value", F.when(n == 0, 1.0).otherwise(_chi2_tail(F.col("chi2")))
    )
    return tested.withColumn("significance", significance_stars(F.col("p_value")))


def mcnemar_pairs(predictions: dict[str, DataFrame], key: str = "address") -> DataFrame:
    """The test for every pair of models, one row each."""
    names = list(predictions)
    tables = [
        mcnemar(predictions[x], predictions[y], key).select(F.lit(x).alias("model_a"), F.lit(y).alias("model_b"), "*")
        for i, x in enumerate(names)
        for y in names[i + 1:]
    ]
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return result


def overfit_flags(predictions: DataFrame, by: list[str] | None = None, gap: float = 0.05, limit: int | None = None) -> DataFrame:
    """Area under the curve per split, side by side, and whether training beats the others by more than ``gap``.

    ``predictions`` holds the rows of all splits in a column ``split``.
    """
    by = list(by or [])
    areas = rank_metrics(predictions, [*by, "split"], limit)
    wide = areas.groupBy(*by).agg(
        *[F.max(F.when(F.col("split") == s, F.col("auc_roc"))).alias(f"{s}_auc") for s in ("train", "val", "test")]
    )
    over = lambda s: F.coalesce(F.col("train_auc") - F.col(f"{s}_auc") > gap, F.lit(False))
    return wide.withColumns({"overfit_warning_val": over("val"), "overfit_warning_test": over("test")})
