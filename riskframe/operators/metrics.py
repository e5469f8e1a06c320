"""Classification metrics over a scored table.

Counts are aggregated first (map-side combined, so a class or model holding most rows is no problem);
everything after that works on a table of label pairs. ``by`` groups by model, fold, run or any column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions import mean_pm_std as mean_pm_std_expr
from riskframe.functions import safe_ratio

LOG_LOSS_FLOOR = 1e-15


def _count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0)))


def confusion_matrix(
    df: DataFrame, labels: Sequence[int], target: str = "y", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """(actual, predicted, n) for every pair of the given labels, zero cells kept."""
    by = list(by)
    counted = (
        df.where(F.col(target).isNotNull() & F.col(prediction).isNotNull())
        .groupBy(*by, F.col(target).alias("actual"), F.col(prediction).alias("predicted"))
        .agg(F.count("*").alias("n"))
    )
    zero = F.lit(0).cast("bigint")
    grid = F.array(
        *[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), zero.alias("n")) for a in labels for p in labels]
    )
    if by:
        # each counted row also brings the zero grid of its group; summing merges both without a join
        own = F.array(F.struct(F.col("actual"), F.col("predicted"), F.col("n")))
        filled = counted.select(*by, F.inline(F.concat(own, grid)))
    else:
        filled = counted.unionByName(df.sparkSession.range(1).select(F.inline(grid)))
    return filled.groupBy(*by, "actual", "predicted").agg(F.sum("n").alias("n"))


def confusion_wide(matrix: DataFrame, labels: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """The matrix for display: one row per actual label, one column per predicted label."""
    return matrix.groupBy(*by, "actual").pivot("predicted", list(labels)).agg(F.sum("n"))


def accuracy(df: DataFrame, target: str = "y", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Share of right predictions over the ``n`` rows that have both a truth and a prediction."""
    right = (F.col(target) == F.col(prediction)).cast("double")
    return df.groupBy(*by).agg(F.count(right).alias("n"), F.avg(right).alias("accuracy"))


def binary_counts(target: str = "y", prediction: str = "prediction") -> list[Column]:
    """Aggregates for the four cells, positive class 1."""
    y, p = F.col(target), F.col(prediction)
    return [
        _count_if((y == 1) & (p == 1)).alias("tp"),
        _count_if((y != 1) & (p == 1)).alias("fp"),
        _count_if((y == 1) & (p != 1)).alias("fn"),
        _count_if((y != 1) & (p != 1)).alias("tn"),
    ]


def binary_metrics_from_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.select(
        *by,
        (tp + fp + fn + tn).alias("n"),
        safe_ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tp, tp + fn).alias("recall"),
        safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def precision_recall_f1(
    df: DataFrame, target: str = "y", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class; 0 where a denominator is 0."""
    return binary_metrics_from_counts(df.groupBy(*by).agg(*binary_counts(target, prediction)), by)


def per_class_metrics(
    df: DataFrame, target: str = "y", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """One row per label with that label as the positive class."""
    by = list(by)
    pairs = (
        df.where(F.col(target).isNotNull() & F.col(prediction).isNotNull())
        .groupBy(*by, F.col(target).alias("__a"), F.col(prediction).alias("__p"))
        .agg(F.count("*").alias("__n"))
    )
    zero = F.lit(0).cast("bigint")
    as_actual = F.struct(
        F.col("__a").alias("label"),
        F.when(F.col("__a") == F.col("__p"), F.col("__n")).otherwise(zero).alias("tp"),
        F.col("__n").alias("support"),
        zero.alias("predicted"),
    )
    as_predicted = F.struct(
        F.col("__p").alias("label"), zero.alias("tp"), zero.alias("support"), F.col("__n").alias("predicted")
    )
    sums = (
        pairs.select(*by, F.inline(F.array(as_actual, as_predicted)))
        .groupBy(*by, "label")
        .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    )
    return sums.select(
        *by,
        "label",
        safe_ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        safe_ratio(F.col("tp"), F.col("support")).alias("recall"),
        safe_ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "tp",
    )


_SCORES = ("precision", "recall", "f1")


def _macro(name: str) -> Column:
    return F.avg(name)


def _weighted(name: str) -> Column:
    return safe_ratio(F.sum(F.col(name) * F.col("support")), F.sum("support"))


def weighted_prf(df: DataFrame, target: str = "y", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Per-class values weighted by support; F1 is averaged, not rebuilt from averages."""
    return (
        per_class_metrics(df, target, prediction, by)
        .groupBy(*by)
        .agg(*[_weighted(m).alias(m) for m in _SCORES], F.sum("support").alias("support"))
    )


def macro_prf(df: DataFrame, target: str = "y", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Plain mean over classes."""
    return (
        per_class_metrics(df, target, prediction, by)
        .groupBy(*by)
        .agg(*[_macro(m).alias(m) for m in _SCORES], F.sum("support").alias("support"))
    )


def classification_report(
    df: DataFrame, target: str = "y", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Per-class rows, then accuracy, macro avg and weighted avg, in one grouping-sets pass."""
    by = list(by)
    labelled = per_class_metrics(df, target, prediction, by).withColumn("label", F.col("label").cast("string"))
    sets = labelled.groupingSets([[*by, "label"], by], *by, "label").agg(
        F.grouping("label").alias("is_total"),
        *[_macro(m).alias(f"macro_{m}") for m in _SCORES],
        *[_weighted(m).alias(f"weighted_{m}") for m in _SCORES],
        F.sum("support").alias("support"),
        safe_ratio(F.sum("tp"), F.sum("support")).alias("acc"),
    )

    def line(name: Column, values: Sequence[str]) -> Column:
        return F.struct(
            name.alias("class"), *[F.col(v).alias(m) for v, m in zip(values, _SCORES)], F.col("support").alias("support")
        )

    macro = line(F.lit("macro avg"), [f"macro_{m}" for m in _SCORES])
    weighted = line(F.lit("weighted avg"), [f"weighted_{m}" for m in _SCORES])
    total = F.array(line(F.lit("accuracy"), ["acc"] * 3), macro, weighted)
    single = F.array(line(F.col("label"), [f"macro_{m}" for m in _SCORES]))
    return sets.select(*by, F.inline(F.when(F.col("is_total") == 1, total).otherwise(single)))


def report_wide(report: DataFrame, classes: Sequence[str], by: Sequence[str]) -> DataFrame:
    """A report flattened to one row per group: accuracy, then precision, recall and F1 per class row."""
    lines = [*classes, "macro avg", "weighted avg"]
    picks = [F.max(F.when(F.col("class") == "accuracy", F.col("precision"))).alias("accuracy")]
    for name in lines:
        slug = name.replace(" ", "_")
        picks += [F.max(F.when(F.col("class") == name, F.col(m))).alias(f"{m}_{slug}") for m in _SCORES]
    return report.groupBy(*by).agg(*picks)


def log_loss(
    df: DataFrame, target: str = "y", probability: str = "p", by: Sequence[str] = (), floor: float = LOG_LOSS_FLOOR
) -> DataFrame:
    """Mean of -ln(p of the true class), p clipped; null where a model gives no probabilities."""
    clipped = F.greatest(F.lit(floor), F.least(F.lit(1 - floor), F.col(probability)))
    of_truth = F.when(F.col(target) == 1, clipped).otherwise(1 - clipped)
    loss = F.when(F.col(target).isNotNull() & F.col(probability).isNotNull(), -F.ln(of_truth))
    return df.groupBy(*by).agg(F.avg(loss).alias("log_loss"))


def fold_metrics(
    df: DataFrame,
    by: Sequence[str] = (),
    fold: str = "fold",
    target: str = "y",
    prediction: str = "prediction",
) -> DataFrame:
    """All threshold metrics of every fold, in one aggregate."""
    return precision_recall_f1(df.where(F.col(fold).isNotNull()), target, prediction, [*by, fold])


def to_long(df: DataFrame, metrics: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keys..., metric, value) rows; a metric without a value gives no row."""
    return df.unpivot(list(keep), list(metrics), "metric", "value").where("value IS NOT NULL")


def cv_summary(per_fold: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation over fold values: (keys..., metric, mean, std, k)."""
    return (
        to_long(per_fold, metrics, by)
        .groupBy(*by, "metric")
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("k"))
    )


def mean_pm_std(summary: DataFrame, output: str = "text") -> DataFrame:
    return summary.withColumn(output, mean_pm_std_expr("mean", "std"))
