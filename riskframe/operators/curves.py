"""ROC curve and the areas under it, with ties counted exactly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators.ordering import bucket_name, range_buckets, running, shuffle_buckets


def _scores(
    df: DataFrame, target: str, probability: str, by: Sequence[str], ranges: Bucketizer | None
) -> tuple[DataFrame, DataFrame]:
    """Scored rows with their value range, and the same summed per distinct score (ties become one row)."""
    y = F.col(target)
    rows = df.where(y.isNotNull() & F.col(probability).isNotNull()).select(
        *by,
        F.col(probability).cast("double").alias("score"),
        F.when(y == 1, 1).otherwise(0).cast("bigint").alias("pos"),
        F.when(y == 1, 0).otherwise(1).cast("bigint").alias("neg"),
    )
    placed = (ranges or range_buckets(rows, ["score"])).transform(rows)
    groups = placed.groupBy(*by, bucket_name("score"), "score").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    return placed, groups


def roc_curve(
    df: DataFrame,
    target: str = "y",
    probability: str = "p",
    by: Sequence[str] = (),
    ranges: Bucketizer | None = None,
) -> DataFrame:
    """(threshold, fpr, tpr) from the highest score down. A first point (0, 0) without threshold is added;
    a rate is null when the group lacks that class."""
    by = list(by)
    rows, groups = _scores(df, target, probability, by, ranges)
    cumulative = running(
        groups,
        "score",
        bucket_name("score"),
        {"cum_pos": ("sum", "pos"), "cum_neg": ("sum", "neg")},
        by=by,
        descending=True,
        whole={"all_pos": ("sum", "pos"), "all_neg": ("sum", "neg")},
        source=rows,
    )
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("double")

    def point(threshold: Column, cum_neg: Column, cum_pos: Column) -> Column:
        return F.struct(
            threshold.alias("threshold"),
            F.when(F.col("all_neg") > 0, cum_neg / F.col("all_neg")).alias("fpr"),
            F.when(F.col("all_pos") > 0, cum_pos / F.col("all_pos")).alias("tpr"),
        )

    here = point(F.col("score").cast("double"), F.col("cum_neg"), F.col("cum_pos"))
    # the highest score has nothing above it; its row also brings the origin
    is_first = F.col("cum_pos") + F.col("cum_neg") == F.col("pos") + F.col("neg")
    points = F.when(is_first, F.array(point(none, zero, zero), here)).otherwise(F.array(here))
    return cumulative.select(*by, F.inline(points))


def roc_auc(
    df: DataFrame,
    target: str = "y",
    probability: str = "p",
    by: Sequence[str] = (),
    ranges: Bucketizer | None = None,
) -> DataFrame:
    """Chance that a positive outranks a negative, ties half; null when a class or all scores are absent."""
    by = list(by)
    rows, groups = _scores(df, target, probability, by, ranges)
    below = running(
        groups, "score", bucket_name("score"), {"neg_below": ("sum", "neg")}, by=by, inclusive=False, source=rows
    )
    wins = F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / F.lit(2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return below.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.when(pairs > 0, F.sum(wins) / pairs).alias("roc_auc"),
    )


def auc_trapezoid(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under (fpr, tpr) points. Both rates only rise, so the point before is the running maximum.

    fpr + tpr runs from 0 to 2 and every point adds at least one row's share to it, so equal steps hold
    equal numbers of points at most: the ranges need no look at the data.
    """
    by = list(by)
    parts = max(2, shuffle_buckets(curve))
    inner = [2.0 * i / parts for i in range(1, parts)]
    ranges = Bucketizer(
        splits=[float("-inf"), *inner, float("inf")],
        inputCol="along",
        outputCol=bucket_name("along"),
        handleInvalid="keep",
    )
    placed = ranges.transform(curve.select(*by, "fpr", "tpr", (F.col("fpr") + F.col("tpr")).alias("along")))
    steps = running(
        placed,
        "along",
        bucket_name("along"),
        {"fpr_before": ("max", "fpr"), "tpr_before": ("max", "tpr")},
        by=by,
        inclusive=False,
    )
    area = (F.col("fpr") - F.col("fpr_before")) * (F.col("tpr") + F.col("tpr_before")) / F.lit(2.0)
    return steps.groupBy(*by).agg(F.sum(area).alias("auc"), F.count("*").alias("n_points"))
