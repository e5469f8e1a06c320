"""All metrics of a scored table from one aggregate over its distinct scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions import safe_ratio
from riskframe.operators.ordering import bucket_name, range_buckets, running

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")
_CELLS = ("tp", "fp", "fn", "tn")


def _weighted(of_positive: Column, of_negative: Column) -> Column:
    positives, negatives = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    return safe_ratio(of_positive * positives + of_negative * negatives, positives + negatives)


def all_metrics(
    scored: DataFrame,
    by: Sequence[str] = (),
    target: str = "y",
    prediction: str = "prediction",
    probability: str = "probability",
    average: str = "binary",
    ranges: Bucketizer | None = None,
) -> DataFrame:
    """n, accuracy, precision, recall, f1 and roc_auc per group of a table with a 0/1 target.

    ``average`` is "binary" (class 1) or "weighted" (both classes by support). The area covers rows with
    a probability and is null where a class or all probabilities are absent.
    """
    if average not in ("binary", "weighted"):
        raise ValueError(f"unknown average {average!r}")
    by = list(by)
    y, p = F.col(target) == 1, F.col(prediction) == 1
    flag = {"tp": y & p, "fp": ~y & p, "fn": y & ~p, "tn": ~y & ~p}
    known = F.col(probability).isNotNull()
    rows = scored.where(F.col(target).isNotNull() & F.col(prediction).isNotNull()).select(
        *by,
        F.col(probability).cast("double").alias("score"),
        *[F.when(flag[c], 1).otherwise(0).cast("bigint").alias(c) for c in _CELLS],
        F.when(y & known, 1).otherwise(0).cast("bigint").alias("pos"),
        F.when(~y & known, 1).otherwise(0).cast("bigint").alias("neg"),
    )
    placed = (ranges or range_buckets(rows, ["score"])).transform(rows)
    groups = placed.groupBy(*by, bucket_name("score"), "score").agg(
        *[F.sum(c).alias(c) for c in (*_CELLS, "pos", "neg")]
    )
    below = running(
        groups, "score", bucket_name("score"), {"neg_below": ("sum", "neg")}, by=by, inclusive=False, source=placed
    )
    wins = F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / F.lit(2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    sums = below.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in _CELLS], F.when(pairs > 0, F.sum(wins) / pairs).alias("roc_auc")
    )
    tp, fp, fn, tn = (F.col(c) for c in _CELLS)
    precision, recall, f1 = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn), safe_ratio(2 * tp, 2 * tp + fp + fn)
    if average == "weighted":
        precision = _weighted(precision, safe_ratio(tn, tn + fn))
        recall = _weighted(recall, safe_ratio(tn, tn + fp))
        f1 = _weighted(f1, safe_ratio(2 * tn, 2 * tn + fn + fp))
    n = tp + fp + fn + tn
    return sums.select(
        *by,
        n.alias("n"),
        safe_ratio(tp + tn, n).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        "roc_auc",
    )
