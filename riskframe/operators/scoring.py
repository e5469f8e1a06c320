"""Scoring tables with a fitted model, and the tables built from the result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions import decode_label, percent_text
from riskframe.operators.columns import encode_target, select_features
from riskframe.operators.learners import score
from riskframe.operators.sampling import class_distribution
from riskframe.operators.summary import all_metrics


def batch_score(
    df: DataFrame,
    model: PipelineModel,
    features: Sequence[str],
    keep: Sequence[str] = (),
    positive: str = "positive",
    negative: str = "negative",
) -> DataFrame:
    """Kept columns with prediction, its label and the probability. Missing features stop the job."""
    ready = select_features(df, features, keep)
    scored = score(model, ready, keep)
    return scored.select(
        *keep, "prediction", decode_label("prediction", positive, negative).alias("prediction_label"), "probability"
    )


def score_with_truth(
    df: DataFrame,
    model: PipelineModel,
    features: Sequence[str],
    target: str,
    keep: Sequence[str] = (),
    positive: str = "positive",
    negative: str = "negative",
    mapping: Mapping[str, int] | None = None,
) -> DataFrame:
    """As ``batch_score``, with the truth of the same row beside it when the table carries one."""
    if target not in df.columns:
        return batch_score(df, model, features, keep, positive, negative)
    named = encode_target(df, target, mapping) if mapping else df
    truth = named.withColumn("actual", F.col(target).cast("int"))
    scored = batch_score(truth, model, features, [*keep, "actual"], positive, negative)
    label = F.when(F.col("actual").isNotNull(), decode_label("actual", positive, negative))
    return scored.select(*keep, "prediction", "prediction_label", "probability", "actual", label.alias("actual_label"))


def truth_metrics(scored: DataFrame, average: str = "weighted") -> DataFrame:
    """One row of metrics of a table scored with truth: n, accuracy, precision, recall, f1, roc_auc."""
    return all_metrics(scored, (), "actual", "prediction", "probability", average)


def prediction_distribution(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    return class_distribution(scored, prediction)


def with_percent(scored: DataFrame, probability: str = "probability", output: str = "probability_text") -> DataFrame:
    """Probability as a percentage text; null where there is none."""
    return scored.withColumn(output, F.when(F.col(probability).isNotNull(), percent_text(F.col(probability))))
