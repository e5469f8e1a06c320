"""Tables that compare models. Inputs hold one row per model (and metric), outputs likewise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions import join_in_order, metric_title, name_slug, run_stamp


def model_comparison(
    long: DataFrame, metrics: Sequence[str], model: str = "model", order: str = "accuracy"
) -> DataFrame:
    """One row per model, one column per metric, best first; a metric a model lacks is null."""
    return (
        long.groupBy(model)
        .pivot("metric", list(metrics))
        .agg(F.first("value"))
        .orderBy(F.col(order).desc_nulls_last(), F.col(model))
    )


def best_model(
    df: DataFrame, metric: str = "accuracy", model: str = "model", by: Sequence[str] = ()
) -> DataFrame:
    """Model with the highest value; the first name wins a tie."""
    scored = df.where(F.col(metric).isNotNull())
    return scored.groupBy(*by).agg(
        F.min_by(model, F.struct(-F.col(metric), F.col(model))).alias(model), F.max(metric).alias(metric)
    )


def rank_by_metric(
    df: DataFrame, metric: str, model: str = "model", descending: bool = True, output: str = "rank"
) -> DataFrame:
    """Competition rank of each model; models without the metric are left unranked."""
    order = F.col(metric).desc() if descending else F.col(metric).asc()
    ranked = F.rank().over(Window.orderBy(order))
    return df.where(F.col(metric).isNotNull()).withColumn(output, ranked)


def top_n_models(df: DataFrame, metric: str, n: int = 5, model: str = "model") -> DataFrame:
    return df.orderBy(F.col(metric).desc_nulls_last(), F.col(model)).limit(n)


def test_vs_cv(test: DataFrame, cv: DataFrame, model: str = "model") -> DataFrame:
    """Hold-out and cross-validation rows of each model one after the other."""
    both = test.withColumn("split", F.lit("Test")).unionByName(
        cv.withColumn("split", F.lit("CV")), allowMissingColumns=True
    )
    return both.orderBy(F.col(model), F.col("split").desc())


def with_slug(df: DataFrame, name: str, output: str = "slug") -> DataFrame:
    return df.withColumn(output, name_slug(name))


def with_title(df: DataFrame, name: str, output: str = "title") -> DataFrame:
    return df.withColumn(output, metric_title(name))


def feature_list_text(
    df: DataFrame, position: str, name: str, by: Sequence[str] = (), output: str = "features"
) -> DataFrame:
    """Feature names of each group joined in order; a group is one model's feature list."""
    return df.groupBy(*by).agg(join_in_order(position, name).alias(output), F.count("*").alias("feature_count"))


def with_run_stamp(df: DataFrame, column: str, output: str = "run_stamp") -> DataFrame:
    return df.withColumn(output, run_stamp(column))
