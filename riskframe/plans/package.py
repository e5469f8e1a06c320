"""Scoring from the model registry alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.scoring import batch_score
from riskframe.sources.models import load_model
from riskframe.sources.registry import latest_models


def score_registered(
    df: DataFrame,
    registry: DataFrame,
    model_type: str,
    keep: Sequence[str] = (),
    positive: str = "positive",
    negative: str = "negative",
) -> DataFrame:
    """Scores of the newest registered model of a type, with the features its registry row names, in that order.

    Missing features stop the job; other columns of the table are left out."""
    row = latest_models(registry.where(F.col("model_type") == model_type)).first()
    if row is None:
        raise ValueError(f"no registered model of type {model_type!r}")
    return batch_score(df, load_model(row["model_file"]), list(row["features"]), keep, positive, negative)
