"""Votes over scored tables, and the out-of-fold table behind stacking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.jobs import run_threads, written
from riskframe.operators.learners import Learner, coded_for, score


def _total(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns])


def align_scores(tables: Mapping[str, DataFrame], key: str, value: str) -> DataFrame:
    """Scored tables of several models as one, a column per model, joined on the row key."""
    named = [df.select(key, F.col(value).alias(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.join(b, key), named)


def score_columns(df: DataFrame, models: Mapping[str, PipelineModel], value: str = "probability") -> DataFrame:
    """Add one score column per model by chaining transforms: every model in one pass, no join."""
    other = "prediction" if value == "probability" else "probability"
    for name, model in models.items():
        df = score(model, df).withColumnRenamed(value, name).drop(other)
    return df


def vote_soft(df: DataFrame, probabilities: Sequence[str]) -> DataFrame:
    """Mean probability; class 1 above one half, so a tie is class 0."""
    mean = _total(probabilities) / F.lit(float(len(probabilities)))
    return df.withColumn("probability", mean).withColumn("prediction", (F.col("probability") > 0.5).cast("int"))


def vote_hard(df: DataFrame, predictions: Sequence[str]) -> DataFrame:
    """Majority of labels; a tie is class 0. A majority has no probability."""
    majority = (_total(predictions) * 2 > len(predictions)).cast("int")
    return df.withColumn("prediction", majority).withColumn("probability", F.lit(None).cast("double"))


def fit_folds(
    df: DataFrame, learners: Sequence[Learner], features: Sequence[str], target: str, k: int, fold: str = "fold", parallelism: int = 2
) -> dict[tuple[int, str], PipelineModel]:
    """Models by (fold, learner), each fitted on the rows of the other folds; boosted ones share coded rows."""
    coded = coded_for(learners, df, features, target, fold, k)
    pairs = [(i, learner) for i in range(k) for learner in learners]
    jobs = [lambda i=i, learner=learner: learner.fit(df.where(F.col(fold) != i), features, target, None, coded, i) for i, learner in pairs]
    return dict(zip([(i, learner.name) for i, learner in pairs], run_threads(df.sparkSession, jobs, parallelism)))


def stack_meta_features(
    df: DataFrame,
    learners: Sequence[Learner],
    features: Sequence[str],
    target: str,
    key: str,
    k: int = 5,
    fold: str = "fold",
    parallelism: int = 2,
) -> DataFrame:
    """Out-of-fold probability of each learner: (key, target, fold, one column per learner).

    ``df`` carries the fold column. Each fold's models score only rows they were not fitted on. The folded rows are written
    once, as every pass of every fit reads them.
    """
    df = written(df.select(*dict.fromkeys([key, target, fold, *features])), "folded")
    fitted = fit_folds(df, learners, features, target, k, fold, parallelism)
    parts = []
    for i in range(k):
        models = {learner.name: fitted[(i, learner.name)] for learner in learners}
        held = df.where(F.col(fold) == i).select(key, target, fold, *features)
        parts.append(score_columns(held, models).select(key, target, fold, *models))
    return reduce(lambda a, b: a.unionByName(b), parts)
