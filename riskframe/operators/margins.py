"""Margin learners with probabilities, and a kernel support vector machine.

A margin (distance from a separating plane) becomes a probability by a curve fitted on out-of-fold margins: a sigmoid, or the
monotone step curve that pools neighbours.  Both are scorers like any other, so such models enter soft votes and stacks.

The kernel machine maps rows by random Fourier features, whose inner products tend to the Gaussian kernel as their number
grows, and fits the hinge loss there: its cost is that of a linear machine over ``components`` columns, whatever the rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.jobs import written
from riskframe.operators.sampling import stratified_kfold
from riskframe.operators.scorers import LinearScorer, _Scorer

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

#: Newton steps of the sigmoid; each is one aggregate of five sums.
STEPS = 25


def as_linear(model: PipelineModel, features: Sequence[str]) -> LinearScorer:
    """A fitted linear model over raw columns as one linear score."""
    last = model.stages[-1]
    if isinstance(last, LinearScorer):
        return last
    if not isinstance(last, LinearSVCModel):
        raise ValueError(f"{type(last).__name__} has no linear margin")
    scaler = model.stages[-2]
    mean, std = np.array(scaler.mean.toArray()), np.array(scaler.std.toArray())
    weights = np.divide(last.coefficients.toArray(), std, out=np.zeros(len(std)), where=std > 0)
    return LinearScorer(features, weights.tolist(), float(last.intercept - weights @ mean), "none")


class MonotoneScorer(LinearScorer):
    """Probability of a linear margin by a rising curve through (boundaries, values), flat beyond its ends."""

    boundaries = Param(Params._dummy(), "boundaries", "margins of the curve, rising", TypeConverters.toListFloat)
    values = Param(Params._dummy(), "values", "probability at each boundary", TypeConverters.toListFloat)

    def __init__(self, features=None, weights=None, bias: float = 0.0, boundaries: Sequence[float] = (), values: Sequence[float] = ()) -> None:
        super().__init__(features, weights, bias, "none")
        self._set(boundaries=[float(b) for b in boundaries], values=[float(v) for v in values])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        at, heights = np.array(self._value(self.boundaries)), np.array(self._value(self.values))

        @F.pandas_udf("double")
        def curve(margin: pd.Series) -> pd.Series:
            return pd.Series(np.interp(margin.to_numpy(float), at, heights))

        p = F.col("__p")
        return dataset.withColumn("__p", curve(self.raw())).select(*dataset.columns, (p > 0.5).cast("int").alias("prediction"), p.alias("probability"))


def fit_sigmoid(margins: DataFrame, margin: str, target: str) -> tuple[float, float]:
    """(slope, shift) of the logistic curve with the largest likelihood of the classes, which count as (n + 1) / (n + 2) and
    1 / (n + 2) so that no class is certain.  Newton steps, halved while they do not bring the loss down."""
    y = F.col(target) == 1
    positive, negative = margins.agg(F.count_if(y), F.count_if(~y)).first()
    truth = F.when(y, F.lit((positive + 1.0) / (positive + 2.0))).otherwise(F.lit(1.0 / (negative + 2.0)))
    m = F.col(margin)

    def sums(slope: float, shift: float) -> tuple[float, ...]:
        z = m * slope + shift
        p = 1.0 / (1.0 + F.exp(-z))
        loss = F.greatest(z, F.lit(0.0)) - z * truth + F.log1p(F.exp(-F.abs(z)))
        w = p * (1 - p)
        found = margins.agg(F.sum(loss), F.sum((p - truth) * m), F.sum(p - truth), F.sum(w * m * m), F.sum(w * m), F.sum(w)).first()
        return tuple(v or 0.0 for v in found)

    at = (0.0, math.log((positive + 1.0) / (negative + 1.0)))
    now, size = sums(*at), 1.0
    for _ in range(STEPS):
        loss, g1, g2, h11, h12, h22 = now
        step = np.linalg.lstsq(np.array([[h11 + 1e-12, h12], [h12, h22 + 1e-12]]), np.array([g1, g2]), rcond=None)[0]
        if np.abs(step).max() < 1e-10:
            break
        size = min(1.0, 2 * size)
        while size > 1e-6:
            there = (at[0] - size * float(step[0]), at[1] - size * float(step[1]))
            then = sums(*there)
            if then[0] <= loss + 1e-12 * abs(loss):
                break
            size /= 2
        else:
            break
        at, now = there, then
    return at


def fit_monotone(margins: DataFrame, margin: str, target: str) -> tuple[list[float], list[float]]:
    """(boundaries, values) of the rising curve nearest to the classes: neighbours out of order are pooled."""
    rows = margins.select(F.col(margin).cast("double").alias("m"), (F.col(target) == 1).cast("double").alias("y"))
    # equal margins are one point with their mean and number
    points = rows.groupBy("m").agg(F.avg("y").alias("y"), F.count("*").cast("double").alias("n"))
    vectors = points.select(array_to_vector(F.array("m")).alias("x"), "y", "n")
    model = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="n").fit(vectors)
    return [float(b) for b in model.boundaries.toArray()], [float(p) for p in model.predictions.toArray()]


def out_of_fold_margins(rows: DataFrame, fit, features: Sequence[str], target: str, k: int) -> DataFrame:
    """(margin, target) of every row, by a model that has not seen its fold.  Rows that agree in all features share a fold."""
    key = F.xxhash64(*[F.col(f) for f in features])
    folded = written(stratified_kfold(rows.withColumn("__key", key), "__key", target, k, "calibrate", "__fold"), "folded")
    parts = []
    for i in range(k):
        linear = as_linear(fit(folded.where(F.col("__fold") != i)), features)
        parts.append(folded.where(F.col("__fold") == i).select(linear.raw().alias("margin"), F.col(target).alias("__y")))
    return written(reduce(lambda a, b: a.unionByName(b), parts), "margins")


def calibrated(rows: DataFrame, fit, features: Sequence[str], target: str, method: str = "sigmoid", k: int = 5) -> PipelineModel:
    """The margin learner ``fit`` (rows -> model) on all rows, with probabilities from its out-of-fold margins."""
    if method not in ("sigmoid", "monotone"):
        raise ValueError(f"unknown method {method!r}")
    features = list(features)
    margins = out_of_fold_margins(rows, fit, features, target, k)
    linear = as_linear(fit(rows), features)
    weights, bias = linear.getOrDefault(linear.weights), linear.getOrDefault(linear.bias)
    if method == "sigmoid":
        slope, shift = fit_sigmoid(margins, "margin", "__y")
        scorer = LinearScorer(features, [w * slope for w in weights], bias * slope + shift, "logistic")
    else:
        scorer = MonotoneScorer(features, weights, bias, *fit_monotone(margins, "margin", "__y"))
    return PipelineModel(stages=[scorer])


class RandomFeatureMap(_Scorer):
    """``__mapped``: sqrt(2 / m) cos(W x + b) of the standardised features, W normal with deviation sqrt(2 gamma), b uniform;
    inner products of two rows tend to exp(-gamma |x - y|^2).  W and b follow from the seed."""

    means = Param(Params._dummy(), "means", "mean of each feature", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "deviation of each feature", TypeConverters.toListFloat)
    gamma = Param(Params._dummy(), "gamma", "width of the kernel", TypeConverters.toFloat)
    components = Param(Params._dummy(), "components", "number of random features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the draw", TypeConverters.toInt)

    def __init__(self, features=None, means=(), deviations=(), gamma: float = 1.0, components: int = 200, seed: int = 42) -> None:
        values = {} if features is None else {"features": list(features)}
        super().__init__(**values, means=[float(x) for x in means], deviations=[float(x) for x in deviations], gamma=float(gamma), components=components, seed=seed)

    def drawn(self) -> tuple[np.ndarray, np.ndarray]:
        rng, m = np.random.default_rng(self._value(self.seed)), self._value(self.components)
        w = rng.normal(size=(len(self._value(self.features)), m)) * math.sqrt(2 * self._value(self.gamma))
        return w, rng.uniform(0, 2 * math.pi, m)

    def mapped(self, x: np.ndarray) -> np.ndarray:
        """Random features of rows of raw values."""
        return map_rows(x, *self.drawn(), self._value(self.means), self._value(self.deviations))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names, means, deviations = (self._value(p) for p in (self.features, self.means, self.deviations))
        w, b = self.drawn()

        @F.pandas_udf("array<double>")
        def features(*columns: pd.Series) -> pd.Series:
            return pd.Series(list(map_rows(np.column_stack([c.to_numpy(float) for c in columns]), w, b, means, deviations)))

        return dataset.withColumn("__mapped", array_to_vector(features(*[F.col(f).cast("double") for f in names])))


def map_rows(x: np.ndarray, w: np.ndarray, b: np.ndarray, means: Sequence[float], deviations: Sequence[float]) -> np.ndarray:
    """Random features; a missing value counts as the mean."""
    deviation = np.array(deviations)
    z = np.nan_to_num((x - np.array(means)) / np.where(deviation > 0, deviation, 1.0))
    return math.sqrt(2.0 / len(b)) * np.cos(z @ w + b)


def fit_random_feature_svm(
    rows: DataFrame, features: Sequence[str], target: str, weight: str | None, gamma: float | None, components: int, penalty: float, max_iter: int, seed: int
) -> PipelineModel:
    features = list(features)
    found = rows.agg(*[g(f) for f in features for g in (F.avg, F.stddev_pop)]).first()
    means, deviations = [float(v or 0.0) for v in found[::2]], [float(v or 0.0) for v in found[1::2]]
    mapper = RandomFeatureMap(features, means, deviations, gamma if gamma is not None else 1.0 / len(features), components, seed)
    learner = LinearSVC(featuresCol="__mapped", labelCol=target, regParam=penalty, maxIter=max_iter, standardization=False)
    if weight:
        learner.setParams(weightCol=weight)
    ready = written(mapper.transform(rows).select("__mapped", target, *([weight] if weight else [])), "mapped")
    return PipelineModel(stages=[mapper, learner.fit(ready)])
