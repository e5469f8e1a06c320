"""Scorers whose fitted form is a handful of numbers: they score with column expressions.

Each is a Spark ML transformer, so it can sit in a ``PipelineModel``, be saved and loaded with it, and
run on a stream. All of them add ``prediction`` (int) and ``probability`` (double, null if not defined).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions import dot


class _Scorer(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    features = Param(Params._dummy(), "features", "feature column names", TypeConverters.toListString)

    def __init__(self, **values) -> None:
        super().__init__()
        if values:
            self._set(**values)

    def raw(self) -> Column:
        raise NotImplementedError

    def _value(self, param: Param):
        return self.getOrDefault(param)


class LinearScorer(_Scorer):
    """bias + weights * features; class 1 above 0. ``link`` is "logistic" or "none" (no probability)."""

    weights = Param(Params._dummy(), "weights", "one weight per feature", TypeConverters.toListFloat)
    bias = Param(Params._dummy(), "bias", "constant term", TypeConverters.toFloat)
    link = Param(Params._dummy(), "link", "logistic or none", TypeConverters.toString)

    def __init__(
        self,
        features: Sequence[str] | None = None,
        weights: Sequence[float] | None = None,
        bias: float = 0.0,
        link: str = "logistic",
    ) -> None:
        values = {} if features is None else {"features": list(features), "weights": [float(w) for w in weights]}
        super().__init__(**values, bias=float(bias), link=link)

    def raw(self) -> Column:
        return dot(self._value(self.features), self._value(self.weights), self._value(self.bias))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        score = F.col("__raw")
        probability = 1.0 / (1.0 + F.exp(-score)) if self._value(self.link) == "logistic" else F.lit(None).cast("double")
        return dataset.withColumn("__raw", self.raw()).select(
            *dataset.columns, (score > 0).cast("int").alias("prediction"), probability.alias("probability")
        )


class GaussianScorer(_Scorer):
    """Naive Bayes with one normal density per class and feature."""

    labels = Param(Params._dummy(), "labels", "class labels", TypeConverters.toListInt)
    log_priors = Param(Params._dummy(), "log_priors", "log share per class", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "class-major means", TypeConverters.toListFloat)
    variances = Param(Params._dummy(), "variances", "class-major variances", TypeConverters.toListFloat)

    def __init__(self, features=None, labels=None, log_priors=None, means=None, variances=None) -> None:
        names = {"features": features, "labels": labels, "log_priors": log_priors, "means": means}
        values = {k: list(v) for k, v in {**names, "variances": variances}.items() if v is not None}
        super().__init__(**values)

    def log_likelihoods(self) -> dict[int, Column]:
        """Per class: log share - 1/2 sum(ln var + (x - mean)^2 / var)."""
        names, labels = self._value(self.features), self._value(self.labels)
        means, variances = self._value(self.means), self._value(self.variances)
        priors, d = self._value(self.log_priors), len(names)
        result = {}
        for c, label in enumerate(labels):
            terms = []
            for j, name in enumerate(names):
                gap = F.col(name).cast("double") - F.lit(means[c * d + j])
                spread = variances[c * d + j]
                # a missing feature says nothing about the class, as the fit leaves it out of means and variances
                terms.append(F.coalesce(F.log(F.lit(spread)) + gap * gap / F.lit(spread), F.lit(0.0)))
            result[label] = F.lit(priors[c]) - F.lit(0.5) * reduce(lambda x, y: x + y, terms)
        return result

    def _transform(self, dataset: DataFrame) -> DataFrame:
        joint = self.log_likelihoods()
        named = dataset.select("*", *[value.alias(f"__ll_{label}") for label, value in joint.items()])
        best = F.array_max(
            F.array(*[F.struct(F.col(f"__ll_{c}").alias("ll"), F.lit(-c).alias("neg")) for c in joint])
        )
        if set(joint) == {0, 1}:
            probability = 1.0 / (1.0 + F.exp(F.col("__ll_0") - F.col("__ll_1")))
        else:
            probability = F.lit(None).cast("double")
        return named.select(
            *dataset.columns, (-best["neg"]).cast("int").alias("prediction"), probability.alias("probability")
        )


class StumpScorer(_Scorer):
    """Weighted vote of one-split trees: each says +side above its threshold, -side otherwise."""

    split_on = Param(Params._dummy(), "split_on", "feature of each stump", TypeConverters.toListString)
    thresholds = Param(Params._dummy(), "thresholds", "threshold of each stump", TypeConverters.toListFloat)
    sides = Param(Params._dummy(), "sides", "sign above the threshold", TypeConverters.toListInt)
    alphas = Param(Params._dummy(), "alphas", "weight of each stump", TypeConverters.toListFloat)

    def __init__(self, features=None, split_on=None, thresholds=None, sides=None, alphas=None) -> None:
        names = {"features": features, "split_on": split_on, "thresholds": thresholds, "sides": sides}
        values = {k: list(v) for k, v in {**names, "alphas": alphas}.items() if v is not None}
        super().__init__(**values)

    def raw(self) -> Column:
        total = sum(self._value(self.alphas)) or 1.0
        votes = [
            # a missing feature counts as above every threshold, as in the fit
            F.when(F.coalesce(F.col(name).cast("double") >= t, F.lit(True)), F.lit(a * s)).otherwise(F.lit(-a * s))
            for name, t, s, a in zip(
                self._value(self.split_on),
                self._value(self.thresholds),
                self._value(self.sides),
                self._value(self.alphas),
            )
        ]
        return reduce(lambda x, y: x + y, votes, F.lit(0.0)) / F.lit(total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        score = F.col("__raw")
        return dataset.withColumn("__raw", self.raw()).select(
            *dataset.columns,
            (score > 0).cast("int").alias("prediction"),
            (1.0 / (1.0 + F.exp(-score))).alias("probability"),
        )
