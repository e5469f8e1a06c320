"""Learners. Every ``fit_*`` returns a ``PipelineModel`` that scores raw feature columns.

Tree, logistic, SVM and perceptron learners are Spark ML's distributed ones. Closed-form learners are one
or two aggregates; boosted stumps are one small histogram aggregate per round.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.jobs import written
from riskframe.operators.boosting import PROFILES, Coded, coded_rows, fit_coded, fit_histogram_boosting
from riskframe.operators.margins import calibrated, fit_random_feature_svm
from riskframe.operators.ordering import MAX_CLASSES, bucket_name, range_buckets
from riskframe.operators.sampling import balanced_weights, positive_weight
from riskframe.operators.scorers import GaussianScorer, LinearScorer, StumpScorer

MAX_DEPTH = 30
VARIANCE_FLOOR = 1e-9
WEIGHT = "__weight"
#: Rounds of boosted stumps between two writings of the row weights.
REWEIGH = 10


def _rows(df: DataFrame, features: Sequence[str], target: str, weight: str | None, extra: Sequence[str] = ()) -> DataFrame:
    """Only the columns a learner needs, without rows that have no label."""
    needed = dict.fromkeys([*features, target, *([weight] if weight else []), *extra])
    return df.where(F.col(target).isNotNull()).select(*needed)


def _stages(features: Sequence[str], standardise: bool) -> list:
    if not standardise:
        return [VectorAssembler(inputCols=list(features), outputCol="__features")]
    return [
        VectorAssembler(inputCols=list(features), outputCol="__raw_features"),
        StandardScaler(inputCol="__raw_features", outputCol="__features", withMean=True, withStd=True),
    ]


def _fit(df, features, target, weight, learner, standardise: bool = False) -> PipelineModel:
    learner.setParams(featuresCol="__features", labelCol=target)
    if weight:
        learner.setParams(weightCol=weight)
    return Pipeline(stages=[*_stages(features, standardise), learner]).fit(_rows(df, features, target, weight))


def fit_random_forest(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    weight: str | None = None,
    trees: int = 200,
    depth: int = 20,
    min_leaf: int = 4,
    min_split: int = 2,
    subset: str = "log2",
    bootstrap: bool = False,
    seed: int = 42,
) -> PipelineModel:
    """Forest. A minimum split size has no counterpart and is met through the leaf size."""
    if depth > MAX_DEPTH:
        raise ValueError(f"depth is limited to {MAX_DEPTH}")
    learner = RandomForestClassifier(
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=max(min_leaf, math.ceil(min_split / 2)),
        featureSubsetStrategy=subset,
        bootstrap=bootstrap,
        maxMemoryInMB=512,
        seed=seed,
    )
    return _fit(df, features, target, weight, learner)


def fit_boosted_trees(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    weight: str | None = None,
    profile: str = "leafy",
    bins: int = 64,
    seed: int = 42,
    **changes,
) -> PipelineModel:
    """Gradient-boosted trees on histograms, with the settings of a profile and any changes to them."""
    rows = _rows(df, features, target, weight)
    return fit_histogram_boosting(rows, features, target, weight, boosted_settings(profile, changes), bins, seed)


def boosted_settings(profile: str, changes: Mapping[str, object]) -> dict:
    unknown = sorted(set(changes) - set(PROFILES[profile]))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return {**PROFILES[profile], **changes}


def fit_boosted_coded(
    coded: Coded, left_out: int | None, label_weights: tuple[float, float], profile: str = "leafy", bins: int = 64, seed: int = 42, **changes
) -> PipelineModel:
    """The same on rows that many fits share."""
    return fit_coded(coded, left_out, label_weights, boosted_settings(profile, changes), seed)


def fit_logistic(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    weight: str | None = None,
    c: float = 1.0,
    max_iter: int = 100,
    standardise: bool = False,
) -> PipelineModel:
    """Logistic regression with inverse penalty c on the summed loss."""
    rows = _rows(df, features, target, weight)
    mass = rows.agg(F.sum(F.col(weight) if weight else F.lit(1.0))).first()[0] or 1.0
    learner = LogisticRegression(
        regParam=1.0 / (c * mass), elasticNetParam=0.0, standardization=False, maxIter=max_iter
    )
    return _fit(df, features, target, weight, learner, standardise)


def fit_decision_tree(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    weight: str | None = None,
    depth: int = 10,
    min_leaf: int = 1,
    seed: int = 42,
) -> PipelineModel:
    learner = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed)
    return _fit(df, features, target, weight, learner)


def fit_linear_svm(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    weight: str | None = None,
    penalty: float = 0.01,
    max_iter: int = 10,
) -> PipelineModel:
    """Linear support vector machine on standardised features; gives no probability."""
    return _fit(df, features, target, weight, LinearSVC(regParam=penalty, maxIter=max_iter), standardise=True)


def fit_kernel_svm(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    weight: str | None = None,
    gamma: float | None = None,
    components: int = 200,
    penalty: float = 1e-3,
    max_iter: int = 100,
    seed: int = 42,
) -> PipelineModel:
    """Support vector machine with a Gaussian kernel through random features of standardised values; ``gamma`` is one over
    the number of features if not given. Gives no probability."""
    return fit_random_feature_svm(_rows(df, features, target, weight), features, target, weight, gamma, components, penalty, max_iter, seed)


def fit_calibrated(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    weight: str | None = None,
    base: str = "linear_svm",
    method: str = "sigmoid",
    k: int = 5,
    **settings,
) -> PipelineModel:
    """A margin learner (linear_svm or ridge) with probabilities from its out-of-fold margins, by a sigmoid or monotone curve."""
    if base not in ("linear_svm", "ridge"):
        raise ValueError(f"{base!r} is no margin learner")
    fit = lambda rows: LEARNERS[base](rows, features, target, weight=weight, **settings)
    return calibrated(_rows(df, features, target, weight), fit, features, target, method, k)


def fit_mlp(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    hidden: Sequence[int] = (16,),
    max_iter: int = 50,
    seed: int = 42,
) -> PipelineModel:
    """Multi-layer perceptron on standardised features."""
    learner = MultilayerPerceptronClassifier(layers=[len(features), *hidden, 2], maxIter=max_iter, seed=seed)
    return _fit(df, features, target, None, learner, standardise=True)


def fit_naive_bayes(df: DataFrame, features: Sequence[str], target: str) -> PipelineModel:
    """Gaussian naive Bayes: class means and population variances, one aggregate."""
    aggs = [F.count("*").alias("n")]
    for name in features:
        aggs += [F.avg(name).alias(f"m_{name}"), F.var_pop(name).alias(f"v_{name}")]
    found = _rows(df, features, target, None).groupBy(target).agg(*aggs).limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{target!r} has more than {MAX_CLASSES} classes; it is not a class column")
    stats = sorted(found, key=lambda r: r[target])
    total = sum(r["n"] for r in stats)
    scorer = GaussianScorer(
        features=list(features),
        labels=[int(r[target]) for r in stats],
        log_priors=[math.log(r["n"] / total) for r in stats],
        means=[float(r[f"m_{f}"]) for r in stats for f in features],
        variances=[max(float(r[f"v_{f}"]), VARIANCE_FLOOR) for r in stats for f in features],
    )
    return PipelineModel(stages=[scorer])


def fit_lda(df: DataFrame, features: Sequence[str], target: str) -> PipelineModel:
    """Linear discriminant of two classes: class means and pooled covariance from one aggregate over the
    second-degree terms of the standardised features, then a small solve."""
    d = len(features)
    rows = _rows(df, features, target, None)
    prepared = Pipeline(stages=_stages(features, True)).fit(rows)
    scaler = prepared.stages[-1]
    expanded = PolynomialExpansion(degree=2, inputCol="__features", outputCol="__terms").transform(
        prepared.transform(rows)
    )
    stats = (
        expanded.groupBy(target)
        .agg(Summarizer.metrics("mean", "count").summary(F.col("__terms")).alias("s"))
        .select(target, "s.mean", "s.count")
        .collect()
    )
    if len(stats) != 2:
        raise ValueError("linear discriminant needs exactly two classes")
    counts, means, pooled = {}, {}, np.zeros((d, d))
    for row in stats:
        terms, n, at = row["mean"].toArray(), row["count"], 0
        mean, second = np.zeros(d), np.zeros((d, d))
        for i in range(d):  # terms come as x_i, then x_0*x_i .. x_i*x_i
            mean[i] = terms[at]
            second[i, : i + 1] = second[: i + 1, i] = terms[at + 1 : at + 2 + i]
            at += 2 + i
        counts[row[target]], means[row[target]] = n, mean
        pooled += n * (second - np.outer(mean, mean))
    low, high = sorted(counts)
    pooled /= sum(counts.values()) - 2
    weights = np.linalg.pinv(pooled) @ (means[high] - means[low])
    bias = math.log(counts[high] / counts[low]) - 0.5 * float((means[high] + means[low]) @ weights)
    std = np.array(scaler.std.toArray())
    raw = np.divide(weights, std, out=np.zeros(d), where=std > 0)
    bias -= float(raw @ scaler.mean.toArray())
    return PipelineModel(stages=[LinearScorer(features, [float(w) for w in raw], bias, "logistic")])


def fit_ridge(
    df: DataFrame, features: Sequence[str], target: str, weight: str | None = None, alpha: float = 1.0
) -> PipelineModel:
    """Least squares on a -1/+1 target with an L2 penalty alpha on the summed loss; class by sign."""
    rows = _rows(df, features, target, weight).withColumn("__signed", F.when(F.col(target) == 1, 1.0).otherwise(-1.0))
    amount = F.col(weight) if weight else F.lit(1.0)
    mass, signed = rows.agg(F.sum(amount), F.sum(amount * F.col("__signed"))).first()
    mass = mass or 1.0
    mean = (signed or 0.0) / mass
    direct = len(features) <= 1000
    # Spark ML divides the penalty by the label's deviation; multiplying by it keeps alpha in label units
    spread = math.sqrt(max(1.0 - mean * mean, 0.0)) * (1.0 if direct else math.sqrt(mass / max(mass - 1.0, 1.0)))
    learner = LinearRegression(
        featuresCol="__features",
        labelCol="__signed",
        elasticNetParam=0.0,
        regParam=alpha / mass * (spread or 1.0),
        standardization=False,
        solver="normal" if direct else "l-bfgs",
    )
    if weight:
        learner.setParams(weightCol=weight)
    fitted = learner.fit(_stages(features, False)[0].transform(rows))
    scorer = LinearScorer(features, [float(w) for w in fitted.coefficients], float(fitted.intercept), "none")
    return PipelineModel(stages=[scorer])


def fit_adaboost(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    rounds: int = 50,
    rate: float = 1.0,
    bins: int = 32,
) -> PipelineModel:
    """Boosted stumps. A row's weight is a function of the stumps chosen so far: each round is one aggregate of (feature, bin,
    class) weights over binned features, and every ``REWEIGH`` rounds the weights so far are written as a column, so that a
    round's cost does not grow with their number."""
    features = list(features)
    rows = _rows(df, features, target, None)
    binner = range_buckets(rows, features, bins)
    # a missing feature counts as above every threshold, here and when scoring
    top = [len(s) - 1 for s in binner.getSplitsArray()]
    codes = [
        F.when(F.col(f).isNull(), F.lit(top[j])).otherwise(F.col(bucket_name(f)).cast("int")).alias(f"b{j}")
        for j, f in enumerate(features)
    ]
    coded = (
        binner.transform(rows)
        .select((F.col(target) == 1).alias("pos"), F.lit(0.0).alias("held"), *codes)
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    kept_rows, written_upto = coded, 0
    edges = [np.array(s[1:-1]) for s in binner.getSplitsArray()]
    stumps: list[tuple[int, int, int, float]] = []  # feature, first bin above, side, weight
    try:
        for turn in range(rounds):
            log_weight = F.col("held")
            for j, cut, side, alpha in stumps[written_upto:]:
                above = F.col(f"b{j}") >= cut
                said_pos = above if side == 1 else ~above
                log_weight = log_weight + F.when(said_pos != F.col("pos"), F.lit(alpha)).otherwise(F.lit(0.0))
            if turn and turn % REWEIGH == 0:
                coded = written(coded.withColumn("held", log_weight), "weighed")
                log_weight, written_upto = F.col("held"), len(stumps)
            cells = F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"b{j}").alias("b")) for j in range(len(features))])
            shift = sum(alpha for *_, alpha in stumps) / 2
            histogram = (
                coded.withColumn("w", F.exp(log_weight - F.lit(shift)))
                .select("pos", "w", F.inline(cells))
                .groupBy("j", "b", "pos")
                .agg(F.sum("w").alias("w"))
                .collect()
            )
            table = np.zeros((len(features), bins + 2, 2))
            for r in histogram:
                table[r["j"], r["b"], int(r["pos"])] += r["w"]
            best = None
            for j in range(len(features)):
                total = table[j].sum()
                neg_below = np.cumsum(table[j, :, 0])
                pos_below = np.cumsum(table[j, :, 1])
                for cut in range(1, len(edges[j]) + 1):
                    # error of "positive from this bin on": negatives above plus positives below
                    error = (table[j, :, 0].sum() - neg_below[cut - 1] + pos_below[cut - 1]) / total
                    for side, e in ((1, error), (-1, 1 - error)):
                        if best is None or e < best[0] - 1e-12:
                            best = (e, j, cut, side)
            if best is None or best[0] >= 0.5:
                break
            error = max(best[0], 1e-10)
            stumps.append((best[1], best[2], best[3], rate * math.log((1 - error) / error)))
            if best[0] <= 0:
                break
    finally:
        kept_rows.unpersist()
    scorer = StumpScorer(
        features=features,
        split_on=[features[j] for j, *_ in stumps],
        thresholds=[float(edges[j][cut - 1]) for j, cut, *_ in stumps],
        sides=[side for *_, side, _ in stumps],
        alphas=[alpha for *_, alpha in stumps],
    )
    return PipelineModel(stages=[scorer])


LEARNERS: dict[str, Callable[..., PipelineModel]] = {
    "random_forest": fit_random_forest,
    "boosted_trees": fit_boosted_trees,
    "logistic": fit_logistic,
    "decision_tree": fit_decision_tree,
    "naive_bayes": fit_naive_bayes,
    "lda": fit_lda,
    "ridge": fit_ridge,
    "linear_svm": fit_linear_svm,
    "kernel_svm": fit_kernel_svm,
    "calibrated": fit_calibrated,
    "mlp": fit_mlp,
    "adaboost": fit_adaboost,
}
UNWEIGHTED = ("naive_bayes", "lda", "mlp", "adaboost")


@dataclass(frozen=True)
class Learner:
    """A learner by name with its settings; ``weighting`` is None, "balanced" or a positive-class factor."""

    name: str
    kind: str
    settings: Mapping[str, object] = field(default_factory=dict)
    weighting: object = None

    def fit(
        self, df: DataFrame, features: Sequence[str], target: str, totals: Mapping | None = None, coded: Coded | None = None,
        left_out: int | None = None,
    ) -> PipelineModel:
        """``coded`` are rows shared by the fits of several folds; ``df`` are those without the fold ``left_out``."""
        if self.kind not in LEARNERS:
            raise ValueError(f"unknown learner {self.kind!r}")
        if self.kind == "boosted_trees" and coded is not None and self.settings.get("bins", 64) == coded.bins:
            return fit_boosted_coded(coded, left_out, self.label_weights(coded.rows_of(left_out)), **self.settings)
        if self.weighting is None:
            return LEARNERS[self.kind](df, features, target, **self.settings)
        if self.kind in UNWEIGHTED:
            raise ValueError(f"{self.kind} takes no row weights")
        if self.weighting == "balanced":
            weighted = balanced_weights(df, target, WEIGHT, totals)
        else:
            weighted = positive_weight(df, target, float(self.weighting), WEIGHT)
        return LEARNERS[self.kind](weighted, features, target, weight=WEIGHT, **self.settings)

    def label_weights(self, n: tuple[int, int]) -> tuple[float, float]:
        """Weights of labels 0 and 1, from the rows of each."""
        if self.weighting is None:
            return 1.0, 1.0
        if self.weighting != "balanced":
            return 1.0, float(self.weighting)
        present = sum(1 for x in n if x)
        return tuple(sum(n) / (present * x) if x else 0.0 for x in n)


def coded_for(
    learners: Sequence[Learner], rows: DataFrame, features: Sequence[str], target: str, fold: str | None = None, k: int = 0
) -> Coded | None:
    """Coded rows for the boosted fits of all learners and folds, where there is more than one of them."""
    many = sum(1 for x in learners if x.kind == "boosted_trees" and x.settings.get("bins", 64) == 64) * max(k, 1)
    return coded_rows(rows, features, target, fold, k) if many > 1 else None


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Kept columns plus ``prediction`` (int) and ``probability`` of class 1 (null when there is none).

    Both come from this model: columns of these names that the table brings along are dropped first."""
    stale = ("prediction", "probability", "rawPrediction")
    keep = [c for c in (df.columns if keep is None else keep) if c not in stale]
    scored = model.transform(df.drop(*stale))
    if "probability" not in scored.columns:
        probability = F.lit(None).cast("double")
    elif isinstance(scored.schema["probability"].dataType, VectorUDT):
        probability = vector_to_array("probability")[1]
    else:
        probability = F.col("probability")
    return scored.select(*keep, F.col("prediction").cast("int").alias("prediction"), probability.alias("probability"))
