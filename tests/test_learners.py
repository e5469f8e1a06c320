import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskframe.operators import learners as L
from riskframe.operators.learners import Learner, score
from riskframe.session import scratch_path
from riskframe.sources import load_model, save_model

FEATURES = ["a", "b", "c"]
SETTINGS = {
    "random_forest": {"trees": 5, "depth": 4, "min_leaf": 2},
    "boosted_trees": {"rounds": 12, "depth": 3},
    "logistic": {},
    "decision_tree": {"depth": 4},
    "naive_bayes": {},
    "lda": {},
    "ridge": {},
    "linear_svm": {},
    "mlp": {"hidden": (4,), "max_iter": 20},
    "adaboost": {"rounds": 8},
}


def _data(n=300, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.gauss(5, 2), rng.random()
        out.append((i, a, b, c, int(a + 0.6 * (b - 5) + rng.gauss(0, 0.4) > 0.4)))
    return out


@pytest.fixture(scope="module")
def data():
    return _data()


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, "id int, a double, b double, c double, y int").cache()


@pytest.mark.parametrize("kind", sorted(SETTINGS))
def test_every_learner_beats_the_majority_and_reloads(spark, df, kind):
    model = Learner(kind, kind, SETTINGS[kind]).fit(df, FEATURES, "y")
    scored = score(model, df, ["id", "y"])
    assert scored.dtypes[2:] == [("prediction", "int"), ("probability", "double")]
    share = scored.agg(F.avg((F.col("y") == F.col("prediction")).cast("double"))).first()[0]
    majority = df.agg(F.greatest(F.avg("y"), 1 - F.avg("y"))).first()[0]
    assert share > majority + 0.15
    without = scored.where("probability IS NULL").count()
    assert without == (df.count() if kind in ("ridge", "linear_svm") else 0)
    path = scratch_path(spark, kind)
    save_model(model, path)
    assert rows(score(load_model(path), df, ["id", "y"])) == rows(scored)


@pytest.mark.parametrize("kind", ["random_forest", "adaboost", "logistic"])
def test_fit_repeats(df, kind):
    one = Learner(kind, kind, SETTINGS[kind]).fit(df, FEATURES, "y")
    two = Learner(kind, kind, SETTINGS[kind]).fit(df, FEATURES, "y")
    assert rows(score(one, df, ["id"])) == rows(score(two, df, ["id"]))


def test_logistic_gradient_vanishes(df, data):
    fitted = L.fit_logistic(df, FEATURES, "y", c=2.0, max_iter=300).stages[-1]
    w, b = fitted.coefficients.toArray(), fitted.intercept
    x, y = np.array([d[1:4] for d in data]), np.array([d[4] for d in data])
    residual = 1 / (1 + np.exp(-(x @ w + b))) - y
    gradient = x.T @ residual + w / 2.0
    assert np.abs(gradient).max() < 0.05 and abs(residual.sum()) < 0.05


def test_ridge_matches_normal_equations(df, data):
    scorer = L.fit_ridge(df, FEATURES, "y", alpha=3.0).stages[0]
    x, t = np.array([d[1:4] for d in data]), np.array([2 * d[4] - 1 for d in data])
    xc = x - x.mean(axis=0)
    w = np.linalg.solve(xc.T @ xc + 3.0 * np.eye(3), xc.T @ (t - t.mean()))
    assert scorer.getOrDefault(scorer.weights) == pytest.approx(list(w), abs=1e-6)
    assert scorer.getOrDefault(scorer.bias) == pytest.approx(t.mean() - x.mean(axis=0) @ w, abs=1e-6)


def test_lda_matches_closed_form(df, data):
    scorer = L.fit_lda(df, FEATURES, "y").stages[0]
    x, y = np.array([d[1:4] for d in data]), np.array([d[4] for d in data])
    pos, neg = x[y == 1], x[y == 0]
    pooled = ((pos - pos.mean(0)).T @ (pos - pos.mean(0)) + (neg - neg.mean(0)).T @ (neg - neg.mean(0))) / (len(x) - 2)
    w = np.linalg.solve(pooled, pos.mean(0) - neg.mean(0))
    b = math.log(len(pos) / len(neg)) - 0.5 * (pos.mean(0) + neg.mean(0)) @ w
    assert scorer.getOrDefault(scorer.weights) == pytest.approx(list(w), rel=1e-8)
    assert scorer.getOrDefault(scorer.bias) == pytest.approx(b, rel=1e-8)


def test_naive_bayes_agrees_with_spark(df):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import VectorAssembler

    ours = dict(rows(score(L.fit_naive_bayes(df, FEATURES, "y"), df, ["id"]).select("id", "probability")))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)
    theirs = NaiveBayes(modelType="gaussian", labelCol="y").fit(ready).transform(ready)
    for r in theirs.select("id", "probability").collect():
        assert ours[r["id"]] == pytest.approx(r["probability"][1], abs=1e-5)


def test_naive_bayes_many_classes_and_flat_column(spark):
    df = spark.createDataFrame([(i % 3, float(i % 3) + i * 1e-3, 7.0) for i in range(30)], "y int, x double, flat double")
    scored = score(L.fit_naive_bayes(df, ["x", "flat"], "y"), df, ["y"])
    assert scored.where("y <> prediction OR probability IS NOT NULL").count() == 0


def test_adaboost_rounds_follow_the_definition(spark):
    points = [(float(i), int(i >= 6) if i != 2 else 1) for i in range(10)]
    df = spark.createDataFrame(points, "x double, y int")
    scorer = L.fit_adaboost(df, ["x"], "y", rounds=1, bins=10).stages[0]
    assert scorer.getOrDefault(scorer.sides) == [1]
    assert 5 < scorer.getOrDefault(scorer.thresholds)[0] <= 6
    assert scorer.getOrDefault(scorer.alphas)[0] == pytest.approx(math.log(0.9 / 0.1))


def test_refusals(df):
    with pytest.raises(ValueError, match="unknown settings"):
        L.fit_boosted_trees(df, FEATURES, "y", depht=3)
    with pytest.raises(ValueError, match="depth"):
        L.fit_random_forest(df, FEATURES, "y", depth=31)
    with pytest.raises(ValueError, match="weights"):
        Learner("x", "naive_bayes", weighting="balanced").fit(df, FEATURES, "y")
    with pytest.raises(ValueError, match="two classes"):
        L.fit_lda(df.where("y = 1"), FEATURES, "y")


def test_null_targets_are_left_out(spark, df):
    extra = spark.createDataFrame([(999, 1e6, 1e6, 1e6, None)], df.schema)
    one = L.fit_logistic(df, FEATURES, "y").stages[-1].coefficients
    two = L.fit_logistic(df.unionByName(extra), FEATURES, "y").stages[-1].coefficients
    assert list(one) == pytest.approx(list(two), abs=1e-6)


def test_missing_features_are_scored_as_they_were_fitted(spark):
    data = [(i, None if i % 2 else float(i % 10), i % 2) for i in range(400)]
    df = spark.createDataFrame(data, "id int, a double, y int")
    stumps = L.score(L.fit_adaboost(df, ["a"], "y", rounds=1), df)
    assert stumps.where("a IS NULL AND prediction <> y").count() == 0
    spread = spark.createDataFrame([(i, float(i % 7), None if i % 3 else 1.0 + i % 2, i % 2) for i in range(60)], "id int, a double, b double, y int")
    bayes = L.score(L.fit_naive_bayes(spread, ["a", "b"], "y"), spread)
    assert bayes.where("probability IS NULL").count() == 0
