import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskframe.operators import learners as L
from riskframe.operators import margins as M
from riskframe.operators.learners import Learner, score
from riskframe.plans.evaluate import Ensemble, fit_panel
from riskframe.session import scratch_path
from riskframe.sources import load_model, save_model

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def df(spark):
    rng = random.Random(3)
    data = []
    for i in range(300):
        a, b = rng.gauss(0, 1), rng.gauss(2, 3)
        data.append((i, a, b, int(a + 0.2 * b + rng.gauss(0, 0.7) > 0.5)))
    return spark.createDataFrame(data, "id int, a double, b double, y int").cache()


def test_sigmoid_is_the_likeliest_curve(spark):
    rng = random.Random(5)
    data = [(m, int(rng.random() < 1 / (1 + math.exp(-(2 * m - 0.7))))) for m in (rng.gauss(0, 1.5) for _ in range(400))]
    slope, shift = M.fit_sigmoid(spark.createDataFrame(data, "m double, y int"), "m", "y")
    m, y = np.array([d[0] for d in data]), np.array([d[1] for d in data])
    pos, neg = y.sum(), (1 - y).sum()
    truth = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    p = 1 / (1 + np.exp(-(slope * m + shift)))
    assert abs(((p - truth) * m).sum()) < 1e-6 and abs((p - truth).sum()) < 1e-6 and 1 < slope < 3.5


def pooled(points):
    """Pool adjacent violators, written out: (margin, mean, weight) by margin."""
    stack: list[list] = []
    for m, v, w in sorted(points):
        stack.append([v, w, [m]])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            v2, w2, m2 = stack.pop()
            v1, w1, m1 = stack.pop()
            stack.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, m1 + m2])
    return {m: v for v, _, ms in stack for m in ms}


def test_monotone_curve_as_written_out(spark):
    rng = random.Random(6)
    data = [(round(rng.gauss(0, 1), 1), int(rng.random() < 0.5 + 0.1 * i % 0.4)) for i in range(500)]
    at, heights = M.fit_monotone(spark.createDataFrame(data, "m double, y int").repartition(5), "m", "y")
    assert all(a < b for a, b in zip(at, at[1:])) and all(a <= b for a, b in zip(heights, heights[1:]))
    by: dict = {}
    for m, y in data:
        by.setdefault(m, []).append(y)
    want = pooled([(m, sum(v) / len(v), len(v)) for m, v in by.items()])
    for m, v in want.items():
        assert np.interp(m, at, heights) == pytest.approx(v)


@pytest.mark.parametrize("settings", [{"base": "linear_svm"}, {"base": "ridge", "method": "monotone"}])
def test_calibrated_margins_vote_and_reload(spark, df, settings):
    learner = Learner("calibrated", "calibrated", settings)
    model = learner.fit(df, FEATURES, "y")
    scored = score(model, df, ["id", "y"])
    found = scored.agg(F.avg("probability"), F.avg("y"), F.min("probability"), F.max("probability"), F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()
    assert found[0] == pytest.approx(found[1], abs=0.06) and 0 <= found[2] < 0.2 and 0.8 < found[3] <= 1 and found[4] > 0.75
    path = scratch_path(spark, "calibrated")
    save_model(model, path)
    assert rows(score(load_model(path), df, ["id", "y"])) == rows(scored)
    panel = fit_panel(df, [learner, Learner("bayes", "naive_bayes")], [Ensemble("soft", "soft")], FEATURES, "y", "id", k=2)
    assert panel["soft"].score(df, ["id"]).where("probability IS NULL").count() == 0


def test_linear_form_of_the_support_vector_machine(df):
    model = L.fit_linear_svm(df, FEATURES, "y")
    linear = M.as_linear(model, FEATURES)
    both = model.transform(df).select("prediction", (linear.raw() > 0).cast("double").alias("ours"), F.abs(linear.raw()).alias("size"))
    assert both.where("prediction <> ours AND size > 1e-9").count() == 0
    with pytest.raises(ValueError, match="margin"):
        M.as_linear(L.fit_naive_bayes(df, FEATURES, "y"), FEATURES)


def test_random_features_tend_to_the_kernel():
    x = np.random.default_rng(0).normal(size=(30, 3))
    mapper = M.RandomFeatureMap(["a", "b", "c"], [0, 0, 0], [1, 1, 1], 0.4, 20_000, 1)
    z = mapper.mapped(x)
    exact = np.exp(-0.4 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - exact).max() < 0.04


def test_kernel_machine_parts_a_ring(spark):
    rng = random.Random(8)
    data = []
    for i in range(400):
        r, t = (rng.gauss(1, 0.2), 1) if i % 2 else (rng.gauss(3, 0.2), 0)
        angle = rng.uniform(0, 2 * math.pi)
        data.append((i, r * math.cos(angle), r * math.sin(angle), t))
    ring = spark.createDataFrame(data, "id int, a double, b double, y int")
    hits = lambda model: score(model, ring, ["y"]).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    kernel = L.fit_kernel_svm(ring, FEATURES, "y", gamma=1.0)
    assert hits(kernel) > 0.97 and hits(L.fit_linear_svm(ring, FEATURES, "y")) < 0.7
    path = scratch_path(spark, "kernel")
    save_model(kernel, path)
    assert rows(score(load_model(path), ring, ["id"])) == rows(score(kernel, ring, ["id"]))
