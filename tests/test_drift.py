import math
import random

import pytest
from conftest import rows

from riskframe.operators import drift as D


def test_ks_against_plain_loop(spark):
    rng = random.Random(6)
    a = [(round(rng.gauss(0, 1), 1), rng.random()) for _ in range(150)]
    b = [(round(rng.gauss(0.5, 1), 1), rng.random()) for _ in range(90)] + [(None, 0.5)]
    left, right = (spark.createDataFrame(t, "x double, u double") for t in (a, b))
    got = {r["column"]: r["statistic"] for r in D.ks_statistic(left, right, ["x", "u"]).collect()}
    for j, name in enumerate(("x", "u")):
        va, vb = [r[j] for r in a if r[j] is not None], [r[j] for r in b if r[j] is not None]
        gap = max(abs(sum(v <= t for v in va) / len(va) - sum(v <= t for v in vb) / len(vb)) for t in va + vb)
        assert got[name] == pytest.approx(gap)


def test_categories(spark):
    a = spark.createDataFrame([("I",), ("I",), ("II",), (None,)], "c string")
    b = spark.createDataFrame([("II",), ("III",)], "c string")
    assert [(r[1], round(r[4], 6)) for r in rows(D.category_drift(a, b, ["c"]))] == [
        ("I", -0.666667), ("II", 0.166667), ("III", 0.5)
    ]
    assert D.total_variation(a, b, ["c"]).first()["statistic"] == pytest.approx(2 / 3)
    same = spark.createDataFrame([("x",), ("x",), ("y",)], "c string")
    assert D.population_stability(same, same, ["c"]).first()["statistic"] == 0
    other = spark.createDataFrame([("x",), ("y",), ("y",)], "c string")
    expected = (1 / 3 - 2 / 3) * math.log(0.5) * 2
    assert D.population_stability(same, other, ["c"]).first()["statistic"] == pytest.approx(expected)


def test_report_and_flag(spark):
    a = spark.createDataFrame([(float(i), "a") for i in range(50)], "x double, c string")
    far = spark.createDataFrame([(float(i + 30), "a") for i in range(50)], "x double, c string")
    same = D.drift_report(a, a, ["x"], ["c"])
    assert {(r["kind"], r["statistic"], r["drifted"]) for r in same.collect()} == {("numeric", 0.0, False), ("category", 0.0, False)}
    assert D.drift_flag(same).first()[0] is False
    moved = D.drift_report(a, far, ["x"], ["c"])
    assert dict(rows(moved, "column", "drifted")) == {"x": True, "c": False}
    assert D.drift_flag(moved).first()[0] is True
    with pytest.raises(ValueError):
        D.drift_report(a, a)


def test_training_progress(spark):
    loss = spark.createDataFrame([(0, 0.67), (1, 0.64), (2, 0.62)], "iter int, loss double")
    time = spark.createDataFrame([(0, 285, 71172), (1, 290, 36046), (2, 441, 36389)], "iter int, passed bigint, remaining bigint")
    got = rows(D.training_progress(loss, time), "iter", "step_time", "loss_drop")
    assert [(i, s) for i, s, _ in got] == [(0, 285), (1, 5), (2, 151)]
    assert got[0][2] is None and got[1][2] == pytest.approx(0.03)
