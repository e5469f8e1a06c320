import random

import pytest
from conftest import rows
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from riskframe.operators import attribution as A
from riskframe.operators.scorers import LinearScorer

W = {"a": 2.0, "b": -1.0, "c": 0.5}


@pytest.fixture(scope="module")
def df(spark):
    rng = random.Random(2)
    data = [(i, rng.gauss(0, 1), rng.gauss(3, 2), rng.random(), i % 2) for i in range(101)]
    return spark.createDataFrame(data, "id int, a double, b double, c double, y int").cache()


def test_contributions_add_up_to_the_score(df):
    means = A.feature_means(df, list(W))
    base = A.base_value(W, means, 0.25)
    total = A.linear_attribution(df, "id", W, means).groupBy("id").agg(F.sum("contribution").alias("s"))
    for r in total.join(df, "id").collect():
        assert base + r["s"] == pytest.approx(0.25 + 2 * r["a"] - r["b"] + 0.5 * r["c"])


def test_waterfall_ends_at_the_score(df):
    means = A.feature_means(df, list(W))
    steps = {}
    for r in A.attribution_waterfall(df, "id", W, means, 0.25).collect():
        steps.setdefault(r["id"], []).append(r)
    for r in df.collect():
        mine = sorted(steps[r["id"]], key=lambda s: s["step"])
        assert [s["step"] for s in mine] == [1, 2, 3]
        sizes = [abs(s["contribution"]) for s in mine]
        assert sizes == sorted(sizes, reverse=True)
        assert mine[0]["from_value"] == pytest.approx(A.base_value(W, means, 0.25))
        assert mine[1]["from_value"] == pytest.approx(mine[0]["to_value"])
        assert mine[2]["to_value"] == pytest.approx(0.25 + 2 * r["a"] - r["b"] + 0.5 * r["c"])
    assert "Exchange" not in A.attribution_waterfall(df, "id", W, means)._jdf.queryExecution().executedPlan().toString()


def test_bars(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0), (2, 0.0, 0.0)], "id int, a double, b double")
    got = rows(A.attribution_bars(df, "id", {"a": 1.0, "b": -1.0}, {"a": 0.0, "b": 0.0}), "id", "feature", "width", "sign_class")
    assert got == [
        (1, "a", 100.0, "positive-value"), (1, "b", pytest.approx(100 / 3), "negative-value"),
        (2, "a", 0.0, "negative-value"), (2, "b", 0.0, "negative-value"),
    ]


def test_summary(df):
    means = A.feature_means(df, list(W))
    got = {r["feature"]: r for r in A.attribution_summary(df, W, means).collect()}
    values = sorted(2.0 * (r["a"] - means["a"]) for r in df.collect())
    assert got["a"]["p50"] == pytest.approx(values[50]) and got["a"]["min_value"] == pytest.approx(values[0])
    assert got["a"]["mean_abs"] == pytest.approx(sum(map(abs, values)) / 101)


@pytest.mark.parametrize("group_rows", [1000, 20, 1])
def test_shuffling_keeps_every_column_value(df, group_rows):
    moved = A.permuted_columns(df, "id", ["a", "b"], 1, group_rows)
    assert moved.count() == 101
    for f in ("a", "b"):
        assert sorted(r[0] for r in moved.select(f"shuffled_{f}").collect()) == sorted(r[0] for r in df.select(f).collect())
    assert rows(moved) == rows(A.permuted_columns(df.repartition(5), "id", ["a", "b"], 1, group_rows))
    if group_rows == 1000:
        assert moved.where("a = shuffled_a").count() == 0


def test_permutation_importance_finds_the_used_feature(spark):
    rng = random.Random(1)
    data = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(400)]
    df = spark.createDataFrame([(i, a, b, int(a > 0)) for i, a, b in data], "id int, a double, b double, y int")
    model = PipelineModel(stages=[LinearScorer(["a", "b"], [1.0, 0.0], 0.0)])
    got = [tuple(r) for r in A.permutation_importance(df, model, ["b", "a"], "y", "id", group_rows=150).collect()]
    assert [r[0] for r in got] == ["a", "b"]
    assert got[0][1] == 1.0 and 0.3 < got[0][3] < 0.7 and got[1][3] == 0.0


@pytest.mark.parametrize("kind,settings", [("boosted_trees", {"rounds": 4, "depth": 4}), ("random_forest", {"trees": 4, "depth": 4}), ("decision_tree", {"depth": 4})])
def test_tree_contributions_add_up_to_the_score(df, kind, settings):
    from riskframe.operators.learners import Learner, score

    marked = df.withColumn("y", (F.col("a") + 0.3 * F.col("b") > 1).cast("int"))
    model = Learner(kind, kind, settings).fit(marked, ["a", "b", "c"], "y")
    forest = A.forest_of(model)
    rows_ = A.tree_contributions(marked, "id", forest)
    scored = score(model, marked, ["id"])
    value = F.log(F.col("probability") / (1 - F.col("probability"))) if kind == "boosted_trees" else F.col("probability")
    for r in rows_.join(scored.select("id", value.alias("value")), "id").collect():
        assert [p["feature"] for p in r["pairs"]] == ["a", "b", "c"]
        assert forest.base_value() + sum(p["contribution"] for p in r["pairs"]) == pytest.approx(r["value"], abs=1e-9)
    steps = A.contribution_waterfall(rows_, "id", forest.base_value()).where("step = 3").join(scored.select("id", value.alias("value")), "id")
    assert all(r["to_value"] == pytest.approx(r["value"], abs=1e-9) for r in steps.collect())
    assert A.contribution_bars(rows_, "id").groupBy("id").agg(F.max("width").alias("w")).where("abs(w - 100) > 1e-6 AND w <> 0").count() == 0
    found = {r["feature"]: r["mean_abs"] for r in A.contribution_summary(A.wide_contributions(rows_, forest.features), forest.features).collect()}
    assert set(found) == {"a", "b", "c"} and found["a"] > found["c"]
    assert "Exchange" not in rows_._jdf.queryExecution().executedPlan().toString()
