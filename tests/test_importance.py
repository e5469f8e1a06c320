import random

import pytest
from conftest import rows

from riskframe.operators import importance as I
from riskframe.operators.learners import fit_decision_tree, fit_random_forest

# Published importances of one study (share in a forest, splits in a boosted model).
IMPORTANCES = [
    ("DT", 0.06517212158679453, 382), ("FS", 0.14929422177933716, 287), ("BMI", 0.025070439791623465, 262),
    ("EA", 0.025829912518943267, 236), ("RR", 0.013801008317275518, 83), ("LVIDd", 0.03190097906731174, 68),
    ("Wall_Subendocardial", 0.01517523261850333, 64), ("NYHA_III", 0.016633004919450488, 62),
    ("Wall_No", 0.03349558067662931, 33), ("ACS_UA", 0.0255562974151001, 0), ("MR_Severe", 0.0036178952041233357, 0),
]
AVERAGES = {"DT": 191.0325860607934, "FS": 143.57464711088966, "Wall_No": 16.516747790338314, "ACS_UA": 0.01277814870755005}
# An invented vote: which of four methods chose a feature.
METHODS = ("lasso", "forest", "logistic", "expert")
VOTES = [
    ("height", True, True, True, True),
    ("width", True, True, True, True),
    ("depth", True, True, False, True),
    ("colour", True, True, True, False),
    ("weight", False, True, False, True),
    ("price", True, False, True, False),
    ("shape", False, True, False, False),
    ("age", True, False, False, False),
]


def chosen_by(least):
    return {row[0] for row in VOTES if sum(row[1:]) >= least}


@pytest.fixture(scope="module")
def votes(spark):
    return I.votes_table(spark, {m: [row[0] for row in VOTES if row[1 + i]] for i, m in enumerate(METHODS)})


def test_raw_average_and_order(spark):
    left = spark.createDataFrame([(f, a) for f, a, _ in reversed(IMPORTANCES)], "feature string, a double")
    right = spark.createDataFrame([(f, b) for f, _, b in IMPORTANCES], "feature string, b int")
    got = [tuple(r) for r in I.combine_importance(left, right, "a", "b", mode="raw").collect()]
    assert [r[0] for r in got] == [f for f, *_ in IMPORTANCES]
    for f, average in AVERAGES.items():
        assert dict((r[0], r[3]) for r in got)[f] == pytest.approx(average, abs=1e-12)
    top = I.top_k_features(spark.createDataFrame(got, "feature string, a double, b int, average_importance double"), 4)
    assert [r[0] for r in top.collect()] == ["DT", "FS", "BMI", "EA"]


def test_normalized_is_scale_free(spark):
    left = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "feature string, x double")
    right = spark.createDataFrame([("a", 100), ("b", 300)], "feature string, n int")
    assert [r[3] for r in I.combine_importance(left, right, "x", "n").collect()] == [0.5, 0.5]
    with pytest.raises(ValueError):
        I.combine_importance(left, right, "x", "n", mode="other")


def test_votes(votes):
    wide = {r["feature"]: r for r in I.method_votes(votes, list(METHODS)).collect()}
    for feature, *picked in VOTES:
        assert [wide[feature][m] for m in METHODS] == picked and wide[feature]["methods_count"] == sum(picked)
    assert {r[0] for r in I.vote_threshold(votes, 3).collect()} == chosen_by(3)
    assert {r[0] for r in I.vote_threshold(votes, 2).collect()} == chosen_by(2)
    lists = [votes.where(f"method = '{m}'").select("feature") for m in METHODS]
    assert {r[0] for r in I.vote_intersection(lists).collect()} == chosen_by(4)


@pytest.fixture(scope="module")
def signal(spark):
    rng = random.Random(5)
    data = []
    for i in range(400):
        a, b, noise = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
        data.append((i, a, b, noise, 0.0, int(a + 0.5 * b + rng.gauss(0, 0.3) > 0)))
    return spark.createDataFrame(data, "id int, a double, b double, noise double, flat double, y int").cache()


NAMES = ["a", "b", "noise", "flat"]


def test_model_importances(spark, signal):
    model = fit_random_forest(signal, NAMES, "y", trees=5, depth=4).stages[-1]
    table = I.importance_table(spark, model, NAMES).collect()
    assert table[0]["feature"] == "a" and sum(r["importance"] for r in table) == pytest.approx(1.0)
    splits = {r["feature"]: r["importance"] for r in I.split_count_importance(spark, model, NAMES).collect()}
    assert splits["flat"] == 0 and splits["a"] > 0
    assert sum(splits.values()) == sum((t.numNodes - 1) // 2 for t in model.trees)
    tree = fit_decision_tree(signal, NAMES, "y", depth=3).stages[-1]
    single = {r["feature"]: r["importance"] for r in I.split_count_importance(spark, tree, NAMES).collect()}
    assert sum(single.values()) == (tree.numNodes - 1) // 2


def test_selectors(signal):
    l1 = {r["feature"]: r["chosen"] for r in I.select_l1(signal, NAMES, "y", alpha=0.08).collect()}
    assert l1["a"] and l1["b"] and not l1["noise"] and not l1["flat"]
    assert [r["feature"] for r in I.select_rf(signal, NAMES, "y", k=2, trees=5).collect()] == ["a", "b"]
    assert "flat" not in {r["feature"] for r in I.select_rf(signal, NAMES, "y", cut=0.0, trees=5).collect()}
    assert [r["feature"] for r in I.select_lr(signal, NAMES, "y", k=2).collect()] == ["a", "b"]
    assert I.select_domain(signal, ["b", "a"], ["id"]).columns == ["id", "b", "a"]
    with pytest.raises(ValueError):
        I.select_rf(signal, NAMES, "y")
    with pytest.raises(ValueError, match="zinc"):
        I.select_domain(signal, ["zinc"])


def test_vector_names(signal):
    assert I.vector_names(I.assemble(signal, NAMES)) == NAMES
    assert rows(I.scaled(signal, ["a"]).select("id")) == rows(signal.select("id"))
