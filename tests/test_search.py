import hashlib
import math
import random
import threading

import pytest
from conftest import rows

from riskframe.operators import search as R
from riskframe.plans import tune


def test_draws_follow_the_hash(spark):
    trials = spark.range(200).withColumnRenamed("id", "trial")
    for space in (R.LEAFY_SPACE, R.DEEP_SPACE, R.FOREST_SPACE):
        drawn = R.param_space_sample(trials, "trial", space, 42).collect()
        for name, rng in space.items():
            values = [r[name] for r in drawn]
            if isinstance(rng, R.Choice):
                assert set(values) == {str(v) for v in rng.values}
            else:
                assert all(rng.low - 1e-8 <= v <= rng.high + 1e-8 for v in values)
                assert len(set(values)) > 5
    u = int(hashlib.md5(b"42:learning_rate:7").hexdigest()[:8], 16) / 2**32
    expected = math.exp(math.log(0.01) + u * (math.log(0.3) - math.log(0.01)))
    row = R.param_space_sample(trials, "trial", R.DEEP_SPACE, 42).where("trial = 7").first()
    assert row["learning_rate"] == pytest.approx(expected, abs=1e-8)


def test_pack_params(spark):
    df = spark.createDataFrame([(1, 5, "x")], "trial int, depth int, kind string")
    assert R.pack_params(df, ["depth", "kind"]).first()["params"] == {"depth": "5", "kind": "x"}


@pytest.fixture(scope="module")
def trials(spark):
    rng = random.Random(3)
    data = []
    for study in ("s1", "s2"):
        for t in range(60):
            depth, kind = rng.randint(1, 20), rng.choice("ab")
            data.append((study, t, 0.5 + 0.02 * depth + 0.001 * rng.random(), {"depth": str(depth), "kind": kind}))
    return data, spark.createDataFrame(data, "study string, trial bigint, score double, params map<string,string>")


def test_running_best_and_best_params(trials):
    data, df = trials
    got = {(r["study"], r["trial"]): r["best_so_far"] for r in R.running_best(df.repartition(5)).collect()}
    for study in ("s1", "s2"):
        best = 0
        for s, t, score, _ in data:
            if s == study:
                best = max(best, score)
                assert got[(s, t)] == best
    top = {r["study"]: r for r in R.best_params(df).collect()}
    for study in top:
        winner = max((d for d in data if d[0] == study), key=lambda d: (d[2], -d[1]))
        assert (top[study]["trial"], top[study]["params"]) == (winner[1], winner[3])


def test_earliest_trial_wins(spark):
    df = spark.createDataFrame(
        [("s", 61, 0.885, {"a": "1"}), ("s", 70, 0.885, {"a": "2"}), ("s", 3, 0.87, {"a": "3"}), ("s", 1, None, {"a": "4"})],
        "study string, trial bigint, score double, params map<string,string>",
    )
    assert R.best_params(df).first()["trial"] == 61
    assert tuple(R.search_summary(df).first()) == ("s", 0.885, 4)
    assert rows(R.trial_history(df), "trial")[0] == (1,)


def test_param_importance_by_hand(trials):
    data, df = trials
    got = {(r["study"], r["parameter"]): r["importance"] for r in R.param_importance(df, ["depth"], ["kind"]).collect()}
    for study in ("s1", "s2"):
        mine = [(float(d[3]["depth"]), d[3]["kind"], d[2]) for d in data if d[0] == study]
        n, mean = len(mine), sum(m[2] for m in mine) / len(mine)
        total = sum((m[2] - mean) ** 2 for m in mine)

        def share(bin_of):
            bins = {}
            for m in mine:
                bins.setdefault(bin_of(m), []).append(m[2])
            return sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in bins.values()) / total

        by_depth = share(lambda m: sum(o[0] < m[0] for o in mine) * 5 // n)
        assert got[(study, "depth")] == pytest.approx(by_depth, abs=1e-9)
        assert got[(study, "kind")] == pytest.approx(share(lambda m: m[1]), abs=1e-9)
        assert got[(study, "depth")] > got[(study, "kind")]


def test_settings_become_learners():
    learner = tune.forest_learner(
        {"n_estimators": "298", "max_depth": "23", "min_samples_split": "6", "min_samples_leaf": "4",
         "max_features": "log2", "bootstrap": "false"}
    )
    assert learner.settings == {
        "trees": 298, "depth": 23, "min_split": 6, "min_leaf": 4, "subset": "log2", "bootstrap": False
    }
    boosted = tune.boosted_learner({"n_estimators": "10", "learning_rate": "0.1", "scale_pos_weight": "1.5"}, "deep")
    assert boosted.settings == {"profile": "deep", "rounds": 10, "step": 0.1} and boosted.weighting == 1.5
    whole = tune.boosted_learner({"boosting_type": "dart", "reg_alpha": "0.1", "reg_lambda": "2", "num_leaves": "31", "min_child_samples": "7"})
    assert whole.settings == {"profile": "leafy", "boosting": "dart", "alpha": 0.1, "lambda_": 2.0, "leaves": 31, "min_leaf": 7}
    assert tune.boosted_learner({"booster": "gbtree", "min_child_weight": "3", "gamma": "0.5"}, "deep").settings == {
        "profile": "deep", "boosting": "gbtree", "min_weight": 3.0, "min_gain": 0.5
    }


def test_forest_refuses_what_it_does_not_know():
    with pytest.raises(ValueError, match="nonsense"):
        tune.forest_learner({"n_estimators": "2", "max_depth": "2", "nonsense": "9"})


@pytest.mark.parametrize("space,profile", [(R.LEAFY_SPACE, "leafy"), (R.DEEP_SPACE, "deep")])
def test_every_draw_of_a_boosted_space_is_a_learner(spark, space, profile):
    drawn = R.pack_params(R.param_space_sample(spark.range(20).toDF("trial"), "trial", space), list(space))
    learners = [tune.boosted_learner(r["params"], profile) for r in drawn.collect()]
    assert len(learners) == 20 and all(100 <= x.settings["rounds"] <= 1000 for x in learners)


def test_search_end_to_end(spark):
    rng = random.Random(4)
    data = [(i, float(i % 10), rng.random(), int(i % 10 >= 5)) for i in range(120)]
    df = spark.createDataFrame(data, "id int, a double, b double, y int")
    settings = spark.createDataFrame(
        [(0, {"n_estimators": "2", "max_depth": "1"}), (1, {"n_estimators": "3", "max_depth": "3"})],
        "trial bigint, params map<string,string>",
    )
    found = tune.search_trials(df, settings, tune.forest_learner, ["a", "b"], "y", "id", "forest", k=2)
    got = {r["trial"]: r for r in found.collect()}
    assert set(got) == {0, 1} and got[1]["score"] > 0.9 and got[1]["std"] >= 0
    check = tune.final_cv_check(df, tune.forest_learner(got[1]["params"]), ["a", "b"], "y", "id", k=2)
    means = {r["metric"]: (r["mean"], r["k"]) for r in check.collect()}
    assert means["accuracy"][0] > 0.9 and means["accuracy"][1] == 2 and "roc_auc" in means


def test_folds_of_a_setting_are_fitted_at_once(spark):
    """One setting, three folds: all three fits have to be under way for any of them to end."""
    df = spark.createDataFrame([(i, float(i % 5), i % 2) for i in range(60)], "id int, a double, y int")
    settings = spark.createDataFrame([(1, {})], "trial int, params map<string,string>")
    meeting = threading.Barrier(3)

    class Waiting(tune.Learner):
        def fit(self, *args):
            meeting.wait(timeout=60)
            return super().fit(*args)

    found = tune.search_trials(df, settings, lambda _: Waiting("bayes", "naive_bayes"), ["a"], "y", "id", k=3, parallelism=3)
    assert 0 <= found.first()["score"] <= 1
