"""Queries of tuned learners and of searches fit all the rounds that the reference fits."""

import datetime

import numpy as np
import pytest
from conftest import rows

from riskframe.catalog import all_queries
from riskframe.operators import boosting as B
from riskframe.operators import learners as L
from riskframe.operators import search as R

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of a few rows: events of two kinds, and regions for the trials of a search."""
    rng, path = np.random.default_rng(5), str(tmp_path_factory.mktemp("tables"))
    start, kinds = datetime.datetime(2024, 1, 1), ("view", "purchase", "click", "signup")
    events = []
    for i in range(90):
        at = start + datetime.timedelta(minutes=int(rng.integers(0, 1440)))
        k = int(rng.integers(0, 9))
        events.append((i, at, int(rng.integers(0, 12)), kinds[(k + i % 2) % 4], float(rng.normal() ** 2), '{"k": %d}' % k))
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(events, schema).write.parquet(f"{path}/events.parquet")
    spark.createDataFrame([(0,), (3,)], "r_regionkey int").write.parquet(f"{path}/region.parquet")
    return path


@pytest.fixture
def fits(monkeypatch):
    """Settings and number of trees of every boosted fit."""
    found, boosted = [], B.boosted

    def noted(*args):
        model = boosted(*args)
        found.append((next(a for a in args if isinstance(a, dict) and "rounds" in a), len(model.stages[-1].parts()[1])))
        return model

    monkeypatch.setattr(B, "boosted", noted)
    return found


def test_the_deep_profile_is_fitted_whole(spark, folder, fits):
    assert all_queries()["fit_boosted_trees_deep"](spark, folder).count() == 90
    assert [(s, n) for s, n in fits] == [(B.PROFILES["deep"], 500)]


@pytest.mark.parametrize("boosting", ["gbdt", "dart", "goss"])
@pytest.mark.parametrize("leaves", [None, 7])
def test_one_task_fits_what_passes_fit(spark, monkeypatch, boosting, leaves):
    """A fit of many rounds is one job where a task holds its rows, and gives the trees that passes over them give."""
    rng = np.random.default_rng(3)
    data = [(float(rng.normal()), None if i % 9 == 0 else float(rng.integers(0, 6)), float(rng.random())) for i in range(300)]
    data = [(*x, int(x[0] + 0.5 * (x[1] or 0) * (x[2] > 0.4) + rng.normal() * 0.3 > 1.0)) for x in data]
    df = spark.createDataFrame(data, "a double, b double, c double, y int")
    s = {**B.PROFILES["leafy"], "boosting": boosting, "rounds": B.REWRITE + 4, "depth": 5, "leaves": leaves, "drop": 0.5, "skip": 0.2}
    passes, histograms = [], B.histograms
    monkeypatch.setattr(B, "histograms", lambda *a: passes.append(1) or histograms(*a))
    one = B.fit_histogram_boosting(df, FEATURES, "y", None, s)
    assert not passes
    monkeypatch.setattr(B, "TASK_ROWS", 0)
    two = B.fit_histogram_boosting(df, FEATURES, "y", None, s)
    assert passes
    first, second = one.stages[-1].parts(), two.stages[-1].parts()
    assert first[2:] == second[2:] and len(first[1]) == s["rounds"]
    assert [t.as_lists() for t in first[1]] == [t.as_lists() for t in second[1]]
    assert rows(L.score(one, df, ["y"])) == rows(L.score(two, df, ["y"]))


def test_rows_are_scored_as_by_the_trees_themselves(spark):
    """Places among all trees' thresholds send a row where its values do: at a threshold, beyond all of them, missing."""
    trees = [
        {"feature": [0, 1, -1, -1, -1], "threshold": [0.5, 2.0, 0, 0, 0], "missing_left": [True, False, False, False, False], "left": [1, 3, -1, -1, -1], "right": [2, 4, -1, -1, -1], "value": [0, 0, 1.0, 2.0, 4.0]},
        {"feature": [0, -1, -1], "threshold": [float("inf"), 0, 0], "missing_left": [False] * 3, "left": [1, -1, -1], "right": [2, -1, -1], "value": [0, 0.25, 8.0]},
        {"feature": [-1], "threshold": [0], "missing_left": [False], "left": [-1], "right": [-1], "value": [0.125]},
    ]
    forest = [B.T.tree_of({**t, "cover": [1.0] * len(t["feature"]), "gain": [0.0] * len(t["feature"])}) for t in trees]
    scorer = B.BoostedScorer(["a", "b"], B.T.dump(forest), [1.0, 0.5, 2.0], -3.0)
    values = [0.5, 0.49, -1.0, 7.0, float("inf"), float("-inf"), None]
    table = spark.createDataFrame([(a, b) for a in values for b in (1.9, 2.0, 2.1, None)], "a double, b double")
    for a, b, margin in table.select("a", "b", scorer.raw()).collect():
        x = np.array([[np.nan if v is None else v for v in (a, b)]])
        assert margin == -3.0 + sum(w * t.predict(x)[0] for t, w in zip(forest, [1.0, 0.5, 2.0]))


def test_a_panel_fits_its_boosted_members_whole(spark, folder, fits):
    """Each profile once for all training rows and once for each of the five folds of the stacks."""
    assert all_queries()["model_panel"](spark, folder).count() == 9
    assert sorted(n for s, n in fits) == [264] * 6 + [500] * 6
    assert all(s in (B.PROFILES["leafy"], B.PROFILES["deep"]) for s, _ in fits)


def whole_study(spark, space):
    """The number of trees of each of the three folds' fits of each setting, as drawn from the whole space."""
    drawn = R.param_space_sample(spark.createDataFrame([(0,), (3,)], "trial int"), "trial", space)
    assert all(100 <= r["n_estimators"] <= 1000 for r in drawn.collect())
    return sorted(r["n_estimators"] for r in drawn.collect() for _ in range(3))


def test_the_leafy_study_draws_from_the_whole_space(spark, folder, fits):
    found = all_queries()["search_trials_leafy"](spark, folder).collect()
    assert sorted(n for s, n in fits) == whole_study(spark, R.LEAFY_SPACE)
    assert sorted(int(r["n_estimators"]) for r in found) == sorted({n for _, n in fits})
    assert all(s["rounds"] == n for s, n in fits)


def test_the_deep_study_draws_from_the_whole_space(spark, folder, fits):
    found = all_queries()["search_trials_deep"](spark, folder).collect()
    assert sorted(n for s, n in fits) == whole_study(spark, R.DEEP_SPACE)
    assert sorted(int(r["n_estimators"]) for r in found) == sorted({n for _, n in fits})
    assert all(s["rounds"] == n for s, n in fits)


def test_the_studies_together_draw_from_the_whole_spaces(spark, folder, fits):
    found = {r["study"]: r["n_trials"] for r in all_queries()["search_studies"](spark, folder).collect()}
    assert found == {"forest": 2, "leafy": 2, "deep": 2}
    assert sorted(n for _, n in fits) == sorted(whole_study(spark, R.LEAFY_SPACE) + whole_study(spark, R.DEEP_SPACE))
