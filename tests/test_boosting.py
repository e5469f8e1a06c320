import itertools
import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskframe.operators import boosting as B
from riskframe.operators import learners as L
from riskframe.operators import trees as T
from riskframe.operators.ordering import exact_quantiles
from riskframe.session import scratch_path
from riskframe.sources import load_model, save_model

FEATURES = ["a", "b", "c"]
PLAIN = {"boosting": "gbdt", "rounds": 1, "depth": 3, "leaves": None, "step": 1.0, "rows": 1.0, "subset": 1.0, "min_leaf": 3, "min_weight": 0.5, "min_gain": 0.01, "alpha": 0.3, "lambda_": 0.7}


def data(n=240, seed=4):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a, b, c = float(rng.normal()), float(rng.integers(0, 6)), float(rng.random())
        out.append((i, a, None if i % 9 == 0 else b, c, int(a + 0.5 * b * (c > 0.4) + rng.normal() * 0.3 > 1.0), 1.0 + i % 3))
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(data(), "id int, a double, b double, c double, y int, w double")


def plain_tree(x, y, w, edges, s, base):
    """Best-first growth, one leaf at a time, with every split tried on the rows themselves."""
    unit = B.UNIT / w.max()
    p = 1 / (1 + np.exp(-base))
    g, h = np.rint(w * (p - y) * unit), np.rint(w * p * (1 - p) * unit)
    worth = lambda at: max(abs(g[at].sum() / unit) - s["alpha"], 0) ** 2 / (h[at].sum() / unit + s["lambda_"] + 1e-12)

    def best(at, depth):
        found = None
        if depth >= s["depth"]:
            return None
        for missing_left in (False, True):
            for f, cuts in enumerate(edges):
                for cut in cuts:
                    goes = np.where(np.isnan(x[at, f]), missing_left, x[at, f] < cut)
                    left, right = at[goes], at[~goes]
                    if min(len(left), len(right)) < max(1, s["min_leaf"]) or min(h[left].sum(), h[right].sum()) / unit < s["min_weight"]:
                        continue
                    gain = 0.5 * (worth(left) + worth(right) - worth(at))
                    if gain > s["min_gain"] and (found is None or gain > found[0] + 1e-9):
                        found = (gain, left, right)
        return found

    whole = np.arange(len(y))
    leaves = [(whole, 0, best(whole, 0))]
    while any(b for *_, b in leaves) and (s["leaves"] is None or len(leaves) < s["leaves"]):
        i = max((i for i, leaf in enumerate(leaves) if leaf[2]), key=lambda i: leaves[i][2][0])
        _, depth, (_, left, right) = leaves.pop(i)
        leaves += [(left, depth + 1, best(left, depth + 1)), (right, depth + 1, best(right, depth + 1))]
    out = np.empty(len(y))
    for at, *_ in leaves:
        total = g[at].sum() / unit
        out[at] = -math.copysign(max(abs(total) - s["alpha"], 0), total) / (h[at].sum() / unit + s["lambda_"] + 1e-12)
    return out, len(leaves)


@pytest.mark.parametrize("change", [{}, {"leaves": 5, "depth": 12}, {"leaves": 9, "depth": 12, "min_leaf": 1, "alpha": 0.0}])
def test_first_tree_is_that_of_a_search_over_all_splits(df, change):
    s = {**PLAIN, **change}
    model = B.fit_histogram_boosting(df, FEATURES, "y", "w", s, bins=16).stages[-1]
    _, (tree,), (weight,), base = model.parts()
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in data()])
    y, w = np.array([r[4] for r in data()], float), np.array([r[5] for r in data()])
    edges = B.bin_edges(df, FEATURES, 16)
    want, leaves = plain_tree(x, y, w, edges, s, base)
    assert weight == 1.0 and base == pytest.approx(math.log(w[y == 1].sum() / w[y == 0].sum()))
    assert (tree.feature < 0).sum() == leaves > 3
    assert tree.predict(x) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("boosting", ["gbdt", "dart", "goss"])
def test_partitions_and_reload_change_nothing(spark, df, boosting):
    s = {**PLAIN, "boosting": boosting, "rounds": B.REWRITE + 3, "step": 0.3, "rows": 0.8, "subset": 0.7, "leaves": 6, "drop": 0.5, "most_dropped": 50, "skip": 0.0}
    one = B.fit_histogram_boosting(df.repartition(1), FEATURES, "y", None, s)
    two = B.fit_histogram_boosting(df.repartition(5, "c"), FEATURES, "y", None, s)
    first, second = rows(L.score(one, df, ["id"])), rows(L.score(two, df, ["id"]))
    assert first == second
    path = scratch_path(spark, "boosted")
    save_model(one, path)
    assert rows(L.score(load_model(path), df, ["id"])) == first


def test_dropped_trees_share_their_weight():
    """With every tree dropped each round, n trees weigh step / n each."""
    s = {**PLAIN, "boosting": "dart", "rounds": 4, "step": 0.5, "drop": 1.0, "most_dropped": 50, "skip": 0.0}
    weights: list[float] = []
    for _ in range(s["rounds"]):
        k = len(weights)
        weights = [w * k / (k + 1) for w in weights] + [s["step"] / (k + 1)]
    assert weights == pytest.approx([0.125] * 4)


def test_dart_fits_without_the_dropped_trees(df):
    """All trees dropped: each new tree is fitted to the prior alone, so with all rows and columns all trees are equal."""
    s = {**PLAIN, "boosting": "dart", "rounds": 4, "step": 0.5, "drop": 1.1, "most_dropped": 50, "skip": 0.0}
    _, forest, weights, _ = B.fit_histogram_boosting(df, FEATURES, "y", None, s).stages[-1].parts()
    assert weights == pytest.approx([0.125] * 4)
    assert all(t.as_lists() == forest[0].as_lists() for t in forest)


def test_loss_falls_and_profiles_are_taken_whole(df):
    s = {**PLAIN, "rounds": 12, "step": 0.3}
    names, forest, weights, base = B.fit_histogram_boosting(df, FEATURES, "y", None, s).stages[-1].parts()
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in data()])
    y, margin, losses = np.array([r[4] for r in data()]), np.full(len(x), base), []
    for tree, weight in zip(forest, weights):
        margin = margin + weight * tree.predict(x)
        losses.append(np.mean(np.log1p(np.exp(-(2 * y - 1) * margin))))
    assert all(b < a for a, b in zip(losses, losses[1:])) and losses[-1] < 0.35
    for profile in ("leafy", "deep"):
        model = L.fit_boosted_trees(df, FEATURES, "y", profile=profile, rounds=2)
        assert len(model.stages[-1].parts()[1]) == 2
    with pytest.raises(ValueError, match="unknown settings"):
        L.fit_boosted_trees(df, FEATURES, "y", depht=3)


@pytest.mark.parametrize("pivots", [3, 4096])
def test_edges_are_the_exact_quantiles(df, monkeypatch, pivots):
    monkeypatch.setattr(B, "PIVOTS", pivots)
    picks = {f"q{i}": i / 16 for i in range(1, 17)}
    want = {r["column"]: r for r in exact_quantiles(df.select(*FEATURES), FEATURES, picks).collect()}
    for name, got in zip(FEATURES, B.bin_edges(df, FEATURES, 16)):
        assert got.tolist() == sorted({want[name][q] for q in picks})


def test_a_round_computes_gradients_once_and_sums_no_leaves(df, monkeypatch):
    """A tree of depth 3 takes a pass for the root and one for each level that may still be split."""
    passes, rounds = [], []
    histograms, drawn_rows = B.histograms, B.drawn_rows
    monkeypatch.setattr(B, "histograms", lambda *a: passes.append(len(a[3])) or histograms(*a))
    monkeypatch.setattr(B, "drawn_rows", lambda *a: rounds.append(1) or drawn_rows(*a))
    B.fit_histogram_boosting(df, FEATURES, "y", None, {**PLAIN, "rounds": 2})
    assert len(rounds) == 2 and len(passes) <= 2 * PLAIN["depth"]


def test_the_largest_value_is_not_taken_for_missing(spark):
    """With a bin for each value, the rows of the largest one are split off on their own side."""
    rows_ = [(float(i % 8), int(i % 8 == 7)) for i in range(80)] + [(None, 0)] * 10
    table = spark.createDataFrame(rows_, "a double, y int")
    _, (tree,), _, _ = B.fit_histogram_boosting(table, ["a"], "y", None, {**PLAIN, "depth": 1, "alpha": 0.0}, bins=8).stages[-1].parts()
    assert tree.cover.tolist() == [90.0, 80.0, 10.0] and tree.missing_left[0]
    assert tree.leaf_of(np.array([[np.nan], [6.0], [7.0]])).tolist() == [1, 1, 2]


def test_odd_tables(spark, df):
    flat = spark.createDataFrame([(1.0, None, i % 2) for i in range(20)], "a double, b double, y int")
    assert {r[1] for r in rows(L.score(L.fit_boosted_trees(flat, ["a", "b"], "y", rounds=2), flat, ["y"]))} <= {0, 1}
    one_class = df.where("y = 1")
    assert {r[0] for r in rows(L.score(L.fit_boosted_trees(one_class, FEATURES, "y", rounds=1), one_class, []))} == {1}
    empty = df.where("y = 7")
    assert L.score(L.fit_boosted_trees(empty, FEATURES, "y", rounds=3), df, ["id"]).count() == df.count()


def expected(tree: T.Tree, x: np.ndarray, known: frozenset, node: int = 0) -> float:
    """Value of a row of which only some features are known, the others weighed by training rows."""
    f = int(tree.feature[node])
    if f < 0:
        return float(tree.value[node])
    left, right = int(tree.left[node]), int(tree.right[node])
    if f in known:
        goes_left = bool(tree.missing_left[node]) if np.isnan(x[f]) else x[f] < tree.threshold[node]
        return expected(tree, x, known, left if goes_left else right)
    n = tree.cover[node]
    return tree.cover[left] / n * expected(tree, x, known, left) + tree.cover[right] / n * expected(tree, x, known, right)


def test_tree_contributions_as_by_enumeration(df):
    s = {**PLAIN, "rounds": 3, "depth": 6, "min_leaf": 2, "step": 0.5}
    _, forest, _, _ = B.fit_histogram_boosting(df, FEATURES, "y", None, s).stages[-1].parts()
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in data()])[:25]
    for tree in forest:
        got = tree.contributions(x)
        assert got.sum(axis=1) == pytest.approx(tree.predict(x) - tree.mean(), abs=1e-10)
        for i, row in enumerate(x):
            for j in range(3):
                others = [k for k in range(3) if k != j]
                want = 0.0
                for size in range(3):
                    for some in itertools.combinations(others, size):
                        chance = math.factorial(size) * math.factorial(2 - size) / math.factorial(3)
                        want += chance * (expected(tree, row, frozenset((*some, j))) - expected(tree, row, frozenset(some)))
                assert got[i, j] == pytest.approx(want, abs=1e-10)


def test_folds_share_coded_rows(df):
    """Fits that leave out one fold each code the table once, and are the fits on the rows of the other folds."""
    from riskframe.operators.learners import Learner

    table = df.withColumn("fold", F.when(F.col("id") % 11 != 0, F.col("id") % 3)).withColumn("y", F.when(F.col("id") != 7, F.col("y")))
    shared = B.coded_rows(table, FEATURES, "y", "fold", 3, bins=16)
    for left_out in (0, 2, None):
        rest = table.where("y IS NOT NULL") if left_out is None else table.where(f"fold <> {left_out} AND y IS NOT NULL")
        assert [list(e) for e in shared.edges[left_out]] == [list(e) for e in B.bin_edges(rest, FEATURES, 16)]
    for weighting in ("balanced", 1.5):
        learner = Learner("b", "boosted_trees", {"rounds": 3, "depth": 3, "bins": 16, "profile": "deep"}, weighting)
        one = learner.fit(rest.where("fold <> 2"), FEATURES, "y").stages[-1].parts()
        two = learner.fit(rest.where("fold <> 2"), FEATURES, "y", None, shared, 2).stages[-1].parts()
        assert one[2] == two[2] and one[3] == pytest.approx(two[3], abs=1e-12)
        for a, b in zip(one[1], two[1]):
            assert np.array_equal(a.feature, b.feature) and np.array_equal(a.threshold, b.threshold) and np.allclose(a.value, b.value)


def test_other_labels_share_no_coded_rows(df):
    assert B.coded_rows(df.withColumn("y", F.col("y") + 1), FEATURES, "y") is None
