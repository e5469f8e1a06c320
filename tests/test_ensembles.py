import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskframe.operators import ensembles as E
from riskframe.operators.learners import Learner
from riskframe.operators.sampling import stratified_kfold, stratified_split
from riskframe.plans import evaluate as V

BASE = (Learner("tree", "decision_tree", {"depth": 3}), Learner("bayes", "naive_bayes"))
ENSEMBLES = (
    V.Ensemble("soft", "soft"),
    V.Ensemble("hard", "hard"),
    V.Ensemble("stacked", "stack", Learner("final", "logistic", {}, "balanced")),
)


@pytest.fixture(scope="module")
def df(spark):
    rng = random.Random(8)
    data = []
    for i in range(200):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        data.append((i, a, b, int(a - b + rng.gauss(0, 0.5) > 0)))
    return spark.createDataFrame(data, "id int, a double, b double, y int").cache()


def test_votes_and_ties(spark):
    p = spark.createDataFrame([(1, 0.2, 0.8), (2, 0.6, 0.6)], "id int, p double, q double")
    assert rows(E.vote_soft(p, ["p", "q"]), "id", "prediction", "probability") == [(1, 0, 0.5), (2, 1, 0.6)]
    c = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "id int, p int, q int")
    assert rows(E.vote_hard(c, ["p", "q"]), "id", "prediction", "probability") == [(1, 0, None), (2, 1, None)]


def test_aligned_and_chained_scores_agree(df):
    models = {b.name: b.fit(df, ["a", "b"], "y") for b in BASE}
    from riskframe.operators.learners import score

    joined = E.align_scores({n: score(m, df, ["id"]) for n, m in models.items()}, "id", "probability")
    chained = E.score_columns(df, models).select("id", *models)
    assert rows(joined) == rows(chained)


def test_out_of_fold_scores_come_from_the_other_folds(df):
    folded = stratified_kfold(df, "id", "y", 4)
    meta = E.stack_meta_features(folded, BASE, ["a", "b"], "y", "id", 4)
    assert rows(meta.select("id")) == rows(df.select("id"))
    assert meta.where("tree IS NULL OR bayes IS NULL").count() == 0
    model = BASE[1].fit(folded.where("fold <> 2"), ["a", "b"], "y")
    expected = E.score_columns(folded.where("fold = 2"), {"bayes": model}).select("id", "bayes")
    assert rows(meta.where("fold = 2").select("id", "bayes")) == rows(expected)


def test_panel_scores_every_model_once(df):
    split = stratified_split(df, "id", "y", 0.25)
    table, panel = V.model_panel(
        split.where("NOT is_test"), split.where("is_test"), BASE, ENSEMBLES, ["a", "b"], "y", "id", k=3
    )
    got = {r["model"]: r for r in table.collect()}
    assert set(got) == {"tree", "bayes", "soft", "hard", "stacked"}
    assert {r["n"] for r in got.values()} == {50}
    assert got["hard"]["roc_auc"] is None and got["soft"]["roc_auc"] > 0.8 and got["stacked"]["accuracy"] > 0.7
    long = V.score_panel(panel, df, ["id"])
    assert long.count() == 5 * 200
    soft = panel["soft"].score(df, ["id"])
    assert rows(long.where("model = 'soft'").select("id", "prediction", "probability")) == rows(soft)
    stacked = panel["stacked"].score(df, ["id"])
    assert rows(long.where("model = 'stacked'").select("id", "prediction", "probability")) == rows(stacked)


def test_cross_validation_and_choice(df):
    scored = V.cross_validate(df, BASE, ["a", "b"], "y", "id", k=3, ensembles=ENSEMBLES[:2])
    assert scored.groupBy("model").count().where("count <> 200").count() == 0
    report = V.cv_report(scored, "y")
    by_model = {(r["model"], r["metric"]): r for r in report.collect()}
    assert ("hard", "roc_auc") not in by_model and by_model[("bayes", "accuracy")]["k"] == 3
    test, _ = V.model_panel(df, df, BASE, (), ["a", "b"], "y", "id")
    both = V.comparison_rows(test, report)
    winner = V.choose(both)
    accuracy = {m: r["mean"] for (m, metric), r in by_model.items() if metric == "accuracy"}
    assert winner == min(accuracy, key=lambda m: (-accuracy[m], m))
    assert V.choose(both, by="test") in ("tree", "bayes")


def test_refit(df):
    single = V.refit_best(df, "bayes", BASE, ENSEMBLES, ["a", "b"], "y", "id")
    voted = V.refit_best(df, "soft", BASE, ENSEMBLES, ["a", "b"], "y", "id")
    for model in (single, voted):
        out = V.labelled_scores(df, model, ["a", "b"], ["id"], "yes", "no")
        assert out.where((F.col("prediction") == 1) != (F.col("prediction_label") == "yes")).count() == 0
        assert out.count() == 200
    with pytest.raises(ValueError, match="no model named"):
        V.refit_best(df, "nobody", BASE, ENSEMBLES, ["a", "b"], "y", "id")
    assert df.storageLevel.useMemory and len(df.sparkSession.sparkContext._jsc.getPersistentRDDs()) < 10


def test_stack_by_itself(df):
    stack = V.fit_stack(df, BASE, Learner("final", "random_forest", {"trees": 3, "depth": 3}), ["a", "b"], "y", "id", k=3)
    scored = stack.score(df, ["id", "y"])
    assert scored.agg(F.avg((F.col("y") == F.col("prediction")).cast("double"))).first()[0] > 0.75


@pytest.mark.parametrize("kind", ["soft", "hard", "stack"])
def test_saved_ensembles_score_alike(spark, df, tmp_path, kind):
    from riskframe.operators.scoring import batch_score
    from riskframe.sources import load_model, save_model

    ensemble = next(e for e in ENSEMBLES if e.kind == kind)
    model = V.fit_panel(df, BASE, [ensemble], ["a", "b"], "y", "id", k=3)[ensemble.name]
    path = f"{tmp_path}/{kind}"
    save_model(model, path)
    save_model(model, path, overwrite=True)
    one, two = (batch_score(df, m, ["a", "b"], ["id"]) for m in (model, load_model(path)))
    assert rows(one) == rows(two)


def test_votes_need_probabilities(df):
    learners = [*BASE, Learner("margin", "linear_svm", {"max_iter": 2})]
    with pytest.raises(ValueError, match="margin"):
        V.fit_panel(df, learners, [V.Ensemble("soft", "soft")], ["a", "b"], "y", "id")


def test_old_scores_are_not_taken_for_new_ones(df):
    from riskframe.operators.learners import score

    stale = df.selectExpr("*", "0.99D AS probability", "7 AS prediction")
    got = score(Learner("margin", "linear_svm", {"max_iter": 2}).fit(df, ["a", "b"], "y"), stale)
    assert got.where("probability IS NOT NULL OR prediction > 1").count() == 0


def test_folded_rows_are_written_once(spark, df):
    """Fits and scores read the written folds, not what the table was made of."""
    folded = stratified_kfold(df, "id", "y", 3)
    meta = E.stack_meta_features(folded, BASE[:1], ["a", "b"], "y", "id", 3)
    assert meta.inputFiles() and all("folded" in f for f in meta.inputFiles())
