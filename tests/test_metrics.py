import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskframe.operators import curves, metrics

# True-negative, false-positive, false-negative, true-positive counts of nine evaluated models
# with the positive-class precision and the support-weighted precision, recall and F1 published for them.
MATRICES = {
    "lightgbm": ((30, 7, 4, 39), 0.8478260869565217, (0.8637947570332483, 0.8625, 0.8619124861528723)),
    "extra_trees": ((31, 6, 4, 39), 0.8666666666666667, (0.8754761904761905, 0.875, 0.8746843434343434)),
    "gradient_boosting": ((28, 9, 2, 41), 0.82, (0.8724166666666665, 0.8625, 0.8604918953619002)),
    "random_forest": ((27, 10, 4, 39), 0.7959183673469388, (0.8306287030941408, 0.825, 0.8229859335038363)),
    "stacking_lr": ((28, 9, 6, 37), 0.8043478260869565, (0.8132193094629155, 0.8125, 0.8116988447539167)),
    "stacking_rf": ((27, 10, 7, 36), 0.782608695652174, (0.7879315856777493, 0.7875, 0.786592024054439)),
    "voting_hard": ((28, 9, 2, 41), 0.82, (0.8724166666666665, 0.8625, 0.8604918953619002)),
    "voting_soft": ((28, 9, 3, 40), 0.8163265306122449, (0.8565174456879525, 0.85, 0.8482736572890026)),
    "xgboost": ((28, 9, 3, 40), 0.8163265306122449, (0.8565174456879525, 0.85, 0.8482736572890026)),
}
FOLDS = (0.9000, 0.8750, 0.8500, 0.8500, 0.8750, 0.8750, 0.7500, 0.9250, 0.8750, 0.8250)


@pytest.fixture(scope="module")
def scored(spark):
    data = [
        (model, y, p)
        for model, ((tn, fp, fn, tp), _, _) in MATRICES.items()
        for (y, p), n in {(0, 0): tn, (0, 1): fp, (1, 0): fn, (1, 1): tp}.items()
        for _ in range(n)
    ]
    return spark.createDataFrame(data, "model string, y int, prediction int").cache()


def test_published_reports(scored):
    binary = {r["model"]: r for r in metrics.precision_recall_f1(scored, by=["model"]).collect()}
    weighted = {r["model"]: r for r in metrics.weighted_prf(scored, by=["model"]).collect()}
    for model, ((tn, _, _, tp), precision, weights) in MATRICES.items():
        assert binary[model]["precision"] == pytest.approx(precision, abs=1e-12)
        assert binary[model]["accuracy"] == (tn + tp) / 80
        got = weighted[model]
        assert (got["precision"], got["recall"], got["f1"]) == pytest.approx(weights, abs=1e-12)


def test_published_full_report(scored):
    report = metrics.classification_report(scored.where("model = 'lightgbm'"), by=["model"])
    got = {r["class"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in report.collect()}
    expected = {
        "0": (0.8823529411764706, 0.8108108108108109, 0.8450704225352113, 37),
        "1": (0.8478260869565217, 0.9069767441860465, 0.8764044943820225, 43),
        "accuracy": (0.8625, 0.8625, 0.8625, 80),
        "macro avg": (0.8650895140664961, 0.8588937774984287, 0.8607374584586169, 80),
        "weighted avg": (0.8637947570332483, 0.8625, 0.8619124861528723, 80),
    }
    assert got.keys() == expected.keys()
    for name, values in expected.items():
        assert got[name] == pytest.approx(values, abs=1e-12)
    plain = metrics.classification_report(scored.where("model = 'lightgbm'"))
    assert plain.count() == 5
    wide = metrics.report_wide(report, ["1", "0"], ["model"]).first()
    assert wide["recall_macro_avg"] == pytest.approx(0.8588937774984287) and len(wide) == 14


def test_final_model_values(spark):
    cells = [(0, 0, 30), (0, 1, 7), (1, 0, 2), (1, 1, 41)]
    df = spark.createDataFrame([(y, p) for y, p, n in cells for _ in range(n)], "y int, prediction int")
    r = metrics.precision_recall_f1(df).first()
    assert (r["precision"], r["recall"], r["accuracy"]) == pytest.approx((41 / 48, 41 / 43, 71 / 80))
    assert r["f1"] == pytest.approx(2 * 41 / (48 + 43))
    assert rows(metrics.confusion_matrix(df, [0, 1])) == cells


def test_zero_cells_and_groups(spark):
    df = spark.createDataFrame([("a", 0, 0), ("b", 1, 0)], "g string, y int, prediction int")
    got = rows(metrics.confusion_matrix(df, [0, 1], by=["g"]))
    assert len(got) == 8 and sum(r[3] for r in got) == 2
    wide = metrics.confusion_wide(metrics.confusion_matrix(df, [0, 1], by=["g"]), [0, 1], ["g"])
    assert rows(wide) == [("a", 0, 1, 0), ("a", 1, 0, 0), ("b", 0, 0, 0), ("b", 1, 1, 0)]


def test_one_class_only(spark):
    df = spark.createDataFrame([(0, 0, 0.1)] * 4, "y int, prediction int, p double")
    r = metrics.precision_recall_f1(df).first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0.0, 0.0, 0.0, 1.0)
    assert curves.roc_auc(df).first()["roc_auc"] is None
    assert {r["tpr"] for r in curves.roc_curve(df).collect()} == {None}


def test_population_deviation_of_folds(spark):
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate(FOLDS)], "model string, fold int, accuracy double")
    summary = metrics.mean_pm_std(metrics.cv_summary(df, ["accuracy"], ["model"])).first()
    assert (summary["text"], summary["k"]) == ("0.8600 ± 0.0450", 10)


def _auc(pairs):
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", range(3))
def test_auc_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    data = [(g, rng.randint(0, 1), round(rng.random(), 2)) for g in "ab" for _ in range(150)]
    df = spark.createDataFrame(data, "g string, y int, p double")
    got = {r["g"]: r["roc_auc"] for r in curves.roc_auc(df, by=["g"]).collect()}
    area = {r["g"]: r["auc"] for r in curves.auc_trapezoid(curves.roc_curve(df, by=["g"]), by=["g"]).collect()}
    for g in "ab":
        expected = _auc([(y, p) for h, y, p in data if h == g])
        assert got[g] == pytest.approx(expected) and area[g] == pytest.approx(expected)
    flipped = {r["g"]: r["roc_auc"] for r in curves.roc_auc(df.withColumn("p", 1 - F.col("p")), by=["g"]).collect()}
    assert flipped["a"] == pytest.approx(1 - got["a"])


def test_auc_agrees_with_spark_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = random.Random(9)
    df = spark.createDataFrame([(rng.randint(0, 1), rng.random()) for _ in range(300)], "y int, p double")
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0)
    assert curves.roc_auc(df).first()["roc_auc"] == pytest.approx(evaluator.evaluate(df))


def test_tied_scores_curve(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.9), (0, 0.9), (1, 0.2), (0, 0.2), (0, 0.2)], "y int, p double")
    points = {(r["threshold"], round(r["fpr"], 6), round(r["tpr"], 6)) for r in curves.roc_curve(df).collect()}
    assert points == {(None, 0.0, 0.0), (0.9, 0.333333, 0.666667), (0.2, 1.0, 1.0)}


def test_null_targets_and_scores_do_not_count(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (0, 0.1, 0), (None, 0.5, 1), (1, None, None)], "y int, p double, prediction int")
    assert tuple(curves.roc_auc(df).first()) == (1, 1, 1.0)
    assert metrics.log_loss(df).first()[0] == pytest.approx(-math.log(0.9))
    assert sum(r["n"] for r in metrics.confusion_matrix(df, [0, 1]).collect()) == 2


def test_log_loss_clips(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.0)], "y int, p double")
    assert metrics.log_loss(df).first()[0] == pytest.approx(-math.log(1e-15) / 2)
    assert metrics.log_loss(df.withColumn("p", F.lit(None).cast("double"))).first()[0] is None


def test_one_pass_metrics_equal_the_single_ones(spark):
    from riskframe.operators.summary import all_metrics

    rng = random.Random(12)
    data = [("m", rng.randint(0, 1), round(rng.random(), 1)) for _ in range(200)]
    df = spark.createDataFrame(data, "g string, y int, probability double").withColumn(
        "prediction", (F.col("probability") > 0.6).cast("int")
    )
    hard = df.select(F.lit("hard").alias("g"), "y", F.lit(None).cast("double").alias("probability"), "prediction")
    both = df.unionByName(hard)
    binary = {r["g"]: r for r in all_metrics(both, ["g"]).collect()}
    single = {r["g"]: r for r in metrics.precision_recall_f1(both, by=["g"]).collect()}
    area = curves.roc_auc(df, probability="probability").first()["roc_auc"]
    for g in ("m", "hard"):
        for name in ("n", "accuracy", "precision", "recall", "f1"):
            assert binary[g][name] == pytest.approx(single[g][name])
    assert binary["hard"]["roc_auc"] is None and binary["m"]["roc_auc"] == pytest.approx(area)
    weighted = all_metrics(df, average="weighted").first()
    expected = metrics.weighted_prf(df).first()
    for name in ("precision", "recall", "f1"):
        assert weighted[name] == pytest.approx(expected[name])
