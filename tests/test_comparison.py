from conftest import rows

from riskframe.operators import comparison as C
from riskframe.operators.metrics import to_long

# A published comparison of nine models (accuracy, area; a hard vote has no area).
TABLE = [
    ("LightGBM", 0.8675, 0.9327846130477709), ("XGBoost", 0.8625, 0.936325662641452), ("Voting (Hard)", 0.8625, None),
    ("Extra Trees", 0.86, 0.9325112022480443), ("Gradient Boosting", 0.8575, 0.9289929368876738),
    ("Voting (Soft)", 0.855, 0.941831852358168), ("Random Forest", 0.8525, 0.932230196703881),
    ("Stacking (LR)", 0.8525, 0.9403204982152351), ("Stacking (RF)", 0.835, 0.9221595655806183),
]


def _table(spark):
    return spark.createDataFrame(TABLE, "model string, accuracy double, roc_auc double").repartition(3)


def test_comparison_sorts_and_keeps_gaps(spark):
    long = to_long(_table(spark), ["accuracy", "roc_auc"], ["model"])
    assert long.count() == 17
    got = [tuple(r) for r in C.model_comparison(long, ["accuracy", "roc_auc"]).collect()]
    assert [r[0] for r in got][:3] == ["LightGBM", "Voting (Hard)", "XGBoost"]
    assert dict((r[0], r[2]) for r in got)["Voting (Hard)"] is None


def test_best_rank_top(spark):
    assert tuple(C.best_model(_table(spark)).first()) == ("LightGBM", 0.8675)
    tie = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", None)], "model string, accuracy double")
    assert C.best_model(tie).first()["model"] == "a"
    ranks = {r["model"]: r["rank"] for r in C.rank_by_metric(_table(spark), "roc_auc").collect()}
    assert ranks["Voting (Soft)"] == 1 and ranks["Stacking (LR)"] == 2 and "Voting (Hard)" not in ranks
    assert {r["rank"] for r in C.rank_by_metric(tie, "accuracy").collect()} == {1}
    assert [r["model"] for r in C.top_n_models(_table(spark), "accuracy", 2).collect()] == ["LightGBM", "Voting (Hard)"]


def test_interleaved_splits(spark):
    test = spark.createDataFrame([("b", 0.8), ("a", 0.9)], "model string, accuracy double")
    cv = spark.createDataFrame([("a", 0.7, 0.01), ("b", 0.6, 0.02)], "model string, accuracy double, std double")
    got = [(r["model"], r["split"]) for r in C.test_vs_cv(test, cv).collect()]
    assert got == [("a", "Test"), ("a", "CV"), ("b", "Test"), ("b", "CV")]


def test_text_columns(spark):
    df = spark.createDataFrame([("m", 1, "HR"), ("m", 0, "Age")], "model string, pos int, feature string")
    assert rows(C.feature_list_text(df, "pos", "feature", ["model"])) == [("m", "Age, HR", 2)]
    assert rows(C.with_slug(_table(spark), "model"), "slug")[0] == ("extra_trees",)
    assert rows(C.with_title(df, "feature"), "title") == [("Age",), ("Hr",)]
