import pytest
from conftest import rows

from riskframe.operators import columns as C


def test_encode_target_text_only(spark):
    text = spark.createDataFrame([(1, "yes"), (2, "no"), (3, "other")], "id int, y string")
    assert rows(C.encode_target(text, "y", {"yes": 1, "no": 0})) == [(1, 1), (2, 0), (3, None)]
    number = spark.createDataFrame([(1, 0)], "id int, y int")
    assert C.encode_target(number, "y", {"yes": 1}) is number


def test_split_and_select(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 0)], "id int, b double, a double, y int")
    assert C.split_features_target(df, "y", "id") == (["b", "a"], "y")
    assert C.split_features_target(df.drop("y"), "y", "id") == (["b", "a"], None)
    assert C.select_features(df, ["a", "b"]).columns == ["a", "b"]
    with pytest.raises(ValueError, match="missing required features: zinc, iron"):
        C.select_features(df, ["a", "zinc", "iron"])


def test_missing_features_table(spark):
    need = spark.createDataFrame([("a",), ("b",)], "feature string")
    have = spark.createDataFrame([("b",), ("c",)], "feature string")
    assert rows(C.missing_features(need, have)) == [("a",)]


def test_decode_drop_reduce(spark):
    df = spark.createDataFrame([("k001", 1.0, 1), ("k002", 2.0, 0)], "row_key string, Na double, p int")
    labelled = C.decode_label(df, "p", "Positive", "Negative", "label")
    assert rows(labelled, "label") == [("Negative",), ("Positive",)]
    assert C.drop_key(df, "row_key").columns == ["Na", "p"]
    assert C.reduce_columns(df, ["Na"]).columns == ["row_key", "p"]
    with pytest.raises(ValueError, match="unknown"):
        C.reduce_columns(df, ["Cl"])


def test_one_hot_first_level_and_null_and_unseen(spark):
    train = spark.createDataFrame([("Nil",), ("Mild",), ("Severe",), ("Moderate",), (None,)], "MR string")
    levels = C.category_levels(train, ["MR"])
    assert levels == {"MR": ["Mild", "Moderate", "Nil", "Severe"]}
    new = spark.createDataFrame([(1, "Nil"), (2, None), (3, "Other"), (4, "Mild")], "id int, MR string")
    hot = C.one_hot(new, levels)
    assert hot.columns == ["id", "MR_Moderate", "MR_Nil", "MR_Severe"]
    assert rows(hot) == [(1, False, True, False), *[(i, False, False, False) for i in (2, 3, 4)]]


def test_level_limit(spark):
    df = spark.range(30).selectExpr("cast(id AS string) AS c", "'x' AS d")
    with pytest.raises(ValueError, match="levels"):
        C.category_levels(df, ["c", "d"], limit=10)


@pytest.mark.parametrize("mode", ["exact", "approx", "none"])
def test_profile(spark, mode):
    df = spark.createDataFrame([(1, "b", None), (2, "a", None), (2, None, None)], "n int, t string, e double")
    got = {r["column"]: r for r in C.table_profile(df, distinct=mode).collect()}
    assert (got["n"]["n_rows"], got["n"]["n_missing"], got["n"]["min_number"], got["n"]["max_number"]) == (3, 0, 1.0, 2.0)
    assert (got["t"]["n_missing"], got["t"]["min_text"], got["t"]["max_text"]) == (1, "a", "b")
    assert (got["e"]["n_missing"], got["e"]["min_number"]) == (3, None)
    if mode != "none":
        assert [got[c]["n_distinct"] for c in "nte"] == [2, 2, 0]
