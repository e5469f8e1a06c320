import hashlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskframe import functions as X


def test_hash_order_and_uniform(spark):
    df = spark.createDataFrame([(1,), (20,)], "id bigint")
    found = dict(rows(df, "id", X.hash_order("id", 42)))
    assert found[20] == hashlib.md5(b"42:20").hexdigest()
    u = dict(rows(df, "id", X.hash_uniform("id", "s")))
    assert u[1] == int(hashlib.md5(b"s:1").hexdigest()[:8], 16) / 2**32
    assert all(0 <= v < 1 for v in u.values())


def test_labels(spark):
    df = spark.createDataFrame([("yes",), ("no",), ("unknown",), (None,)], "t string")
    found = [r[0] for r in df.select(X.encode_label("t", {"yes": 1, "no": 0})).collect()]
    assert found == [1, 0, None, None]
    codes = spark.createDataFrame([(1,), (0,), (2,)], "p int")
    assert [r[0] for r in codes.select(X.decode_label("p", "yes", "no")).collect()] == ["yes", "no", "no"]
    with pytest.raises(ValueError):
        X.encode_label("t", {})


def test_text_forms(spark):
    df = spark.createDataFrame([("Voting (Soft)", "roc_auc", 0.87, 0.0444)], "n string, m string, a double, s double")
    got = df.select(X.name_slug("n"), X.metric_title("m"), X.mean_pm_std("a", "s"), X.percent_text(F.col("a"))).first()
    assert tuple(got) == ("voting_(soft)", "Roc_auc", "0.8700 ± 0.0444", "87.00%")


def test_join_in_order_keeps_positions(spark):
    df = spark.createDataFrame([(2, "c"), (0, "a"), (1, "b"), (10, "d")], "pos int, name string")
    assert df.agg(X.join_in_order("pos", "name")).first()[0] == "a, b, c, d"


def test_run_stamp(spark):
    df = spark.sql("SELECT timestamp'2025-04-11 21:55:56' AS t")
    assert df.select(X.run_stamp("t")).first()[0] == "20250411_215556"


def test_numeric(spark):
    df = spark.createDataFrame([(1, 0), (1, 4)], "a int, b int")
    assert [r[0] for r in df.select(X.safe_ratio(F.col("a"), F.col("b"))).collect()] == [0.0, 0.25]
    assert df.select(X.dot(["a", "b"], [2.0, 0.5], 1.0)).collect()[1][0] == 5.0
    with pytest.raises(ValueError):
        X.dot(["a"], [1.0, 2.0])
