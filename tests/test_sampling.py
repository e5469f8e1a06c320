import hashlib
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskframe.operators import sampling as S


def _keys(spark, counts):
    data = [(f"k{label}-{i}", label) for label, n in counts.items() for i in range(n)]
    return spark.createDataFrame(data, "id string, y int")


def test_quota_rule():
    assert S.test_quotas({1: 216, 0: 184}, 0.2) == {1: 43, 0: 37}
    assert S.test_quotas({1: 173, 0: 147}, 0.25) == {1: 43, 0: 37}
    assert sum(S.test_quotas({0: 1, 1: 1, 2: 1}, 0.34).values()) == 2
    assert S.test_quotas({}, 0.2) == {}


def test_split_400_rows(spark):
    split = S.stratified_split(_keys(spark, {1: 216, 0: 184}), "id", "y", 0.2)
    assert Counter((r["y"], r["is_test"]) for r in split.collect()) == {
        (1, True): 43, (0, True): 37, (1, False): 173, (0, False): 147
    }


def test_split_survives_repartition_and_null_target(spark):
    df = _keys(spark, {1: 50, 0: 70}).unionByName(spark.createDataFrame([("none", None)], "id string, y int"))
    once = S.stratified_split(df, "id", "y", 0.3)
    again = S.stratified_split(df.repartition(7), "id", "y", 0.3)
    assert rows(once) == rows(again)
    assert [r["is_test"] for r in once.where("y IS NULL").collect()] == [None]


def test_copies_of_a_key_stay_together(spark):
    df = _keys(spark, {1: 40, 0: 40})
    hot = spark.range(60).select(F.lit("k1-3").alias("id"), F.lit(1).alias("y"))
    split = S.stratified_kfold(df.unionByName(hot), "id", "y", 4)
    assert split.where("id = 'k1-3'").select("fold").distinct().count() == 1
    assert split.where("fold IS NULL").count() == 0


def test_random_split_counts(spark):
    df = spark.range(401)
    got = S.random_split(df, "id", 0.2)
    assert got.where("is_test").count() == 81
    expected = sorted(range(401), key=lambda i: hashlib.md5(f"split:42:{i}".encode()).hexdigest())[:81]
    assert sorted(r[0] for r in got.where("is_test").select("id").collect()) == sorted(expected)


@pytest.mark.parametrize("counts,k", [({0: 341, 1: 58}, 5), ({0: 5, 1: 2}, 5), ({0: 10, 1: 11, 2: 12}, 3), ({1: 4}, 3)])
def test_fold_sizes_differ_by_one_at_most(spark, counts, k):
    got = S.stratified_kfold(_keys(spark, counts), "id", "y", k)
    by_class = Counter((r["y"], r["fold"]) for r in got.collect())
    for label in counts:
        sizes = [by_class[(label, f)] for f in range(k)]
        assert sum(sizes) == counts[label] and max(sizes) - min(sizes) <= 1
    totals = [sum(by_class[(label, f)] for label in counts) for f in range(k)]
    assert max(totals) - min(totals) <= 1


def test_folds_are_random_and_seeded(spark):
    df = _keys(spark, {0: 200, 1: 200})
    one, two = S.stratified_kfold(df, "id", "y", 5, 1), S.stratified_kfold(df, "id", "y", 5, 2)
    assert rows(one) == rows(S.stratified_kfold(df.repartition(9), "id", "y", 5, 1))
    same = one.join(two.withColumnRenamed("fold", "other"), ["id", "y"]).where("fold = other").count()
    assert 40 < same < 130


def test_views_and_bad_k(spark):
    folded = S.stratified_kfold(_keys(spark, {0: 20, 1: 20}), "id", "y", 4)
    train, held = S.kfold_views(folded, 1)
    assert (train.count(), held.count(), train.intersect(held).count()) == (30, 10, 0)
    with pytest.raises(ValueError):
        S.stratified_kfold(folded, "id", "y", 1)


def test_fold_plan_has_no_shuffle(spark):
    folded = S.stratified_kfold(_keys(spark, {0: 20, 1: 20}), "id", "y", 4)
    assert "Exchange" not in folded._jdf.queryExecution().executedPlan().toString()


def test_sample(spark):
    df = spark.range(500)
    few = S.sample_n(df, "id", 20)
    assert few.count() == 20 and rows(few) == rows(S.sample_n(df.repartition(6), "id", 20))
    expected = sorted(range(500), key=lambda i: hashlib.md5(f"sample:42:{i}".encode()).hexdigest())[:20]
    assert sorted(r[0] for r in few.collect()) == sorted(expected)
    assert S.sample_n(df, "id", 900).count() == 500 and S.sample_n(df, "id", 0).count() == 0


@pytest.mark.parametrize("n,expected", [(5, 5), (9_999, 9_999), (10_001, 10_001), (25_000, 20_000)])
def test_sample_of_copies_and_nulls_is_exact(spark, n, expected):
    df = spark.range(30_000).select(F.when(F.col("id") < 20_000, F.floor(F.col("id") / 5)).alias("k"), "id")
    got = S.sample_n(df, "k", n)
    assert got.count() == expected and got.where("k IS NULL").count() == 0


def test_rows_without_a_key_get_no_part(spark):
    df = _keys(spark, {0: 60, 1: 60}).unionByName(spark.createDataFrame([(None, 0), (None, 1)] * 20, "id string, y int"))
    for got, name in (
        (S.stratified_kfold(df, "id", "y", 5), "fold"),
        (S.stratified_split(df, "id", "y"), "is_test"),
        (S.random_split(df, "id"), "is_test"),
    ):
        assert got.where(f"(id IS NULL) <> ({name} IS NULL)").count() == 0


def test_hold_out_is_not_a_fold(spark):
    df = _keys(spark, {0: 500, 1: 500})
    both = S.stratified_kfold(S.stratified_split(df, "id", "y", 0.2), "id", "y", 5).where("is_test")
    assert max(r["count"] for r in both.groupBy("fold").count().collect()) < 80


def test_distribution_and_weights(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (0,), (None,)], "y int")
    assert [tuple(r) for r in S.class_distribution(df, "y").collect()] == [(1, 3, 0.75), (0, 1, 0.25)]
    weights = dict(rows(S.balanced_weights(df.where("y IS NOT NULL"), "y").distinct(), "y", "weight"))
    assert weights == {1: 4 / 6, 0: 2.0}
    assert dict(rows(S.positive_weight(df.where("y IS NOT NULL"), "y", 1.5).distinct(), "y", "weight")) == {1: 1.5, 0: 1.0}


def test_many_classes_follow_the_rules_of_few(spark, monkeypatch):
    """With the driver's limit below the number of classes, splits, folds and weights are the same."""
    data = [(i, i % 11 if i % 4 else 0) for i in range(500)] + [(None, 3), (9000, None)]
    df = spark.createDataFrame(data, "id long, c int")
    few = [rows(f(df)) for f in (lambda d: S.stratified_split(d, "id", "c", 0.3), lambda d: S.stratified_kfold(d, "id", "c", 4), lambda d: S.balanced_weights(d, "c"))]
    monkeypatch.setattr(S, "MAX_CLASSES", 3)
    many = [rows(f(df)) for f in (lambda d: S.stratified_split(d, "id", "c", 0.3), lambda d: S.stratified_kfold(d, "id", "c", 4), lambda d: S.balanced_weights(d, "c"))]
    assert few[:2] == many[:2]
    assert [r[:2] for r in few[2]] == [r[:2] for r in many[2]] and all((a[2] is None) == (b[2] is None) and (a[2] is None or abs(a[2] - b[2]) < 1e-12) for a, b in zip(few[2], many[2]))
