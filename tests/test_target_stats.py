import hashlib

import pytest

from riskframe.operators import target_stats as S
from riskframe.operators.learners import fit_logistic, score


def data(n=300):
    return [(i, "hot" if i % 3 else (None if i % 5 == 0 else f"l{i % 7}"), (i * 7919) % 4, None if i % 50 == 0 else int(i * 31 % 10 < 4)) for i in range(n)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(data(), "id long, kind string, size int, y int").repartition(5)


def test_statistics_as_a_walk_in_hash_order(df):
    got = {r["id"]: r for r in S.ordered_target_stats(df, "id", ["kind", "size"], "y", weight=2.0).collect()}
    labelled = [r[3] for r in data() if r[3] is not None]
    prior, sums = sum(labelled) / len(labelled), {}
    for row in sorted(data(), key=lambda r: hashlib.md5(f"stats:42:{r[0]}".encode()).hexdigest()):
        for column, level in (("kind", row[1]), ("size", row[2])):
            total, n = sums.get((column, level), (0, 0))
            assert got[row[0]][f"{column}_stat"] == pytest.approx((total + 2 * prior) / (n + 2))
            if row[3] is not None:
                sums[column, level] = total + row[3], n + 1
    assert set(got[1].asDict()) == {"id", "kind", "size", "y", "kind_stat", "size_stat"}


def test_partitions_do_not_matter(df):
    as_dict = lambda d: {r["id"]: r["kind_stat"] for r in S.ordered_target_stats(d, "id", ["kind"], "y").collect()}
    one, many = as_dict(df.coalesce(1)), as_dict(df.repartition(11, "size"))
    assert one.keys() == many.keys() and all(one[i] == pytest.approx(many[i]) for i in one)


def test_a_row_never_sees_its_own_label(spark):
    """Levels of one row carry nothing: every row gets the prior, where the level's mean would give the label away."""
    df = spark.createDataFrame([(i, f"only{i}", i % 2) for i in range(60)], "id long, kind string, y int")
    assert {round(r["kind_stat"], 12) for r in S.ordered_target_stats(df, "id", ["kind"], "y").collect()} == {0.5}


def test_new_rows_take_the_training_sums(spark, df):
    stats = S.level_stats(df, "kind", "y")
    new = spark.createDataFrame([(1, "hot"), (2, None), (3, "unseen")], "id int, kind string")
    got = {r["id"]: r["kind_stat"] for r in S.apply_level_stats(new, stats, "kind", 0.4).collect()}
    for i, level in ((1, "hot"), (2, None)):
        y = [r[3] for r in data() if r[1] == level and r[3] is not None]
        assert got[i] == pytest.approx((sum(y) + 0.4) / (len(y) + 1))
    assert got[3] == pytest.approx(0.4)


def test_in_place_of_one_column_per_level(spark):
    rows = [(i, f"u{i % 20}", int(i % 20 < 8) if i % 10 else 1 - int(i % 20 < 8)) for i in range(2000)]
    df = S.ordered_target_stats(spark.createDataFrame(rows, "id long, user string, y int"), "id", ["user"], "y")
    scored = score(fit_logistic(df, ["user_stat"], "y"), df, ["y"])
    assert scored.where("y = prediction").count() > 0.8 * 2000
