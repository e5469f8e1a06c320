import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskframe.operators import ordering as O


def _table(spark, n=500, seed=1):
    rng = random.Random(seed)
    data = [(rng.choice(["a", "b", None]), i, float(rng.randint(0, 60)), rng.randint(-5, 5)) for i in range(n)]
    return data, spark.createDataFrame(data, "g string, id bigint, x double, v bigint")


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("buckets", [1, 7])
def test_running_equals_plain_loop(spark, descending, inclusive, buckets):
    data, df = _table(spark)
    placed = O.range_buckets(df, ["id"], buckets).transform(df.repartition(5))
    got = O.running(
        placed,
        "id",
        O.bucket_name("id"),
        {"s": ("sum", "v"), "m": ("max", "v"), "l": ("min", "v")},
        by=["g"],
        descending=descending,
        inclusive=inclusive,
        whole={"total": ("sum", "v")},
    )
    expected = []
    for g in ("a", "b", None):
        seen = []
        group = sorted((r for r in data if r[0] == g), key=lambda r: r[1], reverse=descending)
        total = sum(r[3] for r in group)
        for r in group:
            now = [*seen, r[3]] if inclusive else list(seen)
            expected.append((g, r[1], sum(now), max(now, default=None), min(now, default=None), total))
            seen.append(r[3])
    assert rows(got, "g", "id", "s", "m", "l", "total") == sorted(expected, key=repr)


def test_running_balances_a_group_holding_most_rows(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 10 == 0, "small").otherwise("hot").alias("g"), "id", F.lit(1).alias("one"))
    placed = O.range_buckets(df, ["id"], 16).transform(df)
    sizes = placed.groupBy("g", O.bucket_name("id")).count().agg(F.max("count")).first()[0]
    assert sizes < 600
    last = O.running(placed, "id", O.bucket_name("id"), {"n": ("sum", "one")}, by=["g"]).groupBy("g").agg(F.max("n"))
    assert dict(rows(last)) == {"hot": 3600, "small": 400}


def test_with_previous_and_numbers(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 7, 6.0), ("a", 3, 9.0), ("b", 2, 1.0)], "g string, i bigint, v double")
    assert rows(O.with_previous(df, "i", ["v"], by=["g"]), "g", "i", "prev_v") == [
        ("a", 1, None), ("a", 3, 5.0), ("a", 7, 9.0), ("b", 2, None)
    ]
    big = spark.range(0, 3000, 3)
    numbered = rows(O.number_rows(big, "id"))
    assert len(numbered) == 1000 and all(number == i // 3 + 1 for i, number in numbered)


def test_exact_quantiles_are_nearest_rank(spark):
    data, df = _table(spark, 333)
    got = O.exact_quantiles(df, ["x", "v"], {"low": 0.1, "half": 0.5, "top": 1.0})
    for row in got.collect():
        values = sorted(float(r[2] if row["column"] == "x" else r[3]) for r in data)
        for name, q in (("low", 0.1), ("half", 0.5), ("top", 1.0)):
            assert row[name] == values[-(-int(q * 1000) * len(values) // 1000) - 1]
        assert row["n"] == 333


def test_hash_cut_is_the_row_at_the_rank(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).cast("int").alias("c"))
    counts = O.count_hash_cells(df, "id", "c", 42)
    cuts = O.hash_cuts(df, "id", "c", 42, counts, {0: [1, 500, 1000], 2: [77]})
    import hashlib

    for (label, rank), value in cuts.items():
        ordered = sorted(hashlib.md5(f"42:{i}".encode()).hexdigest() for i in range(label, 3000, 3))
        assert ordered[rank - 1] == value
    assert len(cuts) == 4


def test_too_many_classes_are_refused(spark):
    df = spark.range(400).select("id", F.col("id").alias("c"))
    with pytest.raises(ValueError, match="classes"):
        O.count_classes(df, "c")
    with pytest.raises(ValueError, match="classes"):
        O.count_hash_cells(df, "id", "c", 1)


def test_full_cells_are_counted_by_longer_prefixes(spark, monkeypatch):
    """The cut is the same however few rows a cell may have; each refinement looks at the cells of the cuts only."""
    df = spark.range(5000).select("id", (F.col("id") % 2).cast("int").alias("c"))
    counts = O.count_hash_cells(df, "id", "c", 42)
    wanted = {0: [1, 777, 2500], 1: [1200]}
    want = O.hash_cuts(df, "id", "c", 42, counts, wanted)
    seen = []
    below = O._cells_below
    monkeypatch.setattr(O, "CELL_ROWS", 0)
    monkeypatch.setattr(O, "_cells_below", lambda *a: seen.append(len(a[4])) or below(*a))
    assert O.hash_cuts(df, "id", "c", 42, counts, wanted) == want and len(want) == 4
    assert seen and max(seen) <= 4


def test_parts_of_any_number_of_classes(spark, monkeypatch):
    """Parts by tables are those of rows dealt in hash order, in cells of any size; rows without key or class get none."""
    import hashlib

    monkeypatch.setattr(O, "CELL_ROWS", 4)
    data = [(i, "hot" if i % 3 == 0 else f"c{i % 97}") for i in range(900)] + [(None, "c1"), (5000, None)]
    df = spark.createDataFrame(data, "id long, c string").repartition(5)
    by: dict = {}
    for i, c in data:
        if i is not None and c is not None:
            by.setdefault(c, []).append(i)
    parts = {c: [len(ids) // 2, 0, len(ids) - len(ids) // 2 - 1, 1] for c, ids in by.items()}
    sizes = spark.createDataFrame([(c, len(by[c]), p) for c, p in parts.items()], "c string, n long, parts array<long>")
    got = {(r["id"], r["c"]): r["__part"] for r in O.class_parts(df, "id", "c", 7, sizes).collect()}
    assert got.pop((None, "c1")) is None and got.pop((5000, None)) is None
    want = {}
    for c, ids in by.items():
        ordered = sorted(ids, key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())
        places = [p for p, n in enumerate(parts[c]) for _ in range(n)]
        want.update({(i, c): p for i, p in zip(ordered, places)})
    assert got == want


def test_sum_before(spark):
    data = [(f"k{i * 37 % 101:03d}", i % 7) for i in range(101)]
    df = spark.createDataFrame(data, "k string, n long").repartition(6)
    total = 0
    want = {}
    for k, n in sorted(data):
        want[k] = total
        total += n
    assert {r["k"]: r["before"] for r in O.sum_before(df, ["k"], "n", "before").collect()} == want
