import random

import numpy as np

import pytest
from pyspark.sql import functions as F

from riskframe.operators import neighbours as N


def _points(n, d, seed, start=0):
    rng = random.Random(seed)
    centres = [[rng.uniform(-20, 20) for _ in range(d)] for _ in range(6)]
    return [
        (start + i, [c + rng.gauss(0, 1) for c in rng.choice(centres)], rng.randint(0, 3)) for i in range(n)
    ]


def _brute(train, queries, k):
    found = {}
    for key, v, _ in queries:
        ranked = sorted((round(sum((a - b) ** 2 for a, b in zip(v, t[1])), 6), t[0], t[2]) for t in train)[:k]
        found[key] = ranked
    return found


SCHEMA = "id bigint, v array<double>, label int"


@pytest.mark.parametrize("options", [{"broadcast_cells": 10**7}, {"block_rows": 40}, {}])
@pytest.mark.parametrize("d,k", [(3, 5), (12, 1)])
def test_neighbours_match_brute_force(spark, options, d, k):
    train, queries = _points(300, d, 1), _points(60, d, 2, start=1000)
    got = N.nearest_neighbours(
        spark.createDataFrame(train, SCHEMA), spark.createDataFrame(queries, SCHEMA), "id", "v", "label", k, digits=6, **options
    )
    mine = {}
    for r in got.collect():
        mine.setdefault(r["id"], []).append((r["distance"], r["neighbour"], r["label"]))
    assert {q: sorted(v) for q, v in mine.items()} == _brute(train, queries, k)


def test_both_sides_from_one_table(spark):
    points = spark.createDataFrame(_points(120, 4, 3), SCHEMA)
    got = N.score_knn(points.where("id >= 20"), points.where("id < 20"), "id", "v", "label", 3, broadcast_cells=0, block_rows=30)
    assert got.count() == 20 and len(got.collect()) == 20


def test_copies_ties_and_small_tables(spark):
    train = spark.createDataFrame([(i, [0.0, 0.0], i % 2) for i in range(8)], SCHEMA)
    asked = spark.createDataFrame([(100, [0.0, 0.0], 0), (101, [5.0, 5.0], 0)], SCHEMA)
    for options in ({"broadcast_cells": 10**7}, {"block_rows": 3}):
        near = N.nearest_neighbours(train, asked, "id", "v", "label", 3, **options)
        assert sorted({r["neighbour"] for r in near.collect()}) == [0, 1, 2]
        votes = {r["id"]: (r["prediction"], r["votes"]) for r in N.score_knn(train, asked, "id", "v", "label", 4, **options).collect()}
        assert votes == {100: (0, 2), 101: (0, 2)}
        all_of_them = N.nearest_neighbours(train, asked, "id", "v", "label", 50, **options)
        assert all_of_them.groupBy("id").count().where("count <> 8").count() == 0
    assert N.score_knn(train.where("id < 0"), asked, "id", "v", "label").count() == 0


def test_blocks_stay_small(spark):
    """Most points in one place: their cell is cut into blocks on both sides."""
    train = spark.range(2000).select("id", F.array(F.rand(1) * 1e-3, F.rand(2) * 1e-3).alias("v"), F.lit(1).alias("label"))
    asked = spark.range(5000, 5300).select("id", F.array(F.lit(0.0), F.lit(0.0)).alias("v"), F.lit(1).alias("label"))
    got = N.nearest_neighbours(train, asked, "id", "v", "label", 2, block_rows=100, broadcast_cells=0)
    assert got.count() == 600
    assert got.agg(F.countDistinct("id")).first()[0] == 300


@pytest.mark.parametrize("scale,offset", [(1e-4, 0.0), (1.0, 0.0), (1.0, 1e7)])
@pytest.mark.parametrize("options", [{}, {"broadcast_cells": 10**7}])
def test_exact_at_any_scale(spark, scale, offset, options):
    rng = np.random.default_rng(3)
    points = rng.random((300, 3)) * scale + offset
    asked = rng.random((30, 3)) * scale + offset
    train = spark.createDataFrame([(i, p.tolist(), 0) for i, p in enumerate(points)], "id int, v array<double>, label int")
    queries = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(asked)], "id int, v array<double>")
    got: dict = {}
    for r in N.nearest_neighbours(train, queries, "id", "v", "label", 4, block_rows=50, **options).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    for i, q in enumerate(asked):
        assert got[i] == set(np.argsort(((points - q) ** 2).sum(axis=1), kind="stable")[:4].tolist())


def test_small_training_blocks_do_not_cut_the_queries_as_small(spark, monkeypatch):
    """A cell's rows are copied once for each block of queries: blocks of few training rows must not multiply them."""
    train = spark.createDataFrame(_points(300, 3, 1), SCHEMA)
    queries = spark.createDataFrame([(1000 + i, [0.5, 0.5, 0.5], 0) for i in range(200)], SCHEMA)
    want = {(r["id"], r["position"]): r["neighbour"] for r in N.nearest_neighbours(train, queries, "id", "v", "label", 3).collect()}
    nearest = N._nearest

    def of_all(asked, *others):
        if len(asked) != 200:
            raise ValueError(f"{len(asked)} of 200 queries in a block")
        return nearest(asked, *others)

    monkeypatch.setattr(N, "_nearest", of_all)
    found = N.nearest_neighbours(train, queries, "id", "v", "label", 3, block_rows=10)
    assert {(r["id"], r["position"]): r["neighbour"] for r in found.collect()} == want
