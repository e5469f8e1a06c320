import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_neighbours import SCHEMA, _points

from riskframe.operators import neighbours as N
from riskframe.operators import vector_index as V
from riskframe.session import scratch_path


def tables(spark, n=400, d=4, scale=1.0, shift=0.0):
    move = lambda rows: [(i, [x * scale + shift for x in v], y) for i, v, y in rows]
    return spark.createDataFrame(move(_points(n, d, 1)), SCHEMA), spark.createDataFrame(move(_points(50, d, 2, start=1000)), SCHEMA)


def same(one, two):
    as_dict = lambda df: {(r["id"], r["position"]): r["neighbour"] for r in df.collect()}
    return as_dict(one) == as_dict(two)


@pytest.mark.parametrize("scale,shift", [(1e-4, 0.0), (1.0, 100.0), (1e7, 0.0)])
def test_exact_search_at_any_scale(spark, monkeypatch, scale, shift):
    monkeypatch.setattr(V, "CELL_ROWS", 30)  # full cells are dealt over blocks
    train, queries = tables(spark, scale=scale, shift=shift)
    index = V.build_index(train, "id", "v", "label", scratch_path(spark, "index"))
    assert max(index.blocks.values()) > 1
    found = V.search_index(spark, index, queries, "id", "v", 3)
    assert same(found, N.nearest_neighbours(train, queries, "id", "v", "label", 3))
    assert V.recall(found, train, queries, "id", "v", "label", 3) == 1.0


def test_few_probes_find_most(spark):
    train, queries = tables(spark, 1500, 8)
    index = V.build_index(train, "id", "v", "label", scratch_path(spark, "index"))
    found = V.search_index(spark, index, queries, "id", "v", 5, probes=8)
    assert V.recall(found, train, queries, "id", "v", "label", 5) >= 0.9
    again = V.search_index(spark, V.open_index(spark, index.path), queries, "id", "v", 5, probes=8)
    assert same(found, again)


def test_the_table_is_not_moved(spark):
    """Only the queries are dealt out anew; the rows are read from their buckets."""
    train, queries = tables(spark)
    index = V.build_index(train, "id", "v", "label", scratch_path(spark, "index"))
    known = index.rows(spark)
    joined = known.join(queries.select((F.col("id") % 3).alias("cell"), (F.col("id") % 2).alias("block")), ["cell", "block"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    _, queries = tables(spark)
    empty = V.build_index(none, "id", "v", "label", scratch_path(spark, "index"))
    assert V.search_index(spark, empty, queries, "id", "v").collect() == []
    copies = spark.createDataFrame([(i, [1.0, 2.0], i % 2) for i in range(20)] + [(99, None, 1)], SCHEMA)
    index = V.build_index(copies, "id", "v", "label", scratch_path(spark, "index"))
    asked = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, None, 0)], SCHEMA)
    found = V.search_index(spark, index, asked, "id", "v", 3).collect()
    assert [(r["id"], r["neighbour"], r["distance"]) for r in found] == [(1, 0, 0.0), (1, 1, 0.0), (1, 2, 0.0)]
    assert V.vote_of(V.search_index(spark, index, asked, "id", "v", 3), "id").first()["votes"] == 2


def test_centres_cover_separate_groups():
    rng = random.Random(2)
    points = np.array([[g * 100 + rng.random(), rng.random()] for g in range(5) for _ in range(40)])
    near, gap = V.nearest_centre(points, V.fitted_centres(points, 5, 1))
    assert gap.max() < 120 and len(set(near.tolist())) == 5


def test_queries_of_a_group_are_met_in_parts(spark, monkeypatch):
    """However many queries come to a block, a task makes matrices of a part of them."""
    train, queries = tables(spark)
    index = V.build_index(train, "id", "v", "label", scratch_path(spark, "index"), cells=2)
    nearest = N._nearest

    def of_few(asked, points, keys, k, digits=None):
        if len(asked) > 7:
            raise ValueError("too many queries at once")
        return nearest(asked, points, keys, k, digits)

    monkeypatch.setattr(V, "ASK_ROWS", 7, raising=False)
    monkeypatch.setattr(V, "_nearest", of_few)
    found = V.search_index(spark, index, queries, "id", "v", 3)
    assert same(found, N.nearest_neighbours(train, queries, "id", "v", "label", 3))
