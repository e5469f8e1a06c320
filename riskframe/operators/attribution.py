"""Contributions of features to a score, per row and over a table."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.functions import hash_order, hash_uniform
from riskframe.operators import trees as T
from riskframe.operators.boosting import BoostedScorer
from riskframe.operators.learners import score
from riskframe.operators.ordering import exact_quantiles
from riskframe.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

GROUP_ROWS = 50_000


def feature_means(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    return {f: float(row[f]) for f in features}


def base_value(weights: Mapping[str, float], means: Mapping[str, float], bias: float) -> float:
    return bias + sum(w * means[f] for f, w in weights.items())


def _contribution(feature: str, weight: float, mean: float) -> Column:
    return F.lit(float(weight)) * (F.col(feature).cast("double") - F.lit(float(mean)))


def _pairs(weights: Mapping[str, float], means: Mapping[str, float]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(f).alias("feature"), _contribution(f, w, means[f]).alias("contribution"))
            for f, w in weights.items()
        ]
    )


def linear_attribution(
    df: DataFrame, key: str, weights: Mapping[str, float], means: Mapping[str, float]
) -> DataFrame:
    """weight * (value - mean) per row and feature: (key, feature, contribution), exact for linear scores."""
    return df.select(key, F.inline(_pairs(weights, means)))


def contribution_bars(rows: DataFrame, key: str) -> DataFrame:
    """Bars from (key, pairs) rows: each contribution with its size in percent of the row's largest one, and its sign class."""
    pairs = F.col("pairs")
    largest = F.array_max(F.transform(pairs, lambda p: F.abs(p["contribution"])))
    size = F.abs("contribution")
    return rows.select(key, largest.alias("top"), F.inline(pairs)).select(
        key,
        "feature",
        "contribution",
        F.when(F.col("top") == 0, F.lit(0.0)).otherwise(F.lit(100.0) * size / F.col("top")).alias("width"),
        F.when(F.col("contribution") > 0, F.lit("positive-value")).otherwise(F.lit("negative-value")).alias("sign_class"),
    )


def contribution_waterfall(rows: DataFrame, key: str, base: float) -> DataFrame:
    """Steps from (key, pairs) rows: from the base value to the score, largest contribution first, feature name on ties.

    A row's steps are ordered and summed inside the row; nothing is shuffled.
    """
    ordered = F.array_sort(
        F.transform(
            "pairs",
            lambda p: F.struct(
                (-F.abs(p["contribution"])).alias("k"), p["feature"].alias("feature"), p["contribution"].alias("value")
            ),
        )
    )
    start = F.lit(float(base))
    steps = F.col("steps")

    def step(item: Column, position: Column) -> Column:
        upto = F.aggregate(F.slice(steps, F.lit(1), position + 1), start, lambda acc, s: acc + s["value"])
        return F.struct(
            (position + 1).alias("step"),
            item["feature"].alias("feature"),
            item["value"].alias("contribution"),
            (upto - item["value"]).alias("from_value"),
            upto.alias("to_value"),
        )

    return rows.select(key, ordered.alias("steps")).select(key, F.inline(F.transform(steps, step)))


def contribution_summary(wide: DataFrame, features: Sequence[str], quantiles: Mapping[str, float] | None = None) -> DataFrame:
    """Per feature, from a table with a column of contributions for each: mean absolute size, range and exact quantiles."""
    quantiles = quantiles or {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    extra = [
        (F.sum(F.abs("value") * F.col("k")) / F.sum("k")).alias("mean_abs"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    ]
    found = exact_quantiles(wide, list(features), quantiles, extra)
    return found.select(F.col("column").alias("feature"), "mean_abs", "min_value", "max_value", *quantiles)


def attribution_bars(
    df: DataFrame, key: str, weights: Mapping[str, float], means: Mapping[str, float]
) -> DataFrame:
    """Contributions with their size in percent of the row's largest one, and their sign class."""
    return contribution_bars(df.select(key, _pairs(weights, means).alias("pairs")), key)


def attribution_waterfall(
    df: DataFrame, key: str, weights: Mapping[str, float], means: Mapping[str, float], bias: float = 0.0
) -> DataFrame:
    """Steps from the base value to the score, largest contribution first, feature name on ties."""
    return contribution_waterfall(df.select(key, _pairs(weights, means).alias("pairs")), key, base_value(weights, means, bias))


def attribution_summary(
    df: DataFrame, weights: Mapping[str, float], means: Mapping[str, float], quantiles: Mapping[str, float] | None = None
) -> DataFrame:
    """Per feature over the table: mean absolute contribution, range and exact quantiles."""
    wide = df.select(*[_contribution(f, w, means[f]).alias(f) for f, w in weights.items()])
    return contribution_summary(wide, list(weights), quantiles)


@dataclass(frozen=True)
class Forest:
    """A fitted tree model as node tables: base + sum of weight times tree over ``features``."""

    features: list[str]
    trees: list[T.Tree]
    weights: list[float]
    base: float

    def base_value(self) -> float:
        """Score over the training rows, from which contributions count."""
        return self.base + sum(w * t.mean() for t, w in zip(self.trees, self.weights))


def forest_of(model: PipelineModel, features: Sequence[str] | None = None) -> Forest:
    """Node tables of a boosted model (its score is in log odds) or of a decision tree or forest of Spark ML (its score is the
    probability of class 1; ``features`` are those it was assembled from)."""
    last = model.stages[-1]
    if isinstance(last, BoostedScorer):
        return Forest(*last.parts())
    spark = SparkSession.active()
    path = scratch_path(spark, "trees")
    last.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    if "nodeData" in saved.columns:
        saved = saved.select("treeID", "nodeData.*")
    else:
        saved = saved.withColumn("treeID", F.lit(0))
    names = list(features or model.stages[0].getInputCols())
    nodes: dict[int, dict[int, object]] = {}
    for r in saved.collect():  # a row per node of the model
        nodes.setdefault(r["treeID"], {})[r["id"]] = r
    trees = []
    for _, rows in sorted(nodes.items()):
        order = sorted(rows)
        place = {n: i for i, n in enumerate(order)}
        lists: dict[str, list] = {k: [] for k in T.Tree.__dataclass_fields__}
        for n in order:
            r = rows[n]
            inner = r["leftChild"] >= 0
            stats = list(r["impurityStats"])
            row = {
                "feature": r["split"]["featureIndex"] if inner else -1,
                # Spark sends equal values left, a node table sends values below the threshold there
                "threshold": float(np.nextafter(r["split"]["leftCategoriesOrThreshold"][0], np.inf)) if inner else 0.0,
                "missing_left": False,
                "left": place[r["leftChild"]] if inner else -1,
                "right": place[r["rightChild"]] if inner else -1,
                "value": 0.0 if inner else (stats[1] / sum(stats) if len(stats) > 1 and sum(stats) else 0.0),
                "cover": sum(stats),
                "gain": r["gain"] if inner else 0.0,
            }
            for k, v in row.items():
                lists[k].append(v)
        trees.append(T.tree_of(lists))
    return Forest(names, trees, [1.0 / len(trees)] * len(trees), 0.0)


def tree_contributions(df: DataFrame, key: str, forest: Forest) -> DataFrame:
    """(key, pairs) rows: the exact Shapley value of every feature for every row, over the paths of all trees.

    The node tables travel with the tasks and are bounded by the model; rows are explained batch by batch and not moved.
    """
    names = list(forest.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(1 + j).to_numpy(zero_copy_only=False).astype(float) for j in range(len(names))])
            total = np.zeros_like(x)
            for tree, weight in zip(forest.trees, forest.weights):
                total += weight * tree.contributions(x)
            cells = pa.StructArray.from_arrays([pa.array(names * len(x), pa.string()), pa.array(total.ravel(), pa.float64())], names=["feature", "contribution"])
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, cells)], names=[key, "pairs"])

    ready = df.select(key, *[F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(names)])
    kind = dict(ready.dtypes)[key]
    return ready.mapInArrow(run, f"`{key}` {kind}, pairs array<struct<feature:string,contribution:double>>")


def wide_contributions(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """A column of contributions per feature from (key, pairs) rows, as ``contribution_summary`` takes them."""
    return rows.select(*[F.col("pairs")[j]["contribution"].alias(f) for j, f in enumerate(features)])


def permuted_columns(
    df: DataFrame, key: str, features: Sequence[str], seed: int | str = 42, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Add ``shuffled_<feature>``: each value moved to the next row in hash order.

    Rows are hashed into groups of bounded size and shifted inside their group, so one window over one
    shuffle serves all features and every column keeps exactly its values.
    """
    groups = max(1, -(-df.count() // group_rows))
    placed = df.withColumn("__order", hash_order(key, seed)).withColumn(
        "__group", F.floor(hash_uniform(key, f"{seed}:group") * F.lit(float(groups)))
    )
    ordered = Window.partitionBy("__group").orderBy("__order")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    packed = F.struct(*features)
    moved = placed.withColumn("__next", F.coalesce(F.lead(packed).over(ordered), F.first(packed).over(whole)))
    return moved.select(*df.columns, *[F.col(f"__next.{f}").alias(f"shuffled_{f}") for f in features])


def permutation_importance(
    df: DataFrame,
    model: PipelineModel,
    features: Sequence[str],
    target: str,
    key: str,
    seed: int | str = 42,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Accuracy lost when one feature is shuffled: (feature, baseline, shuffled, importance).

    All shuffled copies are scored in one pass and summed per feature in one aggregate.
    """
    features = list(features)
    rows = df.where(F.col(target).isNotNull()).select(key, target, *features)
    both = permuted_columns(rows, key, features, seed, group_rows)
    variants = [
        F.struct(
            F.lit(name).alias("__variant"),
            *[(F.col(f"shuffled_{f}") if f == name else F.col(f)).alias(f) for f in features],
        )
        for name in ["", *features]
    ]
    stacked = both.select(F.col(target).alias("__truth"), F.inline(F.array(*variants)))
    scored = score(model, stacked, ["__variant", "__truth"])
    accuracy = (
        scored.groupBy("__variant").agg(F.avg((F.col("prediction") == F.col("__truth")).cast("double")).alias("acc"))
    )
    # one row per feature from here on
    return (
        accuracy.agg(
            F.max(F.when(F.col("__variant") == "", F.col("acc"))).alias("baseline"),
            F.collect_list(F.when(F.col("__variant") != "", F.struct("__variant", "acc"))).alias("rest"),
        )
        .select("baseline", F.inline("rest"))
        .select(
            F.col("__variant").alias("feature"),
            "baseline",
            F.col("acc").alias("shuffled"),
            (F.col("baseline") - F.col("acc")).alias("importance"),
        )
        .orderBy(F.col("importance").desc(), "feature")
    )
