"""Feature importance tables, votes of several selectors, and the selectors themselves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.session import scratch_path


def vector_names(df: DataFrame, column: str = "features") -> list[str]:
    """Names of a vector's elements, from the attributes its assembler left in the schema."""
    attributes = df.schema[column].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a["name"]) for group in attributes.values() for a in group)
    return [name for _, name in slots]


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    """Add the feature vector; a null feature stops the job instead of dropping the row."""
    return VectorAssembler(inputCols=list(features), outputCol=output).transform(df)


def scaled(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    """Add the vector of standardised features."""
    with_raw = assemble(df, features, "__raw")
    scaler = StandardScaler(inputCol="__raw", outputCol=output, withMean=True, withStd=True)
    return scaler.fit(with_raw).transform(with_raw).drop("__raw")


def importance_table(spark: SparkSession, model: Model, features: Sequence[str]) -> DataFrame:
    """(feature, importance) of a fitted tree model, most important first."""
    values = [float(v) for v in model.featureImportances.toArray()]
    table = spark.createDataFrame(list(zip(features, values)), "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature")


def split_count_importance(spark: SparkSession, model: Model, features: Sequence[str]) -> DataFrame:
    """How many splits use each feature, counted over the saved trees; unused features count 0."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    node = "nodeData" if "nodeData" in nodes.columns else None
    index = F.col("nodeData.split.featureIndex" if node else "split.featureIndex")
    used = nodes.where(index >= 0).groupBy(index.alias("position")).agg(F.count("*").alias("importance"))
    names = spark.createDataFrame(list(enumerate(features)), "position int, feature string")
    return (
        names.join(used, "position", "left")
        .select("feature", F.coalesce("importance", F.lit(0).cast("bigint")).alias("importance"))
        .orderBy(F.col("importance").desc(), "feature")
    )


def combine_importance(
    left: DataFrame, right: DataFrame, left_value: str, right_value: str, on: str = "feature", mode: str = "normalized"
) -> DataFrame:
    """Average two importances per feature. ``normalized`` brings both to sum 1 first; ``raw`` averages
    them as they are, which lets the larger scale decide."""
    if mode not in ("raw", "normalized"):
        raise ValueError(f"unknown mode {mode!r}")
    a, b = F.col(left_value).cast("double"), F.col(right_value).cast("double")
    joined = left.select(on, left_value).join(right.select(on, right_value), on)
    if mode == "normalized":
        table = Window.partitionBy()  # one row per feature, sorted in one place anyway
        a, b = a / F.sum(a).over(table), b / F.sum(b).over(table)
    average = ((a + b) / F.lit(2.0)).alias("average_importance")
    return joined.select(on, left_value, right_value, average).orderBy(F.col("average_importance").desc(), on)


def top_k_features(df: DataFrame, k: int, value: str = "average_importance", on: str = "feature") -> DataFrame:
    return df.orderBy(F.col(value).desc_nulls_last(), on).limit(k)


def method_votes(votes: DataFrame, methods: Sequence[str], feature: str = "feature") -> DataFrame:
    """One boolean column per selection method and their number per feature."""
    wide = votes.groupBy(feature).pivot("method", list(methods)).agg(F.count(F.lit(1)))
    flags = [F.coalesce(F.col(f"`{m}`") > 0, F.lit(False)).alias(m) for m in methods]
    chosen = wide.select(feature, *flags)
    count = reduce(lambda x, y: x + y, [F.col(f"`{m}`").cast("int") for m in methods])
    return chosen.withColumn("methods_count", count)


def vote_threshold(votes: DataFrame, k: int, feature: str = "feature") -> DataFrame:
    """Features chosen by at least k methods."""
    counted = votes.select("method", feature).distinct().groupBy(feature).agg(F.count("*").alias("n_methods"))
    return counted.where(F.col("n_methods") >= k)


def vote_intersection(lists: Sequence[DataFrame]) -> DataFrame:
    """Features on every list: as a chain of INTERSECT, but one shuffle whatever the number of lists, and a
    feature repeated many times is combined before it."""
    columns = lists[0].columns
    marked = [df.select(*columns, F.lit(1 << i).cast("bigint").alias("__on")) for i, df in enumerate(lists)]
    stacked = reduce(lambda x, y: x.unionByName(y), marked)
    full = (1 << len(lists)) - 1
    return stacked.groupBy(*columns).agg(F.bit_or("__on").alias("__on")).where(F.col("__on") == full).select(*columns)


def _weights_table(spark: SparkSession, features: Sequence[str], weights: Sequence[float]) -> DataFrame:
    rows = [(f, float(w)) for f, w in zip(features, weights)]
    return spark.createDataFrame(rows, "feature string, weight double")


def select_l1(df: DataFrame, features: Sequence[str], target: str, alpha: float = 0.01) -> DataFrame:
    """Features with a non-zero L1 weight on the standardised table: (feature, weight, chosen)."""
    data = scaled(df.where(F.col(target).isNotNull()), features)
    learner = LinearRegression(
        featuresCol="features", labelCol=target, elasticNetParam=1.0, regParam=alpha, standardization=False
    )
    weights = learner.fit(data.select("features", F.col(target).cast("double").alias(target))).coefficients
    table = _weights_table(df.sparkSession, features, weights)
    return table.withColumn("chosen", F.col("weight") != 0).orderBy(F.abs("weight").desc(), "feature")


def select_rf(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    k: int | None = None,
    cut: float | None = None,
    trees: int = 20,
    depth: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Features of a forest above an importance cut, or its k most important ones."""
    if (k is None) == (cut is None):
        raise ValueError("give either k or cut")
    data = assemble(df.where(F.col(target).isNotNull()), features)
    forest = RandomForestClassifier(
        featuresCol="features", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed
    ).fit(data.select("features", target))
    table = importance_table(df.sparkSession, forest, features)
    return top_k_features(table, k, "importance") if k is not None else table.where(F.col("importance") > cut)


def select_lr(df: DataFrame, features: Sequence[str], target: str, k: int, c: float = 1.0) -> DataFrame:
    """k features with the largest absolute weight of a logistic regression on standardised features."""
    rows = df.where(F.col(target).isNotNull())
    data = scaled(rows, features)
    learner = LogisticRegression(
        featuresCol="features", labelCol=target, regParam=1.0 / (c * max(rows.count(), 1)), standardization=False
    )
    weights = learner.fit(data.select("features", target)).coefficients
    table = _weights_table(df.sparkSession, features, weights)
    return table.orderBy(F.abs("weight").desc(), "feature").limit(k)


def select_domain(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Columns of a fixed expert list, in its order."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"missing required features: {', '.join(absent)}")
    return df.select(*keep, *names)


def votes_table(spark: SparkSession, chosen: Mapping[str, Sequence[str]]) -> DataFrame:
    """(method, feature) rows from the feature list of each method."""
    rows = [(method, feature) for method, features in chosen.items() for feature in features]
    return spark.createDataFrame(rows, "method string, feature string")
