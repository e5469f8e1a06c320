"""Categories as numbers: ordered target statistics.

A training row's number is the mean target of the rows of its level that come before it in hash order, drawn towards the
mean of the table, so no row ever sees its own label.  The hash order is cut into ranges and each range adds the sums of the
ranges before it: a level that holds most rows is spread over all of them.  Other tables take a level's sums over all
training rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions import hash_order, hash_uniform
from riskframe.operators.ordering import running, shuffle_buckets


def target_mean(df: DataFrame, target: str) -> float:
    """Mean target of the rows that have one; a half if none has."""
    found = df.agg(F.avg(F.col(target).cast("double"))).first()[0]
    return 0.5 if found is None else float(found)


def _smoothed(total: Column, count: Column, prior: float, weight: float) -> Column:
    return (total + F.lit(prior * weight)) / (count + F.lit(weight))


def ordered_target_stats(
    df: DataFrame, key: str, columns: Sequence[str], target: str, weight: float = 1.0, seed: int | str = 42, suffix: str = "_stat"
) -> DataFrame:
    """Add ``<column>_stat`` for every category column: (target sum of earlier rows of the level + weight * table mean) /
    (their number + weight).  ``key`` identifies a row.  A null level is a level; rows without a target count nowhere and
    get the statistic of their place all the same."""
    prior, buckets = target_mean(df, target), shuffle_buckets(df)
    out = df.withColumn("__hash", hash_order(key, f"stats:{seed}")).withColumn(
        "__range", F.floor(hash_uniform(key, f"stats:{seed}") * F.lit(float(buckets))).cast("int")
    )
    out = out.withColumn("__y", F.coalesce(F.col(target).cast("double"), F.lit(0.0))).withColumn("__one", F.col(target).isNotNull().cast("double"))
    for name in columns:
        sums = {"__sum": ("sum", "__y"), "__count": ("sum", "__one")}
        out = running(out, "__hash", "__range", sums, by=[name], inclusive=False)
        out = out.withColumn(f"{name}{suffix}", _smoothed(F.col("__sum"), F.col("__count"), prior, weight)).drop("__sum", "__count")
    return out.drop("__hash", "__range", "__y", "__one")


def level_stats(df: DataFrame, column: str, target: str) -> DataFrame:
    """(level, total, rows) of a category column over all rows with a target."""
    rows = df.where(F.col(target).isNotNull())
    return rows.groupBy(F.col(column).alias("level")).agg(F.sum(F.col(target).cast("double")).alias("total"), F.count("*").alias("rows"))


def apply_level_stats(df: DataFrame, stats: DataFrame, column: str, prior: float, weight: float = 1.0, suffix: str = "_stat") -> DataFrame:
    """Add ``<column>_stat`` from the sums of a training table; a level it has not seen gets the prior."""
    joined = df.join(stats.toDF("__level", "__total", "__rows"), df[column].eqNullSafe(F.col("__level")), "left")
    value = _smoothed(F.coalesce("__total", F.lit(0.0)), F.coalesce("__rows", F.lit(0)), prior, weight)
    return joined.withColumn(f"{column}{suffix}", value).drop("__level", "__total", "__rows")
