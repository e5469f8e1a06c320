"""Distribution change between two versions of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.ordering import bucket_name, range_buckets, running, with_previous

THRESHOLD = 0.1


def _stack(base: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    flag_a = [F.lit(1).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")]
    flag_b = [F.lit(0).cast("bigint").alias("a"), F.lit(1).cast("bigint").alias("b")]
    return base.select(*columns, *flag_a).unionByName(current.select(*columns, *flag_b))


def ks_statistic(base: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per numeric column: (column, statistic)."""
    columns = list(columns)
    both = _stack(base, current, columns)
    placed = range_buckets(both, columns).transform(both)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.col(c).cast("double").alias("value"), F.col(bucket_name(c)).alias("bucket")
            )
            for c in columns
        ]
    )
    rows = placed.select("a", "b", F.inline(cells)).where("value IS NOT NULL")
    counted = rows.groupBy("column", "bucket", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    shares = running(
        counted,
        "value",
        "bucket",
        {"cum_a": ("sum", "a"), "cum_b": ("sum", "b")},
        by=["column"],
        whole={"all_a": ("sum", "a"), "all_b": ("sum", "b")},
        source=rows,
    )
    gap = F.abs(F.try_divide(F.col("cum_a"), F.col("all_a")) - F.try_divide(F.col("cum_b"), F.col("all_b")))
    return shares.groupBy("column").agg(F.max(gap).alias("statistic"))


def _level_shares(base: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    both = _stack(base, current, columns)
    levels = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns]
    )
    counted = (
        both.select("a", "b", F.inline(levels))
        .where("level IS NOT NULL")
        .groupBy("column", "level")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )
    sizes = counted.groupBy("column").agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    return counted.join(F.broadcast(sizes), "column").select(  # one row per column of the schema
        "column",
        "level",
        F.coalesce(F.try_divide(F.col("a"), F.col("all_a")), F.lit(0.0)).alias("base_share"),
        F.coalesce(F.try_divide(F.col("b"), F.col("all_b")), F.lit(0.0)).alias("current_share"),
    )


def category_drift(base: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of every level in both tables and its change; a level absent from one side has share 0."""
    shares = _level_shares(base, current, columns)
    return shares.withColumn("change", F.col("current_share") - F.col("base_share"))


def total_variation(base: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Half the summed absolute share change per category column: (column, statistic)."""
    gap = F.abs(F.col("current_share") - F.col("base_share"))
    return (
        _level_shares(base, current, columns).groupBy("column").agg((F.sum(gap) / F.lit(2.0)).alias("statistic"))
    )


def population_stability(
    base: DataFrame, current: DataFrame, columns: Sequence[str], floor: float = 1e-6
) -> DataFrame:
    """Population stability index per category column, shares floored to keep the logarithm finite."""
    a, b = F.greatest(F.col("base_share"), F.lit(floor)), F.greatest(F.col("current_share"), F.lit(floor))
    return (
        _level_shares(base, current, columns).groupBy("column").agg(F.sum((b - a) * F.ln(b / a)).alias("statistic"))
    )


def drift_report(
    base: DataFrame,
    current: DataFrame,
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per column: distance between both tables and whether it passes the threshold."""
    if not numeric and not categorical:
        raise ValueError("name at least one column")
    parts = []
    if numeric:
        parts.append(ks_statistic(base, current, numeric).withColumn("kind", F.lit("numeric")))
    if categorical:
        parts.append(total_variation(base, current, categorical).withColumn("kind", F.lit("category")))
    table = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return table.select("column", "kind", "statistic", (F.col("statistic") > threshold).alias("drifted"))


def drift_flag(report: DataFrame) -> DataFrame:
    """One row: does any column drift?"""
    return report.agg(F.coalesce(F.bool_or("drifted"), F.lit(False)).alias("drift_detected"))


def training_progress(loss: DataFrame, time: DataFrame, by: Sequence[str] = (), iteration: str = "iter") -> DataFrame:
    """Join loss and time logs on iteration; add the time spent and the loss dropped since the one before."""
    both = loss.join(time, [*by, iteration])
    steps = with_previous(both, iteration, ["loss", "passed"], by=by)
    return steps.select(
        *by,
        iteration,
        "loss",
        "passed",
        "remaining",
        (F.col("passed") - F.coalesce("prev_passed", F.lit(0))).alias("step_time"),
        (F.col("prev_loss") - F.col("loss")).alias("loss_drop"),
    )
