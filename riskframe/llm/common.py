"""Expressions and table helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.jobs import written

#: White space that separates words; everything else is part of a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one task handles in an ordered pass.
ROWS_PER_CELL = 50_000

__all__ = ["ROWS_PER_CELL", "SPACE", "WORD", "cells_for", "only", "running_sum", "table", "text_or_empty", "words", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text, in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; other columns of the input, whatever their names, go no further."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def cells_for(rows: int, per_cell: int = ROWS_PER_CELL) -> int:
    return max(1, -(-rows // per_cell))


def running_sum(df: DataFrame, group: list[str], cell: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the group before this one, in the order of ``cell`` and then ``order``.

    Each (group, cell) is summed by itself and gets the total of the earlier cells, so a group of any size is spread
    over its cells.  ``cell`` must not contradict ``order``.  Group columns must not be null.
    """
    keys = [*group, cell]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    starts = totals.select(*keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    return (
        df.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, keys)
        .withColumn(out, F.col(out) + F.col("_before"))
        .drop("_before")
    )
