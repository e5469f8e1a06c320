"""Run folders: every run keeps its tables beside the earlier ones."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_run(df: DataFrame, path: str, run: str = "run_id") -> None:
    """Add run folders; a column holds the run of each row."""
    df.write.mode("append").partitionBy(run).parquet(path)


def read_runs(spark: SparkSession, path: str, runs: Sequence[str] | None = None, run: str = "run_id") -> DataFrame:
    """All runs under a path, or some of them; other folders are not opened."""
    table = spark.read.parquet(path)
    return table if runs is None else table.where(F.col(run).cast("string").isin(list(runs)))


def union_runs(tables: Sequence[DataFrame], key: str, run: str) -> DataFrame:
    """Rows of several overlapping runs, one per key: the one of the earliest run, all columns compared
    on a tie. ``n_rows`` counts the rows that hold the key."""
    stacked = reduce(lambda a, b: a.unionByName(b), tables)
    rest = [c for c in stacked.columns if c not in (key, run)]
    row = F.struct(run, *rest)
    return (
        stacked.groupBy(key)
        .agg(F.min(row).alias("r"), F.count("*").alias("n_rows"))
        .select(key, "r.*", "n_rows")
    )
