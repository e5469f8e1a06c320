"""Training curves kept as nested JSON: {"meta": ..., "iterations": [{"learn": [loss], ...}, ...]}."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CURVE_SCHEMA = (
    "iterations array<struct<learn: array<double>, iteration: int, passed_time: double, remaining_time: double>>"
)


def read_learning_curve(
    spark: SparkSession, path: str, schema: str = CURVE_SCHEMA, one_per_file: bool = True, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per iteration. A file holds one JSON document, or one document per line."""
    documents = spark.read.schema(schema).option("multiLine", one_per_file).json(path)
    return flatten_learning_curve(documents, keep)


def flatten_learning_curve(documents: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return documents.select(*keep, F.explode("iterations").alias("it")).select(
        *keep,
        F.col("it.iteration").alias("iter"),
        F.element_at("it.learn", 1).alias("loss"),
        F.col("it.passed_time").alias("passed_time"),
        F.col("it.remaining_time").alias("remaining_time"),
    )
