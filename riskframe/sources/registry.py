"""Model registry: one row per registered model, and the info files of model folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INFO_SCHEMA = (
    "model_type string, accuracy string, feature_count int, deployment_timestamp string, "
    "model_file string, features array<string>"
)


def model_row(
    spark: SparkSession, model_type: str, accuracy: float, features: Sequence[str], timestamp: str, model_file: str
) -> DataFrame:
    """Registry row of a run. The accuracy is the measured one."""
    row = (model_type, f"{accuracy:.4f}", len(features), timestamp, model_file, list(features))
    return spark.createDataFrame([row], INFO_SCHEMA)


def register_model(rows: DataFrame, path: str) -> None:
    """Append rows to the registry table; other runs may append at the same time."""
    rows.write.mode("append").parquet(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INFO_SCHEMA).parquet(path)


def write_model_info(rows: DataFrame, path: str, folder: str = "package") -> None:
    """One info file per model folder; ``folder`` names the column that names the folders."""
    rows.repartition(folder).write.partitionBy(folder).json(path)


def read_model_info(spark: SparkSession, path: str, schema: str = INFO_SCHEMA) -> DataFrame:
    """Info files of all model folders under a path as one table. A file holds one JSON object, on one
    line or many."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def explode_features(info: DataFrame, keep: Sequence[str]) -> DataFrame:
    return info.select(*keep, F.posexplode("features").alias("position", "feature"))


def latest_models(info: DataFrame, by: str = "model_type") -> DataFrame:
    """Newest info row per model type; the file name decides between equal times."""
    columns = [c for c in info.columns if c != by]
    newest = F.max_by(F.struct(*columns), F.struct("deployment_timestamp", "model_file"))
    return info.groupBy(by).agg(newest.alias("m")).select(by, "m.*")


def compare_features(before: DataFrame, after: DataFrame, feature: str = "feature", by: Sequence[str] = ()) -> DataFrame:
    """Features of two versions side by side: kept, added or removed."""
    keys = [*by, feature]
    left = before.select(*keys).distinct().withColumn("in_before", F.lit(True))
    right = after.select(*keys).distinct().withColumn("in_after", F.lit(True))
    joined = left.join(right, keys, "full_outer")
    status = (
        F.when(F.col("in_before").isNull(), F.lit("added"))
        .when(F.col("in_after").isNull(), F.lit("removed"))
        .otherwise(F.lit("kept"))
    )
    return joined.select(*keys, status.alias("status"))
