"""Header CSV and TSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_csv_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Header CSV; a schema spares the extra pass that inference costs. Blank cells are null."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_tsv_log(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Tab-separated log with a header line."""
    reader = spark.read.option("header", True).option("sep", "\t")
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def write_csv_table(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """Header CSV, one file per partition, no row numbers."""
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)
