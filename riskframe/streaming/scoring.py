"""Scoring of JSON records that arrive as files. Rows are scored one by one, so there is no state and no
watermark; the same transformer runs in batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from riskframe.operators.scoring import batch_score


def json_records(
    spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def stream_score(
    records: DataFrame,
    model: PipelineModel,
    features: Sequence[str],
    output: str,
    checkpoint: str,
    keep: Sequence[str] = (),
    positive: str = "positive",
    negative: str = "negative",
) -> StreamingQuery:
    """Score everything that has arrived and append it to a parquet folder, each record once."""
    scored = batch_score(records, model, features, keep, positive, negative)
    return (
        scored.writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
