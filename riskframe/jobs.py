"""Driver-side helpers for jobs of many steps: threads, kept rows and written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from riskframe.session import scratch_path


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Hold the narrow rows many fits read; a lost executor recomputes its part from the source."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def written(df: DataFrame, label: str) -> DataFrame:
    """The table after a round trip through the shared folder: scored once, read by every later step, and
    still there when executors are lost."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_threads(spark: SparkSession, jobs: Sequence[Callable], parallelism: int) -> list:
    """Run driver-side jobs a few at a time; each submits Spark jobs of its own."""
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [w.result() for w in waiting]
