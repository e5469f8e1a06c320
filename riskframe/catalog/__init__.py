"""Named queries over the test tables, and the SQL that checks them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskframe.catalog import columns, comparison, importance, learners, metrics, monitoring, sampling, search, sources

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (sources, columns, sampling, importance, learners, metrics, comparison, search, monitoring)


def all_queries() -> dict[str, Query]:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
