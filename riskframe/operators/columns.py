"""Target, feature and schema operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions import decode_label as decode_expr
from riskframe.functions import encode_label

_NUMERIC = (T.NumericType, T.BooleanType)


def encode_target(df: DataFrame, target: str, mapping: Mapping[str, int]) -> DataFrame:
    """Text target to integers by ``mapping``; a numeric target is left alone, unknown text is null."""
    if not isinstance(df.schema[target].dataType, T.StringType):
        return df
    return df.withColumn(target, encode_label(target, mapping))


def split_features_target(df: DataFrame, target: str, key: str | None = None) -> tuple[list[str], str | None]:
    """Feature names in table order, and the target name or None when the table carries no truth."""
    features = [c for c in df.columns if c not in (target, key)]
    return features, target if target in df.columns else None


def missing_names(df: DataFrame, required: Sequence[str]) -> list[str]:
    present = set(df.columns)
    return [name for name in required if name not in present]


def select_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Ordered projection; stops with the names of required columns the table lacks."""
    absent = missing_names(df, [*keep, *features])
    if absent:
        raise ValueError(f"missing required features: {', '.join(absent)}")
    return df.select(*keep, *features)


def missing_features(required: DataFrame, actual: DataFrame, on: str = "feature") -> DataFrame:
    """Rows of a required-feature table with no counterpart in an actual-feature table."""
    return required.join(actual.select(on).distinct(), on, "left_anti")


def decode_label(df: DataFrame, prediction: str, positive: str, negative: str, output: str) -> DataFrame:
    return df.withColumn(output, decode_expr(prediction, positive, negative))


def drop_key(df: DataFrame, key: str) -> DataFrame:
    return df.drop(key)


def reduce_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    absent = missing_names(df, columns)
    if absent:
        raise ValueError(f"cannot drop unknown columns: {', '.join(absent)}")
    return df.drop(*columns)


def category_levels(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> dict[str, list[str]]:
    """Sorted levels of each text column, from one pass over the training rows.

    Levels become columns, so they have to fit a schema; ``limit`` stops with an error, before any level is
    fetched, when a column has more of them."""
    if not columns:
        return {}
    pairs = (
        df.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], list(columns), "column", "level")
        .where("level IS NOT NULL")
        .distinct()
    )
    if limit is not None:
        over = pairs.groupBy("column").count().where(F.col("count") > limit).orderBy("column").first()
        if over is not None:
            raise ValueError(f"{over['column']!r} has more than {limit} levels; it is not a category")
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for row in pairs.collect():
        levels[row["column"]].append(row["level"])
    return {c: sorted(found) for c, found in levels.items()}


def one_hot(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """One boolean column ``column_level`` per level but the first; null and unseen levels are all false."""
    flags = [
        F.coalesce(F.col(column) == F.lit(level), F.lit(False)).alias(f"{column}_{level}")
        for column, found in levels.items()
        for level in list(found)[1:]
    ]
    rest = [c for c in df.columns if c not in levels]
    return df.select(*rest, *flags)


def table_profile(df: DataFrame, columns: Sequence[str] | None = None, distinct: str = "exact") -> DataFrame:
    """One row per column: rows, missing, distinct, range. ``distinct`` is "exact", "approx" or "none".

    Ranges come as numbers for numeric columns and as text for the others.
    """
    if distinct not in ("exact", "approx", "none"):
        raise ValueError(f"unknown distinct mode {distinct!r}")
    columns = list(columns or df.columns)
    numeric = {c: isinstance(df.schema[c].dataType, _NUMERIC) for c in columns}
    aggs = [F.count("*").alias("n_rows")]
    for i, c in enumerate(columns):
        col = F.col(c)
        low, high = F.min(col), F.max(col)
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                (F.count("*") - F.count(col)).alias("n_missing"),
                (low.cast("double") if numeric[c] else F.lit(None).cast("double")).alias("min_number"),
                (high.cast("double") if numeric[c] else F.lit(None).cast("double")).alias("max_number"),
                (F.lit(None).cast("string") if numeric[c] else low.cast("string")).alias("min_text"),
                (F.lit(None).cast("string") if numeric[c] else high.cast("string")).alias("max_text"),
                (F.approx_count_distinct(col) if distinct == "approx" else F.lit(None).cast("bigint")).alias(
                    "n_distinct"
                ),
            ).alias(f"s{i}")
        )
    wide = df.agg(*aggs)
    profile = wide.select(
        "n_rows", F.inline(F.array(*[F.col(f"s{i}") for i in range(len(columns))]))
    )
    if distinct == "exact":
        counted = (
            df.select(*[F.col(c).cast("string").alias(c) for c in columns])
            .unpivot([], columns, "column", "value")
            .where("value IS NOT NULL")
            .groupBy("column", "value")
            .agg(F.lit(1).alias("one"))
            .groupBy("column")
            .agg(F.count("*").alias("n_seen"))
        )
        profile = (
            profile.drop("n_distinct")
            .join(counted, "column", "left")
            .withColumn("n_distinct", F.coalesce("n_seen", F.lit(0).cast("bigint")))
            .drop("n_seen")
        )
    return profile.select(
        "column", "n_rows", "n_missing", "n_distinct", "min_number", "max_number", "min_text", "max_text"
    )
