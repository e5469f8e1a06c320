"""Text forms used in reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_slug(column: str) -> Column:
    """File-safe model name: blanks to underscores, lower case."""
    return F.lower(F.translate(F.col(column), " ", "_"))


def metric_title(column: str) -> Column:
    """First letter upper, all others lower, also after blanks and underscores."""
    text = F.col(column)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.expr(f"substring(`{column}`, 2)")))


def mean_pm_std(mean: str, std: str) -> Column:
    return F.format_string("%.4f ± %.4f", F.col(mean), F.col(std))


def percent_text(value: Column) -> Column:
    """Share as a percentage with two decimals."""
    return F.format_string("%.2f%%", value * F.lit(100.0))


def join_in_order(position: str, name: str, separator: str = ", ") -> Column:
    """Aggregate: names of a group joined by ascending position."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(position), F.col(name))))
    return F.array_join(F.transform(pairs, lambda p: p[name]), separator)


def run_stamp(column: str) -> Column:
    """Directory suffix of a run time."""
    return F.date_format(F.col(column), "yyyyMMdd_HHmmss")
