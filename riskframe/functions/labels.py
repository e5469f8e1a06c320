"""Target encoding and decoding."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_label(column: str, mapping: Mapping[str, int]) -> Column:
    """Map text labels to integers; a label outside the mapping becomes null."""
    if not mapping:
        raise ValueError("mapping must name at least one label")
    expr = None
    for text, code in mapping.items():
        hit = F.col(column) == F.lit(text)
        expr = F.when(hit, F.lit(code)) if expr is None else expr.when(hit, F.lit(code))
    return expr.cast("int")


def decode_label(column: str, positive: str, negative: str) -> Column:
    """Text for a predicted class: 1 is the positive label, everything else the negative one."""
    return F.when(F.col(column) == 1, F.lit(positive)).otherwise(F.lit(negative))
