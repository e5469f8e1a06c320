"""Repeatable randomness: every draw is a hash of a seed and a key.

``rand(seed)`` depends on how rows are laid out in partitions, so a lost executor or another
cluster size changes the draw. A hash of the key does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(key: str | Column, seed: int | str) -> Column:
    """Hex text whose ascending order is a random order of the keys."""
    column = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), column.cast("string")))


def hash_uniform(key: str | Column, seed: int | str) -> Column:
    """Number in [0, 1) drawn from the first 32 bits of the hash."""
    head = F.substring(hash_order(key, seed), 1, 8)
    return F.conv(head, 16, 10).cast("long").cast("double") / F.lit(float(2**32))
