"""Splits, folds, samples and class weights.

Draws follow the hash order of a row key. Class sizes are counted, target ranks are turned into hash
cuts (two narrow passes), and rows are then labelled by comparing their hash with literals: no shuffle,
no sort and no join over the wide table. The key must identify a row; copies of a key stay together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions import hash_order
from riskframe.operators.ordering import MAX_CLASSES, class_parts, class_totals, count_classes, count_hash_cells, hash_cuts, sum_before

HASH = "__hash"


def ceil_share(total: int, share: float) -> int:
    """Rows in a share, rounded up, without a float step above a whole number (0.2 of 400 is 80)."""
    exact = round(total * share, 9)
    return int(exact) if exact == int(exact) else int(exact) + 1


def test_quotas(totals: Mapping[object, int], share: float) -> dict:
    """Test rows per class: floor of the share, left-over rows to the largest remainders."""
    n = sum(totals.values())
    size = ceil_share(n, share)
    quotas = {c: size * count // n for c, count in totals.items()} if n else {}
    rest = size - sum(quotas.values())
    by_remainder = sorted(totals, key=lambda c: (-((size * totals[c]) % n), c))
    for label in by_remainder[:rest]:
        quotas[label] += 1
    return quotas


def fold_sizes(totals: Mapping[object, int], k: int) -> dict:
    """Rows per class and fold. Dealing all rows class after class round the folds keeps every size,
    per class and in total, within one of the others."""
    sizes, offset = {}, 0
    for label in sorted(totals):
        n = totals[label]
        sizes[label] = [n // k + (1 if (fold - offset) % k < n % k else 0) for fold in range(k)]
        offset += n
    return sizes


def _assign(
    df: DataFrame, key: str, target: str | None, seed: int | str, sizes: Mapping[object, Sequence[int]], counts
) -> tuple[DataFrame, Column]:
    """The table with its hash column, and the part number of a row: its class is cut, in hash order,
    into parts of the given sizes."""
    ranks = {}
    for label, parts in sizes.items():
        ends, total = [], 0
        for part in parts[:-1]:
            total += part
            ends.append(total)
        ranks[label] = ends
    cuts = hash_cuts(df, key, target, seed, counts, ranks)
    hashed = df.withColumn(HASH, hash_order(key, seed))
    result = None
    for label, ends in ranks.items():
        cases = [
            f"WHEN {HASH} <= '{cuts[(label, end)]}' THEN {part}"
            for part, end in enumerate(ends)
            if sizes[label][part]
        ]
        last = len(sizes[label]) - 1
        value = F.expr(f"CASE {' '.join(cases)} ELSE {last} END") if cases else F.lit(last)
        if target is None:
            result = value
            break
        hit = F.col(target) == F.lit(label)
        result = F.when(hit, value) if result is None else result.when(hit, value)
    # a row without a key has no place in the order and gets no part
    return hashed, F.lit(None).cast("int") if result is None else F.when(F.col(HASH).isNotNull(), result)


def many_classes(df: DataFrame, target: str) -> bool:
    """Whether the classes are too many for the driver; their counts and cuts are then tables."""
    return df.where(F.col(target).isNotNull()).select(target).distinct().limit(MAX_CLASSES + 1).count() > MAX_CLASSES


def _quota_table(totals: DataFrame, share: float) -> DataFrame:
    """(c, n, parts): the quotas of ``test_quotas`` for a table of class totals."""
    n = totals.agg(F.sum("n")).first()[0] or 0
    size = ceil_share(n, share)
    exact = F.col("n").cast("decimal(38,0)") * F.lit(size).cast("decimal(19,0)")  # beyond 2^63 for large tables
    rest = (exact % F.lit(max(n, 1)).cast("decimal(19,0)")).cast("decimal(38,0)")
    base = totals.select("c", "n", ((exact - rest) / F.lit(max(n, 1))).cast("long").alias("base"), (-rest).cast("long").alias("less"))
    left = size - (base.agg(F.sum("base")).first()[0] or 0)
    placed = sum_before(base.withColumn("one", F.lit(1).cast("long")), ["less", "c"], "one", "place")
    quota = F.col("base") + (F.col("place") < left).cast("long")
    return placed.select("c", "n", F.array(quota, F.col("n") - quota).alias("parts"))


def _fold_table(totals: DataFrame, k: int) -> DataFrame:
    """(c, n, parts): the sizes of ``fold_sizes`` for a table of class totals."""
    placed = sum_before(totals, ["c"], "n", "offset")
    size = lambda f: F.floor(F.col("n") / k).cast("long") + (F.pmod(F.lit(f) - F.col("offset"), F.lit(k)) < F.col("n") % k).cast("long")
    return placed.select("c", "n", F.array(*[size(f) for f in range(k)]).alias("parts"))


def stratified_split(
    df: DataFrame, key: str, target: str, share: float = 0.2, seed: int | str = 42, output: str = "is_test"
) -> DataFrame:
    """Mark a hold-out that keeps class shares. Rows without a key or a class get null.

    The draw has a seed of its own, so a hold-out is never one of the folds drawn with the same number."""
    seed = f"split:{seed}"
    if many_classes(df, target):
        return class_parts(df, key, target, seed, _quota_table(class_totals(df, key, target), share)).withColumn(output, F.col("__part") == 0).drop("__part")
    counts = count_hash_cells(df, key, target, seed)
    quotas = test_quotas(counts.totals, share)
    sizes = {c: [quotas[c], counts.totals[c] - quotas[c]] for c in counts.labels()}
    hashed, part = _assign(df, key, target, seed, sizes, counts)
    return hashed.withColumn(output, part == 0).drop(HASH)


def random_split(df: DataFrame, key: str, share: float = 0.2, seed: int | str = 42, output: str = "is_test") -> DataFrame:
    """Mark a hold-out of ceil(share * n) rows, whatever their class. Rows without a key get null."""
    seed = f"split:{seed}"
    counts = count_hash_cells(df, key, None, seed)
    n = sum(counts.totals.values())
    size = ceil_share(n, share)
    hashed, part = _assign(df, key, None, seed, {0: [size, n - size]}, counts)
    return hashed.withColumn(output, part == 0).drop(HASH)


def stratified_kfold(
    df: DataFrame, key: str, target: str, k: int = 5, seed: int | str = 42, output: str = "fold"
) -> DataFrame:
    """Number rows 0..k-1 so that fold sizes, per class and in total, differ by at most one. Rows without
    a key or a class get null."""
    if k < 2:
        raise ValueError("k must be at least 2")
    if many_classes(df, target):
        return class_parts(df, key, target, seed, _fold_table(class_totals(df, key, target), k)).withColumnRenamed("__part", output)
    counts = count_hash_cells(df, key, target, seed)
    hashed, part = _assign(df, key, target, seed, fold_sizes(counts.totals, k), counts)
    return hashed.withColumn(output, part).drop(HASH)


def kfold_views(df: DataFrame, fold: int, column: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of one fold."""
    return df.where(F.col(column) != fold), df.where(F.col(column) == fold)


def sample_n(df: DataFrame, key: str, n: int, seed: int | str = 42) -> DataFrame:
    """n rows at random, or all if there are fewer; rows without a key are never drawn.

    A hash cut at any n: rows before the cut, and of the copies of the one key at the cut as many as are missing."""
    seed = f"sample:{seed}"
    counts = count_hash_cells(df, key, None, seed)
    keyed = df.where(F.col(key).isNotNull())
    if n >= sum(counts.totals.values()):
        return keyed
    if n <= 0:
        return df.limit(0)
    cut = hash_cuts(df, key, None, seed, counts, {0: [n]})[(0, n)]
    hashed = keyed.withColumn(HASH, hash_order(key, seed))
    before = hashed.where(F.col(HASH) < cut)
    rest = hashed.where(F.col(HASH) == cut).limit(n - before.count())
    return before.unionByName(rest).drop(HASH)


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Rows and share per class; null targets are no class."""
    counted = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n")).scalar()
    return counted.select(target, "n", (F.col("n").cast("double") / total).alias("share")).orderBy(
        F.col("share").desc(), F.col(target)
    )


def balanced_weights(
    df: DataFrame, target: str, output: str = "weight", totals: Mapping[object, int] | None = None
) -> DataFrame:
    """n / (classes * rows of the class), by a join where the classes are many; ``totals`` reuses known class counts."""
    if totals is None and many_classes(df, target):
        counted = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("__class")).agg(F.count("*").alias("__n"))
        classes, rows = counted.agg(F.count("*"), F.sum("__n")).first()
        weighed = counted.select("__class", (F.lit(float(rows)) / (F.lit(float(classes)) * F.col("__n"))).alias(output))
        return df.join(weighed, df[target] == weighed["__class"], "left").drop("__class")
    totals = dict(totals) if totals is not None else count_classes(df, target)
    present = {c: n for c, n in totals.items() if n}
    n = sum(present.values())
    expr = None
    for label, count in present.items():
        value = F.lit(n / (len(present) * count))
        hit = F.col(target) == F.lit(label)
        expr = F.when(hit, value) if expr is None else expr.when(hit, value)
    return df.withColumn(output, F.lit(None).cast("double") if expr is None else expr)


def positive_weight(df: DataFrame, target: str, weight: float, output: str = "weight") -> DataFrame:
    """Weight of the positive class against 1 for the others."""
    return df.withColumn(output, F.when(F.col(target) == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))
