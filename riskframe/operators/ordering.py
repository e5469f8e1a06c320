"""Order-dependent work without an unbounded window partition.

Two building blocks carry every operator that needs a rank or a running total:

* ``hash_cuts`` finds the hash value that closes the first *r* rows of a class in hash order. A split
  is then a comparison with a literal, so the wide table is never shuffled or sorted.
* ``range_buckets`` + ``running`` compute running sums, maxima and minima: rows are cut into value
  ranges, each range is one window partition, and the totals of the earlier ranges are added.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions import hash_order
from riskframe.jobs import written

PREFIX_DIGITS = 3
#: Classes whose counts are held by the driver; with more, counts and cuts are tables (``class_parts``).
MAX_CLASSES = 256
#: Rows of a hash cell that one task puts in order; a larger one that holds a cut is counted again by a longer prefix.
CELL_ROWS = 50_000


@dataclass(frozen=True)
class ClassCounts:
    """Rows per class and per (class, hash prefix); at most MAX_CLASSES * 16**PREFIX_DIGITS cells."""

    totals: dict
    cells: dict

    def labels(self) -> list:
        return sorted(self.totals)


def count_classes(df: DataFrame, target: str, limit: int = MAX_CLASSES) -> dict:
    """Rows per non-null class. Stops when the column has more classes than ``limit``."""
    rows = df.where(F.col(target).isNotNull()).groupBy(target).count().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{target!r} has more than {limit} classes; it is not a class column")
    return {row[0]: row[1] for row in sorted(rows, key=lambda r: r[0])}


def count_hash_cells(df: DataFrame, key: str, target: str | None, seed: int | str) -> ClassCounts:
    """One narrow pass: class totals and their spread over hash prefixes."""
    label = F.col(target) if target else F.lit(0)
    bound = MAX_CLASSES * 16**PREFIX_DIGITS
    rows = (
        df.select(label.alias("c"), F.substring(hash_order(key, seed), 1, PREFIX_DIGITS).alias("b"))
        .where("c IS NOT NULL AND b IS NOT NULL")
        .groupBy("c", "b")
        .count()
        .limit(bound + 1)
        .collect()
    )
    totals: dict = {}
    cells: dict = {}
    for row in rows:
        totals[row["c"]] = totals.get(row["c"], 0) + row["count"]
        cells.setdefault(row["c"], {})[row["b"]] = row["count"]
    if len(totals) > MAX_CLASSES or len(rows) > bound:
        raise ValueError(f"{target!r} has more than {MAX_CLASSES} classes; it is not a class column")
    return ClassCounts(totals, cells)


def hash_cuts(
    df: DataFrame,
    key: str,
    target: str | None,
    seed: int | str,
    counts: ClassCounts,
    ranks: Mapping[object, Sequence[int]],
) -> dict:
    """Hash of the row at each wanted rank (1-based) of each class.

    Rows that share a key share a hash, so all copies of a key fall on the same side of a cut.
    Only rows in the prefixes that hold a wanted rank are looked at again; while such a prefix has more than
    ``CELL_ROWS`` rows, it is counted once more by a longer one.
    """

    def located(label: object, cells: Mapping[str, int], start: int, pending: Sequence[int]) -> list:
        found = []  # class, prefix, rank in the class, rank in the cell, rows of the cell
        for cell in sorted(cells):
            end = start + cells[cell]
            found += [(label, cell, r, r - start, cells[cell]) for r in pending if start < r <= end]
            start = end
        return found

    places = []
    for label, positions in ranks.items():
        places += located(label, counts.cells.get(label, {}), 0, sorted({r for r in positions if r > 0}))
    digits = PREFIX_DIGITS
    while digits < 32 and any(n > CELL_ROWS and len(cell) == digits for _, cell, _, _, n in places):
        full = sorted({(label, cell) for label, cell, _, _, n in places if n > CELL_ROWS and len(cell) == digits})
        digits += 2
        finer = _cells_below(df, key, target, seed, full, digits)
        places = [
            inner
            for label, cell, rank, local, n in places
            for inner in (
                located(label, finer[label, cell], rank - local, [rank]) if (label, cell) in finer else [(label, cell, rank, local, n)]
            )
        ]
    wanted = [p[:4] for p in places]
    if not wanted:
        return {}

    kind = df.schema[target].dataType if target else T.IntegerType()
    schema = T.StructType(
        [
            T.StructField("c", kind),
            T.StructField("b", T.StringType()),
            T.StructField("rank", T.LongType()),
            T.StructField("local", T.LongType()),
        ]
    )
    cuts = F.broadcast(df.sparkSession.createDataFrame(wanted, schema))
    hashed = df.select((F.col(target) if target else F.lit(0)).alias("c"), hash_order(key, seed).alias("h"))
    in_cell = Window.partitionBy("c", "b").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    lengths = sorted({len(w[1]) for w in wanted})  # no wanted prefix begins another one
    cells = F.array(*[F.substring("h", 1, n) for n in lengths])
    ranked = (
        hashed.withColumn("b", F.explode(cells))
        .join(cuts, ["c", "b"], "left_semi")
        .groupBy("c", "b", "h")
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(in_cell))
    )
    crossing = ranked.join(cuts, ["c", "b"]).where("local <= upto AND local > upto - n").select("c", "rank", "h")
    return {(row["c"], row["rank"]): row["h"] for row in crossing.collect()}


def _cells_below(df: DataFrame, key: str, target: str | None, seed: int | str, full: Sequence[tuple], digits: int) -> dict:
    """Rows per longer prefix of the given (class, prefix) cells."""
    kind = df.schema[target].dataType if target else T.IntegerType()
    schema = T.StructType([T.StructField("c", kind), T.StructField("b", T.StringType())])
    cells = F.broadcast(df.sparkSession.createDataFrame(full, schema))
    rows = df.select((F.col(target) if target else F.lit(0)).alias("c"), hash_order(key, seed).alias("h"))
    rows = rows.withColumn("b", F.substring("h", 1, len(full[0][1]))).join(cells, ["c", "b"], "left_semi")
    out: dict = {}
    for r in rows.groupBy("c", "b", F.substring("h", 1, digits).alias("d")).count().collect():
        out.setdefault((r["c"], r["b"]), {})[r["d"]] = r["count"]
    return out


def sum_before(df: DataFrame, order: Sequence[str], value: str, output: str) -> DataFrame:
    """Add the sum of ``value`` over the rows before this one in ``order`` (a unique order of any types).

    One range shuffle sorts the rows; each range adds the totals of the ranges before it.
    """
    sorted_rows = df.repartitionByRange(shuffle_buckets(df), *order).sortWithinPartitions(*order)
    placed = written(sorted_rows.withColumn("__at", F.monotonically_increasing_id()), "in-order").withColumn("__part", F.shiftright("__at", 33))
    parts = placed.groupBy("__part").agg(F.sum(value).alias("__total"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = parts.select("__part", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return placed.withColumn("__here", here).join(starts, "__part").select(*df.columns, (F.col("__here") + F.col("__start")).alias(output))


def class_totals(df: DataFrame, key: str, target: str) -> DataFrame:
    """(c, n): rows with a key per class, for any number of classes."""
    rows = df.where(F.col(target).isNotNull() & F.col(key).isNotNull())
    return written(rows.groupBy(F.col(target).alias("c")).agg(F.count("*").alias("n")), "classes")


def class_parts(df: DataFrame, key: str, target: str, seed: int | str, sizes: DataFrame) -> DataFrame:
    """Add ``__part``, the number of a row's part, for any number of classes: a class is cut, in hash order, into parts of
    the given sizes (c, n, parts: array of whole numbers).

    A class is laid out in as many hash cells as its rows ask for, cells are counted, and only those that hold a cut are put
    in order.  Rows meet the cuts of their class by a join; a class that holds most rows is left to the skew join.
    """
    digits = F.greatest(F.lit(0), F.ceil(F.log(F.col("n") / F.lit(float(CELL_ROWS))) / F.lit(math.log(16.0)))).cast("int")
    classes = written(sizes.select("c", "n", "parts", digits.alias("digits")), "class-sizes")
    rows = df.select(F.col(target).alias("c"), hash_order(key, seed).alias("h")).where("c IS NOT NULL AND h IS NOT NULL")
    celled = rows.join(classes.select("c", "digits"), "c").select("c", "h", F.expr("substring(h, 1, digits)").alias("b"))
    earlier = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counted = celled.groupBy("c", "b").agg(F.count("*").alias("k")).withColumn("start", F.coalesce(F.sum("k").over(earlier), F.lit(0)))
    ends = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x))
    ranks = classes.where(F.size("parts") > 1).select("c", F.posexplode(ends).alias("part", "rank")).where("rank > 0")
    wanted = written(counted.join(ranks, "c").where("start < rank AND rank <= start + k").select("c", "b", "part", "rank", (F.col("rank") - F.col("start")).alias("local")), "cuts")
    upto = Window.partitionBy("c", "b").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    near = celled.join(wanted.select("c", "b").distinct(), ["c", "b"], "left_semi").groupBy("c", "b", "h").agg(F.count("*").alias("k"))
    ranked = near.withColumn("upto", F.sum("k").over(upto))
    cuts = ranked.join(wanted, ["c", "b"]).where("local <= upto AND local > upto - k")
    cuts = cuts.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("part", "h"))).alias("cuts"))
    table = written(classes.join(cuts, "c", "left").select(F.col("c").alias("__class"), F.col("parts").alias("__sizes"), "cuts"), "class-cuts")
    hashed = df.withColumn("__hash", hash_order(key, seed))
    joined = hashed.join(table, hashed[target] == table["__class"], "left")
    # the first part whose last hash is not below the row's, parts without rows apart; else the last part
    open_ = F.filter("cuts", lambda x: (F.col("__hash") <= x["h"]) & (F.get("__sizes", x["part"]) > 0))
    part = F.coalesce(F.get(open_, F.lit(0))["part"], F.size("__sizes") - 1)
    known = F.col("__hash").isNotNull() & F.col("__class").isNotNull()
    return joined.withColumn("__part", F.when(known, part)).select(*df.columns, "__part")


def shuffle_buckets(df: DataFrame) -> int:
    """Number of ranges to cut a running total into: the session's shuffle width, which a job sets by its size."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bucket_name(column: str) -> str:
    return f"{column}__range"


def range_buckets(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> Bucketizer:
    """Value ranges of roughly equal size per column, as a transformer adding ``<column>__range``.

    The edges are values, so a recomputed partition lands in the same range. Quantiles only have to
    balance the work; results do not depend on them.
    """
    buckets = buckets or shuffle_buckets(df)
    inner = [i / buckets for i in range(1, buckets)]
    if inner:
        edges = df.select([F.col(c).cast("double").alias(c) for c in columns]).approxQuantile(
            list(columns), inner, 1.0 / (4 * buckets)
        )
    else:
        edges = [[] for _ in columns]
    # a bucketizer wants at least one inner edge; any value serves for an empty or all-null column
    finite = [sorted({e for e in found if abs(e) != float("inf")}) or [0.0] for found in edges]
    splits = [[float("-inf"), *inner_edges, float("inf")] for inner_edges in finite]
    return Bucketizer(
        splitsArray=splits,
        inputCols=list(columns),
        outputCols=[bucket_name(c) for c in columns],
        handleInvalid="keep",
    )


_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    order: str,
    bucket: str,
    values: Mapping[str, tuple[str, str]],
    by: Sequence[str] = (),
    descending: bool = False,
    inclusive: bool = True,
    whole: Mapping[str, tuple[str, str]] | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add running aggregates over ``order`` within ``by``; ``values`` maps name -> (kind, column).

    ``bucket`` must be a non-decreasing function of ``order``. With ``inclusive=False`` the row's own
    value is left out: sums start at 0, maxima and minima at null. ``whole`` adds aggregates of the
    entire group in the same pass. ``source`` may name the rows ``df`` was aggregated from: range totals
    are then summed straight from them, which combines on the map side.
    """
    whole = dict(whole or {})
    by = list(by)

    def direction(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    totals = (source if source is not None else df).groupBy(*by, bucket).agg(
        *[_COMBINE[kind](column).alias(f"__t_{name}") for name, (kind, column) in {**values, **whole}.items()]
    )
    group = Window.partitionBy(*by)
    before = Window.partitionBy(*by).orderBy(direction(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *by,
        bucket,
        F.lit(0).alias("__is_row"),
        *[_COMBINE[kind](f"__t_{name}").over(before).alias(f"__v_{name}") for name, (kind, _) in values.items()],
        *[_COMBINE[kind](f"__t_{name}").over(group).alias(f"__g_{name}") for name, (kind, _) in whole.items()],
    )
    rows = df.select(
        "*", F.lit(1).alias("__is_row"), *[F.col(column).alias(f"__v_{name}") for name, (_, column) in values.items()]
    )
    # the total of earlier ranges enters each range as its first row: one shuffle, no join, null-safe groups
    ordered = Window.partitionBy(*by, bucket).orderBy("__is_row", direction(order))
    inside = ordered.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    first = ordered.rowsBetween(Window.unboundedPreceding, 0)
    results = [F.first(f"__g_{name}").over(first).alias(name) for name in whole]
    for name, (kind, _) in values.items():
        value = _COMBINE[kind](f"__v_{name}").over(inside)
        results.append((F.coalesce(value, F.lit(0)) if kind == "sum" else value).alias(name))
    stacked = rows.unionByName(carried, allowMissingColumns=True)
    return stacked.select(*df.columns, "__is_row", *results).where("__is_row = 1").drop("__is_row")


def with_previous(
    df: DataFrame, order: str, payload: Sequence[str], by: Sequence[str] = (), buckets: Bucketizer | None = None
) -> DataFrame:
    """Add ``prev_<column>`` from the row before in ``order``; the order is unique within ``by``."""
    buckets = buckets or range_buckets(df, [order])
    packed = buckets.transform(df).withColumn("__row", F.struct(order, *payload))
    found = running(
        packed, order, bucket_name(order), {"__prev": ("max", "__row")}, by=by, inclusive=False
    )
    return found.select(*df.columns, *[F.col(f"__prev.{c}").alias(f"prev_{c}") for c in payload])


def number_rows(df: DataFrame, order: str, output: str = "number") -> DataFrame:
    """Add 1, 2, 3 ... in ascending ``order`` over the whole table; the order is numeric and unique."""
    placed = range_buckets(df, [order]).transform(df).withColumn("__one", F.lit(1).cast("bigint"))
    return running(placed, order, bucket_name(order), {output: ("sum", "__one")}).select(*df.columns, output)


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Mapping[str, float], extra: Sequence[Column] = ()
) -> DataFrame:
    """Nearest-rank quantiles of each numeric column, as (column, n, <name>...), without holding a column
    in one task: values are counted, counts are accumulated over value ranges. ``extra`` aggregates run over
    (value, k): each distinct value and its count."""
    columns = list(columns)
    placed = range_buckets(df, columns).transform(df)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.col(c).cast("double").alias("value"), F.col(bucket_name(c)).alias("bucket")
            )
            for c in columns
        ]
    )
    cells = placed.select(F.inline(cells)).where("value IS NOT NULL").withColumn("k", F.lit(1).cast("bigint"))
    counted = cells.groupBy("column", "bucket", "value").agg(F.sum("k").alias("k"))
    cumulative = running(
        counted, "value", "bucket", {"upto": ("sum", "k")}, by=["column"], whole={"n": ("sum", "k")}, source=cells
    )
    picks = []
    for name, q in probabilities.items():
        rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("n") * F.lit(float(q)), 9)))
        hit = (F.col("upto") >= rank) & (F.col("upto") - F.col("k") < rank)
        picks.append(F.max(F.when(hit, F.col("value"))).alias(name))
    return cumulative.groupBy("column").agg(F.max("n").alias("n"), *picks, *extra)
