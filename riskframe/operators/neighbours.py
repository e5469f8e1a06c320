"""Exact k-nearest-neighbour vote.

The join is cut into blocks: both sides are placed near pivots, a query only visits the cells its k nearest can lie in (triangle
inequality, so nothing is missed), and cells are cut into blocks of bounded size on both sides. A block
hands on k rows per query, never its pairs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions import hash_order
from riskframe.operators.sampling import sample_n

# tasks get this module's functions with the job, so executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Training rows of a block if not given, and queries of a block at least: each block of queries takes a copy of the cell.
BLOCK_ROWS = 20_000
RINGS = 16
CHUNK_CELLS = 4_000_000


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype("float64") if len(values) else np.zeros((0, 0))


def matrix_of(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal length as a matrix, from their buffer: no object per vector."""
    column = column.combine_chunks()
    lengths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) > 1:
        raise ValueError("vectors of different lengths")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _nearest(
    queries: np.ndarray, points: np.ndarray, keys: np.ndarray, k: int, digits: int | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query positions, point positions and squared distances of each query's k nearest, ties by point key.

    The fast product form, on vectors moved to the points' mean, only narrows the candidates; distances are then
    taken from the differences, and rounded to ``digits`` where that is asked for."""
    out_q, out_p, out_d = [], [], []
    if len(points):
        centre = points.mean(axis=0)
        queries, points = queries - centre, points - centre
    norms = (points**2).sum(axis=1)
    step = 0.0 if digits is None else 2.0 * 10.0**-digits
    chunk = max(1, CHUNK_CELLS // max(len(points), 1))
    for start in range(0, len(queries), chunk):
        part = queries[start : start + chunk]
        own = (part**2).sum(axis=1)[:, None]
        rough = own + norms[None, :] - 2.0 * part @ points.T
        if len(points) > k:
            limit = np.partition(rough, k - 1, axis=1)[:, k - 1 : k] + step + 1e-12 * (own + norms.max())
            rows, cols = np.nonzero(rough <= limit)
        else:
            rows, cols = (a.ravel() for a in np.indices(rough.shape))
        exact = np.empty(len(rows))
        slice_rows = max(1, CHUNK_CELLS // max(1, part.shape[1]))
        for at in range(0, len(rows), slice_rows):  # many ties must not need a matrix of all pairs
            here = slice(at, at + slice_rows)
            exact[here] = ((part[rows[here]] - points[cols[here]]) ** 2).sum(axis=1)
        exact = exact if digits is None else np.round(exact, digits)
        order = np.lexsort((keys[cols], exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        first = np.searchsorted(rows, rows)
        keep = np.arange(len(rows)) - first < k
        out_q.append(rows[keep] + start)
        out_p.append(cols[keep])
        out_d.append(exact[keep])
    if not out_q:
        none = np.zeros(0, dtype=int)
        return none, none, np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_p), np.concatenate(out_d)


def nearest_neighbours(
    train: DataFrame,
    queries: DataFrame,
    key: str,
    vector: str,
    label: str,
    k: int = 5,
    block_rows: int = BLOCK_ROWS,
    broadcast_cells: int = 0,
    seed: int | str = 42,
    digits: int | None = None,
) -> DataFrame:
    """(key, neighbour, label, distance, position): the k nearest training rows of every query row.

    ``broadcast_cells`` lets a training table of at most so many numbers go to every task instead. ``digits`` rounds
    squared distances before they are compared, so that nearer than that is a tie."""
    known = train.where(F.col(vector).isNotNull()).select(F.col(key), F.col(vector), F.col(label))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key), F.col(vector))
    size = known.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    schema = T.StructType(
        [
            T.StructField(key, queries.schema[key].dataType),
            T.StructField("neighbour", train.schema[key].dataType),
            T.StructField("label", train.schema[label].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    if not size["n"]:
        found = train.sparkSession.createDataFrame([], schema)
    elif size["n"] * size["d"] <= broadcast_cells:
        found = _broadcast_search(known, asked, key, vector, label, k, schema, digits)
    else:
        found = _block_search(known, asked, key, vector, label, k, block_rows, size["n"], seed, schema, digits)
    # at most k rows per visited block and query
    place = Window.partitionBy(key).orderBy("distance", "neighbour")
    return found.withColumn("position", F.row_number().over(place)).where(F.col("position") <= k)


def _broadcast_search(known, asked, key, vector, label, k, schema, digits) -> DataFrame:
    local = known.toPandas()
    points, keys, labels = _matrix(local[vector]), local[key].to_numpy(), local[label].to_numpy()
    shared = known.sparkSession.sparkContext.broadcast((points, keys, labels))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points, keys, labels = shared.value
        for batch in batches:
            if len(batch):
                q, p, d = _nearest(_matrix(batch[vector]), points, keys, k, digits)
                yield pd.DataFrame(
                    {key: batch[key].to_numpy()[q], "neighbour": keys[p], "label": labels[p], "distance": d}
                )

    return asked.mapInPandas(search, schema)


def _block_search(known, asked, key, vector, label, k, block_rows, n, seed, schema, digits) -> DataFrame:
    pivots = max(2, round(2 * n ** (1 / 3)))
    anchors = _matrix(sample_n(known, key, pivots, seed).select(vector).toPandas()[vector])
    centre = anchors.mean(axis=0)
    anchors = anchors - centre

    def distances(matrix: np.ndarray) -> np.ndarray:
        matrix = matrix - centre
        squared = (matrix**2).sum(axis=1)[:, None] + (anchors**2).sum(axis=1)[None, :] - 2.0 * matrix @ anchors.T
        return np.sqrt(np.maximum(squared, 0.0))

    @F.pandas_udf("cell int, reach double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        gaps = distances(_matrix(vectors))
        cell = gaps.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "reach": gaps[np.arange(len(cell)), cell]})

    placed = known.withColumn("at", place(F.col(vector))).select(key, vector, label, "at.cell", "at.reach")
    widest = placed.agg(F.max("reach")).first()[0] or 1.0
    ring = F.floor(F.col("reach") / F.lit(widest) * (RINGS - 1)).cast("int")
    # rings: RINGS rows for each pivot, of which there are about the cube root of the rows
    rings = (
        placed.groupBy("cell", ring.alias("ring"))
        .agg(F.count("*").alias("rows"), F.min("reach").alias("low"), F.max("reach").alias("high"))
        .toPandas()
    )
    cells_of, low, high = rings["cell"].to_numpy(), rings["low"].to_numpy(), rings["high"].to_numpy()
    counts = rings["rows"].to_numpy()
    in_cell = rings.groupby("cell")["rows"].sum().to_dict()

    @F.pandas_udf("array<int>")
    def visit(vectors: pd.Series) -> pd.Series:
        """Cells that can hold one of the k nearest: no farther than rings that surely hold k rows."""
        matrix, picked = _matrix(vectors), []
        step = max(1, CHUNK_CELLS // len(cells_of) // 4)
        for start in range(0, len(matrix), step):
            gaps = distances(matrix[start : start + step])[:, cells_of]
            farthest, nearest = gaps + high, np.maximum(np.maximum(gaps - high, low - gaps), 0.0)
            order = np.argsort(farthest, axis=1)
            short = (np.cumsum(counts[order], axis=1) < min(k, n)).sum(axis=1)
            bound = np.take_along_axis(farthest, np.take_along_axis(order, short[:, None], axis=1), axis=1)
            # the product form is off by about a millionth of the largest distances at most, ties by half a digit
            near = nearest <= bound + 1e-6 * (bound + gaps.max()) + (0.0 if digits is None else 10.0 ** (-digits / 2))
            picked += [np.unique(cells_of[row]).astype("int32").tolist() for row in near]
        return pd.Series(picked, dtype=object)

    routed = asked.withColumn("cell", F.explode(visit(F.col(vector))))
    visits = {r["cell"]: r["count"] for r in routed.groupBy("cell").count().collect()}  # one row per cell
    train_blocks = {int(c): max(1, -(-int(m) // block_rows)) for c, m in in_cell.items()}
    query_blocks = {int(c): max(1, -(-m // max(block_rows, BLOCK_ROWS))) for c, m in visits.items()}

    def per_cell(blocks: dict[int, int]):
        pairs = [F.lit(part) for item in sorted(blocks.items()) for part in item]
        return F.try_element_at(F.create_map(*pairs), F.col("cell"))

    def slot(blocks: dict[int, int], salt: str):
        return F.pmod(F.xxhash64(hash_order(key, salt)), per_cell(blocks)).cast("int")

    def every(blocks: dict[int, int]):
        return F.explode(F.sequence(F.lit(0), per_cell(blocks) - 1))

    # a cell no query visits has no query blocks, and its rows go nowhere
    if not query_blocks:
        return known.sparkSession.createDataFrame([], schema)
    # both sides may come from one table: new column names keep them apart in the plan
    left = (
        placed.withColumn("t", slot(train_blocks, "train"))
        .withColumn("q", every(query_blocks))
        .select(
            "cell", "t", "q", F.col(key).alias("point"), F.col(vector).alias("point_at"), F.col(label).alias("point_label")
        )
    )
    right = (
        routed.withColumn("q", slot(query_blocks, "query"))
        .withColumn("t", every(train_blocks))
        .select("cell", "t", "q", F.col(key).alias("query"), F.col(vector).alias("query_at"))
    )

    def search(points: pa.Table, queries: pa.Table) -> pa.Table:
        if points.num_rows and queries.num_rows:
            keys = points.column("point").to_pandas().to_numpy()
            q, p, d = _nearest(matrix_of(queries.column("query_at")), matrix_of(points.column("point_at")), keys, k, digits)
        else:
            q, p, d = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        found = (queries.column("query").take(pa.array(q)), points.column("point").take(pa.array(p)), points.column("point_label").take(pa.array(p)))
        return pa.table([*found, pa.array(d)], names=[key, "neighbour", "label", "distance"])

    parts = ["cell", "t", "q"]
    return left.groupBy(*parts).cogroup(right.groupBy(*parts)).applyInArrow(search, schema)


def score_knn(
    train: DataFrame, queries: DataFrame, key: str, vector: str, label: str, k: int = 5, **options
) -> DataFrame:
    """Majority label of the k nearest training rows, the smaller label on a tie: (key, prediction, votes)."""
    found = nearest_neighbours(train, queries, key, vector, label, k, **options)
    return (
        found.groupBy(key, "label")
        .agg(F.count("*").alias("votes"))
        .groupBy(key)
        .agg(
            F.max_by("label", F.struct(F.col("votes"), -F.col("label"))).alias("prediction"),
            F.max("votes").alias("votes"),
        )
    )
