"""A stored index for nearest neighbours: rows in cells around centres, searched cell by cell with a running bound.

Building: centres are fitted on a bounded sample (``SAMPLE`` rows by hash), then every row is placed in the cell of its
nearest centre, with its distance to it, and the table is written in buckets of the cell; cells of more than ``CELL_ROWS``
rows are dealt over several blocks.  Centres and table are one folder, which any later session opens.

Searching: queries visit their nearest cells in growing batches (1, 2, 4, ... cells).  A visit meets the rows of a block with
the queries that come to it and hands on k rows per query; only queries are moved, the table stays in its buckets.  After
each batch a query drops the cells that the triangle inequality rules out by the k-th distance so far, and ends when none is
left.  With ``probes`` it ends after so many cells at the latest, which is the approximate form: ``recall`` measures it
against the exact search.  Without ``probes`` the result is exact.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.functions import hash_order
from riskframe.jobs import written
from riskframe.operators.neighbours import _matrix, _nearest, matrix_of, nearest_neighbours
from riskframe.operators.sampling import sample_n

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

#: Rows that the centres are fitted on, rounds of that fit, and rows of a block of a cell.
SAMPLE, ROUNDS, CELL_ROWS = 20_000, 10, 20_000
#: Queries of a group that are met at once.
ASK_ROWS = 4096
#: Share of the largest distance to a centre by which the product form of distances may be off.
SLACK = 1e-6


def fitted_centres(points: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Centres by repeated assignment to the nearest one; a centre that loses all its points moves to the farthest point."""
    rng = np.random.default_rng(seed)
    centres = points[np.sort(rng.permutation(len(points))[:cells])].copy()
    for _ in range(ROUNDS):
        near, gap = nearest_centre(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        far = np.argsort(-gap, kind="stable")
        for i, c in enumerate(np.flatnonzero(counts == 0)):
            centres[c] = points[far[i]]
    return centres


def gaps_to(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    middle = centres.mean(axis=0)
    p, c = points - middle, centres - middle
    return np.sqrt(np.maximum((p**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None] - 2 * p @ c.T, 0.0))


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near, gap = np.empty(len(points), np.int64), np.empty(len(points))
    for at in range(0, len(points), 4096):
        gaps = gaps_to(points[at : at + 4096], centres)
        near[at : at + 4096] = gaps.argmin(axis=1)
        gap[at : at + 4096] = gaps.min(axis=1)
    return near, gap


@dataclass(frozen=True)
class VectorIndex:
    """Folder of an index, its centres, and per cell its blocks and the largest distance of a row to its centre."""

    path: str
    centres: np.ndarray
    blocks: dict[int, int]
    reach: dict[int, float]

    def rows(self, spark: SparkSession) -> DataFrame:
        """The indexed rows as a bucketed table of this session: (key, at, label, cell, block)."""
        name = f"index_{uuid.uuid4().hex}"
        meta = spark.read.parquet(f"{self.path}/meta").first()
        spark.sql(
            f"CREATE TABLE {name} ({meta['columns']}) USING parquet CLUSTERED BY (cell, block) INTO {meta['buckets']} BUCKETS LOCATION '{self.path}/rows'"
        )
        return spark.table(name)


def build_index(train: DataFrame, key: str, vector: str, label: str, path: str, cells: int | None = None, seed: int = 42) -> VectorIndex:
    """Index of all rows that have a vector, written to ``path``; about the square root of their number of cells."""
    spark = train.sparkSession
    known = train.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("at"), F.col(label).alias("label"))
    n = known.count()
    drawn = sample_n(known, "key", SAMPLE, f"index:{seed}").orderBy(hash_order("key", seed)).toPandas()
    points = _matrix(drawn["at"])
    centres = fitted_centres(points, max(1, min(cells or round(math.sqrt(n)), len(points))), seed) if len(points) else np.zeros((0, 0))

    @F.pandas_udf("cell long, gap double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        near, gap = nearest_centre(_matrix(vectors), centres)
        return pd.DataFrame({"cell": near, "gap": gap})

    placed = written(known.withColumn("placed", place("at")).select("key", "at", "label", "placed.cell", "placed.gap"), "placed")
    found = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("reach")).collect()  # a row per cell
    blocks = {int(r["cell"]): max(1, -(-r["n"] // CELL_ROWS)) for r in found}
    reach = {int(r["cell"]): float(r["reach"]) for r in found}
    pairs = [F.lit(x) for item in sorted(blocks.items()) for x in item]
    own = F.pmod(F.xxhash64("key"), F.try_element_at(F.create_map(*pairs), F.col("cell"))) if pairs else F.lit(0).cast("long")
    rows = placed.withColumn("block", own.cast("long")).drop("gap")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"index_{uuid.uuid4().hex}"
    rows.write.format("parquet").bucketBy(buckets, "cell", "block").option("path", f"{path}/rows").saveAsTable(name)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    spark.sql(f"DROP TABLE {name}")
    cells_table = [(c, centres[c].tolist(), blocks[c], reach[c]) for c in sorted(blocks)]
    empty = [(c, centres[c].tolist(), 0, 0.0) for c in range(len(centres)) if c not in blocks]
    spark.createDataFrame(cells_table + empty, "cell long, centre array<double>, blocks long, reach double").write.parquet(f"{path}/cells")
    spark.createDataFrame([(columns, buckets)], "columns string, buckets int").write.parquet(f"{path}/meta")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    centres = np.array([r["centre"] for r in cells]) if cells else np.zeros((0, 0))
    return VectorIndex(path, centres, {r["cell"]: r["blocks"] for r in cells if r["blocks"]}, {r["cell"]: r["reach"] for r in cells})


def search_index(spark: SparkSession, index: VectorIndex, queries: DataFrame, key: str, vector: str, k: int = 5, probes: int | None = None) -> DataFrame:
    """(key, neighbour, label, distance, position): the k nearest indexed rows of every query, distances squared.

    ``probes`` bounds the cells a query visits; without it the result is exact."""
    known = index.rows(spark)
    kinds = dict(known.dtypes)
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("query"), F.col(vector).cast("array<double>").alias("to"))
    query_kind = dict(asked.dtypes)["query"]
    most = min(probes or len(index.centres), len(index.centres))
    centres, reach = index.centres, np.array([index.reach.get(c, 0.0) for c in range(len(index.centres))])
    filled = np.array([c in index.blocks for c in range(len(centres))])
    blocks = index.blocks
    out_type = f"query {query_kind}, neighbour {kinds['key']}, label {kinds['label']}, distance double"
    best = spark.createDataFrame([], out_type)

    def visits_between(first: int, last: int):
        @F.pandas_udf("array<struct<cell: long, block: long>>")
        def visits(to: pd.Series, bound: pd.Series) -> pd.Series:
            picked = []
            matrix, limits = _matrix(to), np.sqrt(bound.to_numpy(float))
            for at in range(0, len(matrix), 1024):
                gaps = gaps_to(matrix[at : at + 1024], centres)
                order = np.argsort(np.where(filled, gaps, np.inf), axis=1, kind="stable")[:, first:last]
                for i, row in enumerate(order):
                    # a row of a cell is no nearer than the centre less the cell's reach
                    limit = limits[at + i] * (1 + 1e-9) + SLACK * gaps[i].max()
                    near = [int(c) for c in row if filled[c] and gaps[i, c] - reach[c] <= limit]
                    picked.append([{"cell": c, "block": b} for c in near for b in range(blocks[c])])
            return pd.Series(picked, dtype=object)

        return visits

    state = written(asked.withColumn("bound", F.lit(float("inf"))), "queries") if most else None
    start, width = 0, 1
    while start < most:
        stop = min(most, start + width)

        routed = state.withColumn("visit", F.explode(visits_between(start, stop)("to", "bound"))).select("query", "to", "visit.cell", "visit.block")

        def meet(group: tuple, rows: pa.Table, asking: pa.Table) -> pa.Table:
            points, keys = matrix_of(rows.column("at")), rows.column("key").to_pandas().to_numpy()
            none = pa.table({"query": asking.column("query").slice(0, 0), "neighbour": rows.column("key").slice(0, 0), "label": rows.column("label").slice(0, 0), "distance": pa.array([], pa.float64())})
            parts = [none]
            for at in range(0, asking.num_rows if len(points) else 0, ASK_ROWS):  # matrices of a part, however many ask
                part = asking.slice(at, ASK_ROWS)
                q, p, d = _nearest(matrix_of(part.column("to")), points, keys, k)
                parts.append(pa.table({"query": part.column("query").take(pa.array(q)), "neighbour": rows.column("key").take(pa.array(p)), "label": rows.column("label").take(pa.array(p)), "distance": pa.array(d)}))
            return pa.concat_tables(parts)

        found = known.select("key", "at", "label", "cell", "block").groupBy("cell", "block").cogroup(routed.groupBy("cell", "block")).applyInArrow(meet, out_type)
        place = Window.partitionBy("query").orderBy("distance", "neighbour")
        ranked = best.unionByName(found).withColumn("position", F.row_number().over(place)).where(F.col("position") <= k)
        best = written(ranked.drop("position"), "nearest")
        start, width = stop, width * 2
        if start < most:
            bounds = best.groupBy("query").agg(F.when(F.count("*") >= k, F.max("distance")).alias("kth"))
            state = written(state.drop("bound").join(bounds, "query", "left").select("query", "to", F.coalesce("kth", F.lit(float("inf"))).alias("bound")), "queries")
            if not _any_left(state, centres, reach, filled, start):
                break
    place = Window.partitionBy("query").orderBy("distance", "neighbour")
    return best.withColumn("position", F.row_number().over(place)).withColumnRenamed("query", key)


def _any_left(state: DataFrame, centres: np.ndarray, reach: np.ndarray, filled: np.ndarray, start: int) -> bool:
    """Whether some query still has a cell that its bound does not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch.column(0).to_pandas())
            if not len(matrix):
                continue
            gaps = gaps_to(matrix, centres)
            limits = np.sqrt(batch.column(1).to_numpy(zero_copy_only=False)) * (1 + 1e-9) + SLACK * gaps.max(axis=1)
            order = np.argsort(np.where(filled, gaps, np.inf), axis=1, kind="stable")[:, start:]
            rest = np.take_along_axis(np.where(filled, gaps - reach, np.inf), order, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([bool((rest <= limits[:, None]).any())])], names=["left"])

    return not state.select("to", "bound").mapInArrow(run, "left boolean").where("left").isEmpty()


def recall(found: DataFrame, train: DataFrame, queries: DataFrame, key: str, vector: str, label: str, k: int = 5) -> float:
    """Share of the exact k nearest (by distance) that a search found."""
    exact = nearest_neighbours(train, queries, key, vector, label, k)
    farthest = exact.groupBy(key).agg(F.max("distance").alias("limit"), F.count("*").alias("n"))
    hits = found.join(farthest, key).where(F.col("distance") <= F.col("limit") * (1 + 1e-9) + 1e-12)
    total = farthest.agg(F.sum("n")).first()[0] or 0
    return min(1.0, hits.count() / total) if total else 1.0


def vote_of(found: DataFrame, key: str) -> DataFrame:
    """Majority label of the rows found, the smaller label on a tie: (key, prediction, votes)."""
    votes = found.groupBy(key, "label").agg(F.count("*").alias("votes"))
    return votes.groupBy(key).agg(F.max_by("label", F.struct(F.col("votes"), -F.col("label"))).alias("prediction"), F.max("votes").alias("votes"))
