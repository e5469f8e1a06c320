"""Gradient boosting on histograms: level- or leaf-wise trees, regularised leaves, dropout, one aggregate a level.

Rows are coded once: a byte per feature, its place among the feature's exact quantiles; a batch of them is one row of arrays.
Each round computes gradients and Hessians once, for the rows and columns it draws, and keeps them until its tree is grown.
A pass over them adds up, per (node, feature, code), gradients, Hessians and rows in numpy inside the tasks, and only these
sums are moved, at most as many rows a task as the model has cells.  Of two sibling nodes the one with fewer rows is summed,
the other is the difference; nodes that cannot be split any more are not summed, as their totals follow from their parents'
sums.  Gradients are whole numbers (a share of 2^24 of the largest weight), so the sums, the splits and the model do not
depend on how the rows are partitioned or on tasks that ran twice.  Scores so far are written to the shared folder every few
rounds; between, tasks add the trees that came since.

A fit whose rows one task can hold (``TASK_ROWS``) is a single job: its task reads the coded rows and goes through all rounds,
with the same sums in numpy and so the same model.  Larger tables take a pass of all tasks for each level.

Fits that leave out one fold each share their rows: ``Coded`` holds a row's place among the edges of all of them, found and
written in three passes over the table whatever the number of fits, and a fit reads its own codes off by a table.

Leaf-wise growth takes the best split of all open leaves until ``leaves`` are reached.  Each pass sums the children of all
splits that are the best by what is known; when none of the chosen splits has unknown children, the tree is the one that
splitting one leaf at a time would give.
"""

from __future__ import annotations

import heapq
import math
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.jobs import kept, written
from riskframe.operators import trees as T
from riskframe.operators.scorers import _Scorer

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

MISSING, MISSING_PLACE = 255, 1 << 30
#: Most edges of a feature over all fits that share coded rows: codes of two bytes.
MOST_SHARED = 1 << 15
MOST_BINS = 254
#: Whole-number gradients: a weight of the largest size times 1.
UNIT = 1 << 24
#: Rounds between two writings of the scores, and cells that one pass sums.
REWRITE, MOST_CELLS = 8, 4_000_000
#: Rounds still to come for which the scores are not written.
FEW = 3
#: Values that cut a feature into cells to find its quantiles.
PIVOTS = 4096
#: Rows of a partition of the coded rows, and sums of all tasks up to which the driver adds them up itself.
PART_ROWS, MOST_SUMS = 1 << 18, 1 << 19
#: Rows of a fit of more than ``REWRITE`` rounds that one task holds, and bytes that it may use to remember leaves of trees.
TASK_ROWS, LEAF_BYTES = 1 << 20, 1 << 27
#: Rows that are routed at a time, and nodes whose splits are searched at a time: what processor caches hold.
ROUTED, SEARCHED = 1 << 14, 1 << 5
#: Shares of rows that one-sided sampling takes by size of gradient and, of the rest, by chance.
TOP, OTHER = 0.2, 0.1

# The two tuned boosted learners.
PROFILES = {
    "leafy": {
        "boosting": "dart", "rounds": 264, "depth": 12, "leaves": 147, "step": 0.1321, "rows": 0.8278, "subset": 0.6187, "min_leaf": 5,
        "min_weight": 1e-3, "min_gain": 1.05e-05, "alpha": 1.89e-05, "lambda_": 0.0732, "drop": 0.1, "most_dropped": 50, "skip": 0.5,
    },
    "deep": {
        "boosting": "dart", "rounds": 500, "depth": 12, "leaves": None, "step": 0.1208, "rows": 0.9744, "subset": 0.7837, "min_leaf": 1,
        "min_weight": 1.0, "min_gain": 0.0232, "alpha": 2.62e-05, "lambda_": 1.79e-05, "drop": 0.0, "most_dropped": 0, "skip": 0.0,
    },
}


class BoostedScorer(_Scorer):
    """base + sum of weight times tree; class 1 above 0, probability by the logistic link."""

    trees = Param(Params._dummy(), "trees", "node tables as JSON", TypeConverters.toString)
    weights = Param(Params._dummy(), "weights", "weight of each tree", TypeConverters.toListFloat)
    base = Param(Params._dummy(), "base", "score before the first tree", TypeConverters.toFloat)

    def __init__(self, features: Sequence[str] | None = None, trees: str = "[]", weights: Sequence[float] = (), base: float = 0.0) -> None:
        values = {} if features is None else {"features": list(features)}
        super().__init__(**values, trees=trees, weights=[float(w) for w in weights], base=float(base))

    def parts(self) -> tuple[list[str], list[T.Tree], list[float], float]:
        return self._value(self.features), T.load(self._value(self.trees)), self._value(self.weights), self._value(self.base)

    def raw(self) -> Column:
        names, trees, weights, base = self.parts()
        cuts = thresholds(trees, len(names))
        routers = [Router(over_places(tree, cuts), missing=MISSING_PLACE) for tree in trees]

        @F.pandas_udf("double")
        def margin(*columns: pd.Series) -> pd.Series:
            places = np.empty((len(cuts), len(columns[0])), np.int32)
            for j, own in enumerate(cuts):
                x = columns[j].to_numpy(float)
                places[j] = np.where(np.isnan(x), MISSING_PLACE, np.searchsorted(own, x, side="right"))
            total = np.full(places.shape[1], base)
            for router, weight in zip(routers, weights):
                total += weight * router.value.take(router.leaf_of(places))
            return pd.Series(total)

        return margin(*[F.col(f).cast("double") for f in names])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        score = F.col("__raw")
        return dataset.withColumn("__raw", self.raw()).select(
            *dataset.columns, (score > 0).cast("int").alias("prediction"), (1.0 / (1.0 + F.exp(-score))).alias("probability")
        )


def draws(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) from the rows' hashes and a seed."""
    with np.errstate(over="ignore"):
        x = hashes.view(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int, n: int | None = None) -> list[np.ndarray]:
    """Per feature the distinct values at the quantiles i / bins, exact, so the same however the rows are partitioned."""
    return fold_edges(rows, features, bins, n)[None]


def fold_edges(
    rows: DataFrame, features: Sequence[str], bins: int, n: int | None = None, fold: str | None = None, k: int = 0
) -> dict[int | None, list[np.ndarray]]:
    """Edges of all rows (None) and of the rows of all folds but one, for each of ``k`` folds, in the same passes.

    Pivots from some rows cut a feature's values into cells.  Counting the cells of each fold finds those that hold a wanted
    rank; only the values inside them are counted one by one.  The pivots bear on the work alone, not on the result."""
    place = F.coalesce(F.col(fold), F.lit(k)).cast("int") if fold else F.lit(0)  # rows without a fold come last
    narrow = rows.select(*[F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(features)], place.alias("fold"))
    n = narrow.count() if n is None else n
    some = narrow.sample(min(1.0, 8 * PIVOTS / n), seed=1).toPandas() if n else pd.DataFrame(columns=narrow.columns)
    pivots = []
    for name in narrow.columns[:-1]:
        values = np.unique(some[name].to_numpy(float) + 0.0)
        values = values[~np.isnan(values)]
        pivots.append(values[np.unique(np.linspace(0, len(values) - 1, min(PIVOTS, len(values))).astype(int))] if len(values) else values)

    def places(batch: pa.RecordBatch, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values that are there, their cells (an even one lies between two pivots, an odd one is a pivot) and folds."""
        there = batch.column(j).is_valid().to_numpy(zero_copy_only=False)
        x = batch.column(j).to_numpy(zero_copy_only=False)[there].astype(float)
        at = np.searchsorted(pivots[j], x)
        hit = np.append(pivots[j], np.nan)[at] == x
        return x, 2 * at + hit, batch.column(len(pivots)).to_numpy()[there]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros((k + 1) * (2 * len(p) + 1), np.int64) for p in pivots]
        for batch in batches:
            for j, own in enumerate(counts):
                _, cell, f = places(batch, j)
                own += np.bincount(f * (2 * len(pivots[j]) + 1) + cell, minlength=len(own))
        for j, own in enumerate(counts):
            at = np.flatnonzero(own)
            f, cell = np.divmod(at, 2 * len(pivots[j]) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), j)), pa.array(cell), pa.array(f), pa.array(own[at])], names=["j", "cell", "f", "n"])

    found = narrow.mapInArrow(count, "j long, cell long, f long, n long").groupBy("j", "cell", "f").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    parts = [*range(k), None]
    edges: dict[int | None, list[set]] = {v: [set() for _ in pivots] for v in parts}
    inside: dict[tuple[int, int, int], list[int]] = {}
    for i, v in enumerate(parts):
        taken = found if v is None else found[(found["f"] != v) & (found["f"] < k)]
        for j, own in taken.groupby(["j", "cell"], as_index=False)["n"].sum().sort_values(["j", "cell"]).groupby("j"):
            cells, upto = own["cell"].to_numpy(), np.cumsum(own["n"].to_numpy())
            for q in [*(b / bins for b in range(1, bins)), 1.0]:
                rank = max(1, math.ceil(round(float(upto[-1]) * q, 9)))
                at = int(np.searchsorted(upto, rank))
                if cells[at] % 2:
                    edges[v][j].add(float(pivots[j][cells[at] // 2]))
                else:
                    inside.setdefault((i, int(j), int(cells[at])), []).append(rank - int(upto[at - 1] if at else 0))
    if inside:
        wanted = [np.unique(np.array([c for _, i, c in inside if i == j], np.int64)) for j in range(len(pivots))]

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for j in range(len(pivots)):
                    x, cell, f = places(batch, j)
                    own = np.isin(cell, wanted[j])
                    columns = [pa.array(np.full(own.sum(), j)), pa.array(cell[own]), pa.array(f[own].astype(np.int64)), pa.array(x[own])]
                    yield pa.RecordBatch.from_arrays(columns, names=["j", "cell", "f", "value"])

        picked = narrow.mapInArrow(pick, "j long, cell long, f long, value double")
        own = lambda v: F.count("*") if v is None else F.count_if((F.col("f") != v) & (F.col("f") < k))
        counted = picked.groupBy("j", "cell", "value").agg(*[own(v).alias(f"k{i}") for i, v in enumerate(parts)])
        window = Window.partitionBy("j", "cell").orderBy("value")
        summed = counted.select("*", *[F.sum(f"k{i}").over(window).alias(f"upto{i}") for i in range(len(parts))])
        sums = [F.struct(F.lit(i).cast("long").alias("i"), F.col(f"k{i}").alias("k"), F.col(f"upto{i}").alias("upto")) for i in range(len(parts))]
        ranks = narrow.sparkSession.createDataFrame([(*at, sorted(set(r))) for at, r in inside.items()], "i long, j long, cell long, ranks array<long>")
        met = summed.select("j", "cell", "value", F.inline(F.array(*sums))).join(F.broadcast(ranks), ["i", "j", "cell"])
        for r in met.where(F.exists("ranks", lambda x: (x <= F.col("upto")) & (x > F.col("upto") - F.col("k")))).select("i", "j", "value").collect():
            edges[parts[r["i"]]][r["j"]].add(r["value"])
    return {v: [np.unique(np.array(list(e), float)) for e in own] for v, own in edges.items()}


def code_rows(
    rows: DataFrame, features: Sequence[str], target: str, weight: str | None, edges: list[np.ndarray], fold: str | None = None, k: int = 0
) -> DataFrame:
    """hash, y, w (empty without a weight), fold, codes (per feature the values of its edges at or below a row's) and margin
    (empty until scores are written): arrays of a batch's rows.  A code is a byte; with a fold, two bytes, as edges are
    those of many fits, and the place behind the last is missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.empty((len(edges), batch.num_rows), np.uint16 if fold else np.uint8)
            for j, cuts in enumerate(edges):
                x = batch.column(batch.num_columns - len(edges) + j).to_numpy(zero_copy_only=False).astype(float)
                codes[j] = np.where(np.isnan(x), len(cuts) + 1 if fold else MISSING, np.searchsorted(cuts, x, side="right"))
            hashes, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            w = batch.column("w").to_numpy(zero_copy_only=False).astype(float) if weight else EMPTY
            folds = batch.column("fold").to_numpy(zero_copy_only=False).astype(np.int16) if fold else EMPTY
            if batch.num_rows:
                yield packed([(hashes.astype(np.int64), y.astype(np.float32), w, folds, codes, EMPTY)], BLOCK)

    x = [F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(features)]
    more = [F.col(weight).cast("double").alias("w")] if weight else []
    more += [F.coalesce(F.col(fold), F.lit(k)).cast("int").alias("fold")] if fold else []
    narrow = rows.select(F.xxhash64(*[F.col(f) for f in features], F.col(target)).alias("hash"), (F.col(target) == 1).cast("double").alias("y"), *more, *x)
    return narrow.mapInArrow(run, schema_of(BLOCK))


class Coded:
    """Rows coded for fits that each leave out one of ``k`` folds, or none: edges of every fit, one written table of places
    among all of them, and the rows of each label and fold."""

    def __init__(self, rows: DataFrame, features: Sequence[str], target: str, fold: str | None = None, k: int = 0, bins: int = 64):
        rows = rows.where(F.col(target).isNotNull())
        self.features, self.target, self.bins, self.k = list(features), target, bins, k
        rows = rows if fold else rows.withColumn("__fold", F.lit(0))
        fold = fold or "__fold"
        place = F.coalesce(F.col(fold), F.lit(k)).cast("int").alias("f")
        self.counts = {(int(r["y"]), r["f"]): r["n"] for r in rows.groupBy((F.col(target) == 1).alias("y"), place).agg(F.count("*").alias("n")).collect()}
        n = sum(self.counts.values())
        self.edges = fold_edges(rows, features, bins, n, fold, k)
        self.union = [np.unique(np.concatenate(e)) for e in zip(*self.edges.values())]
        coded = code_rows(rows, features, target, None, self.union, fold, k)
        self.state = written(coded.repartition(max(1, -(-n // PART_ROWS))), "coded")

    def rows_of(self, left_out: int | None) -> tuple[int, int]:
        """Rows of labels 0 and 1 of a fit."""
        used = lambda f: left_out is None or (f != left_out and f < self.k)
        return tuple(sum(n for (y, f), n in self.counts.items() if y == label and used(f)) for label in (0, 1))

    def tables(self, left_out: int | None) -> list[np.ndarray]:
        """Per feature the code of a fit for every place among the edges of all fits."""
        own = self.edges[left_out]
        codes = [np.searchsorted(e, np.concatenate([[-np.inf], u]), side="right") for e, u in zip(own, self.union)]
        return [np.append(c, MISSING).astype(np.uint8) for c in codes]


def coded_rows(
    rows: DataFrame, features: Sequence[str], target: str, fold: str | None = None, k: int = 0, bins: int = 64
) -> Coded | None:
    """Rows to share among fits; None where labels are others than 0 and 1, whose weights differ row by row, or where there
    would be too many edges."""
    labels = rows.where(F.col(target).isNotNull()).select(target).distinct().limit(3).collect()
    if any(r[0] not in (0, 1) for r in labels) or (k + 1) * bins > MOST_SHARED:
        return None
    return Coded(rows, features, target, fold, k, bins)


#: Columns of the coded rows, and of those that a round draws.
BLOCK, DRAWN = ("hash", "y", "w", "fold", "codes", "margin"), ("codes", "g", "h")
EMPTY = np.empty(0)


def schema_of(names: Sequence[str]) -> str:
    return ", ".join(f"{n} binary" for n in names)


def packed(blocks: list[tuple[np.ndarray, ...]], names: Sequence[str]) -> pa.RecordBatch:
    """A row of bytes for each block of arrays."""
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in column], pa.binary()) for column in zip(*blocks)], names=list(names))


def unpacked(batch: pa.RecordBatch, kinds: Sequence[type]) -> Iterator[list[np.ndarray]]:
    for i in range(batch.num_rows):
        yield [np.frombuffer(batch.column(j)[i].as_buffer(), kind) for j, kind in enumerate(kinds)]


class Router:
    """A tree over codes: rows with a code of at most a node's go left, and ``missing`` where the node says; leaves lead to
    themselves."""

    def __init__(self, tree: T.Tree, columns: np.ndarray | None = None, missing: int = MISSING):
        is_split, own = tree.feature >= 0, np.arange(len(tree.feature))
        place = tree.feature if columns is None else np.searchsorted(columns, tree.feature)
        self.line = np.where(is_split, place, 0).astype(np.int32)
        self.code = np.where(is_split, np.floor(np.where(is_split, tree.threshold, 0.0)), 0).astype(np.int32)
        self.kids = np.where(is_split, np.stack([tree.left, tree.right]), own).T.ravel().astype(np.int32)
        self.missing_right = ~tree.missing_left
        self.value, self.missing, self.depth, level = tree.value, missing, 0, np.flatnonzero(is_split[:1])
        while len(level):
            self.depth += 1
            level = np.concatenate([tree.left[level], tree.right[level]])
            level = level[is_split[level]]

    def leaf_of(self, codes: np.ndarray) -> np.ndarray:
        """Leaf of every row of codes, a line of the array per feature."""
        n, flat = codes.shape[1], codes.ravel()
        out, line, kids = np.empty(n, np.intp), self.line.astype(np.intp) * n, self.kids.astype(np.intp)
        cut = self.code.astype(codes.dtype)
        some_missing = bool((codes == self.missing).any())
        for start in range(0, n, ROUTED):
            at = np.arange(start, min(n, start + ROUTED))
            node = np.zeros(len(at), np.intp)
            for _ in range(self.depth):
                code = flat.take(line.take(node) + at)
                right = code > cut.take(node)
                if some_missing:
                    right = np.where(code == self.missing, self.missing_right.take(node), right)
                node = kids.take(2 * node + right)
            out[start : start + len(at)] = node
        return out


def thresholds(trees: Sequence[T.Tree], width: int) -> list[np.ndarray]:
    """Per feature the distinct values at which any of the trees splits it."""
    feature = np.concatenate([np.empty(0, np.int64), *(t.feature for t in trees)])
    threshold = np.concatenate([EMPTY, *(t.threshold for t in trees)])
    return [np.unique(threshold[feature == j]) for j in range(width)]


def over_places(tree: T.Tree, cuts: list[np.ndarray]) -> T.Tree:
    """A tree over values as one over a row's places among ``cuts``: below a cut are the places up to the cut's own."""
    place = np.zeros(len(tree.feature))
    for j, own in enumerate(cuts):
        at = tree.feature == j
        place[at] = np.searchsorted(own, tree.threshold[at])
    return replace(tree, threshold=place, cover=EMPTY, gain=EMPTY)


class Pass:
    """What tasks need for a pass: the trees since the scores were written, how rows of this round are drawn, and, until the
    scores are written, where they start, the weights of labels 0 and 1 and how to read the codes of shared rows."""

    def __init__(
        self, width: int, extra: list[tuple[T.Tree, float]], unit: float, seed: int, rows: float, top: float | None = None,
        base: float = 0.0, label_weights: tuple[float, float] = (1.0, 1.0), tables: list[np.ndarray] | None = None,
        left_out: int | None = None, k: int = 0,
    ):
        self.width, self.extra, self.unit, self.seed, self.rows, self.top = width, extra, unit, seed, rows, top
        self.base, self.label_weights, self.tables, self.left_out, self.k = base, label_weights, tables, left_out, k

    def own_rows(self, codes: np.ndarray, folds: np.ndarray, rest: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """Codes of this fit, and the other arrays, of the rows that are not left out."""
        places = codes.view(np.uint16).reshape(self.width, -1)
        if self.left_out is not None:
            at = np.flatnonzero((folds != self.left_out) & (folds < self.k))
            places, rest = places.take(at, axis=1), tuple(x.take(at) for x in rest)
        codes = np.empty(places.shape, np.uint8)
        for j, table in enumerate(self.tables):
            codes[j] = table.take(places[j])
        return codes, *rest

    def read(self, batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, ...]]]:
        """codes (a line per feature), y, w, margin and hash of the blocks of each batch."""
        routers = [(Router(tree), weight) for tree, weight in self.extra]
        for batch in batches:
            blocks = []
            for hashes, y, w, folds, codes, held in unpacked(batch, (np.int64, np.float32, float, np.int16, np.uint8, float)):
                if len(folds):
                    codes, hashes, y = self.own_rows(codes, folds, (hashes, y))
                codes = codes.reshape(self.width, -1)
                w = w if len(w) else np.where(y > 0, self.label_weights[1], self.label_weights[0])
                margin = held.copy() if len(held) else np.full(len(y), self.base)
                for router, weight in routers:
                    margin += weight * router.value.take(router.leaf_of(codes))
                blocks.append((codes, y, w, margin, hashes))
            yield blocks

    def gradient_sizes(self, y, w, margin) -> np.ndarray:
        """Rows by size of gradient, in 4096ths of the unit."""
        p = 1.0 / (1.0 + np.exp(-margin))
        return np.bincount(np.minimum(np.abs(w * (p - y) * self.unit) * 4096 / UNIT, 4097).astype(np.int64), minlength=4098)

    def gradients(self, y, w, margin, hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whole-number gradients and Hessians, and which rows this round uses."""
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = w * (p - y) * self.unit, w * p * (1 - p) * self.unit
        used = w > 0
        if self.top is not None:  # all rows of large gradient, some of the others, weighed up
            small = np.abs(g) < self.top
            drawn = draws(hashes, self.seed) < OTHER / (1 - TOP)
            used &= ~small | drawn
            g, h = np.where(small, g * (1 - TOP) / OTHER, g), np.where(small, h * (1 - TOP) / OTHER, h)
        elif self.rows < 1:
            used &= draws(hashes, self.seed) < self.rows
        return np.rint(g), np.rint(h), used


def sizes_of_gradients(state: DataFrame, step: Pass) -> float:
    """Size of gradient (in units) that a share TOP of the rows reaches, to a 4096th of the unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(4098, np.int64)
        for blocks in step.read(batches):
            for _, y, w, margin, _ in blocks:
                counts += step.gradient_sizes(y, w, margin)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])

    counts = np.zeros(4098, np.int64)
    for r in state.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]
    return top_size(counts)


def top_size(counts: np.ndarray) -> float:
    upto = np.cumsum(counts[::-1])
    at = len(counts) - 1 - int(np.searchsorted(upto, TOP * upto[-1]))
    return at * UNIT / 4096 if upto[-1] else 0.0


def drawn_rows(state: DataFrame, step: Pass, columns: np.ndarray) -> DataFrame:
    """codes of the round's columns, gradients and Hessians of the rows that it uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in step.read(batches):
            out = []
            for codes, y, w, margin, hashes in blocks:
                g, h, used = step.gradients(y, w, margin, hashes)
                at = np.flatnonzero(used)
                if len(at):  # at most 2^24 times the weight of a row that stands for others, which 32 bits hold
                    out.append((np.stack([codes[c].take(at) for c in columns]), g[at].astype(np.int32), h[at].astype(np.int32)))
            if out:
                yield packed(out, DRAWN)

    return state.mapInArrow(run, schema_of(DRAWN))


def histograms(drawn: DataFrame, tasks: int, tree: T.Tree, slots: dict[int, int], columns: np.ndarray, bins: int) -> np.ndarray:
    """(slot, column, code, [gradient, Hessian, rows]) of the leaves named in ``slots``; codes reach to ``bins``, the last
    place is missing."""
    places = np.full(len(tree.feature), -1)
    for leaf, slot in slots.items():
        places[leaf] = slot
    shape = (len(slots), len(columns), bins + 2)
    size = len(slots) * (bins + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, router = np.zeros((3, len(columns), size), np.int64), Router(tree, columns)
        for batch in batches:
            for codes, g, h in unpacked(batch, (np.uint8, np.int32, np.int32)):
                codes = codes.reshape(len(columns), -1)
                at = places.take(router.leaf_of(codes))
                if at.min() < 0:
                    own = np.flatnonzero(at >= 0)
                    codes, g, h, at = codes.take(own, axis=1), g.take(own), h.take(own), at.take(own)
                if not len(at):
                    continue
                start, g, h = at * (bins + 2), g.astype(float), h.astype(float)
                for c in range(len(columns)):
                    cell = start + np.where(codes[c] == MISSING, bins + 1, codes[c])
                    if size <= 4 * len(at):  # sums of whole numbers below 2^53 are exact
                        for k, values in enumerate((g, h, None)):
                            sums[k, c] += np.bincount(cell, values, size).astype(np.int64)
                    else:
                        for k, values in enumerate((g, h, 1)):
                            np.add.at(sums[k, c], cell, values if k == 2 else values.astype(np.int64))
        flat = sums.reshape(3, -1)
        at = np.flatnonzero(flat[2])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x[at]) for x in flat)], names=["cell", "g", "h", "n"])

    found = drawn.mapInArrow(run, "cell long, g long, h long, n long")
    if tasks * size * len(columns) > MOST_SUMS:
        found = found.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    found = found.toArrow()
    out = np.zeros((len(columns) * size, 3), np.int64)
    for k, name in enumerate(("g", "h", "n")):
        np.add.at(out[:, k], found.column("cell").to_numpy(), found.column(name).to_numpy())
    return out.reshape(len(columns), len(slots), bins + 2, 3).swapaxes(0, 1).reshape(*shape, 3)


class Node:
    """``sums`` are kept while the children are not known, ``total`` is whole numbers of gradient, Hessian and rows, and a split
    is (gain, column, code, missing left, total of the left side): rows with a code of at most ``code`` go left."""

    __slots__ = ("sums", "total", "depth", "split", "children", "number")

    def __init__(self, sums: np.ndarray | None, total: tuple[int, int, int], depth: int, number: int):
        self.sums, self.total, self.depth, self.number = sums, total, depth, number
        self.split: tuple | None = None
        self.children: tuple[Node, Node] | None = None


def shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def may_split(total: tuple[int, int, int], depth: int, s: dict, unit: float) -> bool:
    """Whether two sides with the least rows and Hessian can come out of a node."""
    return depth < s["depth"] and total[2] >= 2 * max(1, s["min_leaf"]) and total[1] / unit >= 2 * s["min_weight"] * (1 - 1e-9)


def side_totals(node: Node) -> tuple[tuple, tuple]:
    """Totals left and right of a node's split."""
    left = node.split[4]
    return left, tuple(a - b for a, b in zip(node.total, left))


def best_splits(sums: np.ndarray, s: dict, unit: float) -> list[tuple | None]:
    """The best split of each node by its sums (node, column, code, [gradient, Hessian, rows])."""
    out: list[tuple | None] = []
    for start in range(0, len(sums), SEARCHED):
        whole = np.ascontiguousarray(np.moveaxis(sums[start : start + SEARCHED], -1, 0))
        x = whole.astype(float)
        x[:2] /= unit
        total = np.cumsum(x[:, :, 0], axis=-1)[:, :, -1, None, None, None]
        below = np.cumsum(x[..., :-1], axis=-1)[..., :-1]
        sides = np.stack([below, below + x[..., -1:]], axis=2)  # missing right, missing left
        other = total - sides

        def worth(x: np.ndarray) -> np.ndarray:
            return np.maximum(np.abs(x[0]) - s["alpha"], 0.0) ** 2 / (x[1] + s["lambda_"] + 1e-12)

        gain = 0.5 * (worth(sides) + worth(other) - worth(total))
        fit = (np.minimum(sides[2], other[2]) >= max(1, s["min_leaf"])) & (np.minimum(sides[1], other[1]) >= s["min_weight"])
        flat = np.where(fit, gain, -np.inf).reshape(len(gain), -1)
        if not flat.shape[1]:
            out += [None] * len(gain)
            continue
        best, lines = flat.argmax(axis=1), np.arange(len(gain))
        most = flat[lines, best]
        side, column, code = np.unravel_index(best, gain.shape[1:])
        left = np.cumsum(whole[..., :-1], axis=-1)[:, lines, column, code] + side * whole[:, lines, column, -1]
        found = zip(most.tolist(), column.tolist(), code.tolist(), (side > 0).tolist(), map(tuple, left.T.tolist()))
        out += [split if split[0] > max(s["min_gain"], 0.0) else None for split in found]
    return out


def as_tree(nodes: list[Node], columns: np.ndarray, s: dict, unit: float, chosen: set[int] | None = None) -> T.Tree:
    """Node table over codes; ``chosen`` are the split nodes (all that have children if not given)."""
    kept, place = [nodes[0]], {}
    for node in kept:  # grows as its nodes' children are found
        place[node.number] = len(place)
        if node.children and (chosen is None or node.number in chosen):
            kept += node.children
    is_split = np.array([bool(n.children) and (chosen is None or n.number in chosen) for n in kept])
    asked = [(*n.split[:4], place[n.children[0].number], place[n.children[1].number]) if k else (0.0, 0, 0, False, -1, -1) for n, k in zip(kept, is_split)]
    gain, column, code, missing_left, left, right = (np.array(x) for x in zip(*asked))
    total = np.array([n.total for n in kept], float)
    value = -shrunk(total[:, 0] / unit, s["alpha"]) / (total[:, 1] / unit + s["lambda_"] + 1e-12)
    return T.tree_of(
        {
            "feature": np.where(is_split, np.asarray(columns)[column], -1),
            "threshold": np.where(is_split, code + 0.5, 0.0),
            "missing_left": missing_left,
            "left": left,
            "right": right,
            "value": np.where(is_split, 0.0, value),
            "cover": total[:, 2],
            "gain": gain,
        }
    )


def chosen_splits(root: Node, leaves: int | None) -> tuple[set[int], list[Node]]:
    """Splits in the order of their gain until there are enough leaves, and those of them whose children are not summed yet."""
    heap, chosen, unknown = [(-root.split[0], root.number, root)] if root.split else [], set(), []
    while heap and (leaves is None or len(chosen) < leaves - 1):
        _, number, node = heapq.heappop(heap)
        chosen.add(number)
        if node.children is None:
            unknown.append(node)
            continue
        for child in node.children:
            if child.split:
                heapq.heappush(heap, (-child.split[0], child.number, child))
    return chosen, unknown


class Spread:
    """Coded rows of a fit as a table: a pass of all tasks for each level of a tree."""

    def __init__(self, state: DataFrame):
        self.state, self.tasks = state, state.rdd.getNumPartitions()

    def top(self, step: Pass) -> float:
        return sizes_of_gradients(self.state, step)

    def tree(self, step: Pass, columns: np.ndarray, bins: int, s: dict) -> T.Tree:
        with kept(drawn_rows(self.state, step, columns)) as drawn:
            sums = lambda tree, slots: histograms(drawn, self.tasks, tree, slots, columns, bins)
            root = lambda: sums(LEAF, {0: 0})
            return grow(root, lambda nodes, part: sums(*probe_tree(nodes, part, columns)), columns, bins, s, step.unit)

    def rewrite(self, step: Pass) -> None:
        self.state = written(rescored(self.state, step), "coded")


class Held:
    """Coded rows of a fit in the memory of one task."""

    def __init__(self, blocks: list[tuple[np.ndarray, ...]], bins: int, again: bool):
        """``again``: whether trees are asked for after their scores are written."""
        codes, self.y, self.w, self.margin, self.hashes = (np.concatenate(x, axis=-1) for x in zip(*blocks))
        self.codes = np.where(codes == MISSING, np.uint8(bins + 1), codes)
        self.bins, self.again, self.leaves, self.room = bins, again, {}, LEAF_BYTES

    def values_of(self, tree: T.Tree) -> tuple[np.ndarray, np.ndarray]:
        """Values of a tree's leaves, and the place among them of each row; remembered while there is room."""
        if id(tree) not in self.leaves:
            is_leaf = tree.feature < 0
            rank = (np.cumsum(is_leaf) - 1).astype(np.min_scalar_type(int(is_leaf.sum())))
            found = tree.value[is_leaf], rank.take(Router(tree, missing=self.bins + 1).leaf_of(self.codes))
            if found[1].nbytes > self.room:
                return found
            self.room -= found[1].nbytes
            self.leaves[id(tree)] = found
        return self.leaves[id(tree)]

    def scores(self, step: Pass) -> np.ndarray:
        margin = self.margin.copy()
        for tree, weight in step.extra:
            values, at = self.values_of(tree)
            margin += (weight * values).take(at)
        return margin

    def top(self, step: Pass) -> float:
        return top_size(step.gradient_sizes(self.y, self.w, self.scores(step)))

    def tree(self, step: Pass, columns: np.ndarray, bins: int, s: dict) -> T.Tree:
        g, h, used = step.gradients(self.y, self.w, self.scores(step), self.hashes)
        at = np.flatnonzero(used)
        drawn = HeldDrawn(self.codes.take(columns, axis=0).take(at, axis=1), g[at], h[at], bins)
        return grow(drawn.root, drawn.children, columns, bins, s, step.unit)

    def rewrite(self, step: Pass) -> None:
        self.margin = self.scores(step)
        if not self.again:
            self.leaves, self.room = {}, LEAF_BYTES


class HeldDrawn:
    """Rows that a round draws, and the node that each has come to."""

    def __init__(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int):
        self.codes, self.g, self.h, self.bins = codes, g, h, bins
        self.node = np.zeros(len(g), np.intp)
        self.some_missing = bool((codes == bins + 1).any())

    def root(self) -> np.ndarray:
        return self.sums(np.arange(len(self.g)), self.node, 1)

    def children(self, nodes: list[Node], part: list[tuple[Node, int]]) -> np.ndarray:
        """Moves the rows of the nodes of ``part`` to their children, and sums one child of each."""
        place = np.full(len(nodes), -1)
        place[[node.number for node, _ in part]] = np.arange(len(part))
        at = place.take(self.node)
        own = np.flatnonzero(at >= 0)
        at = at.take(own)
        column, cut, missing_right = (np.array(x) for x in zip(*((node.split[1], node.split[2], not node.split[3]) for node, _ in part)))
        kids = np.array([child.number for node, _ in part for child in node.children])
        code = self.codes.ravel().take((column * len(self.g)).take(at) + own)
        right = code > cut.astype(np.uint8).take(at)
        if self.some_missing:
            right = np.where(code == self.bins + 1, missing_right.take(at), right)
        self.node[own] = kids.take(2 * at + right)
        mine = np.flatnonzero(right == np.array([bool(side) for _, side in part]).take(at))
        return self.sums(own.take(mine), at.take(mine), len(part))

    def sums(self, own: np.ndarray, at: np.ndarray, slots: int) -> np.ndarray:
        """(slot, column, code, [gradient, Hessian, rows]); sums of whole numbers below 2^53 are exact."""
        width = self.bins + 2
        out = np.empty((slots, len(self.codes), width, 3), np.int64)
        start, g, h = at * width, self.g.take(own), self.h.take(own)
        for c in range(len(self.codes)):
            cell = start + self.codes[c].take(own)
            for k, values in enumerate((g, h, None)):
                out[:, c, :, k] = np.bincount(cell, values, slots * width).reshape(slots, width)
        return out


#: A tree of one leaf.
LEAF = T.tree_of({"feature": [-1], "threshold": [0], "missing_left": [False], "left": [-1], "right": [-1], "value": [0], "cover": [1], "gain": [0]})


def grow(root: Callable, children: Callable, columns: np.ndarray, bins: int, s: dict, unit: float) -> T.Tree:
    """One tree over codes. ``root`` gives the sums of all drawn rows, ``children`` those of one child of each named node."""
    whole = root()
    nodes = [Node(whole[0], tuple(whole[0, 0].sum(axis=0).tolist()), 0, 0)]
    nodes[0].split = best_splits(whole, s, unit)[0] if s["depth"] > 0 else None
    at_once, level = max(1, MOST_CELLS // (len(columns) * (bins + 2))), nodes[:]
    while True:
        if s["leaves"] is None:  # all splits are taken: those of the last pass are the unknown ones
            chosen, unknown = None, [node for node in level if node.split]
        else:
            chosen, unknown = chosen_splits(nodes[0], s["leaves"])
        if not unknown:
            return as_tree(nodes, columns, s, unit, chosen)
        level = []
        asked: list[tuple[Node, int]] = []  # nodes with a child that may be split, and the side to sum
        for node in unknown:
            pair = []
            for total in side_totals(node):
                pair.append(Node(None, total, node.depth + 1, len(nodes)))
                nodes.append(pair[-1])
            node.children = (pair[0], pair[1])
            may = [may_split(child.total, child.depth, s, unit) for child in pair]
            if any(may):
                smaller = int(pair[1].total[2] < pair[0].total[2])
                asked.append((node, smaller if all(may) else may.index(True)))
            else:
                node.sums = None
        for start in range(0, len(asked), at_once):
            part = asked[start : start + at_once]
            found = children(nodes, part)
            rest = np.stack([node.sums for node, _ in part]) - found
            open_, sums = [], []
            for slot, (node, side) in enumerate(part):
                node.sums = None  # only the total is needed from here on
                for child, own in ((node.children[side], found[slot]), (node.children[1 - side], rest[slot])):
                    if may_split(child.total, child.depth, s, unit):
                        open_.append(child)
                        sums.append(own)
            for child, own, split in zip(open_, sums, best_splits(np.stack(sums), s, unit)):
                child.split = split
                child.sums = own if split else None
            level += open_


def probe_tree(nodes: list[Node], part: list[tuple[Node, int]], columns: np.ndarray) -> tuple[T.Tree, dict[int, int]]:
    """Node table of the tree as known so far, and the slots of the children to sum, one of each node of ``part``."""
    slot = {node.children[side].number: i for i, (node, side) in enumerate(part)}
    lists: dict[str, list] = {k: [] for k in T.Tree.__dataclass_fields__}
    names: dict[int, int] = {}

    def add(feature=-1, threshold=0.0, missing_left=False) -> int:
        row = {"feature": feature, "threshold": threshold, "missing_left": missing_left, "left": -1, "right": -1, "value": 0.0, "cover": 1.0, "gain": 0.0}
        for k, v in row.items():
            lists[k].append(v)
        return len(lists["feature"]) - 1

    def visit(node: Node) -> int:
        if node.number in slot:
            names[len(lists["feature"])] = slot[node.number]
        if node.children is None:
            return add()
        _, column, code, missing_left, _ = node.split
        at = add(int(columns[column]), code + 0.5, missing_left)
        lists["left"][at] = visit(node.children[0])
        lists["right"][at] = visit(node.children[1])
        return at

    visit(nodes[0])
    return T.tree_of(lists), names


def with_thresholds(tree: T.Tree, edges: list[np.ndarray]) -> T.Tree:
    """A tree over codes as a tree over values: a code of at most c means a value below edge c, or any value at all."""
    cuts = np.zeros(len(tree.feature))
    for f, own in enumerate(edges):
        at = tree.feature == f
        cuts[at] = np.append(own, np.inf).take(np.minimum(tree.threshold[at].astype(np.intp), len(own)))
    return replace(tree, threshold=cuts)


def rescored(state: DataFrame, step: Pass) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in step.read(batches):
            if blocks:
                yield packed([(hashes, y, w, EMPTY, codes, margin) for codes, y, w, margin, hashes in blocks], BLOCK)

    return state.mapInArrow(run, state.schema)


def fit_histogram_boosting(
    rows: DataFrame, features: Sequence[str], target: str, weight: str | None, settings: dict, bins: int = 64, seed: int = 42
) -> PipelineModel:
    """Boosted trees with the settings of a profile; ``boosting`` is gbdt, dart (trees dropped at random while the next one is
    fitted) or goss (rows of small gradient sampled).  A missing value goes to the better side of each split.  Rows that agree
    in all features and the target are drawn together."""
    if not 2 <= bins <= MOST_BINS:
        raise ValueError(f"bins must lie between 2 and {MOST_BINS}")
    features = list(features)
    amount = F.col(weight).cast("double") if weight else F.lit(1.0)
    total, positive, largest, n = rows.agg(F.sum(amount), F.sum(F.when(F.col(target) == 1, amount)), F.max(amount), F.count("*")).first()
    edges = bin_edges(rows, features, bins, n)
    state = written(code_rows(rows, features, target, weight, edges).repartition(max(1, -(-n // PART_ROWS))), "coded")
    return boosted(state, features, edges, (total, positive, largest), n, settings, bins, seed)


def fit_coded(coded: Coded, left_out: int | None, label_weights: tuple[float, float], settings: dict, seed: int = 42) -> PipelineModel:
    """The same on shared rows but those of one fold, with a weight for each of the labels 0 and 1."""
    n = coded.rows_of(left_out)
    zero, one = (a * b for a, b in zip(n, label_weights))
    totals = (zero + one, one, max((w for w, rows in zip(label_weights, n) if rows), default=None))
    reading = {"label_weights": label_weights, "tables": coded.tables(left_out), "left_out": left_out, "k": coded.k}
    return boosted(coded.state, coded.features, coded.edges[left_out], totals, sum(n), settings, coded.bins, seed, reading)


def boosted(
    state: DataFrame, features: list[str], edges: list[np.ndarray], totals: tuple, n: int, settings: dict, bins: int, seed: int,
    reading: dict | None = None,
) -> PipelineModel:
    """The rounds, on ``n`` coded rows.  ``totals`` are the weights' sum, that of label 1 and the largest."""
    s = dict(settings)
    if s["boosting"] not in ("gbdt", "gbtree", "dart", "goss"):
        raise ValueError(f"unknown boosting {s['boosting']!r}")
    total, positive, largest = totals
    share = min(max((positive or 0.0) / total, 1e-6), 1 - 1e-6) if total else 0.5
    base = float(np.log(share / (1 - share)))
    reading = {"unit": UNIT / (largest or 1.0), "base": base, **(reading or {})}
    if not total:
        forest, weights = [], []
    elif n <= TASK_ROWS and s["rounds"] > REWRITE:
        forest, weights = rounds_in_task(state, len(features), s, bins, seed, reading)
    else:
        forest, weights = rounds_of(Spread(state), len(features), s, bins, seed, reading)
    done = [with_thresholds(t, edges) for t in forest]
    return PipelineModel(stages=[BoostedScorer(features, T.dump(done), weights, base)])


def rounds_of(rows: Spread | Held, width: int, s: dict, bins: int, seed: int, reading: dict) -> tuple[list[T.Tree], list[float]]:
    """Trees over codes and their weights."""
    forest: list[T.Tree] = []
    weights: list[float] = []
    held: list[float] = []  # weights in the written scores
    for turn in range(s["rounds"]):
        rng = np.random.default_rng([seed, turn])
        columns = np.sort(rng.permutation(width)[: max(1, int(np.ceil(s["subset"] * width)))])
        out: list[int] = []
        if s["boosting"] == "dart" and forest and rng.random() >= s["skip"]:
            out = [int(i) for i in np.flatnonzero(rng.random(len(forest)) < s["drop"])][: s["most_dropped"]]
        now = [0.0 if i in set(out) else w for i, w in enumerate(weights)]
        extra = [(t, a - b) for t, a, b in zip(forest, now, held) if a != b]
        step = Pass(width, extra, seed=seed * 1_000_003 + turn, rows=s["rows"], **reading)
        if s["boosting"] == "goss":
            step.top = rows.top(step)
        forest.append(rows.tree(step, columns, bins, s))
        weights = [w * len(out) / (len(out) + 1) if i in set(out) else w for i, w in enumerate(weights)] + [s["step"] / (len(out) + 1)]
        held.append(0.0)
        if (turn + 1) % REWRITE == 0 and s["rounds"] - turn - 1 >= FEW:
            changed = [(t, a - b) for t, a, b in zip(forest, weights, held) if a != b]
            rows.rewrite(Pass(width, changed, seed=0, rows=1.0, **reading))
            held = list(weights)
    return forest, weights


#: How a task hands on the columns of a tree.
TREE_KINDS = {"feature": np.int32, "threshold": float, "missing_left": bool, "left": np.int32, "right": np.int32, "value": float, "cover": float, "gain": float}


def rounds_in_task(state: DataFrame, width: int, s: dict, bins: int, seed: int, reading: dict) -> tuple[list[T.Tree], list[float]]:
    """The same in one task, which holds the rows: one job for all rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [b for read in Pass(width, [], seed=0, rows=1.0, **reading).read(batches) for b in read]
        if blocks:
            forest, weights = rounds_of(Held(blocks, bins, s["boosting"] == "dart"), width, s, bins, seed, reading)
            for i, (tree, weight) in enumerate(zip(forest, weights)):
                columns = [pa.array([getattr(tree, name).astype(kind).tobytes()], pa.binary()) for name, kind in TREE_KINDS.items()]
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([weight]), *columns], names=["at", "weight", *TREE_KINDS])

    found = state.coalesce(1).mapInArrow(run, "at long, weight double, " + schema_of(TREE_KINDS)).toArrow().to_pylist()
    found.sort(key=lambda r: r["at"])
    trees = [T.tree_of({name: np.frombuffer(r[name], kind) for name, kind in TREE_KINDS.items()}) for r in found]
    return trees, [r["weight"] for r in found]


def boosted_importance(spark: SparkSession, model: PipelineModel, kind: str = "split") -> DataFrame:
    """(feature, importance) of a boosted model: how many splits use a feature, or the gain they brought."""
    names, forest, _, _ = model.stages[-1].parts()
    totals = dict.fromkeys(names, 0.0)
    for tree in forest:
        for f, gain in zip(tree.feature, tree.gain):
            if f >= 0:
                totals[names[f]] += 1.0 if kind == "split" else float(gain)
    table = spark.createDataFrame(list(totals.items()), "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature")
