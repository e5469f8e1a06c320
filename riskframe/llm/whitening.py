"""Whitening of embeddings through a bidiagonal qd solver.

Rows become whole numbers, exact sums centre them, and each task reduces its centred rows to a triangle by blockwise QR;
triangles meet sixteen at a time.  On the last one (dimensions squared, whatever the rows) Householder reflections make a
bidiagonal, dqds finds its singular values, and twisted factorisations give the directions.  A covariance matrix is never
formed, so small eigenvalues keep their digits.

Defined results: vectors that are null or hold nulls or non-finite entries are left out, and so are those whose length is
not the most frequent one (of equally frequent ones the longest).  Entries beyond 2^30 count as 2^30.  Repeated rows count
as often as they stand there, ids may repeat or be null.  A component without variance (all rows the same, fewer rows than
components) has no whitened value (null) and does not enter the identity error.  A deviation that does not fit a long is
null.  An empty table, or one without a usable vector, gives no rows.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import only, written

SCALE, SHIFT = 1024, 100_000
ENTRY_LIMIT = float(2**30)
COMPONENTS = 8
#: Triangles that meet in one task.
FAN_IN = 16
EPS = float(np.finfo(float).eps)


# --- rows ------------------------------------------------------------------------------------------------------------


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Columns ``id`` and ``v`` (array of double) of the rows that hold a vector of finite numbers."""
    rows = only(df, key, vector).select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(F.col("v").isNotNull() & ~bad & (F.size("v") > 0))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def whole(vectors: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(vectors, -ENTRY_LIMIT, ENTRY_LIMIT) * SCALE).astype(np.int64) + SHIFT


def sums_of(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = whole(matrix(batch.column("v"), width))
                yield pa.RecordBatch.from_pydict({"n": [len(x)], "s": [x.sum(axis=0).tolist()]})

    return run


class Centre:
    """Row minus mean, with the mean's whole part taken off before anything is rounded."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.floor = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of (n x - S)^2 per row; null where it does not fit a long."""
        about = (self(x) * float(self.n)) ** 2
        spread = x - self.floor
        rest = np.array([s % self.n for s in self.sums], dtype=np.int64)
        with np.errstate(over="ignore"):
            exact = ((spread * self.n - rest) ** 2).sum(axis=1).tolist()
        for i in np.flatnonzero(about.sum(axis=1) > 9.2e18):
            total = sum((self.n * int(a) - s) ** 2 for a, s in zip(x[i], self.sums))
            exact[i] = total if total < 2**63 else None
        return exact


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def padded(r: np.ndarray, width: int) -> list[float]:
    out = np.zeros((width, width))
    out[: len(r)] = r
    return out.ravel().tolist()


def triangles_of(centre: Centre, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            if batch.num_rows:
                r = triangle(np.vstack([r, centre(whole(matrix(batch.column("v"), width)))]))
        if len(r):
            yield pa.RecordBatch.from_pydict({"lane": [TaskContext.get().partitionId()], "r": [padded(r, width)]})

    return run


def met_triangles(width: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = matrix(table.sort_by("lane").column("r"), width * width).reshape(-1, width)
        return pa.table({"lane": [key[0].as_py()], "r": [padded(triangle(rows), width)]}, schema=LANES)

    return run


LANES = pa.schema([("lane", pa.int64()), ("r", pa.list_(pa.float64()))])


# --- the dense part: dimensions squared, on the driver ------------------------------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of U'RV by Householder reflections, and V."""
    a, n = r.copy(), len(r)
    v = np.eye(n)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        w, size = x.copy(), float(np.linalg.norm(x))
        if size == 0.0:
            return w, 0.0
        w[0] += np.copysign(size, x[0])
        return w, 2.0 / float(w @ w)

    for k in range(n):
        w, beta = reflector(a[k:, k])
        a[k:, k:] -= beta * np.outer(w, w @ a[k:, k:])
        if k < n - 2:
            w, beta = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= beta * np.outer(v[:, k + 1 :] @ w, w)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), v


def dqds_pass(q: list[float], e: list[float], lo: int, hi: int, shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential quotient-difference transform of q[lo..hi] with a shift; None if the shift was too large."""
    qq, ee = [], []
    d = least = q[lo] - shift
    for i in range(lo, hi):
        if d < 0.0:
            return None
        top = d + e[i]
        qq.append(top)
        if top == 0.0:
            ee.append(0.0)
            d = q[i + 1] - shift
        else:
            t = q[i + 1] / top
            ee.append(e[i] * t)
            d = d * t - shift
        least = min(least, d)
    if d < 0.0 or not np.isfinite(d):
        return None
    qq.append(d)
    return qq, ee, least


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Singular values of a bidiagonal, falling, each to high relative accuracy."""
    q = (np.asarray(diagonal, float) ** 2).tolist()
    e = (np.asarray(above, float) ** 2).tolist()
    n, found = len(q), []
    blocks = [(0, n - 1, 0.0, None)]
    while blocks:
        lo, hi, moved, least = blocks.pop()
        while True:
            cut = next((i for i in range(hi - 1, lo - 1, -1) if e[i] <= EPS * EPS * (moved + min(q[i], q[i + 1]))), None)
            if cut is not None:
                if cut < hi - 1:
                    blocks.append((lo, cut, moved, None))
                    lo, least = cut + 1, None
                else:
                    found.append(moved + q[hi])
                    hi -= 1
                continue
            if hi == lo:
                found.append(moved + q[lo])
                break
            # the least pivot bounds the least eigenvalue from above; a shift that was too large is cut and tried again
            shift, step = 0.0 if least is None else 0.98 * least, None
            while step is None:
                step = dqds_pass(q, e, lo, hi, shift)
                if step is None and shift == 0.0:
                    raise ArithmeticError("qd transform without a shift broke down")
                shift_used, shift = shift, (shift / 4 if shift > 1e-3 * (least or 0.0) else 0.0)
            q[lo : hi + 1], e[lo:hi], least = step[0], step[1], max(step[2], 0.0)
            moved += shift_used
    return np.sqrt(np.array(sorted(found, reverse=True)))


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> Iterator[np.ndarray]:
    """Eigenvectors of B'B for one eigenvalue from its twisted factorisations, the best twist first."""
    n = len(diagonal)
    d, l = diagonal**2, np.append(above / diagonal[:-1], 0.0) if n > 1 else np.zeros(1)
    tiny = EPS * max(float(d.max()), 1e-300)  # a pivot of rounding size stands for this much
    down, up = np.zeros(n), np.zeros(n)
    s, p = np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):  # stationary: from the top
        pivot = s[i] + d[i]
        if abs(pivot) < tiny:
            pivot, s[i] = -tiny, -tiny - d[i]
        down[i] = d[i] * l[i] / pivot
        s[i + 1] = down[i] * l[i] * s[i] - value
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):  # progressive: from the bottom
        pivot = d[i] * l[i] ** 2 + p[i + 1]
        if abs(pivot) < tiny:
            pivot, p[i + 1] = -tiny, -tiny - d[i] * l[i] ** 2
        up[i] = l[i] * d[i] / pivot
        p[i] = p[i + 1] * (d[i] / pivot) - value
    gamma = np.abs(s + p + value)
    for k in np.argsort(gamma, kind="stable"):
        z = np.zeros(n)
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -down[i] * z[i + 1]
        for i in range(k, n - 1):
            z[i + 1] = -up[i] * z[i]
        size = np.linalg.norm(z)
        if np.isfinite(size) and size > 0:
            yield z / size


def principal(r: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of a triangle, falling, and the right singular vectors of the first ``components`` as columns.

    Vectors of close values are made orthogonal to the ones before; a vector that is lost that way comes from the next
    best twist.  Signs: the entry of largest size is positive.
    """
    size = float(np.abs(r).max()) if r.size else 0.0
    if size == 0.0:
        return np.zeros(len(r)), np.zeros((len(r), 0))
    diagonal, above, v = bidiagonal(r / size)
    values = dqds(diagonal, above)
    # a zero on the diagonal has no factorisation; the least change that rounding makes anyway stands in for it
    floor = EPS * float(values[0])
    held = np.where(np.abs(diagonal) < floor, floor, diagonal)
    count = min(components, int((values > len(r) * EPS * values[0]).sum()))
    columns: list[np.ndarray] = []
    for value in values[:count]:
        best, kept = None, 0.0
        for z in twisted(held, above, float(value) ** 2):
            w = z.copy()
            for _ in range(2):
                for other in columns:
                    w -= (other @ w) * other
            left = float(np.linalg.norm(w))
            if left > kept:
                best, kept = w / left, left
            if left > 0.5:
                break
        columns.append(best)
    vectors = v @ np.array(columns).T
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(count)])
    return values * size, vectors * signs


# --- jobs -----------------------------------------------------------------------------------------------------------------


class Whitening:
    """Fitted directions: ``values`` are all eigenvalues, ``vectors`` the columns kept (components without variance are
    not among them)."""

    def __init__(self, centre: Centre, singular: np.ndarray, vectors: np.ndarray):
        self.centre = centre
        self.values = singular**2 / centre.n
        self.vectors = vectors
        self.scales = vectors / np.sqrt(self.values[: vectors.shape[1]])
        trace = float(self.values.sum())
        self.explained = [float(v) / trace if trace > 0 else None for v in self.values]


def most_frequent_length(rows: DataFrame) -> int:
    sizes = rows.groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).first()
    return sizes["k"] if sizes else 0


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Directions from rows of ``usable`` of one length; what reaches the driver is one triangle."""
    width = len(rows.first()["v"])
    parts = rows.select("v").mapInArrow(sums_of(width), "n long, s array<long>")
    exact = F.sum(F.col("value").cast("decimal(38,0)")).alias("s")
    found = parts.select("n", F.posexplode("s").alias("at", "value")).groupBy("at").agg(exact, F.sum("n").alias("n")).orderBy("at").collect()
    centre = Centre(found[0]["n"], [int(r["s"]) for r in found])
    level = written(rows.select("v").mapInArrow(triangles_of(centre, width), "lane long, r array<double>"), "triangles")
    while (level.agg(F.max("lane")).first()[0] or 0) > 0:
        met = level.withColumn("lane", F.floor(F.col("lane") / FAN_IN)).groupBy("lane")
        level = written(met.applyInArrow(met_triangles(width), "lane long, r array<double>"), "triangles")
    r = np.array(level.first()["r"]).reshape(width, width)
    return Whitening(centre, *principal(r, components))


def projected(model: Whitening, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(matrix(batch.column("v"), width)) if batch.num_rows else np.zeros((0, width), np.int64)
            w = model.centre(x) @ model.scales
            offsets = np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(model.centre.deviations(x), pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(w.ravel(), pa.float64())),
                ],
                ["id", "deviation", "w"],
            )

    return run


def moments_of(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = matrix(batch.column("w"), width)
                mean = w.mean(axis=0)
                about = w - mean
                rows, columns = np.triu_indices(width)
                yield pa.RecordBatch.from_pydict(
                    {
                        "n": [len(w)] * len(rows),
                        "a": rows.tolist(),
                        "b": columns.tolist(),
                        "ma": mean[rows].tolist(),
                        "mb": mean[columns].tolist(),
                        "m2": (about.T @ about)[rows, columns].tolist(),
                    }
                )

    return run


def identity_error(whitened: DataFrame, width: int) -> float | None:
    """Largest entry of |covariance of ``w`` - identity|; blocks are centred by themselves and then brought together."""
    if width == 0:
        return None
    blocks = written(
        whitened.select("w").mapInArrow(moments_of(width), "n long, a long, b long, ma double, mb double, m2 double"), "moments"
    )
    total = blocks.groupBy("a", "b").agg(
        F.sum("n").alias("_n"),
        (F.sum(F.col("n") * F.col("ma")) / F.sum("n")).alias("_ma"),
        (F.sum(F.col("n") * F.col("mb")) / F.sum("n")).alias("_mb"),
    )
    spread = F.col("m2") + F.col("n") * (F.col("ma") - F.col("_ma")) * (F.col("mb") - F.col("_mb"))
    covariance = blocks.join(total, ["a", "b"]).groupBy("a", "b").agg((F.sum(spread) / F.first("_n")).alias("c"))
    one = F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)
    return covariance.agg(F.max(F.abs(F.col("c") - one))).first()[0]


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector: ``key``, n, deviation, ``w`` (whitened values of the components that have variance),
    explained (of all components asked for) and identity_error."""
    rows = usable(df, key, vector)
    width = most_frequent_length(rows)
    kind = dict(rows.dtypes)["id"]
    if width == 0:
        return df.sparkSession.createDataFrame(
            [], f"`{key}` {kind}, n long, deviation long, w array<double>, explained array<double>, identity_error double"
        )
    rows = rows.where(F.size("v") == width)
    model = fit(rows, components)
    done = written(rows.mapInArrow(projected(model, width), f"id {kind}, deviation long, w array<double>"), "whitened")
    error = identity_error(done, model.vectors.shape[1])

    def numbers(values: list) -> Column:
        return F.array(*[F.lit(v).cast("double") for v in values])

    return done.select(
        F.col("id").alias(key),
        F.lit(model.centre.n).cast("long").alias("n"),
        "deviation",
        "w",
        numbers(model.explained[:components]).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def by_component(whitened: DataFrame, key: str = "vec_id") -> DataFrame:
    """A row per vector and component, numbered from 1."""
    return whitened.select(
        key,
        F.posexplode("explained").alias("_at", "explained"),
        "n",
        "deviation",
        "w",
        "identity_error",
    ).select(
        key,
        (F.col("_at") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        F.get("w", F.col("_at")).alias("whitened"),
        "explained",
        "identity_error",
    )
