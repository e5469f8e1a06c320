"""Decision trees as small tables of nodes: evaluated over Arrow batches, explained path by path."""

from __future__ import annotations

import json
import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package


@dataclass(frozen=True)
class Tree:
    """Nodes by number, the root first.  ``feature`` is -1 at a leaf; a row goes left below ``threshold``, and where the
    value is missing if ``missing_left``.  ``cover`` is the number of training rows, ``gain`` what the split brought."""

    feature: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row of a matrix of doubles; NaN is missing."""
        node, lines = np.zeros(len(x), np.int64), np.arange(len(x))
        open_ = lines if len(self.feature) and self.feature[0] >= 0 else lines[:0]
        while len(open_):
            at = node[open_]
            v = x[open_, self.feature[at]]
            goes_left = np.where(np.isnan(v), self.missing_left[at], v < self.threshold[at])
            node[open_] = np.where(goes_left, self.left[at], self.right[at])
            open_ = open_[self.feature[node[open_]] >= 0]
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaf_of(x)]

    def mean(self) -> float:
        """Value over the training rows."""
        leaves = self.feature < 0
        return float(np.average(self.value[leaves], weights=np.maximum(self.cover[leaves], 1e-12)))

    def paths(self) -> list[tuple[float, list[tuple[int, float, float, bool, float]]]]:
        """For each leaf its value and, for each feature on its way, (feature, low, high, takes missing, share): the rows
        with low <= x < high stay on the way, and of the training rows that share."""
        out, todo = [], [(0, {})]
        while todo:
            node, limits = todo.pop()
            f = int(self.feature[node])
            if f < 0:
                out.append((float(self.value[node]), [(k, *v) for k, v in sorted(limits.items())]))
                continue
            low, high, missing, share = limits.get(f, (-np.inf, np.inf, True, 1.0))
            for child, is_left in ((int(self.left[node]), True), (int(self.right[node]), False)):
                part = max(float(self.cover[child]), 1e-12) / max(float(self.cover[node]), 1e-12)
                t = float(self.threshold[node])
                bounds = (low, min(high, t)) if is_left else (max(low, t), high)
                takes = missing and bool(self.missing_left[node]) == is_left
                todo.append((child, {**limits, f: (*bounds, takes, share * part)}))
        return out

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Shapley value of every feature for every row (rows by columns), rows off a path weighed by training rows.

        For a leaf of value v whose way asks m features, feature j gets v (o_j - z_j) times the integral over t in [0, 1] of
        the product over the others of z_i (1 - t) + o_i t, with o_i 1 where the row stays on the way and z_i the share of
        training rows.  The integrand is a polynomial of degree m - 1, so m / 2 Gauss points give it exactly.
        """
        out = np.zeros_like(x, dtype=float)
        for value, way in self.paths():
            m = len(way)
            if not m or value == 0.0:
                continue
            points, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
            points, weights = (points + 1) / 2, weights / 2
            on = np.empty((m, len(x)))
            for i, (f, low, high, takes, _) in enumerate(way):
                v = x[:, f]
                on[i] = np.where(np.isnan(v), takes, (v >= low) & (v < high))
            share = np.array([w[4] for w in way])
            factors = share[:, None, None] * (1 - points) + on[:, :, None] * points  # never 0: shares are above 0, points below 1
            whole = factors.prod(axis=0) * weights
            for i, (f, *_rest) in enumerate(way):
                out[:, f] += value * (on[i] - share[i]) * (whole / factors[i]).sum(axis=1)
        return out

    def as_lists(self) -> dict:
        return {k: getattr(self, k).tolist() for k in self.__dataclass_fields__}


def tree_of(lists: dict) -> Tree:
    kinds = {"feature": np.int64, "left": np.int64, "right": np.int64, "missing_left": bool}
    return Tree(**{k: np.array(v, kinds.get(k, float)) for k, v in lists.items()})


def dump(trees: Sequence[Tree]) -> str:
    return json.dumps([t.as_lists() for t in trees])


def load(text: str) -> list[Tree]:
    return [tree_of(x) for x in json.loads(text)]
