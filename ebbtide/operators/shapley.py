"""Shapley values of histogram boosters, by the paths to the leaves.

A leaf is reached by a row through the conditions on its path, one interval of bins per feature. When the features
outside a coalition are averaged by the training rows of the branches (path-dependent values), the game of one leaf
is a product over the features of its path: a feature inside the coalition contributes whether the row meets its
condition, one outside the share of rows that does. The Shapley value of a product game needs only the sums of
products of every size, which a short polynomial per feature gives; a path has at most ``depth`` features, so a row
costs a few hundred operations per leaf, vectorised over a batch. Values of all leaves and trees add up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.histboost import Booster, HistogramModel, Tree, binned


@dataclass(frozen=True)
class LeafPath:
    """Value of a leaf and, per feature of its path, the bins ``low < bin <= high`` and the share of rows inside."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def leaf_paths(tree: Tree) -> list[LeafPath]:
    found, waiting = [], [(0, {})]
    while waiting:
        node, held = waiting.pop()
        f = int(tree.feature[node])
        if f < 0:
            rows = [(k, *v) for k, v in sorted(held.items())]
            columns = [np.array(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, int), *[np.zeros(0)] * 3]
            found.append(LeafPath(float(tree.value[node]), *columns))
            continue
        low, high, share = held.get(f, (-1, 1 << 30, 1.0))
        cut, rows = int(tree.bin[node]), float(tree.rows[node])
        for child, bounds in ((2 * node + 1, (low, min(high, cut))), (2 * node + 2, (max(low, cut), high))):
            part = float(tree.rows[child]) / rows if rows else 0.5
            waiting.append((child, held | {f: (*bounds, share * part)}))
    return found


def path_values(path: LeafPath, x: np.ndarray) -> np.ndarray:
    """``[row, path feature]``: Shapley values of one leaf's game."""
    m = len(path.features)
    out = np.zeros((len(x), m))
    bins = x[:, path.features].astype(np.int64)
    inside = ((bins > path.low) & (bins <= path.high)).astype(np.float64)
    weights = [factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)]
    for j in range(m):
        sums = np.zeros((m, len(x)))  # sums of products over coalitions of each size, without feature j
        sums[0] = 1.0
        size = 0
        for i in range(m):
            if i == j:
                continue
            grown = sums * path.share[i]
            grown[1 : size + 2] += sums[: size + 1] * inside[:, i]
            sums, size = grown, size + 1
        out[:, j] = path.value * (inside[:, j] - path.share[j]) * sum(w * s for w, s in zip(weights, sums, strict=True))
    return out


def tree_values(paths: list[LeafPath], x: np.ndarray, width: int) -> np.ndarray:
    """``[row, feature]`` of a whole tree."""
    out = np.zeros((len(x), width))
    for path in paths:
        if len(path.features):
            out[:, path.features] += path_values(path, x)
    return out


def base_value(booster: Booster) -> float:
    """The mean score over the training rows of the branches, to which the values of a row add up its score."""
    return booster.start + booster.target.rate * sum(p.value * float(np.prod(p.share)) for t in booster.trees for p in leaf_paths(t))


def _booster_values(booster: Booster, x: np.ndarray, width: int) -> np.ndarray:
    total = np.zeros((len(x), width))
    for tree in booster.trees:
        total += tree_values(leaf_paths(tree), x, width)
    return booster.target.rate * total


def shapley_values(model: HistogramModel, booster: int = 0) -> Column:
    """``array<double>``: one value per feature of the model, on the scale of the raw score of one booster."""
    own, cuts, width = model.boosters[booster], model.cuts, len(model.features)

    @F.arrow_udf("array<double>")
    def values(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            x = binned(columns if isinstance(columns, tuple) else (columns,), cuts)
            yield pa.array(list(_booster_values(own, x, width)), pa.list_(pa.float64()))

    return values(*[F.col(f).cast("double") for f in model.features])


def shapley_importance(df: DataFrame, model: HistogramModel, booster: int = 0) -> DataFrame:
    """Rows ``(feature, importance)``: mean absolute Shapley value; a task sends one sum per feature."""
    own, cuts, features = model.boosters[booster], model.cuts, list(model.features)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(features)), 0
        for batch in batches:
            x = binned(batch.columns, cuts)
            total += np.abs(_booster_values(own, x, len(features))).sum(0)
            n += len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(features), pa.array(total), pa.array([n] * len(features))], names=["feature", "total", "n"]
        )

    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    found = rows.mapInArrow(sums, "feature string, total double, n long")
    return found.groupBy("feature").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("importance"))
