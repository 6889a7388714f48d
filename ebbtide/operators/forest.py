"""Random survival forest: log-rank splits, Nelson-Aalen curves in the leaves, an ensemble curve.

All trees grow level by level in the same jobs. A row counts in a tree as often as a Poisson draw, keyed by its id
and the tree, says (a bootstrap without moving rows). A level is one aggregation of leaving and dying rows by
(tree, node), over the node's own random features, their bins and the numbered times; the log-rank statistic of
every cut follows from those counts, wherever the counts of a node meet. What moves depends on trees, nodes,
features, bins and times, never on the rows.

Times are the event times while there are at most ``time_bins`` of them, and as many quantiles beyond. Null and NaN
feature values share a bin above all others. Rows with a null time or event are refused by the caller's schema or
count as not dying at time zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.histboost import Tree, _summed, binned, number_times, quantile_cuts
from ebbtide.session import materialize

BINS, TIME_BINS = 16, 32
TASK_CELLS = 2_000_000
_STATE = "x binary, row long, time int, event int"


def cumulative_hazard(leaving: np.ndarray, dying: np.ndarray) -> np.ndarray:
    """Nelson-Aalen estimate up to each numbered time, along the last axis; number 0 lies before the first."""
    at_risk = np.cumsum(leaving[..., ::-1], axis=-1)[..., ::-1]
    step = np.divide(dying, at_risk, out=np.zeros_like(dying), where=at_risk > 0)
    step[..., 0] = 0.0
    return np.cumsum(step, axis=-1)


def logrank_scores(leaving: np.ndarray, dying: np.ndarray) -> np.ndarray:
    """Log-rank chi-square of every cut ``[feature, cut]`` of counts ``[feature, bin, time]``; NaN where undefined."""
    left, d_left = np.cumsum(leaving, axis=1)[:, :-1], np.cumsum(dying, axis=1)[:, :-1]
    n_left = np.cumsum(left[..., ::-1], axis=-1)[..., ::-1]
    n = np.cumsum(leaving[0].sum(0)[::-1])[::-1]
    d = dying[0].sum(0)
    told = (n > 0) & (d > 0) & (np.arange(len(n)) > 0)
    n, d, n_left, d_left = n[told], d[told], n_left[..., told], d_left[..., told]
    share = n_left / n
    spread = np.where(n > 1, d * (n - d) / np.maximum(n - 1, 1e-300), 0.0)
    z = (d_left - d * share).sum(-1)
    v = (spread * share * (1 - share)).sum(-1)
    return np.divide(z * z, v, out=np.full_like(z, np.nan), where=v > 1e-12)


@dataclass
class SurvivalForest:
    """``curves[i]`` holds a tree's cumulative hazard per node and numbered time."""

    features: list[str]
    cuts: list[np.ndarray]
    times: np.ndarray
    trees: list[Tree]
    curves: list[np.ndarray]

    def hazard(self, x: np.ndarray) -> np.ndarray:
        """Mean cumulative hazard of every row of binned features at every numbered time."""
        total = np.zeros((len(x), len(self.times) + 1))
        for tree, curve in zip(self.trees, self.curves, strict=True):
            total += curve[tree.leaf(x)]
        return total / max(1, len(self.trees))

    def predict(self, df: DataFrame, at: Sequence[float] = (), risk: str = "risk", prefix: str = "surv_") -> DataFrame:
        """Adds ``risk`` (expected deaths: the ensemble's hazard summed over all times) and survival at ``at``, in one pass."""
        forest = self
        places = [int(np.searchsorted(self.times, t, side="right")) for t in at]

        @F.arrow_udf("array<double>")
        def scored(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for columns in batches:
                hazard = forest.hazard(binned(columns if isinstance(columns, tuple) else (columns,), forest.cuts))
                out = np.column_stack([hazard[:, 1:].sum(1), *[np.exp(-hazard[:, p]) for p in places]])
                yield pa.array(list(out), pa.list_(pa.float64()))

        held = df.withColumn("__scores", scored(*[F.col(f).cast("double") for f in self.features]))
        names = [risk, *[f"{prefix}{t:g}" for t in at]]
        return held.withColumns({n: F.get("__scores", F.lit(i)) for i, n in enumerate(names)}).drop("__scores")


def _hashed(row: np.ndarray, salt: int) -> np.ndarray:
    z = row.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (1 + salt)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


#: Cumulative probabilities of a Poisson number of mean one.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def drawn_features(width: int, wanted: int, tree: int, node: int, seed: int) -> np.ndarray:
    """The node's random features, ascending."""
    return np.sort(np.random.default_rng([seed, tree, node]).permutation(width)[:wanted])


def fit_forest(
    df: DataFrame,
    features: Sequence[str],
    row_id: Sequence[str],
    trees: int = 30,
    depth: int = 6,
    least_rows: int = 15,
    features_per_node: int | None = None,
    bootstrap: bool = True,
    bins: int = BINS,
    time_bins: int = TIME_BINS,
    seed: int = 42,
    time: str = "time",
    event: str = "event",
) -> SurvivalForest:
    """Grow the forest; ``features_per_node`` is the root of the number of features by default."""
    features, width = list(features), len(features)
    wanted = features_per_node or max(1, math.ceil(math.sqrt(width)))
    cuts, times = quantile_cuts(df, features, bins), number_times(df, time, event, time_bins)
    deep, long = max(len(c) for c in cuts) + 2, len(times) + 1
    tasks = max(1, math.ceil(df.count() * trees * wanted / TASK_CELLS))
    given = df.select(
        F.xxhash64(*row_id).alias("row"),
        F.coalesce(F.col(time).cast("double"), F.lit(0.0)).alias("time"),
        F.coalesce(F.col(event).cast("int"), F.lit(0)).alias("event"),
        *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)],
    ).repartition(tasks, "row")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = binned([batch.column(f"x{i}") for i in range(width)], cuts)
            t = np.searchsorted(times, batch.column("time").to_numpy(zero_copy_only=False), side="right").astype(np.int32)
            columns = [pa.array([r.tobytes() for r in x], pa.binary()), batch.column("row"), pa.array(t), batch.column("event")]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _STATE.split(", ")])

    state = materialize(given.mapInArrow(put, _STATE))
    grown = [Tree.empty(depth) for _ in range(trees)]
    curves = [np.zeros((len(t.feature), long)) for t in grown]
    opened = {(i, 0) for i in range(trees)}
    for level in range(depth):
        if not opened:
            break
        base, wide, held = (1 << level) - 1, 1 << level, frozenset(opened)
        growing = sorted({i for i, _ in held})
        picks = {(i, node): drawn_features(width, wanted, i, node, seed) for i, node in held}

        def emit(batch: pa.RecordBatch, base=base, wide=wide, level=level, held=held, growing=growing, picks=picks):
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(-1, width)
            row, t, died = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "time", "event"))
            for i in growing:
                weight = np.searchsorted(_POISSON, _hashed(row, seed * 1_000_003 + i), side="right") if bootstrap else np.ones(len(row), np.int64)
                node = grown[i].leaf(x, level) - base
                for j in range(wide):
                    if (i, base + j) not in held or not (mine := np.flatnonzero((node == j) & (weight > 0))).size:
                        continue
                    own = picks[i, base + j]
                    cell = ((np.arange(len(own)) * deep + x[mine][:, own]) * long + t[mine][:, None]).ravel()
                    size = len(own) * deep * long
                    w = np.repeat(weight[mine].astype(np.float64), len(own))
                    yield i << 16 | (base + j), np.concatenate([np.bincount(cell, w, size), np.bincount(cell, w * np.repeat(died[mine] == 1, len(own)), size)])

        def finish(slot: int, total: np.ndarray, picks=picks) -> np.ndarray:
            own = picks[slot >> 16, slot & 0xFFFF]
            leaving, dying = total.reshape(2, len(own), deep, long)
            rows = leaving.sum(-1)
            n_left = np.cumsum(rows, axis=1)[:, :-1]
            scores = logrank_scores(leaving, dying)
            scores[(n_left < least_rows) | (rows[0].sum() - n_left < least_rows)] = np.nan
            whole = [leaving[0].sum(0), dying[0].sum(0)]
            if np.isnan(scores).all():
                return np.concatenate([[-1, 0, rows[0].sum(), 0], cumulative_hazard(*whole), np.zeros(long)])
            f, cut = np.unravel_index(int(np.nanargmax(scores)), scores.shape)
            left = [leaving[f, : cut + 1].sum(0), dying[f, : cut + 1].sum(0)]
            right = [a - b for a, b in zip(whole, left, strict=True)]
            return np.concatenate([[own[f], cut, left[0].sum(), right[0].sum()], cumulative_hazard(*left), cumulative_hazard(*right)])

        found = _summed(state, emit, len(held) * 2 * wanted * deep * long, finish)
        opened = set()
        for slot, values in sorted(found.items()):
            i, node = slot >> 16, slot & 0xFFFF
            tree, f, first, second = grown[i], int(values[0]), values[4 : 4 + long], values[4 + long :]
            if f < 0:
                tree.rows[node], curves[i][node] = values[2], first
                continue
            tree.feature[node], tree.bin[node], tree.rows[node] = f, int(values[1]), values[2] + values[3]
            for child, n, curve in ((2 * node + 1, values[2], first), (2 * node + 2, values[3], second)):
                tree.rows[child], curves[i][child] = n, curve
                if level + 1 < depth:
                    opened.add((i, child))
    return SurvivalForest(features, cuts, times, grown, curves)
