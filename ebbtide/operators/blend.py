"""Combining scores: means, rank blends, sweeps, calibration, banded assembly."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.functions import vectors as V
from ebbtide.operators import histboost
from ebbtide.operators.histboost import Target
from ebbtide.operators.metrics import concordance
from ebbtide.operators.ranks import average_rank, average_ranks
from ebbtide.session import materialize

# fixed values: weights of the survival rank tried by the sweep
SWEEP_WEIGHTS = (0.97, 0.93, 0.88, 0.82, 0.75, 0.65, 0.5)


def ensemble_mean(df: DataFrame, models: Sequence[Sequence[str]], out: Sequence[str]) -> DataFrame:
    """Mean of the models per horizon, then monotone over the horizons."""
    means = [V.mean([F.col(model[i]) for model in models]) for i in range(len(out))]
    return df.withColumns(dict(zip(out, V.running_minimum(means), strict=True)))


def expected_survival(survival: Sequence[str], horizons: Sequence[float]) -> Column:
    """Area under the survival curve from 0, where it is 1, to the last horizon."""
    return V.trapezoid([F.lit(1.0), *[F.col(s) for s in survival]], [0, *horizons])


def risk_candidates(
    df: DataFrame, survival: Sequence[str], hazard: str, row_id: Sequence[str], horizons=(30, 60, 90)
) -> DataFrame:
    """Five risk scores, higher = sooner: 1 - S at the last horizon, minus expected survival, summed
    event probabilities, a hazard score, and the mean rank of hazard and expected survival."""
    scored = df.withColumns(
        {
            f"risk_s{horizons[-1]}": 1 - F.col(survival[-1]),
            "risk_expected": -expected_survival(survival, horizons),
            "risk_sum": V.total([1 - F.col(s) for s in survival]),
            "risk_cox": F.col(hazard).cast("double"),
        }
    )
    ranked = average_ranks(scored, [("risk_cox", "_a"), ("risk_expected", "_b")], row_id)
    return ranked.withColumn("risk_blend", 0.5 * F.col("_a") + 0.5 * F.col("_b")).drop("_a", "_b")


def blend_sweep(
    df: DataFrame,
    survival_risk: str,
    timing: Sequence[str],
    row_id: Sequence[str],
    weights: Sequence[float] = SWEEP_WEIGHTS,
    **concordance_options,
) -> DataFrame:
    """Rows ``(signal, weight, c_index, best)``: the survival risk alone and blended by rank with each signal.

    Ranks are computed once; the candidates become rows, and one grouped concordance scores them all.
    """
    time, event = concordance_options.get("time", "time"), concordance_options.get("event", "event")
    used = df.select(*dict.fromkeys([*row_id, time, event, survival_risk, *timing]))
    names = [f"_t{i}" for i in range(len(timing))]
    ranked = average_ranks(used, [(survival_risk, "_r"), *zip(timing, names, strict=True)], row_id)
    ranked = materialize(ranked.select(time, event, survival_risk, "_r", *names))
    candidates = [("", 1.0, F.col(survival_risk).cast("double"))]
    for i, signal in enumerate(timing):
        candidates += [(signal, float(w), w * F.col("_r") + (1 - w) * F.col(f"_t{i}")) for w in weights]
    blends = F.array(*[F.struct(F.lit(i).alias("candidate"), c.alias("blend")) for i, (_, _, c) in enumerate(candidates)])
    rows = ranked.select(time, event, F.explode(blends).alias("b")).select(time, event, "b.candidate", "b.blend")
    scored = materialize(concordance(rows, "blend", by=["candidate"], **concordance_options).select("candidate", "c_index"))
    best = scored.orderBy(F.col("c_index").desc(), "candidate").limit(1).first()
    names = df.sparkSession.createDataFrame(
        [(i, signal, weight) for i, (signal, weight, _) in enumerate(candidates)], "candidate int, signal string, weight double"
    )
    found = names.join(F.broadcast(scored), "candidate", "left")  # one row per candidate
    chosen = F.lit(best["candidate"] if best else 0)
    return found.select("signal", "weight", F.coalesce("c_index", F.lit(0.5)).alias("c_index"), (F.col("candidate") == chosen).cast("int").alias("best"))


def apply_blend(df: DataFrame, survival_risk: str, signal: str, weight: float, out: str, row_id: Sequence[str]) -> DataFrame:
    """The chosen blend on another table, ranked within that table."""
    if not signal or weight == 1.0:
        return df.withColumn(out, F.col(survival_risk))
    ranked = average_ranks(df, [(survival_risk, "_a"), (signal, "_b")], row_id)
    return ranked.withColumn(out, weight * F.col("_a") + (1 - weight) * F.col("_b")).drop("_a", "_b")


TASK_ROWS, HELD_ROWS, BIN_ROWS, CUT_ROWS = 10_000, 50_000, 500_000, 4_000
_PIECE = "candidate int, bin int, score binary, pos binary, neg binary"
_PART = "candidate int, bin int, pos double, neg double, inside double"


def _tallied(score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each different score once, rising, with its sums."""
    values, at = np.unique(score, return_inverse=True)
    return values, np.bincount(at, pos, len(values)), np.bincount(at, neg, len(values))


def auc_of_blends(df: DataFrame, blends: dict[str, Column], label: str) -> dict[str, float]:
    """AUC of several combined columns, all in a single job; NULL when a class is missing.

    The scores of each candidate are cut into bins of about ``BIN_ROWS`` rows. A task sends the different scores of its
    rows, packed by candidate and bin; a bin meets in one place, where its pairs are counted, and the pairs between bins
    follow from the counts of the lower bins. Equal scores are added up before they move. The cut points come from the
    rows of smallest hashes, ``CUT_ROWS`` at most; they decide on the balance of the bins and not on the result.
    """
    names = list(blends)
    table = df.select(F.array(*[c.cast("double") for c in blends.values()]).alias("s"), F.col(label).cast("bigint").alias("y"))
    table = table.where("y IS NOT NULL")
    n = table.count()
    bins = max(1, math.ceil(n / BIN_ROWS))
    tasks = min(len(names) * bins, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = np.empty((len(names), 0))
    if bins > 1:
        drawn = table.where(F.pmod(F.xxhash64("s"), F.lit(max(1, 2 * n // CUT_ROWS))) == 0).select("s").limit(CUT_ROWS).collect()
        if drawn:
            cuts = np.quantile(np.array([r.s for r in drawn], np.float64), [i / bins for i in range(1, bins)], axis=0, method="lower").T

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= HELD_ROWS:
                yield pieces(held)
                held, rows = [], 0
        if rows:
            yield pieces(held)

    def pieces(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        scores = np.concatenate([b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names)) for b in held])
        pos = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in held]).astype(np.float64)
        out = []
        for i in range(len(names)):
            values, p, q = _tallied(scores[:, i], pos, 1 - pos)
            edges = [0, *np.searchsorted(values, cuts[i], side="right").tolist(), len(values)]
            out += [
                (i, j, values[a:b].tobytes(), p[a:b].tobytes(), q[a:b].tobytes()) for j, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b
            ]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        columns = [pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PIECE.split(", ")])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                _, p, q = _tallied(*[np.concatenate([np.frombuffer(piece[k], np.float64) for piece in held]) for k in range(3)])
                inside = float((p * (np.cumsum(q) - q / 2)).sum())
                columns = [pa.array([slot[0]], pa.int32()), pa.array([slot[1]], pa.int32()), *[pa.array([float(v)]) for v in (p.sum(), q.sum(), inside)]]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PART.split(", ")])

        for batch in batches:
            for i, j, *piece in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (i, j) != slot:
                    yield from done()
                    slot, held = (i, j), []
                held.append(piece)
        yield from done()

    moved = table.mapInArrow(packed, _PIECE).repartition(tasks, "candidate", "bin")
    parts = moved.sortWithinPartitions("candidate", "bin").mapInArrow(counted, _PART)
    lower = F.coalesce(F.sum("neg").over(W.partitionBy("candidate").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    placed = parts.withColumn("pairs", F.col("inside") + F.col("pos") * lower)
    area = F.try_divide(F.sum("pairs"), F.sum("pos") * F.sum("neg"))
    found = {r.candidate: r.auc for r in placed.groupBy("candidate").agg(area.alias("auc")).collect()}
    return {name: found.get(i) for i, name in enumerate(names)}


def rank_ensemble(df: DataFrame, models: Sequence[str], label: str, row_id: Sequence[str], step: float = 0.05) -> DataFrame:
    """Rows ``(w0, w1, …, auc, best)`` over the weight simplex of the model ranks.

    Candidate columns are scored in batches, one job per batch.
    """
    ranked = average_ranks(df, [(model, f"_r{i}") for i, model in enumerate(models)], row_id)
    # a row is small and its blends are many, so even a small table is dealt over all cores
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(math.ceil(n / TASK_ROWS), max(cores, math.ceil(n / BIN_ROWS))))
    ranked = materialize(ranked.select(label, *[f"_r{i}" for i in range(len(models))]).repartition(tasks))
    parts = round(1 / step)
    grid = [w for w in _compositions(parts, len(models))]
    rows = []
    for start in range(0, len(grid), 64):
        batch = grid[start : start + 64]
        blends = {
            # whole weights on half-integer ranks: sums are exact, so equal blends tie
            str(start + j): V.total([F.col(f"_r{i}") * float(w) for i, w in enumerate(weights)]) for j, weights in enumerate(batch)
        }
        found = auc_of_blends(ranked, blends, label)
        rows += [([w / parts for w in weights], found[str(start + j)]) for j, weights in enumerate(batch)]
    best = max(range(len(rows)), key=lambda i: rows[i][1] or 0.0)
    schema = ", ".join(f"w{i} double" for i in range(len(models))) + ", auc double, best int"
    return df.sparkSession.createDataFrame([(*w, a, int(i == best)) for i, (w, a) in enumerate(rows)], schema)


def _compositions(total: int, parts: int):
    if parts == 1:
        yield (total,)
        return
    for first in range(total + 1):
        for rest in _compositions(total - first, parts - 1):
            yield (first, *rest)


def blend_weight_search(df: DataFrame, first: str, second: str, label: str, row_id: Sequence[str], step: float = 0.05) -> DataFrame:
    """Rows ``(weight, auc, best)`` for ``w * rank(first) + (1 - w) * rank(second)``."""
    table = rank_ensemble(df, [first, second], label, row_id, step)
    return table.select(F.col("w0").alias("weight"), "auc", "best")


BLOCK = "lo double, hi double, total double, weight double"
POOL_ROWS = 1 << 20


def _pool_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pool adjacent violators of blocks in rising order into blocks of strictly rising means."""
    lo, hi, total, weight = stack = [], [], [], []
    for pdf in batches:
        block = [pdf[c].to_numpy() for c in ("lo", "hi", "total", "weight")]
        while len(block[0]):
            # a run in which no mean rises is one block: most of the work, without a loop over rows
            starts = np.flatnonzero(np.concatenate([[True], np.diff(block[2] / block[3]) > 0]))
            ends = np.concatenate([starts[1:], [len(block[0])]]) - 1
            shrunk = len(starts) < 0.9 * len(block[0])
            block = [block[0][starts], block[1][ends], np.add.reduceat(block[2], starts), np.add.reduceat(block[3], starts)]
            if not shrunk:
                break
        for first, last, t, w in zip(*(c.tolist() for c in block), strict=True):
            while total and total[-1] / weight[-1] >= t / w:
                first = lo.pop()
                hi.pop()
                t, w = t + total.pop(), w + weight.pop()
            for column, value in zip(stack, (first, last, t, w), strict=True):
                column.append(value)
    for start in range(0, len(lo), 10_000):
        cut = slice(start, start + 10_000)
        yield pd.DataFrame({"lo": lo[cut], "hi": hi[cut], "total": total[cut], "weight": weight[cut]})


def pool_violators(points: DataFrame, task_rows: int | None = None) -> DataFrame:
    """Blocks ``(lo, hi, total, weight)`` of the rising least-squares curve of ``points`` of the same columns.

    Neighbours that violate the order inside a range of the points belong to one block of the whole curve. So each
    round pools the ranges of one partitioning, of ever fewer ranges, until no two ranges violate the order
    where they meet; only one pair of means per range reaches the driver. Equal means share a block.
    """
    task_rows = task_rows or POOL_ROWS
    blocks, parts = materialize(points), None
    while True:
        needed = math.ceil(blocks.count() / task_rows)
        parts = max(1, needed if parts is None else min(needed, parts // 2))
        ranges = blocks.repartitionByRange(parts, "lo").sortWithinPartitions("lo")
        pooled = materialize(ranges.mapInPandas(_pool_sorted, BLOCK).withColumn("_range", F.spark_partition_id()))
        blocks = pooled.drop("_range")
        if parts == 1:
            return blocks
        mean = F.col("total") / F.col("weight")
        edges = pooled.groupBy("_range").agg(F.min("lo").alias("lo"), F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last"))
        edges = edges.orderBy("lo").collect()
        if all(left["last"] < right["first"] for left, right in zip(edges, edges[1:], strict=False)):
            return blocks


def fit_isotonic(df: DataFrame, score: str, target: Column | str, increasing: bool = True) -> IsotonicRegressionModel:
    """Isotonic calibration curve; prediction interpolates and clips at the ends.

    Rows are summed per distinct score, then pooled in Spark; the model, which lives on the driver, is made from the
    two ends of every final block. Rows whose score or target is NULL or NaN take no part.
    """
    x = F.col(score).cast("double")
    y = (F.col(target) if isinstance(target, str) else target).cast("double")
    sign = 1.0 if increasing else -1.0
    used = df.select(x.alias("lo"), (sign * y).alias("_y")).filter("NOT isnan(lo) AND NOT isnan(_y) AND lo IS NOT NULL AND _y IS NOT NULL")
    points = used.groupBy("lo").agg(F.sum("_y").alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
    blocks = pool_violators(points.select("lo", F.col("lo").alias("hi"), "total", "weight"))
    half = F.struct(F.col("lo").alias("features"), (F.col("weight") / 2).alias("weight"))
    other = F.struct(F.col("hi").alias("features"), (F.col("weight") / 2).alias("weight"))
    ends = blocks.select((sign * F.col("total") / F.col("weight")).alias("label"), F.explode(F.array_distinct(F.array(half, other))).alias("p"))
    return IsotonicRegression(isotonic=increasing, weightCol="weight").fit(ends.select("p.features", "label", "p.weight"))


def apply_isotonic(df: DataFrame, model: IsotonicRegressionModel, score: str, out: str) -> DataFrame:
    staged = df.withColumn("_x", F.col(score).cast("double"))
    return model.setFeaturesCol("_x").setPredictionCol(out).transform(staged).drop("_x")


def calibrate(
    oof: DataFrame, test: DataFrame, survival: Sequence[str], horizons: Sequence[int], time: str = "time"
) -> DataFrame:
    """Isotonic curves fitted on out-of-fold survival probabilities, applied to ``test``, then made monotone."""
    out = test
    for name, h in zip(survival, horizons, strict=True):
        model = fit_isotonic(oof, name, F.col(time) > h)
        out = apply_isotonic(out, model, name, "_p").withColumn(name, F.col("_p")).drop("_p")
    clipped = [F.least(F.greatest(F.col(s), F.lit(0.0)), F.lit(1.0)) for s in survival]
    return out.withColumns(dict(zip(survival, V.running_minimum(clipped), strict=True)))


# fixed values: foot and width of the bands of unknown and of positive counts, and the weight of the count's rank
UNKNOWN_BAND = (0.62, 0.37)
POSITIVE_BAND = (0.0, 0.60)
HIDDEN_WEIGHT = 0.8


def banded_score(
    df: DataFrame, hidden: str, behaviour: str, row_id: Sequence[str], weight: float = HIDDEN_WEIGHT, second: str | None = None
) -> DataFrame:
    """Score in bands from a leaked count: A, 0 hidden -> 1; B, unknown -> (0.62, 0.99]; C, positive -> (0, 0.6];
    D, a negative count, which overlapping id blocks give -> 0. Every row of ``df`` is in one band.

    Inside a band the order is the rank of the behavioural score, blended with the rank of ``-hidden``
    in band C. A NaN count is unknown. ``second`` names a score of its own for band C.
    """
    df = df.withColumn(hidden, F.when(~F.isnan(F.col(hidden).cast("double")), F.col(hidden)))
    overlapping = df.filter(F.col(hidden) < 0).withColumn("score", F.lit(0.0)).withColumn("band", F.lit("D"))
    certain = df.filter(F.col(hidden) == 0).withColumn("score", F.lit(1.0)).withColumn("band", F.lit("A"))
    unknown = df.filter(F.col(hidden).isNull())
    retained = df.filter(F.col(hidden) > 0)
    n_unknown, n_retained = unknown.count(), retained.count()
    unknown = average_rank(unknown, behaviour, "_b", row_id)
    unknown = unknown.withColumn("score", UNKNOWN_BAND[0] + UNKNOWN_BAND[1] * F.col("_b") / max(1, n_unknown)).withColumn("band", F.lit("B"))
    retained = average_ranks(retained.withColumn("_h", -F.col(hidden)), [("_h", "_a"), (second or behaviour, "_b")], row_id)
    # rounded so that blends that differ by floating-point noise tie
    retained = retained.withColumn("_c", F.round(weight * F.col("_a") + (1 - weight) * F.col("_b"), 9))
    retained = average_ranks(retained, [("_c", "_d")], row_id)
    retained = retained.withColumn("score", POSITIVE_BAND[0] + POSITIVE_BAND[1] * F.col("_d") / max(1, n_retained)).withColumn("band", F.lit("C"))
    kept = [*df.columns, "score", "band"]
    out = certain.select(*kept)
    for band in (unknown, retained, overlapping):
        out = out.unionByName(band.select(*kept))
    return out


def monotone_second_stage(
    df: DataFrame, hidden: str, model_score: str, label: str, out: str, weight: float = 0.5
) -> DataFrame:
    """Score that never rises with ``hidden``: a decreasing isotonic curve of it, averaged with a model
    that does not see it."""
    curve = fit_isotonic(df, hidden, label, increasing=False)
    return apply_isotonic(df, curve, hidden, "_iso").withColumn(
        out, weight * F.col("_iso") + (1 - weight) * F.col(model_score)
    ).drop("_iso")


def constrained_second_stage(
    train: DataFrame, test: DataFrame | None, features: Sequence[str], hidden: str, label: str, row_id: Sequence[str], out: str,
    fold: str = "fold", folds: int = 5, rounds: int = 100, depth: int = 5, rate: float = 0.05, validation: str | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Boosted trees on the features and the count, whose score never rises with the count, whatever the features are.

    ``out`` is out of fold on ``train`` and the mean over the folds on ``test``. With ``validation`` its rows end the boosting.
    """
    target = Target(out, label=label, rounds=rounds, depth=depth, rate=rate, stopping=validation is not None, monotone=((hidden, -1),))
    model = histboost.fit(train, [*features, hidden], [target], row_id, fold, folds, validation=validation)
    return model.out_of_fold(train, fold), None if test is None else model.mean_score(test)
