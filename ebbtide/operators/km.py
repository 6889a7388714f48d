"""Non-parametric survival: Kaplan–Meier, Nelson–Aalen, log-rank, curves per group.

Everything is computed from one table with a row per (group, distinct time). Discrete follow-up days
keep it tiny; continuous times go through the bucketed running totals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.columns import left_closed_bin
from ebbtide.operators.ranks import assign_bucket, bucket_count, join_null_safe, plain_double, quantile_map, running_totals, sketch_splits
from ebbtide.session import materialize

#: Numbers at risk that a task holds at once, times by groups.
LOGRANK_CELLS = 2_000_000


def survival_table(
    df: DataFrame, time: str = "time", event: str = "event", by: Sequence[str] = ()
) -> DataFrame:
    """Rows ``(by…, t, n_risk, d, censored, surv, variance, cum_hazard)`` with ties grouped by time.

    ``surv`` is the product of ``1 - d/n``, taken through logarithms so that partial sums combine;
    ``variance`` is Greenwood's, NULL once nobody survives; ``cum_hazard`` is Nelson–Aalen.
    """
    by = list(by)
    counts = materialize(
        df.groupBy(*by, F.col(time).alias("t")).agg(
            F.count(F.lit(1)).alias("leaving"), F.sum(F.col(event).cast("bigint")).alias("d")
        )
    )
    risk = running_totals(counts, "t", ["leaving"], by).withColumn(
        "n_risk", F.col("tot_leaving") - F.col("cum_leaving") + F.col("leaving")
    )
    survivors = F.col("n_risk") - F.col("d")
    steps = risk.select(
        *by,
        "t",
        "n_risk",
        "d",
        (F.col("leaving") - F.col("d")).alias("censored"),
        F.when(survivors > 0, F.ln(survivors / F.col("n_risk"))).otherwise(F.lit(0.0)).alias("log_step"),
        (F.col("d") / F.col("n_risk")).alias("hazard"),
        F.when(survivors > 0, F.col("d") / (F.col("n_risk") * survivors)).otherwise(F.lit(0.0)).alias("green"),
    )
    run = running_totals(steps, "t", ["log_step", "hazard", "green"], by)
    # nobody is left only at the very last time of a group
    surv = F.when(F.col("n_risk") == F.col("d"), F.lit(0.0)).otherwise(F.exp("cum_log_step"))
    return run.select(
        *by,
        "t",
        "n_risk",
        "d",
        "censored",
        surv.alias("surv"),
        F.when(F.col("n_risk") > F.col("d"), surv * surv * F.col("cum_green")).alias("variance"),
        F.col("cum_hazard").alias("cum_hazard"),
    )


def survival_at(table: DataFrame, times: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """S at each query time: the last step at or before it, 1 before the first."""
    by = list(by)
    queried = [
        F.max_by("surv", F.when(F.col("t") <= at, F.col("t"))).alias(f"s{i}") for i, at in enumerate(times)
    ]
    reached = [F.min("t").alias("first")]
    wide = table.groupBy(*by).agg(*queried, *reached) if by else table.agg(*queried, *reached)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(float(at)).alias("t"),
                    F.when(F.col("first") > at, F.lit(1.0)).otherwise(F.col(f"s{i}")).alias("surv"),
                )
                for i, at in enumerate(times)
            ]
        )
    ).alias("r")
    return wide.select(*by, rows).select(*by, "r.*")


def median_survival(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First time with S <= 0.5; NULL when the curve never gets there."""
    reached = F.min(F.when(F.col("surv") <= 0.5, F.col("t"))).alias("median")
    return table.groupBy(*by).agg(reached) if by else table.agg(reached)


def loglog_curves(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """ln(-ln S) per group, parallel under proportional hazards; only where 0 < S < 1."""
    inside = table.filter((F.col("surv") > 0) & (F.col("surv") < 1))
    return inside.select(*by, "t", F.ln(-F.ln("surv")).alias("loglog"))


def chi_square_tail(x: float, dof: int) -> float:
    """P(chi-square with ``dof`` degrees of freedom > x), in closed form for whole ``dof``."""
    if x <= 0 or dof == 0:
        return 1.0
    half = x / 2
    if dof % 2 == 0:
        total, term = 0.0, math.exp(-half)
        for i in range(dof // 2):
            total += term
            term *= half / (i + 1)
        return min(1.0, total)
    total, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for i in range((dof - 1) // 2):
        total += term
        term *= half / (i + 1.5)
    return min(1.0, total)


def logrank_components(
    df: DataFrame, group: str, time: str = "time", event: str = "event"
) -> tuple[list, np.ndarray, np.ndarray]:
    """Group values, observed minus expected events, and their covariance matrix, for any number of groups.

    Rows are counted by (group, time) and cut at time buckets. A bucket starts from the numbers at risk behind it, a
    small table with a row per bucket and group, and adds its event times to k sums and k * k pair sums. A NULL
    group is a group of its own, the first; rows without a time are left out.
    """
    counts = materialize(
        df.filter(F.col(time).isNotNull())
        .groupBy(F.col(group).alias("group"), F.col(time).alias("t"))
        .agg(F.count(F.lit(1)).cast("double").alias("leaving"), F.sum(F.col(event).cast("double")).alias("d"))
    )
    groups = sorted((row[0] for row in counts.select("group").distinct().collect()), key=lambda g: (g is not None, g))
    k = len(groups)
    if not k:
        return [], np.zeros(0), np.zeros((0, 0))
    codes = df.sparkSession.createDataFrame([(g, i) for i, g in enumerate(groups)], T.StructType([counts.schema["group"], T.StructField("g", T.IntegerType())]))
    coded = join_null_safe(counts, F.broadcast(codes), ["group"])  # as many rows as the covariance has columns
    splits, _ = sketch_splits(coded, ["t"], bucket_count(df))["t"]
    keyed = materialize(assign_bucket(coded.select("g", "t", "leaving", "d"), "t", splits, "bucket").withColumn("t", plain_double("t")))
    behind: dict[int, np.ndarray] = {}
    later = np.zeros(k)
    sizes = keyed.groupBy("bucket", "g").agg(F.sum("leaving").alias("n")).collect()
    for b in sorted({r.bucket for r in sizes}, reverse=True):
        behind[b] = later.copy()
        for r in sizes:
            if r.bucket == b:
                later[r.g] += r.n

    def sums(table: pa.Table) -> pa.Table:
        z, v, after = np.zeros(k), np.zeros((k, k)), behind[table.column("bucket")[0].as_py()]
        t, g, leaving, d = (table.column(c).to_numpy() for c in ("t", "g", "leaving", "d"))
        times, place = np.unique(-t, return_inverse=True)  # from the last to the first
        order = np.argsort(place, kind="stable")
        step = max(1, LOGRANK_CELLS // k)
        for first in range(0, len(times), step):
            mine = order[np.searchsorted(place[order], first) : np.searchsorted(place[order], first + step)]
            gone, died = np.zeros((min(step, len(times) - first), k)), np.zeros((min(step, len(times) - first), k))
            np.add.at(gone, (place[mine] - first, g[mine]), leaving[mine])
            np.add.at(died, (place[mine] - first, g[mine]), d[mine])
            n = after + np.cumsum(gone, axis=0)
            after = n[-1]
            told = died.sum(1) > 0
            n, died = n[told], died[told]
            all_n, all_d = n.sum(1), died.sum(1)
            z += (died - n * (all_d / all_n)[:, None]).sum(0)
            scale = np.divide(all_d * (all_n - all_d), all_n**2 * (all_n - 1), out=np.zeros_like(all_n), where=all_n > 1)
            v += np.diag((scale * all_n) @ n) - (n * scale[:, None]).T @ n
        return pa.table({"place": np.arange(k + k * k), "value": np.concatenate([z, v.ravel()])})

    found = keyed.groupBy("bucket").applyInArrow(sums, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    flat = np.zeros(k + k * k)
    for r in found.collect():
        flat[r.place] = r.value
    return groups, flat[:k], flat[k:].reshape(k, k)


def logrank_test(df: DataFrame, group: str, time: str = "time", event: str = "event") -> DataFrame:
    """One row ``(statistic, dof, p_value)`` comparing the survival of two or more groups."""
    groups, z, v = logrank_components(df, group, time, event)
    dof = max(len(groups) - 1, 0)
    statistic = float(z[:dof] @ np.linalg.pinv(v[:dof, :dof]) @ z[:dof]) if dof else 0.0
    row = [(statistic, dof, chi_square_tail(statistic, dof))]
    return df.sparkSession.createDataFrame(row, "statistic double, dof int, p_value double")


def risk_segments(df: DataFrame, risk: str, probabilities: Sequence[float] = (0.33, 0.66)) -> DataFrame:
    """Adds ``segment`` 0 (low) … by the quantiles of the risk, cut points belonging to the upper side."""
    cuts = quantile_map(df, [risk], probabilities)[risk]
    return df.withColumn("segment", left_closed_bin(F.col(risk), cuts))
