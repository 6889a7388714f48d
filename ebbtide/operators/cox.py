"""Cox regression as a Newton iteration over distributed sums.

One evaluation of the partial likelihood is one Spark job: rows are summed per (stratum, time), the
per-time table is cumulated from the last time backwards (bucketed when times are continuous), tied
events enter by Efron's correction, and a single row with the log-likelihood, gradient and Hessian
reaches the driver, where a p-by-p system is solved.

Rows may carry a start time (time-varying covariates): a row at risk in ``(start, stop]`` adds its sums at
``stop`` and subtracts them at ``start``, so no row is ever split by event times.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ebbtide.functions import vectors as V
from ebbtide.operators.metrics import concordance
from ebbtide.operators.quality import fit_scaler
from ebbtide.operators.ranks import (
    assign_bucket,
    bucket_count,
    join_null_safe,
    running_totals,
    sketch_splits,
    step_lookup,
    with_offsets,
)
from ebbtide.session import materialize

DIRECT = 256  # tied events of one time that are summed one by one
TAIL = 64  # of more, as many at the end, where the terms change fastest
NODES, WEIGHTS = np.polynomial.legendre.leggauss(32)
FEW_TIMES = 1_000  # times of all strata that one place cumulates
HELD_ROWS = 100_000  # rows of a task that are summed per time at once


def _efron_terms(k, d, r, e) -> np.ndarray:
    f = k / d
    phi = r - f * e
    return np.stack([1 / phi, f / phi, 1 / phi**2, f / phi**2, f * f / phi**2, np.log(phi)], axis=-1)


def _efron_sums(d: np.ndarray, r: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Per event time, sums over k = 0 … d-1 of functions of the Efron denominator ``r - (k/d) e``.

    Columns: 1/phi, f/phi, 1/phi^2, f/phi^2, f^2/phi^2 and ln(phi) with f = k/d. The cost of a time does not
    depend on ``d``: beyond ``DIRECT`` ties all but the last ``TAIL`` terms are an Euler-Maclaurin sum, whose
    integral runs over the logarithm of the denominator, where 32 Gauss nodes are exact to rounding.
    """
    out = np.zeros((len(d), 6))
    many = d > DIRECT
    first = np.where(many, d - TAIL, 0.0)  # the terms from here on are added one by one
    for k in range(int(np.max(d - first, initial=0.0))):
        i = np.flatnonzero(first + k < d)
        out[i] += _efron_terms(first[i] + k, d[i], r[i], e[i])
    if many.any():
        d, r, e, last = d[many], r[many], e[many], first[many] - 1
        c, x = e / d, r * d / e
        low, high = np.log(x - last), np.log(x)
        u = (high + low)[:, None] / 2 + (high - low)[:, None] / 2 * NODES
        y = np.exp(u)
        at = _efron_terms(x[:, None] - y, d[:, None], r[:, None], e[:, None])
        total = np.einsum("tn,tnf->tf", WEIGHTS * y * (high - low)[:, None] / 2, at)
        total += (_efron_terms(np.zeros_like(d), d, r, e) + _efron_terms(last, d, r, e)) / 2
        for side, y in ((1.0, x - last), (-1.0, x)):
            slope = [1 / (c * y**2), x / (d * c * y**2), 2 / (c**2 * y**3), (2 * x / y**3 - 1 / y**2) / (d * c**2)]
            slope += [(2 * x**2 / y**3 - 2 * x / y**2) / (d * c) ** 2, -1 / y]
            third = [6 / (c * y**4), 6 * x / (d * c * y**4), 24 / (c**2 * y**5), (24 * x / y**5 - 6 / y**4) / (d * c**2)]
            third += [(24 * x**2 / y**5 - 12 * x / y**4) / (d * c) ** 2, -2 / y**3]
            total += side * (np.stack(slope, -1) / 12 - np.stack(third, -1) / 720)
        out[many] += total
    return out


def _moments(table: pd.DataFrame, side: str, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of weight, weighted covariates and weighted products of each time, the last as p-by-p matrices."""
    zero = table[f"{side}0"].to_numpy(np.float64)
    one = table[[f"{side}1_{i}" for i in range(p)]].to_numpy(np.float64)
    two = np.zeros((len(table), p, p))
    for i in range(p):
        for j in range(i, p):
            two[:, i, j] = two[:, j, i] = table[f"{side}2_{i}_{j}"].to_numpy(np.float64)
    return zero, one, two


def _likelihood_parts(table: pd.DataFrame, p: int) -> np.ndarray:
    """``[ll, gradient…, Hessian…]`` summed over the event times of a table with cumulated risk sets."""
    r0, r1, r2 = _moments(table, "R", p)
    d0, d1, d2 = _moments(table, "D", p)
    s0, s1, q0, q1, q2, logs = _efron_sums(table["d"].to_numpy(np.float64), r0, d0).T
    ll = float(table["eta"].sum() - logs.sum())
    gradient = table[[f"X{i}" for i in range(p)]].to_numpy(np.float64).sum(0) - (s0 @ r1 - s1 @ d1)
    second = np.einsum("t,tij->ij", s0, r2) - np.einsum("t,tij->ij", s1, d2)
    crossed = np.einsum("t,ti,tj->ij", q1, r1, d1)
    outer = np.einsum("t,ti,tj->ij", q0, r1, r1) - crossed - crossed.T + np.einsum("t,ti,tj->ij", q2, d1, d1)
    return np.concatenate([[ll], gradient, (outer - second).ravel()])


class RiskSets:
    """Scaled covariates in long form, keyed by stratum and time bucket, ready for repeated evaluation."""

    def __init__(
        self,
        df: DataFrame,
        columns: Sequence[str],
        time: str,
        event: str,
        strata: Sequence[str] = (),
        start: str | None = None,
    ):
        self.columns, self.strata = list(columns), list(strata)
        self.scaler = {c: (m, s or 1.0) for c, (m, s) in fit_scaler(df, columns).items()}
        self.z = [f"z{i}" for i in range(len(columns))]
        scaled = {z: (F.col(c) - self.scaler[c][0]) / self.scaler[c][1] for z, c in zip(self.z, columns, strict=True)}
        keep = [*self.strata, *[F.col(z) for z in self.z], F.col("e"), F.col("t"), F.col("sign")]
        base = df.withColumns(scaled).withColumn("e", F.col(event).cast("int"))
        stop = base.withColumns({"t": F.col(time).cast("double"), "sign": F.lit(1.0)}).select(*keep)
        if start is not None:
            entry = base.withColumns({"t": F.col(start).cast("double"), "sign": F.lit(-1.0), "e": F.lit(0)}).select(*keep)
            stop = stop.unionByName(entry.filter(F.col("t").isNotNull()))
        counts = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("bigint")).alias("d")).first()
        self.n, self.events = counts["n"], counts["d"] or 0
        times = stop.select(*self.strata, "t").distinct()
        splits = sketch_splits(times, ["t"], bucket_count(df))["t"][0]
        self.few = times.limit(FEW_TIMES + 1).count() <= FEW_TIMES
        self.rows = materialize(assign_bucket(stop, "t", splits, "bucket"))

    def table(self, beta: np.ndarray, second: bool = True) -> DataFrame:
        """Per event time: risk-set sums ``R…``, event sums ``D…`` and ``X…``, events at or after it ``cum_d``."""
        p, z = len(self.z), [F.col(name) for name in self.z]
        rows = self.rows.withColumn("eta", V.dot(z, beta)).withColumn("w", F.exp("eta"))
        w, e, sign = F.col("w"), F.col("e"), F.col("sign")
        moments = {"0": F.lit(1.0)} | {f"1_{i}": z[i] for i in range(p)}
        if second:
            moments |= {f"2_{i}_{j}": z[i] * z[j] for i in range(p) for j in range(i, p)}
        sums = {f"R{name}": F.sum(sign * w * m) for name, m in moments.items()}
        events = {f"D{name}": F.sum(e * w * m) for name, m in moments.items()}
        events |= {f"X{i}": F.sum(e * z[i]) for i in range(p)}
        events |= {"d": F.sum(e.cast("double")), "eta": F.sum(e * F.col("eta"))}
        per_time = rows.groupBy(*self.strata, "bucket", "t").agg(
            *[c.alias(name) for name, c in {**sums, **events}.items()]
        )
        backwards = (
            W.partitionBy(*self.strata, "bucket").orderBy(F.col("t").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
        )
        cumulated = [*sums, "d"]
        per_time = with_offsets(per_time, ["bucket"], self.strata, {s: F.sum(s) for s in cumulated}, descending=True)
        running = {s: F.col(f"{s}_before") + F.sum(s).over(backwards) for s in cumulated}
        running["cum_d"] = running.pop("d")
        return per_time.withColumns(running).filter(F.col("d") > 0)

    def evaluate(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log partial likelihood, gradient and Hessian at ``beta`` (on scaled covariates).

        Every task reduces its event times to one vector of ``1 + p + p*p`` numbers; only their sum leaves
        the cluster.
        """
        if self.few:
            return self._evaluate_few(beta)
        p = len(self.z)

        def reduce(batches):
            total = np.zeros(1 + p + p * p)
            for pdf in batches:
                total += _likelihood_parts(pdf, p)
            yield pd.DataFrame({"parts": [total]})

        parts = self.table(beta).mapInPandas(reduce, "parts array<double>")
        values = np.zeros(1 + p + p * p)
        summed = parts.select(F.posexplode("parts")).groupBy("pos").agg(F.sum("col").alias("v"))
        for row in summed.collect():
            values[row["pos"]] = row["v"]
        return float(values[0]), values[1 : 1 + p], values[1 + p :].reshape(p, p)

    def _evaluate_few(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The same with ``FEW_TIMES`` times at most: one job with one shuffle, of one row per task and time.

        A task sums the products of its rows per stratum and time in blocks; the times of a stratum meet in one place,
        which cumulates them from the last one on. As in any sum a NULL does not count: a row without a covariate is
        in no risk set, and an event time without any is unknown.
        """
        p, z, weights = len(self.z), list(self.z), [float(b) for b in beta]
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        factors = [(), *[(i,) for i in range(p)], *pairs]
        moments = ["0", *[f"1_{i}" for i in range(p)], *[f"2_{i}_{j}" for i, j in pairs]]
        q, covariates = len(moments), [f"X{i}" for i in range(p)]
        # then how many values stand behind the sums of the events
        names = [*[f"R{m}" for m in moments], *[f"D{m}" for m in moments], *covariates, "d", "eta", "nD", *[f"n{c}" for c in covariates]]
        strata = [f"k{i}" for i in range(len(self.strata))]
        keys = [*strata, "t"]

        def added(table: pa.Table) -> pa.Table:
            sums = table.group_by(keys, use_threads=False).aggregate([(c, "sum") for c in names])
            return sums.select([*keys, *[f"{c}_sum" for c in names]]).rename_columns([*keys, *names])

        def block(table: pa.Table) -> pa.Table:
            x = [table.column(c).to_numpy() for c in z]
            known = [~table.column(c).is_null().to_numpy() for c in z]
            e, sign = table.column("e").cast(pa.float64()).to_numpy(), table.column("sign").to_numpy()
            counted = ~table.column("e").is_null().to_numpy()
            inside = np.logical_and.reduce([np.ones(len(e), bool), *known])
            died = inside & counted
            with np.errstate(over="ignore", invalid="ignore"):
                eta = sum((v * b for v, b in zip(x, weights, strict=True)), np.zeros(len(e)))
                w = np.exp(eta)
                products = [math.prod((x[i] for i in at), start=w) for at in factors]
                columns = [np.where(inside, sign * m, 0.0) for m in products] + [np.where(died, e * m, 0.0) for m in products]
                columns += [np.where(own & counted, e * v, 0.0) for v, own in zip(x, known, strict=True)]
                columns += [np.where(counted, e, 0.0), np.where(died, e * eta, 0.0)]
            columns += [flag.astype(np.float64) for flag in (died, *[own & counted for own in known])]
            places = [*[table.column(k) for k in strata], pc.add(table.column("t"), 0.0)]  # -0.0 is 0.0
            return added(pa.table([*places, *columns], names=[*keys, *names]))

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, rows, total = [], 0, None
            for batch in batches:
                held.append(batch)
                rows += batch.num_rows
                if rows >= HELD_ROWS:
                    found = block(pa.Table.from_batches(held))
                    total = found if total is None else added(pa.concat_tables([total, found]))
                    held, rows = [], 0
            if rows:
                found = block(pa.Table.from_batches(held))
                total = found if total is None else added(pa.concat_tables([total, found]))
            if total is not None:
                yield from total.to_batches()

        def reduced(table: pa.Table) -> pa.Table:
            sums = added(table).to_pandas()
            t = sums["t"].to_numpy(np.float64)
            sums = sums.iloc[np.argsort(-np.where(np.isnan(t), np.inf, t), kind="stable")]  # a time that is no number comes last
            sums[names[:q]] = sums[names[:q]].cumsum()
            sums = sums[sums["d"] > 0]
            sums.loc[sums["nD"] == 0, names[q : 2 * q]] = np.nan
            for c in covariates:
                sums.loc[sums[f"n{c}"] == 0, c] = np.nan
            parts = _likelihood_parts(sums, p) if len(sums) else np.zeros(1 + p + p * p)
            return pa.table({"pos": pa.array(np.arange(len(parts))), "v": pa.array(parts)})

        kinds = {f.name: f.dataType for f in self.rows.schema}
        renamed = [F.col(c).alias(k) for k, c in zip(strata, self.strata, strict=True)]
        place = [StructField(k, kinds[c]) for k, c in zip(strata, self.strata, strict=True)]
        schema = StructType([*place, *[StructField(c, DoubleType()) for c in ("t", *names)]])
        partial = self.rows.select(*renamed, "t", "e", "sign", *z).mapInArrow(summed, schema)
        parts = partial.withColumn("whole", F.lit(0)).groupBy("whole", *strata).applyInArrow(reduced, "pos long, v double")
        values = np.zeros(1 + p + p * p)
        for row in parts.groupBy("pos").agg(F.sum("v").alias("v")).collect():
            values[row["pos"]] = row["v"]
        return float(values[0]), values[1 : 1 + p], values[1 + p :].reshape(p, p)


@dataclass
class CoxModel:
    """A fitted model; coefficients refer to the original covariates, centred at their means."""

    columns: list[str]
    means: np.ndarray
    coefficients: np.ndarray
    covariance: np.ndarray
    log_likelihood: float
    n: int
    events: int
    iterations: int
    strata: list[str] = field(default_factory=list)
    baseline: DataFrame | None = None
    _sets: RiskSets | None = None
    _scaled: np.ndarray | None = None

    def linear_predictor(self) -> Column:
        terms = [(F.col(c) - float(m)) * float(b) for c, m, b in zip(self.columns, self.means, self.coefficients, strict=True)]
        return V.total(terms)

    def partial_hazard(self) -> Column:
        """``exp(beta . (x - mean))`` as a column expression."""
        return F.exp(self.linear_predictor())

    def concordance(self, df: DataFrame, time: str = "time", event: str = "event") -> DataFrame:
        """One row ``concordant, tied_risk, comparable, c_index`` of the model's risk on ``df``.

        A row censored at the time of an event outlives it. With strata only pairs of one stratum count, because
        risks of different baselines do not compare; the strata are groups of one pass, their counts added up.
        """
        scored = df.withColumn("_risk", self.linear_predictor())
        counts = concordance(scored, "_risk", time, event, tied_times=True, by=self.strata)
        names = ["concordant", "tied_risk", "comparable"]
        total = counts.agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names])
        share = F.try_divide(F.col("concordant") + F.col("tied_risk") / 2, F.col("comparable"))
        return total.withColumn("c_index", F.coalesce(share, F.lit(0.5)))

    def summary(self, spark) -> DataFrame:
        """Rows ``(feature, coef, hazard_ratio, se, lower, upper, z, p)``."""
        rows = []
        for i, name in enumerate(self.columns):
            coef, se = float(self.coefficients[i]), float(math.sqrt(max(self.covariance[i, i], 0.0)))
            z = coef / se if se else float("nan")
            p = math.erfc(abs(z) / math.sqrt(2)) if se else float("nan")
            rows.append((name, coef, math.exp(coef), se, math.exp(coef - 1.96 * se), math.exp(coef + 1.96 * se), z, p))
        return spark.createDataFrame(
            rows, "feature string, coef double, hazard_ratio double, se double, lower double, upper double, z double, p double"
        )


def fit_cox(
    df: DataFrame,
    columns: Sequence[str],
    time: str = "time",
    event: str = "event",
    penalizer: float = 0.0,
    strata: Sequence[str] = (),
    start: str | None = None,
    tolerance: float = 1e-8,
    max_iterations: int = 25,
) -> CoxModel:
    """Maximise ``log-likelihood / n - penalizer / 2 * |beta|^2`` over standardised covariates (Efron ties)."""
    sets = RiskSets(df, columns, time, event, strata, start)
    p = len(sets.z)
    ridge = penalizer * sets.n
    objective = lambda ll, b: ll - ridge / 2 * float(b @ b)
    beta = np.zeros(p)
    ll, g, h = sets.evaluate(beta)
    iteration = 0
    for iteration in range(1, max_iterations + 1):
        step = np.linalg.lstsq(-(h - ridge * np.eye(p)), g - ridge * beta, rcond=None)[0]
        scale = 1.0
        while True:
            candidate = beta + scale * step
            new_ll, new_g, new_h = sets.evaluate(candidate)
            if objective(new_ll, candidate) >= objective(ll, beta) - 1e-9 * abs(ll) or scale < 1e-3:
                break
            scale /= 2
        done = float(np.max(np.abs(candidate - beta), initial=0.0)) < tolerance
        beta, ll, g, h = candidate, new_ll, new_g, new_h
        if done or float(np.max(np.abs(step), initial=0.0)) < tolerance:
            break
    scales = np.array([sets.scaler[c][1] for c in sets.columns])
    covariance = np.linalg.pinv(-(h - ridge * np.eye(p))) / np.outer(scales, scales)
    return CoxModel(
        list(columns),
        np.array([sets.scaler[c][0] for c in sets.columns]),
        beta / scales,
        covariance,
        ll,
        sets.n,
        sets.events,
        iteration,
        list(strata),
        None,
        sets,
        beta,
    )


def baseline_hazard(model: CoxModel) -> DataFrame:
    """Breslow cumulative baseline hazard at each event time: ``(strata…, t, h0)``."""
    table = model._sets.table(model._scaled, second=False)
    steps = materialize(table.select(*model.strata, "t", (F.col("d") / F.col("R0")).alias("h")))
    return running_totals(steps, "t", ["h"], model.strata).select(*model.strata, "t", F.col("cum_h").alias("h0"))


def predict_survival(df: DataFrame, model: CoxModel, times: Sequence[float]) -> DataFrame:
    """Columns ``surv_{t}``: ``exp(-H0(t) * partial hazard)`` with the baseline of the row's stratum.

    A stratum of the fit without events so far has ``H0 = 0``; a stratum the fit has not seen gives NULL.
    """
    base = baseline_hazard(model)
    at = [F.max(F.when(F.col("t") <= t, F.col("h0"))).alias(f"_h{i}") for i, t in enumerate(times)]
    known = model._sets.rows.select(*model.strata).distinct() if model.strata else base.sparkSession.range(1).select()
    hazards = base.groupBy(*model.strata).agg(*at)
    if model.strata:
        hazards = join_null_safe(known, hazards, model.strata, "left")
    hazards = hazards.select(*model.strata, *[F.coalesce(F.col(f"_h{i}"), F.lit(0.0)).alias(f"_h{i}") for i in range(len(times))])
    if model.strata:
        placed = join_null_safe(df, hazards, model.strata, "left")
    else:
        row = hazards.first()
        placed = df.withColumns({f"_h{i}": F.lit(float(row[f"_h{i}"])) for i in range(len(times))})
    risk = model.partial_hazard()
    out = placed.withColumns({f"surv_{t:g}": F.exp(-F.col(f"_h{i}") * risk) for i, t in enumerate(times)})
    return out.drop(*[f"_h{i}" for i in range(len(times))])


def predict_median(df: DataFrame, model: CoxModel, out: str = "median") -> DataFrame:
    """First time with predicted survival at or below one half; NULL when it is never reached.

    With strata, rows meet the baseline of their own stratum, all strata in one lookup; a stratum that the fit has
    not seen gives NULL.
    """
    needed = df.withColumn("_need", math.log(2) / model.partial_hazard())
    steps = baseline_hazard(model).groupBy("h0", *model.strata).agg(F.min("t").alias("t"))
    return step_lookup(needed, "_need", steps, "h0", "t", out, forward=True, by=model.strata).drop("_need")


def proportional_hazard_test(model: CoxModel) -> DataFrame:
    """Rows ``(feature, statistic, p)``: scaled Schoenfeld residuals against the rank of the event time.

    All events of one time share rank and expectation, so their residuals are needed only as per-time
    sums, and the test is one aggregation over the per-time table.
    """
    from ebbtide.operators.km import chi_square_tail

    sets, p, deaths = model._sets, len(model.columns), float(model.events)
    if sets.strata:
        ranks = running_totals(
            materialize(sets.rows.groupBy("t").agg(F.sum(F.col("e").cast("double")).alias("all_d")).filter("all_d > 0")), "t", ["all_d"]
        ).select("t", (F.col("cum_all_d") - (F.col("all_d") - 1) / 2).alias("rank"))
        table = step_lookup(sets.table(model._scaled, second=False), "t", ranks, "t", "rank", "rank")
    else:
        table = sets.table(model._scaled, second=False).withColumn(
            "rank", deaths - F.col("cum_d") + (F.col("d") + 1) / 2
        )
    middle = (deaths + 1) / 2

    def reduce(batches):
        spread, u = 0.0, np.zeros(p)
        for pdf in batches:
            d, centred = pdf["d"].to_numpy(np.float64), pdf["rank"].to_numpy(np.float64) - middle
            r1, d1 = (pdf[[f"{s}1_{i}" for i in range(p)]].to_numpy(np.float64) for s in "RD")
            ties = _efron_sums(d, pdf["R0"].to_numpy(np.float64), pdf["D0"].to_numpy(np.float64))
            residual = pdf[[f"X{i}" for i in range(p)]].to_numpy(np.float64) - (ties[:, :1] * r1 - ties[:, 1:2] * d1)
            spread += float((d * centred**2).sum())
            u += centred @ residual
        yield pd.DataFrame({"spread": [spread], "u": [u]})

    sums = table.mapInPandas(reduce, "spread double, u array<double>")
    row = sums.agg(F.sum("spread").alias("spread"), *[F.sum(F.col("u")[i]).alias(f"u{i}") for i in range(p)]).first()
    scales = np.array([sets.scaler[c][1] for c in sets.columns])
    variance = model.covariance * np.outer(scales, scales)
    u = np.array([row[f"u{i}"] or 0.0 for i in range(p)])
    scaled = deaths * variance @ u
    rows = []
    for i, name in enumerate(model.columns):
        statistic = float(scaled[i] ** 2 / (deaths * variance[i, i] * row["spread"]))
        rows.append((name, statistic, chi_square_tail(statistic, 1)))
    return sets.rows.sparkSession.createDataFrame(rows, "feature string, statistic double, p double")


def fit_elastic_net(
    df: DataFrame,
    columns: Sequence[str],
    l1_ratio: float = 0.9,
    alphas: Sequence[float] | None = None,
    n_alphas: int = 5,
    min_ratio: float = 0.05,
    time: str = "time",
    event: str = "event",
    max_iterations: int = 10,
    tolerance: float = 1e-6,
) -> DataFrame:
    """Elastic-net path: rows ``(alpha, feature, coef)`` on standardised covariates.

    Minimises ``-loglik/n + alpha * (l1_ratio |b|_1 + (1 - l1_ratio)/2 |b|^2)`` by proximal Newton steps: one
    Spark job gives gradient and Hessian, coordinate descent on the small quadratic model runs on the driver.
    """
    sets = RiskSets(df, columns, time, event)
    p, n = len(columns), float(sets.n)
    beta = np.zeros(p)
    _, g, h = sets.evaluate(beta)
    if alphas is None:
        top = float(np.max(np.abs(g))) / n / l1_ratio
        alphas = [top * min_ratio ** (i / max(n_alphas - 1, 1)) for i in range(n_alphas)]
    rows = []
    for alpha in alphas:
        for _ in range(max_iterations):
            new = _quadratic_elastic_net(beta, -g / n, -h / n, alpha, l1_ratio)
            moved = float(np.max(np.abs(new - beta)))
            beta = new
            if moved < tolerance:
                break
            _, g, h = sets.evaluate(beta)
        rows += [(float(alpha), c, float(b)) for c, b in zip(columns, beta, strict=True)]
    return df.sparkSession.createDataFrame(rows, "alpha double, feature string, coef double")


def _quadratic_elastic_net(beta, gradient, hessian, alpha, l1_ratio, sweeps=500):
    """Minimise the local quadratic model plus the penalty by cyclic soft thresholding."""
    x = beta.copy()
    for _ in range(sweeps):
        largest = 0.0
        for j in range(len(x)):
            slope = gradient[j] + hessian[j] @ (x - beta) - hessian[j, j] * x[j]
            weight = hessian[j, j] + alpha * (1 - l1_ratio)
            value = -np.sign(slope) * max(abs(slope) - alpha * l1_ratio, 0.0) / weight if weight > 0 else 0.0
            largest, x[j] = max(largest, abs(value - x[j])), value
        if largest < 1e-10:
            break
    return x
