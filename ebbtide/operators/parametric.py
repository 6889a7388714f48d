"""Parametric survival: exponential, Weibull, and accelerated-failure-time regressions.

Univariate fits work on a histogram of (time, event). Regressions send one partial sum per partition
(log-likelihood, gradient, Hessian, computed on Arrow batches with NumPy) to a tree-less sum on the
driver, which solves a small Newton system.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import AFTSurvivalRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions import vectors as V
from ebbtide.operators.metrics import concordance
from ebbtide.operators.quality import fit_scaler
from ebbtide.session import materialize

SHORTEST = 0.5  # times at or below zero have no logarithm; they are raised to this


def _scaled_erfc(x: float) -> float:
    """``exp(x^2) erfc(x)`` for x >= 0: directly, or by its continued fraction where ``erfc`` gets small."""
    if x < 4:
        return math.exp(x * x) * math.erfc(x)
    fraction = x
    for k in range(80, 0, -1):
        fraction = x + k / 2 / fraction
    return 1 / (math.sqrt(math.pi) * fraction)


# the scaled function is smooth in 2 / (2 + x), which maps [0, infinity) to (0, 1]: one Chebyshev series serves all x
_NODES = 0.5 + 0.5 * np.cos(np.pi * (np.arange(48) + 0.5) / 48)
_SERIES = np.polynomial.chebyshev.chebfit(2 * _NODES - 1, [_scaled_erfc(2 / u - 2) / u for u in _NODES], 40)


def _erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function of a whole array."""
    size = np.abs(x)
    u = 2 / (2 + size)
    with np.errstate(under="ignore"):
        upper = u * np.polynomial.chebyshev.chebval(2 * u - 1, _SERIES) * np.exp(-size * size)
    return np.where(x < 0, 2 - upper, upper)


def _positive_time(time: str) -> Column:
    return F.greatest(F.col(time).cast("double"), F.lit(SHORTEST))


def _time_counts(df: DataFrame, time: str, event: str) -> DataFrame:
    return df.groupBy(_positive_time(time).alias("t")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(event).cast("double")).alias("d")
    )


def fit_exponential(df: DataFrame, time: str = "time", event: str = "event") -> DataFrame:
    """One row ``(scale, log_likelihood, aic)``: mean time per event."""
    sums = df.agg(F.sum(_positive_time(time)).alias("t"), F.sum(F.col(event).cast("double")).alias("d"))
    scale = F.try_divide(F.col("t"), F.col("d"))
    ll = -F.col("d") * F.ln(scale) - F.col("t") / scale
    return sums.select(scale.alias("scale"), ll.alias("log_likelihood"), (2 - 2 * ll).alias("aic"))


def fit_weibull(df: DataFrame, time: str = "time", event: str = "event", tolerance: float = 1e-10) -> DataFrame:
    """One row ``(shape, scale, log_likelihood, aic, hazard)``; ``hazard`` says whether risk rises or falls.

    The scale has a closed form given the shape; each Newton step for the shape is one aggregation of
    three sums over the time histogram.
    """
    counts = materialize(_time_counts(df, time, event))
    first = counts.agg(
        F.sum("d").alias("d"), F.sum(F.col("d") * F.ln("t")).alias("dl"), F.max("t").alias("top")
    ).first()
    d, mean_log, top = first["d"], first["dl"] / first["d"], first["top"]
    k = 1.0
    for _ in range(100):
        power = F.pow(F.col("t") / top, F.lit(k))  # scaled so that large times cannot overflow
        log = F.ln("t")
        s = counts.agg(
            F.sum(F.col("n") * power).alias("a"),
            F.sum(F.col("n") * power * log).alias("b"),
            F.sum(F.col("n") * power * log * log).alias("c"),
        ).first()
        ratio = s["b"] / s["a"]
        value = 1 / k + mean_log - ratio
        slope = -1 / k**2 - (s["c"] / s["a"] - ratio**2)
        step = -value / slope
        k = k + step if k + step > 0 else k / 2
        if abs(step) < tolerance * k:
            break
    total = counts.agg(F.sum(F.col("n") * F.pow(F.col("t") / top, F.lit(k)))).first()[0]
    scale = top * (total / d) ** (1 / k)
    ll = d * math.log(k) - d * k * math.log(scale) + (k - 1) * first["dl"] - d
    kind = "flat" if abs(k - 1) < 0.05 else ("rises" if k > 1 else "falls")
    row = [(float(k), float(scale), float(ll), float(4 - 2 * ll), kind)]
    return df.sparkSession.createDataFrame(row, "shape double, scale double, log_likelihood double, aic double, hazard string")


# ---- accelerated failure time ---------------------------------------------------------------------------------


def _normal_tail(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ln(1 - Phi(z))`` and the hazard ``phi / (1 - Phi)``, stable far in the tail."""
    far = z > 30
    safe = np.where(far, 0.0, z)
    tail = 0.5 * _erfc(safe / math.sqrt(2))
    log_tail = np.log(np.maximum(tail, 1e-300))
    hazard = np.exp(-safe * safe / 2 - 0.5 * math.log(2 * math.pi) - log_tail)
    x = np.where(far, z, 31.0)
    far_hazard = x + 1 / x - 2 / x**3
    far_log = -x * x / 2 - 0.5 * math.log(2 * math.pi) - np.log(far_hazard)
    return np.where(far, far_log, log_tail), np.where(far, far_hazard, hazard)


def _terms(family: str, z: np.ndarray, event: np.ndarray):
    """Log-density (event) or log-survival (censored) of the standard error and its two derivatives."""
    if family == "weibull":
        grown = np.exp(np.minimum(z, 100))  # a trial step this far off is rejected anyway
        return event * z - grown, event - grown, -grown
    if family == "loglogistic":
        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        weight = 1 + event
        soft = np.logaddexp(0, z)
        return event * z - weight * soft, event - weight * p, -weight * p * (1 - p)
    if family == "lognormal":
        log_tail, hazard = _normal_tail(z)
        value = np.where(event == 1, -z * z / 2 - 0.5 * math.log(2 * math.pi), log_tail)
        return value, np.where(event == 1, -z, -hazard), np.where(event == 1, -1.0, -hazard * (hazard - z))
    raise ValueError(f"unknown family {family!r}")


def _partial_sums(family: str, theta: np.ndarray, columns: int):
    """Batch function: one row ``[ll, gradient…, Hessian…]`` per partition for ``(intercept, beta, ln sigma)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        beta, log_sigma = theta[:-1], theta[-1]
        sigma = math.exp(log_sigma)
        p = columns + 1
        ll, g, h = 0.0, np.zeros(p + 1), np.zeros((p + 1, p + 1))
        for pdf in batches:
            values = pdf.to_numpy(np.float64)
            x = np.column_stack([np.ones(len(values)), values[:, :columns]])
            y, e, n = values[:, columns], values[:, columns + 1], values[:, columns + 2]
            z = (y - x @ beta) / sigma
            value, first, second = _terms(family, z, e)
            ll += float(n @ (value - e * (log_sigma + y)))
            g[:p] += -(n * first) @ x / sigma
            g[p] += float(n @ (-first * z - e))
            h[:p, :p] += (x * (n * second)[:, None]).T @ x / sigma**2
            cross = (n * (second * z + first)) @ x / sigma
            h[:p, p] += cross
            h[p, :p] += cross
            h[p, p] += float(n @ (second * z * z + first * z))
        yield pd.DataFrame({"sums": [np.concatenate([[ll], g, h.ravel()])]})

    return run


_SUMS = T.StructType([T.StructField("sums", T.ArrayType(T.DoubleType()))])


@dataclass
class AftModel:
    """``ln T = intercept + coefficients . x + sigma * error``; coefficients refer to the original covariates."""

    family: str
    columns: list[str]
    intercept: float
    coefficients: list[float]
    sigma: float
    log_likelihood: float
    covariance: np.ndarray | None = None  # of the coefficients

    @property
    def aic(self) -> float:
        return 2 * (len(self.columns) + 2) - 2 * self.log_likelihood

    def location(self) -> Column:
        terms = [F.lit(self.intercept), *[F.col(c) * b for c, b in zip(self.columns, self.coefficients, strict=True)]]
        return V.total(terms)

    def median(self) -> Column:
        """Predicted median time."""
        shift = self.sigma * math.log(math.log(2)) if self.family == "weibull" else 0.0
        return F.exp(self.location() + shift)

    def survival(self, t: Column) -> Column:
        """Survival at a positive time, beyond the observed range if asked for."""
        z = (F.ln(t) - self.location()) / self.sigma
        if self.family == "weibull":
            return F.exp(-F.exp(z))
        if self.family == "loglogistic":
            return 1 / (1 + F.exp(z))
        return normal_survival(z)

    def hazard(self, t: Column) -> Column:
        z = (F.ln(t) - self.location()) / self.sigma
        if self.family == "weibull":
            return F.exp(z) / (self.sigma * t)
        if self.family == "loglogistic":
            return 1 / ((1 + F.exp(-z)) * self.sigma * t)
        return F.exp(-z * z / 2) / (math.sqrt(2 * math.pi) * self.sigma * t) / normal_survival(z)

    def time_ratios(self, spark: SparkSession) -> DataFrame:
        """Rows ``(feature, coef, time_ratio)``; a ratio above 1 delays the event."""
        rows = [(c, float(b), math.exp(b)) for c, b in zip(self.columns, self.coefficients, strict=True)]
        return spark.createDataFrame(rows, "feature string, coef double, time_ratio double")

    def summary(self, spark: SparkSession) -> DataFrame:
        """Rows ``(feature, coef, time_ratio, se, lower, upper, z, p)``; the bounds are those of the ratio at 95 %.

        Standard errors are Wald's, from the observed information of all parameters; NULL where it is singular.
        """
        rows = []
        for i, (name, coef) in enumerate(zip(self.columns, self.coefficients, strict=True)):
            variance = float("nan") if self.covariance is None else float(self.covariance[i, i])
            if variance > 0:
                se = math.sqrt(variance)
                z = coef / se
                rest = (se, math.exp(coef - 1.96 * se), math.exp(coef + 1.96 * se), z, math.erfc(abs(z) / math.sqrt(2)))
            else:
                rest = (None,) * 5
            rows.append((name, float(coef), math.exp(coef), *rest))
        return spark.createDataFrame(
            rows, "feature string, coef double, time_ratio double, se double, lower double, upper double, z double, p double"
        )


@F.pandas_udf(T.DoubleType())
def normal_survival(z: pd.Series) -> pd.Series:
    """``1 - Phi(z)`` on Arrow batches; Spark has no error function."""
    return pd.Series(0.5 * _erfc(z.to_numpy(np.float64) / math.sqrt(2)))


def fit_aft(
    df: DataFrame,
    columns: Sequence[str],
    family: str = "weibull",
    time: str = "time",
    event: str = "event",
    max_iterations: int = 50,
    tolerance: float = 1e-9,
) -> AftModel:
    """Maximum likelihood by damped Newton steps; families ``weibull``, ``lognormal``, ``loglogistic``."""
    scaler = {c: (m, s or 1.0) for c, (m, s) in fit_scaler(df, columns).items()}
    names = [f"x{i}" for i in range(len(columns))]
    rows = materialize(
        df.select(
            *[((F.col(c) - scaler[c][0]) / scaler[c][1]).alias(x) for x, c in zip(names, columns, strict=True)],
            F.ln(_positive_time(time)).alias("y"),
            F.col(event).cast("double").alias("e"),
            F.lit(1.0).alias("n"),
        )
    )
    size = len(columns) + 2

    def evaluate(theta):
        parts = rows.mapInPandas(_partial_sums(family, theta, len(columns)), _SUMS)
        total = parts.select(*[F.sum(F.element_at("sums", i + 1)) for i in range(1 + size + size * size)])
        values = np.array([v or 0.0 for v in total.first()])
        return values[0], values[1 : 1 + size], values[1 + size :].reshape(size, size)

    start = rows.agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).first()
    theta = np.zeros(size)
    theta[0], theta[-1] = start["m"], math.log(start["s"] or 1.0)
    ll, g, h = evaluate(theta)
    for _ in range(max_iterations):
        curvature = -h
        lowest = float(np.linalg.eigvalsh(curvature)[0])
        if lowest <= 0:  # far from the maximum: lean towards steepest ascent
            curvature = curvature + (1e-3 * abs(np.trace(curvature)) / size - lowest) * np.eye(size)
        step = np.linalg.solve(curvature, g)
        scale = 1.0 / max(1.0, abs(step[-1]))  # the spread moves by at most a factor e
        while True:
            trial = theta + scale * step
            new = evaluate(trial)
            if (np.isfinite(new[0]) and new[0] >= ll - 1e-10 * abs(ll)) or scale < 1e-6:
                break
            scale /= 2
        gained = new[0] - ll
        theta, (ll, g, h) = trial, new
        if float(np.max(np.abs(scale * step))) < 1e-7 or abs(gained) < tolerance * abs(ll):
            break
    coefficients = [theta[i + 1] / scaler[c][1] for i, c in enumerate(columns)]
    intercept = theta[0] - sum(b * scaler[c][0] for b, c in zip(coefficients, columns, strict=True))
    spread = np.array([scaler[c][1] for c in columns])
    covariance = _coefficient_covariance(h, spread)
    return AftModel(family, list(columns), float(intercept), [float(b) for b in coefficients], math.exp(theta[-1]), float(ll), covariance)


def _coefficient_covariance(hessian: np.ndarray, spread: np.ndarray) -> np.ndarray | None:
    """Covariance of the original coefficients from the Hessian in ``(intercept, scaled beta, ln sigma)``."""
    try:
        inverse = np.linalg.inv(-hessian)
    except np.linalg.LinAlgError:
        return None
    return inverse[1:-1, 1:-1] / np.outer(spread, spread)


def fit_weibull_aft(df: DataFrame, columns: Sequence[str], time: str = "time", event: str = "event", **params) -> AftModel:
    """Weibull regression by the estimator of Spark ML, returned in the same form with its log-likelihood."""
    staged = VectorAssembler(inputCols=list(columns), outputCol="features").transform(
        df.select(*columns, _positive_time(time).alias("label"), F.col(event).cast("double").alias("censor"))
    )
    fitted = AFTSurvivalRegression(maxIter=100, tol=1e-9, **params).fit(staged)
    model = AftModel("weibull", list(columns), float(fitted.intercept), [float(b) for b in fitted.coefficients], float(fitted.scale), 0.0)
    size, theta = len(columns) + 2, np.array([model.intercept, *model.coefficients, math.log(model.sigma)])
    rows = staged.select(*columns, F.ln("label").alias("y"), F.col("censor").alias("e"), F.lit(1.0).alias("n"))
    sums = rows.mapInPandas(_partial_sums("weibull", theta, len(columns)), _SUMS)
    total = sums.select(*[F.sum(F.element_at("sums", i + 1)) for i in range(1 + size + size * size)]).first()
    model.log_likelihood = float(total[0])
    model.covariance = _coefficient_covariance(np.array(total[1 + size :]).reshape(size, size), np.ones(len(columns)))
    return model


def aic_table(spark: SparkSession, models: Sequence[AftModel], df: DataFrame | None = None) -> DataFrame:
    """Rows ``(family, log_likelihood, aic, best)``, lowest AIC first.

    With ``df`` (``time, event`` and the covariates) also ``c_index``, the concordance of the predicted median times
    there; all families are groups of one pass.
    """
    best = min(models, key=lambda m: m.aic)
    rows = [(m.family, m.log_likelihood, m.aic, int(m is best)) for m in models]
    table = spark.createDataFrame(rows, "family string, log_likelihood double, aic double, best int")
    if df is not None:
        risks = [F.struct(F.lit(m.family).alias("family"), (-m.median()).alias("risk")) for m in models]
        long = df.select("time", "event", F.explode(F.array(*risks)).alias("r")).select("time", "event", "r.*")
        ranked = concordance(long, "risk", tied_times=True, by=["family"])
        table = table.join(ranked.select("family", "c_index"), "family", "left")
    return table.orderBy("aic")


def parametric_curves(df: DataFrame, model: AftModel, times: Sequence[float], row_id: str = "id") -> DataFrame:
    """Rows ``(id, t, surv, hazard)`` of the fitted curve at any positive times."""
    exploded = df.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in times])))
    return exploded.select(row_id, "t", model.survival(F.col("t")).alias("surv"), model.hazard(F.col("t")).alias("hazard"))
