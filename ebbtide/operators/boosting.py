"""Person-period models on Spark ML trees, and boosting on survival likelihoods.

Hazard forests and hazard boosting classify person-period rows; boosted Cox and boosted AFT are histogram
boosters (``histboost``). Results are not numerically those of other libraries.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.columns import left_closed_bin
from ebbtide.operators import histboost
from ebbtide.operators.histboost import HistogramModel, Target
from ebbtide.session import materialize

# ---- person-period models ---------------------------------------------------------------------------------------


def person_periods(df: DataFrame, cuts: Sequence[float], time: str = "time", event: str = "event") -> DataFrame:
    """One row per entity and period lived through: ``period``, ``died``; periods are ``[cut, next cut)``.

    At most ``len(cuts)`` rows per entity, made by ``explode`` without a shuffle. The last period of a censored
    entity is only partly observed and is left out unless the entity leaves at its end.
    """
    last = left_closed_bin(F.col(time), list(cuts)[1:])
    whole = F.when(F.col(event) == 1, last).otherwise(left_closed_bin(F.col(time), list(cuts)[1:]) - 1)
    periods = F.when(whole >= 0, F.sequence(F.lit(0), whole))
    return (
        df.withColumn("_last", last)
        .withColumn("period", F.explode(periods))
        .withColumn("died", ((F.col("period") == F.col("_last")) & (F.col(event) == 1)).cast("int"))
        .drop("_last")
    )


@dataclass
class HazardModel:
    """A classifier of dying within a period given the covariates and the period number."""

    features: list[str]
    cuts: list[float]
    classifier: object

    def hazards(self, df: DataFrame, row_id: str = "id") -> DataFrame:
        """Rows ``(id, period, hazard)`` for every period."""
        periods = df.select(row_id, *self.features).withColumn(
            "period", F.explode(F.array(*[F.lit(i) for i in range(len(self.cuts))]))
        )
        assembled = VectorAssembler(inputCols=[*self.features, "period"], outputCol="features", handleInvalid="keep").transform(periods)
        return self.classifier.transform(assembled).select(row_id, "period", vector_to_array("probability")[1].alias("hazard"))

    def risk(self, df: DataFrame, row_id: str = "id") -> DataFrame:
        """Rows ``(id, risk)``: summed hazard over the periods."""
        return self.hazards(df, row_id).groupBy(row_id).agg(F.sum("hazard").alias("risk"))

    def survival(self, df: DataFrame, at: Sequence[int], row_id: str = "id") -> DataFrame:
        """Columns ``surv_{i}``: probability of outliving period ``i``."""
        log_left = F.ln(F.greatest(1 - F.col("hazard"), F.lit(1e-12)))
        out = [F.exp(F.sum(F.when(F.col("period") <= i, log_left).otherwise(F.lit(0.0)))).alias(f"surv_{i}") for i in at]
        return self.hazards(df, row_id).groupBy(row_id).agg(*out)


def fit_hazard_model(
    df: DataFrame, features: Sequence[str], cuts: Sequence[float], kind: str = "forest", time="time", event="event", **params
) -> HazardModel:
    """``forest`` or ``gbt`` on the person-period table."""
    rows = person_periods(df.select(*features, time, event), cuts, time, event)
    assembled = VectorAssembler(inputCols=[*features, "period"], outputCol="features", handleInvalid="keep").transform(rows)
    if kind == "forest":
        settings = {"numTrees": 30, "maxDepth": 6, "minInstancesPerNode": 15, "featureSubsetStrategy": "sqrt", "seed": 42} | params
        learner = RandomForestClassifier(labelCol="died", **settings)
    else:
        settings = {"maxIter": 20, "maxDepth": 3, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": 42} | params
        learner = GBTClassifier(labelCol="died", **settings)
    return HazardModel(list(features), [float(c) for c in cuts], learner.fit(materialize(assembled.select("features", "died"))))


# ---- gradient boosting on survival likelihoods ---------------------------------------------------------------------


@dataclass
class BoostedModel:
    """A histogram booster; for AFT the value is ln(time), for Cox the log risk."""

    fitted: HistogramModel

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        """Adds ``out``: the score, or the mean over the folds of a fit by folds."""
        return self.fitted.mean_score(df).withColumnRenamed(_SCORE, out)


_SCORE = "__boosted"


def fit_boosted_cox(
    df: DataFrame, features: Sequence[str], row_id: Sequence[str], rounds: int = 50, rate: float = 0.1, depth: int = 3,
    subsample: float = 0.8, seed: int = 42, time: str = "time", event: str = "event",
) -> BoostedModel:
    """Newton trees on the Cox partial likelihood; higher score = sooner event."""
    target = Target(_SCORE, "cox", rounds=rounds, depth=depth, rate=rate)
    return BoostedModel(histboost.fit(df, features, [target], row_id, time=time, event=event, subsample=subsample, seed=seed))


def fit_boosted_aft(
    df: DataFrame, features: Sequence[str], row_id: Sequence[str], rounds: int = 50, rate: float = 0.1, depth: int = 3,
    subsample: float = 0.8, sigma: float = 1.0, seed: int = 42, time: str = "time", event: str = "event",
) -> BoostedModel:
    """Newton trees on the normal AFT likelihood of ln(time); censored rows are lower bounds."""
    target = Target(_SCORE, "aft", rounds=rounds, depth=depth, rate=rate)
    return BoostedModel(
        histboost.fit(df, features, [target], row_id, time=time, event=event, subsample=subsample, sigma=sigma, seed=seed)
    )
