"""Targets: time to silence, fixed-window inactivity, horizon labels, and their consistency checks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.operators.ranks import quantile_map


def silence_label(daily: DataFrame, entities: DataFrame, cutoff: date, silent_days: int, t_max: int) -> DataFrame:
    """Days from ``cutoff`` to the first day that opens ``silent_days`` inactive days in a row.

    ``id, time, event``: ``event`` is 1 when such a day comes before ``t_max``, otherwise the entity is
    censored at ``t_max``. Activity must be observed for ``t_max + silent_days - 1`` days after the
    cutoff. The day before the cutoff acts as an active day; ``daily`` has one row per entity and day.
    """
    end = cutoff + timedelta(days=t_max + silent_days - 1)
    anchor = F.lit(cutoff - timedelta(days=1))
    active = daily.filter((F.col("d") >= F.lit(cutoff)) & (F.col("d") < F.lit(end))).select("id", "d")
    days = entities.select("id", anchor.alias("d")).unionByName(active.join(entities.select("id"), "id", "left_semi"))
    following = F.coalesce(F.lead("d").over(W.partitionBy("id").orderBy("d")), F.lit(end))
    silent = days.withColumn("quiet", F.datediff(following, F.col("d")) - 1)
    starts = F.when(F.col("quiet") >= silent_days, F.datediff("d", anchor))
    first = silent.groupBy("id").agg(F.min(starts).alias("starts"))
    event = F.coalesce(F.col("starts") < t_max, F.lit(False))
    return first.select(
        "id", F.when(event, F.col("starts")).otherwise(F.lit(t_max)).cast("int").alias("time"), event.cast("int").alias("event")
    )


def inactivity_label(daily: DataFrame, entities: DataFrame, cutoff: date, days: int) -> DataFrame:
    """1 for entities without a single transaction in the ``days`` days from ``cutoff``."""
    end = cutoff + timedelta(days=days)
    active = daily.filter((F.col("d") >= F.lit(cutoff)) & (F.col("d") < F.lit(end))).groupBy("id").agg(F.sum("c").alias("cnt"))
    return entities.select("id").join(active, "id", "left").select("id", F.col("cnt").isNull().cast("int").alias("churn"))


def horizon_labels(outcomes: DataFrame, horizons: Sequence[int] = (30, 60, 90)) -> DataFrame:
    """``surv_h`` = 1 when the time exceeds horizon ``h``."""
    return outcomes.withColumns({f"surv_{h}": (F.col("time") > h).cast("int") for h in horizons})


def base_survival(outcomes: DataFrame, horizons: Sequence[int] = (30, 60, 90)) -> DataFrame:
    rates = [F.avg((F.col("time") > h).cast("int")).alias(f"surv_{h}") for h in horizons]
    return outcomes.agg(F.avg("event").alias("event_rate"), *rates)


def known_by_horizon(outcomes: DataFrame, horizon: float) -> DataFrame:
    """Event-by-horizon label of the rows whose status at the horizon is known; the others are dropped."""
    time, event = F.col("time"), F.col("event")
    by_then = (time <= horizon) & (event == 1)
    return outcomes.filter(by_then | (time > horizon)).withColumn("label", by_then.cast("int"))


def unknown_share(outcomes: DataFrame, horizon: float) -> DataFrame:
    time, event = F.col("time"), F.col("event")
    known = ((time <= horizon) & (event == 1)) | (time > horizon)
    return outcomes.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(known).alias("known"),
        F.avg((~known).cast("int")).alias("dropped_share"),
        F.count_if(known & (time <= horizon)).alias("events"),
    )


def censoring_check(outcomes: DataFrame, t_max: int) -> DataFrame:
    """Whether every censored row ends at ``t_max`` and every event comes earlier."""
    censored = F.col("event") == 0
    return outcomes.agg(
        F.count_if(censored).alias("censored"),
        F.bool_and(~censored | (F.col("time") == t_max)).cast("int").alias("censored_at_end"),
        F.bool_and(F.col("time").between(0, t_max)).cast("int").alias("in_range"),
    )


def follow_up_summary(outcomes: DataFrame) -> DataFrame:
    median = quantile_map(outcomes, ["time"], [0.5])["time"][0]
    return outcomes.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("event").alias("event_rate"),
        (1 - F.avg("event")).alias("censoring_rate"),
        F.min("time").alias("min_time"),
        F.lit(median).alias("median_time"),
        F.max("time").alias("max_time"),
    )


def id_overlap(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Share of the ids of ``left`` that occur in ``right``."""
    ids = right.select(key).distinct().withColumn("_there", F.lit(1))
    matched = left.select(key).distinct().join(ids, key, "left")
    return matched.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("_there").alias("shared"),
        (F.count("_there") / F.count(F.lit(1))).alias("share"),
    )
