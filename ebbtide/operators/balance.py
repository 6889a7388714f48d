"""Balance features from a snapshot table ``(id, d, b)`` with one row per account and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.functions.columns import avg_if, count_if, max_if, std_if
from ebbtide.window import ObservationWindow

EMPTY_WALLET = 1.0  # a balance at or below this counts as zero


def daily_closing(balances: DataFrame) -> DataFrame:
    """One row per account and day where a source repeats days: the largest balance of the day wins."""
    return balances.groupBy("id", "d").agg(F.max("b").alias("b"))


def _level_columns(window: ObservationWindow):
    d, b = F.col("d"), F.col("b")
    full, recent, short = window.full, window.recent, window.short
    in_recent, in_short = window.in_span(d, recent), window.in_span(d, short)
    empty = b <= EMPTY_WALLET
    out = [
        F.max_by(b, d).alias("bal_last"),
        F.avg(b).alias(f"bal_mean_{full}"),
        F.stddev_samp(b).alias(f"bal_std_{full}"),
        F.min(b).alias(f"bal_min_{full}"),
        F.max(b).alias(f"bal_max_{full}"),
        avg_if(in_recent, b).alias(f"bal_mean_{recent}"),
        std_if(in_recent, b).alias(f"bal_std_{recent}"),
    ]
    if window.segments:
        first = window.segments[0][0]
        out.append(avg_if(window.in_segment(d, first), b).alias(f"bal_mean_{first}"))
    out += [
        avg_if(in_short, b).alias(f"bal_mean_{short}"),
        count_if(empty).alias(f"zero_bal_days_{full}"),
        count_if(empty & in_recent).alias(f"zero_bal_days_{recent}"),
        count_if(empty & in_short).alias(f"zero_bal_days_{short}"),
        F.regr_slope(b, window.day_index(d)).alias("bal_slope"),
    ]
    return out


def _change_columns(window: ObservationWindow):
    d, diff = F.col("d"), F.col("diff")
    moved = diff != 0
    return [
        max_if(moved, d).alias("bal_last_chg_d"),
        count_if(moved & window.in_span(d, window.recent)).alias(f"bal_chg_days_{window.recent}"),
        count_if(moved).alias(f"bal_chg_days_{window.full}"),
        F.stddev_samp(diff).alias("bal_diff_std"),
        F.avg(F.abs(diff)).alias("bal_diff_absmean"),
        F.sum(F.when(diff < 0, -diff).otherwise(F.lit(0.0))).alias(f"bal_outflow_{window.full}"),
    ]


def _weekly_columns(window: ObservationWindow):
    week = window.week_index(F.col("d"))
    return [avg_if(week == i, F.col("b")).alias(f"wk{i}_bal") for i in window.balance_weeks]


def with_changes(balances: DataFrame) -> DataFrame:
    """Change against the previous snapshot of the account."""
    previous = F.lag("b").over(W.partitionBy("id").orderBy("d"))
    return balances.withColumn("diff", F.col("b") - previous)


def balance_stats(balances: DataFrame, window: ObservationWindow) -> DataFrame:
    return balances.groupBy("id").agg(*_level_columns(window))


def balance_changes(balances: DataFrame, window: ObservationWindow) -> DataFrame:
    return with_changes(balances).groupBy("id").agg(*_change_columns(window))


def weekly_balance(balances: DataFrame, window: ObservationWindow) -> DataFrame:
    return balances.groupBy("id").agg(*_weekly_columns(window))


def balance_profile(balances: DataFrame, window: ObservationWindow) -> DataFrame:
    """Levels, changes and weekly means with a single shuffle by account."""
    columns = [*_level_columns(window), *_change_columns(window), *_weekly_columns(window)]
    return with_changes(balances).groupBy("id").agg(*columns)
