"""Ratio, rhythm, trajectory and flag features computed column by column from the assembled row.

Every function takes and returns a DataFrame and adds columns only; NULL inputs give NULL ratios that
``finalize_features`` fills at the very end. Column stems follow ``ObservationWindow.quarter``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions import vectors as V
from ebbtide.functions.columns import EPS, fill_missing, flag, zero_if_null
from ebbtide.operators.activity import TYPE_STEMS
from ebbtide.operators.balance import EMPTY_WALLET
from ebbtide.operators.dictionary import apply_codes
from ebbtide.window import ObservationWindow

c = F.col


def _weeks(window: ObservationWindow) -> list[Column]:
    return [zero_if_null(c(f"wk{i}_cnt")).cast("double") for i in range(window.weeks)]


def recency_family(df: DataFrame, window: ObservationWindow) -> DataFrame:
    """Days back from the cutoff for the four dated columns, which are dropped."""
    dated = {
        "recency_days": "last_d",
        "first_seen_days": "first_d",
        "in_recency_days": "in_last_d",
        "bal_stagnation_days": "bal_last_chg_d",
    }
    missing = F.lit(window.missing_days)
    out = df.withColumns({name: F.coalesce(window.days_before_cutoff(c(d)), missing) for name, d in dated.items()})
    out = out.withColumn("money_recency", F.least("recency_days", "bal_stagnation_days"))
    return out.drop(*dated.values())


def fill_recencies(df: DataFrame, window: ObservationWindow) -> DataFrame:
    """Constants that stand in for absent recencies and gaps; must precede the rhythm scores."""
    days = window.missing_days
    fills = {f"rec_{stem}": days for stem in TYPE_STEMS}
    fills |= {"hours_since_last": days * 24, "gap_mean": days, "gap_max": days, "gap_std": 0}
    return fill_missing(df, fills)


def rhythm_scores(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "gap_z": (c("recency_days") - c("gap_mean")) / (c("gap_std") + 1),
            "recency_over_maxgap": c("recency_days") / (c("gap_max") + 1),
            "recency_over_meangap": c("recency_days") / (c("gap_mean") + 1),
        }
    )


def silence_shares(df: DataFrame, window: ObservationWindow) -> DataFrame:
    """Share of fully silent ``silence``-day windows, and the Poisson chance of one more."""
    possible = window.days - window.silence + 1
    lead = F.greatest(F.lit(window.days) - c("first_seen_days"), F.lit(0))
    leading = F.greatest(lead - (window.silence - 1), F.lit(0))
    return df.withColumns(
        {
            "dead30_share": (zero_if_null(c("dead30_inner")) + leading) / float(possible),
            "p_silent30_poisson": F.exp(-zero_if_null(c(f"cnt_{window.recent}")).cast("double")),
        }
    )


def trajectory_shape(df: DataFrame, window: ObservationWindow) -> DataFrame:
    w = _weeks(window)
    middle = (len(w) - 1) / 2
    return df.withColumns(
        {
            "trailing_zero_weeks": V.trailing_zeros(w),
            "wk_slope": V.dot(w, [i - middle for i in range(len(w))]) / (V.total(w) + 1),
            "wk_last_over_mean": w[-1] / (V.mean(w) + EPS),
            "wk_last4_over_first4": V.total(w[-4:]) / (V.total(w[:4]) + 1),
        }
    )


def momentum(df: DataFrame, window: ObservationWindow) -> DataFrame:
    full, recent, short = (c(f"cnt_{s}") for s in (window.full, window.recent, window.short))
    recent_days, short_days = window.spans[window.recent], window.spans[window.short]
    first, second, third = (c(f"cnt_{name}") for name, _, _ in window.segments)
    return df.withColumns(
        {
            "trend_30_90": recent / (full / 3 + EPS),
            "trend_7_30": short / (recent * short_days / recent_days + EPS),
            f"{window.segments[2][0]}_over_{window.segments[0][0]}{window.segments[1][0]}": third
            / ((first + second) / 2 + 1),
            "intensity": full / (c("active_days") + EPS),
            f"active_rate_{window.recent}": c(f"active_days_{window.recent}") / float(recent_days),
        }
    )


def mix_shares(df: DataFrame, window: ObservationWindow) -> DataFrame:
    full = c(f"cnt_{window.full}")
    out = {f"share_{stem}": c(f"cnt_{stem}") / (full + EPS) for stem in TYPE_STEMS}
    out |= {
        "evening_share": c("cnt_evening") / (full + EPS),
        "weekend_share": c("cnt_weekend") / (full + EPS),
        "in_out_ratio": c(f"in_cnt_{window.full}") / (full + 1),
        "amt_cv": c(f"amt_std_{window.full}") / (c(f"amt_mean_{window.full}") + EPS),
        "net_cashflow": zero_if_null(c("amt_cashin")) - zero_if_null(c("amt_cashout")),
    }
    return df.withColumns(out)


def _offset_ratio(top: Column, bottom: Column) -> Column:
    """``top / (bottom + 1)``; an overdrawn balance of exactly -1 gives NULL, filled with 0 at the end."""
    return F.try_divide(top, bottom + 1)


def balance_ratios(df: DataFrame, window: ObservationWindow) -> DataFrame:
    first = window.segments[0][0]
    early, late = window.balance_weeks[0], window.balance_weeks[-1]
    return df.withColumns(
        {
            "bal_last_over_mean": _offset_ratio(c("bal_last"), c(f"bal_mean_{window.full}")),
            "bal_last_over_max": _offset_ratio(c("bal_last"), c(f"bal_max_{window.full}")),
            f"bal_30_over_{first}": _offset_ratio(c(f"bal_mean_{window.recent}"), c(f"bal_mean_{first}")),
            "bal_chg_rate_30d": c(f"bal_chg_days_{window.recent}") / float(window.spans[window.recent]),
            f"bal_wk{late}_over_wk{early}": _offset_ratio(c(f"wk{late}_bal"), c(f"wk{early}_bal")),
        }
    )


def churn_mechanism(df: DataFrame, window: ObservationWindow) -> DataFrame:
    """How close a customer came to the lapse rule; needs ``momentum`` columns."""
    longest = window.gap_lengths[-1]
    fills = {f"n_gap{n}": 0 for n in window.gap_lengths} | {"gap_p90": window.missing_days}
    daily_outflow = zero_if_null(c(f"bal_outflow_{window.full}")) / 90
    return fill_missing(df, fills).withColumns(
        {
            "max_silent_streak": F.greatest("gap_max", "recency_days"),
            "near_churn_gap": c("gap_max") / float(window.silence),
            f"ever_{longest}d_gap": flag(c("gap_max") >= longest),
            "silence_over_p90gap": c("recency_days") / (c("gap_p90") + 1),
            "trend_accel": c("trend_7_30") - c("trend_30_90"),
            "days_to_zero_bal": c("bal_last") / (daily_outflow + 1),
        }
    )


def regularity(df: DataFrame, window: ObservationWindow) -> DataFrame:
    """Spread and burstiness of activity; needs ``mix_shares`` and filled gaps."""
    w = _weeks(window)
    whole = V.total(w)
    return df.withColumns(
        {
            "wk_entropy": V.entropy([x / (whole + EPS) for x in w], EPS),
            "wk_cv": V.population_std(w) / (V.mean(w) + EPS),
            "active_week_frac": V.positive_share(w),
            "gap_cv": c("gap_std") / (c("gap_mean") + 1),
            "type_entropy": V.entropy([c(f"share_{stem}") for stem in TYPE_STEMS], EPS),
        }
    )


def inactivity_flags(df: DataFrame, window: ObservationWindow) -> DataFrame:
    return df.withColumns(
        {
            "is_inactive_30d": flag(zero_if_null(c(f"cnt_{window.recent}")) == 0),
            "is_inactive_90d": flag(zero_if_null(c(f"cnt_{window.full}")) == 0),
            "no_inflow_90d": flag(zero_if_null(c(f"in_cnt_{window.full}")) == 0),
            "is_drained": flag(zero_if_null(c("bal_last")) <= EMPTY_WALLET),
        }
    )


def derive_all(df: DataFrame, window: ObservationWindow) -> DataFrame:
    """All derived columns in dependency order, still unfilled; one projection after optimisation."""
    df = fill_recencies(recency_family(df, window), window)
    df = silence_shares(rhythm_scores(df), window)
    df = momentum(trajectory_shape(df, window), window)
    df = balance_ratios(mix_shares(df, window), window)
    df = regularity(churn_mechanism(df, window), window)
    fills = {"peer_avg_recency": window.missing_days, "peer_min_recency": window.missing_days}
    return inactivity_flags(fill_missing(df, fills), window)


def finalize_features(df: DataFrame, categories: dict[str, list | DataFrame], key: str = "id") -> DataFrame:
    """Category codes, then every numeric column as a filled double."""
    coded = apply_codes(df, categories)
    features = [name for name in coded.columns if name != key]
    return fill_missing(coded.selectExpr(key, *[f"CAST(`{f}` AS DOUBLE) AS `{f}`" for f in features]), {}, rest=0.0)


