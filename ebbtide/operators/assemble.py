"""The wide feature row: profile columns and a left-outer star join on the customer key."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.window import ObservationWindow


def tenure_and_profile(profile: DataFrame, window: ObservationWindow, account_type: str | None = "Customer") -> DataFrame:
    """``id, tenure_days, GENDER, REGION`` of the accounts of one type."""
    if account_type is not None:
        profile = profile.filter(F.col("account_type") == account_type)
    opened = F.col("open_date").cast("date")
    return profile.select("id", window.days_before_cutoff(opened).alias("tenure_days"), "GENDER", "REGION")


def star_join(spine: DataFrame, tables: Iterable[DataFrame], key: str = "id") -> DataFrame:
    """Left-join feature tables with one row per key; all sides are hash-partitioned by the same key."""
    for table in tables:
        spine = spine.join(table, key, "left")
    return spine


def attach_labels(labels: DataFrame, features: DataFrame, key: str = "id") -> DataFrame:
    return labels.join(features, key, "left")


def null_report(df: DataFrame) -> DataFrame:
    """One row ``(n_rows, null_cells)`` over all columns, in one aggregation."""
    nulls = [F.count_if(F.col(name).isNull()) for name in df.columns]
    cells = nulls[0]
    for n in nulls[1:]:
        cells = cells + n
    return df.agg(F.count(F.lit(1)).alias("n_rows"), cells.alias("null_cells"))


def assert_no_nulls(df: DataFrame) -> DataFrame:
    report = null_report(df).first()
    if report["null_cells"]:
        raise ValueError(f"{report['null_cells']} NULL feature values in {report['n_rows']} rows")
    return df
