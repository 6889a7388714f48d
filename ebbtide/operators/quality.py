"""Feature quality: skew audit, winsorising, log copies, histograms, standard scores.

Everything that is learnt (caps, means) is fitted on one table and applied to any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.ranks import exact_quantiles, quantile_map


def skew_audit(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Rows ``(feature, skew, zero_share, p99_over_med)``.

    Moments of all columns come from one aggregation; quantiles are exact, or read from a mergeable
    sketch in that same pass when ``approximate``.
    """
    measures = []
    for i, name in enumerate(columns):
        x = F.col(name).cast("double")
        measures += [F.skewness(x).alias(f"s{i}"), F.avg((x == 0).cast("int")).alias(f"z{i}")]
        if approximate:
            measures.append(F.percentile_approx(x, [0.5, 0.99], 10_000).alias(f"q{i}"))
    row = df.agg(*measures)
    fields = ["feature", "skew", "zero_share"] + (["med", "p99"] if approximate else [])
    structs = []
    for i, name in enumerate(columns):
        values = [F.lit(name), F.col(f"s{i}"), F.col(f"z{i}")]
        if approximate:
            values += [F.col(f"q{i}")[0], F.col(f"q{i}")[1]]
        structs.append(F.struct(*[v.alias(f) for v, f in zip(values, fields, strict=True)]))
    moments = row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")
    if not approximate:
        quantiles = exact_quantiles(df, columns, [0.5, 0.99])
        wide = quantiles.groupBy("feature").agg(
            F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("med"),
            F.max(F.when(F.col("prob") == 0.99, F.col("value"))).alias("p99"),
        )
        moments = moments.join(wide, "feature", "left")
    return moments.select(
        "feature", "skew", "zero_share", (F.col("p99") / (F.abs("med") + 1e-9)).alias("p99_over_med")
    )


def select_skewed(audit: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Features skewed beyond the threshold, flags (``is_…``) left out."""
    return audit.filter((F.col("skew") > threshold) & ~F.col("feature").startswith("is_"))


def fit_caps(df: DataFrame, columns: Sequence[str], quantile: float = 0.999) -> dict[str, float]:
    return {name: values[0] for name, values in quantile_map(df, columns, [quantile]).items()}


def apply_caps(df: DataFrame, caps: dict[str, float]) -> DataFrame:
    """Values above the fitted cap are set to it; NULL stays NULL."""
    return df.withColumns(
        {name: F.when(F.col(name).isNotNull(), F.least(F.col(name).cast("double"), F.lit(cap))) for name, cap in caps.items()}
    )


def log_copies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``{column}_log`` = ln(1 + x) of the non-negative part."""
    return df.withColumns({f"{name}_log": F.log1p(F.greatest(F.col(name), F.lit(0))) for name in columns})


def histogram(df: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """Equal-width bins over the value range: ``bin, low, high, n``, empty bins left out."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        low, high = 0.0, 1.0
    low, high = float(low), float(high)
    width = (high - low) / bins or 1.0
    position = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    counted = df.filter(F.col(column).isNotNull()).groupBy(position.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumns({"low": low + F.col("bin") * width, "high": low + (F.col("bin") + 1) * width})


def fit_scaler(df: DataFrame, columns: Sequence[str], sample: bool = True) -> dict[str, tuple[float, float]]:
    """Mean and standard deviation (sample or population) of each column, in one aggregation."""
    std = F.stddev_samp if sample else F.stddev_pop
    row = df.agg(*[f for i, c in enumerate(columns) for f in (F.avg(c).alias(f"m{i}"), std(c).alias(f"s{i}"))]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] or 0.0) for i, c in enumerate(columns)}


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - mean) / (std + 1e-9) for c, (mean, std) in scaler.items()})
