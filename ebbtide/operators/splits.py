"""Reproducible samples, hold-outs and folds from the md5 order of the row id.

The same rows come back on every engine and every run, whatever the partitioning; no group is sorted
in a single task (see ``ranks.hash_rank``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.ranks import hash_order, hash_rank

KEY_DIGITS, PREFIX_DIGITS = 32, 3


def sample_n(df: DataFrame, row_id: Sequence[str], n: int, seed: int = 42, task_rows: int = 100_000) -> DataFrame:
    """The ``n`` rows of the smallest md5 keys, all rows if there are fewer.

    Counts by the leading digits of the key tell which prefix holds the n-th key; the next digits are counted inside
    it only, until it holds ``task_rows`` at most. Rows of smaller prefixes are kept as they are; only the rows of
    that one prefix are ordered.
    """
    keyed = df.withColumn("_key", hash_order(row_id, seed))
    prefix, wanted = "", n
    while len(prefix) < KEY_DIGITS:
        inside = keyed.filter(F.col("_key").startswith(prefix)) if prefix else keyed
        digits = F.substring("_key", len(prefix) + 1, PREFIX_DIGITS)
        counts = sorted(tuple(r) for r in inside.groupBy(digits).count().collect())  # at most 16 ** PREFIX_DIGITS rows
        if sum(c for _, c in counts) <= wanted:
            break  # everything inside the prefix belongs to the sample
        for digit, count in counts:
            if wanted <= count:
                break
            wanted -= count
        prefix += digit
        if count <= task_rows:
            break
    if not prefix:
        return df
    head = F.substring("_key", 1, len(prefix))
    edge = keyed.filter(head == prefix).orderBy("_key", *row_id).limit(wanted)
    return keyed.filter(head < prefix).unionByName(edge).drop("_key")


def head(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows in ``order``: every task keeps its own first rows, and only those are merged."""
    return df.orderBy(*order).limit(k)


def holdout_split(
    df: DataFrame, row_id: Sequence[str], fraction: float = 0.25, by: Sequence[str] = (), seed: int = 42
) -> DataFrame:
    """Adds ``is_test``: the first ``ceil(fraction * n)`` rows of every stratum in md5 order."""
    ranked = hash_rank(df, row_id, "_r", seed, by)
    return ranked.withColumn("is_test", (F.col("_r") <= F.ceil(F.col("_r_of") * fraction)).cast("int")).drop("_r", "_r_of")


def folds(df: DataFrame, row_id: Sequence[str], k: int = 5, by: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Adds ``fold`` in 0 … k-1, balanced inside every stratum of ``by`` (plain folds without)."""
    ranked = hash_rank(df, row_id, "_r", seed, by)
    return ranked.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r", "_r_of")


def undersample(df: DataFrame, row_id: Sequence[str], label: str, seed: int = 42) -> DataFrame:
    """All positives and equally many negatives, drawn in md5 order."""
    positives = df.filter(F.col(label) == 1)
    n = positives.count()
    return positives.unionByName(sample_n(df.filter(F.col(label) == 0), row_id, n, seed))


def nearest_to_quantile(
    df: DataFrame, value: str, row_id: str, probabilities: Sequence[float], quantiles: Sequence[float]
) -> DataFrame:
    """For each probability the row whose value lies nearest to the quantile; ties by id."""
    best = [
        F.min(F.struct(F.abs(F.col(value) - q).alias("gap"), F.col(row_id).alias("id"), F.col(value).alias("value"))).alias(
            f"p{i}"
        )
        for i, q in enumerate(quantiles)
    ]
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(p).alias("prob"), F.col(f"p{i}.id").alias("id"), F.col(f"p{i}.value").alias("value"))
                for i, p in enumerate(probabilities)
            ]
        )
    )
    return df.agg(*best).select(rows.alias("r")).select("r.*")
