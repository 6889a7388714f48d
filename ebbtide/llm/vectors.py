"""Vectors of one length, shared by the operators on embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vector: Column) -> Column:
    """Whether a vector is not null, not empty, and free of null, NaN and infinite entries."""
    inf = F.lit(float("inf"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def usable(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vector is sound and of the most frequent length (of equally frequent ones the longest), and that length.

    Vectors of other lengths cannot be compared with the rest and leave. Without a sound vector the length is 0.
    """
    kept = rows.where(sound(F.col(vector)))
    lengths = kept.groupBy(F.size(vector).alias("length")).agg(F.count("*").alias("n"))
    length = lengths.agg(F.max_by("length", F.struct("n", "length")).alias("length")).first().length or 0
    return kept.where(F.size(vector) == length), length
