"""Row-wise arithmetic over a fixed list of columns (a short per-entity vector), kept inside codegen."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Sequence[Column]) -> Column:
    return reduce(add, values)


def mean(values: Sequence[Column]) -> Column:
    return total(values) / len(values)


def population_std(values: Sequence[Column]) -> Column:
    centre = mean(values)
    return F.sqrt(total([(v - centre) * (v - centre) for v in values]) / len(values))


def dot(values: Sequence[Column], weights: Sequence[float]) -> Column:
    return total([v * float(w) for v, w in zip(values, weights, strict=True)])


def positive_share(values: Sequence[Column]) -> Column:
    return total([(v > 0).cast("int") for v in values]) / len(values)


def entropy(shares: Sequence[Column], eps: float) -> Column:
    """``-sum p ln(p + eps)`` over positive shares; a NULL share adds nothing."""
    return -total([F.when(p > 0, p * F.ln(p + eps)).otherwise(F.lit(0.0)) for p in shares])


def trailing_zeros(values: Sequence[Column]) -> Column:
    """Length of the run of zeros at the end of the vector."""
    out = F.lit(len(values))
    for i, value in enumerate(values):
        # the last non-zero position wins because later columns wrap earlier ones
        out = F.when(value != 0, F.lit(len(values) - 1 - i)).otherwise(out)
    return out


def running_minimum(values: Sequence[Column]) -> list[Column]:
    """Cumulative minimum from left to right."""
    return [values[0]] + [F.least(*values[: i + 1]) for i in range(1, len(values))]


def trapezoid(values: Sequence[Column], at: Sequence[float]) -> Column:
    """Integral of the piecewise-linear curve through ``(at[i], values[i])``."""
    pieces = [(values[i] + values[i + 1]) * (0.5 * (at[i + 1] - at[i])) for i in range(len(at) - 1)]
    return total(pieces)
