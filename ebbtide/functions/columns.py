"""Small column expressions: filtered aggregates, safe ratios, bins, flags, codes."""

from __future__ import annotations

from collections.abc import Sequence
from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6


def sum_if(condition: Column, value: Column) -> Column:
    """Sum over matching rows; NULL when none match."""
    return F.sum(F.when(condition, value))


def avg_if(condition: Column, value: Column) -> Column:
    return F.avg(F.when(condition, value))


def std_if(condition: Column, value: Column) -> Column:
    return F.stddev_samp(F.when(condition, value))


def max_if(condition: Column, value: Column) -> Column:
    return F.max(F.when(condition, value))


def count_if(condition: Column) -> Column:
    """Count of matching rows; 0 when none match."""
    return F.count(F.when(condition, F.lit(1)))


WORD = 63


def distinct_units(index: Column, units: int) -> Column:
    """Exact number of distinct unit indexes in ``0 … units - 1``, as bit sets of ``WORD`` units each.

    Bit sets merge on the map side and need neither ``Expand`` nor a second shuffle. An index outside the
    window is not a unit of it and does not count.
    """
    one = F.lit(1).cast("bigint")
    total = F.lit(0).cast("bigint")
    for low in range(0, max(units, 1), WORD):
        inside = index.between(low, min(low + WORD, units) - 1)
        bits = F.bit_or(F.when(inside, F.call_function("shiftleft", one, (index - low).cast("int"))))
        total = total + F.coalesce(F.bit_count(bits).cast("bigint"), F.lit(0))
    return total


def zero_if_null(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def clip(column: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a column; NULL stays NULL."""
    out = column
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(column.isNotNull(), out)


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def right_closed_bin(column: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval ``(edge[i], edge[i+1]]`` that holds the value; NULL outside."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per interval")
    out = F.when(column <= edges[0], F.lit(None).cast("string"))
    for edge, label in zip(edges[1:], labels, strict=True):
        out = out.when(column <= edge, F.lit(label))
    return out


def left_closed_bin(column: Column, cuts: Sequence[float]) -> Column:
    """Number of cut points at or below the value."""
    out = F.lit(0)
    for cut in cuts:
        out = out + (column >= cut).cast("int")
    return out


def interval_labels(edges: Sequence[float]) -> list[str]:
    """``(a, b]`` texts for consecutive edges, an infinite edge printed as ``inf``."""

    def text(edge: float) -> str:
        return "inf" if edge == float("inf") else f"{edge:g}"

    return [f"({text(a)}, {text(b)}]" for a, b in zip(edges, edges[1:], strict=False)]


HEX_DIGITS = 31


def hex_suffix_to_number(column: Column) -> Column:
    """Value of the hexadecimal text after the last dash as ``decimal(38, 0)``, exact for up to 31 digits.

    Text that is not hexadecimal, or longer, has no value; ``unparsed_share`` tells how much that is. Longer ones have
    an ordered text, ``hex_suffix_key``.
    """
    tail = F.substring_index(column, "-", -1)
    padded = F.lpad(tail, HEX_DIGITS + 1, "0")
    whole = F.lit(0).cast("decimal(38,0)")
    for start in range(1, HEX_DIGITS + 1, 8):
        digits = F.conv(F.substring(padded, start, 8), 16, 10).cast("decimal(10,0)")
        whole = (whole * F.lit(16**8).cast("decimal(10,0)")).cast("decimal(38,0)") + digits
    return F.when(tail.rlike(f"^[0-9A-Fa-f]{{1,{HEX_DIGITS}}}$"), whole.cast("decimal(38,0)"))


def unparsed_share(df: DataFrame, column: str) -> DataFrame:
    """One row ``(n, unparsed)``: rows with an id, and the share of them without a hexadecimal value."""
    missing = hex_suffix_to_number(F.col(column)).isNull().cast("int")
    return df.filter(F.col(column).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(missing).alias("unparsed"))


KEY_DIGITS = 64
LARGEST_DIFFERENCE = 10**37


def hex_suffix_key(column: Column) -> Column:
    """The hexadecimal text after the last dash in lower case, zeros in front, so that text order is number order.

    Holds up to ``KEY_DIGITS`` digits: identifiers of 128 and 256 bits. NULL where the text is not hexadecimal or longer.
    """
    tail = F.substring_index(column, "-", -1)
    return F.when(tail.rlike(f"^[0-9A-Fa-f]{{1,{KEY_DIGITS}}}$"), F.lpad(F.lower(tail), KEY_DIGITS, "0"))


def common_digits(df: DataFrame, column: str) -> int:
    """Number of leading digits that all keys of a column share, from its smallest and its largest key."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    return len(commonprefix([low or "", high or ""]))


def hex_position(key: Column, skip: int = 0) -> Column:
    """The 64 bits after the first ``skip`` digits as a double; never falls as the key rises, if those digits are shared."""
    start = min(skip, KEY_DIGITS - 1) + 1
    return F.conv(F.substring(key, start, 16), 16, 10).cast("double")


def hex_difference(later: Column, earlier: Column) -> Column:
    """``later - earlier`` of two keys as ``decimal(38, 0)``, exact up to ``LARGEST_DIFFERENCE`` and cut there.

    Eight digits at a time from the front, so equal leading digits cost nothing.
    """
    total = F.lit(0).cast("decimal(38,0)")
    digits = lambda key, start: F.conv(F.substring(key, start, 8), 16, 10).cast("decimal(10,0)")
    for start in range(1, KEY_DIGITS + 1, 8):
        grown = F.try_multiply(total, F.lit(16**8).cast("decimal(10,0)"))
        total = F.try_add(grown, digits(later, start) - digits(earlier, start)).cast("decimal(38,0)")
    largest = F.lit(str(LARGEST_DIFFERENCE)).cast("decimal(38,0)")
    inside = total.between(-largest, largest)
    return F.when(inside, total).when(later > earlier, largest).when(later < earlier, -largest)


def fill_missing(df: DataFrame, by_column: dict[str, float], rest: float | None = None) -> DataFrame:
    """Fill NULL and NaN: named columns with their own constant, then all other numeric columns with ``rest``."""
    if by_column:
        df = df.na.fill(by_column)
    return df if rest is None else df.na.fill(rest)


def fit_categories(df: DataFrame, columns: Sequence[str], bound: int = 1000) -> dict[str, list]:
    """Sorted distinct values of each column, refused when there are more than ``bound``."""
    fitted = {}
    for column in columns:
        rows = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(bound + 1).collect()
        if len(rows) > bound:
            raise ValueError(f"{column} has more than {bound} values; it is not a category")
        fitted[column] = sorted(row[0] for row in rows)
    return fitted


def apply_categories(df: DataFrame, fitted: dict[str, list]) -> DataFrame:
    """Replace values by their position in the fitted list; NULL and unseen values give -1."""
    codes = {}
    for column, values in fitted.items():
        position = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)) - 1
        codes[column] = F.coalesce(position, F.lit(-1)).cast("int")
    return df.withColumns(codes)
