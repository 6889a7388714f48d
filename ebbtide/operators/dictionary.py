"""Category codes of any number of values: an ordered dictionary built and joined as a table.

The distinct values are range-partitioned and written once, each with the number of its range, so the ranges stay as
they are whatever happens to executors. A value's code is its position inside the range plus the sizes of the
ranges before it. No task sorts, and no driver holds, all values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.functions.columns import apply_categories, fit_categories
from ebbtide.operators.ranks import with_offsets
from ebbtide.operators.skew import salted_join
from ebbtide.session import materialize

BROADCAST_VALUES = 100_000


def category_dictionary(df: DataFrame, column: str, ranges: int | None = None) -> DataFrame:
    """Rows ``(value, code)``: distinct values in order, codes 0, 1, 2 …; NULL is no value. Empty without values."""
    values = df.select(F.col(f"`{column}`").alias("value")).filter("value is not null").distinct()
    parts = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(values.repartitionByRange(parts, "value").withColumn("_range", F.spark_partition_id()))
    placed = with_offsets(ranged, ["_range"], [], {"_c": F.count(F.lit(1))})
    position = F.row_number().over(W.partitionBy("_range").orderBy("value"))
    return materialize(placed.select("value", (F.col("_c_before") + position - 1).cast("long").alias("code")))


def apply_dictionary(df: DataFrame, column: str, dictionary: DataFrame, broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
    """Replace values by their code in the dictionary; NULL and unseen values give -1.

    A counted dictionary of at most ``broadcast_values`` values goes to the rows. Beyond that rows and codes meet by a
    shuffle in which a value that holds a large part of the rows is spread over many tasks; rows without a
    code never enter it.
    """
    order, code = df.columns, F.coalesce("_code", F.lit(-1)).cast("long")
    codes = dictionary.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    keyed = df.withColumn("_value", F.col(f"`{column}`"))
    if dictionary.count() <= broadcast_values:
        met = keyed.join(F.broadcast(codes), "_value", "left")
    else:
        known = salted_join(keyed.filter("_value is not null"), _with_unseen(codes, keyed), "_value", [f"`{c}`" for c in order])
        met = known.unionByName(keyed.filter("_value is null").withColumn("_code", F.lit(None).cast("long")))
    return met.withColumn(column, code).select(*[f"`{c}`" for c in order])


def _with_unseen(codes: DataFrame, keyed: DataFrame) -> DataFrame:
    """One row per value of either side, the code NULL where the dictionary has none."""
    asked = keyed.select("_value").filter("_value is not null").distinct()
    return asked.join(codes, "_value", "left")


def fit_codes(df: DataFrame, columns: Sequence[str], bound: int = 1000) -> dict[str, list | DataFrame]:
    """Codes per column: a list where there are at most ``bound`` values, a dictionary table beyond. Codes are equal."""
    counted = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns)]).first()
    fitted = {}
    for i, column in enumerate(columns):
        try:
            fitted[column] = fit_categories(df, [column], bound)[column] if counted[i] <= 2 * bound else None
        except ValueError:
            fitted[column] = None
        if fitted[column] is None:
            fitted[column] = category_dictionary(df, column)
    return fitted


def apply_codes(df: DataFrame, fitted: Mapping[str, list | DataFrame]) -> DataFrame:
    """Apply ``fit_codes``."""
    lists = {c: v for c, v in fitted.items() if isinstance(v, list)}
    out = apply_categories(df, lists) if lists else df
    for column, dictionary in fitted.items():
        if column not in lists:
            out = apply_dictionary(out, column, dictionary)
    return out
