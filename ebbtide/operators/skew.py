"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.session import materialize


HOT_LIST = 10_000


def hot_keys(df: DataFrame, key: str, parts: int = 64, rows_per_task: int = 1_000_000) -> DataFrame:
    """``key, spread`` of keys with more than ``1/parts`` of the rows or more than a task should hold.

    ``spread`` is the number of tasks the key's rows should be dealt to, from its counted rows. By counting
    there are fewer than ``parts + HOT_LIST`` such keys, whatever the table.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total")).scalar()
    limit = F.greatest(F.lit(rows_per_task), F.ceil(total / HOT_LIST))
    hot = counts.filter((F.col("_n") * parts > total) | (F.col("_n") > limit))
    return hot.select(key, F.greatest(F.lit(16), F.ceil(F.col("_n") / rows_per_task)).cast("int").alias("spread"))


def salted_join(
    left: DataFrame, right: DataFrame, key: str, spread_by: Sequence[str], parts: int = 64, rows_per_task: int = 1_000_000
) -> DataFrame:
    """Inner join of ``left`` with ``right`` (one row per key), hot keys spread over as many tasks as their rows need.

    Rows of a hot key take a salt from the hash of ``spread_by``; its single right row is repeated once
    per salt. Other keys keep salt 0. The hot list is bounded by counting, so it is broadcast.
    """
    hot = hot_keys(left, key, parts, rows_per_task).withColumnRenamed("spread", "_spread")
    hot = F.broadcast(materialize(hot))
    salt = F.pmod(F.hash(*spread_by), F.coalesce("_spread", F.lit(1)))
    salted = left.join(hot, key, "left").withColumn("_salt", salt)
    copies = F.sequence(F.lit(0), F.coalesce("_spread", F.lit(1)) - 1)
    repeated = right.join(hot, key, "left").withColumn("_salt", F.explode(copies))
    return salted.drop("_spread").join(repeated.drop("_spread"), [key, "_salt"]).drop("_salt")
