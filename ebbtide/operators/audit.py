"""Leakage audits: dates after the window, identifiers that encode time or hidden activity.

An identifier is a number, or a text of ``hex_suffix_key``, which holds more digits than any number type and
keeps their order; the audits compare such texts whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.functions.columns import common_digits, hex_difference, hex_position, interval_labels, right_closed_bin
from ebbtide.operators.ranks import assign_bucket, average_rank, bucket_count, join_null_safe, next_value, sketch_splits

HIDDEN_EDGES = (0, 1, 2, 3, 5, 8, 13, 21, 34, 55, float("inf"))  # fixed values: bin edges of hidden counts


def date_range_guard(tables: Mapping[str, tuple[DataFrame, Column]], last_day: date) -> DataFrame:
    """Rows ``(source, n, min_d, max_d, ok)``; ``ok`` is 0 when a record lies after ``last_day``."""
    out = None
    for name, (df, day) in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("min_d"), F.max(day).alias("max_d")).select(
            F.lit(name).alias("source"), "n", "min_d", "max_d", (F.col("max_d") <= F.lit(last_day)).cast("int").alias("ok")
        )
        out = row if out is None else out.unionByName(row)
    return out


def assert_no_future(tables: Mapping[str, tuple[DataFrame, Column]], last_day: date) -> None:
    late = [r["source"] for r in date_range_guard(tables, last_day).filter("ok = 0").collect()]
    if late:
        raise ValueError(f"records after {last_day} in {', '.join(late)}")


def id_time_correlation(df: DataFrame, time: str, number: str, row_id: Sequence[str]) -> DataFrame:
    """Correlation of the position in time (ties averaged) with an identifier.

    A text counts by the 64 bits after the digits that all identifiers share, which a correlation cannot tell from the
    whole number.
    """
    ranked = average_rank(df, time, "_position", row_id)
    value = hex_position(F.col(number), common_digits(df, number)) if _is_text(df, number) else F.col(number)
    return ranked.agg(F.corr(F.col("_position"), value).alias("corr"))


def _is_text(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column] == "string"


def previous_in_entity(df: DataFrame, entity: str, time: str, value: str, out: str, buckets: int | None = None) -> DataFrame:
    """Value of the entity's previous row in time; ties in time are ordered by the value.

    One entity may hold a large part of all rows, so its history is cut at global time buckets: inside a
    bucket a window finds the predecessor, and the first row of a bucket takes the last value of the
    entity's previous bucket. Rows without an entity have no predecessor.
    """
    splits, _ = sketch_splits(df, [time], buckets or bucket_count(df))[time]
    keyed = assign_bucket(df, time, splits, "_bucket")
    lasts = keyed.groupBy(entity, "_bucket").agg(F.max(F.struct(time, value)).alias("_l"))
    lasts = lasts.select(
        entity, "_bucket", F.lag(F.col(f"_l.{value}")).over(W.partitionBy(entity).orderBy("_bucket")).alias("_carried")
    )
    inside = W.partitionBy(entity, "_bucket").orderBy(time, value)
    joined = join_null_safe(keyed, lasts, [entity, "_bucket"])
    found = F.when(F.col(entity).isNotNull(), F.coalesce(F.lag(value).over(inside), F.col("_carried")))
    return joined.withColumn(out, found).drop("_bucket", "_carried")


def id_monotone_share(df: DataFrame, entity: str, time: str, number: str, at_least: int = 3) -> DataFrame:
    """Mean share of increasing identifier steps per entity, over entities with ``at_least`` rows.

    Rows without an entity are nobody's sequence and do not count.
    """
    stepped = previous_in_entity(df.filter(F.col(entity).isNotNull()), entity, time, number, "_previous")
    per_entity = stepped.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(number) > F.col("_previous")).cast("int")).alias("share")
    )
    kept = per_entity.filter(F.col("n") >= at_least)
    return kept.agg(F.count(F.lit(1)).alias("entities"), F.avg("share").alias("mono"))


def leak_verdict(df: DataFrame, entity: str, time: str, number: str, row_id: Sequence[str]) -> DataFrame:
    """One row ``(corr, mono, leak)``; a leak needs both a global and a within-entity time order."""
    corr = id_time_correlation(df, time, number, row_id)
    mono = id_monotone_share(df, entity, time, number)
    return corr.withColumn("mono", mono.select("mono").scalar()).withColumn(
        "leak", ((F.abs("corr") > 0.3) & (F.col("mono") > 0.9)).cast("int")
    )


def id_blocks(df: DataFrame, entity: str, number: str) -> DataFrame:
    """Identifier range per entity, ids missing inside it and ids up to the next entity's range.

    ``fid, lid, n, internal_holes, hidden``; the last range has no successor and hides nothing. Counts between texts
    are exact up to 37 digits and cut there.
    """
    ranges = df.groupBy(entity).agg(F.min(number).alias("fid"), F.max(number).alias("lid"), F.count(F.lit(1)).alias("n"))
    if _is_text(df, number):
        ranges = ranges.withColumn("_place", hex_position(F.col("fid"), common_digits(df, number)))
        followed = next_value(ranges, "fid", "_next", place="_place")
        last = ranges.agg(F.max("lid")).scalar()
        to_next, inside = hex_difference(F.col("_next"), F.col("lid")) - 1, hex_difference(F.col("lid"), F.col("fid"))
        hidden = F.when(F.col("_next").isNull(), hex_difference(last, F.col("lid"))).otherwise(to_next)
    else:
        followed = next_value(ranges, "fid", "_next")
        after_all = ranges.agg(F.max("lid") + 1).scalar()
        hidden, inside = F.coalesce("_next", after_all) - F.col("lid") - 1, F.col("lid") - F.col("fid")
    return followed.select(
        F.col(entity).alias("id"), "fid", "lid", "n", hidden.alias("hidden"), (inside + 1 - F.col("n")).alias("internal_holes")
    )


def contiguity_test(blocks: DataFrame) -> DataFrame:
    """Whether ids form gap-free, non-overlapping blocks, the structure a counter leak needs."""
    holes, hidden = F.col("internal_holes") == 0, F.col("hidden") >= 0
    return blocks.agg(
        F.count(F.lit(1)).alias("blocks"),
        F.avg(holes.cast("int")).alias("contiguous_share"),
        F.bool_and(holes & hidden).cast("int").alias("valid"),
    )


def hidden_confusion(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of ``hidden == 0`` against the binary label, unmatched ids dropped."""
    joined = labels.join(blocks.select("id", "hidden"), "id")
    return joined.groupBy((F.col("hidden") == 0).cast("int").alias("none_hidden"), F.col("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


def rate_by_bin(df: DataFrame, value: str, label: str, edges: Sequence[float] = HIDDEN_EDGES) -> DataFrame:
    """Size and mean label per right-closed bin; values outside the edges are left out."""
    labels = interval_labels(edges)
    binned = df.withColumn("bin", right_closed_bin(F.col(value), edges, labels)).filter(F.col("bin").isNotNull())
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("size"), F.avg(label).alias("mean"))


def dominance_check(importance: DataFrame, limit: float = 0.6) -> DataFrame:
    """Top share of an importance table ``(feature, importance)`` and whether it looks like a label proxy."""
    total = importance.agg(F.sum("importance")).scalar()
    shares = importance.withColumn("share", F.try_divide(F.col("importance"), total))
    top = shares.agg(F.max(F.struct("share", "feature")).alias("t"))
    return top.select(
        F.col("t.feature").alias("feature"),
        F.col("t.share").alias("share"),
        (F.col("t.share") > limit).cast("int").alias("suspicious"),
    )
