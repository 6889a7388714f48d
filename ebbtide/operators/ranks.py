"""Global order without a single-task sort.

A window without ``PARTITION BY`` moves every row to one task. Everything here works instead in three
steps: (1) a mergeable quantile sketch gives equi-depth cut points, (2) rows are numbered inside their
bucket by an ordinary partitioned window, (3) the totals of the lower buckets, a table with one row
per bucket, are added as offsets. A value so frequent that it fills several buckets is isolated in a
bucket of its own and that bucket is split further by a hash of the row id, so no task ever receives
more than a few bucket widths of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.session import materialize

SUB_BUCKETS = 256


def bucket_count(df: DataFrame) -> int:
    """Buckets per global order: two per shuffle partition, so stragglers can be balanced."""
    return max(16, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sketch_splits(df: DataFrame, columns: Sequence[str], buckets: int) -> dict[str, tuple[list[float], set[float]]]:
    """Per column: split points for ``Bucketizer`` and the values heavy enough to stand alone."""
    probabilities = [i / buckets for i in range(1, buckets)]
    accuracy = max(10_000, 20 * buckets)
    row = df.agg(
        *[
            F.percentile_approx(F.col(c).cast("double"), probabilities, accuracy).alias(f"q{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    out = {}
    for i, column in enumerate(columns):
        cuts = [c + 0.0 for c in (row[f"q{i}"] or []) if c is not None and math.isfinite(c)]
        heavy = {a for a, b in zip(cuts, cuts[1:], strict=False) if a == b}
        inner = sorted(set(cuts) | {math.nextafter(v, math.inf) for v in heavy}) or [0.0]
        out[column] = ([-math.inf, *inner, math.inf], heavy)
    return out


def plain_double(column: str) -> Column:
    """The column as a double with -0.0 turned into 0.0, which the bucket search would tell apart."""
    return F.col(column).cast("double") + F.lit(0.0)


def assign_bucket(df: DataFrame, column: str, splits: list[float], out: str) -> DataFrame:
    """Bucket number of each row; values outside the sketch's sample fall in the open end buckets."""
    as_double = f"{out}_value"
    bucketizer = Bucketizer(inputCol=as_double, outputCol=out, splits=splits, handleInvalid="keep")
    with_double = df.withColumn(as_double, plain_double(column))
    return bucketizer.transform(with_double).withColumn(out, F.col(out).cast("int")).drop(as_double)


def hash_order(row_id: Sequence[str], seed: int | str = 0) -> Column:
    """A reproducible pseudo-random order key: the md5 text of ``seed|id|id…``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in row_id]))


def hash_bucket(key: Column, buckets: int = SUB_BUCKETS) -> Column:
    """Leading bits of an md5 text; keeps the order of the text and is uniform."""
    digits = max(1, math.ceil(math.log(buckets, 16)))
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("int")


def with_offsets(
    df: DataFrame, bucket: Sequence[str], by: Sequence[str], sums: dict[str, Column], descending: bool = False
) -> DataFrame:
    """Attach to each row the totals of all earlier buckets (``{name}_before``) and of its own (``{name}_here``).

    The bucket table has at most a few thousand rows per group; it is summed by a window and sent back
    as a small join side, which the planner broadcasts from its measured size.
    """
    totals = df.groupBy(*by, *bucket).agg(*[expr.alias(f"{name}_here") for name, expr in sums.items()])
    order = [F.col(b).desc() if descending else F.col(b).asc() for b in bucket]
    earlier = W.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*(by or [F.lit(0)]))
    columns = {}
    for name in sums:
        columns[f"{name}_before"] = F.coalesce(F.sum(f"{name}_here").over(earlier), F.lit(0))
        columns[f"{name}_all"] = F.sum(f"{name}_here").over(whole)
    return join_null_safe(df, totals.withColumns(columns), [*by, *bucket])


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be NULL; the right side has one row per key."""
    renamed = right
    condition = F.lit(True)
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"__r_{key}")
        condition = condition & left[key].eqNullSafe(F.col(f"__r_{key}"))
    return left.join(renamed, condition, how).drop(*[f"__r_{key}" for key in keys])


def average_rank(
    df: DataFrame, value: str, out: str, row_id: Sequence[str], buckets: int | None = None
) -> DataFrame:
    """Ascending 1-based rank over the whole column; ties share the mean of their positions."""
    ranked = _positions(df, value, row_id, buckets)
    first = F.col("_n_before") + F.when(F.col("_heavy"), F.lit(1)).otherwise(F.col("_rank"))
    ties = F.when(F.col("_heavy"), F.col("_n_here")).otherwise(F.col("_ties"))
    return ranked.withColumn(out, first + (ties - 1) / 2).drop(*_WORK)


def average_ranks(df: DataFrame, columns: Sequence[tuple[str, str]], row_id: Sequence[str]) -> DataFrame:
    """``average_rank`` of several columns, given as pairs ``(value, out)``.

    A rank reads its input three times, for the cuts, the counts and the rows, so a chain of ranks would compute the
    input of the first a power of the columns often. Each step is therefore written once and read from its files.
    """
    for value, out in columns:
        df = average_rank(materialize(df), value, out, row_id)
    return df


def unique_rank(
    df: DataFrame, value: str, out: str, row_id: Sequence[str], seed: int | str = 0, buckets: int | None = None
) -> DataFrame:
    """Ascending 1-based position over the whole column; ties are ordered by the hash of the id."""
    ranked = _positions(df, value, row_id, buckets, seed)
    return ranked.withColumn(out, F.col("_n_before") + F.col("_sub_before") + F.col("_row")).drop(*_WORK)


_WORK = (
    "_bucket _sub _heavy _key _n_before _n_here _n_all _sub_before _sub_here _sub_all _rank _ties _row"
).split()


def _positions(df, value, row_id, buckets, seed=0):
    buckets = buckets or bucket_count(df)
    splits, heavy = sketch_splits(df, [value], buckets)[value]
    keyed = assign_bucket(df, value, splits, "_bucket").withColumn("_bucket", F.coalesce("_bucket", F.lit(-1)))
    keyed = keyed.withColumns(
        {
            # NULLs come first, in a bucket of their own; like any value that fills a bucket they are split by hash
            "_heavy": F.col(value).isNull() | (F.col(value).cast("double").isin(*heavy) if heavy else F.lit(False)),
            "_key": hash_order(row_id, seed),
        }
    )
    keyed = keyed.withColumn("_sub", F.when(F.col("_heavy"), hash_bucket(F.col("_key"))).otherwise(F.lit(0)))
    counts = (
        keyed.groupBy("_bucket", "_sub")
        .agg(F.count(F.lit(1)).alias("_sub_here"))
        .withColumns(
            {
                "_n_here": F.sum("_sub_here").over(W.partitionBy("_bucket")),
                "_sub_before": F.coalesce(
                    F.sum("_sub_here").over(
                        W.partitionBy("_bucket").orderBy("_sub").rowsBetween(W.unboundedPreceding, -1)
                    ),
                    F.lit(0),
                ),
                # at most buckets * SUB_BUCKETS rows, already aggregated
                "_n_before": F.coalesce(
                    F.sum("_sub_here").over(
                        W.partitionBy(F.lit(0)).orderBy("_bucket").rangeBetween(W.unboundedPreceding, -1)
                    ),
                    F.lit(0),
                ),
            }
        )
    )
    placed = join_null_safe(keyed, counts, ["_bucket", "_sub"])
    here = W.partitionBy("_bucket", "_sub")
    return placed.withColumns(
        {
            "_rank": F.rank().over(here.orderBy(value)),
            "_ties": F.count(F.lit(1)).over(here.orderBy(value).rangeBetween(0, 0)),
            "_row": F.row_number().over(here.orderBy(value, "_key", *row_id)),
        }
    )


def hash_rank(
    df: DataFrame, row_id: Sequence[str], out: str, seed: int | str = 42, by: Sequence[str] = (), bucket_rows: int = 100_000
) -> DataFrame:
    """Reproducible random permutation: 1-based position in md5 order, inside each ``by`` group.

    A group may hold most of the table, so the order is cut at md5 prefixes (uniform by construction)
    and the positions of earlier prefixes are added as offsets. There are so many prefixes that one holds
    about ``bucket_rows`` rows of the whole table at most.
    """
    buckets = max(16, math.ceil(df.count() / bucket_rows))
    keyed = df.withColumn("_key", hash_order(row_id, seed)).withColumn("_prefix", hash_bucket(F.col("_key"), buckets))
    placed = with_offsets(keyed, ["_prefix"], list(by), {"_c": F.count(F.lit(1))})
    inside = W.partitionBy(*by, "_prefix").orderBy("_key", *row_id)
    position = F.col("_c_before") + F.row_number().over(inside)
    return placed.withColumns({out: position, f"{out}_of": F.col("_c_all")}).drop(
        "_key", "_prefix", "_c_before", "_c_here", "_c_all"
    )


def running_totals(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Inclusive running sums (``cum_{name}``) and group totals (``tot_{name}``) along a unique ``order``.

    ``df`` must be pre-aggregated to one row per (by, order).
    """
    by = list(by)
    direction = F.col(order).desc() if descending else F.col(order).asc()
    splits, _ = sketch_splits(df, [order], buckets or bucket_count(df))[order]
    keyed = assign_bucket(df, order, splits, "_bucket")
    placed = with_offsets(keyed, ["_bucket"], by, {s: F.sum(s) for s in sums}, descending)
    inside = (
        W.partitionBy(*by, "_bucket").orderBy(direction).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    out = placed.withColumns(
        {f"cum_{s}": F.col(f"{s}_before") + F.sum(s).over(inside) for s in sums}
        | {f"tot_{s}": F.col(f"{s}_all") for s in sums}
    )
    return out.drop("_bucket", *[f"{s}{end}" for s in sums for end in ("_before", "_here", "_all")])


def value_histogram(df: DataFrame, value: str, by: Sequence[str] = (), weights: dict[str, Column] | None = None):
    """One row per (by, value) with the row count ``n`` and optional extra sums; partial on the map side."""
    extra = [expr.alias(name) for name, expr in (weights or {}).items()]
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), *extra)


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], buckets: int | None = None
) -> DataFrame:
    """Rows ``(feature, prob, value)``: linear-interpolation quantiles of whole columns, exact.

    The built-in exact ``percentile`` merges a map of all distinct values in one task. Here every column is cut into
    equi-depth buckets by a sketch. One scan counts each column's buckets (a task sends one number per column and
    bucket); the counts tell which buckets hold the wanted positions, and a second scan sends the values of
    those buckets only, counted per batch. NULL and NaN do not count; a column without values has no rows.
    """
    columns = list(columns)
    plan = sketch_splits(df, columns, buckets or bucket_count(df))
    inner = [np.array(plan[c][0][1:-1]) for c in columns]
    rows = df.select(*[plain_double(c).alias(f"c{i}") for i, c in enumerate(columns)])

    def placed(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
        values = batch.column(i).to_numpy(zero_copy_only=False)
        values = values[~np.isnan(values)]
        return values, np.searchsorted(inner[i], values, side="right")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(len(cuts) + 1, np.int64) for cuts in inner]
        for batch in batches:
            for i, total in enumerate(totals):
                total += np.bincount(placed(batch, i)[1], minlength=len(total))
        for i, total in enumerate(totals):
            held = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), i)), pa.array(held), pa.array(total[held])], names=["i", "bucket", "n"])

    sizes = rows.mapInArrow(counted, "i long, bucket long, n long").groupBy("i", "bucket").agg(F.sum("n").alias("n"))
    by_column: dict[int, list[tuple[int, int]]] = {}
    for r in sizes.collect():  # one row per column and bucket
        by_column.setdefault(r.i, []).append((r.bucket, r.n))
    asked, wanted = [], {}
    for i, held in by_column.items():
        held.sort()
        ends = np.cumsum([n for _, n in held])
        for p in probabilities:
            target = float(p) * (int(ends[-1]) - 1)
            for end, position in (("a", math.floor(target)), ("b", math.ceil(target))):
                at = int(np.searchsorted(ends, position, side="right"))
                wanted.setdefault(i, set()).add(held[at][0])
                asked.append((i, held[at][0], columns[i], float(p), target, end, position - int(ends[at] - held[at][1])))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, own in wanted.items():
                values, bucket = placed(batch, i)
                kept = np.isin(bucket, list(own))
                found, first, n = np.unique(values[kept], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), i)), pa.array(bucket[kept][first]), pa.array(found), pa.array(n)], names=["i", "bucket", "value", "n"]
                )

    held = rows.mapInArrow(picked, "i long, bucket long, value double, n long").groupBy("i", "bucket", "value").agg(F.sum("n").alias("n"))
    inside = W.partitionBy("i", "bucket").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    spans = held.withColumn("stop", F.sum("n").over(inside)).withColumn("start", F.col("stop") - F.col("n"))
    schema = "i long, bucket long, feature string, prob double, target double, end string, position long"
    questions = F.broadcast(df.sparkSession.createDataFrame(asked, schema))  # two rows per column and probability
    met = spans.join(questions, ["i", "bucket"]).filter((F.col("start") <= F.col("position")) & (F.col("position") < F.col("stop")))
    ends = met.groupBy("feature", "prob").agg(
        F.max(F.when(F.col("end") == "a", F.col("value"))).alias("a"),
        F.max(F.when(F.col("end") == "b", F.col("value"))).alias("b"),
        F.max("target").alias("t"),
    )
    return ends.select("feature", "prob", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("t") - F.floor("t"))).alias("value"))


def quantile_map(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float]]:
    """The same quantiles as a small dictionary, for cut points that become literals."""
    found = {(r["feature"], r["prob"]): r["value"] for r in exact_quantiles(df, columns, probabilities).collect()}
    return {c: [found.get((c, float(p))) for p in probabilities] for c in columns}


def next_value(df: DataFrame, value: str, out: str, buckets: int | None = None, place: str | None = None) -> DataFrame:
    """Next larger value over the whole table (``lead`` in global order); NULL for the last row.

    A value that is not a number needs a number ``place`` that never falls as the value rises, to cut the range by.

    Inside a bucket this is a partitioned window; the last row of a bucket takes the smallest value of
    the next non-empty bucket from the one-row-per-bucket table.
    """
    place = place or value
    splits, _ = sketch_splits(df, [place], buckets or bucket_count(df))[place]
    keyed = assign_bucket(df, place, splits, "_bucket")
    firsts = keyed.groupBy("_bucket").agg(F.min(value).alias("_first"))
    firsts = firsts.select(
        "_bucket", F.lead("_first").over(W.partitionBy(F.lit(0)).orderBy("_bucket")).alias("_following")
    )
    inside = W.partitionBy("_bucket").orderBy(value)
    return (
        join_null_safe(keyed, firsts, ["_bucket"])
        .withColumn(out, F.coalesce(F.lead(value).over(inside), F.col("_following")))
        .drop("_bucket", "_following")
    )


def equal_frequency_bin(rank: Column, n: Column, bins: int) -> Column:
    """Bin ``bins`` … 1 by ascending unique rank; bin 1 holds the largest values.

    Edges lie at the linear-interpolation quantiles of the ranks, which decides where remainders go.
    """
    position = F.greatest(F.lit(1), F.ceil((rank - 1) * bins / (n - 1)))
    return (F.lit(bins + 1) - position).cast("int")


def step_lookup(
    df: DataFrame, value: str, steps: DataFrame, key: str, payload: str, out: str, forward: bool = False, by: Sequence[str] = ()
) -> DataFrame:
    """Payload of the last step with ``key <= value`` (or, ``forward``, the first with ``key >= value``).

    ``steps`` has one row per key. Both sides are cut at the quantiles of the rows, so that rows, which
    are many, fill the buckets evenly; a value that fills several buckets stands alone in one, and its rows
    are spread over sub-buckets by hash. A row before (after) all steps of its bucket takes the payload
    carried over from the nearest other bucket. With ``by`` rows meet the steps of their own group, NULL being a
    group, all groups in one plan; a group without steps has no payload.
    """
    by, kind = list(by), dict(steps.dtypes)[payload]
    groups = [f"_g{i}" for i in range(len(by))]
    own_group = [F.col(f"`{c}`").alias(g) for c, g in zip(by, groups, strict=True)]
    steps = steps.filter(F.col(key).isNotNull()).select(plain_double(key).alias("_k"), F.col(payload).alias("_p"), *own_group)
    keyed = df.withColumn("_k", plain_double(value))
    splits, heavy = sketch_splits(keyed, ["_k"], bucket_count(df))["_k"]
    own = [F.col(f"`{c}`") for c in df.columns]
    row = F.struct(*own)
    spread = F.pmod(F.xxhash64(*own), F.lit(SUB_BUCKETS)).cast("int")
    hot = F.col("_k").isNull() | (F.col("_k").isin(*heavy) if heavy else F.lit(False))
    left = assign_bucket(keyed.select("_k", row.alias("_row"), F.when(hot, spread).otherwise(0).alias("_sub"), *own_group), "_k", splits, "_bucket")
    right = assign_bucket(steps, "_k", splits, "_bucket")
    # the buckets of heavy values hold one value and hence at most one step: it goes to every sub-bucket
    alone = right.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.max("_k").alias("_only"))
    hot_bucket = F.col("_only").isin(*heavy) if heavy else F.lit(False)
    subs = F.when(hot_bucket & (F.col("_n") == 1), F.sequence(F.lit(0), F.lit(SUB_BUCKETS - 1))).otherwise(F.array(F.lit(0)))
    placed_steps = join_null_safe(right, alone.select(*groups, "_bucket", subs.alias("_subs")), [*groups, "_bucket"])
    placed_steps = placed_steps.select("_k", "_p", *groups, "_bucket", F.explode("_subs").alias("_sub"))
    edge = F.min(F.struct("_k", "_p")) if forward else F.max(F.struct("_k", "_p"))
    places = [*groups, "_bucket"]
    edges = right.groupBy(*places).agg(edge.alias("_e")).select(*places, F.col("_e._p").alias("_edge"))
    every = left.select(*places).distinct().unionByName(edges.select(*places)).distinct()
    edges = join_null_safe(every, edges, places, "left")
    whole = groups or [F.lit(0)]
    if forward:
        beyond = W.partitionBy(*whole).orderBy("_bucket").rowsBetween(1, W.unboundedFollowing)
        carried = F.first("_edge", ignorenulls=True).over(beyond)
        inside = W.partitionBy(*places, "_sub").orderBy("_k", F.col("_tag").desc()).rowsBetween(W.currentRow, W.unboundedFollowing)
        nearest = F.first("_p", ignorenulls=True).over(inside)
    else:
        beyond = W.partitionBy(*whole).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
        carried = F.last("_edge", ignorenulls=True).over(beyond)
        inside = W.partitionBy(*places, "_sub").orderBy("_k", "_tag").rowsBetween(W.unboundedPreceding, W.currentRow)
        nearest = F.last("_p", ignorenulls=True).over(inside)
    carried_rows = edges.select(*places, carried.alias("_carried"))
    row_tag, step_tag = 1, 0  # at equal keys the step precedes the row, or follows it when looking forward
    merged = left.withColumn("_p", F.lit(None).cast(kind)).withColumn("_tag", F.lit(row_tag)).unionByName(
        placed_steps.withColumn("_tag", F.lit(step_tag)), allowMissingColumns=True
    )
    matched = merged.withColumn("_near", nearest).filter(F.col("_tag") == row_tag)
    joined = join_null_safe(matched, carried_rows, places)
    found = F.when(F.col("_k").isNotNull(), F.coalesce("_near", "_carried"))
    return joined.select("_row.*", found.alias(out))
