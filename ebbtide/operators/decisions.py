"""From scores to actions: lift tables, gains, retention tiers, submissions and their checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.functions import vectors as V
from ebbtide.functions.columns import right_closed_bin
from ebbtide.operators.ranks import assign_bucket, bucket_count, equal_frequency_bin, sketch_splits, unique_rank

# fixed values: tier edges on the 30-day churn probability
TIER_EDGES = (-1.0, 0.02, 0.05, 0.15, 1.0)
TIER_NAMES = ("watch", "soon", "urgent", "critical")


def deciles(df: DataFrame, score: str, row_id: Sequence[str], bins: int = 10) -> DataFrame:
    """Adds ``decile`` 1 (highest scores) … ``bins``; ties are broken by the hash of the id."""
    n = df.count()
    ranked = unique_rank(df, score, "_r", row_id)
    return ranked.withColumn("decile", equal_frequency_bin(F.col("_r"), F.lit(max(n, 2)), bins)).drop("_r")


def lift_table(df: DataFrame, score: str, label: str, row_id: Sequence[str], bins: int = 10) -> DataFrame:
    """Per decile: customers, churners, churn rate, lift over the base rate, cumulative recall."""
    table = (
        deciles(df, score, row_id, bins)
        .groupBy("decile")
        .agg(F.count(F.lit(1)).alias("customers"), F.sum(label).alias("churners"), F.avg(label).alias("churn_rate"))
    )
    whole = W.partitionBy(F.lit(0))  # one row per decile from here on
    running = whole.orderBy("decile").rowsBetween(W.unboundedPreceding, W.currentRow)
    base = F.sum("churners").over(whole) / F.sum("customers").over(whole)
    return table.withColumns(
        {
            "lift": F.try_divide(F.col("churn_rate"), base),
            "cum_recall": F.try_divide(F.sum("churners").over(running), F.sum("churners").over(whole)),
        }
    )


def gains_curve(lift: DataFrame) -> DataFrame:
    """Share of customers targeted against share of churners captured, both in percent."""
    whole = W.partitionBy(F.lit(0))
    running = whole.orderBy("decile").rowsBetween(W.unboundedPreceding, W.currentRow)
    targeted = 100.0 * F.sum("customers").over(running) / F.sum("customers").over(whole)
    return lift.select("decile", targeted.alias("targeted"), (100.0 * F.col("cum_recall")).alias("captured"))


def top_fraction(df: DataFrame, score: str, row_id: Sequence[str], fraction: float = 0.1) -> DataFrame:
    """The ``max(1, floor(n * fraction))`` rows with the highest scores; ties by the hash of the id.

    Score buckets are counted; buckets above the one that is cut are kept whole, and only the rows of that one are
    ranked. Rows without a score come first.
    """
    down = df.withColumn("_down", -F.col(score))
    splits, _ = sketch_splits(down, ["_down"], bucket_count(df))["_down"]
    keyed = assign_bucket(down, "_down", splits, "_cut").withColumn("_cut", F.coalesce("_cut", F.lit(-1)))
    counts = sorted(tuple(r) for r in keyed.groupBy("_cut").count().collect())  # one row per bucket
    wanted = max(1, int(sum(n for _, n in counts) * fraction))
    for cut, n in counts:
        if wanted <= n:
            break
        wanted -= n
    else:
        return df
    edge = unique_rank(keyed.filter(F.col("_cut") == cut), "_down", "_r", row_id).filter(F.col("_r") <= wanted).drop("_r")
    return keyed.filter(F.col("_cut") < cut).unionByName(edge).drop("_down", "_cut")


def top_capture(df: DataFrame, score: str, label: str, row_id: Sequence[str], fraction: float = 0.1) -> DataFrame:
    """Precision, recall and lift of targeting the top fraction."""
    base = df.agg(F.avg(label).alias("rate"), F.sum(label).alias("positives")).first()
    top = top_fraction(df, score, row_id, fraction)
    return top.agg(F.count(F.lit(1)).alias("targeted"), F.sum(label).alias("hits"), F.avg(label).alias("precision")).withColumns(
        {
            "recall": F.col("hits") / F.lit(float(max(1, base["positives"] or 0))),
            "lift": F.try_divide(F.col("precision"), F.lit(base["rate"])),
        }
    )


def retention_tier(df: DataFrame, churn: str = "churn30") -> DataFrame:
    return df.withColumn("tier", right_closed_bin(F.col(churn), TIER_EDGES, TIER_NAMES))


def tier_summary(df: DataFrame, churn90: str = "churn90") -> DataFrame:
    """Per tier: customers, event rate, mean predicted 90-day churn, median duration.

    Durations are whole days, so the exact median needs one small map per tier.
    """
    return df.groupBy("tier").agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("event").alias("actual_event_rate"),
        F.avg(churn90).alias("mean_pred_churn90"),
        F.percentile("time", 0.5).alias("median_duration"),
    )


def with_actions(df: DataFrame, actions: Mapping[str, str], key: str = "tier") -> DataFrame:
    """Attach the caller's action of each tier (or driver); a value without one gets NULL."""
    mapping = df.sparkSession.createDataFrame(list(actions.items()), f"{key} string, action string")
    return df.join(F.broadcast(mapping), key, "left")


def monotone_probabilities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Clip to [0, 1] and take the running minimum from the first to the last horizon."""
    clipped = [F.least(F.greatest(F.col(name), F.lit(0.0)), F.lit(1.0)) for name in columns]
    return df.withColumns(dict(zip(columns, V.running_minimum(clipped), strict=True)))


def submission(scored: DataFrame, ids: DataFrame, risk: str, survival: Sequence[str], horizons=(30, 60, 90)) -> DataFrame:
    """Scoring list with shifted non-negative risk and monotone survival probabilities."""
    names = [f"SURV_PROB_{h}D" for h in horizons]
    base = ids.join(scored, "id", "left")
    lowest = base.agg(F.min(risk)).scalar()
    out = base.select(
        F.col("id").alias("ACCOUNT_ID"),
        F.greatest(F.col(risk) - lowest, F.lit(0.0)).alias("RISK_SCORE"),
        *[F.col(s).alias(n) for s, n in zip(survival, names, strict=True)],
    )
    return monotone_probabilities(out, names)


def binary_submission(scored: DataFrame, ids: DataFrame, probability: str) -> DataFrame:
    clipped = F.least(F.greatest(F.col(probability), F.lit(0.0)), F.lit(1.0))
    return ids.join(scored, "id", "left").select(F.col("id").alias("ACCOUNT_ID"), clipped.alias("CHURN_PROB"))


def submission_checks(sub: DataFrame, expected_rows: int, key: str = "ACCOUNT_ID") -> DataFrame:
    """One row of 0/1 verdicts: row count, unique ids, no NULL, bounds, monotone survival."""
    probabilities = [c for c in sub.columns if c.startswith("SURV_PROB_") or c == "CHURN_PROB"]
    bounded = F.lit(True)
    for p in probabilities:
        bounded = bounded & F.col(p).between(0, 1)
    monotone = F.lit(True)
    for a, b in zip(probabilities, probabilities[1:], strict=False):
        monotone = monotone & (F.col(a) >= F.col(b) - 1e-9)
    whole = F.lit(True)
    for name in sub.columns:
        whole = whole & F.col(name).isNotNull()
    # one row per id first, so that the uniqueness check needs no global distinct
    per_id = sub.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.coalesce(bounded, F.lit(False))).alias("bounded"),
        F.bool_and(F.coalesce(monotone, F.lit(False))).alias("monotone"),
        F.bool_and(whole).alias("whole"),
    )
    return per_id.agg(
        F.sum("n").alias("n_rows"),
        (F.sum("n") == expected_rows).cast("int").alias("rows_ok"),
        (F.max("n") == 1).cast("int").alias("unique_ok"),
        F.bool_and("whole").cast("int").alias("not_null_ok"),
        F.bool_and("bounded").cast("int").alias("bounds_ok"),
        F.bool_and("monotone").cast("int").alias("monotone_ok"),
    )


def campaign_value(lift: DataFrame, cost: float = 20.0, value: float = 500.0, save_rate: float = 0.3) -> DataFrame:
    """Expected value per decile of contacting everyone in it."""
    saved = F.col("churners") * save_rate * value
    spent = F.col("customers") * cost
    return lift.select("decile", "customers", "churners", saved.alias("saved"), spent.alias("spent"), (saved - spent).alias("net"))
