"""Ranking and calibration metrics on whole tables: AUC, precision, Brier, concordance, time-dependent AUC.

Threshold metrics read a histogram of the score, so equal scores are one row and the running sums over
it are bucketed (see ``ranks.running_totals``); no pair of rows is ever formed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.functions import vectors as V
from ebbtide.operators.decisions import top_capture
from ebbtide.operators.km import survival_at, survival_table
from ebbtide.operators.ranks import (
    hash_rank,
    join_null_safe,
    plain_double,
    running_totals,
    step_lookup,
)
from ebbtide.operators.skew import salted_join
from ebbtide.session import materialize

# ---- binary scores ----------------------------------------------------------------------------------------


def score_histogram(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score with positives ``pos`` and negatives ``neg``."""
    positive = F.col(label).cast("bigint")
    return df.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve with half weight on ties; NULL when a class is missing."""
    hist = materialize(score_histogram(df, score, label, by))
    run = running_totals(hist, "score", ["pos", "neg"], by)
    below = F.col("cum_neg") - F.col("neg") / 2
    return run.groupBy(*by).agg(
        F.try_divide(
            F.sum(F.col("pos") * below), F.max("tot_pos").cast("double") * F.max("tot_neg").cast("double")
        ).alias("auc")
    )


def average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of precision times the recall gained at each distinct threshold, from high to low."""
    hist = materialize(score_histogram(df, score, label, by)).withColumn("all", F.col("pos") + F.col("neg"))
    run = running_totals(hist, "score", ["pos", "all"], by, descending=True)
    gained = F.try_divide(F.col("pos"), F.col("tot_pos"))
    return run.groupBy(*by).agg(F.sum(gained * F.col("cum_pos") / F.col("cum_all")).alias("ap"))


def threshold_areas(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """``by…, auc, ap``: both areas from one histogram and one running sum, for all groups at once.

    Counts from the highest score down are the totals less the counts below.
    """
    hist = materialize(score_histogram(df, score, label, by))
    run = running_totals(hist, "score", ["pos", "neg"], by)
    below = F.col("cum_neg") - F.col("neg") / 2
    found = F.col("tot_pos") - F.col("cum_pos") + F.col("pos")
    named = found + F.col("tot_neg") - F.col("cum_neg") + F.col("neg")
    pairs = F.max("tot_pos").cast("double") * F.max("tot_neg").cast("double")
    return run.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("pos") * below), pairs).alias("auc"),
        F.sum(F.try_divide(F.col("pos"), F.col("tot_pos")) * found / named).alias("ap"),
    )


def classifier_metrics(df: DataFrame, score: str, label: str, row_id: Sequence[str], fraction: float = 0.1) -> DataFrame:
    """One row: AUC, average precision, precision and recall in the top fraction."""
    areas = threshold_areas(df, score, label).select(F.struct("auc", "ap").alias("areas")).scalar()
    top = top_capture(df, score, label, row_id, fraction).withColumn("areas", areas)
    return top.select("areas.auc", "areas.ap", F.col("precision").alias("p_at_10"), F.col("recall").alias("r_at_10"))


def model_table(df: DataFrame, scores: Sequence[str], label: str, row_id: Sequence[str], minutes=None) -> DataFrame:
    """``model, auc, ap, p_at_10, r_at_10, fit_min``: ``classifier_metrics`` of several score columns, one row per model.

    The areas of all models come from one scan; ``minutes`` by model, 0 where unknown.
    """
    scored = [F.struct(F.lit(name).alias("model"), F.col(f"`{name}`").cast("double").alias("score")) for name in scores]
    long = df.select(F.col(f"`{label}`").alias("y"), F.explode(F.array(*scored)).alias("s")).select("y", "s.*")
    areas = threshold_areas(long, "score", "y", ["model"])
    out = None
    for name in scores:
        row = top_capture(df, name, label, row_id).select(
            F.lit(name).alias("model"),
            F.col("precision").alias("p_at_10"),
            F.col("recall").alias("r_at_10"),
            F.lit(float((minutes or {}).get(name, 0.0))).alias("fit_min"),
        )
        out = row if out is None else out.unionByName(row)
    return out.join(areas, "model", "left").select("model", "auc", "ap", "p_at_10", "r_at_10", "fit_min")


# ---- survival probabilities ---------------------------------------------------------------------------------


def brier(df: DataFrame, horizons: Sequence[int], survival: Sequence[str], time: str = "time") -> DataFrame:
    """Mean squared error of S(h) against 1[T > h], all horizons in one pass."""
    errors = []
    for h, s in zip(horizons, survival, strict=True):
        miss = (F.col(time) > h).cast("double") - F.col(s)
        errors.append(F.avg(miss * miss).alias(f"brier_{h}"))
    return df.agg(*errors)


def integrated(values: DataFrame, horizons: Sequence[float], prefix: str = "brier_", out: str = "ibs") -> DataFrame:
    """Trapezoid average of per-horizon columns over the horizon range."""
    curve = [F.col(f"{prefix}{h}") for h in horizons]
    return values.withColumn(out, V.trapezoid(curve, list(horizons)) / float(horizons[-1] - horizons[0]))


def competition_score(c_index, ibs):
    """Points of a concordance and an integrated Brier score, as columns."""
    ranking = F.greatest(F.lit(0.0), (c_index - 0.5) / 0.5) * 40
    calibration = F.greatest(F.lit(0.0), (0.05 - ibs) / 0.05) * 30
    return ranking, calibration


def scorecard(c_index: float, ibs: float, spark: SparkSession) -> DataFrame:
    """Rows ``(metric, value, points)`` with the total last."""
    one = spark.createDataFrame([(float(c_index), float(ibs))], "c double, i double")
    ranking, calibration = competition_score(F.col("c"), F.col("i"))
    rows = F.array(
        F.struct(F.lit("c_index").alias("metric"), F.col("c").alias("value"), ranking.alias("points")),
        F.struct(F.lit("ibs").alias("metric"), F.col("i").alias("value"), calibration.alias("points")),
        F.struct(
            F.lit("total").alias("metric"), F.lit(None).cast("double").alias("value"), (ranking + calibration).alias("points")
        ),
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def censoring_curve(df: DataFrame, time: str = "time", event: str = "event") -> DataFrame:
    """Survival function of the censoring time, ``(t, g)``; events leave before censorings of the same time."""
    table = survival_table(df, time, event)
    at_risk = F.col("n_risk") - F.col("d")
    # the last time with nobody at risk but the censored themselves ends at 0
    factor = F.when(at_risk > F.col("censored"), F.ln(1 - F.col("censored") / at_risk)).otherwise(F.lit(0.0))
    ends = (F.col("censored") > 0) & (at_risk == F.col("censored"))
    steps = table.select("t", factor.alias("log_step"), ends.cast("int").alias("ends"))
    run = running_totals(steps, "t", ["log_step", "ends"])
    return run.select("t", F.when(F.col("cum_ends") > 0, F.lit(0.0)).otherwise(F.exp("cum_log_step")).alias("g"))


def with_censoring_weight(df: DataFrame, curve: DataFrame, time: str = "time", event: str = "event") -> DataFrame:
    """Adds ``ipcw`` = 1/G(T) on event rows (0 on censored rows), G read at the last step before or at T."""
    found = step_lookup(df, time, curve, "t", "g", "_g")
    weight = F.when(F.col(event) == 1, F.try_divide(F.lit(1.0), F.coalesce("_g", F.lit(1.0)))).otherwise(F.lit(0.0))
    return found.withColumn("ipcw", F.coalesce(weight, F.lit(0.0))).drop("_g")


def ipcw_brier(df: DataFrame, times: Sequence[float], survival: Sequence[str], curve: DataFrame) -> DataFrame:
    """Brier score with inverse-probability-of-censoring weights at each time, and their trapezoid mean.

    ``curve`` is the censoring curve of the training data; columns ``brier_0 …`` follow ``times``.
    """
    scores = with_censoring_weight(df, curve).agg(*_weighted_errors(times, survival, _curve_at(curve, times)))
    return _mean_over_times(scores, times, "brier_", "ibs")


def _mean_over_times(scores: DataFrame, times: Sequence[float], prefix: str, out: str) -> DataFrame:
    curve = [F.col(f"{prefix}{i}") for i in range(len(times))]
    return scores.withColumn(out, V.trapezoid(curve, list(times)) / float(times[-1] - times[0]))


def _weighted_errors(times: Sequence[float], survival: Sequence[str], at: Sequence[float], prefix: str = "brier_") -> list[Column]:
    """Mean squared errors of rows with ``ipcw``, one aggregate per time; ``at`` is the censoring curve there."""
    columns = []
    for i, (t, s) in enumerate(zip(times, survival, strict=True)):
        early = (F.col("time") <= t) & (F.col("event") == 1)
        died = F.when(early, F.col(s) * F.col(s) * F.col("ipcw")).otherwise(F.lit(0.0))
        alive = F.when(F.col("time") > t, (1 - F.col(s)) * (1 - F.col(s)) / at[i]).otherwise(F.lit(0.0))
        columns.append(F.avg(died + alive).alias(f"{prefix}{i}"))
    return columns


def _curve_at(curve: DataFrame, times: Sequence[float]) -> list[float]:
    row = curve.agg(*[F.max_by("g", F.when(F.col("t") <= t, F.col("t"))).alias(f"g{i}") for i, t in enumerate(times)]).first()
    return [1.0 if row[f"g{i}"] is None else float(row[f"g{i}"]) for i in range(len(times))]


def evaluation_times(train: DataFrame, test: DataFrame, n: int = 10) -> list[float]:
    """``n`` inner points of an even grid strictly inside the event-time ranges of both tables."""
    ranges = [df.filter("event = 1").agg(F.min("time"), F.max("time")).first() for df in (train, test)]
    low, high = max(float(r[0]) for r in ranges), min(float(r[1]) for r in ranges)
    return [low + (high - low) * i / (n + 1) for i in range(1, n + 1)]


def time_dependent_auc(df: DataFrame, risk: str, times: Sequence[float], curve: DataFrame) -> DataFrame:
    """Rows ``(t, auc)``: chance that a case by ``t`` outranks a row still at risk after ``t``.

    Cases weigh 1/G(T) from the training censoring curve; equal risks count one half.
    """
    return _weighted_time_auc(with_censoring_weight(df, curve), risk, times)


def _weighted_time_auc(weighted: DataFrame, risk: str, times: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    per_time = F.explode(F.array(*[F.lit(float(t)) for t in times])).alias("t")
    case = F.when((F.col("time") <= F.col("t")) & (F.col("event") == 1), F.col("ipcw")).otherwise(F.lit(0.0))
    control = (F.col("time") > F.col("t")).cast("double")
    hist = materialize(
        weighted.select(*by, F.col(risk).alias("score"), "time", "event", "ipcw", per_time)
        .groupBy(*by, "t", "score")
        .agg(F.sum(case).alias("case"), F.sum(control).alias("control"))
    )
    run = running_totals(hist, "score", ["case", "control"], [*by, "t"])
    won = F.col("case") * (F.col("cum_control") - F.col("control") / 2)
    return run.groupBy(*by, "t").agg(F.try_divide(F.sum(won), F.max("tot_case") * F.max("tot_control")).alias("auc"))


def mean_time_auc(aucs: DataFrame, table: DataFrame, times: Sequence[float]) -> float:
    """Average of AUC(t) weighted by the drop of the survival curve over the evaluated times."""
    surv = {r["t"]: r["surv"] for r in survival_at(table, times).collect()}
    score = {r["t"]: r["auc"] for r in aucs.collect()}
    total, previous = 0.0, 1.0
    for t in times:
        total += (score[float(t)] or 0.0) * (previous - surv[float(t)])
        previous = surv[float(t)]
    return total / (1.0 - previous) if previous < 1.0 else float("nan")


def survival_evaluation(
    test: DataFrame, train: DataFrame, models: Mapping[str, tuple[str, Sequence[str]]], times: Sequence[float]
) -> DataFrame:
    """One row per model: ``model, c_index, ibs, mean_auc``.

    ``models`` names a risk column and the survival columns at ``times`` (at least two, rising); censoring weights come from
    ``train``, the weights of the times from the survival curve of ``test``. All models share the jobs: weights are
    looked up once, Brier scores are one aggregate, and concordance and AUC take the model as a group. Rows without
    a risk take part in neither; a model without a comparable pair has concordance 0.5; a time without cases or
    controls adds nothing to the mean AUC; an empty table has no Brier score and no AUC.
    """
    curve = materialize(censoring_curve(train))
    used = list(dict.fromkeys(c for risk, survival in models.values() for c in (risk, *survival)))
    weighted = materialize(with_censoring_weight(test, curve).select("time", "event", "ipcw", *used))
    risks = [F.struct(F.lit(m).alias("model"), plain_double(risk).alias("risk")) for m, (risk, _) in models.items()]
    long = weighted.select("time", "event", "ipcw", F.explode(F.array(*risks)).alias("m")).select("time", "event", "ipcw", "m.*")
    long = long.filter("risk is not null")

    at, errors = _curve_at(curve, times), []
    for i, (_, survival) in enumerate(models.values()):
        errors += _weighted_errors(times, survival, at, f"brier_{i}_")
    brier_row = weighted.agg(*errors)
    for i in range(len(models)):
        brier_row = _mean_over_times(brier_row, times, f"brier_{i}_", f"ibs_{i}")
    ibs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"ibs_{i}").alias("ibs")) for i, m in enumerate(models)]))

    surv = {r["t"]: r["surv"] for r in survival_at(survival_table(test), times).collect()}  # one row per asked time
    levels = [1.0, *[1.0 if surv[float(t)] is None else float(surv[float(t)]) for t in times]]
    drop = F.lit(0.0)
    for t, before, after in zip(times, levels, levels[1:], strict=False):
        drop = drop + F.when(F.col("t") == float(t), F.lit(before - after)).otherwise(F.lit(0.0))
    aucs = _weighted_time_auc(long, "risk", times, ["model"]).groupBy("model")
    mean_auc = aucs.agg(F.try_divide(F.sum(F.coalesce("auc", F.lit(0.0)) * drop), F.lit(1.0 - levels[-1])).alias("mean_auc"))
    ranked = concordance(long, "risk", by=["model"]).select("model", "c_index")
    row = brier_row.select(ibs.alias("r")).select("r.*").join(ranked, "model", "left").join(mean_auc, "model", "left")
    return row.select("model", F.coalesce("c_index", F.lit(0.5)).alias("c_index"), "ibs", "mean_auc")


# ---- concordance ----------------------------------------------------------------------------------------------

DIGIT_BITS = 4
DIGITS = 1 << DIGIT_BITS


def _comparison_time(df: DataFrame, time: str, event: str, tied_times: bool) -> DataFrame:
    """Column ``t`` whose strict order decides which row outlives which."""
    if not tied_times:
        return df.withColumn("t", F.col(time).cast("double"))
    if dict(df.dtypes)[time] in ("int", "bigint", "smallint", "tinyint"):
        return df.withColumn("t", (F.col(time) * 2 + 1 - F.col(event)).cast("double"))
    counts = df.groupBy(F.col(time).alias("_time")).agg(F.count(F.lit(1)).alias("n"))
    position = running_totals(counts, "_time", ["n"]).select("_time", F.col("cum_n").alias("_position"))
    placed = salted_join(df.withColumn("_time", F.col(time)), position, "_time", df.columns)
    return placed.withColumn("t", (F.col("_position") * 2 + 1 - F.col(event)).cast("double"))


def concordance(
    df: DataFrame,
    risk: str,
    time: str = "time",
    event: str = "event",
    tied_times: bool = False,
    by: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Exact concordance index of right-censored data: ``by…, concordant, tied_risk, comparable, c_index``.

    A pair counts when ``i`` has an event and ``j`` outlives it; with ``tied_times`` also when ``j`` is
    censored at that very time. Rows without a risk, time or event take part in no pair. No pair is formed:
    rows are counted per (time, risk), the risks are numbered in order, and the number is read as digits of
    base ``DIGITS``. Two numbers first differ at one digit, so for every digit the rows with equal higher
    digits are a block, and one running sum per lower digit, from the last time backwards, counts the smaller
    risks that live longer. A block may hold the whole table: it is summed per time first and the running sums
    are cut at time buckets, so no task holds a block. Groups of ``by`` (candidates, folds) share all steps.
    """
    by = list(by)
    whole = df.select(*by, time, event, risk).dropna(subset=[time, event, risk])
    keyed = _comparison_time(whole, time, event, tied_times)
    counts = materialize(
        keyed.groupBy(*by, (F.col("t") + F.lit(0.0)).alias("t"), plain_double(risk).alias("risk")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("bigint")).alias("ev")
        )
    )
    later = F.col("ev").cast("double") * (F.col("cum_n") - F.col("n"))

    per_time = counts.groupBy(*by, "t").agg(F.sum("n").alias("n"), F.sum("ev").alias("ev"))
    comparable = running_totals(per_time, "t", ["n"], by, descending=True, buckets=buckets)
    parts = [comparable.select(*by, F.lit("comparable").alias("part"), later.alias("pairs"))]

    tied = running_totals(counts, "t", ["n"], [*by, "risk"], descending=True, buckets=buckets)
    parts.append(tied.select(*by, F.lit("tied_risk").alias("part"), later.alias("pairs")))

    per_risk = counts.groupBy(*by, "risk").agg(F.sum("n").alias("n"))
    numbered = running_totals(per_risk, "risk", ["n"], by, buckets=buckets)
    numbered = numbered.select(*by, "risk", (F.col("cum_n") - F.col("n")).alias("_number"))
    placed = materialize(join_null_safe(counts, numbered, [*by, "risk"]))
    last = placed.agg(F.max("_number")).first()[0] or 0
    levels = max(1, -(-int(last).bit_length() // DIGIT_BITS))
    shifted = lambda level: F.call_function("shiftright", F.col("_number"), (level * DIGIT_BITS).cast("int"))
    digits = placed.select(*by, "t", "n", "ev", "_number", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_level"))
    digits = digits.withColumns(
        {"_digit": shifted(F.col("_level")).bitwiseAND(F.lit(DIGITS - 1)), "_block": shifted(F.col("_level") + 1)}
    )
    at = lambda d, name: F.sum(F.when(F.col("_digit") == d, F.col(name)).otherwise(F.lit(0)))
    below = [f"n{d}" for d in range(DIGITS - 1)]
    block = materialize(
        digits.groupBy(*by, "_level", "_block", "t").agg(
            *[at(d, "n").alias(f"n{d}") for d in range(DIGITS - 1)], *[at(d, "ev").alias(f"e{d}") for d in range(1, DIGITS)]
        )
    )
    run = running_totals(block, "t", below, [*by, "_level", "_block"], descending=True, buckets=buckets)
    smaller, pairs = F.lit(0.0), F.lit(0.0)
    for d in range(1, DIGITS):
        smaller = smaller + (F.col(f"cum_n{d - 1}") - F.col(f"n{d - 1}"))
        pairs = pairs + F.col(f"e{d}") * smaller
    parts.append(run.select(*by, F.lit("concordant").alias("part"), pairs.alias("pairs")))

    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    names = ["concordant", "tied_risk", "comparable"]
    total = union.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(F.col("part") == n, F.col("pairs"))), F.lit(0.0)).alias(n) for n in names]
    )
    share = F.try_divide(F.col("concordant") + F.col("tied_risk") / 2, F.col("comparable"))
    return total.select(*by, *names, F.coalesce(share, F.lit(0.5)).alias("c_index"))


def concordance_index(df: DataFrame, risk: str, **options) -> float:
    return float(concordance(df, risk, **options).first()["c_index"])


def sampled_concordance(
    df: DataFrame, risk: str, row_id: Sequence[str], draws: int = 3_000_000, seed: int = 0, time="time", event="event"
) -> DataFrame:
    """Concordance estimated from random (event, any) pairs drawn with replacement.

    Both sides are numbered by hash order and met by equi-joins on the drawn numbers, so a draw costs two
    shuffled rows and no task sees more than its share.
    """
    spark = df.sparkSession
    base = materialize(df.select(*row_id, F.col(time).alias("t"), F.col(event).alias("e"), F.col(risk).alias("r")))
    left = hash_rank(base.filter("e = 1"), row_id, "i", seed).select("i", F.col("t").alias("ti"), F.col("r").alias("ri"))
    right = hash_rank(base, row_id, "j", seed).select("j", F.col("t").alias("tj"), F.col("r").alias("rj"))
    events, rows = base.filter("e = 1").count(), base.count()
    pick = lambda n, salt: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(max(n, 1))) + 1
    drawn = spark.range(draws).select(pick(events, "i").alias("i"), pick(rows, "j").alias("j"))
    pairs = drawn.join(left, "i").join(right, "j").filter(F.col("tj") > F.col("ti"))
    won = (F.col("ri") > F.col("rj")).cast("double") + 0.5 * (F.col("ri") == F.col("rj")).cast("double")
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.avg(won), F.lit(0.5)).alias("c_index"))
