"""Queries that fit models: Cox, parametric, hazard trees, boosting, classifiers, blending, importance.

Fits are compared by invariants in the tests; where the result follows from the data alone, SQL is given.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.catalog import sql as S
from ebbtide.catalog import targets as base
from ebbtide.catalog.registry import query
from ebbtide.operators import activity, audit, blend, boosting, cox, forest, histboost, km, metrics, models, parametric, shapley, splits, tuning
from ebbtide.operators.assemble import attach_labels
from ebbtide.operators.histboost import Target
from ebbtide.operators.quality import apply_scaler, fit_scaler, log_copies
from ebbtide.plans import churn
from ebbtide.plans import survival as plan
from ebbtide.session import materialize
from ebbtide.sources import roles
from ebbtide.sources.tables import table
from ebbtide.window import ObservationWindow

HISTORY_WINDOW = ObservationWindow(
    start=roles.LEDGER_BASE,
    cutoff=roles.LEDGER_END,
    spans={"1y": 365, "90d": 90},
    full="all",
    recent="1y",
    short="90d",
    silence=180,
    gap_lengths=(90, 180, 365),
    missing_days=2100,
    recurrence_unit="year",
)
FEATURES = [
    "recency_days", "cnt_all", "cnt_1y", "cnt_90d", "gap_mean", "gap_max", "gap_std", "amt_mean_all", "amt_max_all", "gap_z",
]
COVARIATES = ["recency_days", "cnt_all", "cnt_1y", "gap_mean", "amt_mean_all"]


def frame(spark, folder):
    """Order history before the cutoff as features, joined to the time to the next order."""
    orders = roles.order_activity(spark, folder).filter(F.col("d") < F.lit(roles.LEDGER_END))
    daily = activity.daily_activity(orders)
    counts = activity.window_counts(daily, HISTORY_WINDOW)
    profile = counts.join(activity.gap_stats(daily, HISTORY_WINDOW), "id", "left")
    amounts = orders.groupBy(F.col("src").alias("id")).agg(
        F.avg("amt").alias("amt_mean_all"), F.max("amt").alias("amt_max_all")
    )
    wide = profile.join(amounts, "id").select(
        "id",
        HISTORY_WINDOW.days_before_cutoff(F.col("last_d")).cast("double").alias("recency_days"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("cnt_all", "cnt_1y", "cnt_90d", "gap_std")],
        *[F.coalesce(F.col(c).cast("double"), F.lit(2100.0)).alias(c) for c in ("gap_mean", "gap_max")],
        "amt_mean_all",
        "amt_max_all",
    )
    wide = wide.withColumn("gap_z", (F.col("recency_days") - F.col("gap_mean")) / (F.col("gap_std") + 1))
    return materialize(attach_labels(base.outcomes(spark, folder), wide))


def folded(spark, folder, k=5):
    labelled = frame(spark, folder).withColumn("label", F.col("event"))
    return materialize(splits.folds(labelled, ["id"], k, ["event"]))


def _standard(df, columns):
    return apply_scaler(df, fit_scaler(df, columns))


# ---- Cox family ---------------------------------------------------------------------------------------------------

SUMMARY = "feature:s coef:f hazard_ratio:f se:f lower:f upper:f z:f p:f"


@query("cox_fit", SUMMARY)
def _(spark, folder):
    return cox.fit_cox(frame(spark, folder), COVARIATES).summary(spark)


@query("hazard_ratios", SUMMARY)
def _(spark, folder):
    standard = _standard(frame(spark, folder), COVARIATES)
    return cox.fit_cox(standard, COVARIATES, penalizer=0.01).summary(spark).orderBy(F.col("hazard_ratio").desc())


@query("cox_risk", "id:i hazard:f median:f surv_30:f surv_60:f surv_90:f")
def _(spark, folder):
    df = frame(spark, folder)
    model = cox.fit_cox(df, COVARIATES)
    scored = cox.predict_survival(cox.predict_median(df, model), model, [30, 60, 90])
    return scored.withColumn("hazard", model.partial_hazard())


@query("cox_baseline", "t:f h0:f")
def _(spark, folder):
    return cox.baseline_hazard(cox.fit_cox(frame(spark, folder), COVARIATES))


@query("cox_proportionality", "feature:s statistic:f p:f")
def _(spark, folder):
    return cox.proportional_hazard_test(cox.fit_cox(frame(spark, folder), COVARIATES))


def _with_segment(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    return frame(spark, folder).join(customers, "id")


@query("cox_strata", SUMMARY)
def _(spark, folder):
    return cox.fit_cox(_with_segment(spark, folder), COVARIATES, strata=["c_mktsegment"]).summary(spark)


@query("cox_concordance", "concordant:i tied_risk:i comparable:i c_index:f")
def _(spark, folder):
    df = materialize(_with_segment(spark, folder))
    return cox.fit_cox(df, COVARIATES, strata=["c_mktsegment"]).concordance(df)


@query("cox_start_stop", SUMMARY)
def _(spark, folder):
    """Follow-up split at day 30: a covariate may take another value in the second part."""
    df = frame(spark, folder)
    late = F.col("time") > 30
    first = df.withColumns(
        {
            "from": F.lit(None).cast("double"),
            "to": F.least(F.col("time"), F.lit(30)).cast("double"),
            "died": F.when(late, 0).otherwise(F.col("event")),
            "recency_late": F.lit(0.0),
        }
    )
    second = df.filter(late).withColumns(
        {"from": F.lit(30.0), "to": F.col("time").cast("double"), "died": F.col("event"), "recency_late": F.col("recency_days")}
    )
    columns = ["recency_days", "recency_late", "cnt_all"]
    return cox.fit_cox(first.unionByName(second), columns, "to", "died", start="from").summary(spark)


@query("cox_elastic_net", "alpha:f feature:s coef:f")
def _(spark, folder):
    return cox.fit_elastic_net(frame(spark, folder), COVARIATES)


# ---- parametric -------------------------------------------------------------------------------------------------------


@query(
    "exponential_fit",
    "scale:f log_likelihood:f aic:f",
    S.with_(
        S.OUTCOMES,
        "x AS (SELECT sum(greatest(time, 0.5)) AS t, CAST(sum(event) AS DOUBLE) AS d FROM outcomes)",
        select="""SELECT t / d AS scale, -d * ln(t / d) - d AS log_likelihood, 2 + 2 * (d * ln(t / d) + d) AS aic FROM x""",
    ),
)
def _(spark, folder):
    return parametric.fit_exponential(base.outcomes(spark, folder))


@query("weibull_fit", "shape:f scale:f log_likelihood:f4 aic:f4 hazard:s")
def _(spark, folder):
    return parametric.fit_weibull(base.outcomes(spark, folder))


@query("weibull_aft", "feature:s coef:f time_ratio:f")
def _(spark, folder):
    return parametric.fit_weibull_aft(_standard(frame(spark, folder), COVARIATES), COVARIATES).time_ratios(spark)


@query("aft_summary", "feature:s coef:f time_ratio:f se:f lower:f upper:f z:f4 p:f")
def _(spark, folder):
    return parametric.fit_aft(frame(spark, folder), COVARIATES, "weibull").summary(spark)


@query("aft_aic_concordance", "family:s aic:f4 best:i c_index:f")
def _(spark, folder):
    df = frame(spark, folder)
    fits = [parametric.fit_aft(df, COVARIATES, f) for f in ("weibull", "lognormal", "loglogistic")]
    return parametric.aic_table(spark, fits, df)


@query("lognormal_aft", "feature:s coef:f time_ratio:f")
def _(spark, folder):
    return parametric.fit_aft(frame(spark, folder), COVARIATES, "lognormal").time_ratios(spark)


@query("loglogistic_aft", "feature:s coef:f time_ratio:f")
def _(spark, folder):
    return parametric.fit_aft(frame(spark, folder), COVARIATES, "loglogistic").time_ratios(spark)


@query("aft_aic_table", "family:s log_likelihood:f4 aic:f4 best:i")
def _(spark, folder):
    df = frame(spark, folder)
    return parametric.aic_table(spark, [parametric.fit_aft(df, COVARIATES, f) for f in ("weibull", "lognormal", "loglogistic")])


@query("parametric_curves", "id:i t:f surv:f hazard:f8")
def _(spark, folder):
    df = frame(spark, folder)
    return parametric.parametric_curves(df, parametric.fit_aft(df, COVARIATES, "weibull"), [30, 60, 90, 180])


@query("aft_median_time", "id:i median:f4")
def _(spark, folder):
    df = frame(spark, folder)
    return df.withColumn("median", parametric.fit_aft(df, COVARIATES, "loglogistic").median())


# ---- person-period and boosted survival ---------------------------------------------------------------------------------

CUTS = [0, 15, 30, 45, 60, 75]


@query(
    "person_periods",
    "id:i period:i died:i",
    S.with_(
        S.OUTCOMES,
        """x AS (SELECT id, event, CAST(time >= 15 AS INT) + CAST(time >= 30 AS INT) + CAST(time >= 45 AS INT)
             + CAST(time >= 60 AS INT) + CAST(time >= 75 AS INT) AS last FROM outcomes)""",
        select="""SELECT id, CAST(p AS BIGINT) AS period, CASE WHEN event = 1 AND p = last THEN 1 ELSE 0 END AS died
                  FROM x, range(6) AS r(p) WHERE p <= last - (1 - event)""",
    ),
)
def _(spark, folder):
    return boosting.person_periods(base.outcomes(spark, folder), CUTS)


def _hazard(spark, folder, kind, **params):
    df = frame(spark, folder)
    model = boosting.fit_hazard_model(df, FEATURES, CUTS, kind, **params)
    return model.risk(df).join(model.survival(df, [1, 3, 5]), "id")


@query("hazard_forest", "id:i risk:f surv_1:f surv_3:f surv_5:f")
def _(spark, folder):
    return _hazard(spark, folder, "forest")


@query("survival_forest", "id:i risk:f surv_30:f surv_60:f surv_90:f")
def _(spark, folder):
    df = frame(spark, folder)
    return forest.fit_forest(df, FEATURES, ["id"]).predict(df, [30, 60, 90])


@query("hazard_gbt", "id:i risk:f surv_1:f surv_3:f surv_5:f")
def _(spark, folder):
    return _hazard(spark, folder, "gbt")


@query("boosted_cox", "id:i risk:f")
def _(spark, folder):
    df = frame(spark, folder)
    return boosting.fit_boosted_cox(df, FEATURES, ["id"]).predict(df, "risk")


@query("boosted_aft", "id:i risk:f")
def _(spark, folder):
    df = frame(spark, folder)
    fitted = boosting.fit_boosted_aft(df, FEATURES, ["id"]).predict(df, "log_time")
    return fitted.withColumn("risk", -F.col("log_time"))


# ---- classifiers and protocol ----------------------------------------------------------------------------------------------


@query("gbt_oof", "id:i fold:i p:f")
def _(spark, folder):
    return _boosted_folds(spark, folder, Target("p", label="label", rounds=20))


@query("gbt_oof_early_stopping", "id:i fold:i p:f")
def _(spark, folder):
    return _boosted_folds(spark, folder, Target("p", label="label", rounds=20, stopping=True))


def _boosted_folds(spark, folder, target, k=5):
    df = folded(spark, folder).withColumn("is_validation", models.stopping_slice(["id"]))
    return histboost.fit(df, FEATURES, [target], ["id"], "fold", k, validation="is_validation").out_of_fold(df)


@query("logit_oof", "id:i fold:i p:f")
def _(spark, folder):
    logged = log_copies(folded(spark, folder), ["amt_mean_all", "amt_max_all", "gap_mean"])
    columns = [f"{c}_log" if c in ("amt_mean_all", "amt_max_all", "gap_mean") else c for c in FEATURES]
    return models.out_of_fold(logged, None, models.logistic_classifier(columns), 5, "p")[0]


@query("test_scores_fold_mean", "id:i p:f")
def _(spark, folder):
    df = folded(spark, folder)
    train, test = df.filter(F.col("id") % 4 != 0), df.filter(F.col("id") % 4 == 0).drop("fold")
    return models.out_of_fold(train, test, models.logistic_classifier(FEATURES), 5, "p")[1]


@query("horizon_models", "id:i s30:f s60:f s90:f")
def _(spark, folder):
    make = lambda label: models.gbt_classifier(FEATURES, label)
    return models.horizon_models(folded(spark, folder), None, make, 5)[0]


@query("model_table", "model:s auc:f ap:f p_at_10:f r_at_10:f fit_min:f")
def _(spark, folder):
    fits = {"gbt": models.gbt_classifier(FEATURES), "logistic": models.logistic_classifier(FEATURES)}
    return models.compare_models(folded(spark, folder), fits, 5, "label", ["id"])[1]


@query("imbalance_table", "variant:s auc:f ap:f p_at_10:f r_at_10:f")
def _(spark, folder):
    df = frame(spark, folder).withColumn("label", F.col("event"))
    return models.imbalance_table(df, FEATURES, "label", ["id"])


@query("smote", "label:i recency_days:f cnt_all:f amt_mean_all:f")
def _(spark, folder):
    df = frame(spark, folder).withColumn("label", F.col("event"))
    return models.smote(df, FEATURES, "label", ["id"])


@query("adversarial_validation", "auc:f shift:i")
def _(spark, folder):
    df = frame(spark, folder)
    return models.adversarial_validation(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), FEATURES, ["id"])


@query("tuning_trials", "trial:i stepSize:f maxDepth:f minInstancesPerNode:f subsamplingRate:f featureShare:f auc:f best_so_far:f")
def _(spark, folder):
    return tuning.random_search(frame(spark, folder), FEATURES, "event", ["id"])


def _gbt(df, **params):
    return models.gbt_classifier(FEATURES, "event", **params)(df)


@query("gain_importance", "feature:s importance:f")
def _(spark, folder):
    df = frame(spark, folder)
    return models.gain_importance(df, _gbt(df), FEATURES)


@query("dominance_check", "feature:s share:f suspicious:i")
def _(spark, folder):
    df = frame(spark, folder)
    return audit.dominance_check(models.gain_importance(df, _gbt(df), FEATURES))


@query("occlusion_importance", "feature:s importance:f")
def _(spark, folder):
    df = frame(spark, folder)
    return models.occlusion_importance(df, _gbt(df), FEATURES)


@query("shapley_importance", "feature:s importance:f")
def _(spark, folder):
    df = frame(spark, folder)
    model = histboost.fit(df, FEATURES, [Target("p", label="event", rounds=20)], ["id"])
    return shapley.shapley_importance(df, model)


@query("permutation_importance", "feature:s importance:f std:f")
def _(spark, folder):
    df = frame(spark, folder)
    model = cox.fit_cox(df, COVARIATES)
    return models.permutation_importance(df, lambda x: x.withColumn("risk", model.partial_hazard()), COVARIATES, ["id"])


@query("cv_c_index", "fold:i c_index:f mean:f std:f")
def _(spark, folder):
    df = folded(spark, folder)

    def fit(train):
        model = cox.fit_cox(train, COVARIATES, penalizer=0.01)
        return lambda x: x.withColumn("risk", model.partial_hazard())

    return models.cross_validated_concordance(df, fit, 5)


# ---- blending and calibration --------------------------------------------------------------------------------------------------


SIGNALS = ["recency", "risk", "weekly", "mixed"]


def _sweep_sql() -> str:
    place = "CAST(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0 AS DOUBLE)"
    named = "sig AS (SELECT *, 1 - s90 AS risk90, recency % 7 AS weekly, (id * 37) % 101 - recency AS mixed FROM scores)"
    columns = ", ".join(f"{place.format(c)} AS r_{c}" for c in ["risk90", *SIGNALS])
    ranks = f"r AS (SELECT *, {columns} FROM sig)"
    arms = " UNION ALL ".join(
        f"SELECT time, event, '{c}' AS signal, w, w * r_risk90 + (1 - w) * r_{c} AS x FROM r, wt" for c in SIGNALS
    )
    weights = "wt AS (SELECT CAST(unnest([" + ", ".join(map(str, blend.SWEEP_WEIGHTS)) + "]) AS DOUBLE) AS w)"
    blends = f"blends AS (SELECT time, event, '' AS signal, CAST(1 AS DOUBLE) AS w, risk90 AS x FROM sig UNION ALL {arms})"
    select = """SELECT a.signal AS signal, a.w AS weight,
        avg(CASE WHEN a.x > b.x THEN 1.0 WHEN a.x = b.x THEN 0.5 ELSE 0.0 END) AS c_index
        FROM blends a JOIN blends b ON b.signal = a.signal AND b.w = a.w AND b.time > a.time WHERE a.event = 1 GROUP BY a.signal, a.w"""
    return S.with_(S.OUTCOMES, base.HISTORY, base.PROBABILITIES, named, ranks, weights, blends, select=select)


@query("blend_sweep", "signal:s weight:f c_index:f", _sweep_sql())
def _(spark, folder):
    scored = base.survival_scores(spark, folder).withColumns(
        {
            "risk90": 1 - F.col("s90"),
            "weekly": F.col("recency") % 7,
            "mixed": (F.col("id") * 37) % 101 - F.col("recency"),
        }
    )
    return blend.blend_sweep(scored, "risk90", SIGNALS, ["id"])


TWO = """two AS (SELECT l.doc_id AS id, l.quality AS y, CAST(n_chars AS DOUBLE) AS a, CAST(length(source) * 1000 + l.doc_id % 977 AS DOUBLE) AS b,
  CAST(-(l.doc_id % 311) AS DOUBLE) AS c FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
rk AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,
  rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb,
  rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS rc FROM two)"""


def _three_scores(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    return (
        table(spark, folder, "labels")
        .join(docs, "doc_id")
        .select(
            F.col("doc_id").alias("id"),
            F.col("quality").alias("y"),
            F.col("n_chars").cast("double").alias("a"),
            (F.length("source") * 1000 + F.col("doc_id") % 977).cast("double").alias("b"),
            (-(F.col("doc_id") % 311)).cast("double").alias("c"),
        )
    )


def _ensemble_sql(weights: str, blended: str, select: str) -> str:
    return S.with_(
        TWO,
        weights,
        f"bl AS (SELECT wt.*, y, round({blended}, 9) AS s FROM rk CROSS JOIN wt)",
        "bh AS (SELECT k, s, sum(y) AS pos, sum(1 - y) AS neg FROM bl GROUP BY k, s)",
        "bc AS (SELECT k, pos, neg, sum(neg) OVER (PARTITION BY k ORDER BY s) - neg / 2.0 AS below FROM bh)",
        "ba AS (SELECT k, sum(pos * below) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc FROM bc GROUP BY k)",
        select=select,
    )


@query(
    "blend_weight_search",
    "weight:f auc:f",
    _ensemble_sql(
        "wt AS (SELECT k, k / 20.0 AS w FROM range(21) AS t(k))",
        "k * ra + (20 - k) * rb",
        "SELECT wt.w AS weight, auc FROM ba JOIN wt USING (k)",
    ),
)
def _(spark, folder):
    return blend.blend_weight_search(_three_scores(spark, folder), "a", "b", "y", ["id"])


@query(
    "rank_ensemble",
    "w0:f w1:f w2:f auc:f",
    _ensemble_sql(
        """wt AS (SELECT i * 100 + j AS k, i / 20.0 AS w0, j / 20.0 AS w1, (20 - i - j) / 20.0 AS w2
             FROM range(21) AS p(i), range(21) AS q(j) WHERE i + j <= 20)""",
        "20 * (w0 * ra + w1 * rb + w2 * rc)",
        "SELECT w0, w1, w2, auc FROM ba JOIN wt USING (k)",
    ),
)
def _(spark, folder):
    return blend.rank_ensemble(_three_scores(spark, folder), ["a", "b", "c"], "y", ["id"])


BANDS = """hid AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey % 7 - 1 END AS hidden, o_totalprice AS b FROM orders),
  ru AS (SELECT id, 'B' AS band, 0.62 + 0.37 * (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0) / count(*) OVER () AS score
    FROM hid WHERE hidden IS NULL),
  rc AS (SELECT id, round(0.8 * (rank() OVER (ORDER BY -hidden) + (count(*) OVER (PARTITION BY hidden) - 1) / 2.0)
    + (1 - 0.8) * (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0), 9) AS m FROM hid WHERE hidden > 0),
  rd AS (SELECT id, 'C' AS band, 0.60 * (rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0) / count(*) OVER () AS score FROM rc)"""


@query(
    "banded_score",
    "id:i band:s score:f",
    S.with_(
        BANDS,
        select="""SELECT id, 'A' AS band, 1.0 AS score FROM hid WHERE hidden = 0 UNION ALL SELECT id, band, score FROM ru
          UNION ALL SELECT id, band, score FROM rd UNION ALL SELECT id, 'D', 0.0 FROM hid WHERE hidden < 0""",
    ),
)
def _(spark, folder):
    hidden = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey") % 7 - 1)
    df = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), hidden.alias("hidden"), F.col("o_totalprice").alias("b"))
    return blend.banded_score(df, "hidden", "b", ["id"])


def _isotonic_sql() -> str:
    """At each distinct score: the largest over all starts at or before it of the smallest mean up to an end at or after it."""
    parts = []
    for h in (30, 60, 90):
        parts += [
            f"p{h} AS (SELECT s{h} AS s, row_number() OVER (ORDER BY s{h}) AS k, sum(CAST(time > {h} AS INT)) AS y, count(*) AS n FROM scores GROUP BY s{h})",
            f"c{h} AS (SELECT s, k, sum(y) OVER (ORDER BY k) AS cy, sum(n) OVER (ORDER BY k) AS cn FROM p{h})",
            f"""m{h} AS (SELECT a.k AS a, b.k AS b, (b.cy - coalesce(z.cy, 0)) / CAST(b.cn - coalesce(z.cn, 0) AS DOUBLE) AS mean
                FROM c{h} a JOIN c{h} b ON b.k >= a.k LEFT JOIN c{h} z ON z.k = a.k - 1)""",
            f"""i{h} AS (SELECT s, max(low) AS g FROM (SELECT c.s AS s, m.a, min(m.mean) AS low FROM c{h} c
                JOIN m{h} m ON m.a <= c.k AND m.b >= c.k GROUP BY c.s, m.a) GROUP BY s)""",
        ]
    select = """SELECT id, i30.g AS s30, least(i30.g, i60.g) AS s60, least(i30.g, i60.g, i90.g) AS s90
        FROM scores JOIN i30 ON i30.s = s30 JOIN i60 ON i60.s = s60 JOIN i90 ON i90.s = s90"""
    return S.with_(S.OUTCOMES, base.HISTORY, base.PROBABILITIES, *parts, select=select)


@query("isotonic_calibration", "id:i s30:f s60:f s90:f", _isotonic_sql())
def _(spark, folder):
    scored = base.survival_scores(spark, folder)
    return blend.calibrate(scored, scored, ["s30", "s60", "s90"], (30, 60, 90))


@query("monotone_second_stage", "id:i p:f score:f")
def _(spark, folder):
    df = frame(spark, folder)
    model = models.logistic_classifier(FEATURES, "event")(df)
    return blend.monotone_second_stage(models.score(df, model, "p"), "cnt_all", "p", "event", "score")


@query("constrained_second_stage", "id:i fold:i score:f")
def _(spark, folder):
    df = folded(spark, folder).withColumn("_stop", models.stopping_slice(["id"]))
    behaviour = [f for f in FEATURES if f != "cnt_all"]
    return blend.constrained_second_stage(df, None, behaviour, "cnt_all", "label", ["id"], "score", validation="_stop")[0]


@query("survival_plan", "ACCOUNT_ID:i RISK_SCORE:f SURV_PROB_30D:f SURV_PROB_60D:f SURV_PROB_90D:f")
def _(spark, folder):
    df = frame(spark, folder)
    train, test = df.filter(F.col("id") % 4 != 0), df.filter(F.col("id") % 4 == 0)
    return plan.run(train, test, FEATURES).submission


def _churn(spark, folder, blocks=None, **options):
    df = frame(spark, folder).withColumn("label", F.col("event")).drop("time", "event")
    train, test = df.filter(F.col("id") % 4 != 0), df.filter(F.col("id") % 4 == 0).drop("label")
    return churn.run(train, test, FEATURES, blocks=blocks, logged=["amt_mean_all", "gap_mean"], **options)


@query("churn_plan", "ACCOUNT_ID:i CHURN_PROB:f")
def _(spark, folder):
    return _churn(spark, folder).submission


@query("churn_plan_banded_lift", "decile:i customers:i churners:i churn_rate:f lift:f cum_recall:f")
def _(spark, folder):
    """The bands need id blocks; order keys per customer stand in for them, though they are not contiguous."""
    blocks = audit.id_blocks(table(spark, folder, "orders"), "o_custkey", "o_orderkey")
    return _churn(spark, folder, blocks, trust_blocks=True).lift


@query("mean_time_auc", "mean_auc:f n_times:i")
def _(spark, folder):
    scored = base.survival_scores(spark, folder, base.mixed_outcomes)
    train, test = scored.filter("id % 2 = 0"), scored.filter("id % 2 = 1")
    times = metrics.evaluation_times(train, test, 5)
    aucs = metrics.time_dependent_auc(test, "risk", times, metrics.censoring_curve(train))
    mean = metrics.mean_time_auc(aucs, km.survival_table(test), times)
    return test.agg(F.lit(mean).alias("mean_auc"), F.lit(len(times)).alias("n_times"))
