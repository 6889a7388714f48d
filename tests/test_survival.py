"""Survival estimators: hand-computed cases, brute force, parameter recovery."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from conftest import COVARIATES
from pyspark.sql import functions as F

from ebbtide.operators import boosting, cox, km, metrics, parametric

TRUTH = np.array([0.03, -0.0005, 0.2, 0.7])


def test_kaplan_meier_by_hand(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, 1), (4, 0)], "time int, event int")
    table = km.survival_table(df)
    curve = {r.t: r.surv for r in table.collect()}
    assert curve == pytest.approx({1: 0.8, 2: 0.6, 3: 0.3, 4: 0.3})
    assert km.median_survival(table).first()["median"] == 3
    assert [r.surv for r in km.survival_at(table, [0.5, 1, 2.5, 9]).orderBy("t").collect()] == pytest.approx([1, 0.8, 0.6, 0.3])


def test_curve_ends_at_zero_when_all_die(spark):
    df = spark.createDataFrame([(1, 1), (2, 1)], "time int, event int")
    assert [r.surv for r in km.survival_table(df).orderBy("t").collect()] == pytest.approx([0.5, 0.0])


def test_logrank_identical_groups(spark):
    rows = [(t, e, g) for t, e in [(1, 1), (2, 1), (2, 0), (5, 1)] for g in "ab"]
    row = km.logrank_test(spark.createDataFrame(rows, "time int, event int, g string"), "g").first()
    assert row.statistic == pytest.approx(0) and row.p_value == pytest.approx(1)


def test_logrank_forms_agree(recipe_df):
    two = km.logrank_test(recipe_df, "group").first()
    assert two.dof == 1 and two.statistic > 50 and two.p_value < 1e-10


def test_chi_square_tail_reference_points():
    assert km.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert km.chi_square_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert km.chi_square_tail(7.814727903251179, 3) == pytest.approx(0.05)
    assert km.chi_square_tail(9.487729036781154, 4) == pytest.approx(0.05)


def brute_force(t, e, r, tied):
    won = ties = pairs = 0
    for i in np.flatnonzero(e):
        outlives = (t > t[i]) | (((t == t[i]) & (e == 0)) if tied else False)
        pairs += int(outlives.sum())
        won += int((outlives & (r < r[i])).sum())
        ties += int((outlives & (r == r[i])).sum())
    return won, ties, pairs


@pytest.mark.parametrize(
    "options", [{}, {"buckets": 7}], ids=["default", "bucketed"]
)
@pytest.mark.parametrize("tied", [False, True])
@pytest.mark.parametrize("kind", ["discrete", "continuous", "hot_time"])
def test_concordance_equals_pair_count(spark, kind, tied, options):
    rng = np.random.default_rng(5)
    n = 300
    r = np.where(rng.random(n) < 0.4, 0.5, rng.normal(size=n).round(2))
    t = {
        "discrete": rng.integers(0, 20, n),
        "continuous": rng.exponential(10, n).round(3),
        "hot_time": np.where(rng.random(n) < 0.5, 9.0, rng.exponential(10, n)),
    }[kind]
    e = (rng.random(n) < 0.5).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"time": t, "event": e, "risk": r}))
    row = metrics.concordance(df, "risk", tied_times=tied, **options).first()
    assert (row.concordant, row.tied_risk, row.comparable) == brute_force(t, e, r, tied)


def test_concordance_by_group_in_one_pass(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 240), "time": rng.integers(0, 30, 240), "event": rng.integers(0, 2, 240), "risk": rng.normal(size=240).round(1)})
    pdf.loc[0, "risk"] = None
    found = {r.g: (r.concordant, r.tied_risk, r.comparable) for r in metrics.concordance(spark.createDataFrame(pdf), "risk", by=["g"]).collect()}
    for g, part in pdf.dropna().groupby("g"):
        assert found[g] == brute_force(part.time.to_numpy(), part.event.to_numpy(), part.risk.to_numpy(), False)


def test_concordance_extremes(spark):
    df = spark.createDataFrame([(float(t), 1) for t in range(1, 30)], "time double, event int")
    for expr, want in (("-time", 1.0), ("0 * time", 0.5), ("time", 0.0)):
        assert metrics.concordance_index(df.withColumn("risk", F.expr(expr)), "risk") == want


def test_sampled_concordance_is_close(recipe_df):
    scored = recipe_df.withColumn("risk", F.col("age") * 0.03 + F.col("group") * 0.7)
    exact = metrics.concordance_index(scored, "risk")
    sampled = metrics.sampled_concordance(scored, "risk", ["id"], draws=200_000).first()["c_index"]
    assert sampled == pytest.approx(exact, abs=0.01)


@pytest.mark.parametrize("strata", [[], ["g"]], ids=["whole", "strata"])
def test_cox_evaluation_of_few_times_is_one_short_job(spark, strata, monkeypatch):
    """Ties, blocks of 20 rows, late entries, a NULL stratum, covariates and events that are missing: as over time buckets."""
    monkeypatch.setattr(cox, "HELD_ROWS", 20)
    rng = np.random.default_rng(3)
    rows = [
        (None if k % 7 == 0 else "ab"[k % 2], float(rng.integers(3, 15)), float(rng.integers(0, 3)), None if k % 41 == 0 else int(rng.random() < 0.6),
         None if k % 29 == 0 else float(rng.normal()), float(rng.normal()))
        for k in range(400)
    ]
    df = spark.createDataFrame(rows, "g string, time double, start double, event int, x double, y double").repartition(3)
    sets = cox.RiskSets(df, ["x", "y"], "time", "event", strata, "start")
    beta = np.array([0.4, -0.3])
    context = spark.sparkContext
    context.setJobGroup(f"few-{len(strata)}", "one evaluation")
    found = sets.evaluate(beta)
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup(f"few-{len(strata)}")) <= 3
    sets.few = False
    for a, b in zip(found, sets.evaluate(beta), strict=True):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-9)
    monkeypatch.setattr(cox, "FEW_TIMES", 5)
    assert not cox.RiskSets(df, ["x", "y"], "time", "event", strata).few


def efron(beta, t, e, x):
    eta = x @ beta
    w, total = np.exp(eta), 0.0
    for u in np.unique(t[e == 1]):
        dead = (t == u) & (e == 1)
        risk, dying, d = w[t >= u].sum(), w[dead].sum(), dead.sum()
        total += eta[dead].sum() - sum(math.log(risk - k / d * dying) for k in range(d))
    return total


@pytest.fixture(scope="module")
def fitted(recipe_df):
    return cox.fit_cox(recipe_df, COVARIATES)


def test_cox_recovers_parameters(fitted):
    # the hazard effect is the time effect times the Weibull shape
    se = np.sqrt(np.diag(fitted.covariance))
    assert (np.abs(fitted.coefficients - 1.3 * TRUTH) < 4 * se).all()


def test_cox_start_stop_form_agrees(recipe_df, fitted):
    half = F.col("time") / 2
    none = F.lit(None).cast("double")
    first = recipe_df.withColumns({"from": none, "to": half, "died": F.lit(0)})
    second = recipe_df.withColumns({"from": half, "to": F.col("time"), "died": F.col("event").cast("int")})
    split = cox.fit_cox(first.unionByName(second), COVARIATES, "to", "died", start="from")
    assert split.coefficients == pytest.approx(fitted.coefficients)


def test_cox_with_ties_maximises_the_efron_likelihood(spark, recipe):
    days = recipe.assign(day=np.ceil(recipe.time).astype(int))
    model = cox.fit_cox(spark.createDataFrame(days), COVARIATES, "day")
    x, t, e = (days[COVARIATES] - days[COVARIATES].mean()).to_numpy(), days.day.to_numpy(), days.event.to_numpy()
    best = efron(model.coefficients, t, e, x)
    assert model.log_likelihood == pytest.approx(best)
    for j in range(4):
        for shift in (0.01, -0.01):
            moved = model.coefficients.copy()
            moved[j] *= 1 + shift
            assert efron(moved, t, e, x) < best


def test_cox_median_inverts_the_predicted_curve(recipe, recipe_df, fitted):
    base = cox.baseline_hazard(fitted).toPandas().sort_values("t")
    got = cox.predict_median(recipe_df, fitted).toPandas().sort_values("id")["median"]
    need = math.log(2) / np.exp((recipe[COVARIATES] - fitted.means).to_numpy() @ fitted.coefficients)
    index = np.searchsorted(base.h0.to_numpy(), need, "left")
    want = np.append(base.t.to_numpy(), np.nan)[index]
    assert np.array_equal(got.to_numpy(), want, equal_nan=True)


def test_efron_sums_equal_the_plain_sums():
    d = np.array([1, 2, 5, 255, 256, 257, 300, 5000, 100_000], float)
    for slack in (1.0, 1.5, 40.0):
        e = d * np.linspace(0.3, 2.0, len(d))
        want = [cox._efron_terms(np.arange(n), n, a * slack, a).sum(0) for n, a in zip(d, e, strict=True)]
        got = cox._efron_sums(d, e * slack, e)
        assert np.allclose(got, want, rtol=1e-10, atol=1e-12)


def test_stratified_predictions_use_their_own_baseline(spark, recipe):
    """Region 0 lives five times as long: its predictions must follow its own curve."""
    slow = recipe.assign(time=np.where(recipe.region == 0, recipe.time * 5, recipe.time))
    df = spark.createDataFrame(slow)
    model = cox.fit_cox(df, ["age", "balance", "group"], strata=["region"])
    t = float(np.median(slow.time))
    seen = cox.predict_median(cox.predict_survival(df, model, [t]), model).toPandas()
    assert len(seen) == len(slow)
    empirical = {}
    for region, part in slow.groupby("region"):
        curve, s = sorted(zip(part.time, part.event, strict=True)), 1.0
        for i, (time, event) in enumerate(curve):
            if time <= t and event:
                s *= 1 - 1 / (len(curve) - i)
        empirical[region] = s
    for region, part in seen.groupby("region"):
        assert abs(part[f"surv_{t:g}"].mean() - empirical[region]) < 0.1
    medians = seen.groupby("region")["median"].median()
    assert medians[0] > 3 * medians[1]
    unknown = df.limit(3).withColumn("region", F.lit(99))
    got = cox.predict_median(cox.predict_survival(unknown, model, [t]), model).collect()
    assert len(got) == 3 and all(r[f"surv_{t:g}"] is None and r["median"] is None for r in got)


def test_proportionality_test_and_strata(recipe_df, fitted):
    rows = {r.feature: r.p for r in cox.proportional_hazard_test(fitted).collect()}
    assert set(rows) == set(COVARIATES) and all(0 <= p <= 1 for p in rows.values())
    strata = cox.fit_cox(recipe_df, ["age", "balance", "group"], strata=["region"])
    assert strata.coefficients[2] == pytest.approx(fitted.coefficients[3], abs=0.15)


def test_elastic_net_path_shrinks_to_zero(recipe_df):
    path = cox.fit_elastic_net(recipe_df, COVARIATES, n_alphas=3).toPandas()
    sizes = path.groupby("alpha").coef.apply(lambda c: c.abs().sum()).sort_index(ascending=False)
    assert sizes.iloc[0] == pytest.approx(0, abs=1e-6) and sizes.is_monotonic_increasing


def test_weibull_and_exponential(spark):
    rng = np.random.default_rng(0)
    t = 5 * rng.weibull(1.7, 4000)
    c = rng.uniform(0.5, 12, 4000)
    df = spark.createDataFrame(pd.DataFrame({"time": np.minimum(t, c).clip(0.5), "event": ((t <= c) & (t > 0.5)).astype(int)}))
    row = parametric.fit_weibull(df).first()
    assert row.scale == pytest.approx(5, rel=0.05) and row.hazard == "rises"
    assert parametric.fit_exponential(df).first()["aic"] > row.aic


def test_aft_families_and_selection(spark, recipe_df):
    models = [parametric.fit_aft(recipe_df, COVARIATES, f) for f in ("weibull", "lognormal", "loglogistic")]
    weibull = models[0]
    assert 1 / weibull.sigma == pytest.approx(1.3, abs=0.2)
    assert weibull.coefficients == pytest.approx(-TRUTH, rel=0.4)
    built_in = parametric.fit_weibull_aft(recipe_df, COVARIATES)
    assert built_in.coefficients == pytest.approx(weibull.coefficients, rel=1e-3)
    assert built_in.log_likelihood == pytest.approx(weibull.log_likelihood, rel=1e-6)
    assert parametric.aic_table(spark, models).filter("best = 1").first()["family"] == "weibull"
    for model in models:
        at_median = recipe_df.limit(3).withColumn("m", model.median()).select(model.survival(F.col("m")).alias("s"))
        assert [r.s for r in at_median.collect()] == pytest.approx([0.5] * 3)


def test_ipcw_reduces_to_plain_brier_without_censoring(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"time": rng.integers(1, 90, 200), "event": 1, "s": rng.random(200)})
    df = spark.createDataFrame(pdf)
    curve = metrics.censoring_curve(df)
    weighted = metrics.ipcw_brier(df, [30, 60], ["s", "s"], curve).first()
    plain = metrics.brier(df, [30, 60], ["s", "s"]).first()
    assert (weighted.brier_0, weighted.brier_1) == pytest.approx((plain.brier_30, plain.brier_60))
    auc = {r.t: r.auc for r in metrics.time_dependent_auc(df.withColumn("risk", -F.col("time")), "risk", [30, 60], curve).collect()}
    assert auc == {30.0: 1.0, 60.0: 1.0}


def test_evaluation_times_lie_inside(recipe_df):
    low, high = recipe_df.filter("id % 2 = 0"), recipe_df.filter("id % 2 = 1")
    times = metrics.evaluation_times(low, high, 5)
    assert len(times) == 5 and times == sorted(times)


def test_person_periods_reproduce_kaplan_meier_on_whole_periods(spark):
    df = spark.createDataFrame([(1, 5, 1), (2, 15, 1), (3, 30, 0), (4, 25, 0)], "id int, time int, event int")
    rows = boosting.person_periods(df, [0, 10, 20]).groupBy("period").agg(F.count("*").alias("n"), F.sum("died").alias("d"))
    # the censored rows count in the periods they lived through completely
    assert {r.period: (r.n, r.d) for r in rows.collect()} == {0: (4, 1), 1: (3, 1)}


def test_boosted_cox_ranks(recipe_df):
    model = boosting.fit_boosted_cox(recipe_df, COVARIATES, ["id"], rounds=5)
    assert metrics.concordance_index(model.predict(recipe_df, "risk"), "risk") > 0.62


def test_hazard_forest_and_boosted_aft_rank(recipe_df):
    forest = boosting.fit_hazard_model(recipe_df, COVARIATES, [0, 2, 4, 6, 8, 10], numTrees=10)
    joined = recipe_df.join(forest.risk(recipe_df), "id").join(forest.survival(recipe_df, [0, 2, 5]), "id")
    assert metrics.concordance_index(joined, "risk") > 0.65
    assert joined.filter("surv_0 < surv_2 or surv_2 < surv_5").count() == 0
    aft = boosting.fit_boosted_aft(recipe_df, COVARIATES, ["id"], rounds=3)
    assert metrics.concordance_index(aft.predict(recipe_df, "f").withColumn("risk", -F.col("f")), "risk") > 0.62
