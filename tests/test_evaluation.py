from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import COVARIATES
from pyspark.sql import functions as F

from ebbtide.operators import cox, km, metrics, models, parametric

TIMES = [2.0, 4.0, 6.0]


def _brute_concordance(time, event, risk, group=None):
    won = tied = pairs = 0
    for i in np.flatnonzero(event):
        later = (time > time[i]) | ((time == time[i]) & (event == 0))
        if group is not None:
            later &= group == group[i]
        won += int((risk[later] < risk[i]).sum())
        tied += int((risk[later] == risk[i]).sum())
        pairs += int(later.sum())
    return won, tied, pairs


def test_evaluation_of_many_models_equals_that_of_each(recipe_df):
    scored = recipe_df.withColumn("a", F.round("age", 0)).withColumn("b", F.when(F.col("id") % 50 > 0, -F.col("balance")))
    for t in TIMES:
        scored = scored.withColumn(f"s{t:g}", F.exp(-F.col("age") * t / 500)).withColumn(f"u{t:g}", F.lit(0.5))
    train, test = scored.filter("id % 2 = 0"), scored.filter("id % 2 = 1")
    models = {"age": ("a", ["s2", "s4", "s6"]), "balance": ("b", ["u2", "u4", "u6"])}
    rows = {r.model: r for r in metrics.survival_evaluation(test, train, models, TIMES).collect()}
    curve = metrics.censoring_curve(train)
    assert set(rows) == set(models)
    for name, (risk, survival) in models.items():
        assert rows[name].c_index == pytest.approx(metrics.concordance_index(test, risk))
        assert rows[name].ibs == pytest.approx(metrics.ipcw_brier(test, TIMES, survival, curve).first()["ibs"])
        aucs = metrics.time_dependent_auc(test.filter(F.col(risk).isNotNull()), risk, TIMES, curve)
        assert rows[name].mean_auc == pytest.approx(metrics.mean_time_auc(aucs, km.survival_table(test), TIMES))


def test_evaluation_of_an_empty_table_has_a_row_per_model(recipe_df):
    scored = recipe_df.select("time", "event", F.col("age").alias("a"), F.lit(0.5).alias("s"))
    row = metrics.survival_evaluation(scored.limit(0), scored, {"m": ("a", ["s"] * 3)}, TIMES).first()
    assert (row.model, row.c_index, row.ibs, row.mean_auc) == ("m", 0.5, None, None)


def test_cox_concordance_counts_pairs_of_one_stratum(recipe, recipe_df):
    rounded = recipe_df.withColumn("time", F.ceil("time"))
    model = cox.fit_cox(rounded, COVARIATES[:2], strata=["region"])
    risk = sum((recipe[c] - m) * b for c, m, b in zip(model.columns, model.means, model.coefficients, strict=True))
    expected = _brute_concordance(np.ceil(recipe.time.to_numpy()), recipe.event.to_numpy(), risk.to_numpy(), recipe.region.to_numpy())
    row = model.concordance(rounded).first()
    assert (row.concordant, row.tied_risk, row.comparable) == expected
    assert row.c_index == pytest.approx((expected[0] + expected[1] / 2) / expected[2])


def _log_likelihood(recipe, columns, theta):
    x = np.column_stack([np.ones(len(recipe)), recipe[columns].to_numpy(float)])
    y, e, sigma = np.log(np.maximum(recipe.time, 0.5)), recipe.event, math.exp(theta[-1])
    z = (y - x @ theta[:-1]) / sigma
    return float((e * (z - theta[-1] - y) - np.exp(z)).sum())


def test_aft_standard_errors_equal_a_numeric_hessian(spark, recipe, recipe_df):
    columns = ["age", "group"]
    model = parametric.fit_aft(recipe_df, columns, "weibull")
    theta = np.array([model.intercept, *model.coefficients, math.log(model.sigma)])
    steps = np.array([1e-3, 1e-4, 1e-3, 1e-3])
    hessian = np.zeros((4, 4))
    for i in range(4):
        for j in range(4):
            values = [
                a * b * _log_likelihood(recipe, columns, theta + a * steps * (np.arange(4) == i) + b * steps * (np.arange(4) == j))
                for a in (-1, 1)
                for b in (-1, 1)
            ]
            hessian[i, j] = sum(values) / (4 * steps[i] * steps[j])
    expected = np.sqrt(np.diag(np.linalg.inv(-hessian)))[1:3]
    rows = {r.feature: r for r in model.summary(spark).collect()}
    assert [rows[c].se for c in columns] == pytest.approx(expected, rel=1e-3)
    assert rows["group"].lower < rows["group"].time_ratio < rows["group"].upper < 1 and rows["group"].p < 1e-4
    built_in = parametric.fit_weibull_aft(recipe_df, columns)
    assert [r.se for r in built_in.summary(spark).collect()] == pytest.approx(expected, rel=1e-2)


def test_aic_table_with_concordance(spark, recipe, recipe_df):
    models = [parametric.fit_aft(recipe_df, COVARIATES, f) for f in ("weibull", "lognormal")]
    rows = {r.family: r for r in parametric.aic_table(spark, models, recipe_df).collect()}
    for model in models:
        location = recipe[COVARIATES].to_numpy(float) @ np.array(model.coefficients)
        won, tied, pairs = _brute_concordance(recipe.time.to_numpy(), recipe.event.to_numpy(), -location)
        assert rows[model.family].c_index == pytest.approx((won + tied / 2) / pairs, abs=1e-6)


def _brute_areas(score, y):
    won = sum((score[y == 1][:, None] > score[y == 0]).sum(1)) + (score[y == 1][:, None] == score[y == 0]).sum() / 2
    levels = np.unique(score)[::-1]
    ap = sum(((score == v) & (y == 1)).sum() / y.sum() * (y[score >= v].sum() / (score >= v).sum()) for v in levels)
    return won / (y.sum() * (len(y) - y.sum())), ap


def test_areas_of_many_models_equal_pair_counts(recipe, recipe_df):
    y = recipe.event.to_numpy()
    df = recipe_df.withColumn("decade", F.floor(F.col("age") / 10))
    rows = {r.model: r for r in metrics.model_table(df, ["age", "decade"], "event", ["id"], {"age": 2.0}).collect()}
    assert rows["age"].fit_min == 2.0 and rows["decade"].fit_min == 0.0
    for name, score in (("age", recipe.age.to_numpy()), ("decade", np.floor(recipe.age.to_numpy() / 10))):
        expected = _brute_areas(score, y)
        assert (rows[name].auc, rows[name].ap) == pytest.approx(expected)
        one = metrics.classifier_metrics(df, name, "event", ["id"]).first()
        assert (one.auc, one.ap) == pytest.approx(expected)
        assert (one.p_at_10, one.r_at_10) == pytest.approx((rows[name].p_at_10, rows[name].r_at_10))


def test_areas_without_a_class_are_null(recipe_df):
    row = metrics.classifier_metrics(recipe_df.filter("event = 1"), "age", "event", ["id"]).first()
    assert row.auc is None and row.ap == pytest.approx(1.0)


def test_compared_models_get_an_ensemble_row(recipe_df):
    df = recipe_df.withColumn("label", F.col("event")).withColumn("fold", (F.col("id") % 2).cast("int"))
    fits = {"few": models.logistic_classifier(["age"]), "all": models.logistic_classifier(COVARIATES)}
    scored, table = models.compare_models(df, fits, 2, "label", ["id"])
    assert scored.filter(F.abs(F.col("ensemble") - (F.col("few") + F.col("all")) / 2) > 1e-12).count() == 0
    rows = {r.model: r for r in table.collect()}
    assert set(rows) == {"few", "all", "ensemble"}
    assert rows["ensemble"].fit_min == pytest.approx(rows["few"].fit_min + rows["all"].fit_min)
    with pytest.raises(ValueError):
        models.compare_models(df, {"ensemble": fits["few"]}, 2, "label", ["id"])
