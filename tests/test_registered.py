"""Registered fits run with the defaults of their operators; the operators are replaced, nothing is fitted."""

from __future__ import annotations

import inspect
from unittest.mock import MagicMock

import pytest

from ebbtide.catalog import REGISTRY, modelling


class Called(Exception):
    pass


def settings_of(monkeypatch, spark, name, owner, operator):
    """The bound arguments with which the query calls the operator."""
    signature = inspect.signature(getattr(owner, operator))

    def record(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Called(bound.arguments)

    monkeypatch.setattr(modelling, "frame", MagicMock())
    monkeypatch.setattr(modelling, "folded", folded := MagicMock())
    monkeypatch.setattr(modelling, "table", MagicMock())
    monkeypatch.setattr(modelling.audit, "id_blocks", MagicMock())
    monkeypatch.setattr(owner, operator, record)
    with pytest.raises(Called) as called:
        REGISTRY[name].build(spark, "")
    return called.value.args[0], folded


@pytest.mark.parametrize(
    "name, owner, expected",
    [
        ("survival_plan", modelling.plan, {"folds": 5, "trees": 20, "rounds": 50}),
        ("churn_plan", modelling.churn, {"folds": 5, "trees": 20}),
        ("churn_plan_banded_lift", modelling.churn, {"folds": 5, "trees": 20}),
    ],
)
def test_plans_run_whole(monkeypatch, spark, name, owner, expected):
    found, _ = settings_of(monkeypatch, spark, name, owner, "run")
    assert {k: found[k] for k in expected} == expected


@pytest.mark.parametrize(
    "name, owner, operator, expected",
    [
        ("cox_elastic_net", modelling.cox, "fit_elastic_net", {"n_alphas": 5}),
        ("boosted_cox", modelling.boosting, "fit_boosted_cox", {"rounds": 50}),
        ("boosted_aft", modelling.boosting, "fit_boosted_aft", {"rounds": 50}),
        ("tuning_trials", modelling.tuning, "random_search", {"trials": 8, "rounds": 20}),
        ("hazard_gbt", modelling.boosting, "fit_hazard_model", {"params": {}}),
        ("gbt_oof", modelling.histboost, "fit", {"targets": [modelling.Target("p", label="label", rounds=20)], "folds": 5}),
        ("gbt_oof_early_stopping", modelling.histboost, "fit", {"targets": [modelling.Target("p", label="label", rounds=20, stopping=True)], "folds": 5}),
        ("model_table", modelling.models, "gbt_classifier", {"params": {}}),
        ("model_table", modelling.models, "compare_models", {"k": 5}),
        ("imbalance_table", modelling.models, "imbalance_table", {"params": {}}),
        ("adversarial_validation", modelling.models, "adversarial_validation", {"params": {}}),
    ],
)
def test_fits_run_whole(monkeypatch, spark, name, owner, operator, expected):
    found, folded = settings_of(monkeypatch, spark, name, owner, operator)
    assert {k: found.get(k, {}) for k in expected} == expected
    assert all(call.args[2:] in ((), (5,)) for call in folded.call_args_list)


def test_horizon_models_use_default_trees(monkeypatch, spark):
    found, _ = settings_of(monkeypatch, spark, "horizon_models", modelling.models, "horizon_models")
    make = next(v for v in found.values() if inspect.isfunction(v))
    monkeypatch.setattr(modelling.models, "gbt_classifier", lambda *args, **kwargs: (args, kwargs))
    assert make("x") == ((modelling.FEATURES, "x"), {})


def test_model_table_keeps_the_fit_time(monkeypatch, spark):
    shown = spark.createDataFrame([("gbt", 0.7, 0.6, 0.5, 0.4, 1.25)], "model string, auc double, ap double, p_at_10 double, r_at_10 double, fit_min double")
    monkeypatch.setattr(modelling, "folded", MagicMock())
    monkeypatch.setattr(modelling.models, "compare_models", lambda *args: (None, shown))
    assert REGISTRY["model_table"].build(spark, "").first()["fit_min"] == 1.25
