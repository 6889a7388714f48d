"""Survival forest against brute-force splits, Shapley values against all coalitions."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
import pytest
from conftest import COVARIATES, make_survival_data

from ebbtide.operators import cox, forest, histboost, shapley
from ebbtide.operators.metrics import concordance_index


def slow_logrank(left, time, event):
    z = v = 0.0
    for t in np.unique(time[event == 1]):
        risk = time >= t
        n, n1 = risk.sum(), (risk & left).sum()
        d, d1 = ((time == t) & (event == 1)).sum(), ((time == t) & (event == 1) & left).sum()
        z += d1 - d * n1 / n
        if n > 1:
            v += d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1)
    return z * z / v if v > 1e-12 else float("nan")


@pytest.fixture(scope="module")
def small(spark):
    data = make_survival_data(240, 11)
    data["time"] = np.ceil(data.time.clip(upper=12) * 2)
    return data, spark.createDataFrame(data).cache()


def test_first_split_is_the_best_logrank_cut(small):
    data, df = small
    fitted = forest.fit_forest(df, COVARIATES, ["id"], trees=1, depth=1, features_per_node=4, bootstrap=False, bins=8)
    assert len(fitted.times) == len(data.time[data.event == 1].unique())
    x = histboost.binned([pa.array(data[f].to_numpy(float)) for f in COVARIATES], fitted.cuts)
    time, event = data.time.to_numpy(), data.event.to_numpy()
    found = {}
    for f in range(4):
        for cut in range(len(fitted.cuts[f])):
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) >= 15:
                found[f, cut] = slow_logrank(left, time, event)
    best = max(found, key=found.get)
    tree = fitted.trees[0]
    assert (tree.feature[0], tree.bin[0]) == best
    for child, mask in ((1, x[:, best[0]] <= best[1]), (2, x[:, best[0]] > best[1])):
        expected = np.cumsum([0.0] + [((time == t) & (event == 1) & mask).sum() / ((time >= t) & mask).sum() for t in fitted.times])
        assert tree.rows[child] == mask.sum() and np.allclose(fitted.curves[0][child], expected)


def test_scores_of_all_cuts(small):
    data, _ = small
    rng = np.random.default_rng(2)
    bins, time = rng.integers(0, 5, len(data)), data.time.to_numpy()
    times = np.unique(time[data.event == 1])
    number = np.searchsorted(times, time, side="right")
    leaving, dying = np.zeros((1, 5, len(times) + 1)), np.zeros((1, 5, len(times) + 1))
    np.add.at(leaving[0], (bins, number), 1)
    np.add.at(dying[0], (bins, number), data.event.to_numpy())
    expected = [slow_logrank(bins <= c, time, data.event.to_numpy()) for c in range(4)]
    assert np.allclose(forest.logrank_scores(leaving, dying)[0], expected)


def test_forest_ranks_like_cox_and_curves_fall(recipe_df):
    fitted = forest.fit_forest(recipe_df, COVARIATES, ["id"], trees=20, depth=5)
    scored = fitted.predict(recipe_df, [1, 3, 6])
    linear = recipe_df.withColumn("risk", cox.fit_cox(recipe_df, COVARIATES).partial_hazard())
    assert concordance_index(scored, "risk") > concordance_index(linear, "risk") - 0.03 > 0.6
    assert scored.where("surv_1 < surv_3 or surv_3 < surv_6 or surv_1 > 1 or surv_6 < 0").count() == 0
    again = forest.fit_forest(recipe_df.repartition(5), COVARIATES, ["id"], trees=2, depth=3)
    assert np.array_equal(again.trees[1].feature, forest.fit_forest(recipe_df, COVARIATES, ["id"], trees=2, depth=3).trees[1].feature)


def test_forest_of_tables_without_splits(spark):
    df = spark.createDataFrame([(i, 1.0, float(i % 3), 1) for i in range(9)], "id long, a double, time double, event int")
    fitted = forest.fit_forest(df, ["a"], ["id"], trees=2, depth=2)
    assert len({r.risk for r in fitted.predict(df).collect()}) == 1
    empty = forest.fit_forest(df.limit(0), ["a"], ["id"], trees=1, depth=1)
    assert empty.predict(df).count() == 9


def expected_value(tree, x, held, node=0):
    """Mean leaf value when the features outside ``held`` follow the training rows."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    left, right = 2 * node + 1, 2 * node + 2
    if f in held:
        return expected_value(tree, x, held, right if x[f] > tree.bin[node] else left)
    return sum(tree.rows[c] / tree.rows[node] * expected_value(tree, x, held, c) for c in (left, right))


def test_shapley_values_equal_all_coalitions(spark):
    rng = np.random.default_rng(6)
    names = [f"f{i}" for i in range(8)]
    values = rng.standard_normal((400, 8))
    label = (values[:, 0] * values[:, 1] + values[:, 2] + 0.5 * values[:, 3] > 0).astype(int)
    rows = [(i, int(y), *map(float, v)) for i, (y, v) in enumerate(zip(label, values, strict=True))]
    df = spark.createDataFrame(rows, "id long, label int, " + ", ".join(f"{n} double" for n in names))
    target = histboost.Target("p", label="label", rounds=4, depth=4)
    model = histboost.fit(df, names, [target], ["id"], bins=8)
    booster = model.boosters[0]
    x = histboost.binned([pa.array(c) for c in values.T], model.cuts)
    found = np.array([r.v for r in df.orderBy("id").select(shapley.shapley_values(model).alias("v")).collect()])
    assert np.allclose(found.sum(1) + shapley.base_value(booster), booster.raw(x))
    for i in range(12):
        for j in range(8):
            others, total = [f for f in range(8) if f != j], 0.0
            for size in range(8):
                weight = factorial(size) * factorial(7 - size) / factorial(8)
                for held in combinations(others, size):
                    total += weight * sum(expected_value(t, x[i], {*held, j}) - expected_value(t, x[i], set(held)) for t in booster.trees)
            assert found[i, j] == pytest.approx(0.1 * total, abs=1e-9)
    importance = {r.feature: r.importance for r in shapley.shapley_importance(df, model).collect()}
    assert np.allclose([importance[n] for n in names], np.abs(found).mean(0))
    assert max(importance, key=importance.get) == "f2"
