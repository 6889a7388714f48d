"""Classifier protocol, sampling, blending and decision invariants."""

from __future__ import annotations

import threading

import numpy as np
import pytest
from conftest import COVARIATES
from pyspark.sql import functions as F

from ebbtide.operators import audit, blend, decisions, metrics, models, quality, splits, tuning


@pytest.fixture(scope="module")
def labelled(spark, recipe_df):
    df = recipe_df.withColumn("label", (F.col("time") < 4).cast("int"))
    return splits.folds(df, ["id"], 3, ["label"]).cache()


def test_folds_are_balanced_and_reproducible(labelled):
    sizes = labelled.groupBy("label", "fold").count().toPandas()
    for _, part in sizes.groupby("label"):
        assert part["count"].max() - part["count"].min() <= 1
    again = splits.folds(labelled.drop("fold").repartition(5), ["id"], 3, ["label"])
    assert again.join(labelled.select("id", F.col("fold").alias("f")), "id").filter("fold <> f").count() == 0


def test_holdout_share(labelled):
    got = splits.holdout_split(labelled, ["id"], 0.25, ["label"]).groupBy("label").agg(F.avg("is_test").alias("s"))
    assert all(r.s == pytest.approx(0.25, abs=0.01) for r in got.collect())


def test_undersample_balances(labelled):
    got = {r.label: r["count"] for r in splits.undersample(labelled, ["id"], "label").groupBy("label").count().collect()}
    assert got[0] <= got[1]


def test_out_of_fold_covers_every_row_once(labelled):
    train, test = labelled.filter("id % 5 <> 0"), labelled.filter("id % 5 = 0").drop("fold")
    oof, scored = models.out_of_fold(train, test, models.logistic_classifier(COVARIATES), 3, "p")
    assert oof.count() == oof.select("id").distinct().count() == train.count()
    assert scored.count() == test.count() and scored.filter("p between 0 and 1").count() == test.count()
    from ebbtide.operators.metrics import auc

    assert auc(oof, "p", "label").first()["auc"] > 0.6


def test_horizon_models_are_monotone_and_handle_one_class(labelled):
    make = lambda label: models.gbt_classifier(COVARIATES, label, maxIter=2, maxDepth=2)
    oof, _ = models.horizon_models(labelled, None, make, 3, (3, 6, 1000), "s")
    assert oof.filter("s3 < s6 or s6 < s1000").count() == 0
    assert oof.agg(F.max("s1000")).first()[0] == 0.0


def test_smote_balances_inside_the_minority_hull(labelled):
    minority = labelled.withColumn("label", (F.col("time") < 1).cast("int"))
    made = models.smote(minority, COVARIATES, "label", ["id"])
    counts = {r.label: r["count"] for r in made.groupBy("label").count().collect()}
    assert counts[0] == counts[1]
    seen = minority.filter("label = 1").agg(F.min("age"), F.max("age")).first()
    new = made.filter("label = 1").agg(F.min("age"), F.max("age")).first()
    assert seen[0] - 1e-9 <= new[0] and new[1] <= seen[1] + 1e-9


def test_nearest_rows_equal_brute_force(spark):
    """Integer points with ties and copies: distances are exact, equal ones go to the lesser row."""
    rows = np.random.default_rng(5).integers(0, 4, (300, 3)).astype(float)
    got = models.nearest_rows(spark, rows, np.ones(3), 5, block=50).orderBy("base", "place").collect()
    expected = []
    for i, r in enumerate(rows):
        order = sorted((j for j in range(300) if j != i), key=lambda j: (((rows[j] - r) ** 2).sum(), j))
        expected += [(i, place, j) for place, j in enumerate(order[:5])]
    assert [tuple(r) for r in got] == expected


def test_smote_rows_lie_between_neighbours(spark):
    """One feature: every made row lies between a minority row and one of its two nearest."""
    rows = [(i, float(i * i), 1) for i in range(12)] + [(100 + i, -1.0, 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, label int")
    made = [r.x for r in models.smote(df, ["x"], "label", ["id"], k=2).filter("label = 1").collect()]
    squares = [float(i * i) for i in range(12)]
    near = {x: sorted((abs(x - o), o) for o in squares if o != x)[:2] for x in squares}
    assert len(made) == 60 and set(squares) <= {round(x, 9) for x in made}
    assert all(any(min(x, o) - 1e-9 <= m <= max(x, o) + 1e-9 for x, n in near.items() for _, o in n) for m in made)


def test_importances(labelled):
    model = models.gbt_classifier(COVARIATES, maxIter=2, maxDepth=2)(labelled)
    gains = models.gain_importance(labelled, model, COVARIATES)
    assert gains.agg(F.sum("importance")).first()[0] == pytest.approx(1)
    occluded = {r.feature: r.importance for r in models.occlusion_importance(labelled, model, COVARIATES).collect()}
    for r in gains.collect():
        assert (r.importance == 0) == (occluded[r.feature] == 0)
    assert audit.dominance_check(gains).first()["share"] <= 1


def test_shuffle_column_permutes_one_column(labelled):
    got = models.shuffle_column(labelled.select("id", "age", "balance"), "age", ["id"], 1)
    before, after = labelled.toPandas(), got.toPandas()
    assert sorted(before.age) == sorted(after.age)
    merged = before.merge(after, on="id")
    assert (merged.balance_x == merged.balance_y).all() and (merged.age_x != merged.age_y).mean() > 0.9


def test_adversarial_validation_sees_a_shift(labelled):
    shifted = labelled.withColumn("age", F.col("age") + 30)
    row = models.adversarial_validation(labelled, shifted, COVARIATES, ["id"], maxIter=3).first()
    assert row.shift == 1 and row.auc > 0.8


def test_random_search_table(labelled):
    rows = tuning.random_search(labelled, COVARIATES, "label", ["id"], trials=2, rounds=2).orderBy("trial").collect()
    assert [r.trial for r in rows] == [1, 2] and rows[1].best_so_far == max(r.auc for r in rows)
    assert tuning.draw_trials(3) == tuning.draw_trials(3)


def test_isotonic_micro_case(spark):
    df = spark.createDataFrame([(0.1, 0), (0.1, 1), (0.5, 0), (0.7, 1), (0.9, 1)], "x double, y int")
    model = blend.fit_isotonic(df, "x", "y")
    asked = spark.createDataFrame([(0.0,), (0.6,), (2.0,)], "x double")
    assert [r.p for r in blend.apply_isotonic(asked, model, "x", "p").orderBy("x").collect()] == pytest.approx([1 / 3, 2 / 3, 1])


def _max_min(points):
    """The rising curve at each point: the largest over starts of the smallest mean up to an end."""
    y, w = np.array([p[1] for p in points]), np.array([p[2] for p in points])
    sums, weights = np.concatenate([[0], np.cumsum(y)]), np.concatenate([[0], np.cumsum(w)])
    mean = lambda a, b: (sums[b + 1] - sums[a]) / (weights[b + 1] - weights[a])
    return [max(min(mean(a, b) for b in range(i, len(points))) for a in range(i + 1)) for i in range(len(points))]


@pytest.mark.parametrize("shape", ["noise", "falling", "rising", "cascade", "equal"])
def test_violators_are_pooled_over_ranges(spark, shape):
    """Ranges of 16 points: the blocks are those of the whole curve, whatever crosses the ranges."""
    rng = np.random.default_rng(3)
    y = {
        "noise": np.arange(120) // 30 + rng.integers(0, 4, 120),
        "falling": np.arange(120)[::-1],
        "rising": np.arange(120),
        "cascade": np.concatenate([np.arange(119), [-5000]]),
        "equal": np.full(120, 3),
    }[shape].astype(float)
    points = [(float(i), float(t), float(w)) for i, (t, w) in enumerate(zip(y, rng.integers(1, 4, 120), strict=True))]
    frame = spark.createDataFrame(points, "lo double, total double, weight double").repartition(5).withColumn("hi", F.col("lo"))
    blocks = blend.pool_violators(frame.select("lo", "hi", "total", "weight"), task_rows=16).orderBy("lo").collect()
    means = [b.total / b.weight for b in blocks]
    assert all(a < b for a, b in zip(means, means[1:], strict=False))
    curve = [m for b, m in zip(blocks, means, strict=True) for _ in range(int(b.lo), int(b.hi) + 1)]
    assert curve == pytest.approx(_max_min(points))


def test_a_million_falling_scores_leave_one_block(spark):
    points = spark.range(1_000_000).select(
        F.col("id").cast("double").alias("lo"), F.col("id").cast("double").alias("hi"), (-F.col("id")).cast("double").alias("total"), F.lit(1.0).alias("weight")
    )
    rows = blend.pool_violators(points, task_rows=100_000).collect()
    assert [(r.lo, r.hi, r.weight) for r in rows] == [(0.0, 999_999.0, 1e6)]


def test_isotonic_leaves_out_missing_and_falls(spark):
    rows = [(0.1, 1.0), (0.2, 1.0), (0.3, 0.0), (0.4, 1.0), (0.5, 0.0), (None, 1.0), (float("nan"), 0.0), (0.1, None)]
    df = spark.createDataFrame(rows, "x double, y double")
    model = blend.fit_isotonic(df, "x", "y", increasing=False)
    asked = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.35,), (0.4,), (0.5,)], "x double")
    got = [r.p for r in blend.apply_isotonic(asked, model, "x", "p").orderBy("x").collect()]
    assert got == pytest.approx([1, 1, 0.5, 0.5, 0.5, 0])


def test_second_stage_never_rises_with_hidden(labelled):
    df = labelled.withColumn("hidden", F.col("id") % 7).withColumn("p", F.lit(0.3))
    scored = blend.monotone_second_stage(df, "hidden", "p", "label", "s").groupBy("hidden").agg(F.max("s").alias("s"))
    values = [r.s for r in scored.orderBy("hidden").collect()]
    assert values == sorted(values, reverse=True)


def test_monotone_probabilities(spark):
    df = spark.createDataFrame([(0.9, 0.95, 0.4), (1.2, -0.1, 0.5)], "a double, b double, c double")
    got = [tuple(r) for r in decisions.monotone_probabilities(df, ["a", "b", "c"]).collect()]
    assert got == [(0.9, 0.9, 0.4), (1.0, 0.0, 0.0)]


def test_submission_checks_catch_faults(spark):
    good = [(1, 0.0, 0.9, 0.8, 0.7), (2, 1.0, 0.9, 0.9, 0.9)]
    schema = "ACCOUNT_ID int, RISK_SCORE double, SURV_PROB_30D double, SURV_PROB_60D double, SURV_PROB_90D double"
    assert min(decisions.submission_checks(spark.createDataFrame(good, schema), 2).drop("n_rows").first()) == 1
    bad = [(1, 0.0, 0.9, 0.95, 1.7), (1, None, 0.9, 0.9, 0.9)]
    assert sum(decisions.submission_checks(spark.createDataFrame(bad, schema), 3).drop("n_rows").first()) == 0


def test_deciles_sum_to_all_rows(labelled):
    table = decisions.lift_table(labelled, "age", "label", ["id"]).toPandas().sort_values("decile")
    assert table.customers.sum() == labelled.count() and table.cum_recall.iloc[-1] == pytest.approx(1)
    assert table.customers.max() - table.customers.min() <= 1


def test_scaler_caps_and_audit_forms(labelled):
    scaled = quality.apply_scaler(labelled, quality.fit_scaler(labelled, ["age"])).agg(F.avg("age"), F.stddev("age")).first()
    assert scaled[0] == pytest.approx(0, abs=1e-9) and scaled[1] == pytest.approx(1)
    capped = quality.apply_caps(labelled, quality.fit_caps(labelled, ["balance"], 0.9))
    assert capped.agg(F.max("balance")).first()[0] < labelled.agg(F.max("balance")).first()[0]
    exact = {r.feature: r.p99_over_med for r in quality.skew_audit(labelled, ["age", "balance"]).collect()}
    sketch = {r.feature: r.p99_over_med for r in quality.skew_audit(labelled, ["age", "balance"], approximate=True).collect()}
    assert sketch == pytest.approx(exact, rel=0.05)


def test_auc_of_blends_counts_over_bins(spark, monkeypatch):
    """Bins of 50 rows, packed from batches of 30 and more, with ties, a heavy value, null labels and a single class."""
    monkeypatch.setattr(blend, "BIN_ROWS", 50)
    monkeypatch.setattr(blend, "HELD_ROWS", 30)
    rng = np.random.default_rng(2)
    rows = [(float(rng.integers(40)), 7.0 if k % 3 else float(k), int(rng.random() < 0.3) if k % 11 else None) for k in range(700)]
    df = spark.createDataFrame(rows, "a double, b double, y int").repartition(5)
    blends = {"a": F.col("a"), "b": F.col("b"), "c": 3 * F.col("a") - F.col("b")}
    found = blend.auc_of_blends(df, blends, "y")
    for name, score in (("a", lambda a, b: a), ("b", lambda a, b: b), ("c", lambda a, b: 3 * a - b)):
        pos, neg = ([score(a, b) for a, b, y in rows if y == k] for k in (1, 0))
        wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
        assert found[name] == wins / (len(pos) * len(neg))
    assert blend.auc_of_blends(df.where("y = 1"), blends, "y") == {"a": None, "b": None, "c": None}
    assert blend.auc_of_blends(df.where("y = 2"), blends, "y") == {"a": None, "b": None, "c": None}


def test_auc_of_blends_moves_packed_bins_and_no_rows(spark, monkeypatch):
    """No score leaves its task as a row: neither a histogram by score nor a running sum over it is made."""
    monkeypatch.setattr(metrics, "score_histogram", None)
    df = spark.range(1000).select("id", (F.col("id") % 10).alias("a"), (F.col("id") % 7).alias("b"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    assert blend.rank_ensemble(df, ["a", "b"], "y", ["id"]).count() == 21


def test_cross_validation_fits_folds_side_by_side(labelled):
    together = threading.Barrier(3, timeout=20)

    def fit(train):
        together.wait()  # breaks unless all three folds are being fitted
        mean = train.agg(F.avg("age")).first()[0]
        return lambda x: x.withColumn("risk", F.col("age") - mean)

    rows = {r.fold: r for r in models.cross_validated_concordance(labelled, fit, 3).collect()}
    for fold, row in rows.items():
        held = labelled.filter(F.col("fold") == fold).withColumn("risk", F.col("age"))
        assert row.c_index == pytest.approx(metrics.concordance_index(held, "risk"))
    assert len(rows) == 3 and rows[0]["mean"] == pytest.approx(np.mean([r.c_index for r in rows.values()]))


def test_permutation_importance_numbers_rows_once_a_repeat(labelled, monkeypatch):
    """Two numberings per repeat, whatever the number of features; each feature is shuffled as ``shuffle_column`` does."""
    features, calls, plain = ["age", "balance", "group"], [], models.hash_rank
    monkeypatch.setattr(models, "hash_rank", lambda *a, **k: calls.append(a) or plain(*a, **k))
    risk = lambda x: x.withColumn("risk", F.col("age") / 30 - F.col("balance") / 2000 + F.col("group"))
    found = {r.feature: r.importance for r in models.permutation_importance(labelled, risk, features, ["id"], repeats=2).collect()}
    assert len(calls) == 4 and set(found) == set(features)
    whole = metrics.concordance_index(risk(labelled), "risk")
    shuffled = [metrics.concordance_index(risk(models.shuffle_column(labelled, "balance", ["id"], 42 + r)), "risk") for r in range(2)]
    assert found["balance"] == pytest.approx(whole - sum(shuffled) / 2, abs=1e-12)
