"""Selections, quantiles, lookups and log-rank tests that work from counts, against plain computations."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from conftest import COVARIATES
from pyspark.sql import functions as F

from ebbtide.operators import audit, blend, cox, decisions, km, ranks, splits
from ebbtide.plans import churn


@pytest.mark.parametrize("n", [0, 1, 137, 4000, 9000])
def test_sample_is_the_smallest_keys(spark, n):
    df = spark.range(5000).repartition(7)
    got = sorted(r.id for r in splits.sample_n(df, ["id"], n, 7, task_rows=50).collect())
    assert got == sorted(sorted(range(5000), key=lambda i: hashlib.md5(f"7|{i}".encode()).hexdigest())[:n])


def test_sample_of_repeated_ids(spark):
    df = spark.range(900).select((F.col("id") % 3).alias("id"))
    assert splits.sample_n(df, ["id"], 400, task_rows=10).count() == 400


@pytest.mark.parametrize("fraction", [0.001, 0.1, 0.5, 1.0])
def test_top_fraction_equals_ranking(spark, fraction):
    score = F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 101 == 1, None).otherwise(F.col("id") % 50)
    df = spark.range(2000).withColumn("s", score)
    ranked = ranks.unique_rank(df.withColumn("d", -F.col("s")), "d", "r", ["id"]).collect()
    expected = sorted(r.id for r in ranked if r.r <= max(1, int(2000 * fraction)))
    assert sorted(r.id for r in decisions.top_fraction(df, "s", ["id"], fraction).collect()) == expected


def test_quantiles_of_awkward_columns(spark):
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal(3000), rng.integers(0, 3, 3000).astype(float)
    rows = [(float(x) if i % 9 else None, float(y) if i % 7 else float("nan"), None) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    probabilities = [0.0, 0.01, 0.33, 0.5, 0.999, 1.0]
    found = {(r.feature, r.prob): r.value for r in ranks.exact_quantiles(df, ["a", "b", "c"], probabilities).collect()}
    kept = {"a": [r[0] for r in rows if r[0] is not None], "b": [r[1] for r in rows if r[1] == r[1]]}
    assert found == pytest.approx({(c, p): np.quantile(v, p) for c, v in kept.items() for p in probabilities})


def test_lookup_by_many_groups(spark):
    """Every row takes the step of its own group, NULL groups included, groups without steps none."""
    rng = np.random.default_rng(1)
    steps = [(None if g == 3 else g, float(k), g * 100 + k) for g in range(300) for k in sorted(rng.choice(40, 5, replace=False).tolist())]
    rows = [(i, None if g == 3 else g, float(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 310, 4000).tolist(), rng.uniform(-2, 45, 4000), strict=True))]
    table = spark.createDataFrame(steps, "g int, k double, p int")
    df = spark.createDataFrame(rows, "i int, g int, v double")
    for forward in (False, True):
        got = {r.i: r.o for r in ranks.step_lookup(df, "v", table, "k", "p", "o", forward=forward, by=["g"]).collect()}
        for i, g, v in rows:
            fit = [(k, p) for h, k, p in steps if h == g and (k >= v if forward else k <= v)]
            assert got[i] == ((min(fit) if forward else max(fit))[1] if fit else None)


def test_median_by_strata_equals_separate_lookups(recipe_df):
    df = recipe_df.withColumn("s", F.when(F.col("id") % 5 > 0, F.col("id") % 5))
    model = cox.fit_cox(df, COVARIATES, strata=["s"])
    found = {r.id: r.median for r in cox.predict_median(df.union(df.limit(3).withColumns({"id": F.col("id") + 10_000, "s": F.lit(77)})), model).collect()}
    base = {}
    for r in cox.baseline_hazard(model).collect():
        base.setdefault(r.s, []).append((r.h0, r.t))
    for r in df.withColumn("w", model.partial_hazard()).collect():
        reached = [t for h, t in base[r.s] if h >= np.log(2) / r.w]
        assert found[r.id] == (min(reached) if reached else None)
    assert [v for i, v in found.items() if i >= 10_000] == [None] * 3


def slow_logrank(rows):
    groups = sorted({g for g, _, _ in rows}, key=lambda g: (g is not None, g))
    z, v = np.zeros(len(groups)), np.zeros((len(groups),) * 2)
    for t in sorted({t for _, t, e in rows if e}):
        n = np.array([sum(1 for g, u, _ in rows if g == k and u >= t) for k in groups], float)
        d = np.array([sum(1 for g, u, e in rows if g == k and u == t and e) for k in groups], float)
        N, D = n.sum(), d.sum()
        z += d - D * n / N
        if N > 1:
            v += D * (N - D) / (N * N * (N - 1)) * (N * np.diag(n) - np.outer(n, n))
    return groups, z, v


@pytest.mark.parametrize("cells", [2_000_000, 50])
def test_logrank_of_many_groups_and_a_null_group(spark, monkeypatch, cells):
    monkeypatch.setattr(km, "LOGRANK_CELLS", cells)
    rng = np.random.default_rng(8)
    rows = [(None if g == 0 else int(g), int(t), int(e)) for g, t, e in zip(rng.integers(0, 12, 400), rng.integers(0, 30, 400), rng.integers(0, 2, 400), strict=True)]
    df = spark.createDataFrame(rows, "g int, time int, event int").repartition(3)
    groups, z, v = km.logrank_components(df, "g")
    expected = slow_logrank(rows)
    assert groups == expected[0] and np.allclose(z, expected[1]) and np.allclose(v, expected[2])
    row = km.logrank_test(df, "g").first()
    assert row.dof == 11 and 0 <= row.p_value <= 1


def test_logrank_of_two_hundred_groups(spark):
    df = spark.range(6000).select((F.col("id") % 200).cast("string").alias("g"), (F.col("id") % 97).alias("time"), (F.col("id") % 2).cast("int").alias("event"))
    row = km.logrank_test(df.union(spark.createDataFrame([("0", None, 1)], "g string, time long, event int")), "g").first()
    assert row.dof == 199 and row.statistic > 0 and km.logrank_test(df.limit(0), "g").first().dof == 0


def test_rows_without_an_entity_have_no_sequence(spark):
    rows = [("a", t, t) for t in range(4)] + [(None, t, 100 - t) for t in range(50)]
    df = spark.createDataFrame(rows, "e string, t int, n int")
    assert tuple(audit.id_monotone_share(df, "e", "t", "n").first()) == (1, 1.0)
    stepped = audit.previous_in_entity(df, "e", "t", "n", "before")
    assert stepped.count() == 54 and stepped.filter("e is null and before is not null").count() == 0


def test_second_stage_never_rises_with_the_count_out_of_fold(recipe_df):
    df = splits.folds(recipe_df.withColumns({"label": (F.col("time") < 4).cast("int"), "hidden": F.col("id") % 9 + 1}), ["id"], 3, ["label"]).cache()
    grid = df.limit(30).select(*COVARIATES, F.explode(F.sequence(F.lit(1), F.lit(9))).alias("hidden"), "id")
    oof, tested = blend.constrained_second_stage(df, grid, COVARIATES, "hidden", "label", ["id"], "s", folds=3, rounds=8, depth=3)
    assert oof.count() == df.count() and oof.filter("s is null or s < 0 or s > 1").count() == 0
    for _, part in tested.toPandas().sort_values("hidden").groupby("id"):
        assert (part.s.diff().dropna() <= 1e-12).all()


def test_churn_plan_switches_bands_by_contiguity(recipe_df):
    """Blocks that overlap leave the ensemble; sound blocks give bands, with the second stage inside the last."""
    df = recipe_df.withColumn("label", (F.col("time") < 4).cast("int")).select("id", "label", *COVARIATES)
    train, test = df.filter("id % 4 <> 0"), df.filter("id % 4 = 0").drop("label")
    hidden = F.when(F.col("id") % 5 == 0, 0).otherwise(F.col("id") % 7 + 1)
    blocks = df.filter("id % 6 <> 0").select("id", hidden.alias("hidden"), F.lit(0).alias("internal_holes"))
    sound = churn.run(train, test, COVARIATES, blocks=blocks, folds=2, trees=4)
    assert {r.band for r in sound.oof.select("band").distinct().collect()} == {"A", "B", "C"}
    assert sound.oof.filter("band = 'C' and (second is null or score > 0.6)").count() == 0
    assert sound.oof.filter("(band = 'A') <> (hidden = 0) or (band = 'A' and score <> 1)").count() == 0
    broken = churn.run(train, test, COVARIATES, blocks=blocks.withColumn("internal_holes", F.lit(1)), folds=2, trees=4)
    assert "band" not in broken.oof.columns and broken.oof.filter("score <> ensemble").count() == 0
    assert sound.submission.count() == broken.submission.count() == test.count()
