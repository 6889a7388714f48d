"""Global order, quantiles, lookups and skewed joins against pandas."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import blend, ranks
from ebbtide.operators.audit import previous_in_entity
from ebbtide.operators.skew import hot_keys, salted_join
from ebbtide.session import materialize, scratch


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(1)
    return pd.DataFrame({"id": range(1000), "x": np.where(rng.random(1000) < 0.4, 3.0, rng.normal(size=1000).round(1))})


@pytest.fixture(scope="module")
def frame(spark, values):
    return spark.createDataFrame(values)


@pytest.mark.parametrize("buckets", [None, 5])
def test_average_rank(frame, values, buckets):
    got = ranks.average_rank(frame, "x", "r", ["id"], buckets).toPandas().sort_values("id")
    assert (got.r.to_numpy() == values.x.rank().to_numpy()).all()


def test_a_chain_of_ranks_computes_its_input_once(spark):
    rows = spark.sparkContext.accumulator(0)

    def seen(x):
        rows.add(1)
        return x

    values = [(i, float(i * 7 % 5), float(i * 3 % 11), float(i % 2), None if i % 9 == 0 else float(-i)) for i in range(40)]
    df = spark.createDataFrame(values, "id long, a double, b double, c double, d double").withColumn("a", F.udf(seen, "double")("a"))
    columns = [(c, f"r_{c}") for c in "abcd"]
    got = ranks.average_ranks(df, columns, ["id"]).toPandas().sort_values("id")
    assert rows.value == len(values)
    for i, (column, out) in enumerate(columns, 1):
        want = pd.Series([v[i] for v in values], dtype=float).rank(na_option="top")
        assert got[out].tolist() == want.tolist(), column


def test_blend_sweep_reads_its_table_once(spark):
    rows = spark.sparkContext.accumulator(0)

    def seen(x):
        rows.add(1)
        return x

    values = [(i, i % 13, int(i % 3 > 0), float(i * 7 % 23), float(i * 5 % 17)) for i in range(60)]
    df = spark.createDataFrame(values, "id long, time int, event int, risk double, a double").withColumn("risk", F.udf(seen, "double")("risk"))
    found = {(r.signal, r.weight): r.c_index for r in blend.blend_sweep(df, "risk", ["a", "risk"], ["id"], (0.5,)).collect()}
    assert rows.value == len(values)
    pdf = pd.DataFrame(values, columns=["id", "time", "event", "risk", "a"])
    for key, x in {("", 1.0): pdf.risk, ("a", 0.5): pdf.risk.rank() / 2 + pdf.a.rank() / 2, ("risk", 0.5): pdf.risk.rank()}.items():
        pairs = [(x[i] > x[j]) + (x[i] == x[j]) / 2 for i in pdf.index[pdf.event == 1] for j in pdf.index[pdf.time > pdf.time[i]]]
        assert found[key] == pytest.approx(np.mean(pairs))


def test_average_rank_micro_case(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 2.0), (3, 5.0)], "id int, x double")
    got = ranks.average_rank(df, "x", "r", ["id"]).orderBy("id").toPandas()
    assert got.r.tolist() == [1, 2.5, 2.5, 4]


@pytest.mark.parametrize("buckets", [None, 5])
def test_unique_rank_is_a_permutation_in_order(frame, buckets):
    got = ranks.unique_rank(frame, "x", "r", ["id"], buckets=buckets).toPandas().sort_values("r")
    assert (got.r.to_numpy() == np.arange(1, 1001)).all() and got.x.is_monotonic_increasing


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(frame, descending):
    hist = ranks.value_histogram(frame, "x")
    got = ranks.running_totals(hist, "x", ["n"], buckets=5, descending=descending).toPandas()
    got = got.sort_values("x", ascending=not descending)
    assert (got.cum_n.to_numpy() == got.n.cumsum().to_numpy()).all() and set(got.tot_n) == {1000}


@pytest.mark.parametrize("buckets", [None, 5])
def test_exact_quantiles(frame, values, buckets):
    probabilities = [0, 0.1, 0.5, 0.999, 1]
    got = ranks.exact_quantiles(frame, ["x", "id"], probabilities, buckets).toPandas()
    for column in ("x", "id"):
        mine = got[got.feature == column].sort_values("prob").value
        assert np.allclose(mine, np.quantile(values[column], probabilities))


def test_next_value(frame):
    got = ranks.next_value(ranks.value_histogram(frame, "x").select("x"), "x", "following", 5).toPandas().sort_values("x")
    assert (got.following.to_numpy()[:-1] == got.x.to_numpy()[1:]).all() and got.following.isna().sum() == 1


def test_hash_rank_by_group(frame):
    got = ranks.hash_rank(frame.withColumn("g", F.col("id") % 3), ["id"], "r", by=["g"]).toPandas()
    for _, part in got.groupby("g"):
        assert sorted(part.r) == list(range(1, len(part) + 1)) and set(part.r_of) == {len(part)}


@pytest.mark.parametrize("forward", [False, True])
def test_step_lookup(spark, frame, forward):
    keys = np.arange(-3, 3.5, 0.5)
    steps = spark.createDataFrame([(float(k), float(i)) for i, k in enumerate(keys)], "k double, v double")
    got = ranks.step_lookup(frame, "x", steps, "k", "v", "found", forward).toPandas()
    assert len(got) == 1000
    for x, found in zip(got.x, got.found, strict=True):
        index = np.searchsorted(keys, x, "left") if forward else np.searchsorted(keys, x, "right") - 1
        assert (np.isnan(found) and not 0 <= index < len(keys)) or found == index


@pytest.mark.parametrize("forward", [False, True])
def test_step_lookup_with_a_hot_value(spark, forward):
    """95 % of the rows at one value, some NULL: the answers stay right."""
    values = [7.0] * 950 + [None] * 20 + [float(i) / 3 for i in range(30)]
    rows = spark.createDataFrame(list(enumerate(values)), "id long, x double")
    keys = [-1.0, 2.0, 7.0, 9.0]
    steps = spark.createDataFrame([(k, f"s{k}") for k in keys], "k double, v string")
    got = ranks.step_lookup(rows, "x", steps, "k", "v", "found", forward).collect()
    assert len(got) == 1000
    for r in got:
        near = None if r.x is None else min((k for k in keys if k >= r.x), default=None) if forward else max((k for k in keys if k <= r.x), default=None)
        assert r.found == (None if near is None else f"s{near}")


def test_nulls_are_spread_when_ranked(spark):
    """90 % NULL scores: they come first, are split by hash, and no work group holds more than a small part."""
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id") % 977).alias("x"))
    placed = ranks._positions(rows, "x", ["id"], 16)
    assert placed.groupBy("_bucket", "_sub").count().agg(F.max("count")).first()[0] < 1000
    got = ranks.unique_rank(rows, "x", "r", ["id"], buckets=16).toPandas()
    assert sorted(got.r) == list(range(1, 20_001))


def test_equal_frequency_bins_match_linear_quantile_edges(spark):
    df = spark.range(1, 13).select(ranks.equal_frequency_bin(F.col("id"), F.lit(12), 10).alias("b"), "id")
    assert [r.b for r in df.orderBy("id").collect()] == [10, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1]


def test_salted_join_equals_plain_join_with_a_hot_key(spark):
    left = spark.range(3000).select(F.col("id").alias("a"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("k"))
    right = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert [(r.k, r.spread) for r in hot_keys(left, "k").collect()] == [(7, 16)]
    assert [(r.k, r.spread) for r in hot_keys(left, "k", rows_per_task=20).collect()] == [(7, 51)]
    got = salted_join(left, right, "k", ["a"]).select("a", "k", "v").toPandas().sort_values("a").reset_index(drop=True)
    want = left.join(right, "k").select("a", "k", "v").toPandas().sort_values("a").reset_index(drop=True)
    assert got.equals(want)


def test_previous_in_entity_over_buckets(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"e": np.where(rng.random(600) < 0.5, 0, rng.integers(1, 20, 600)), "t": rng.permutation(600), "v": rng.permutation(600)})
    got = previous_in_entity(spark.createDataFrame(pdf), "e", "t", "v", "p", 7).toPandas().sort_values(["e", "t"])
    want = pdf.sort_values(["e", "t"]).groupby("e").v.shift(1)
    assert np.array_equal(got.p.to_numpy(np.float64), want.to_numpy(np.float64), equal_nan=True)


def test_scratch_tables_are_dropped(spark):
    with scratch(spark):
        kept = materialize(spark.range(10))
        files = [f.removeprefix("file:") for f in kept.inputFiles()]
        assert kept.count() == 10 and all(os.path.exists(f) for f in files)
    assert not any(os.path.exists(f) for f in files)
