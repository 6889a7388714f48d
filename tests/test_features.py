"""Feature micro-cases, sources and leakage audits."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from ebbtide import ObservationWindow
from ebbtide.functions import columns as C
from ebbtide.functions import vectors as V
from ebbtide.operators import activity, audit, balance, labels, network
from ebbtide.operators.assemble import assert_no_nulls
from ebbtide.sources import tables

Q = ObservationWindow.quarter()


def test_quarter_window():
    assert (Q.days, Q.weeks, Q.cutoff) == (91, 13, date(2024, 4, 1))
    assert Q.since("60d") == date(2024, 2, 1) and Q.since("30d") == date(2024, 3, 2)
    assert [s[0] for s in Q.segments] == ["jan", "feb", "mar"] and Q.units("month") == 3


def test_gap_of_45_days(spark):
    daily = spark.createDataFrame([("a", date(2024, 1, 5), 1), ("a", date(2024, 2, 19), 1), ("b", date(2024, 1, 1), 2)], "id string, d date, c long")
    rows = activity.gap_stats(daily, Q).collect()
    assert len(rows) == 1 and rows[0].dead30_inner == 15 and rows[0].gap_max == 45 and rows[0].n_gap21 == 1


def test_null_rules(spark):
    daily = spark.createDataFrame([("a", date(2024, 1, 5), 3)], "id string, d date, c long")
    row = activity.window_counts(daily, Q).first()
    assert row.cnt_90d == 3 and row.cnt_30d is None and row.active_days_30d == 0 and row.active_weeks == 1


def test_trailing_zero_weeks(spark):
    cols = [F.col(f"w{i}") for i in range(13)]
    df = spark.createDataFrame([[0] * 13, [0] * 12 + [2], [1] + [0] * 12], [f"w{i}" for i in range(13)])
    assert [r[0] for r in df.select(V.trailing_zeros(cols)).collect()] == [13, 0, 12]


def test_distinct_units_of_any_length(spark):
    df = spark.range(200).select((F.col("id") % 100).cast("int").alias("u"))
    assert df.agg(C.distinct_units(F.col("u"), 200)).first()[0] == 100
    assert df.agg(C.distinct_units(F.col("u") % 60, 63)).first()[0] == 60
    outside = spark.createDataFrame([(-64,), (0,), (64,), (3,), (None,), (63,)], "u int")
    assert outside.agg(C.distinct_units(F.col("u"), 10)).first()[0] == 2
    assert outside.agg(C.distinct_units(F.col("u"), 64)).first()[0] == 3
    assert outside.filter("u is null").agg(C.distinct_units(F.col("u"), 10)).first()[0] == 0


def test_hex_suffix(spark):
    texts = ["T-ff", "T-xyz", "T-00000000ffffff", "T-123456789abcdef0", "a-b-" + "F" * 31, "T-" + "0" * 32, "T-", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    expected = [255, None, 16777215, 0x123456789ABCDEF0, 16**31 - 1, None, None, None]
    assert [r[0] for r in df.select(C.hex_suffix_to_number(F.col("x"))).collect()] == expected
    row = C.unparsed_share(df, "x").first()
    assert (row.n, round(row.unparsed, 6)) == (7, round(3 / 7, 6))


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(0.02,), (0.021,), (-2.0,), (2.0,)], "x double")
    got = [r[0] for r in df.select(C.right_closed_bin(F.col("x"), (-1, 0.02, 1), ("low", "high"))).collect()]
    assert got == ["low", "high", None, None]


def test_categories_are_fitted_once(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "g string")
    fitted = C.fit_categories(train, ["g"])
    test = spark.createDataFrame([("a",), ("b",), ("new",), (None,)], "g string")
    assert [r.g for r in C.apply_categories(test, fitted).collect()] == [0, 1, -1, -1]
    with pytest.raises(ValueError):
        C.fit_categories(spark.range(30).select(F.col("id").cast("string").alias("g")), ["g"], bound=10)


def test_peers_without_activity_are_left_out(spark):
    trx = spark.createDataFrame(
        [(1, 2, "CUST"), (2, 3, "CUST"), (1, 1, "CUST"), (1, 9, "MRCH")], "src long, dst long, kind string"
    ).withColumns({"d": F.lit(date(2024, 3, 30)), "typ": F.lit("P2P"), "amt": F.lit(1.0), "hr": F.lit(1)})
    pairs = network.pair_recurrence(trx, Q)
    peers = network.peer_liveness(pairs, activity.window_counts(activity.daily_activity(trx), Q), Q)
    assert {r.id: r.n_peers_2way for r in peers.collect()} == {1: 1, 2: 1, 3: 1}


def test_balance_last_and_outflow(spark):
    df = spark.createDataFrame([(1, date(2024, 1, 1), 10.0), (1, date(2024, 1, 2), 4.0), (1, date(2024, 1, 3), 0.5)], "id int, d date, b double")
    row = balance.balance_profile(df, Q).first()
    assert (row.bal_last, row.bal_outflow_90d, row.zero_bal_days_90d) == (0.5, 9.5, 1)
    assert balance.daily_closing(df.unionByName(df)).count() == 3


def test_silence_label(spark):
    cut = date(2024, 1, 10)
    rows = [("at_once", date(2024, 1, 9)), ("later", date(2024, 1, 10)), ("never", date(2024, 1, 10)), ("never", date(2024, 1, 12)), ("never", date(2024, 1, 14))]
    daily = spark.createDataFrame(rows, "id string, d date").withColumn("c", F.lit(1))
    got = {r.id: (r.time, r.event) for r in labels.silence_label(daily, daily.select("id").distinct(), cut, 2, 4).collect()}
    assert got == {"at_once": (0, 1), "later": (1, 1), "never": (4, 0)}


def test_future_records_are_refused(spark):
    df = spark.createDataFrame([(date(2024, 4, 2),)], "d date")
    with pytest.raises(ValueError):
        audit.assert_no_future({"trx": (df, F.col("d"))}, date(2024, 3, 31))


def test_contiguous_blocks_are_recognised(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), ("b", 6), ("c", 7)], "e string, n long")
    blocks = audit.id_blocks(df, "e", "n")
    assert {r.id: (r.hidden, r.internal_holes) for r in blocks.collect()} == {"a": (2, 0), "b": (0, 0), "c": (0, 0)}
    assert audit.contiguity_test(blocks).first()["valid"] == 1


def test_null_assertion(spark):
    with pytest.raises(ValueError):
        assert_no_nulls(spark.createDataFrame([(1, None)], "a int, b int"))


def test_csv_round_trip_and_views(spark, tmp_path):
    rows = [("x", 5, 1), ("y", 91, 0)]
    df = spark.createDataFrame(rows, tables.LABELS_SCHEMA)
    tables.write_table(df, str(tmp_path / "labels"), "csv")
    back = tables.read_csv(spark, str(tmp_path / "labels"), tables.LABELS_SCHEMA)
    assert sorted(tuple(r) for r in back.collect()) == rows and back.schema == tables.LABELS_SCHEMA
    tables.write_table(df, str(tmp_path / "part"), partition_by=["EVENT_FLAG"])
    tables.read_parquet(spark, str(tmp_path / "part"), view="labels_view")
    assert spark.sql("SELECT count(*) FROM labels_view WHERE EVENT_FLAG = 1").first()[0] == 1
