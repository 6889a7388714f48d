"""The star-schema tables in the roles the analytics need: transactions, balances, profiles, labels.

The clock of each source is stretched or compressed onto the observation quarter, so that the whole
table takes part in every feature: day ``k`` of ``n`` falls on day ``k * 91 / n`` of the quarter.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.sources.tables import table
from ebbtide.window import ObservationWindow

QUARTER = ObservationWindow.quarter(date(2024, 1, 1))
EVENTS_WINDOW = ObservationWindow(
    start=date(2024, 1, 1),
    cutoff=date(2024, 1, 31),
    spans={"21d": 21, "14d": 14, "7d": 7, "3d": 3, "1d": 1},
    segments=(
        ("early", date(2024, 1, 1), date(2024, 1, 11)),
        ("middle", date(2024, 1, 11), date(2024, 1, 21)),
        ("late", date(2024, 1, 21), date(2024, 1, 31)),
    ),
    full="30d",
    recent="7d",
    short="3d",
    silence=3,
    gap_lengths=(2, 3, 4),
    balance_weeks=(0, 1, 2, 3),
    recurrence_unit="week",
)
ORDERS_WINDOW = ObservationWindow(
    start=date(1995, 1, 1),
    cutoff=date(2001, 8, 2),
    spans={"1y": 365, "90d": 90},
    full="all",
    recent="1y",
    short="90d",
    silence=180,
    gap_lengths=(90, 180, 365),
    recurrence_unit="year",
)
LEDGER_BASE = date(1995, 1, 1)
LEDGER_END = date(2000, 8, 1)  # first day whose orders belong to the outcome, not to the features
FOLLOW_UP = 91

# fixed values: which transaction type a source category stands for, and the kind of its counterparty
EVENT_TYPES = {"purchase": "P2P", "click": "MerchantPay", "view": "BillPay", "signup": "CashIn", "error": "CashOut"}
PRIORITY_TYPES = {
    "1-URGENT": "P2P",
    "2-HIGH": "MerchantPay",
    "3-MEDIUM": "BillPay",
    "4-NOT SPECIFIED": "CashIn",
    "5-LOW": "CashOut",
}
KINDS = {"P2P": "CUST", "MerchantPay": "MRCH", "BillPay": "BILL"}


def _recode(column: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    out = None
    for key, value in mapping.items():
        out = F.when(column == key, F.lit(value)) if out is None else out.when(column == key, F.lit(value))
    return out.otherwise(F.lit(default))


def event_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` on their own 30-day clock."""
    typ = _recode(F.col("event_type"), EVENT_TYPES)
    return (
        table(spark, folder, "events")
        .select(
            F.col("user_id").alias("src"),
            F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("dst"),
            typ.alias("typ"),
            F.col("value").alias("amt"),
            F.to_date("ts").alias("d"),
            F.hour("ts").alias("hr"),
            "event_id",
        )
        .withColumn("kind", _recode(F.col("typ"), KINDS, "AGNT"))
    )


def order_activity(spark: SparkSession, folder: str) -> DataFrame:
    """``orders`` as dated activity of customers on their own clock."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("src"),
        F.col("o_orderpriority").alias("typ"),
        F.col("o_totalprice").alias("amt"),
        F.to_date("o_orderdate").alias("d"),
        F.col("o_orderkey").alias("trx_id"),
    )


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines shipped before the outcome period as a payment ledger of customers over one quarter."""
    span = (LEDGER_END - LEDGER_BASE).days
    offset = F.datediff(F.to_date("l_shipdate"), F.lit(LEDGER_BASE))
    day = F.floor(offset * F.lit(QUARTER.days) / span).cast("int")
    lines = (
        table(spark, folder, "lineitem")
        .filter(F.col("l_shipdate") < F.lit(LEDGER_END))
        .select(
            "l_orderkey",
            F.col("l_suppkey").alias("dst"),
            F.col("l_extendedprice").alias("amt"),
            F.date_add(F.lit(QUARTER.start), day).alias("d"),
            (F.col("l_partkey") % 24).cast("int").alias("hr"),
        )
    )
    owners = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").alias("src"),
        _recode(F.col("o_orderpriority"), PRIORITY_TYPES).alias("typ"),
    )
    return (
        lines.join(owners, "l_orderkey")
        .withColumn("kind", _recode(F.col("typ"), KINDS, "AGNT"))
        .drop("l_orderkey")
    )


def running_balance(trx: DataFrame, inflow: tuple[str, ...] = ("CashIn", "P2P")) -> DataFrame:
    """Day-end balances ``(id, d, b)`` on active days: signed daily nets, summed up per account.

    The window runs over at most one row per account and day.
    """
    signed = F.when(F.col("typ").isin(*inflow), F.col("amt")).otherwise(-F.col("amt"))
    net = trx.groupBy(F.col("src").alias("id"), "d").agg(F.sum(signed).alias("net"))
    running = W.partitionBy("id").orderBy("d").rowsBetween(W.unboundedPreceding, W.currentRow)
    return net.select("id", "d", F.round(F.sum("net").over(running), 2).alias("b"))


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """``customer`` with region and first order date in the role of the profile table."""
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    region = table(spark, folder, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("REGION"))
    opened = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min(F.to_date("o_orderdate")).alias("open_date")
    )
    return (
        table(spark, folder, "customer")
        .join(nation, "c_nationkey")
        .join(region, "n_regionkey")
        .join(opened, "c_custkey", "left")
        .select(
            F.col("c_custkey").alias("id"),
            F.lit("Customer").alias("account_type"),
            "open_date",
            F.col("c_mktsegment").alias("GENDER"),
            "REGION",
        )
    )


def order_outcomes(spark: SparkSession, folder: str, follow_up: int = FOLLOW_UP) -> DataFrame:
    """Days from the ledger end to the next order, for customers who ordered before it: ``id, time, event``.

    Nobody leaves before ``follow_up`` days, so a customer without an order by then is censored there.
    """
    end = F.lit(LEDGER_END)
    day = F.to_date("o_orderdate")
    seen = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.count_if(day < end).alias("before"),
        F.min(F.when(day >= end, F.datediff(day, end))).alias("wait"),
    )
    observed = F.coalesce(F.col("wait") < follow_up, F.lit(False))
    return seen.filter("before > 0").select(
        "id",
        F.when(observed, F.col("wait")).otherwise(F.lit(follow_up)).cast("int").alias("time"),
        observed.cast("int").alias("event"),
    )


def scored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a quality label, scored by their length: ``id, y, score``."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    return (
        table(spark, folder, "labels")
        .join(docs, "doc_id")
        .select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("score"))
    )
