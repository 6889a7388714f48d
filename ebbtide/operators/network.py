"""Counterparty features: inbound payments, pair recurrence, breadth, liveness of one-hop peers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.columns import count_if, distinct_units
from ebbtide.operators.skew import salted_join
from ebbtide.window import ObservationWindow

CUSTOMER, MERCHANT, BILLER = "CUST", "MRCH", "BILL"  # fixed values: kinds of counterparties


def inbound_engagement(
    trx: DataFrame, window: ObservationWindow, transfer_type: str = "P2P", exact: bool = False, rsd: float = 0.02
) -> DataFrame:
    """Received transfers per destination; senders counted by sketch, or exactly on request.

    The exact distinct shuffles by (destination, sender) first, so a popular destination is spread.
    """
    d = F.col("d")
    senders = F.countDistinct("src") if exact else F.approx_count_distinct("src", rsd)
    return (
        trx.filter((F.col("typ") == transfer_type) & (F.col("src") != F.col("dst")))
        .groupBy(F.col("dst").alias("id"))
        .agg(
            F.count(F.lit(1)).alias(f"in_cnt_{window.full}"),
            count_if(window.in_span(d, window.recent)).alias(f"in_cnt_{window.recent}"),
            F.sum("amt").alias(f"in_amt_{window.full}"),
            F.max("d").alias("in_last_d"),
            senders.alias("in_n_senders"),
        )
    )


def pair_recurrence(trx: DataFrame, window: ObservationWindow, unit: str | None = None) -> DataFrame:
    """Edge list ``(s, t, kind, m)``: in how many calendar units the pair transacted.

    Units are merged as a bit set, so one shuffle by pair suffices where a distinct would need two.
    """
    unit = unit or window.recurrence_unit
    return trx.groupBy(F.col("src").alias("s"), F.col("dst").alias("t"), "kind").agg(
        distinct_units(window.unit_index(F.col("d"), unit), window.units(unit)).alias("m")
    )


def counterparty_breadth(pairs: DataFrame, most: int = 3) -> DataFrame:
    """Distinct counterparties by kind, and those seen in ``most`` (or two or more) units."""
    m, kind = F.col("m"), F.col("kind")
    peer = (kind == CUSTOMER) & (F.col("s") != F.col("t"))
    every = m == most
    return pairs.groupBy(F.col("s").alias("id")).agg(
        F.count(F.lit(1)).alias("n_counterparties"),
        count_if(kind == MERCHANT).alias("n_merchants"),
        count_if(peer).alias("n_p2p_peers"),
        count_if(every).alias("n_recur3_all"),
        count_if(m >= 2).alias("n_recur2_all"),
        count_if(every & (kind == BILLER)).alias("n_recur3_bill"),
        count_if(every & (kind == MERCHANT)).alias("n_recur3_mrch"),
        count_if(every & peer).alias("n_recur3_p2p"),
    )


def undirected_peers(pairs: DataFrame, kind: str = CUSTOMER) -> DataFrame:
    """Each customer pair in both directions, once."""
    edges = pairs.filter((F.col("kind") == kind) & (F.col("s") != F.col("t")))
    forward = edges.select(F.col("s").alias("a"), F.col("t").alias("p"))
    backward = edges.select(F.col("t").alias("a"), F.col("s").alias("p"))
    return forward.unionByName(backward).distinct()


def peer_liveness(pairs: DataFrame, activity: DataFrame, window: ObservationWindow) -> DataFrame:
    """How active the one-hop peers of each customer are; peers without activity are left out.

    The join key is the peer, and a popular peer may carry a large share of all edges, so hot peers
    are salted; the aggregation that follows is partial on the map side.
    """
    recent = f"cnt_{window.recent}"
    nodes = activity.select(F.col("id").alias("p"), recent, window.days_before_cutoff(F.col("last_d")).alias("rec"))
    joined = salted_join(undirected_peers(pairs), nodes, "p", ["a"])
    return joined.groupBy(F.col("a").alias("id")).agg(
        F.count(F.lit(1)).alias("n_peers_2way"),
        F.avg(recent).alias("peer_avg_cnt30"),
        F.avg("rec").alias("peer_avg_recency"),
        F.min("rec").alias("peer_min_recency"),
        F.max(recent).alias("peer_max_cnt30"),
    )
