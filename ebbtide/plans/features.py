"""The customer feature table: three fact aggregations, one star join, one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ebbtide.operators import activity, assemble, balance, derived, network
from ebbtide.operators.dictionary import fit_codes
from ebbtide.session import materialize
from ebbtide.window import ObservationWindow


def raw_feature_tables(
    trx: DataFrame, balances: DataFrame, window: ObservationWindow, exact_senders: bool = False
) -> list[DataFrame]:
    """The aggregates that hang off the customer spine, each with one row per ``id``.

    Facts are read once per grouping (by payer and day, by payer, by payee, by pair, by account). The two
    aggregates with several readers, the activity profile and the pair table, are written out once.
    """
    profile = materialize(activity.activity_profile(activity.daily_activity(trx), window))
    pairs = materialize(network.pair_recurrence(trx, window))
    return [
        profile,
        activity.amount_and_type_mix(trx, window),
        network.inbound_engagement(trx, window, exact=exact_senders),
        balance.balance_profile(balances, window),
        network.counterparty_breadth(pairs, window.units(window.recurrence_unit)),
        network.peer_liveness(pairs, profile, window),
    ]


def assemble_features(
    trx: DataFrame,
    balances: DataFrame,
    profiles: DataFrame,
    window: ObservationWindow,
    exact_senders: bool = False,
) -> DataFrame:
    """One row per customer with all aggregated columns, NULL where a customer has no such activity."""
    spine = assemble.tenure_and_profile(profiles, window)
    return assemble.star_join(spine, raw_feature_tables(trx, balances, window, exact_senders))


def feature_matrix(
    trx: DataFrame,
    balances: DataFrame,
    profiles: DataFrame,
    window: ObservationWindow,
    categories: dict[str, list | DataFrame] | None = None,
    exact_senders: bool = False,
) -> DataFrame:
    """The complete numeric feature matrix keyed by ``id``; no NULL remains.

    The wide row is written out before the derived columns are added, which keeps their large projection
    apart from the aggregations when the plan is compiled.
    """
    if categories is None:
        categories = fit_codes(profiles, ["GENDER", "REGION"])
    wide = materialize(assemble_features(trx, balances, profiles, window, exact_senders))
    return derived.finalize_features(derived.derive_all(wide, window), categories)
