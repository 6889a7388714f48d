"""Feature queries: activity, amounts, gaps, balances, network, assembly and derived columns."""

from __future__ import annotations


from pyspark.sql import functions as F

from ebbtide.catalog import sql as S
from ebbtide.catalog.registry import query
from ebbtide.functions.columns import apply_categories, fit_categories
from ebbtide.operators import activity, assemble, balance, derived, dictionary, network
from ebbtide.plans import features as plan
from ebbtide.session import materialize
from ebbtide.sources import roles
from ebbtide.sources.tables import table

Q, EW, OW = roles.QUARTER, roles.EVENTS_WINDOW, roles.ORDERS_WINDOW


@query(
    "daily_activity",
    "id:i d:d c:i",
    S.with_(S.EVENTS_TRX, S.DAILY, select="SELECT * FROM daily"),
)
def _(spark, folder):
    return activity.daily_activity(roles.event_transactions(spark, folder))


def _daily(spark, folder):
    return activity.daily_activity(roles.event_transactions(spark, folder))


def _ledger_daily(spark, folder):
    return activity.daily_activity(roles.ledger(spark, folder))


@query("window_counts", S.counts(EW)[1], S.with_(S.EVENTS_TRX, S.DAILY, select=S.counts(EW)[0]))
def window_counts(spark, folder):
    return activity.window_counts(_daily(spark, folder), EW)


@query("window_counts_orders", S.counts(OW)[1], S.with_(S.ORDERS_TRX, S.DAILY, select=S.counts(OW)[0]))
def _(spark, folder):
    return activity.window_counts(activity.daily_activity(roles.order_activity(spark, folder)), OW)


@query("window_counts_ledger", S.counts(Q)[1], S.with_(S.LEDGER_TRX, S.DAILY, select=S.counts(Q)[0]))
def _(spark, folder):
    return activity.window_counts(_ledger_daily(spark, folder), Q)


@query("amount_and_type_mix", S.amounts(EW)[1], S.with_(S.EVENTS_TRX, select=S.amounts(EW)[0]))
def _(spark, folder):
    return activity.amount_and_type_mix(roles.event_transactions(spark, folder), EW)


@query("amount_and_type_mix_ledger", S.amounts(Q)[1], S.with_(S.LEDGER_TRX, select=S.amounts(Q)[0]))
def _(spark, folder):
    return activity.amount_and_type_mix(roles.ledger(spark, folder), Q)


@query("gap_stats", S.gaps(EW)[1], S.with_(S.EVENTS_TRX, S.DAILY, select=S.gaps(EW)[0]))
def _(spark, folder):
    return activity.gap_stats(_daily(spark, folder), EW)


@query("gap_stats_orders", S.gaps(OW)[1], S.with_(S.ORDERS_TRX, S.DAILY, select=S.gaps(OW)[0]))
def _(spark, folder):
    return activity.gap_stats(activity.daily_activity(roles.order_activity(spark, folder)), OW)


@query("weekly_trajectory", S.weeks(Q)[1], S.with_(S.LEDGER_TRX, S.DAILY, select=S.weeks(Q)[0]))
def _(spark, folder):
    return activity.weekly_trajectory(_ledger_daily(spark, folder), Q)


@query("inbound_engagement", S.inbound(EW)[1], S.with_(S.EVENTS_TRX, select=S.inbound(EW)[0]))
def _(spark, folder):
    return network.inbound_engagement(roles.event_transactions(spark, folder), EW, exact=True)


@query(
    "inbound_approx",
    "id:i in_cnt_90d:i in_cnt_30d:i in_amt_90d:f4 in_last_d:d in_n_senders:i within_bound:i",
    S.with_(S.LEDGER_TRX, select=f"SELECT *, 1 AS within_bound FROM ({S.inbound(Q)[0]})"),
)
def _(spark, folder):
    """The sketched number of senders beside the exact one; off by five standard errors or one sender at most."""
    trx = materialize(roles.ledger(spark, folder))
    exact = network.inbound_engagement(trx, Q, exact=True)
    sketch = network.inbound_engagement(trx, Q).select("id", F.col("in_n_senders").alias("sketched"))
    gap = F.abs(F.col("sketched") - F.col("in_n_senders"))
    close = gap <= F.greatest(F.lit(1.0), 5 * 0.02 * F.col("in_n_senders"))
    return exact.join(sketch, "id").withColumn("within_bound", close.cast("int"))


@query("balance_stats", S.balance_levels(EW)[1], S.with_(S.EVENTS_TRX, S.BALANCES, select=S.balance_levels(EW)[0]))
def _(spark, folder):
    return balance.balance_stats(roles.running_balance(roles.event_transactions(spark, folder)), EW)


@query("balance_changes", S.balance_moves(EW)[1], S.with_(S.EVENTS_TRX, S.BALANCES, select=S.balance_moves(EW)[0]))
def _(spark, folder):
    return balance.balance_changes(roles.running_balance(roles.event_transactions(spark, folder)), EW)


@query("weekly_balance", S.balance_weeks(Q)[1], S.with_(S.LEDGER_TRX, S.BALANCES, select=S.balance_weeks(Q)[0]))
def _(spark, folder):
    return balance.weekly_balance(roles.running_balance(roles.ledger(spark, folder)), Q)


@query(
    "pair_recurrence",
    "s:i t:i kind:s m:i",
    S.with_(S.EVENTS_TRX, S.pairs("week"), select="SELECT * FROM pairs"),
)
def _(spark, folder):
    return network.pair_recurrence(roles.event_transactions(spark, folder), EW)


@query(
    "pair_recurrence_ledger",
    "s:i t:i kind:s m:i",
    S.with_(S.LEDGER_TRX, S.pairs("month"), select="SELECT * FROM pairs"),
)
def _(spark, folder):
    return network.pair_recurrence(roles.ledger(spark, folder), Q)


@query(
    "counterparty_breadth",
    S.breadth(3)[1],
    S.with_(S.LEDGER_TRX, S.pairs("month"), select=S.breadth(3)[0]),
)
def _(spark, folder):
    return network.counterparty_breadth(network.pair_recurrence(roles.ledger(spark, folder), Q))


@query("peer_liveness", S.peers(EW)[1], S.with_(S.EVENTS_TRX, S.DAILY, S.pairs("week"), select=S.peers(EW)[0]))
def _(spark, folder):
    trx = roles.event_transactions(spark, folder)
    counts = activity.window_counts(activity.daily_activity(trx), EW)
    return network.peer_liveness(network.pair_recurrence(trx, EW), counts, EW)


CODES = """coded AS (SELECT id, tenure_days,
  CASE WHEN "GENDER" IS NULL THEN -1 ELSE (SELECT count(DISTINCT p."GENDER") FROM profiles p WHERE p."GENDER" < k."GENDER") END AS "GENDER",
  CASE WHEN "REGION" IS NULL THEN -1 ELSE (SELECT count(DISTINCT p."REGION") FROM profiles p WHERE p."REGION" < k."REGION") END AS "REGION"
  FROM k)"""


@query(
    "tenure_and_profile",
    "id:i tenure_days:i GENDER:i REGION:i",
    S.with_(S.PROFILES, f"k AS ({S.tenure(Q)})", CODES, select="SELECT * FROM coded"),
)
def _(spark, folder):
    profiles = roles.profiles(spark, folder)
    base = assemble.tenure_and_profile(profiles, Q)
    return apply_categories(base, fit_categories(profiles, ["GENDER", "REGION"]))


@query(
    "category_dictionary",
    "o_orderkey:i code:i",
    """WITH known AS (SELECT DISTINCT o_custkey || '/' || o_orderpriority AS v FROM orders WHERE o_orderstatus <> 'P'),
      codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM known)
      SELECT o_orderkey, coalesce(code, -1) AS code FROM orders LEFT JOIN codes ON v = o_custkey || '/' || o_orderpriority""",
)
def _(spark, folder):
    value = F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority")
    orders = table(spark, folder, "orders").withColumn("code", value)
    fitted = dictionary.category_dictionary(orders.filter("o_orderstatus <> 'P'"), "code")
    return dictionary.apply_dictionary(orders, "code", fitted)


WIDE_CTES, WIDE_SPEC = S.wide(Q)


def _wide(spark, folder):
    trx = materialize(roles.ledger(spark, folder))  # a fact join, read by five aggregations
    return plan.assemble_features(
        trx, roles.running_balance(trx), roles.profiles(spark, folder), Q, exact_senders=True
    )


@query("assemble_features", WIDE_SPEC, S.with_(*WIDE_CTES, select="SELECT * FROM wide"))
def _(spark, folder):
    return _wide(spark, folder)


# ---- derived columns, recomputed in SQL from the assembled row -------------------------------------------

FILL = Q.missing_days
CUT = S.date(Q.cutoff)
_weeks = [f"coalesce(wk{i}_cnt, 0)" for i in range(13)]
_sum = " + ".join(_weeks)
_stems = list(activity.TYPE_STEMS)


def _back(column: str) -> str:
    return f"coalesce(date_diff('day', {column}, {CUT}), {FILL})"


FILLED = f"""filled AS (SELECT * REPLACE (
    {', '.join(f'coalesce(rec_{s}, {FILL}) AS rec_{s}' for s in _stems)},
    coalesce(hours_since_last, {FILL * 24}) AS hours_since_last, coalesce(gap_mean, {FILL}) AS gap_mean,
    coalesce(gap_max, {FILL}) AS gap_max, coalesce(gap_std, 0) AS gap_std,
    coalesce(gap_p90, {FILL}) AS gap_p90, coalesce(peer_avg_recency, {FILL}) AS peer_avg_recency,
    coalesce(peer_min_recency, {FILL}) AS peer_min_recency),
  {_back('last_d')} AS recency_days, {_back('first_d')} AS first_seen_days, {_back('in_last_d')} AS in_recency_days,
  {_back('bal_last_chg_d')} AS bal_stagnation_days, {_sum} AS wsum, ({_sum}) / 13.0 AS wmean
  FROM wide)"""

_entropy_w = " + ".join(
    f"CASE WHEN {x} > 0 THEN ({x} / (wsum + 1e-6)) * ln({x} / (wsum + 1e-6) + 1e-6) ELSE 0 END" for x in _weeks
)
_entropy_t = " + ".join(f"CASE WHEN share_{s} > 0 THEN share_{s} * ln(share_{s} + 1e-6) ELSE 0 END" for s in _stems)
_trailing = "CASE " + " ".join(f"WHEN {_weeks[i]} <> 0 THEN {12 - i}" for i in reversed(range(13))) + " ELSE 13 END"
_wsd = "sqrt((" + " + ".join(f"pow({x} - wmean, 2)" for x in _weeks) + ") / 13.0)"
_slope = " + ".join(f"{x} * {i - 6}" for i, x in enumerate(_weeks))

DERIVED = f"""step1 AS (SELECT *,
  least(recency_days, bal_stagnation_days) AS money_recency,
  (recency_days - gap_mean) / (gap_std + 1) AS gap_z,
  recency_days / (gap_max + 1.0) AS recency_over_maxgap, recency_days / (gap_mean + 1.0) AS recency_over_meangap,
  (coalesce(dead30_inner, 0) + greatest(greatest(91 - first_seen_days, 0) - 29, 0)) / 62.0 AS dead30_share,
  exp(-coalesce(cnt_30d, 0)) AS p_silent30_poisson,
  {_trailing} AS trailing_zero_weeks,
  ({_slope}) / (wsum + 1.0) AS wk_slope, {_weeks[12]} / (wmean + 1e-6) AS wk_last_over_mean,
  ({' + '.join(_weeks[9:])}) / ({' + '.join(_weeks[:4])} + 1.0) AS wk_last4_over_first4,
  cnt_30d / (cnt_90d / 3.0 + 1e-6) AS trend_30_90, cnt_7d / (cnt_30d * 7.0 / 30.0 + 1e-6) AS trend_7_30,
  cnt_mar / ((cnt_jan + cnt_feb) / 2.0 + 1) AS mar_over_janfeb, cnt_90d / (active_days + 1e-6) AS intensity,
  active_days_30d / 30.0 AS active_rate_30d,
  {', '.join(f'cnt_{s} / (cnt_90d + 1e-6) AS share_{s}' for s in _stems)},
  cnt_evening / (cnt_90d + 1e-6) AS evening_share, cnt_weekend / (cnt_90d + 1e-6) AS weekend_share,
  in_cnt_90d / (cnt_90d + 1.0) AS in_out_ratio, amt_std_90d / (amt_mean_90d + 1e-6) AS amt_cv,
  coalesce(amt_cashin, 0) - coalesce(amt_cashout, 0) AS net_cashflow,
  bal_last / nullif(bal_mean_90d + 1, 0) AS bal_last_over_mean, bal_last / nullif(bal_max_90d + 1, 0) AS bal_last_over_max,
  bal_mean_30d / nullif(bal_mean_jan + 1, 0) AS bal_30_over_jan, bal_chg_days_30d / 30.0 AS bal_chg_rate_30d,
  wk12_bal / nullif(wk0_bal + 1, 0) AS bal_wk12_over_wk0
  FROM filled),
step2 AS (SELECT *,
  greatest(gap_max, recency_days) AS max_silent_streak, gap_max / 30.0 AS near_churn_gap,
  CASE WHEN gap_max >= 21 THEN 1 ELSE 0 END AS ever_21d_gap, recency_days / (gap_p90 + 1.0) AS silence_over_p90gap,
  trend_7_30 - trend_30_90 AS trend_accel, bal_last / (coalesce(bal_outflow_90d, 0) / 90.0 + 1) AS days_to_zero_bal,
  -({_entropy_w}) AS wk_entropy, {_wsd} / (wmean + 1e-6) AS wk_cv,
  ({' + '.join(f'CAST({x} > 0 AS INT)' for x in _weeks)}) / 13.0 AS active_week_frac,
  gap_std / (gap_mean + 1.0) AS gap_cv, -({_entropy_t}) AS type_entropy,
  CAST(coalesce(cnt_30d, 0) = 0 AS INT) AS is_inactive_30d, CAST(coalesce(cnt_90d, 0) = 0 AS INT) AS is_inactive_90d,
  CAST(coalesce(in_cnt_90d, 0) = 0 AS INT) AS no_inflow_90d, CAST(coalesce(bal_last, 0) <= 1.0 AS INT) AS is_drained
  FROM step1)"""

RHYTHM = "recency_days first_seen_days in_recency_days bal_stagnation_days money_recency"
SCORES = "gap_z recency_over_maxgap recency_over_meangap dead30_share p_silent30_poisson"
SHAPE = "trailing_zero_weeks wk_slope wk_last_over_mean wk_last4_over_first4"
TREND = "trend_30_90 trend_7_30 mar_over_janfeb intensity active_rate_30d"
MIX = " ".join(f"share_{s}" for s in _stems) + " evening_share weekend_share in_out_ratio amt_cv net_cashflow"
BAL = "bal_last_over_mean bal_last_over_max bal_30_over_jan bal_chg_rate_30d bal_wk12_over_wk0"
CHURN = "max_silent_streak near_churn_gap ever_21d_gap silence_over_p90gap trend_accel days_to_zero_bal"
REGULAR = "wk_entropy wk_cv active_week_frac gap_cv type_entropy"
FLAGS = "is_inactive_30d is_inactive_90d no_inflow_90d is_drained"


def _register(name: str, columns: str):
    spec = "id:i " + " ".join(f"{c}:f4" for c in columns.split())

    @query(name, spec, S.with_(*WIDE_CTES, FILLED, DERIVED, select=f"SELECT id, {', '.join(columns.split())} FROM step2"))
    def _(spark, folder):
        return derived.derive_all(materialize(_wide(spark, folder)), Q)


_register("recency_and_rhythm", f"{RHYTHM} {SCORES}")
_register("trajectory_shape", SHAPE)
_register("momentum", TREND)
_register("mix_shares", MIX)
_register("balance_ratios", BAL)
_register("churn_mechanism", CHURN)
_register("regularity", REGULAR)
_register("inactivity_flags", FLAGS)

_dated = {"last_d", "first_d", "in_last_d", "bal_last_chg_d"}
_plain = [item.rsplit(":", 1)[0] for item in WIDE_SPEC.split()]
_kept = [name for name in _plain if name not in _dated and name not in ("id", "GENDER", "REGION")]
_new = f"{RHYTHM} {SCORES} {SHAPE} {TREND} {MIX} {BAL} {CHURN} {REGULAR} {FLAGS}".split()
MATRIX_COLUMNS = [*_kept, *_new, "GENDER", "REGION"]
_numbers = ", ".join(f"coalesce(CAST(s.{n} AS DOUBLE), 0) AS {n}" for n in [*_kept, *_new])
MATRIX_SQL = S.with_(
    *WIDE_CTES,
    CODES,
    FILLED,
    DERIVED,
    select=f'SELECT s.id, {_numbers}, c."GENDER", c."REGION" FROM step2 s JOIN coded c ON c.id = s.id',
)


def matrix(spark, folder):
    trx = materialize(roles.ledger(spark, folder))
    return plan.feature_matrix(
        trx, roles.running_balance(trx), roles.profiles(spark, folder), Q, exact_senders=True
    )


@query("feature_matrix", "id:i " + " ".join(f"{n}:f4" for n in MATRIX_COLUMNS), MATRIX_SQL)
def _(spark, folder):
    return matrix(spark, folder)


@query(
    "feature_null_report",
    "n_rows:i null_cells:i",
    S.with_(S.PROFILES, f"k AS ({S.tenure(Q)})", select="SELECT count(*) AS n_rows, 0 AS null_cells FROM k"),
)
def _(spark, folder):
    return assemble.null_report(matrix(spark, folder))


@query(
    "labelled_features",
    "id:i time:i event:i cnt_90d:i recency_days:i",
    S.with_(
        *WIDE_CTES,
        FILLED,
        S.OUTCOMES,
        select="""SELECT o.id, o.time, o.event, coalesce(f.cnt_90d, 0) AS cnt_90d, f.recency_days
                  FROM outcomes o LEFT JOIN filled f ON f.id = o.id""",
    ),
)
def _(spark, folder):
    labels = roles.order_outcomes(spark, folder)
    return assemble.attach_labels(labels, matrix(spark, folder).select("id", "cnt_90d", "recency_days"))


