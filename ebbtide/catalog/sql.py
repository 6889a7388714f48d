"""SQL texts shared by the oracle queries: table roles and feature tables for a given window."""

from __future__ import annotations

from ebbtide.operators.activity import TYPE_STEMS
from ebbtide.sources.roles import EVENT_TYPES, FOLLOW_UP, KINDS, LEDGER_BASE, LEDGER_END, PRIORITY_TYPES, QUARTER


def case(column: str, mapping: dict[str, str], default: str = "NULL") -> str:
    quoted = {k: v.replace("'", "''") for k, v in mapping.items()}
    arms = " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in quoted.items())
    return f"CASE {arms} ELSE {default} END"


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


EVENTS_TRX = f"""typed AS (
  SELECT user_id AS src, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS dst,
         {case('event_type', EVENT_TYPES)} AS typ, value AS amt, CAST(ts AS DATE) AS d,
         CAST(extract(hour FROM ts) AS INT) AS hr, event_id
  FROM events),
trx AS (SELECT *, {case('typ', KINDS, "'AGNT'")} AS kind FROM typed)"""

ORDERS_TRX = """trx AS (
  SELECT o_custkey AS src, o_orderpriority AS typ, o_totalprice AS amt, CAST(o_orderdate AS DATE) AS d,
         o_orderkey AS trx_id FROM orders)"""

LEDGER_TRX = f"""typed AS (
  SELECT o_custkey AS src, l_suppkey AS dst, {case('o_orderpriority', PRIORITY_TYPES)} AS typ,
         l_extendedprice AS amt,
         DATE '{QUARTER.start}' + CAST(
             (date_diff('day', DATE '{LEDGER_BASE}', CAST(l_shipdate AS DATE)) * {QUARTER.days})
             // {(LEDGER_END - LEDGER_BASE).days} AS INT) AS d,
         CAST(l_partkey % 24 AS INT) AS hr
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_shipdate < DATE '{LEDGER_END}'),
trx AS (SELECT *, {case('typ', KINDS, "'AGNT'")} AS kind FROM typed)"""

DAILY = "daily AS (SELECT src AS id, d, count(*) AS c FROM trx GROUP BY src, d)"

BALANCES = """bal AS (
  SELECT id, d, round(sum(net) OVER (PARTITION BY id ORDER BY d ROWS UNBOUNDED PRECEDING), 2) AS b
  FROM (SELECT src AS id, d, sum(CASE WHEN typ IN ('CashIn', 'P2P') THEN amt ELSE -amt END) AS net
        FROM trx GROUP BY src, d))"""

PROFILES = """profiles AS (
  SELECT c_custkey AS id, 'Customer' AS account_type, opened AS open_date, c_mktsegment AS "GENDER",
         r_name AS "REGION"
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS opened FROM orders GROUP BY 1)
    ON o_custkey = c_custkey)"""

OUTCOMES = f"""seen AS (
  SELECT o_custkey AS id, count(*) FILTER (WHERE o_orderdate < DATE '{LEDGER_END}') AS before,
         min(date_diff('day', DATE '{LEDGER_END}', CAST(o_orderdate AS DATE)))
           FILTER (WHERE o_orderdate >= DATE '{LEDGER_END}') AS wait
  FROM orders GROUP BY 1),
outcomes AS (
  SELECT id, CASE WHEN wait < {FOLLOW_UP} THEN wait ELSE {FOLLOW_UP} END AS time,
         CASE WHEN wait < {FOLLOW_UP} THEN 1 ELSE 0 END AS event
  FROM seen WHERE before > 0)"""

SCORED = """scored AS (
  SELECT l.doc_id AS id, l.quality AS y, CAST(n_chars AS DOUBLE) AS score
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def date(value) -> str:
    return f"DATE '{value}'"


def counts(w, source: str = "daily") -> tuple[str, str]:
    """SQL and column specification of the nested-window counts."""
    parts = ["id", f"sum(c) AS cnt_{w.full}"]
    parts += [f"sum(CASE WHEN d >= {date(w.since(s))} THEN c END) AS cnt_{s}" for s in w.spans]
    parts += [
        f"sum(CASE WHEN d >= {date(a)} AND d < {date(b)} THEN c END) AS cnt_{n}" for n, a, b in w.segments
    ]
    parts += [
        "max(d) AS last_d",
        "min(d) AS first_d",
        "count(*) AS active_days",
        f"count(CASE WHEN d >= {date(w.since(w.recent))} THEN 1 END) AS active_days_{w.recent}",
        "count(DISTINCT date_trunc('week', d)) AS active_weeks",
        "count(DISTINCT date_trunc('month', d)) AS n_active_months",
    ]
    spec = f"id:i cnt_{w.full}:i " + " ".join(f"cnt_{s}:i" for s in w.spans)
    spec += "".join(f" cnt_{n}:i" for n, _, _ in w.segments)
    spec += f" last_d:d first_d:d active_days:i active_days_{w.recent}:i active_weeks:i n_active_months:i"
    return f"SELECT {', '.join(parts)} FROM {source} GROUP BY id", spec


def gaps(w) -> tuple[str, str]:
    lengths = ", ".join(f"count(CASE WHEN gap >= {n} THEN 1 END) AS n_gap{n}" for n in w.gap_lengths)
    sql = f"""SELECT id, max(gap) AS gap_max, avg(gap) AS gap_mean, stddev_samp(gap) AS gap_std,
      sum(CASE WHEN gap > {w.silence} THEN gap - {w.silence} ELSE 0 END) AS dead30_inner, {lengths},
      quantile_cont(gap, 0.9) AS gap_p90
      FROM (SELECT id, date_diff('day', lag(d) OVER (PARTITION BY id ORDER BY d), d) AS gap FROM daily)
      WHERE gap IS NOT NULL GROUP BY id"""
    spec = "id:i gap_max:i gap_mean:f gap_std:f dead30_inner:i "
    return sql, spec + " ".join(f"n_gap{n}:i" for n in w.gap_lengths) + " gap_p90:f"


def weeks(w) -> tuple[str, str]:
    index = f"date_diff('day', {date(w.start)}, d) // 7"
    cols = ", ".join(f"sum(CASE WHEN wk = {i} THEN c END) AS wk{i}_cnt" for i in range(w.weeks))
    spec = "id:i " + " ".join(f"wk{i}_cnt:i" for i in range(w.weeks))
    return f"SELECT id, {cols} FROM (SELECT id, c, {index} AS wk FROM daily) GROUP BY id", spec


def amounts(w) -> tuple[str, str]:
    recent = f"d >= {date(w.since(w.recent))}"
    cut = date(w.cutoff)
    cols = [
        "src AS id",
        f"min(date_diff('day', d, {cut}) * 24 - hr) AS hours_since_last",
        f"sum(amt) AS amt_sum_{w.full}",
        f"avg(amt) AS amt_mean_{w.full}",
        f"stddev_samp(amt) AS amt_std_{w.full}",
        f"max(amt) AS amt_max_{w.full}",
        f"sum(CASE WHEN {recent} THEN amt END) AS amt_sum_{w.recent}",
        f"avg(CASE WHEN {recent} THEN amt END) AS amt_mean_{w.recent}",
    ]
    spec = (
        f"id:i hours_since_last:i amt_sum_{w.full}:f4 amt_mean_{w.full}:f4 amt_std_{w.full}:f4 "
        f"amt_max_{w.full}:f4 amt_sum_{w.recent}:f4 amt_mean_{w.recent}:f4"
    )
    for stem, name in TYPE_STEMS.items():
        cols.append(f"count(CASE WHEN typ = '{name}' THEN 1 END) AS cnt_{stem}")
        cols.append(f"count(CASE WHEN typ = '{name}' AND {recent} THEN 1 END) AS cnt_{stem}_{w.recent}")
        cols.append(f"date_diff('day', max(CASE WHEN typ = '{name}' THEN d END), {cut}) AS rec_{stem}")
        spec += f" cnt_{stem}:i cnt_{stem}_{w.recent}:i rec_{stem}:i"
    cols += [
        "sum(CASE WHEN typ = 'CashIn' THEN amt END) AS amt_cashin",
        "sum(CASE WHEN typ = 'CashOut' THEN amt END) AS amt_cashout",
        "count(CASE WHEN hr >= 18 THEN 1 END) AS cnt_evening",
        "count(CASE WHEN dayofweek(d) IN (0, 6) THEN 1 END) AS cnt_weekend",
    ]
    spec += " amt_cashin:f4 amt_cashout:f4 cnt_evening:i cnt_weekend:i"
    return f"SELECT {', '.join(cols)} FROM trx GROUP BY src", spec


def inbound(w) -> tuple[str, str]:
    sql = f"""SELECT dst AS id, count(*) AS in_cnt_{w.full},
      count(CASE WHEN d >= {date(w.since(w.recent))} THEN 1 END) AS in_cnt_{w.recent},
      sum(amt) AS in_amt_{w.full}, max(d) AS in_last_d, count(DISTINCT src) AS in_n_senders
      FROM trx WHERE typ = 'P2P' AND src <> dst GROUP BY dst"""
    return sql, f"id:i in_cnt_{w.full}:i in_cnt_{w.recent}:i in_amt_{w.full}:f4 in_last_d:d in_n_senders:i"


def balance_levels(w) -> tuple[str, str]:
    recent, short = f"d >= {date(w.since(w.recent))}", f"d >= {date(w.since(w.short))}"
    name, a, b = w.segments[0]
    sql = f"""SELECT id, arg_max(b, d) AS bal_last, avg(b) AS bal_mean_{w.full}, stddev_samp(b) AS bal_std_{w.full},
      min(b) AS bal_min_{w.full}, max(b) AS bal_max_{w.full},
      avg(CASE WHEN {recent} THEN b END) AS bal_mean_{w.recent},
      stddev_samp(CASE WHEN {recent} THEN b END) AS bal_std_{w.recent},
      avg(CASE WHEN d >= {date(a)} AND d < {date(b)} THEN b END) AS bal_mean_{name},
      avg(CASE WHEN {short} THEN b END) AS bal_mean_{w.short},
      count(CASE WHEN b <= 1.0 THEN 1 END) AS zero_bal_days_{w.full},
      count(CASE WHEN b <= 1.0 AND {recent} THEN 1 END) AS zero_bal_days_{w.recent},
      count(CASE WHEN b <= 1.0 AND {short} THEN 1 END) AS zero_bal_days_{w.short},
      regr_slope(b, date_diff('day', {date(w.start)}, d)) AS bal_slope
      FROM bal GROUP BY id"""
    spec = (
        f"id:i bal_last:f4 bal_mean_{w.full}:f4 bal_std_{w.full}:f4 bal_min_{w.full}:f4 bal_max_{w.full}:f4 "
        f"bal_mean_{w.recent}:f4 bal_std_{w.recent}:f4 bal_mean_{name}:f4 bal_mean_{w.short}:f4 "
        f"zero_bal_days_{w.full}:i zero_bal_days_{w.recent}:i zero_bal_days_{w.short}:i bal_slope:f4"
    )
    return sql, spec


def balance_moves(w) -> tuple[str, str]:
    sql = f"""SELECT id, max(CASE WHEN diff <> 0 THEN d END) AS bal_last_chg_d,
      count(CASE WHEN diff <> 0 AND d >= {date(w.since(w.recent))} THEN 1 END) AS bal_chg_days_{w.recent},
      count(CASE WHEN diff <> 0 THEN 1 END) AS bal_chg_days_{w.full},
      stddev_samp(diff) AS bal_diff_std, avg(abs(diff)) AS bal_diff_absmean,
      sum(CASE WHEN diff < 0 THEN -diff ELSE 0 END) AS bal_outflow_{w.full}
      FROM (SELECT id, d, b - lag(b) OVER (PARTITION BY id ORDER BY d) AS diff FROM bal) GROUP BY id"""
    spec = (
        f"id:i bal_last_chg_d:d bal_chg_days_{w.recent}:i bal_chg_days_{w.full}:i bal_diff_std:f4 "
        f"bal_diff_absmean:f4 bal_outflow_{w.full}:f4"
    )
    return sql, spec


def balance_weeks(w) -> tuple[str, str]:
    index = f"date_diff('day', {date(w.start)}, d) // 7"
    cols = ", ".join(f"avg(CASE WHEN {index} = {i} THEN b END) AS wk{i}_bal" for i in w.balance_weeks)
    return f"SELECT id, {cols} FROM bal GROUP BY id", "id:i " + " ".join(f"wk{i}_bal:f4" for i in w.balance_weeks)


def pairs(unit: str) -> str:
    return f"""pairs AS (SELECT s, t, kind, count(*) AS m FROM (
      SELECT DISTINCT src AS s, dst AS t, kind, date_trunc('{unit}', d) AS u FROM trx) GROUP BY s, t, kind)"""


def breadth(most: int) -> tuple[str, str]:
    sql = f"""SELECT s AS id, count(*) AS n_counterparties,
      count(CASE WHEN kind = 'MRCH' THEN 1 END) AS n_merchants,
      count(CASE WHEN kind = 'CUST' AND s <> t THEN 1 END) AS n_p2p_peers,
      count(CASE WHEN m = {most} THEN 1 END) AS n_recur3_all, count(CASE WHEN m >= 2 THEN 1 END) AS n_recur2_all,
      count(CASE WHEN m = {most} AND kind = 'BILL' THEN 1 END) AS n_recur3_bill,
      count(CASE WHEN m = {most} AND kind = 'MRCH' THEN 1 END) AS n_recur3_mrch,
      count(CASE WHEN m = {most} AND kind = 'CUST' AND s <> t THEN 1 END) AS n_recur3_p2p
      FROM pairs GROUP BY s"""
    spec = (
        "id:i n_counterparties:i n_merchants:i n_p2p_peers:i n_recur3_all:i n_recur2_all:i n_recur3_bill:i "
        "n_recur3_mrch:i n_recur3_p2p:i"
    )
    return sql, spec


def peers(w) -> tuple[str, str]:
    recency = f"date_diff('day', n.last_d, {date(w.cutoff)})"
    sql = f"""SELECT e.a AS id, count(*) AS n_peers_2way, avg(n.cnt) AS peer_avg_cnt30,
      avg({recency}) AS peer_avg_recency, min({recency}) AS peer_min_recency, max(n.cnt) AS peer_max_cnt30
      FROM (SELECT s AS a, t AS p FROM pairs WHERE kind = 'CUST' AND s <> t
            UNION SELECT t, s FROM pairs WHERE kind = 'CUST' AND s <> t) e
      JOIN (SELECT id, max(d) AS last_d, sum(CASE WHEN d >= {date(w.since(w.recent))} THEN c END) AS cnt
            FROM daily GROUP BY id) n ON n.id = e.p
      GROUP BY e.a"""
    return sql, "id:i n_peers_2way:i peer_avg_cnt30:f peer_avg_recency:f peer_min_recency:i peer_max_cnt30:i"


def tenure(w) -> str:
    return f"""SELECT id, date_diff('day', open_date, {date(w.cutoff)}) AS tenure_days, "GENDER", "REGION"
      FROM profiles WHERE account_type = 'Customer'"""


def wide(w) -> tuple[list[str], str]:
    """CTEs of the assembled feature row (named ``wide``) and its specification."""
    most = w.units(w.recurrence_unit)
    parts = {
        "f_cnt": counts(w),
        "f_gap": gaps(w),
        "f_wk": weeks(w),
        "f_amt": amounts(w),
        "f_in": inbound(w),
        "f_bal": balance_levels(w),
        "f_chg": balance_moves(w),
        "f_wkb": balance_weeks(w),
        "f_net": breadth(most),
        "f_peer": peers(w),
    }
    ctes = [LEDGER_TRX, DAILY, BALANCES, PROFILES, pairs(w.recurrence_unit), f"k AS ({tenure(w)})"]
    ctes += [f"{name} AS ({sql})" for name, (sql, _) in parts.items()]
    stars = ", ".join(f"{name}.* EXCLUDE (id)" for name in parts)
    joins = " ".join(f"LEFT JOIN {name} ON {name}.id = k.id" for name in parts)
    ctes.append(f"wide AS (SELECT k.*, {stars} FROM k {joins})")
    spec = "id:i tenure_days:i GENDER:s REGION:s " + " ".join(s.removeprefix("id:i ") for _, s in parts.values())
    return ctes, spec
