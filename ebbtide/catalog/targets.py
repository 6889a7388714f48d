"""Queries over labels, leakage audits, non-parametric survival, metrics and decisions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ebbtide.catalog import sql as S
from ebbtide.catalog.registry import query
from ebbtide.functions.columns import hex_suffix_key
from ebbtide.operators import activity, audit, blend, decisions, km, labels, metrics, ranks
from ebbtide.session import materialize
from ebbtide.sources import roles
from ebbtide.sources.tables import table

CUT = date(2024, 1, 15)

# ---- labels ------------------------------------------------------------------------------------------------------


def _silence_sql(k: int, t_max: int) -> str:
    end = f"DATE '{CUT}' + {t_max + k - 1}"
    return S.with_(
        S.EVENTS_TRX,
        S.DAILY,
        f"ids AS (SELECT DISTINCT id FROM daily WHERE d < DATE '{CUT}')",
        f"""days AS (SELECT id, DATE '{CUT}' - 1 AS d FROM ids UNION ALL
             SELECT id, d FROM daily WHERE d >= DATE '{CUT}' AND d < {end} AND id IN (SELECT id FROM ids))""",
        f"runs AS (SELECT id, d, coalesce(lead(d) OVER (PARTITION BY id ORDER BY d), {end}) AS nxt FROM days)",
        f"""firsts AS (SELECT id, min(CASE WHEN date_diff('day', d, nxt) - 1 >= {k}
             THEN date_diff('day', DATE '{CUT}', d) + 1 END) AS s FROM runs GROUP BY id)""",
        select=f"""SELECT id, CASE WHEN s < {t_max} THEN s ELSE {t_max} END AS time,
                   CASE WHEN s < {t_max} THEN 1 ELSE 0 END AS event FROM firsts""",
    )


def _silence(spark, folder, k, t_max):
    daily = activity.daily_activity(roles.event_transactions(spark, folder))
    ids = daily.filter(F.col("d") < F.lit(CUT)).select("id").distinct()
    return labels.silence_label(daily, ids, CUT, k, t_max)


@query("label_silence", "id:i time:i event:i", _silence_sql(2, 15))
def _(spark, folder):
    return _silence(spark, folder, 2, 15)


@query("label_silence_1", "id:i time:i event:i", _silence_sql(1, 16))
def _(spark, folder):
    return _silence(spark, folder, 1, 16)


@query(
    "label_inactivity",
    "id:i churn:i",
    """SELECT c_custkey AS id, CASE WHEN n IS NULL THEN 1 ELSE 0 END AS churn FROM customer LEFT JOIN
       (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= DATE '2000-08-01' AND o_orderdate < DATE '2000-08-31'
        GROUP BY 1) ON o_custkey = c_custkey""",
)
def _(spark, folder):
    daily = activity.daily_activity(roles.order_activity(spark, folder))
    ids = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    return labels.inactivity_label(daily, ids, roles.LEDGER_END, 30)


@query("order_outcomes", "id:i time:i event:i", S.with_(S.OUTCOMES, select="SELECT * FROM outcomes"))
def outcomes(spark, folder):
    return roles.order_outcomes(spark, folder)


@query(
    "label_horizons",
    "id:i surv_30:i surv_60:i surv_90:i",
    S.with_(
        S.OUTCOMES,
        select="""SELECT id, CAST(time > 30 AS INT) AS surv_30, CAST(time > 60 AS INT) AS surv_60,
                  CAST(time > 90 AS INT) AS surv_90 FROM outcomes""",
    ),
)
def _(spark, folder):
    return labels.horizon_labels(outcomes(spark, folder))


@query(
    "base_survival",
    "event_rate:f surv_30:f surv_60:f surv_90:f",
    S.with_(
        S.OUTCOMES,
        select="""SELECT avg(event) AS event_rate, avg(CAST(time > 30 AS INT)) AS surv_30,
                  avg(CAST(time > 60 AS INT)) AS surv_60, avg(CAST(time > 90 AS INT)) AS surv_90 FROM outcomes""",
    ),
)
def _(spark, folder):
    return labels.base_survival(outcomes(spark, folder))


RANDOM_CENSOR = "outcomes AS (SELECT id, least(time, 20 + id % 80) AS time, CASE WHEN time <= 20 + id % 80 THEN event ELSE 0 END AS event FROM o)"
MIXED = S.OUTCOMES.replace("outcomes AS (", "o AS (") + ",\n" + RANDOM_CENSOR


def mixed_outcomes(spark, folder):
    """Order outcomes with an additional staggered end of observation, so that censoring is spread."""
    limit = F.lit(20) + F.col("id") % 80
    seen = (F.col("time") <= limit) & (F.col("event") == 1)
    return outcomes(spark, folder).select("id", F.least("time", limit).cast("int").alias("time"), seen.cast("int").alias("event"))


@query(
    "label_known_by_horizon",
    "id:i label:i",
    S.with_(
        MIXED,
        select="SELECT id, CASE WHEN time <= 60 THEN 1 ELSE 0 END AS label FROM outcomes WHERE time > 60 OR event = 1",
    ),
)
def _(spark, folder):
    return labels.known_by_horizon(mixed_outcomes(spark, folder), 60)


@query(
    "unknown_share",
    "n:i known:i dropped_share:f events:i",
    S.with_(
        MIXED,
        select="""SELECT count(*) AS n, count(*) FILTER (WHERE time > 60 OR event = 1) AS known,
          1 - count(*) FILTER (WHERE time > 60 OR event = 1) / CAST(count(*) AS DOUBLE) AS dropped_share,
          count(*) FILTER (WHERE time <= 60 AND event = 1) AS events FROM outcomes""",
    ),
)
def _(spark, folder):
    return labels.unknown_share(mixed_outcomes(spark, folder), 60)


@query(
    "censor_check",
    "censored:i censored_at_end:i in_range:i",
    S.with_(
        S.OUTCOMES,
        select="""SELECT count(*) FILTER (WHERE event = 0) AS censored, min(CAST(event = 1 OR time = 91 AS INT)) AS censored_at_end,
          min(CAST(time BETWEEN 0 AND 91 AS INT)) AS in_range FROM outcomes""",
    ),
)
def _(spark, folder):
    return labels.censoring_check(outcomes(spark, folder), 91)


@query(
    "follow_up_summary",
    "n:i event_rate:f censoring_rate:f min_time:f median_time:f max_time:f",
    S.with_(
        MIXED,
        select="""SELECT count(*) AS n, avg(event) AS event_rate, 1 - avg(event) AS censoring_rate, min(time) AS min_time,
          quantile_cont(time, 0.5) AS median_time, max(time) AS max_time FROM outcomes""",
    ),
)
def _(spark, folder):
    return labels.follow_up_summary(mixed_outcomes(spark, folder))


@query(
    "id_overlap",
    "n:i shared:i share:f",
    """SELECT count(*) AS n, count(u) AS shared, count(u) / CAST(count(*) AS DOUBLE) AS share
       FROM (SELECT DISTINCT o_custkey AS id FROM orders) LEFT JOIN (SELECT DISTINCT user_id AS u FROM events) ON u = id""",
)
def _(spark, folder):
    left = table(spark, folder, "orders").select(F.col("o_custkey").alias("id"))
    return labels.id_overlap(left, table(spark, folder, "events").select(F.col("user_id").alias("id")))


# ---- audits --------------------------------------------------------------------------------------------------------


def _corr_sql(src: str, time: str, number: str) -> str:
    return f"""SELECT corr(r, number) AS corr FROM (SELECT {number} AS number,
      rank() OVER (ORDER BY {time}) + (count(*) OVER (PARTITION BY {time}) - 1) / 2.0 AS r FROM {src})"""


def _mono_sql(src: str, entity: str, time: str, number: str) -> str:
    return f"""SELECT count(*) AS entities, avg(share) AS mono FROM (
      SELECT e, count(*) AS n, avg(CAST(number > prev AS INT)) AS share FROM (
        SELECT {entity} AS e, {number} AS number, lag({number}) OVER (PARTITION BY {entity} ORDER BY {time}, {number}) AS prev
        FROM {src}) GROUP BY e) WHERE n >= 3"""


def _events_clock(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("clock")
    )


def _orders_clock(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).alias("clock")
    )


@query("id_time_corr_events", "corr:f", _corr_sql("events", "ts", "event_id"))
def _(spark, folder):
    return audit.id_time_correlation(_events_clock(spark, folder), "clock", "event_id", ["event_id"])


@query("id_time_corr_orders", "corr:f", _corr_sql("orders", "o_orderdate", "o_orderkey"))
def _(spark, folder):
    return audit.id_time_correlation(_orders_clock(spark, folder), "clock", "o_orderkey", ["o_orderkey"])


@query("id_monotone_events", "entities:i mono:f", _mono_sql("events", "user_id", "ts", "event_id"))
def _(spark, folder):
    return audit.id_monotone_share(_events_clock(spark, folder), "user_id", "clock", "event_id")


@query("id_monotone_orders", "entities:i mono:f", _mono_sql("orders", "o_custkey", "o_orderdate", "o_orderkey"))
def _(spark, folder):
    return audit.id_monotone_share(_orders_clock(spark, folder), "o_custkey", "clock", "o_orderkey")


def _verdict_sql(src, entity, time, number):
    return (
        f"SELECT corr, mono, CAST(abs(corr) > 0.3 AND mono > 0.9 AS INT) AS leak FROM ({_corr_sql(src, time, number)}), "
        f"({_mono_sql(src, entity, time, number)})"
    )


@query("leak_verdict_events", "corr:f mono:f leak:i", _verdict_sql("events", "user_id", "ts", "event_id"))
def _(spark, folder):
    return audit.leak_verdict(_events_clock(spark, folder), "user_id", "clock", "event_id", ["event_id"])


@query("leak_verdict_orders", "corr:f mono:f leak:i", _verdict_sql("orders", "o_custkey", "o_orderdate", "o_orderkey"))
def _(spark, folder):
    return audit.leak_verdict(_orders_clock(spark, folder), "o_custkey", "clock", "o_orderkey", ["o_orderkey"])


def _blocks_sql(entity: str, number: str, source: str) -> str:
    """Holes are the gaps between an entity's ordered numbers; what is hidden ends where the next span starts."""
    return f"""steps AS (SELECT {entity} AS id, {number} AS x, {number} - lag({number}) OVER (PARTITION BY {entity} ORDER BY {number}) - 1 AS gap
    FROM {source}),
  spans AS (SELECT id, min(x) AS fid, max(x) AS lid, count(x) AS n, CAST(coalesce(sum(gap), 0) AS BIGINT) AS internal_holes FROM steps GROUP BY id),
  placed AS (SELECT *, row_number() OVER (ORDER BY fid, id) AS place, max(lid) OVER () + 1 AS past FROM spans),
  blocks AS (SELECT a.id, a.fid, a.lid, a.n, CASE WHEN b.id IS NULL THEN a.past ELSE b.fid END - (a.lid + 1) AS hidden, a.internal_holes
    FROM placed a LEFT JOIN placed b ON b.place = a.place + 1)"""


BLOCKS = _blocks_sql("l_orderkey", "l_orderkey * 7 + l_linenumber", "lineitem")


def _line_blocks(spark, folder):
    numbers = table(spark, folder, "lineitem").select(
        "l_orderkey", (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("number")
    )
    return audit.id_blocks(numbers, "l_orderkey", "number")


@query(
    "id_blocks",
    "id:i fid:i lid:i n:i hidden:i internal_holes:i",
    S.with_(BLOCKS, select="SELECT * FROM blocks"),
)
def _(spark, folder):
    return _line_blocks(spark, folder)


@query(
    "id_contiguity",
    "blocks:i contiguous_share:f valid:i",
    S.with_(
        _blocks_sql("o_custkey", "o_orderkey", "orders"),
        select="""SELECT count(*) AS blocks, avg(CAST(internal_holes = 0 AS INT)) AS contiguous_share,
                  min(CAST(internal_holes = 0 AND hidden >= 0 AS INT)) AS valid FROM blocks""",
    ),
)
def _(spark, folder):
    return audit.contiguity_test(audit.id_blocks(table(spark, folder, "orders"), "o_custkey", "o_orderkey"))


# Identifiers of 32 digits: the order key in the upper 64 bits, a number from the order's customer in the lower ones.
LONG_ID = "CAST(o_orderkey AS HUGEINT) * 18446744073709551616 + (o_custkey * 7919) % 100003"
LONG_ORDERS = f"long_orders AS (SELECT o_custkey, o_orderdate, {LONG_ID} AS number FROM orders)"


def _long_ids(spark, folder):
    digits = lambda value: F.lpad(F.hex(value), 16, "0")
    text = F.concat(digits(F.col("o_orderkey").cast("long")), digits(F.col("o_custkey").cast("long") * 7919 % 100003))
    keys = _orders_clock(spark, folder).withColumn("number", hex_suffix_key(text))
    return keys.select("o_custkey", "clock", "number", "o_orderkey")


@query(
    "id_monotone_long",
    "entities:i mono:f",
    S.with_(LONG_ORDERS, select=_mono_sql("long_orders", "o_custkey", "o_orderdate", "number")),
)
def _(spark, folder):
    return audit.id_monotone_share(_long_ids(spark, folder), "o_custkey", "clock", "number")


@query(
    "leak_verdict_long",
    "corr:f mono:f leak:i",
    S.with_(LONG_ORDERS, select=_verdict_sql("long_orders", "o_custkey", "o_orderdate", "number")),
)
def _(spark, folder):
    return audit.leak_verdict(_long_ids(spark, folder), "o_custkey", "clock", "number", ["o_orderkey"])


def _long_blocks_sql() -> str:
    """As ``_blocks_sql``, all counts 128-bit integers."""
    return _blocks_sql("o_custkey", "number", "long_orders").replace("AS BIGINT", "AS HUGEINT")


@query(
    "id_blocks_long",
    "id:i n:i fid:s lid:s hidden:s internal_holes:s",
    S.with_(
        LONG_ORDERS,
        _long_blocks_sql(),
        select="""SELECT id, n, lpad(lower(hex(fid)), 64, '0') AS fid, lpad(lower(hex(lid)), 64, '0') AS lid, hidden, internal_holes
                  FROM blocks""",
    ),
)
def _(spark, folder):
    return audit.id_blocks(_long_ids(spark, folder), "o_custkey", "number")


LABELLED = "lab AS (SELECT o_orderkey AS id, CAST(o_totalprice > 250000 AS INT) AS label FROM orders)"


def _order_labels(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice") > 250000).cast("int").alias("label")
    )


@query(
    "hidden_confusion",
    "none_hidden:i label:i n:i",
    S.with_(
        BLOCKS,
        LABELLED,
        select="""SELECT CAST(hidden = 0 AS INT) AS none_hidden, label, count(*) AS n FROM lab JOIN blocks USING (id)
                  GROUP BY 1, 2""",
    ),
)
def _(spark, folder):
    return audit.hidden_confusion(_line_blocks(spark, folder), _order_labels(spark, folder))


def _auc_sql(src: str, score: str, label: str) -> str:
    return f"""SELECT (sum(CASE WHEN l = 1 THEN r END) - sum(l) * (sum(l) + 1) / 2.0) / (sum(l) * sum(1 - l)) AS auc FROM (
      SELECT {label} AS l, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS r FROM {src})"""


@query(
    "hidden_auc",
    "auc:f",
    S.with_(BLOCKS, LABELLED, "j AS (SELECT -hidden AS s, label FROM lab JOIN blocks USING (id))", select=_auc_sql("j", "s", "label")),
)
def _(spark, folder):
    joined = _order_labels(spark, folder).join(_line_blocks(spark, folder), "id")
    return metrics.auc(joined.withColumn("s", -F.col("hidden")), "s", "label")


@query(
    "event_rate_by_bin",
    "bin:s size:i mean:f",
    S.with_(
        BLOCKS,
        LABELLED,
        select="""SELECT CASE WHEN hidden <= 1 THEN '(0, 1]' WHEN hidden <= 2 THEN '(1, 2]' WHEN hidden <= 3 THEN '(2, 3]'
          WHEN hidden <= 5 THEN '(3, 5]' WHEN hidden <= 8 THEN '(5, 8]' WHEN hidden <= 13 THEN '(8, 13]'
          WHEN hidden <= 21 THEN '(13, 21]' WHEN hidden <= 34 THEN '(21, 34]' WHEN hidden <= 55 THEN '(34, 55]'
          ELSE '(55, inf]' END AS bin, count(*) AS size, avg(label) AS mean
          FROM lab JOIN blocks USING (id) WHERE hidden > 0 GROUP BY 1""",
    ),
)
def _(spark, folder):
    joined = _order_labels(spark, folder).join(_line_blocks(spark, folder), "id")
    return audit.rate_by_bin(joined, "hidden", "label")


# ---- ranks, lift and thresholds ---------------------------------------------------------------------------------------


@query(
    "average_rank",
    "id:i score:f r:f",
    S.with_(
        S.SCORED,
        select="""SELECT id, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r
                  FROM scored""",
    ),
)
def _(spark, folder):
    return ranks.average_rank(roles.scored_documents(spark, folder), "score", "r", ["id"])


@query(
    "average_rank_lines",
    "l_quantity:f r:f n:i",
    """SELECT l_quantity, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r,
       count(*) OVER (PARTITION BY l_quantity) AS n FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_quantity) = 1""",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    ranked = ranks.average_rank(lines, "l_quantity", "r", ["l_orderkey", "l_linenumber"])
    return ranked.groupBy("l_quantity").agg(F.max("r").alias("r"), F.count(F.lit(1)).alias("n"))


DECILED = """ranked AS (SELECT *, row_number() OVER (ORDER BY score, md5('0|' || id)) AS r, count(*) OVER () AS n FROM scored),
  dec AS (SELECT *, CAST(11 - greatest(1, ceil((r - 1) * 10 / CAST(n - 1 AS DOUBLE))) AS INT) AS decile FROM ranked)"""
LIFT = """lift AS (SELECT decile, count(*) AS customers, sum(y) AS churners, avg(y) AS churn_rate FROM dec GROUP BY decile)"""
LIFTED = """lifted AS (SELECT *, churn_rate / (SELECT avg(y) FROM scored) AS lift,
  sum(churners) OVER (ORDER BY decile) / CAST((SELECT sum(y) FROM scored) AS DOUBLE) AS cum_recall,
  100.0 * sum(customers) OVER (ORDER BY decile) / (SELECT count(*) FROM scored) AS targeted FROM lift)"""


@query("deciles", "id:i decile:i", S.with_(S.SCORED, DECILED, select="SELECT id, decile FROM dec"))
def _(spark, folder):
    return decisions.deciles(roles.scored_documents(spark, folder), "score", ["id"])


def _lift(spark, folder):
    return decisions.lift_table(roles.scored_documents(spark, folder), "score", "y", ["id"])


@query(
    "lift_table",
    "decile:i customers:i churners:i churn_rate:f lift:f cum_recall:f",
    S.with_(S.SCORED, DECILED, LIFT, LIFTED, select="SELECT * FROM lifted"),
)
def _(spark, folder):
    return _lift(spark, folder)


@query(
    "gains_curve",
    "decile:i targeted:f captured:f",
    S.with_(S.SCORED, DECILED, LIFT, LIFTED, select="SELECT decile, targeted, 100 * cum_recall AS captured FROM lifted"),
)
def _(spark, folder):
    return decisions.gains_curve(_lift(spark, folder))


@query(
    "campaign_value",
    "decile:i customers:i churners:i saved:f spent:f net:f",
    S.with_(
        S.SCORED,
        DECILED,
        LIFT,
        select="""SELECT decile, customers, churners, churners * 150.0 AS saved, customers * 20.0 AS spent,
                  churners * 150.0 - customers * 20.0 AS net FROM lift""",
    ),
)
def _(spark, folder):
    return decisions.campaign_value(_lift(spark, folder))


TOP = "top AS (SELECT * FROM scored ORDER BY score DESC, md5('0|' || id) LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.1) AS INT)) FROM scored))"


@query("top_fraction", "id:i score:f", S.with_(S.SCORED, TOP, select="SELECT id, score FROM top"))
def _(spark, folder):
    return decisions.top_fraction(roles.scored_documents(spark, folder), "score", ["id"])


@query(
    "top_capture",
    "targeted:i hits:i precision:f recall:f lift:f",
    S.with_(
        S.SCORED,
        TOP,
        select="""SELECT count(*) AS targeted, sum(y) AS hits, avg(y) AS precision,
          sum(y) / CAST((SELECT sum(y) FROM scored) AS DOUBLE) AS recall, avg(y) / (SELECT avg(y) FROM scored) AS lift FROM top""",
    ),
)
def _(spark, folder):
    return decisions.top_capture(roles.scored_documents(spark, folder), "score", "y", ["id"])


@query("auc", "auc:f", S.with_(S.SCORED, select=_auc_sql("scored", "score", "y")))
def _(spark, folder):
    return metrics.auc(roles.scored_documents(spark, folder), "score", "y")


@query(
    "auc_lines",
    "auc:f",
    S.with_(
        "l AS (SELECT l_extendedprice AS s, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem)", select=_auc_sql("l", "s", "y")
    ),
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y")
    )
    return metrics.auc(lines, "s", "y")


AP = """hist AS (SELECT score, sum(y) AS pos, count(*) AS n FROM scored GROUP BY score),
  run AS (SELECT pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM hist WINDOW w AS (ORDER BY score DESC))"""
AP_SELECT = "SELECT sum(pos * cp / CAST(cn AS DOUBLE)) / (SELECT sum(y) FROM scored) AS ap FROM run"


@query("average_precision", "ap:f", S.with_(S.SCORED, AP, select=AP_SELECT))
def _(spark, folder):
    return metrics.average_precision(roles.scored_documents(spark, folder), "score", "y")


@query(
    "classifier_metrics",
    "auc:f ap:f p_at_10:f r_at_10:f",
    S.with_(
        S.SCORED,
        AP,
        TOP,
        select=f"""SELECT ({_auc_sql('scored', 'score', 'y')}) AS auc, ({AP_SELECT}) AS ap, avg(y) AS p_at_10,
          sum(y) / CAST((SELECT sum(y) FROM scored) AS DOUBLE) AS r_at_10 FROM top""",
    ),
)
def _(spark, folder):
    return metrics.classifier_metrics(roles.scored_documents(spark, folder), "score", "y", ["id"])


# ---- survival probabilities, risks and concordance -------------------------------------------------------------------

# a transparent score: order history before the cutoff turned into survival probabilities and a risk
HISTORY = f"""history AS (SELECT o_custkey AS id, count(*) AS orders,
    date_diff('day', max(CAST(o_orderdate AS DATE)), DATE '{roles.LEDGER_END}') AS recency
  FROM orders WHERE o_orderdate < DATE '{roles.LEDGER_END}' GROUP BY 1)"""
PROBABILITIES = """scores AS (SELECT o.id, o.time, o.event, exp(-h.orders / 60.0) AS s30, exp(-h.orders / 30.0) AS s60,
    exp(-h.orders / 20.0) AS s90, CAST(h.orders AS DOUBLE) AS risk, h.recency AS recency
  FROM outcomes o JOIN history h ON h.id = o.id)"""


def history(spark, folder):
    day, end = F.to_date("o_orderdate"), F.lit(roles.LEDGER_END)
    return (
        table(spark, folder, "orders")
        .filter(F.col("o_orderdate") < end)
        .groupBy(F.col("o_custkey").alias("id"))
        .agg(F.count(F.lit(1)).alias("orders"), F.datediff(end, F.max(day)).alias("recency"))
    )


def survival_scores(spark, folder, base=outcomes):
    joined = base(spark, folder).join(history(spark, folder), "id")
    return joined.select(
        "id",
        "time",
        "event",
        F.exp(-F.col("orders") / 60.0).alias("s30"),
        F.exp(-F.col("orders") / 30.0).alias("s60"),
        F.exp(-F.col("orders") / 20.0).alias("s90"),
        F.col("orders").cast("double").alias("risk"),
        "recency",
    )


BRIER = ", ".join(f"avg(pow(CAST(time > {h} AS INT) - s{h}, 2)) AS brier_{h}" for h in (30, 60, 90))


@query(
    "brier_scores",
    "brier_30:f brier_60:f brier_90:f ibs:f",
    S.with_(
        S.OUTCOMES,
        HISTORY,
        PROBABILITIES,
        f"b AS (SELECT {BRIER} FROM scores)",
        select="SELECT *, (brier_30 + 2 * brier_60 + brier_90) / 4 AS ibs FROM b",
    ),
)
def _(spark, folder):
    scored = survival_scores(spark, folder)
    return metrics.integrated(metrics.brier(scored, (30, 60, 90), ("s30", "s60", "s90")), (30, 60, 90))


def _concordance_sql(extra: str = "") -> str:
    return f"""SELECT sum(CAST(a.risk > b.risk AS INT)) AS concordant, sum(CAST(a.risk = b.risk AS INT)) AS tied_risk,
      count(*) AS comparable, (sum(CAST(a.risk > b.risk AS INT)) + sum(CAST(a.risk = b.risk AS INT)) / 2.0) / count(*) AS c_index
      FROM scores a JOIN scores b ON b.time > a.time {extra} WHERE a.event = 1"""


@query(
    "c_index",
    "concordant:i tied_risk:i comparable:i c_index:f",
    S.with_(S.OUTCOMES, HISTORY, PROBABILITIES, select=_concordance_sql()),
)
def _(spark, folder):
    return metrics.concordance(survival_scores(spark, folder), "risk")


@query(
    "c_index_tied_times",
    "concordant:i tied_risk:i comparable:i c_index:f",
    S.with_(MIXED, HISTORY, PROBABILITIES, select=_concordance_sql("OR (b.time = a.time AND b.event = 0)")),
)
def _(spark, folder):
    return metrics.concordance(survival_scores(spark, folder, mixed_outcomes), "risk", tied_times=True)


@query(
    "c_index_sampled",
    "c_index:f within_bound:i",
    S.with_(S.OUTCOMES, HISTORY, PROBABILITIES, select=f"SELECT c_index, 1 AS within_bound FROM ({_concordance_sql()})"),
)
def _(spark, folder):
    """The exact index, and whether the one of three million drawn pairs is within 0.005 of it."""
    scored = materialize(survival_scores(spark, folder))
    exact = metrics.concordance(scored, "risk").select("c_index")
    sampled = metrics.sampled_concordance(scored, "risk", ["id"]).select("c_index").scalar()
    return exact.withColumn("within_bound", (F.abs(F.col("c_index") - sampled) <= 0.005).cast("int"))


COMP = """c AS (SELECT c_index FROM (%s)), i AS (SELECT (brier_30 + 2 * brier_60 + brier_90) / 4 AS ibs FROM (SELECT %s FROM scores))""" % (
    _concordance_sql(),
    BRIER,
)


@query(
    "scorecard",
    "metric:s value:f points:f",
    S.with_(
        S.OUTCOMES,
        HISTORY,
        PROBABILITIES,
        COMP,
        select="""SELECT 'c_index' AS metric, c_index AS value, greatest(0, (c_index - 0.5) / 0.5) * 40 AS points FROM c
          UNION ALL SELECT 'ibs', ibs, greatest(0, (0.05 - ibs) / 0.05) * 30 FROM i
          UNION ALL SELECT 'total', NULL, greatest(0, (c_index - 0.5) / 0.5) * 40 + greatest(0, (0.05 - ibs) / 0.05) * 30 FROM c, i""",
    ),
)
def _(spark, folder):
    scored = survival_scores(spark, folder)
    c = metrics.concordance_index(scored, "risk")
    ibs = metrics.integrated(metrics.brier(scored, (30, 60, 90), ("s30", "s60", "s90")), (30, 60, 90)).first()["ibs"]
    return metrics.scorecard(c, ibs, spark)


# censoring curve G and weights, recomputed in SQL
G_CURVE = """gt AS (SELECT time AS t, count(*) FILTER (WHERE event = 1) AS d, count(*) FILTER (WHERE event = 0) AS c,
    count(*) AS n FROM outcomes GROUP BY 1),
  gr AS (SELECT t, d, c, sum(n) OVER (ORDER BY t DESC) AS at_risk FROM gt),
  g AS (SELECT t, CASE WHEN min(CASE WHEN c > 0 AND at_risk - d = c THEN 0 ELSE 1 END) OVER (ORDER BY t) = 0 THEN 0
    ELSE exp(sum(CASE WHEN at_risk - d > c THEN ln(1 - c / CAST(at_risk - d AS DOUBLE)) ELSE 0 END) OVER (ORDER BY t)) END AS g FROM gr),
  w AS (SELECT s.*, CASE WHEN event = 1 THEN 1 / g.g ELSE 0 END AS ipcw FROM scores s JOIN g ON g.t = s.time)"""
TIMES = (15, 30, 45, 60)


@query("censoring_curve", "t:f g:f", S.with_(MIXED, HISTORY, PROBABILITIES, G_CURVE, select="SELECT t, g FROM g"))
def _(spark, folder):
    return metrics.censoring_curve(mixed_outcomes(spark, folder))


@query(
    "time_dependent_auc",
    "t:f auc:f",
    S.with_(
        MIXED,
        HISTORY,
        PROBABILITIES,
        G_CURVE,
        select=" UNION ALL ".join(
            f"""SELECT {t} AS t, sum(a.ipcw * (CASE WHEN a.risk > b.risk THEN 1 WHEN a.risk = b.risk THEN 0.5 ELSE 0 END))
              / sum(a.ipcw) AS auc FROM w a, w b WHERE a.event = 1 AND a.time <= {t} AND b.time > {t}"""
            for t in TIMES
        ),
    ),
)
def _(spark, folder):
    scored = survival_scores(spark, folder, mixed_outcomes)
    return metrics.time_dependent_auc(scored, "risk", TIMES, metrics.censoring_curve(scored))


def _ipcw_sql(i: int, t: int, s: str) -> str:
    return f"""avg(CASE WHEN time <= {t} AND event = 1 THEN {s} * {s} * ipcw ELSE 0 END
      + CASE WHEN time > {t} THEN (1 - {s}) * (1 - {s}) / (SELECT arg_max(g, t) FROM g WHERE t <= {t}) ELSE 0 END) AS brier_{i}"""


@query(
    "ipcw_brier",
    "brier_0:f brier_1:f brier_2:f ibs:f",
    S.with_(
        MIXED,
        HISTORY,
        PROBABILITIES,
        G_CURVE,
        f"b AS (SELECT {_ipcw_sql(0, 30, 's30')}, {_ipcw_sql(1, 45, 's60')}, {_ipcw_sql(2, 70, 's90')} FROM w)",
        select="SELECT *, ((brier_0 + brier_1) / 2 * 15 + (brier_1 + brier_2) / 2 * 25) / 40 AS ibs FROM b",
    ),
)
def _(spark, folder):
    scored = survival_scores(spark, folder, mixed_outcomes)
    return metrics.ipcw_brier(scored, (30, 45, 70), ("s30", "s60", "s90"), metrics.censoring_curve(scored))


AT = (30, 45, 70)
EVALUATED = {"by_orders": ("risk", ("s30", "s60", "s90")), "by_recency": ("recency", ("s60", "s90", "s90"))}


def _evaluation_sql(model: str, risk: str, survival) -> str:
    """One model's row; ``gr`` holds deaths and rows at risk per time."""
    won = f"(CAST(a.{risk} > b.{risk} AS INT) + CAST(a.{risk} = b.{risk} AS INT) / 2.0)"
    aucs = ", ".join(
        f"(SELECT sum(a.ipcw * {won}) / sum(a.ipcw) FROM w a, w b WHERE a.event = 1 AND a.time <= {t} AND b.time > {t}) AS auc_{t}"
        for t in AT
    )
    kept = ", ".join(f"(SELECT exp(sum(ln(1 - d / CAST(at_risk AS DOUBLE)))) FROM gr WHERE t <= {t} AND at_risk > d) AS surv_{t}" for t in AT)
    brier = ", ".join(_ipcw_sql(i, t, s) for i, (t, s) in enumerate(zip(AT, survival, strict=True)))
    return f"""SELECT '{model}' AS model, c_index, ((brier_0 + brier_1) / 2 * 15 + (brier_1 + brier_2) / 2 * 25) / 40 AS ibs,
      (auc_30 * (1 - surv_30) + auc_45 * (surv_30 - surv_45) + auc_70 * (surv_45 - surv_70)) / (1 - surv_70) AS mean_auc
      FROM (SELECT sum({won}) / count(*) AS c_index FROM scores a JOIN scores b ON b.time > a.time WHERE a.event = 1),
        (SELECT {brier} FROM w), (SELECT {aucs}), (SELECT {kept})"""


@query(
    "survival_evaluation",
    "model:s c_index:f ibs:f mean_auc:f",
    S.with_(
        MIXED,
        HISTORY,
        PROBABILITIES,
        G_CURVE,
        select=" UNION ALL ".join(_evaluation_sql(m, risk, survival) for m, (risk, survival) in EVALUATED.items()),
    ),
)
def _(spark, folder):
    scored = materialize(survival_scores(spark, folder, mixed_outcomes))
    return metrics.survival_evaluation(scored, scored, EVALUATED, AT)


# ---- score columns: monotone, expected survival, candidates -----------------------------------------------------------


@query(
    "monotone_survival",
    "id:i s30:f s60:f s90:f",
    S.with_(
        S.OUTCOMES,
        HISTORY,
        PROBABILITIES,
        select="""SELECT id, greatest(0, least(1, s90 * 1.5)) AS s30, least(greatest(0, least(1, s90 * 1.5)), s30) AS s60,
          least(greatest(0, least(1, s90 * 1.5)), s30, s60) AS s90 FROM scores""",
    ),
)
def _(spark, folder):
    mixed = survival_scores(spark, folder).select(
        "id", (F.col("s90") * 1.5).alias("s30"), F.col("s30").alias("s60"), F.col("s60").alias("s90")
    )
    return decisions.monotone_probabilities(mixed, ["s30", "s60", "s90"])


@query(
    "ensemble_mean",
    "id:i p30:f p60:f p90:f",
    S.with_(
        S.OUTCOMES,
        HISTORY,
        PROBABILITIES,
        "m AS (SELECT id, (s30 + exp(-recency / 3000.0)) / 2 AS a, (s60 + exp(-recency / 1500.0)) / 2 AS b, (s90 + exp(-recency / 2000.0)) / 2 AS c FROM scores)",
        select="SELECT id, a AS p30, least(a, b) AS p60, least(a, b, c) AS p90 FROM m",
    ),
)
def _(spark, folder):
    scored = survival_scores(spark, folder).withColumns(
        {f"t{h}": F.exp(-F.col("recency") / k) for h, k in ((30, 3000.0), (60, 1500.0), (90, 2000.0))}
    )
    return blend.ensemble_mean(scored, [("s30", "s60", "s90"), ("t30", "t60", "t90")], ("p30", "p60", "p90"))


@query(
    "expected_survival",
    "id:i expected:f",
    S.with_(
        S.OUTCOMES, HISTORY, PROBABILITIES, select="SELECT id, 15 * (1 + s30) + 15 * (s30 + s60) + 15 * (s60 + s90) AS expected FROM scores"
    ),
)
def _(spark, folder):
    scored = survival_scores(spark, folder)
    return scored.withColumn("expected", blend.expected_survival(["s30", "s60", "s90"], (30, 60, 90)))


@query(
    "risk_candidates",
    "id:i risk_s90:f risk_expected:f risk_sum:f risk_cox:f risk_blend:f",
    S.with_(
        S.OUTCOMES,
        HISTORY,
        PROBABILITIES,
        "e AS (SELECT *, 15 * (1 + s30) + 15 * (s30 + s60) + 15 * (s60 + s90) AS ex FROM scores)",
        """r AS (SELECT *, rank() OVER (ORDER BY recency) + (count(*) OVER (PARTITION BY recency) - 1) / 2.0 AS rc,
           rank() OVER (ORDER BY -ex) + (count(*) OVER (PARTITION BY ex) - 1) / 2.0 AS re FROM e)""",
        select="""SELECT id, 1 - s90 AS risk_s90, -ex AS risk_expected, 3 - s30 - s60 - s90 AS risk_sum, recency AS risk_cox,
          0.5 * rc + 0.5 * re AS risk_blend FROM r""",
    ),
)
def _(spark, folder):
    return blend.risk_candidates(survival_scores(spark, folder), ("s30", "s60", "s90"), "recency", ["id"])


TIER_CODES = {name: f"T{i}" for i, name in enumerate(decisions.TIER_NAMES)}

TIERED = """t AS (SELECT id, time, event, 1 - s30 AS churn30, 1 - s90 AS churn90,
  CASE WHEN 1 - s30 <= 0.02 THEN 'watch' WHEN 1 - s30 <= 0.05 THEN 'soon' WHEN 1 - s30 <= 0.15 THEN 'urgent' ELSE 'critical' END AS tier
  FROM scores)"""


def _tiered(spark, folder):
    scored = survival_scores(spark, folder)
    return decisions.retention_tier(
        scored.select("id", "time", "event", (1 - F.col("s30")).alias("churn30"), (1 - F.col("s90")).alias("churn90"))
    )


@query(
    "retention_tiers",
    "id:i churn30:f tier:s action:s",
    S.with_(
        S.OUTCOMES,
        HISTORY,
        PROBABILITIES,
        TIERED,
        select=f"SELECT id, churn30, tier, {S.case('tier', TIER_CODES)} AS action FROM t",
    ),
)
def _(spark, folder):
    return decisions.with_actions(_tiered(spark, folder), TIER_CODES)


@query(
    "tier_summary",
    "tier:s customers:i actual_event_rate:f mean_pred_churn90:f median_duration:f",
    S.with_(
        S.OUTCOMES,
        HISTORY,
        PROBABILITIES,
        TIERED,
        select="""SELECT tier, count(*) AS customers, avg(event) AS actual_event_rate, avg(churn90) AS mean_pred_churn90,
          quantile_cont(time, 0.5) AS median_duration FROM t GROUP BY tier""",
    ),
)
def _(spark, folder):
    return decisions.tier_summary(_tiered(spark, folder))


def _submission(spark, folder):
    ids = outcomes(spark, folder).select("id")
    return decisions.submission(survival_scores(spark, folder), ids, "risk", ["s30", "s60", "s90"])


@query(
    "submission",
    "ACCOUNT_ID:i RISK_SCORE:f SURV_PROB_30D:f SURV_PROB_60D:f SURV_PROB_90D:f",
    S.with_(
        S.OUTCOMES,
        HISTORY,
        PROBABILITIES,
        select="""SELECT id AS "ACCOUNT_ID", risk - (SELECT min(risk) FROM scores) AS "RISK_SCORE", s30 AS "SURV_PROB_30D",
          s60 AS "SURV_PROB_60D", s90 AS "SURV_PROB_90D" FROM scores""",
    ),
)
def _(spark, folder):
    return _submission(spark, folder)


@query(
    "submission_checks",
    "n_rows:i rows_ok:i unique_ok:i not_null_ok:i bounds_ok:i monotone_ok:i",
    S.with_(
        S.OUTCOMES,
        select="""SELECT count(*) AS n_rows, 1 AS rows_ok, 1 AS unique_ok, 1 AS not_null_ok, 1 AS bounds_ok, 1 AS monotone_ok
                  FROM outcomes""",
    ),
)
def _(spark, folder):
    return decisions.submission_checks(_submission(spark, folder), outcomes(spark, folder).count())


# ---- Kaplan–Meier family -----------------------------------------------------------------------------------------------

BY_SEGMENT = "grp AS (SELECT o.*, c_mktsegment AS seg FROM outcomes o JOIN customer ON c_custkey = o.id)"
KM = """kt AS (SELECT {by} time AS t, count(*) AS n, sum(event) AS d FROM {src} GROUP BY {by} time),
  kr AS (SELECT *, sum(n) OVER ({part} ORDER BY t DESC) AS n_risk FROM kt),
  km AS (SELECT *, n - d AS censored, product(1 - d / CAST(n_risk AS DOUBLE)) OVER ({part} ORDER BY t) AS surv,
    sum(d / CAST(n_risk AS DOUBLE)) OVER ({part} ORDER BY t) AS cum_hazard,
    sum(CASE WHEN n_risk > d THEN d / (n_risk * CAST(n_risk - d AS DOUBLE)) ELSE 0 END) OVER ({part} ORDER BY t) AS green FROM kr)"""
KM_ALL = KM.format(by="", part="", src="outcomes")
KM_SEG = KM.format(by="seg,", part="PARTITION BY seg", src="grp")


def _grouped(spark, folder, base=mixed_outcomes):
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"))
    return base(spark, folder).join(customers, "id")


@query(
    "kaplan_meier",
    "t:i n_risk:i d:i censored:i surv:f variance:f8 cum_hazard:f",
    S.with_(
        MIXED,
        KM_ALL,
        select="SELECT *, CASE WHEN n_risk > d THEN surv * surv * green END AS variance FROM km",
    ),
)
def _(spark, folder):
    return km.survival_table(mixed_outcomes(spark, folder))


@query(
    "km_by_group",
    "seg:s t:i n_risk:i d:i surv:f",
    S.with_(MIXED, BY_SEGMENT, KM_SEG, select="SELECT * FROM km"),
)
def _(spark, folder):
    return km.survival_table(_grouped(spark, folder), by=["seg"])


@query(
    "km_at_times",
    "seg:s t:f surv:f",
    S.with_(
        MIXED,
        BY_SEGMENT,
        KM_SEG,
        select=" UNION ALL ".join(
            f"SELECT seg, {t} AS t, coalesce(arg_max(surv, t) FILTER (WHERE t <= {t}), 1) AS surv FROM km GROUP BY seg"
            for t in (5, 10, 20, 60)
        ),
    ),
)
def _(spark, folder):
    return km.survival_at(km.survival_table(_grouped(spark, folder), by=["seg"]), [5, 10, 20, 60], ["seg"])


@query(
    "km_median",
    "seg:s median:f",
    S.with_(MIXED, BY_SEGMENT, KM_SEG, select="SELECT seg, min(t) FILTER (WHERE surv <= 0.5) AS median FROM km GROUP BY seg"),
)
def _(spark, folder):
    return km.median_survival(km.survival_table(_grouped(spark, folder), by=["seg"]), ["seg"])


@query(
    "nelson_aalen",
    "t:i hazard:f cum_hazard:f surv_from_hazard:f",
    S.with_(
        MIXED,
        KM_ALL,
        select="SELECT t, d / CAST(n_risk AS DOUBLE) AS hazard, cum_hazard, exp(-cum_hazard) AS surv_from_hazard FROM km",
    ),
)
def _(spark, folder):
    curve = km.survival_table(mixed_outcomes(spark, folder))
    return curve.select(
        "t", (F.col("d") / F.col("n_risk")).alias("hazard"), "cum_hazard", F.exp(-F.col("cum_hazard")).alias("surv_from_hazard")
    )


@query(
    "loglog_curves",
    "seg:s t:i loglog:f",
    S.with_(MIXED, BY_SEGMENT, KM_SEG, select="SELECT seg, t, ln(-ln(surv)) AS loglog FROM km WHERE surv > 0 AND surv < 1"),
)
def _(spark, folder):
    return km.loglog_curves(km.survival_table(_grouped(spark, folder), by=["seg"]), ["seg"])


LOGRANK = """two AS (SELECT time AS t, event, CAST(seg IN ('BUILDING', 'MACHINERY') AS INT) AS g FROM grp),
  tt AS (SELECT t, count(*) AS n, sum(event) AS d, sum(g) AS n1, sum(event * g) AS d1 FROM two GROUP BY t),
  rr AS (SELECT t, d, d1, CAST(sum(n) OVER (ORDER BY t DESC) AS DOUBLE) AS nn, CAST(sum(n1) OVER (ORDER BY t DESC) AS DOUBLE) AS nn1 FROM tt),
  zz AS (SELECT sum(d1 - d * nn1 / nn) AS z,
    sum(CASE WHEN nn > 1 THEN d * (nn - d) / (nn - 1) * (nn1 / nn) * (1 - nn1 / nn) ELSE 0 END) AS v FROM rr WHERE d > 0)"""


@query(
    "logrank_two_groups",
    "statistic:f dof:i",
    S.with_(MIXED, BY_SEGMENT, LOGRANK, select="SELECT z * z / v AS statistic, 1 AS dof FROM zz"),
)
def _(spark, folder):
    two = _grouped(spark, folder).withColumn("g", F.col("seg").isin("BUILDING", "MACHINERY").cast("int"))
    return km.logrank_test(two, "g")


_THREE = """three AS (SELECT *, CASE WHEN seg IN ('BUILDING', 'MACHINERY') THEN 0 WHEN seg = 'AUTOMOBILE' THEN 1 ELSE 2 END AS k FROM grp),
  sets AS (SELECT a.t, count(*) AS n, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1,
      sum(event) FILTER (time = a.t) AS d, coalesce(sum(event) FILTER (time = a.t AND k = 0), 0) AS d0,
      coalesce(sum(event) FILTER (time = a.t AND k = 1), 0) AS d1
    FROM (SELECT DISTINCT time AS t FROM three WHERE event = 1) a JOIN three ON three.time >= a.t GROUP BY a.t),
  scaled AS (SELECT *, CASE WHEN n > 1 THEN d * (n - d) / (CAST(n AS DOUBLE) * n * (n - 1)) ELSE 0.0 END AS c FROM sets),
  parts AS (SELECT sum(d0 - d * n0 / CAST(n AS DOUBLE)) AS z0, sum(d1 - d * n1 / CAST(n AS DOUBLE)) AS z1,
      sum(c * n0 * (n - n0)) AS v00, sum(c * n1 * (n - n1)) AS v11, -sum(c * n0 * n1) AS v01 FROM scaled),
  x AS (SELECT (v11 * z0 * z0 - 2 * v01 * z0 * z1 + v00 * z1 * z1) / (v00 * v11 - v01 * v01) AS statistic FROM parts)"""


@query(
    "logrank_three_groups",
    "statistic:f dof:i p_value:f",
    S.with_(MIXED, BY_SEGMENT, _THREE, select="SELECT statistic, 2 AS dof, exp(-statistic / 2) AS p_value FROM x"),
)
def _(spark, folder):
    group = F.when(F.col("seg").isin("BUILDING", "MACHINERY"), 0).when(F.col("seg") == "AUTOMOBILE", 1).otherwise(2)
    return km.logrank_test(_grouped(spark, folder).withColumn("k", group), "k")


@query("logrank_k_groups", "statistic:f dof:i p_value:f")
def _(spark, folder):
    return km.logrank_test(_grouped(spark, folder), "seg")


SEGMENTED = """cut AS (SELECT quantile_cont(risk, 0.33) AS a, quantile_cont(risk, 0.66) AS b FROM scores),
  seged AS (SELECT time, event, CAST(risk >= a AS INT) + CAST(risk >= b AS INT) AS seg FROM scores, cut)"""


@query(
    "risk_segment_km",
    "segment:i t:i n_risk:i d:i surv:f",
    S.with_(
        S.OUTCOMES,
        HISTORY,
        PROBABILITIES,
        SEGMENTED,
        KM.format(by="seg,", part="PARTITION BY seg", src="seged"),
        select="SELECT seg AS segment, t, n_risk, d, surv FROM km",
    ),
)
def _(spark, folder):
    segmented = km.risk_segments(survival_scores(spark, folder), "risk")
    return km.survival_table(segmented, by=["segment"])




DRIVER_CODES = {"gap_z": "D0", "trend_30_90": "D1", "rec_bill": "D2"}

DRIVERS = """drv AS (SELECT id, CASE WHEN recency > 400 THEN 'gap_z' WHEN risk >= 12 THEN 'trend_30_90' ELSE 'rec_bill' END AS driver
  FROM scores)"""


@query(
    "driver_actions",
    "id:i driver:s action:s",
    S.with_(
        S.OUTCOMES,
        HISTORY,
        PROBABILITIES,
        DRIVERS,
        select=f"SELECT id, driver, {S.case('driver', DRIVER_CODES)} AS action FROM drv",
    ),
)
def _(spark, folder):
    driver = (
        F.when(F.col("recency") > 400, "gap_z").when(F.col("risk") >= 12, "trend_30_90").otherwise("rec_bill").alias("driver")
    )
    scored = survival_scores(spark, folder).select("id", driver)
    return decisions.with_actions(scored, DRIVER_CODES, "driver")
