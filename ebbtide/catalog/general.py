"""Queries over sources, scalar functions, quality, splits and samples."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from ebbtide.catalog import sql as S
from ebbtide.catalog.registry import query
from ebbtide.functions import columns as C
from ebbtide.operators import audit, quality, splits
from ebbtide.operators.ranks import quantile_map
from ebbtide.session import ensure_checkpoint_dir
from ebbtide.sources import roles
from ebbtide.sources.tables import LABELS_SCHEMA, inventory, parse_transactions, read_csv, table, write_table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(
    "source_inventory",
    "source:s n:i",
    " UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS n FROM {t}" for t in TABLES),
)
def _(spark, folder):
    return inventory({name: table(spark, folder, name) for name in TABLES})


LAST = date(2001, 12, 31)


def _guard(name: str, day: str) -> str:
    return (
        f"SELECT '{name}' AS source, count(*) AS n, CAST(min({day}) AS DATE) AS min_d, CAST(max({day}) AS DATE) AS max_d, "
        f"CAST(CAST(max({day}) AS DATE) <= DATE '{LAST}' AS INT) AS ok FROM {name}"
    )


@query(
    "date_range_guard",
    "source:s n:i min_d:d max_d:d ok:i",
    " UNION ALL ".join(_guard(n, d) for n, d in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))),
)
def _(spark, folder):
    days = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
    return audit.date_range_guard({n: (table(spark, folder, n), F.to_date(d)) for n, d in days.items()}, LAST)


@query(
    "parsed_transactions",
    "trx_id:s src:s dst:s kind:s typ:s amt:f4 d:d hr:i",
    S.with_(
        S.EVENTS_TRX,
        select="""SELECT 'T-' || event_id AS trx_id, 'CUST' || src AS src, kind || dst AS dst, kind, typ, amt, d, hr FROM trx""",
    ),
)
def _(spark, folder):
    e = roles.event_transactions(spark, folder)
    raw = e.select(
        F.concat(F.lit("T-"), F.col("event_id")).alias("TrxID"),
        F.concat(F.lit("CUST"), F.col("src")).alias("SRC_ACCOUNT"),
        F.concat("kind", F.col("dst").cast("string")).alias("DST_ACCOUNT"),
        F.col("typ").alias("TRX_TYPE"),
        F.col("amt").alias("TRX_AMT"),
        F.concat(F.col("d").cast("string"), F.lit(" "), F.lpad(F.col("hr").cast("string"), 2, "0"), F.lit(":00:00")).alias(
            "TRX_DATETIME"
        ),
    )
    return parse_transactions(raw)


@query(
    "scalar_functions",
    "event_id:i d:d hr:i prefix:s week:d month:d weekend:i days_left:i hours_left:i hexval:i over30:f cap:f logv:f ratio:f "
    "band:s left_bin:i flag:i low:f",
    """SELECT event_id, CAST(ts AS DATE) AS d, extract(hour FROM ts) AS hr, substr(event_type, 1, 4) AS prefix,
      CAST(date_trunc('week', ts) AS DATE) AS week, CAST(date_trunc('month', ts) AS DATE) AS month,
      CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 ELSE 0 END AS weekend,
      date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS days_left,
      date_diff('hour', date_trunc('hour', ts), TIMESTAMP '2024-01-31 00:00:00') AS hours_left,
      event_id AS hexval, greatest(0, value - 30) AS over30, least(value, 100.0) AS cap, ln(1 + abs(value)) AS logv,
      CASE WHEN value > 30 THEN value / (value - 30 + 1e-6) END AS ratio,
      CASE WHEN value <= 0 THEN NULL WHEN value <= 5 THEN '(0, 5]' WHEN value <= 20 THEN '(5, 20]' ELSE '(20, inf]' END AS band,
      CAST(value >= 10 AS INT) + CAST(value >= 50 AS INT) AS left_bin, CAST(value <= 1.0 AS INT) AS flag,
      least(value, 50.0, extract(hour FROM ts)) AS low FROM events""",
)
def _(spark, folder):
    ts, value = F.col("ts"), F.col("value")
    end = F.lit(date(2024, 1, 31))
    day, hour = F.to_date(ts), F.hour(ts)
    edges = [0, 5, 20, float("inf")]
    return table(spark, folder, "events").select(
        "event_id",
        day.alias("d"),
        hour.alias("hr"),
        F.substring("event_type", 1, 4).alias("prefix"),
        F.date_trunc("week", ts).cast("date").alias("week"),
        F.trunc(day, "month").alias("month"),
        F.dayofweek(day).isin(1, 7).cast("int").alias("weekend"),
        F.datediff(end, day).alias("days_left"),
        (F.datediff(end, day) * 24 - hour).alias("hours_left"),
        C.hex_suffix_to_number(F.concat(F.lit("T-"), F.hex("event_id"))).alias("hexval"),
        F.greatest(F.lit(0), value - 30).alias("over30"),
        C.clip(value, high=100.0).alias("cap"),
        F.log1p(F.abs(value)).alias("logv"),
        F.when(value > 30, F.try_divide(value, value - 30 + C.EPS)).alias("ratio"),
        C.right_closed_bin(value, edges, C.interval_labels(edges)).alias("band"),
        C.left_closed_bin(value, [10, 50]).alias("left_bin"),
        C.flag(value <= 1.0).alias("flag"),
        F.least(value, F.lit(50.0), hour.cast("double")).alias("low"),
    )


@query(
    "top_rows",
    "l_orderkey:i l_linenumber:i l_extendedprice:f2",
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 30",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return splits.head(lines, [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 30)


@query(
    "labels_csv",
    "account:s days:i flag:i",
    """SELECT 'C-' || o_custkey AS account, CAST(max(CAST(o_orderdate AS DATE)) - min(CAST(o_orderdate AS DATE)) AS BIGINT) AS days,
      CAST(count(*) > 10 AS BIGINT) AS flag FROM orders GROUP BY o_custkey""",
)
def _(spark, folder):
    """Labels written as CSV by all tasks and read back with the schema of label files."""
    day = F.to_date("o_orderdate")
    made = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.datediff(F.max(day), F.min(day)).alias("DURATION_DAYS"), (F.count(F.lit(1)) > 10).cast("int").alias("EVENT_FLAG")
    )
    path = f"{ensure_checkpoint_dir(spark)}/labels-{uuid.uuid4().hex}"
    named = made.select(F.concat(F.lit("C-"), F.col("o_custkey")).alias("ACCOUNT_ID"), "DURATION_DAYS", "EVENT_FLAG")
    write_table(named, path, "csv")
    read = read_csv(spark, path, LABELS_SCHEMA)
    return read.select(F.col("ACCOUNT_ID").alias("account"), F.col("DURATION_DAYS").alias("days"), F.col("EVENT_FLAG").alias("flag"))


# ---- quality -------------------------------------------------------------------------------------------------

AUDITED = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def _audit_sql(name: str, source: str) -> str:
    return f"""SELECT '{name}' AS feature,
      (avg(pow({name}, 3)) - 3 * avg({name}) * avg(pow({name}, 2)) + 2 * pow(avg({name}), 3))
        / pow(avg(pow({name}, 2)) - pow(avg({name}), 2), 1.5) AS skew,
      avg(CASE WHEN {name} = 0 THEN 1.0 ELSE 0 END) AS zero_share,
      quantile_cont({name}, 0.99) / (abs(quantile_cont({name}, 0.5)) + 1e-9) AS p99_over_med FROM {source}"""


@query(
    "skew_audit",
    "feature:s skew:f4 zero_share:f p99_over_med:f4",
    " UNION ALL ".join(_audit_sql(c, "lineitem") for c in AUDITED),
)
def _(spark, folder):
    return quality.skew_audit(table(spark, folder, "lineitem"), AUDITED)


@query(
    "skew_audit_sketch",
    "feature:s skew:f4 zero_share:f p99_over_med:f4",
)
def _(spark, folder):
    return quality.skew_audit(table(spark, folder, "lineitem"), AUDITED, approximate=True)


VALUES = "(SELECT event_id, value, value * value AS squared, exp(value / 20) AS grown FROM events)"


@query(
    "skewed_features",
    "feature:s skew:f4",
    f"SELECT feature, skew FROM ({' UNION ALL '.join(_audit_sql(c, VALUES) for c in ('value', 'squared', 'grown'))}) "
    "WHERE skew > 2 AND NOT starts_with(feature, 'is_')",
)
def _(spark, folder):
    v = F.col("value")
    df = table(spark, folder, "events").select(v, (v * v).alias("squared"), F.exp(v / 20).alias("grown"))
    return quality.select_skewed(quality.skew_audit(df, df.columns))


@query(
    "winsorize",
    "event_id:i value:f",
    """SELECT event_id, least(value, (SELECT quantile_cont(value, 0.999) FROM events WHERE user_id % 4 <> 0)) AS value
       FROM events""",
)
def _(spark, folder):
    events = table(spark, folder, "events")
    caps = quality.fit_caps(events.filter(F.col("user_id") % 4 != 0), ["value"])
    return quality.apply_caps(events, caps)


@query(
    "log_copies",
    "o_orderkey:i o_totalprice_log:f",
    "SELECT o_orderkey, ln(1 + greatest(o_totalprice, 0)) AS o_totalprice_log FROM orders",
)
def _(spark, folder):
    return quality.log_copies(table(spark, folder, "orders"), ["o_totalprice"])


@query(
    "histogram",
    "bin:i low:f4 high:f4 n:i",
    """WITH r AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 60 AS w FROM orders)
       SELECT bin, max(lo + bin * w) AS low, max(lo + (bin + 1) * w) AS high, count(*) AS n
       FROM (SELECT least(floor((o_totalprice - lo) / w), 59) AS bin, lo, w FROM orders, r) GROUP BY bin""",
)
def _(spark, folder):
    return quality.histogram(table(spark, folder, "orders"), "o_totalprice", 60)


@query(
    "zscore",
    "c_custkey:i c_acctbal:f",
    """SELECT c_custkey, (c_acctbal - (SELECT avg(c_acctbal) FROM customer))
         / ((SELECT stddev_samp(c_acctbal) FROM customer) + 1e-9) AS c_acctbal FROM customer""",
)
def _(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return quality.apply_scaler(customers, quality.fit_scaler(customers, ["c_acctbal"]))


@query(
    "global_quantiles",
    "feature:s prob:f value:f4",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {p} AS prob, quantile_cont({c}, {p}) AS value FROM lineitem"
        for c in ("l_extendedprice", "l_quantity")
        for p in (0.1, 0.5, 0.99, 0.999)
    ),
)
def _(spark, folder):
    from ebbtide.operators.ranks import exact_quantiles

    return exact_quantiles(table(spark, folder, "lineitem"), ["l_extendedprice", "l_quantity"], [0.1, 0.5, 0.99, 0.999])


@query(
    "value_shares",
    "o_orderpriority:s n:i share:f",
    """SELECT o_orderpriority, count(*) AS n, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM orders) AS share
       FROM orders GROUP BY 1""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    counted = orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / counted.agg(F.sum("n")).scalar())


@query(
    "crosstab",
    "o_orderpriority:s F:i O:i P:i",
    """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F",
       count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P"
       FROM orders GROUP BY 1""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


# ---- samples and splits ----------------------------------------------------------------------------------------


def _md5(key: str, seed: int = 42) -> str:
    return f"md5('{seed}|' || {key})"


@query(
    "sample_n",
    "o_orderkey:i o_totalprice:f",
    f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_md5('o_orderkey')}, o_orderkey LIMIT 1000",
)
def _(spark, folder):
    return splits.sample_n(table(spark, folder, "orders"), ["o_orderkey"], 1000)


@query(
    "holdout_split",
    "id:i y:i is_test:i",
    S.with_(
        S.SCORED,
        select=f"""SELECT id, y, CAST(row_number() OVER (PARTITION BY y ORDER BY {_md5('id')}, id)
          <= ceil(count(*) OVER (PARTITION BY y) * 0.25) AS INT) AS is_test FROM scored""",
    ),
)
def _(spark, folder):
    return splits.holdout_split(roles.scored_documents(spark, folder), ["id"], 0.25, ["y"])


@query(
    "stratified_folds",
    "id:i event:i fold:i",
    S.with_(
        S.OUTCOMES,
        select=f"""SELECT id, event, (row_number() OVER (PARTITION BY event ORDER BY {_md5('id')}, id) - 1) % 5 AS fold
                   FROM outcomes""",
    ),
)
def _(spark, folder):
    return splits.folds(roles.order_outcomes(spark, folder), ["id"], 5, ["event"])


@query(
    "kfold",
    "o_orderkey:i fold:i",
    f"SELECT o_orderkey, (row_number() OVER (ORDER BY {_md5('o_orderkey')}, o_orderkey) - 1) % 5 AS fold FROM orders",
)
def _(spark, folder):
    return splits.folds(table(spark, folder, "orders"), ["o_orderkey"], 5)


@query(
    "undersample",
    "id:i y:i",
    S.with_(
        "inverted AS (SELECT doc_id AS id, 1 - quality AS y FROM labels)",
        select=f"""SELECT id, y FROM inverted WHERE y = 1 UNION ALL
          (SELECT id, y FROM inverted WHERE y = 0 ORDER BY {_md5('id')}, id LIMIT (SELECT count(*) FROM inverted WHERE y = 1))""",
    ),
)
def _(spark, folder):
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("y"))
    return splits.undersample(labels, ["id"], "y")


PROBS = [0.1, 0.5, 0.9]


@query(
    "nearest_to_quantile",
    "prob:f id:i value:f4",
    " UNION ALL ".join(
        f"""(SELECT {p} AS prob, o_orderkey AS id, o_totalprice AS value FROM orders
             ORDER BY abs(o_totalprice - (SELECT quantile_cont(o_totalprice, {p}) FROM orders)), o_orderkey LIMIT 1)"""
        for p in PROBS
    ),
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    quantiles = quantile_map(orders, ["o_totalprice"], PROBS)["o_totalprice"]
    return splits.nearest_to_quantile(orders, "o_totalprice", "o_orderkey", PROBS, quantiles)
