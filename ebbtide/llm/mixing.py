"""Mixing sources to target weights by hierarchical budgeting.

A tree of domains, languages and sources carries integer weights. The budget goes down the tree: the children
of a node share its budget by weight, but no child gets more than its subtree can supply (its tokens times
``max_epochs``). What a short child leaves goes to its siblings, and because a node's capacity is that of its
whole subtree, a shortage reaches the node's own siblings only after its children cannot take it up. Shares
are whole tokens; what rounding leaves goes to the first children by name.

Each leaf then takes whole epochs while its budget covers them, and from the last epoch, ordered by a seeded
hash, the prefix that fills the budget to the token. The prefix is found from token totals per hash prefix;
only the documents of the one hash prefix where the budget ends are ranked, so no source, however large, is
ordered in one task. Only expressions are used.

Defined results: null domains, languages and sources are the text "?"; a text without words has no tokens and
is never selected; nodes of weight zero get nothing; repeated rows are separate documents, ties in the order
take the id and then count together by their text; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.llm.rules import words_of
from ebbtide.session import materialize

LEVELS = ("domain", "lang", "source")
BUCKET_ROWS = 20_000
LARGEST_BUCKET_DIGITS = 7


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``budget`` to ``children``, which hold ``available`` (the parent's), ``weight`` and ``capacity``.

    By capacity per weight, the children that cannot use their share come first. A child is full when its
    capacity is at most its share of what the children before it left; all others share the rest by weight.
    """
    group = W.partitionBy(*parent)
    order = group.orderBy(F.col("capacity") / F.col("weight"), name)
    rows = children.where("weight > 0 and capacity > 0")
    rows = rows.withColumn("before", F.sum("capacity").over(order) - F.col("capacity"))
    rows = rows.withColumn("weights", F.sum("weight").over(group) - F.sum("weight").over(order) + F.col("weight"))
    left = F.col("available") - F.col("before")
    rows = rows.withColumn("full", F.col("capacity") * F.col("weights") <= left * F.col("weight"))
    rows = rows.withColumn("rest", F.col("available") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(group))
    rows = rows.withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(group))
    share = F.expr("case when full then 0 else (rest * weight) div open end")
    rows = rows.withColumn("share", share)
    rows = rows.withColumn("crumbs", F.col("rest") - F.sum("share").over(group))
    place = F.row_number().over(group.orderBy("full", name))
    extra = F.when(~F.col("full") & (place <= F.col("crumbs")), 1).otherwise(0)
    budget = F.when(F.col("full"), F.col("capacity")).otherwise(F.col("share") + extra)
    return rows.withColumn("budget", F.least(budget, F.col("capacity")).cast("long")).drop(
        "before", "weights", "full", "rest", "open", "share", "crumbs"
    )


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """``domain, lang, source, supply, budget`` for leaves with ``supply`` tokens.

    ``weights`` gives each level's weights by name (1 where a name is missing); ``share`` is the whole budget
    as a fraction of all tokens.
    """

    def weight(level: str) -> Column:
        given = weights.get(level, {})
        if not given:
            return F.lit(1)
        table = F.create_map(*[F.lit(x) for pair in sorted(given.items()) for x in pair])
        return F.coalesce(F.element_at(table, F.col(level)), F.lit(1))

    total = F.sum("supply").over(W.partitionBy())
    budget = F.expr(f"(total * {share[0]}) div {share[1]}")
    nodes = leaves.withColumn("capacity", F.col("supply") * max_epochs)
    domains = nodes.groupBy("domain").agg(F.sum("supply").alias("supply"), F.sum("capacity").alias("capacity"))
    domains = domains.withColumn("total", total).withColumn("available", F.least(budget, F.col("total") * max_epochs))
    top = share_out(domains.withColumn("weight", weight("domain")), [], "domain")
    languages = nodes.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    languages = languages.join(top.select("domain", F.col("budget").alias("available")), "domain")
    middle = share_out(languages.withColumn("weight", weight("lang")), ["domain"], "lang")
    sources = nodes.join(middle.select("domain", "lang", F.col("budget").alias("available")), ["domain", "lang"])
    return share_out(sources.withColumn("weight", weight("source")), ["domain", "lang"], "source").select(*LEVELS, "supply", "budget")


def order_key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))))


def mix(
    docs: DataFrame,
    domain: Column,
    weights: dict[str, dict[str, int]],
    share: tuple[int, int] = (1, 1),
    max_epochs: int = 4,
    seed: int = 1,
) -> DataFrame:
    """``doc_id, domain, lang, source, epoch, n_tokens, take_tokens`` of every selected document and epoch."""
    named = docs.select(
        "doc_id",
        F.coalesce(domain.cast("string"), F.lit("?")).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("?")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("?")).alias("source"),
        F.size(words_of(F.col("text"))).cast("long").alias("n_tokens"),
    )
    rows = materialize(named.where("n_tokens > 0"))
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("n"))
    plan = materialize(leaf_budgets(leaves, weights, share, max_epochs).where("budget > 0"))
    plan = plan.select(
        *LEVELS,
        F.expr("budget div supply").cast("int").alias("whole"),
        F.expr("budget % supply").alias("rest"),
    )
    own = rows.join(F.broadcast(plan) if plan.limit(200_001).count() <= 200_000 else plan, list(LEVELS))
    whole = own.where("whole > 0").select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("whole"))).alias("epoch"))
    whole = whole.withColumn("take_tokens", F.col("n_tokens"))
    last = own.where("rest > 0").withColumn("epoch", F.col("whole") + 1)
    last = last.withColumn("place", order_key(seed, F.col("epoch")))
    digits = min(LARGEST_BUCKET_DIGITS, max(1, math.ceil(math.log(max(1, rows.count()) / BUCKET_ROWS + 1, 16))))
    last = last.withColumn("bucket", F.substring("place", 1, digits))
    totals = last.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("tokens"))
    totals = totals.withColumn("up_to", F.sum("tokens").over(W.partitionBy(*LEVELS).orderBy("bucket")))
    cut = totals.join(plan.select(*LEVELS, "rest"), list(LEVELS)).where("up_to - tokens < rest")
    cut = materialize(cut.select(*LEVELS, "bucket", (F.col("up_to") - F.col("tokens")).alias("before"), (F.col("up_to") <= F.col("rest")).alias("inside")))
    last = last.join(cut, [*LEVELS, "bucket"])
    inside = last.where("inside").withColumn("take_tokens", F.col("n_tokens"))
    ranked = W.partitionBy(*LEVELS).orderBy("place", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    straddling = last.where("not inside").withColumn("end", F.col("before") + F.sum("n_tokens").over(ranked))
    straddling = straddling.where("end - n_tokens < rest").withColumn(
        "take_tokens", F.least("n_tokens", F.col("rest") - F.col("end") + F.col("n_tokens"))
    )
    columns = ["doc_id", *LEVELS, "epoch", "n_tokens", "take_tokens"]
    return whole.select(columns).unionByName(inside.select(columns)).unionByName(straddling.select(columns))
