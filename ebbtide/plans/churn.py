"""The binary churn plan: out-of-fold models, rank ensemble, optional leak-aware bands, lift table, submission."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions import vectors as V
from ebbtide.operators import audit, blend, decisions, histboost, metrics, models, splits
from ebbtide.operators.histboost import Target
from ebbtide.operators.quality import log_copies
from ebbtide.operators.ranks import average_ranks
from ebbtide.session import materialize


@dataclass
class ChurnResult:
    submission: DataFrame
    oof: DataFrame
    weights: DataFrame
    model_table: DataFrame
    lift: DataFrame


def run(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    label: str = "label",
    blocks: DataFrame | None = None,
    logged: Sequence[str] = (),
    folds: int = 5,
    trees: int = 20,
    seed: int = 42,
    trust_blocks: bool = False,
) -> ChurnResult:
    """Score ``test`` (``id`` + features) from ``train`` (``id``, label + features).

    A logistic model on logged features and two boosted-tree models are fitted per fold; the tree models
    and the logistic one are blended by rank with weights chosen on out-of-fold AUC. With ``blocks`` (see
    ``audit.id_blocks``) scores are assembled in leak-aware bands, if the blocks pass the contiguity test or
    ``trust_blocks`` waives it; otherwise the ensemble is the score.
    """
    row_id = ["id"]
    linear = [f"{c}_log" if c in set(logged) else c for c in features]
    train = materialize(splits.folds(log_copies(train, logged), row_id, folds, [label], seed))
    test = materialize(log_copies(test, logged))
    targets = [
        Target("boosted", label=label, rounds=trees, depth=5, stopping=True),
        Target("shallow", label=label, rounds=trees, depth=3),
    ]
    names = ["logistic", *[t.out for t in targets]]
    train, test = models.out_of_fold(train, test, models.logistic_classifier(linear, label), folds, "logistic")
    train = materialize(train.withColumn("_stop", models.stopping_slice(row_id)))
    boosted = histboost.fit(train, features, targets, row_id, "fold", folds, validation="_stop")
    train, test = materialize(boosted.out_of_fold(train)), materialize(boosted.mean_score(test))
    weights = blend.rank_ensemble(train, names, label, row_id)
    best = weights.filter("best = 1").first()
    chosen = [best[f"w{i}"] for i in range(len(names))]
    oof, scored = (_blend(side, names, chosen, row_id) for side in (train, test))
    if blocks is not None and (trust_blocks or audit.contiguity_test(blocks).first()["valid"] == 1):
        oof, scored = _leak_aware(oof, scored, blocks, features, label, row_id, folds)
    else:
        oof, scored = (side.withColumn("score", F.col("ensemble")) for side in (oof, scored))
    oof, scored = materialize(oof), materialize(scored)
    table = metrics.model_table(oof, [*names, "ensemble", "score"], label, row_id)
    lift = decisions.lift_table(oof, "score", label, row_id)
    submission = decisions.binary_submission(scored.select("id", "score"), test.select("id"), "score")
    return ChurnResult(submission, oof, weights, table, lift)


def _leak_aware(
    oof: DataFrame, scored: DataFrame, blocks: DataFrame, features: Sequence[str], label: str, row_id: Sequence[str], folds: int
) -> tuple[DataFrame, DataFrame]:
    """Scores in bands. Rows with a positive count are ordered by the count blended with a second stage that sees it.

    The blend's weight has the best AUC out of fold; without both classes among those rows the ensemble stands
    in for the second stage.
    """
    hidden = materialize(blocks.select("id", F.col("hidden").cast("double").alias("hidden")))
    oof, scored = (materialize(side.join(hidden, "id", "left")) for side in (oof, scored))
    positive = oof.filter("hidden > 0")
    if positive.select(label).distinct().count() < 2:
        return tuple(blend.banded_score(side, "hidden", "ensemble", row_id) for side in (oof, scored))
    second, tested = blend.constrained_second_stage(
        positive, scored.filter("hidden > 0"), features, "hidden", label, row_id, "second", folds=folds, validation="_stop"
    )
    second = materialize(second.withColumn("_down", -F.col("hidden")))
    best = blend.blend_weight_search(second, "_down", "second", label, row_id).filter("best = 1").first()
    sides = []
    for side, own in ((oof, second), (scored, materialize(tested))):
        joined = materialize(side.join(own.select(*row_id, "second"), list(row_id), "left"))
        sides.append(blend.banded_score(joined, "hidden", "ensemble", row_id, best["weight"], "second"))
    return sides[0], sides[1]


def _blend(df: DataFrame, names: Sequence[str], weights: Sequence[float], row_id: Sequence[str]) -> DataFrame:
    """Weighted mean of the model ranks, scaled to (0, 1]."""
    n = max(df.count(), 1)
    df = average_ranks(df, [(name, f"rank_{name}") for name in names], row_id)
    mixed = V.total([F.col(f"rank_{name}") * float(w) for name, w in zip(names, weights, strict=True)])
    return df.withColumn("ensemble", mixed / n).drop(*[f"rank_{name}" for name in names])
