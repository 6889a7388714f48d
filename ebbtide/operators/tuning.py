"""Seeded random search over boosted-tree parameters on one stratified hold-out."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.operators.models import stopping_slice
from ebbtide.operators.splits import holdout_split
from ebbtide.session import materialize

# fixed values: parameter ranges (low, high, logarithmic)
RANGES = {
    "stepSize": (0.02, 0.15, True),
    "maxDepth": (3, 7, False),
    "minInstancesPerNode": (10, 300, True),
    "subsamplingRate": (0.5, 1.0, False),
    "featureShare": (0.5, 1.0, False),
    "minInfoGain": (1e-6, 1e-2, True),
    "minWeightFractionPerNode": (0.0, 0.05, False),
}


def draw_trials(n: int, seed: int = 42, ranges=RANGES) -> list[dict[str, float]]:
    """``n`` parameter sets, whole numbers where both ends of the range are whole."""
    rng = random.Random(seed)
    trials = []
    for _ in range(n):
        trial = {}
        for name, (low, high, logarithmic) in ranges.items():
            value = math.exp(rng.uniform(math.log(low), math.log(high))) if logarithmic else rng.uniform(low, high)
            trial[name] = round(value) if isinstance(low, int) and isinstance(high, int) else value
        trials.append(trial)
    return trials


def random_search(
    df: DataFrame, features: Sequence[str], label: str, row_id: Sequence[str], trials: int = 8, rounds: int = 20, seed: int = 42,
    parallelism: int = 4,
) -> DataFrame:
    """Rows ``(trial, parameters…, auc, best_so_far)``; a slice of the training rows stops each fit,
    and the hold-out, which no fit has seen, scores it."""
    staged = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(
        df.select(*row_id, *features, F.col(label).cast("int").alias("label"))
    )
    split = materialize(holdout_split(staged.select(*row_id, "features", "label"), row_id, 0.25, ["label"], seed))
    data = split.filter("is_test = 0").select("features", "label", stopping_slice(row_id, seed=seed).alias("is_validation"))
    held = split.filter("is_test = 1").select("features", "label")
    evaluator = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC", numBins=0)
    drawn = draw_trials(trials, seed)

    def run(item):
        number, p = item
        model = GBTClassifier(
            labelCol="label", maxIter=rounds, validationIndicatorCol="is_validation", seed=seed, stepSize=p["stepSize"], maxDepth=p["maxDepth"],
            minInstancesPerNode=p["minInstancesPerNode"], subsamplingRate=p["subsamplingRate"], featureSubsetStrategy=str(p["featureShare"]),
            minInfoGain=p["minInfoGain"], minWeightFractionPerNode=p["minWeightFractionPerNode"],
        ).fit(data)
        return number, *[float(p[name]) for name in RANGES], float(evaluator.evaluate(model.transform(held)))

    # fits are Spark jobs; the threads only submit them
    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(run, enumerate(drawn, start=1)))
    schema = "trial int, " + ", ".join(f"{name} double" for name in RANGES) + ", auc double"
    table = df.sparkSession.createDataFrame(rows, schema)
    running = W.partitionBy(F.lit(0)).orderBy("trial").rowsBetween(W.unboundedPreceding, W.currentRow)
    return table.withColumn("best_so_far", F.max("auc").over(running))
