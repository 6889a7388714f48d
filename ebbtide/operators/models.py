"""Classifiers and the training protocol: out-of-fold predictions, horizons, imbalance, importance.

Model fits are Spark ML jobs; only fitted models and report rows live on the driver.
"""

from __future__ import annotations

import time as clock
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.functions import vectors as V
from ebbtide.operators.decisions import monotone_probabilities
from ebbtide.operators.metrics import classifier_metrics, concordance, model_table
from ebbtide.operators.ranks import hash_order, hash_rank
from ebbtide.operators.splits import holdout_split, sample_n, undersample
from ebbtide.session import materialize

Fitter = Callable[[DataFrame], Transformer]


def gbt_classifier(
    features: Sequence[str], label: str = "label", weight: str | None = None, validation: str | None = None, **params
) -> Fitter:
    """Gradient-boosted trees; ``validation`` names a boolean column whose rows stop the boosting early."""

    def fit(train: DataFrame) -> Transformer:
        settings = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": 42} | params
        model = GBTClassifier(featuresCol="features", labelCol=label, **settings)
        if weight:
            model = model.setWeightCol(weight)
        if validation:
            model = model.setValidationIndicatorCol(validation)
        return Pipeline(stages=[_assembler(features), model]).fit(train)

    return fit


def logistic_classifier(features: Sequence[str], label: str = "label", c: float = 1.0, **params) -> Fitter:
    """Logistic regression on standardised features; ``c`` is the inverse strength of the ridge penalty."""

    def fit(train: DataFrame) -> Transformer:
        n = max(train.count(), 1)
        stages = [
            _assembler(features, "raw"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
            LogisticRegression(labelCol=label, regParam=1.0 / (n * c), maxIter=100, standardization=False, **params),
        ]
        return Pipeline(stages=stages).fit(train)

    return fit


def _assembler(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")


def score(df: DataFrame, model: Transformer, out: str) -> DataFrame:
    """Adds the probability of the positive class."""
    kept = df.columns
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).select(*kept, out)


def balanced_weight(label: str = "label", rate: float = 0.5) -> Column:
    """Weight ``(1 - rate) / rate`` on positives, 1 on negatives."""
    return F.when(F.col(label) == 1, F.lit((1 - rate) / rate)).otherwise(F.lit(1.0))


def stopping_slice(row_id: Sequence[str], one_in: int = 10, seed: int = 42) -> Column:
    """True for about one row in ``one_in``, by the md5 of the id: the rows that stop the boosting."""
    return F.conv(F.substring(hash_order(row_id, f"{seed}-stop"), 1, 7), 16, 10).cast("int") % one_in == 0


def out_of_fold(
    train: DataFrame, test: DataFrame | None, fit: Fitter, k: int, out: str, fold: str = "fold", early_stopping: bool = False,
    row_id: Sequence[str] = ("id",),
) -> tuple[DataFrame, DataFrame | None]:
    """Each training row is scored by the model that did not see its fold; test scores are fold means.

    With ``early_stopping`` a tenth of the training folds, by the md5 of ``row_id``, is handed over as rows with
    ``is_validation`` true; the fold that is scored never chooses the number of trees.
    """
    parts, tested = None, test
    for i in range(k):
        held = train.filter(F.col(fold) == i)
        seen = train.filter(F.col(fold) != i)
        model = fit(seen.withColumn("is_validation", stopping_slice(row_id))) if early_stopping else fit(seen)
        part = score(held, model, out)
        parts = part if parts is None else parts.unionByName(part)
        if tested is not None:
            tested = score(tested, model, f"{out}_{i}")
    if tested is not None:
        folds = [f"{out}_{i}" for i in range(k)]
        tested = tested.withColumn(out, V.mean([F.col(f) for f in folds])).drop(*folds)
    return parts, tested


def horizon_models(
    train: DataFrame,
    test: DataFrame | None,
    make: Callable[[str], Fitter],
    k: int,
    horizons: Sequence[int] = (30, 60, 90),
    prefix: str = "s",
    time: str = "time",
    early_stopping: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """Out-of-fold survival probability per horizon; a horizon without both classes takes its base rate."""
    labels = {f"surv_{h}": (F.col(time) > h).cast("int") for h in horizons}
    oof = materialize(train.withColumns(labels))
    rates = oof.agg(*[F.avg(name).alias(name) for name in labels]).first()
    scored, tested = oof, test
    for h in horizons:
        rate, out = rates[f"surv_{h}"], f"{prefix}{h}"
        if rate in (0.0, 1.0, None):
            constant = F.lit(float(rate or 0.0))
            scored = scored.withColumn(out, constant)
            tested = None if tested is None else tested.withColumn(out, constant)
            continue
        scored, tested = out_of_fold(scored, tested, make(f"surv_{h}"), k, out, early_stopping=early_stopping)
        scored = materialize(scored)
    columns = [f"{prefix}{h}" for h in horizons]
    scored = monotone_probabilities(scored, columns).drop(*labels)
    return scored, None if tested is None else monotone_probabilities(tested, columns)


def compare_models(
    train: DataFrame, models: dict[str, Fitter], k: int, label: str, row_id: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold scores of every model and of their mean, ``ensemble``, as columns, and the table of their metrics.

    ``fit_min`` is a model's time to fit and score in minutes, for the ensemble that of all models together.
    """
    if "ensemble" in models:
        raise ValueError("ensemble is the name of the mean of all models")
    scored, minutes = train, {}
    for name, fit in models.items():
        started = clock.monotonic()
        scored, _ = out_of_fold(scored, None, fit, k, name)
        scored = materialize(scored)
        minutes[name] = (clock.monotonic() - started) / 60
    scored = scored.withColumn("ensemble", V.mean([F.col(name) for name in models]))
    minutes["ensemble"] = sum(minutes.values())
    table = model_table(scored, list(minutes), label, row_id, minutes)
    return scored, table


# ---- class imbalance --------------------------------------------------------------------------------------------


def nearest_rows(spark: SparkSession, rows: np.ndarray, scale: np.ndarray, k: int, block: int = 64) -> DataFrame:
    """Edges ``(base, place, other)``: the ``k`` nearest other rows of every row, after division by ``scale``.

    Exact; blocks of rows meet the whole matrix, which is shared by broadcast, once. Equal distances go to the
    lesser row number; places count from 0, nearest first.
    """
    shared = spark.sparkContext.broadcast(rows / scale)

    def search(batches):
        scaled = shared.value
        squares = (scaled**2).sum(1)
        for pdf in batches:
            for start in range(0, len(pdf), block):
                base = pdf["id"].to_numpy()[start : start + block]
                distance = squares[None, :] - 2 * scaled[base] @ scaled.T
                distance[np.arange(len(base)), base] = np.inf
                kth = np.partition(distance, k - 1, axis=1)[:, k - 1]
                equal = distance == kth[:, None]
                closer = distance < kth[:, None]
                wanted = k - closer.sum(axis=1, keepdims=True)
                row, other = np.nonzero(closer | equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= wanted))
                order = np.lexsort((other, distance[row, other], row))
                yield pd.DataFrame({"base": base[row[order]], "place": np.arange(len(row)) % k, "other": other[order]})

    return spark.range(len(rows)).mapInPandas(search, "base long, place long, other long")


def smote(
    df: DataFrame, features: Sequence[str], label: str, row_id: Sequence[str], k: int = 5, limit: int = 120_000, seed: int = 42
) -> DataFrame:
    """Balance classes by interpolating minority rows towards one of their ``k`` nearest minority rows.

    As in the study this reproduces, the operator works on a sample of at most ``limit`` rows, which
    bounds the minority matrix that is broadcast (checked below 256 MB). The exact neighbours of every minority row
    are searched once; made rows draw a base, one of its neighbours and a share of the way, and join both.
    """
    sampled = materialize(
        sample_n(df.select(*row_id, *[F.col(f).cast("double").alias(f) for f in features], label), row_id, limit, seed)
    )
    positives = sampled.filter(F.col(label) == 1)
    n_pos, n_neg = positives.count(), sampled.filter(F.col(label) == 0).count()
    if n_pos * len(features) * 8 > 256 << 20:
        raise ValueError("the minority sample is too large to broadcast; lower the limit")
    missing = max(n_neg - n_pos, 0)
    plain = sampled.select(*features, label)
    if n_pos < 2 or missing == 0:
        return plain
    spark = df.sparkSession
    ordered = hash_rank(positives, row_id, "_r", seed)
    matrix = np.array([list(r) for r in ordered.orderBy("_r").select(*features).collect()])
    spread = matrix.std(axis=0)
    neighbours = min(k, n_pos - 1)
    edges = nearest_rows(spark, matrix, np.where(spread > 0, spread, 1.0), neighbours)
    first = ordered.agg(F.min("_r")).first()[0]
    point = lambda name: ordered.select((F.col("_r") - first).alias(name), F.struct(*features).alias(f"_{name}"))
    edges = materialize(edges.join(point("base"), "base").join(point("other"), "other"))

    draw = lambda salt: F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt))
    plan = spark.range(missing).select(
        (F.col("id") % n_pos).alias("base"),
        F.pmod(F.pmod(draw("pick"), F.lit(1 << 30)), F.lit(neighbours)).alias("place"),
        (F.pmod(draw("u"), F.lit(1 << 30)) / float(1 << 30)).alias("_u"),
    )
    made = plan.join(edges, ["base", "place"]).select(
        *[(F.col("_base")[f] + F.col("_u") * (F.col("_other")[f] - F.col("_base")[f])).alias(f) for f in features],
        F.lit(1).cast(dict(plain.dtypes)[label]).alias(label),
    )
    return plain.unionByName(made)


def imbalance_table(
    df: DataFrame, features: Sequence[str], label: str, row_id: Sequence[str], seed: int = 42, **params
) -> DataFrame:
    """The same model trained on full, weighted, undersampled and SMOTE data; metrics on one hold-out."""
    split = materialize(holdout_split(df, row_id, 0.25, [label], seed))
    train, valid = split.filter("is_test = 0"), split.filter("is_test = 1")
    rate = train.agg(F.avg(label)).first()[0]
    weighted = train.withColumn("_weight", balanced_weight(label, rate))
    variants = {
        "none": (train, None),
        "class_weighted": (weighted, "_weight"),
        "undersample": (undersample(train, row_id, label, seed), None),
        "smote": (smote(train, features, label, row_id, seed=seed), None),
    }
    table = None
    for name, (data, weight) in variants.items():
        model = gbt_classifier(features, label, weight, **params)(data)
        row = classifier_metrics(materialize(score(valid, model, "_p")), "_p", label, row_id).select(F.lit(name).alias("variant"), "*")
        table = row if table is None else table.unionByName(row)
    return table


def adversarial_validation(
    train: DataFrame, test: DataFrame, features: Sequence[str], row_id: Sequence[str], n: int | None = None, seed: int = 42, **params
) -> DataFrame:
    """AUC of telling training from test rows on a 30 % hold-out; above 0.6 the populations differ."""
    sides = [
        (sample_n(side, row_id, n, seed) if n else side).select(*row_id, *features).withColumn("label", F.lit(y))
        for y, side in enumerate((train, test))
    ]
    both = materialize(holdout_split(sides[0].unionByName(sides[1]), [*row_id, "label"], 0.3, ["label"], seed))
    model = gbt_classifier(features, **params)(both.filter("is_test = 0"))
    from ebbtide.operators.metrics import auc

    found = auc(score(both.filter("is_test = 1"), model, "p"), "p", "label")
    return found.withColumn("shift", (F.col("auc") > 0.6).cast("int"))


# ---- importance ---------------------------------------------------------------------------------------------------


def gain_importance(df: DataFrame, model: Transformer, features: Sequence[str]) -> DataFrame:
    """Rows ``(feature, importance)`` from the fitted trees."""
    gains = model.stages[-1].featureImportances.toArray()
    return df.sparkSession.createDataFrame([(f, float(g)) for f, g in zip(features, gains, strict=True)], "feature string, importance double")


def occlusion_importance(df: DataFrame, model: Transformer, features: Sequence[str]) -> DataFrame:
    """Mean absolute change of the score when one feature is replaced by its mean, all in one pass."""
    means = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    scored = score(df.select(*features), model, "_p")
    for i, f in enumerate(features):
        kept = scored.withColumnRenamed(f, "_kept").withColumn(f, F.lit(float(means[f] or 0.0)))
        scored = score(kept, model, f"_p{i}").drop(f).withColumnRenamed("_kept", f)
    changes = [F.avg(F.abs(F.col(f"_p{i}") - F.col("_p"))).alias(f"c{i}") for i in range(len(features))]
    rows = F.explode(
        F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"c{i}").alias("importance")) for i, f in enumerate(features)])
    )
    return scored.agg(*changes).select(rows.alias("r")).select("r.*")


def shuffle_column(df: DataFrame, column: str, row_id: Sequence[str], seed: int) -> DataFrame:
    """``df`` with one column permuted: two independent row numberings met by an equi-join."""
    rows = hash_rank(df, row_id, "_r", f"{seed}-rows").drop(column, "_r_of")
    values = hash_rank(df.select(*row_id, column), row_id, "_r", f"{seed}-values").select("_r", column)
    return rows.join(values, "_r").drop("_r")


def permutation_importance(
    df: DataFrame, risk: Callable[[DataFrame], DataFrame], features: Sequence[str], row_id: Sequence[str], repeats: int = 5, seed: int = 42,
    time: str = "time", event: str = "event",
) -> DataFrame:
    """Rows ``(feature, importance, std)``: loss of concordance when a feature is shuffled.

    ``risk`` adds a column ``risk`` to a table of features, times and events. A repeat shuffles all features by the same
    two numberings, made once, as ``shuffle_column`` does one. All shuffles are scored by one grouped concordance.
    """
    needed = ["risk", time, event]
    tables = risk(df).select(F.lit("").alias("feature"), F.lit(0).alias("repeat"), *needed)
    names = [f"_shuffled_{i}" for i in range(len(features))]
    for r in range(repeats):
        rows = hash_rank(df, row_id, "_r", f"{seed + r}-rows").drop("_r_of")
        values = df.select(*row_id, *[F.col(f).alias(name) for f, name in zip(features, names, strict=True)])
        values = hash_rank(values, row_id, "_r", f"{seed + r}-values").select("_r", *names)
        met = materialize(rows.join(values, "_r").drop("_r"))
        for f, name in zip(features, names, strict=True):
            shuffled = risk(met.withColumn(f, F.col(name)).drop(*names))
            tables = tables.unionByName(shuffled.select(F.lit(f).alias("feature"), F.lit(r).alias("repeat"), *needed))
    found = materialize(concordance(tables, "risk", time, event, by=["feature", "repeat"]))
    whole = found.filter("feature = ''").select(F.col("c_index").alias("whole"))
    losses = found.filter("feature != ''").join(F.broadcast(whole))  # one row
    return losses.groupBy("feature").agg(
        F.avg(F.col("whole") - F.col("c_index")).alias("importance"), F.stddev_pop(F.col("whole") - F.col("c_index")).alias("std")
    )


def cross_validated_concordance(
    df: DataFrame, fit_risk: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], k: int = 5, fold: str = "fold",
    time: str = "time", event: str = "event", parallelism: int = 5,
) -> DataFrame:
    """Rows ``(fold, c_index, mean, std)``; the last two (population std) repeat over the folds.

    A fit is a chain of jobs that mostly wait for the driver, so ``parallelism`` folds are fitted at a time.
    """

    def held(i: int) -> DataFrame:
        scored = fit_risk(df.filter(F.col(fold) != i))(df.filter(F.col(fold) == i)).withColumn("fold", F.lit(i))
        return scored.select("fold", "risk", time, event)

    with ThreadPoolExecutor(parallelism) as pool:
        tables = reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(df.sparkSession)(held), range(k)))
    found = concordance(tables, "risk", time, event, by=["fold"]).select("fold", "c_index")
    whole = W.partitionBy(F.lit(0))  # one row per fold
    return found.select("fold", "c_index", F.avg("c_index").over(whole).alias("mean"), F.stddev_pop("c_index").over(whole).alias("std"))
