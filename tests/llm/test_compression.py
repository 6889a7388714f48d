from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.llm import compression
from ebbtide.llm.queries import op9_quality

from .conftest import ENGLISH, FRENCH, GERMAN, SPANISH

FOLDER = "/root/testdata/sf0.1"


def test_held_out_scores_rank_quality(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality")
    rows = op9_quality(spark, FOLDER).where("held_out").join(labels, "doc_id").toPandas()
    good, bad = rows.score[rows.quality == 1], rows.score[rows.quality == 0]
    ranks = rows.score.rank()
    auc = (ranks[rows.quality == 1].sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad))
    assert auc > 0.95 and (good >= 0.5).mean() > 0.95 and (bad < 0.5).mean() > 0.8
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.5) == rows.predicted).all()


def training(spark):
    good = [(i, " ".join((t.split()[i % 7 :] + t.split())[:30]), 1) for i, t in enumerate([ENGLISH, FRENCH, GERMAN, SPANISH] * 20)]
    bad = [(1000 + i, f"BUY!! NOW!! $$$ click### here%%% {i} " * 3, 0) for i in range(80)]
    frame = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    return frame.drop("quality"), frame.drop("text")


def score(model, df):
    return [r.s for r in df.select(compression.quality_score(model, F.col("text")).alias("s")).collect()]


def test_whole_text_counts(spark):
    model = compression.fit(*training(spark))
    scorer = model.scorer()
    good, bad = f"{ENGLISH} {FRENCH} " * 40, "BUY!! NOW!! $$$ click### here%%% " * 200
    assert scorer.score(good) > 0.5 > scorer.score(bad)
    assert scorer.score(good + bad) < scorer.score(good) and scorer.score(bad + good) > scorer.score(bad)


def test_awkward_rows(spark, awkward, nothing):
    docs, labels = training(spark)
    model = compression.fit(docs, labels)
    scores = score(model, awkward)
    assert all(0 <= s <= 1 for s in scores) and score(model, nothing) == []
    texts = [r.text for r in awkward.collect()]
    assert len({s for s, t in zip(scores, texts, strict=True) if not t}) == 1
    none = compression.fit(docs, labels.limit(0))
    assert set(score(none, awkward)) == {0.5}
    one = compression.fit(docs, labels.where("quality = 1"))
    assert set(score(one, awkward)) == {0.99}


def test_sample_takes_the_lower_of_two_labels(spark):
    docs, labels = training(spark)
    twice = labels.unionByName(labels.where("quality = 1").withColumn("quality", F.lit(0)))
    sample = compression.labelled_sample(docs.unionByName(docs), twice, 10_000)
    assert len(sample) == 160 and {y for _, y in sample} == {0}
    assert len(compression.labelled_sample(docs, labels, 10)) <= 40


def test_sample_is_bounded_and_repeatable(spark):
    docs, labels = training(spark)
    sample = compression.labelled_sample(docs, labels, 10)
    assert [sum(y == q for _, y in sample) for q in (0, 1)] == [10, 10]
    moved = compression.labelled_sample(docs.repartition(7), labels.repartition(5, "quality"), 10)
    assert moved == sample
    longest = spark.createDataFrame([(i, "x" * 5000) for i in range(2000, 2040)], "doc_id long, text string")
    marked = longest.select("doc_id", F.lit(1).alias("quality"))
    small = compression.labelled_sample(docs.unionByName(longest), labels.unionByName(marked), 1000, 16 * 400)
    assert all(len(t.encode()) <= 400 for t, _ in small)
    for quality in (0, 1):
        assert 0 < sum(len(t.encode()) for t, y in small if y == quality) <= 16 * 400
    assert compression.labelled_sample(docs.limit(0), labels, 10) == []
