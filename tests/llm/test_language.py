from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ebbtide.llm import language
from ebbtide.llm.queries import op1_language_id

from .conftest import ENGLISH, FRENCH, GERMAN, SPANISH

FOLDER = "/root/testdata/sf0.01"


def predict(model, df):
    return df.select("doc_id", "text", language.identify(model, F.col("text")).alias("p")).select("doc_id", "text", "p.*").collect()


@pytest.fixture(scope="module")
def four(spark):
    rows = [(" ".join(t.split()[i:] + t.split()[:i]), lang) for lang, t in (("en", ENGLISH), ("fr", FRENCH), ("de", GERMAN), ("es", SPANISH)) for i in range(12)]
    return spark.createDataFrame(rows, "text string, lang string")


def test_held_out_accuracy(spark):
    found = op1_language_id(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id")
    row = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert row[0] > 0.97 and 0 <= row[1] and row[2] <= 1


def test_family_then_pair(four, awkward):
    model = language.fit(four)
    assert set(model.pairs) == {("de", "en"), ("es", "fr")}
    found = predict(model, awkward)
    for r in found:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.family) == ("und", 0.0, None)
        else:
            assert r.lang_pred in {"de", "en", "es", "fr"} and language.FAMILY_OF[r.lang_pred] == r.family
    known = {r.text: r.lang_pred for r in found}
    assert [known[t] for t in (ENGLISH, FRENCH, GERMAN, SPANISH)] == ["en", "fr", "de", "es"]


def test_no_labels_one_label_unknown_label(spark, four, awkward, nothing):
    assert {r.lang_pred for r in predict(language.fit(four.limit(0)), awkward)} == {"und"}
    assert {r.lang_pred for r in predict(language.fit(four.where("lang = 'en'")), awkward)} == {"en", "und"}
    model = language.fit(four.withColumn("lang", F.when(F.col("lang") == "de", "xx").otherwise(F.col("lang"))))
    assert model.languages["xx"] == ["xx"] and not predict(model, nothing)


def test_sample_is_bounded_and_loses_no_label(spark):
    rows = [(f"word{i} some text", "en") for i in range(2000)] + [("copy", "fr")] * 500 + [("solo texte", "de")]
    sample, labels = language.labelled_sample(spark.createDataFrame(rows, "text string, lang string"), 100)
    n = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert labels == ["de", "en", "fr"] and 50 < n["en"] < 200 and n["fr"] == n["de"] == 1


def test_profile_of_pieces_equals_whole(monkeypatch):
    text = (ENGLISH + " ") * 50
    whole = language.trigram_profile(text, 512)
    monkeypatch.setattr(language, "BLOCK", 1001)
    assert abs(whole - language.trigram_profile(text, 512)).max() < 1e-12
