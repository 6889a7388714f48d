from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ebbtide.llm import decontaminate, language, mixing, pii, simhash
from ebbtide.llm.queries import DOMAINS, LANGUAGES, PII_KEY, SOURCES, domain_of_source

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage, each written and read again."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, FOLDER).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert before.dtypes == after.dtypes


def test_language_stage(stages):
    """Every document with a letter stays; a null language becomes the predicted one."""
    before, after = stages[0]
    kept = {r.doc_id: r for r in before.collect() if r.text and any(map(str.isalpha, r.text))}
    model = language.fit(before.select("text", "lang"))
    expected = {d: r.lang or model.predict(r.text)[0] for d, r in kept.items()}
    assert {r.doc_id: r.lang for r in after.collect()} == expected


def test_language_stage_fills_null_languages(spark, awkward):
    """The prediction stands where the language is unknown, and nowhere else."""
    model = language.fit(awkward.select("text", "lang"))
    found = corpus_pipeline.language_id(spark, awkward, FOLDER)
    assert found.dtypes == awkward.dtypes
    told = [r for r in awkward.collect() if r.text and any(map(str.isalpha, r.text))]
    expected = [r.lang or model.predict(r.text)[0] for r in told]
    assert sorted(r.lang for r in found.collect()) == sorted(expected) and any(r.lang is None for r in told)


def test_simhash_stage(stages):
    """One document of each group linked by five-word similarity of 0.8 or more: the one of the smallest id."""
    before, after = stages[1]
    from .test_shingles import brute_groups

    group, least = brute_groups([(r.doc_id, r.text) for r in before.collect()]), {}
    for d, g in sorted(group.items(), reverse=True):
        least[g] = d
    assert ids(after) == sorted(least.values()) and len(least) < len(group)


def test_decontamination_stage(spark, stages):
    before, after = stages[2]
    from .test_decontaminate import brute

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert ids(after) == sorted(r[0] for r in brute([(r.doc_id, r.text) for r in before.collect()], items) if not r[2])


def test_pii_stage(stages):
    before, after = stages[3]
    model = pii.fit(before, PII_KEY)
    expected = {r.doc_id: model.replace(r.text)[0] for r in before.collect()}
    assert {r.doc_id: r.text for r in after.collect()} == expected
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_mixing_stage(stages):
    before, after = stages[4]
    from .test_mixing import brute

    rows = before.withColumn("domain", domain_of_source()).withColumn("n", F.size(mixing.words_of(F.col("text")))).collect()
    docs = [(r.doc_id, r.domain, r.lang or "?", r.source or "?", r.n) for r in rows]
    expected = brute(docs, {"domain": DOMAINS, "lang": LANGUAGES, "source": SOURCES}, (1, 1), corpus_pipeline.MAX_EPOCHS, 1)
    found = sorted(((r.doc_id, r.domain, r.lang, r.source, r.n_tokens, r.epoch, r.take_tokens) for r in after.collect()), key=repr)
    assert found == expected


def test_run_equals_stages(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, stages[-1][1].select(got.columns).collect()))


def test_awkward_and_empty_tables_pass_all_stages(spark, awkward, nothing, tmp_path):
    for k, docs in enumerate((awkward, nothing)):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, FOLDER).write.parquet(path := str(tmp_path / f"{k}-{i}"))
            out = spark.read.parquet(path)
            if name != "mixing":
                assert out.columns == docs.columns
            docs = out
        assert (docs.count() > 0) == (k == 0)


def test_every_stage_calls_its_operator():
    owners = (language, simhash, decontaminate, pii, mixing)
    assert len(corpus_pipeline.STAGES) == len(owners)
