from __future__ import annotations

import re
from collections import Counter

import pytest

from ebbtide.llm import rules
from ebbtide.llm.queries import op7_quality_rules

from .conftest import ENGLISH

SPLIT = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = SPLIT.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {p for i, w in enumerate(windows) if seen[w] > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if SPLIT.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall("[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(covered),
    )


def counts(row):
    return tuple(row[c] for c in rules.COUNTS)


@pytest.fixture(scope="module")
def judged(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    return texts, op7_quality_rules(spark, folder).collect()


def test_counts_against_brute_force(judged):
    texts, rows = judged
    assert {r.doc_id: counts(r) for r in rows} == {d: brute(t) for d, t in texts.items()}
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed) and (r.kept or r.base_failed or r.ratio < -0.2)


def test_good_documents_stay_and_junk_goes(spark):
    folder = "/root/testdata/sf0.1"
    rows = op7_quality_rules(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("not base_failed")
    share = {r.quality: r["avg(CAST(kept AS INT))"] for r in rows.selectExpr("quality", "cast(kept as int)").groupBy("quality").avg("kept").toDF("quality", "avg(CAST(kept AS INT))").collect()}
    assert share[1] > 0.99 and share[0] < 0.2


def test_ratio_against_brute_force(spark):
    docs = [(1, "good text here good text"), (2, "bad ### text"), (3, None), (4, "good"), (5, "other words entirely"), (1, "copy of one id")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    r = rules.QualityRules(buckets=1 << 20)
    rows = rules.judge(frame, spark.createDataFrame([(1,), (1,), (4,), (99,), (None,)], "doc_id long"), r).collect()
    import math

    def grams(text):
        w = SPLIT.findall(text or "")
        return [(x,) for x in w] + list(zip(w, w[1:], strict=False))

    raw, target = Counter(), Counter()
    for d, t in docs:
        raw.update(grams(t))
        if d in (1, 4):
            target.update(grams(t))
    n_raw, n_target = sum(raw.values()) + r.buckets, sum(target.values()) + r.buckets
    expected = []
    for d, t in docs:
        g = grams(t)
        total = sum(math.log((target[x] + 1) / n_target) - math.log((raw[x] + 1) / n_raw) for x in g)
        expected.append((d, round(total / max(1, len(g)), 5)))
    assert sorted((x.doc_id, round(x.ratio, 5)) for x in rows) == sorted(expected)


def test_awkward_rows(spark, awkward, nothing):
    trusted = spark.createDataFrame([(4,)], "doc_id long")
    rows = rules.judge(awkward, trusted).collect()
    expected = [brute(r.text) for r in awkward.collect()]
    assert sorted(map(counts, rows)) == sorted(expected)
    assert rules.judge(nothing, trusted).count() == 0
    assert {r.ratio for r in rules.judge(awkward, trusted.limit(0)).collect()} == {0.0}


def test_repeated_windows(spark):
    texts = ["a b c d e " * 4, "a b c d e x a b c d e", "a a a a a", "a a a a a a", "1 2 3 4 5 6 1 2 3 4 5", "a b c d", ENGLISH]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.n_repeat_words for r in rules.with_counts(frame).collect()}
    assert found == {i: brute(t)[4] for i, t in enumerate(texts)}
