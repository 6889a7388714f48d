from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.llm import importance
from ebbtide.llm.queries import op13_importance

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def slow_resample(docs, target, buckets=10_000, share=(5, 100), least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    parts = [(d, *slow_features(t)) for d, t in docs]
    s, t = Counter(), Counter()
    for _, _, features in parts:
        s.update(map(bucket, features))
    for text in target:
        t.update(map(bucket, slow_features(text)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for d, words, features in parts:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in features)
        rows.append((d, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = able[: len(able) * share[0] // share[1]]
    return rows, drawn


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows, drawn = slow_resample(docs, target)
    rank = {r[0]: i for i, r in enumerate(drawn, 1)}
    found = sorted(tuple(r) for r in op13_importance(spark, folder).collect())
    assert found == sorted((d, f, w, s, rank.get(d)) for d, _, f, w, s in rows)
    assert 0 < len(rank) < len(rows)


def test_checksums_of_runs():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in [*rng.integers(1, 12, 300), 63, 64, 65, 500, 1, 64]]
    for k, sums in enumerate(importance.run_checksums(words), 1):
        assert sums.tolist() == [zlib.crc32(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 1 << 16])
def test_pieces_of_long_texts_count_every_run_once(monkeypatch, chunk):
    monkeypatch.setattr(importance, "CHUNK_WORDS", chunk)
    texts = ["a b c d e f g a b c", None, "", "x", "x y", "é É Z-9_q " * 7]
    found = Counter()
    for owner, bucket, _ in importance.feature_buckets([t and t.encode() for t in texts], 10_000):
        found.update(zip(owner.tolist(), bucket.tolist(), strict=True))
    assert found == Counter((i, zlib.crc32(f.encode()) % 10_000) for i, t in enumerate(texts) for f in slow_features(t)[1])


def test_awkward_rows(spark, awkward, nothing):
    target = spark.createDataFrame([("the lazy dog",), (None,)], "text string")
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    rows, drawn = slow_resample(docs, ["the lazy dog"], share=(50, 100), least=3)
    found = importance.resample(awkward, target, share=(50, 100), least_words=3).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, (r[:5] for r in found)), key=key) == sorted(rows, key=key)
    assert [tuple(r[:5]) for r in sorted((r for r in found if r.rank), key=lambda r: r.rank)] == drawn
    assert importance.resample(nothing, target).count() == 0
    assert {r.rank for r in importance.resample(awkward, target.limit(0)).collect()} == {None}


def test_kth_key_and_ranks_with_ties(spark):
    """A third of the rows share one key but for the row number; every k is found and ranks are whole."""
    rows = spark.range(300).select(
        F.struct(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("b"), F.col("id").alias("row")).alias("key")
    ).repartition(5)
    order = sorted((tuple(r.key) for r in rows.collect()), key=lambda t: (t[0], t[1] is not None, t[1] or 0, t[2]))
    for k in (1, 2, 150, 299, 300):
        assert tuple(importance.kth_key(rows, "key", k, pivots=3).values()) == order[k - 1]
    assert importance.kth_key(rows, "key", 0) is None and importance.kth_key(rows, "key", 301) is None
    placed = importance.ranked(rows, "key", "place").collect()
    assert [tuple(r.key) for r in sorted(placed, key=lambda r: r.place)] == order
    assert sorted(r.place for r in placed) == list(range(1, 301))
