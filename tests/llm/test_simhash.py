from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ebbtide.llm import simhash
from ebbtide.llm.queries import op5_simhash


def slow_fingerprint(text):
    tokens = [t for t in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if t]
    if not tokens:
        return 0
    grams = [" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, radius=2):
    fps = sorted(set(fps))
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= radius:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: slow_fingerprint(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    group = brute_groups(texts.values())
    least = {}
    for d, f in sorted(texts.items(), reverse=True):
        least[group[f]] = d
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in op5_simhash(spark, folder).collect()}
    assert found == {d: (f"{f:016x}", least[group[f]]) for d, f in texts.items()}


@pytest.mark.parametrize("n, block", [(10, 2048), (30_000, 2048), (3_000_000, 2048), (30_000, 8), (10, 4)])
def test_links_survive_any_tiling(spark, monkeypatch, n, block):
    """Chains and dense clusters, with the parts of a small and of a large table, and with tiles cut into blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(n + block)
    fps = [0, 1, 3, 2**64 - 1]
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(12):
            fps.append(f)
            f ^= 1 << rng.randrange(64)
            f ^= rng.choice([0, 1 << rng.randrange(64)])
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    found = simhash.components(simhash.near_edges(frame, n, 2)).collect()
    root = {r.node % 2**64: r.root % 2**64 for r in found}
    expected = brute_groups(fps)
    groups = {}
    for f in fps:
        groups.setdefault(expected[f], set()).add(root.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(3, 3)] + [(500, 400)] * 5
    frame = spark.createDataFrame(edges, "a long, b long")
    root = {r.node: r.root for r in simhash.components(frame).collect()}
    assert root == {**{i: 100 for i in range(101, 161)}, **{i: 7 for i in range(8, 40)}, 500: 400}
    assert simhash.components(frame.limit(0)).count() == 0


def test_awkward_rows(spark, awkward, nothing):
    rows = simhash.grouped(awkward).collect()
    assert len(rows) == awkward.count() and simhash.near_duplicates(nothing).count() == 0
    texts = awkward.select("doc_id", F.xxhash64("text").alias("h"), "text").collect()
    for r in rows:
        assert r.fp % 2**64 in {slow_fingerprint(t.text) for t in texts if t.doc_id == r.doc_id and len(t.text or "") < 10_000} or r.doc_id == 8
    assert {r.component_id for r in rows if r.fp == 0} == {1}


def test_keep_one(spark, awkward, nothing):
    kept = simhash.keep_one(awkward)
    assert kept.dtypes == awkward.dtypes and simhash.keep_one(nothing).count() == 0
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in kept.collect()) == sorted(
        [(1, ""), (4, "the q"), (4, "le re"), (0, "der s"), (7, "12345"), (8, "the q"), (9, "É"), (10, "el zo"), (11, "a\x00b <")]
    )


def test_forest_has_fewer_edges_than_values():
    rng = np.random.default_rng(0)
    a = np.uint64(5) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    (edges,) = simhash._links_between(np.unique(a), np.unique(a), 2, True)
    assert edges.shape[1] == len(np.unique(a)) - 1
