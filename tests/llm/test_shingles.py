from __future__ import annotations

import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest

from ebbtide.llm import shingles, simhash
from ebbtide.session import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words5(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(texts):
    """Pairs of different shingle sets with similarity of 0.8 or more, all pairs that share a shingle compared."""
    sets = sorted({words5(t) for t in texts if t}, key=sorted)
    held = {}
    for i, s in enumerate(sets):
        for g in sorted(s)[: len(s) - -(-4 * len(s) // 5) + 1]:
            held.setdefault(g, []).append(i)
    pairs = {p for rows in held.values() for p in combinations(rows, 2)}
    return [(sets[i], sets[j]) for i, j in sorted(pairs) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]


def root_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.root for r in shingles.grouped(docs).collect()}


def same_groups(found, expected):
    return len({(found[d], expected[d]) for d in found}) == len(set(found.values())) == len(set(expected.values()))


def brute_groups(rows):
    texts = dict(rows)
    parent = {words5(t): words5(t) for t in texts.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute_links(texts.values()):
        parent[find(a)] = find(b)
    return {d: find(words5(t)) for d, t in texts.items()}


def test_near_copies_leave_the_pipeline_stage(spark):
    """Copies with one changed word in 200 differ in more than 2 bits of a 3-word fingerprint."""
    rng, rows = random.Random(5), []
    for k in range(20):
        text = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((2 * k, " ".join(text), "en", "src1", 0))
        text[rng.randrange(200)] = "changed"
        rows.append((2 * k + 1, " ".join(text), "en", "src1", 0))
    kept = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 40, 2))


def test_stage_links_by_simhash_too(spark):
    """Texts that repeat one passage have near fingerprints, though their sets share less than four fifths."""
    rng, rows = random.Random(11), []
    for k in range(6):
        passage = [f"p{rng.randrange(10**6)}" for _ in range(7)] * 100
        for j in range(2):
            own = [f"t{rng.randrange(10**6)}" for _ in range(30)]
            rows.append((2 * k + j, " ".join(passage + own), "en", "src1", 0))
    texts = [r[1] for r in rows]
    prints = [simhash.fingerprint(t, 5) for t in texts]
    assert all((prints[k] ^ prints[k + 1]).bit_count() <= 2 for k in range(0, 12, 2)) and not brute_links(texts)
    kept = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 12, 2))


@pytest.mark.parametrize("text", [None, " ", "a", "a b c d", "a b c d e", "A b c d e f " * 5000])
def test_print_and_set_are_those_of_their_operators(text):
    found, items = shingles.print_and_set(text)
    assert found == simhash.fingerprint(text, 5) and items.tolist() == sorted(set(shingles.shingle_set(text).tolist()))
    assert len(items) == len(words5(text))


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_recall_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = {r.doc_id: r.root for r in shingles.grouped(docs).collect()}
    assert brute_links(dict(rows).values()) and same_groups(found, brute_groups(rows))


@pytest.mark.parametrize("block, size", [(512, 1 << 20), (4, 1 << 20), (512, 2000)])
def test_dense_groups_and_both_sides_of_the_threshold(spark, monkeypatch, block, size):
    monkeypatch.setattr(shingles, "BLOCK", block)
    monkeypatch.setattr(shingles, "BLOCK_BYTES", size)
    monkeypatch.setattr(shingles, "BATCH_BYTES", size)
    rng, rows = random.Random(block), [(1, None), (2, " "), (3, "a b"), (4, "A  b"), (5, "a c")]
    for _ in range(3):
        base = [f"w{rng.randrange(900)}" for _ in range(60)]
        for _ in range(25):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(60)] = f"x{rng.randrange(9)}"
            rows.append((len(rows) + 1, " ".join(text)))
    assert same_groups(root_of(spark, rows), brute_groups(rows))


def test_many_very_long_texts(spark):
    """Sets of 30,000 shingles meet in blocks bounded in bytes; near copies of all of them are found."""
    rng, rows = random.Random(3), []
    base = [f"w{rng.randrange(50_000)}" for _ in range(30_000)]
    for k in range(40):
        text = list(base) if k % 2 else [f"v{k}{rng.randrange(50_000)}" for _ in range(30_000)]
        text[rng.randrange(30_000)] = f"x{k}"
        rows.append((k, " ".join(text)))
    found = root_of(spark, rows)
    assert len({found[k] for k in range(1, 40, 2)}) == 1 and len(set(found.values())) == 21


def test_exact_threshold():
    a = np.arange(9, dtype=np.uint64)
    assert shingles.links_within([a[:8], a[1:9]]).tolist() == []  # 7 of 9
    assert shingles.links_within([a, a[:7]]).tolist() == []
    assert shingles.links_within([a[:5], a[:4], a[:5] + np.uint64(50)]).tolist() == [[0, 1]]  # 4 of 5
    assert shingles.links_within([a[:4]], [a[4:], a[:5]]).tolist() == [[0, 1]]


def test_awkward_rows(spark, awkward, nothing):
    assert materialize(shingles.grouped(awkward)).count() == awkward.count() and shingles.grouped(nothing).count() == 0
