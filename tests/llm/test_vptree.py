from __future__ import annotations

import numpy as np
import pytest

from ebbtide.llm import vptree
from ebbtide.llm.queries import op12_neighbours


def slow_neighbours(ids, vectors, asked, k=5):
    """``{query: [(id, score)]}`` by scores of all pairs."""
    out = {}
    for i in asked:
        score = vptree.cosine(vectors, np.broadcast_to(vectors[ids.index(i)], vectors.shape))
        out[i] = sorted(((float(-s), j) for s, j in zip(score, ids, strict=True) if j != i))[:k]
    return {q: [(j, -s) for s, j in found] for q, found in out.items()}


def as_lists(found):
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, vectors = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    found = op12_neighbours(spark, folder)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert as_lists(found.collect()) == slow_neighbours(ids, vectors, [i for i in ids if i % 50 == 0])


def grown(ids, vectors, leaf):
    points, own, starts = vptree.distinct_points(np.asarray(ids), vptree.scaled(vectors))
    order, nodes = vptree.grow(points, leaf)
    lists = [own[starts[o] : starts[o + 1]] for o in order]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    return vptree.Tree(np.concatenate(lists), bounds, points[order], *[nodes[k] for k in ("vantage", "left", "right", "first", "last", "bounds")])


@pytest.mark.parametrize("leaf", [1, 2, 7, 64])
@pytest.mark.parametrize("kind", ["clusters", "line", "copies"])
def test_factor_one_is_exact(leaf, kind):
    rng = np.random.default_rng(leaf)
    if kind == "clusters":
        vectors = rng.standard_normal((8, 6)).repeat(40, 0) + 0.05 * rng.standard_normal((320, 6))
    elif kind == "line":
        vectors = np.column_stack([np.cos(np.arange(320) / 100), np.sin(np.arange(320) / 100)])
    else:
        vectors = rng.integers(-1, 2, (320, 3)) + np.array([0.5, 0, 0])
        vectors[::3] = [1.0, 2.0, 3.0]
    ids = rng.permutation(320).tolist()
    tree = grown(ids, vectors, leaf)
    rows, found, score = tree.nearest(np.array(ids), vptree.scaled(vectors), 5, 1.0)
    got = {}
    for q, i, s in zip(rows, found, score, strict=True):
        got.setdefault(ids[q], []).append((i, s))
    assert got == slow_neighbours(ids, vectors, ids)


def test_pruning_and_relaxation():
    """Clustered points let most comparisons go; a larger factor compares less and still finds nine in ten."""
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((60, 8)).repeat(100, 0) + 0.1 * rng.standard_normal((6000, 8))
    ids, asked = list(range(6000)), list(range(0, 6000, 50))
    expected = slow_neighbours(ids, vectors, asked)
    compared, recall = [], []
    for factor in (1.0, 1.5, 2.5):
        tree = grown(ids, vectors, 32)
        rows, found, _ = tree.nearest(np.array(asked), vptree.scaled(vectors[asked]), 5, factor)
        compared.append(tree.compared / len(asked) / 6000)
        recall.append(sum(len({j for j, _ in expected[q]} & set(found[rows == i])) for i, q in enumerate(asked)) / (5 * len(asked)))
    assert recall[0] == 1.0 and min(recall) >= 0.9
    assert compared[0] < 0.5 and compared == sorted(compared, reverse=True) and compared[-1] < compared[0]


def test_awkward_vectors(spark):
    rng = np.random.default_rng(9)
    good = [(i, rng.standard_normal(4).tolist(), 1, "s", "r") for i in range(120)]
    same = [(200 + i, [0.5, 0.5, 0.0, 0.0], 1, "s", "r") for i in range(150)]
    odd = [
        (50, [0.0] * 4, 1, "s", "r"),
        (250, None, 1, "s", "r"),
        (300, [], 1, "s", "r"),
        (350, [1.0, None, 0.0, 0.0], None, None, None),
        (400, [float("nan"), 1.0, 0.0, 0.0], 1, "s", "r"),
        (450, [1.0, 2.0], 1, "s", "r"),
        (None, [1.0, 0.0, 0.0, 0.0], None, None, None),
        (3, good[3][1], 1, "s", "r"),
        (1000, [2.0**-1000, 2.0**-1000, 0.0, 0.0], 1, "s", "r"),
        (1050, [2.0**1000, 2.0**1000, 0.0, 0.0], 1, "s", "r"),
    ]
    rows = [r for r in good if r[0] != 50] + same + odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, shard string, role string")
    sound = {r[0]: r[1] for r in rows if r[0] is not None and r[1] and len(r[1]) == 4 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}
    ids = list(sound)
    vectors = vptree.scaled(np.array(list(sound.values())))
    found = as_lists(vptree.neighbours(df, lambda i: i % 50 == 0, leaf=8).collect())
    expected = slow_neighbours(ids, vectors, [i for i in ids if i % 50 == 0])
    assert {0, 100, 200, 250, 300, 1000, 1050} == set(found)
    assert {q: [j for j, _ in v] for q, v in found.items()} == {q: [j for j, _ in v] for q, v in expected.items()}
    assert [j for j, _ in found[250]] == [200, 201, 202, 203, 204] == [j for j, _ in found[1000]]  # powers of two change no cosine
    assert vptree.neighbours(df.limit(0), lambda i: i % 50 == 0).count() == 0
    few = vptree.neighbours(df.where("vec_id in (0, 1, 2)"), lambda i: i % 50 == 0).collect()
    assert sorted(r["rank"] for r in few) == [1, 2]


def test_equal_ids_are_queries_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])]
    found = vptree.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i == 0, k=1).collect()
    assert sorted((r.query_id, r.vec_id) for r in found) == [(0, 1), (0, 2)]


def test_shards_stay_bounded():
    assert vptree.shard_count(10**9, 64, 8) * vptree.SHARD_BYTES >= 10**9 * 64 * 8
    assert vptree.shard_count(1, 64, 8) == 1
