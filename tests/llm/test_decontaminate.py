from __future__ import annotations

import random
import re

import pytest

from ebbtide.llm import decontaminate

from .conftest import ENGLISH, FRENCH

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, words string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, width=10, slop=0):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1)):
            if w:
                windows.setdefault(tuple(w[i : i + width]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found, near = words(text), set(), set(), set()
        for window, ids in windows.items():
            for i in range(len(w)):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found |= ids
        if slop:
            for window, ids in windows.items():
                if any(all(t in w[max(0, i + o - slop) : max(0, i + o + slop + 1)] for o, t in enumerate(window)) for i in range(-slop, len(w))):
                    near |= ids
        out.append((doc_id, len(w), len(hit), sorted(found), sorted(near - found)))
    return sorted(out, key=repr)


def run(spark, docs, items, width=10, slop=0):
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), width, slop).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.near_items) for r in found), key=repr)


def test_awkward_rows(spark, awkward, nothing):
    items = [(1, ENGLISH), (2, "LAZY dog"), (3, "É"), (None, "fox"), (2, FRENCH), (5, None), (6, ""), (7, "never seen words"), (1, ENGLISH)]
    docs = [(r.doc_id, r.text) for r in awkward.collect() if len(r.text or "") < 1000]
    small = awkward.where("text is null or length(text) < 1000")
    assert run(spark, small, items) == brute(docs, items)
    assert run(spark, nothing, items) == []
    assert all(not r[2] for r in run(spark, awkward, []))
    long_row = next(r for r in run(spark, awkward, items) if r[0] == 8)
    assert long_row[1] == 3000 * len(words(ENGLISH)) == long_row[2]


@pytest.mark.parametrize("slop", [0, 1])
def test_random_texts(spark, slop):
    rng = random.Random(slop)
    docs = [(i, " ".join(rng.choices("a b c d e f g h Éa".split(), weights=[9, 5, 3, 2, 2, 1, 1, 1, 1], k=rng.randint(0, 60)))) for i in range(40)]
    items = [(i, " ".join(rng.choices("a b c d e f g h".split(), k=rng.randint(0, 7)))) for i in range(12)]
    found = run(spark, spark.createDataFrame(docs, "doc_id long, text string"), items, 4, slop)
    expected = brute(docs, items, 4)
    assert [r[:4] for r in found] == [r[:4] for r in expected]


def test_proximity_catches_one_inserted_word(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, text), (2, text.replace("delta", "delta new")), (3, text.replace("delta", "delta quite new")), (4, "none of it")]
    found = run(spark, spark.createDataFrame(docs, "doc_id long, text string"), [(9, text)], 10, 1)
    assert [(r[0], r[3], r[4]) for r in found] == [(1, ["9"], []), (2, [], ["9"]), (3, [], []), (4, [], [])]


def test_keep_clean(spark, awkward):
    kept = decontaminate.keep_clean(awkward, spark.createDataFrame([(1, ENGLISH, "")], ITEMS))
    assert kept.columns == awkward.columns and kept.dtypes == awkward.dtypes
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, [1, 2, 3, 4, None, None, 7, 9, 10, 11]))
