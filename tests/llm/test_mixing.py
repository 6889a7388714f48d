from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ebbtide.llm import mixing


def fill(available, children):
    """Water filling by repeated passes: children (name, weight, capacity) to whole-token budgets."""
    children = {n: (w, c) for n, w, c in children if w and c}
    full, rest = {}, available
    while True:
        left = {n: v for n, v in children.items() if n not in full}
        total = sum(w for w, _ in left.values())
        short = {n: c for n, (w, c) in left.items() if c * total <= rest * w}
        if not short:
            break
        full |= short
        rest -= sum(short.values())
    out = {n: rest * w // total for n, (w, _) in left.items()}
    for n in sorted(out)[: rest - sum(out.values()) if out else 0]:
        out[n] += 1
    return full | {n: min(v, children[n][1]) for n, v in out.items()}


def brute(docs, weights, share, epochs, seed):
    supply = defaultdict(int)
    for _, domain, lang, source, n in docs:
        supply[domain, lang, source] += n
    supply = {k: v for k, v in supply.items() if v}

    def below(prefix):
        return sum(v * epochs for k, v in supply.items() if k[: len(prefix)] == prefix)

    total = sum(supply.values())
    budgets = {(): min(total * share[0] // share[1], total * epochs)}
    for depth, level in enumerate(("domain", "lang", "source")):
        step = {}
        for node, budget in budgets.items():
            names = {k[depth] for k in supply if k[:depth] == node}
            got = fill(budget, [(n, weights.get(level, {}).get(n, 1), below((*node, n))) for n in names])
            step |= {(*node, n): b for n, b in got.items()}
        budgets = step
    out = []
    for leaf, budget in budgets.items():
        whole, rest = divmod(budget, supply[leaf])
        own = [d for d in docs if d[1:4] == leaf and d[4]]
        out += [(*d, e, d[4]) for e in range(1, whole + 1) for d in own]
        order = sorted(own, key=lambda d: (hashlib.md5(f"{seed}:{whole + 1}:{'?' if d[0] is None else d[0]}".encode()).hexdigest(), d[0] or -1, d[4]))
        for d in order:
            if rest <= 0:
                break
            out.append((*d, whole + 1, min(d[4], rest)))
            rest -= d[4]
    return sorted(out, key=repr)


def run(docs, *args):
    rows = mixing.mix(docs, F.col("domain"), *args).collect()
    return sorted(((r.doc_id, r.domain, r.lang, r.source, r.n_tokens, r.epoch, r.take_tokens) for r in rows), key=repr)


@pytest.mark.parametrize("case", range(6))
def test_against_brute_force(spark, monkeypatch, case):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    rng = random.Random(case)
    docs = []
    for i in range(400):
        source = rng.choices(["s0", "s1", "s2", "s3", "s4"], weights=[60, 10, 5, 2, 1])[0]
        docs.append((i, rng.choice("ab") if source != "s4" else "c", rng.choice(["en", "fr"]), source, rng.randint(0, 30)))
    frame = spark.createDataFrame([(d, dom, lang, s, "w " * n) for d, dom, lang, s, n in docs], "doc_id long, domain string, lang string, source string, text string")
    weights = {"domain": {"a": 5, "b": 2, "c": 9}, "lang": {"en": 3}, "source": {"s0": rng.choice([0, 1]), "s3": 50}}
    share = rng.choice([(1, 1), (1, 3), (5, 2), (100, 1)])
    found = run(frame, weights, share, 3, case)
    assert found == brute(docs, weights, share, 3, case)
    total = sum(d[4] for d in docs)
    if not share[0] == 100 and weights["source"]["s0"]:
        assert sum(r[6] for r in found) == total * share[0] // share[1] or share[0] / share[1] > 1


def test_shortage_goes_to_siblings_first(spark):
    rows = [(i, d, lang, s, "w " * 10) for i, (d, lang, s) in enumerate([("a", "en", "short")] + [("a", "en", "long")] * 20 + [("a", "fr", "x")] * 20 + [("b", "en", "y")] * 40)]
    frame = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, text string")
    found = defaultdict(int)
    for r in run(frame, {}, (1, 2), 1, 1):
        found[r[1:4]] += r[6]
    assert dict(found) == {("a", "en", "short"): 10, ("a", "en", "long"): 92, ("a", "fr", "x"): 101, ("b", "en", "y"): 202}


def test_awkward_rows(awkward, nothing):
    named = awkward.withColumn("domain", F.lit(None).cast("string"))
    rows = run(named, {}, (1, 1), 2, 1)
    assert {r[1] for r in rows} == {"?"} and all(r[4] > 0 for r in rows)
    assert sum(1 for r in rows if r[0] == 4) >= 3
    assert run(nothing.withColumn("domain", F.lit("x")), {}, (1, 1), 2, 1) == []
