from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from ebbtide.llm import secrets
from ebbtide.llm.queries import op4_secrets

BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile("[0-9a-f]+"), 0, 16),
}


def brute(text):
    found = [
        (m.start(), i, kind, m.end())
        for i, (kind, (regex, group, least)) in enumerate(BASE.items())
        for m in regex.finditer(text or "")
        if len(m.group(group)) >= least
    ]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def made_texts(n=300):
    rng = random.Random(5)
    bits = ["token", "Api_Key", "APIKEY", "passwd", "PASSWORD", "secret", '"', "'", " = ", ":", "=", "AKIA", "ABCDEFGH12345678", "deadbeef01234567", "é", "\n", "0123456789abcdef0", "ſecret", "toKen", "xyz/+_.=-", "ghp_" + "a" * 36, "hello "]
    return ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(n)]


def test_base_spans_equal_full_scan():
    texts = [*made_texts(), None, "", "x" * 10_000 + ' password="abcdefghijkl" ' + "y" * 10_000]
    for size in (100, secrets.SEGMENT_BYTES):
        found = secrets.Scanner(secrets.RULES, size).scan(texts)
        assert [[s for s in f if s[0] in BASE] for f in found] == [brute(t) for t in texts]


def test_pieces_of_a_segment(monkeypatch):
    monkeypatch.setattr(secrets, "BLOCK", 64)
    texts = made_texts(60)
    assert [[s for s in f if s[0] in BASE] for f in secrets.Scanner(secrets.RULES).scan(texts)] == [brute(t) for t in texts]


def test_trigram_queries():
    def query(pattern, flags=0):
        return {frozenset(c) for c in secrets.trigram_query(pattern, flags)}

    assert query("abcd") == {frozenset({"abc", "bcd"})}
    assert query("abc|xyz") == {frozenset({"abc"}), frozenset({"xyz"})}
    assert query("[0-9a-f]+") == query("a*") == query("ab") == query("(abc)?") == {frozenset()}
    assert query("abc[0-9]*xyz") == {frozenset({"abc", "xyz"})}
    assert query("a[bc]d") == {frozenset({"abd"}), frozenset({"acd"})}
    assert query("KEY", re.I) == {frozenset()} and query("KEY", re.I | re.A) == {frozenset({"key"})}
    assert secrets.RULES[2].query == secrets.EVERYTHING and secrets.EVERYTHING not in [r.query for r in secrets.RULES[:2]]


def test_every_match_fulfils_its_query():
    for text in made_texts(200):
        for rule in secrets.RULES:
            if any(True for _ in rule.spans(text)):
                low = text.encode().lower().decode()
                assert any(all(t in low for t in clause) for clause in rule.query)


def test_more_rules_and_awkward_rows(spark, awkward, nothing):
    found = secrets.Scanner(secrets.RULES).scan(["a ghp_" + "Z" * 36 + " -----BEGIN RSA PRIVATE KEY-----", "sk_live_" + "1" * 24])
    assert [[k for k, _, _ in f] for f in found] == [["forge", "pem"], ["payment", "hex"]]
    rows = awkward.select("text", secrets.find_secrets(F.col("text")).alias("s")).collect()
    assert all([tuple(x) for x in r.s] == brute(r.text) for r in rows)
    assert nothing.select(secrets.find_secrets(F.col("text"))).count() == 0


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in op4_secrets(spark, folder).collect():
        spans = brute(texts[r.doc_id])
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert r.base_sha256 == digest and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in spans) for kind in BASE)
