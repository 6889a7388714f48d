from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from ebbtide.functions import columns as C
from ebbtide.operators import audit, dictionary

MANY = 100_000


def test_dictionary_of_many_values(spark):
    texts = spark.range(2 * MANY).select(F.md5((F.col("id") % MANY).cast("string")).alias("g"))
    rows = dictionary.category_dictionary(texts, "g").orderBy("code").collect()
    assert [r.code for r in rows] == list(range(MANY))
    assert [r.value for r in rows] == sorted(r.value for r in rows)


@pytest.mark.parametrize("broadcast_values", [100, 0])
def test_codes_of_unseen_null_and_hot_values(spark, broadcast_values):
    train = spark.createDataFrame([("é",), ("b",), ("",), (None,), ("b",), ("Z",)], "`g.x` string")
    fitted = dictionary.category_dictionary(train, "g.x")
    values = ["b"] * 300 + ["", "Z", "é", "new", None, None]
    table = spark.createDataFrame(list(enumerate(values)), "n int, `g.x` string").withColumn("_other", F.lit(1))
    got = dictionary.apply_dictionary(table, "g.x", fitted, broadcast_values)
    expected = {"": 0, "Z": 1, "b": 2, "é": 3}
    assert got.columns == table.columns
    assert {r["n"]: r["g.x"] for r in got.collect()} == {n: expected.get(v, -1) for n, v in enumerate(values)}


def test_dictionary_without_values(spark):
    empty = spark.createDataFrame([(None,)], "g string")
    fitted = dictionary.category_dictionary(empty, "g")
    assert fitted.count() == 0
    assert [r.g for r in dictionary.apply_dictionary(empty, "g", fitted).collect()] == [-1]


def test_lists_and_tables_give_equal_codes(spark):
    table = spark.range(500).select((F.col("id") * 37 % 90).cast("string").alias("a"), (F.col("id") % 7).alias("b"))
    by_list = dictionary.fit_codes(table, ["a", "b"])
    by_table = dictionary.fit_codes(table, ["a", "b"], bound=20)
    assert isinstance(by_list["a"], list) and not isinstance(by_table["a"], list) and isinstance(by_table["b"], list)
    count = lambda fitted: sorted(map(tuple, dictionary.apply_codes(table, fitted).collect()))
    assert count(by_list) == count(by_table)


def _keys(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").withColumn("k", C.hex_suffix_key(F.col("x")))


def test_hex_keys_keep_the_order_of_numbers(spark):
    rng = random.Random(5)
    texts = [uuid.UUID(int=rng.getrandbits(128)).hex for _ in range(50)] + [f"{rng.getrandbits(256):x}" for _ in range(50)]
    texts += ["0", "F" * 64, "T-ff", "00ff", "a-" + "0" * 32]
    rows = _keys(spark, texts).collect()
    number = lambda r: int(r.x.split("-")[-1], 16)
    assert [number(r) for r in sorted(rows, key=lambda r: r.k)] == sorted(number(r) for r in rows)
    assert [r.k for r in _keys(spark, ["T-xyz", "0" * 65, "", "T-", None]).collect()] == [None] * 5


def test_hex_difference_is_exact(spark):
    rng = random.Random(6)
    cases = [(0, 0), (1 << 255, (1 << 255) - 1), (1 << 200, 1 << 199), (16**8, 16**8 - 1), (0, 1 << 250), (10**37, 0), (10**37 + 1, 0)]
    cases += [(b + rng.randrange(10**36), b) for b in (rng.getrandbits(250) for _ in range(30))]
    cases += [(b, a) for a, b in cases]
    df = spark.createDataFrame([(i, f"{a:064x}", f"{b:064x}") for i, (a, b) in enumerate(cases)], "i int, a string, b string")
    got = {r.i: int(r.d) for r in df.select("i", C.hex_difference(F.col("a"), F.col("b")).alias("d")).collect()}
    top = C.LARGEST_DIFFERENCE
    assert got == {i: max(-top, min(top, a - b)) for i, (a, b) in enumerate(cases)}


PREFIX = "7d" * 24


def test_audits_of_long_ids_equal_those_of_their_numbers(spark):
    rng = random.Random(7)
    rows, number = [], 1000
    for clock in range(400):
        number += rng.choice([1, 1, 1, 2, 40])
        rows.append((clock, clock // 20 if clock % 3 else clock % 5, number))
    short = spark.createDataFrame(rows, "clock long, who int, number long")
    long = short.withColumn("number", C.hex_suffix_key(F.concat(F.lit(PREFIX), F.lpad(F.hex("number"), 16, "0"))))
    a, b = (audit.leak_verdict(t, "who", "clock", "number", ["clock"]).first() for t in (short, long))
    assert a.corr == pytest.approx(b.corr, abs=1e-9) and a.mono == b.mono and a.leak == b.leak
    columns = ["id", "n", "hidden", "internal_holes"]
    blocks = [audit.id_blocks(t, "who", "number") for t in (short, long)]
    first, second = (sorted(tuple(int(v) for v in r) for r in t.select(*columns).collect()) for t in blocks)
    assert first == second
    assert audit.contiguity_test(blocks[0]).first() == audit.contiguity_test(blocks[1]).first()


def test_blocks_of_random_uuids(spark):
    rng = random.Random(8)
    ids = [rng.getrandbits(128) for _ in range(60)]
    df = spark.createDataFrame([(i // 3, f"{x:032x}") for i, x in enumerate(ids)], "who int, x string")
    got = {r.id: r for r in audit.id_blocks(df.withColumn("k", C.hex_suffix_key(F.col("x"))), "who", "k").collect()}
    spans = sorted((min(ids[3 * w : 3 * w + 3]), max(ids[3 * w : 3 * w + 3]), w) for w in range(20))
    cut = lambda v: max(-C.LARGEST_DIFFERENCE, min(C.LARGEST_DIFFERENCE, v))
    for place, (low, high, who) in enumerate(spans):
        assert int(got[who].internal_holes) == cut(high - low) + 1 - 3
        after = cut(spans[place + 1][0] - high) - 1 if place + 1 < len(spans) else cut(max(s[1] for s in spans) - high)
        assert int(got[who].hidden) == after
