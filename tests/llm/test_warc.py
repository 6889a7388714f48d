from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import zlib

import pytest
from pyspark.sql import functions as F

from ebbtide.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, own_id string"


def pages(spark):
    rows = [
        (1, "http://a", "<p>same</p>", "x", "y"),
        (2, "http://b\r\nX: 1", "<p>same</p>", "x", "y"),
        (3, None, None, "x", "y"),
        (4, "http://d", "", "x", "y"),
        (5, "http://e", "é\U0001f600\r\n\r\nWARC/1.1\r\n", "x", "y"),
        (6, "http://f", "z" * 700_000, "x", "y"),
        (7, "http://g", "<p>own</p>", "x", "y"),
        (7, "http://g", "<p>own</p>", "x", "y"),
        (7, "http://g", "<p>other</p>", "x", "y"),
        (None, "http://n", "<p>nameless</p>", "x", "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def archive(spark, frame, **limits):
    written = warc.write_archives(frame, warc.new_folder(spark, "raw"), **limits)
    return written, warc.normalise(written, warc.new_folder(spark, "members"))


@pytest.mark.parametrize("least, size", [(0, warc.ARCHIVE_BYTES), (0, 500), (11, 1 << 20)])
def test_round_trip(spark, least, size):
    frame = pages(spark)
    _, normalised = archive(spark, frame, least_bytes=least, archive_bytes=size)
    found = warc.read_archives(normalised).collect()
    expected = []
    rows = [(r.page_id, (r.html or "").encode()) for r in frame.collect()]
    for payload in {p for _, p in rows}:
        ids = [i for i, p in rows if p == payload]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        winner = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            response = len(payload) < least or len(ids) == 1 or (i == winner and first)
            first = first and not (response and i == winner)
            expected.append((i, len(payload), digest, "response" if response else "revisit", None if response else winner, payload if response else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in found]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_members_and_sidecar(spark):
    written, normalised = archive(spark, pages(spark))
    (raw, *_), (one, *_) = written.collect(), normalised.collect()
    data = open(raw.path, "rb").read()
    single = zlib.decompressobj(warc.GZIP)
    assert len(single.decompress(data)) == raw.bytes and single.eof and not single.unused_data
    for one in normalised.collect():
        members, entries = open(one.path, "rb").read(), [json.loads(x) for x in open(one.sidecar)]
        assert len(entries) == one.records and sum(e["length"] for e in entries) == len(members)
        for e in entries:
            text = zlib.decompress(members[e["offset"] : e["offset"] + e["length"]], warc.GZIP)
            assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
    assert sum(w.records for w in written.collect()) == sum(n.records for n in normalised.collect()) == 10


def record(i, body=b"x"):
    return warc.record_bytes(i, "http://u", body.decode(), hashlib.sha1(body).hexdigest(), None)


@pytest.mark.parametrize("pack", ["one", "members", "padded"])
def test_inflater_takes_any_gzip(pack, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 37)
    records = [record(i, b"payload " * i) for i in range(9)]
    parts = {"one": [b"".join(records)], "members": records, "padded": records}[pack]
    data = b"".join(map(gzip.compress, parts)) + (b"\0" * 90 if pack == "padded" else b"")
    sink = io.BytesIO()
    entries = list(warc.normalise_file(io.BytesIO(data), sink))
    out = sink.getvalue()
    assert [zlib.decompress(out[e["offset"] : e["offset"] + e["length"]], warc.GZIP) for e in entries] == records


def test_broken_archives_are_refused():
    data = gzip.compress(record(1) + record(2)[:-30])
    with pytest.raises(ValueError):
        list(warc.normalise_file(io.BytesIO(data), io.BytesIO()))
    with pytest.raises(ValueError):
        list(warc.normalise_file(io.BytesIO(gzip.compress(record(1))[:-12]), io.BytesIO()))
    assert list(warc.normalise_file(io.BytesIO(b""), io.BytesIO())) == []


def test_empty_table(spark):
    assert warc.read_archives(archive(spark, pages(spark).limit(0))[1]).count() == 0


def test_large_ids_and_nulls_in_one_batch(spark):
    """Ids beyond 2^53 stay whole beside null ids, and no payload is lost."""
    base = 1 << 53
    rows = [(base + 1, "u", "<p>same</p>"), (base + 3, "u", "<p>same</p>"), (None, "u", "<p>same</p>"), (None, "u", None), (base + 5, None, "own")]
    rows += [(9_223_372_036_854_775_807, "u", "<p>last</p>"), (9_223_372_036_854_775_806, "u", "<p>last</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    found = warc.read_archives(archive(spark, frame)[1]).collect()
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload and bytes(r.payload)) for r in found), key=repr)
    big = 9_223_372_036_854_775_807
    expected = [
        (base + 1, "revisit", base + 3, None),
        (base + 3, "response", None, b"<p>same</p>"),
        (None, "revisit", base + 3, None),
        (None, "response", None, b""),
        (base + 5, "response", None, b"own"),
        (big, "response", None, b"<p>last</p>"),
        (big - 1, "revisit", big, None),
    ]
    assert got == sorted(expected, key=repr)


def test_very_long_payload_and_clashing_columns(spark):
    frame = pages(spark).withColumns({c: F.lit("clash") for c in ("winner", "copies", "key", "size", "path", "own_key", "shared")})
    long = spark.createDataFrame([(70, "http://l", "line \u00e9\n" * 900_000)], "page_id long, url string, html string")
    found = warc.read_archives(archive(spark, frame.unionByName(long, allowMissingColumns=True))[1]).collect()
    assert len(found) == 11
    (one,) = [r for r in found if r.page_id == 70]
    assert one.payload_bytes == 900_000 * 8 == len(one.payload)
