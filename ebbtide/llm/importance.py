"""Importance resampling towards a target: hashed feature gains, perturbed scores, and a distributed quickselect.

Features are the runs of one to ``RUN`` consecutive words, counted in ``buckets`` of their crc32, over the whole
corpus and over the whole target. The gain of a bucket is the log of the smoothed target over the smoothed
corpus frequency in thousandths, an array of ``buckets`` numbers; a text's weight is the sum over its features,
looked up in that array. Adding keyed Gumbel noise and keeping the highest scores draws without replacement in
proportion to the weights.

The k-th key is found without a sort: every round takes random pivot keys out of the interval that is left and
counts exactly how many keys lie before, at and behind each of them, until a pivot is the k-th key itself. Only
the winners are sorted, by key range, and ranked by their place inside the range plus the sizes of the ranges
before. The crc32 of a run is combined from those of its words, so runs are never written out.

Defined results: words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z; a null or empty
text has no feature, weight 0; a null id hashes as empty text and is drawn last among ties; rows that repeat are
rows of their own, told apart by their place in the written table; empty tables give empty results, and an empty
target counts as T = 0. Very long texts are read in chunks of words. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import broadcast_if_small
from ebbtide.session import materialize

RUN = 3
BUCKETS = 10_000
SCALE = 1000
LEAST_WORDS = 20
PIVOTS = 16
CHUNK_WORDS = 1 << 16
LONGEST = 64
SEED = 42

#: A-Z to a-z, everything else that is neither ``[0-9a-z]`` nor part of a non-ASCII character to a blank.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

# ---- features --------------------------------------------------------------------------------------------------


def _zero_bytes(most: int) -> np.ndarray:
    """``[length, byte place, byte]``: what a checksum becomes when ``length`` zero bytes follow."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    tables = [np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]]
    for _ in range(most):
        tables.append(step[tables[-1] & 0xFF] ^ (tables[-1] >> 8))
    return np.array(tables, np.uint32)


_AFTER = _zero_bytes(LONGEST)


def run_checksums(words: list[bytes]) -> list[np.ndarray]:
    """For 1 to ``RUN`` words: the crc32 of the run that starts at each place, of blank-joined words.

    The checksum of a text and an appended word is that of the text, moved by the word's length, exclusive-or
    that of the word; words longer than ``LONGEST`` bytes are appended one by one.
    """
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    plain = np.fromiter(map(zlib.crc32, seen), np.uint32, len(seen))[ids]
    spaced = np.fromiter((zlib.crc32(b" " + w) for w in seen), np.uint32, len(seen))[ids]
    sizes = np.fromiter((len(w) + 1 for w in seen), np.int64, len(seen))[ids]
    found = [plain]
    for k in range(1, RUN):
        head, tail, size = found[-1][: len(words) - k], spaced[k:], sizes[k:]
        table = np.minimum(size, LONGEST)
        moved = _AFTER[table, 0, head & 0xFF]
        for place in range(1, 4):
            moved ^= _AFTER[table, place, (head >> (8 * place)) & 0xFF]
        joined = moved ^ tail
        for i in np.flatnonzero(size > LONGEST):
            joined[i] = zlib.crc32(b" " + words[i + k], int(head[i]))
        found.append(joined)
    return found


def _chunks(texts: Iterable[bytes | None]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Words of several texts, or of a piece of a long one: ``words, text number of each, counts a run start``.

    A piece repeats the last ``RUN - 1`` words of the one before as ``False``: runs that begin there and end
    inside the earlier piece were counted with it.
    """
    words: list[bytes] = []
    owners: list[np.ndarray] = []
    fresh: list[np.ndarray] = []
    for i, text in enumerate(texts):
        own = (text or b"").translate(_FOLD).split()
        start = 0
        while start < len(own):
            overlap = min(start, RUN - 1)
            piece = own[start - overlap : start + CHUNK_WORDS]
            words += piece
            owners.append(np.full(len(piece), i))
            fresh.append(np.arange(len(piece)) >= overlap)
            start += CHUNK_WORDS
            if len(words) >= CHUNK_WORDS:
                yield words, np.concatenate(owners), np.concatenate(fresh)
                words, owners, fresh = [], [], []
    if words:
        yield words, np.concatenate(owners), np.concatenate(fresh)


def feature_buckets(texts: Iterable[bytes | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """``text number, bucket`` of every feature, each once, and the run length, in bounded chunks."""
    for words, owner, fresh in _chunks(texts):
        for k, sums in enumerate(run_checksums(words)):
            last = len(words) - k
            if last <= 0:
                continue
            whole = (owner[:last] == owner[k:]) & fresh[k:]  # the last word of the run is new in this piece
            yield owner[:last][whole], (sums[:last][whole] % buckets).astype(np.int64), k


def _as_bytes(texts: pa.Array) -> Iterator[bytes | None]:
    for t in texts:
        yield t.as_buffer().to_pybytes() if t.is_valid else None


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all texts of ``rows``; at most ``buckets`` rows leave a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found, _ in feature_buckets(_as_bytes(batch.column(0)), buckets):
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    summed = rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in summed.collect():  # at most ``buckets`` rows
        out[row.bucket] = row.n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floor of a thousand times the log of the target's over the corpus's smoothed frequency."""
    size, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array(
        [math.floor(SCALE * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)],
        np.int64,
    )


def weighed(text: Column, gains: np.ndarray) -> Column:
    """``n_words, n_features, weight`` of a text column: sums over the array of gains."""

    @F.arrow_udf("n_words long, n_features long, weight long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            n_words, n_features, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
            for owner, found, k in feature_buckets(_as_bytes(texts), len(gains)):
                here = np.bincount(owner, minlength=len(texts))
                n_features += here
                n_words += here if k == 0 else 0
                np.add.at(weight, owner, gains[found])
            yield pa.StructArray.from_arrays(list(map(pa.array, (n_words, n_features, weight))), names=["n_words", "n_features", "weight"])

    return of(text)


def gumbel_noise(row_id: str, seed: int = SEED) -> Column:
    """Keyed standard Gumbel noise in thousandths, rounded down: the same for an id at every size and order."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(row_id).cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 32))
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log(uniform))).cast("long")


# ---- selection -------------------------------------------------------------------------------------------------


def kth_key(rows: DataFrame, key: str, k: int, seed: int = SEED, pivots: int = PIVOTS):
    """The ``k``-th smallest (from 1) of the unique struct keys of ``rows``; None when there are fewer.

    A round reads the interval that is left twice: once for random pivots, the keys of the smallest of several
    keyed hashes, and once for the exact numbers of keys up to each of them.
    """
    low = high = None
    before, left = 0, rows.count()
    if not 1 <= k <= left:
        return None
    kind = rows.schema[key].dataType
    as_literal = lambda row: F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])
    turn = 0
    while True:
        inside = rows
        if low is not None:
            inside = inside.where(F.col(key) > as_literal(low))
        if high is not None:
            inside = inside.where(F.col(key) < as_literal(high))
        turn += 1
        drawn = inside.agg(*[F.min_by(key, F.xxhash64(F.lit(seed), F.lit(turn), F.lit(i), key)).alias(f"p{i}") for i in range(pivots)]).first()
        points = sorted({tuple(p) for p in drawn}, key=lambda p: [(v is not None, v) for v in p])  # null first, as in Spark
        points = [dict(zip(kind.names, p, strict=True)) for p in points]
        counts = inside.agg(
            *[F.count_if(F.col(key) < as_literal(p)).alias(f"l{i}") for i, p in enumerate(points)],
            *[F.count_if(F.col(key) == as_literal(p)).alias(f"e{i}") for i, p in enumerate(points)],
        ).first()
        base = before
        for i, p in enumerate(points):
            smaller, equal = base + counts[f"l{i}"], counts[f"e{i}"]
            if smaller < k <= smaller + equal:
                return p
            if k <= smaller:
                high = p
                break
            low, before = p, smaller + equal


def ranked(rows: DataFrame, key: str, out: str) -> DataFrame:
    """``rows`` with their 1-based position by ``key``: sorted by range, offset by the sizes of earlier ranges."""
    placed = materialize(rows.orderBy(key).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    total, offsets = 0, []
    for row in sorted(sizes.collect()):  # one row per sorted range
        offsets.append((row["__part"], total))
        total += row["__n"]
    table = rows.sparkSession.createDataFrame(offsets, "__part long, __before long")
    joined = placed.withColumn("__part", part).join(broadcast_if_small(table), "__part")
    inside = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(out, F.col("__before") + inside + 1).drop("__part", "__place", "__before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: tuple[int, int] = (5, 100),
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    row_id: str = "doc_id",
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs``; ``rank`` is null if not drawn.

    Of the N documents of ``least_words`` words or more, floor(N times ``share``) are drawn, highest score first,
    ties to the smaller id.
    """
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    found = docs.select(F.col(row_id).alias("doc_id"), weighed(F.col("text"), gains).alias("found"))
    scores = found.select("doc_id", "found.*", (F.col("found.weight") + gumbel_noise("doc_id", seed)).alias("score"))
    scores = materialize(scores.withColumn("row", F.monotonically_increasing_id()))
    key = F.struct((-F.col("score")).alias("under"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    keyed = scores.withColumn("key", key)
    able = F.col("n_words") >= least_words
    entrants = keyed.where(able)
    last = kth_key(entrants, "key", entrants.count() * share[0] // share[1], seed)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if last is None:
        return scores.select(*columns, F.lit(None).cast("long").alias("rank"))
    bound = F.struct(*[F.lit(last[f.name]).cast(f.dataType).alias(f.name) for f in keyed.schema["key"].dataType.fields])
    winner = able & (F.col("key") <= bound)
    winners = ranked(keyed.where(winner), "key", "rank").select(*columns, "rank")
    return winners.unionByName(keyed.where(~winner).select(*columns, F.lit(None).cast("long").alias("rank")))
