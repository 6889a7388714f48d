"""SimHash near-duplicates: exact links within a radius by tiled comparison.

A fingerprint has a bit set where more than half of the XXH64 hashes of the text's word shingles have it.
Different fingerprints become tiles by the population counts of their parts (the 64 bits cut into ``parts``
equal pieces). Two fingerprints within the radius differ by at most the radius in the sum of their parts'
count differences, so a tile is compared only with the tiles that near, by exclusive-or and bit counts in
numpy; all other pairs of tiles are skipped. The number of parts follows the number of fingerprints, a large
tile is cut into blocks, and every comparison holds a bounded block on either side. No link is lost.

Links inside a tile leave as a forest (one edge per linked fingerprint and tile), and components are found
by Spark jobs that replace each node's neighbours by the smallest one until nothing changes; nothing is
collected but two counts per round.

Defined results: null or empty texts have fingerprint zero and link like any other; texts of fewer words than
a shingle hash their whole sequence; repeated rows and copies share a fingerprint; a null id never names a
component unless its component has no other id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import partitions
from ebbtide.session import materialize

BITS = 64
SEED = 42
HASHES = 1 << 14
BLOCK = 2048
PARTITION_ROWS = 200_000


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """The hashes of a whole text's shingles, repeats included, in bounded pieces; a shorter text is one shingle."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return
    n, last = max(1, len(tokens) - words + 1), len(tokens) - 1
    ends = np.cumsum([len(t) + 1 for t in tokens]).tolist()
    starts = [0, *ends]
    joined, hashed = b" ".join(tokens), xxhash.xxh64_intdigest
    for first in range(0, n, HASHES):
        stop = min(n, first + HASHES)
        yield np.fromiter(
            (hashed(joined[starts[i] : ends[min(i + words - 1, last)] - 1], SEED) for i in range(first, stop)), np.uint64, stop - first
        )


class Majority:
    """Counts the bits of hashes piece by piece; ``value`` has the bits of more than half of them."""

    def __init__(self) -> None:
        self.counts, self.n = np.zeros(BITS, np.int64), 0

    def add(self, h: np.ndarray) -> None:
        self.counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        self.n += len(h)

    def value(self) -> int:
        return int(np.packbits(2 * self.counts > self.n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of a whole text; hashes are counted in bounded pieces."""
    majority = Majority()
    for piece in shingle_hashes(text, words):
        majority.add(piece)
    return majority.value()


def fingerprints(text: Column, words: int = 3) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t.as_py(), words) for t in texts], np.uint64).view(np.int64))

    return of(text)


# ---- tiles ---------------------------------------------------------------------------------------------------


def parts_for(n: int) -> int:
    """Parts so many that a fingerprint of random bits meets a few thousand others at most, whatever ``n`` is."""
    return next((p for p, most in ((2, 20_000), (4, 2_000_000), (8, 200_000_000)) if n <= most), 16)


def part_counts(parts: int) -> list[Column]:
    width = BITS // parts
    mask = (1 << width) - 1
    return [F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit(mask))).cast("int") for i in range(parts)]


def _later_offsets(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Offsets of absolute sum at most ``radius`` that are greater than zero in dictionary order."""
    found = {(0,) * parts}
    for _ in range(radius):
        found |= {(*o[:i], o[i] + s, *o[i + 1 :]) for o in found for i in range(parts) for s in (-1, 1)}
    return sorted(o for o in found if sum(map(abs, o)) <= radius and o > (0,) * parts)


def near_edges(distinct: DataFrame, n: int, radius: int) -> DataFrame:
    """Edges ``a, b`` that connect all fingerprints (``fp``, different) within ``radius`` bits.

    Each fingerprint is at home in the tile of its counts and a visitor in every later tile near enough, so
    every pair meets once. Tiles of more than ``BLOCK`` are cut into blocks by hash: visitors go to every
    block, and the rows of a block also visit the blocks behind theirs.
    """
    parts = parts_for(n)
    rows = distinct.select("fp", F.array(*part_counts(parts)).alias("tile"))
    sizes = rows.groupBy("tile").agg(F.count("*").alias("size")).select("tile", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    own = rows.join(sizes, "tile").select(
        "fp", "tile", "blocks", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block")
    )
    home = own.select("tile", "block", "fp", F.lit(0).alias("role"))
    behind = own.where("block < blocks - 1").select(
        "tile", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"), "fp", F.lit(1).alias("role")
    )
    offsets = F.array(*[F.array(*map(F.lit, o)) for o in _later_offsets(parts, radius)])
    moved = rows.select("fp", F.explode(F.transform(offsets, lambda o: F.zip_with("tile", o, lambda a, b: a + b))).alias("tile"))
    visit = moved.join(sizes, "tile").select(
        "tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "fp", F.lit(1).alias("role")
    )
    met = home.unionByName(behind).unionByName(visit).withColumn("key", F.xxhash64("tile", "block"))
    expected = n * max(4, len(_later_offsets(parts, radius)) // 2)
    count = max(partitions(distinct.sparkSession), math.ceil(expected / PARTITION_ROWS))
    dealt = met.select("key", "role", "fp").repartition(count, "key").sortWithinPartitions("key", "role")
    return dealt.mapInArrow(lambda batches: _compare(batches, radius), "a long, b long")


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Streams over the sorted tiles: the home rows of a tile are held, visitors pass by in blocks."""
    key, home, waiting = None, [], 0
    for batch in batches:
        keys, roles, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (roles[1:] != roles[:-1])) + 1).tolist(), len(keys)]
        edges = []
        for start, stop in zip(cuts, cuts[1:], strict=False):
            if start == stop:
                continue
            if keys[start] != key:
                edges += _links_within(home, radius)
                key, home, waiting = keys[start], [], 0
            rows = fps[start:stop].view(np.uint64)
            if roles[start] == 0:
                home.append(rows)
                waiting += len(rows)
            elif waiting:
                own = home[0] if len(home) == 1 else np.concatenate(home)
                home = [own]
                for at in range(0, len(rows), BLOCK):
                    edges += _links_between(own, rows[at : at + BLOCK], radius)
        if edges:
            yield _edge_batch(edges)
    if edges := _links_within(home, radius):
        yield _edge_batch(edges)


def _links_within(home: list[np.ndarray], radius: int) -> list[np.ndarray]:
    if not home:
        return []
    rows = np.concatenate(home)
    out = []
    for i, j in [(i, i) for i in range(0, len(rows), BLOCK)] + list(combinations(range(0, len(rows), BLOCK), 2)):
        out += _links_between(rows[i : i + BLOCK], rows[j : j + BLOCK], radius, i == j)
    return out


def _links_between(a: np.ndarray, b: np.ndarray, radius: int, same: bool = False) -> list[np.ndarray]:
    """Edges as columns of two; blocks whose counts lie further apart than the radius are not compared."""
    if len(a) * len(b) <= (1 if same else 0):
        return []
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
    i, j = np.nonzero(np.triu(near, 1) if same else near)
    if not len(i):
        return []
    return [_forest(np.stack([a[i], b[j]]))]


def _forest(links: np.ndarray) -> np.ndarray:
    """Each linked value with the smallest value of its component: as many edges as values, not as pairs."""
    values, flat = np.unique(links, return_inverse=True)
    i, j = flat.reshape(2, -1)
    label = np.arange(len(values))
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(values))
    return np.stack([values[moved], values[label[moved]]])


def _edge_batch(edges: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(edges, axis=1).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


# ---- components ----------------------------------------------------------------------------------------------


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``) but the roots; the root is the component's smallest.

    Rounds of two steps: every larger neighbour of a node is tied to the node's smallest neighbour, then all
    smaller neighbours are. Each round is written to the shared folder; a round without change ends it.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
        return both.join(_minimum(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))

    def small(e: DataFrame) -> DataFrame:
        joined = e.join(_minimum(e), "u")
        return joined.where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(
            joined.select("u", F.col("low").alias("v"))
        )

    state = materialize(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = None
    while True:
        found = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == mark or not found[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(found)
        state = materialize(small(large(state).where("u != v").distinct()).where("u != v").distinct())


def roots_of(distinct: DataFrame, radius: int) -> DataFrame:
    """``fp, root`` of all different fingerprints; ``root`` is the smallest one reachable by links within ``radius`` bits."""
    roots = components(near_edges(distinct, distinct.count(), radius))
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def grouped(docs: DataFrame, radius: int = 2, words: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp, root, component_id`` of every row; ``root`` names the group of fingerprints."""
    prints = materialize(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprints(F.col("text"), words).alias("fp")))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = distinct.join(roots_of(distinct.select("fp"), radius), "fp").select("fp", "least", "root")
    lows = named.groupBy("root").agg(F.min("least").alias("component_id"))
    final = materialize(named.join(lows, "root").select("fp", "root", "component_id"))
    return prints.join(final, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: components of fingerprints within ``radius`` bits."""
    return grouped(docs, radius, words).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 2, words: int = 3) -> DataFrame:
    """One row of ``docs`` per near-duplicate group: the smallest id, then the smallest text hash.

    A null id comes last. Of rows equal in id and text one stays, whichever their other columns.
    """
    return keep_first(docs, materialize(grouped(docs.select("doc_id", "text"), radius, words)))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The row that ``keep_one`` keeps of every ``root`` of ``found`` (``doc_id, text_hash, root`` of every row)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("first")
    winners = materialize(found.groupBy("root").agg(first).select("first.*"))
    kept = _semi(docs, winners)
    same = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    twice = materialize(_semi(same, winners, F.col("text_hash")))
    if twice.isEmpty():
        return kept
    several = _semi(kept, twice).dropDuplicates(["doc_id", "text"])
    return _semi(kept, twice, kind="left_anti").unionByName(several)


def _semi(rows: DataFrame, keys: DataFrame, text_hash: Column | None = None, kind: str = "left_semi") -> DataFrame:
    """Rows with (or without) their id and text hash among ``keys``; null ids are equal."""
    text_hash = F.xxhash64("text") if text_hash is None else text_hash
    keys = keys.select(_id_text().alias("__key_id"), F.col("text_hash").alias("__key_hash"))
    return rows.join(keys, (_id_text() == F.col("__key_id")) & (text_hash == F.col("__key_hash")), kind)


def _id_text() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00"))
