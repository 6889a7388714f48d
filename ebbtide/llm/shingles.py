"""Near-duplicates by word shingles: links of texts whose sets of five-word shingles have Jaccard similarity 0.8 or more.

A text is the set of the XXH64 hashes of its shingles; equal sets are one node. ``BANDS`` keys of ``ROWS`` minimum
hashes each find the candidates: two sets of similarity s share no key with probability (1 - s^ROWS)^BANDS, which
is 1.5e-5 at 0.8 and less above. Keys shared by the same nodes are met once. The sets themselves meet at the keys
by Spark joins, and every link is confirmed by the exact similarity of the two sets, so none is wrong. Keys of more
than ``BLOCK`` nodes or ``BLOCK_BYTES`` are cut into blocks, of which every pair meets; nothing is capped.

Defined results: words are split at ASCII white space and lower-cased in ASCII; texts of fewer words than a
shingle are one shingle; null texts and texts without words are one empty set, which links to nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import broadcast_if_small, partitions
from ebbtide.llm.simhash import SEED, Majority, _edge_batch, _forest, components, roots_of, shingle_hashes
from ebbtide.session import materialize

WORDS, SIMILARITY = 5, 0.8
ROWS, BANDS = 5, 28
BLOCK, BLOCK_BYTES = 512, 4 << 20
BATCH_BYTES = 4 << 20
CHUNK = 512
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted different hashes of a text's shingles."""
    return _merged([np.unique(piece) for piece in shingle_hashes(text, words)])


def _merged(pieces: list[np.ndarray]) -> np.ndarray:
    if not pieces:
        return np.empty(0, np.uint64)
    return pieces[0] if len(pieces) == 1 else np.unique(np.concatenate(pieces))


def print_and_set(text: str | None, words: int = WORDS) -> tuple[int, np.ndarray]:
    """The SimHash of a text and the sorted different hashes of its shingles, hashed once."""
    majority, pieces = Majority(), []
    for piece in shingle_hashes(text, words):
        majority.add(piece)
        pieces.append(np.unique(piece))
    return majority.value(), _merged(pieces)


def band_keys(items: np.ndarray) -> np.ndarray:
    """One key per band: the hash of its number and its minimum hashes; none for the empty set."""
    if not len(items):
        return np.empty(0, np.uint64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max)
    for at in range(0, len(items), CHUNK):
        np.minimum(least, (items[at : at + CHUNK, None] * MULTIPLIERS).min(0), out=least)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def signatures(text: Column, words: int = WORDS) -> Column:
    """``node`` (the hash of the shingle set), ``fp`` (the SimHash), ``size`` and ``bands`` of a text column; one set is held at a time."""

    @F.arrow_udf("node long, fp long, size int, bands array<long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            nodes, fps, sizes, bands = np.empty(len(texts), np.uint64), np.empty(len(texts), np.uint64), np.empty(len(texts), np.int32), []
            for i, t in enumerate(texts):
                fps[i], items = print_and_set(t.as_py(), words)
                nodes[i], sizes[i] = xxhash.xxh64_intdigest(items.tobytes(), SEED), len(items)
                bands.append(band_keys(items).view(np.int64))
            columns = [pa.array(nodes.view(np.int64)), pa.array(fps.view(np.int64)), pa.array(sizes), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.StructArray.from_arrays(columns, names=["node", "fp", "size", "bands"])

    return of(text)


def shingle_sets(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``node, items`` of rows ``node, text``; a batch of results holds about ``BATCH_BYTES``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, items, held = [], [], 0
            for node, text in zip(batch.column(0), batch.column(1), strict=True):
                nodes.append(node.as_py())
                items.append(shingle_set(text.as_py(), words).view(np.int64))
                held += items[-1].nbytes
                if held >= BATCH_BYTES:
                    yield _set_batch(nodes, items)
                    nodes, items, held = [], [], 0
            if nodes:
                yield _set_batch(nodes, items)

    return texts.select("node", "text").mapInArrow(of, "node long, items array<long>")


def _set_batch(nodes: list[int], items: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(items, pa.list_(pa.int64()))], names=["node", "items"])


# ---- links ---------------------------------------------------------------------------------------------------


def links_within(items: list[np.ndarray], others: list[np.ndarray] | None = None, similarity: float = SIMILARITY) -> np.ndarray:
    """Pairs of positions of sets with at least the similarity: inside ``items``, or of ``items`` with ``others``."""
    right = items if others is None else others
    values, flat = np.unique(np.concatenate([*right, *items]), return_inverse=True)
    sizes = np.array([len(x) for x in right])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    words = flat[: starts[-1]]
    found, at, seen = [], int(starts[-1]), np.zeros(len(values), bool)
    for i, own in enumerate(items):
        mine = flat[at : at + len(own)]
        at += len(own)
        first = i + 1 if others is None else 0
        if first >= len(right):
            break
        seen[mine] = True
        common = np.add.reduceat(seen[words[starts[first] :]].astype(np.int64), starts[first:-1] - starts[first])
        seen[mine] = False
        near = np.flatnonzero(common / (sizes[first:] + len(own) - common) >= similarity) + first
        found += [(i, int(j)) for j in near]
    return np.array(found, np.int64).reshape(-1, 2)


def _compare(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Streams over sorted keys: home rows are held, visitors pass by in blocks bounded in rows and in bytes."""
    key, home, visitors, waiting = None, [], [], 0

    def forest(pairs: np.ndarray, left: list, right: list) -> list[np.ndarray]:
        if not len(pairs):
            return []
        return [_forest(np.array([[left[i][0] for i, _ in pairs], [right[j][0] for _, j in pairs]], np.int64).view(np.uint64))]

    def visited() -> list[np.ndarray]:
        nonlocal waiting
        pairs = links_within([h[1] for h in home], [v[1] for v in visitors], similarity) if home and visitors else []
        out = forest(pairs, home, visitors)
        visitors.clear()
        waiting = 0
        return out

    def closed() -> list[np.ndarray]:
        out = visited()
        out += forest(links_within([h[1] for h in home], None, similarity) if len(home) > 1 else [], home, home)
        home.clear()
        return out

    for batch in batches:
        edges = []
        keys, roles, nodes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        sets = batch.column(3)
        for k, role, node, row in zip(keys, roles, nodes, sets, strict=True):
            if k != key:
                edges += closed()
                key = k
            items = row.values.to_numpy().copy()  # a view would keep its whole batch in memory
            (visitors if role else home).append((node, items))
            waiting += items.nbytes if role else 0
            if len(visitors) >= BLOCK or waiting >= BLOCK_BYTES:
                edges += visited()
        if edges:
            yield _edge_batch(edges)
    if edges := closed():
        yield _edge_batch(edges)


def candidates(signed: DataFrame) -> DataFrame:
    """``key, node, blocks`` of every key that several nodes (``node, size, bands``) share; of keys with the same nodes, one.

    So many blocks that one has about ``BLOCK`` sets and ``BLOCK_BYTES`` at most.
    """
    rows = signed.select("node", "size", F.explode("bands").alias("key"))
    full = rows.groupBy("key").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("mark"), (8 * F.sum(F.col("size").cast("long"))).alias("bytes")
    )
    chosen = materialize(full.where("n > 1").groupBy("n", "bytes", "mark").agg(F.min("key").alias("key")))
    blocks = chosen.select("key", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    return rows.join(broadcast_if_small(blocks), "key").select("key", "node", "blocks")


def near_edges(shared: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Edges ``a, b`` that connect all nodes that share a key and have the similarity; ``sets`` has ``node, items``."""
    own = shared.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    home = own.select("key", "block", "node", F.lit(0).alias("role"))
    behind = own.where("block < blocks - 1").select(
        "key", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"), "node", F.lit(1).alias("role")
    )
    met = home.unionByName(behind).select(F.xxhash64("key", "block").alias("key"), "role", "node").join(sets, "node")
    dealt = met.select("key", "role", "node", "items").repartition(partitions(shared.sparkSession), "key")
    return dealt.sortWithinPartitions("key", "role").mapInArrow(lambda batches: _compare(batches, similarity), "a long, b long")


def print_edges(prints: DataFrame, radius: int) -> DataFrame:
    """Edges ``a, b`` that connect all nodes (``node, fp``) whose fingerprints are linked within ``radius`` bits."""
    pairs = materialize(prints.select("node", "fp").distinct())
    roots = roots_of(materialize(pairs.select("fp").distinct()), radius).withColumnRenamed("root", "print")
    named = materialize(pairs.join(roots, "fp").select("node", "print"))
    lows = named.groupBy("print").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("print", "low")
    return named.join(lows, "print").where("node != low").select(F.col("node").alias("a"), F.col("low").alias("b"))


def grouped(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, radius: int | None = None) -> DataFrame:
    """``doc_id, text_hash, root`` of every row; ``root`` names the group of linked texts.

    With ``radius`` texts whose SimHash fingerprints of the same shingles differ in that many bits at most are linked as well.
    """
    row = F.xxhash64("doc_id", "text")
    signed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), row.alias("row"), signatures(F.col("text"), words).alias("s"))
    prints = materialize(signed.select("doc_id", "text_hash", "row", "s.node", "s.fp", "s.size", "s.bands"))
    distinct = materialize(prints.groupBy("node").agg(F.first("bands").alias("bands"), F.first("size").alias("size"), F.min("row").alias("row")))
    shared = materialize(candidates(distinct))
    wanted = broadcast_if_small(distinct.join(shared.select("node").distinct(), "node", "left_semi").select("node", "row"))
    texts = docs.select(row.alias("row"), "text").join(wanted, "row").select("node", "text")
    sets = materialize(shingle_sets(texts.dropDuplicates(["node"]), words))
    edges = near_edges(shared, sets, similarity)
    roots = components(edges if radius is None else edges.unionByName(print_edges(prints, radius)))
    return prints.join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))
