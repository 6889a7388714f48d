"""Nearest neighbours by cosine from vantage-point trees, one per shard of the corpus.

Rows are dealt to shards by a hash of their id, so many that a shard's vectors stay below ``SHARD_BYTES``. Every
shard builds its tree inside one task and the trees are written as the index table. A node has a vantage point
and two halves of its rows, by distance from that point, with the least and greatest distance of each half. Unit
vectors are compared by their straight distance, which has the order of the cosine and obeys the triangle
inequality.

Searching sends blocks of queries to every shard, beside the shard's tree. A query first goes down to the leaf on
its own side, which gives it near neighbours to start from; then the tree is walked once for the whole block, and a
half leaves a query out if the triangle inequality puts every row of it further away than the query's k-th
neighbour, that distance divided by ``factor``. With factor one nothing that could be nearer is left out: the search
is exact. Larger factors skip more. Scores are taken again from the original vectors, pair by pair, and the k
best of all shards stay.

Defined results: rows with a null id, or a vector that is null, empty, all zeros or holds null, NaN or infinite
entries take no part, nor do vectors of another length than the most frequent one; copies of a vector are one point
with several ids, so a large group of them costs one comparison; a row never finds its own id; rows that repeat in
id and vector count once; equal scores go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.llm.common import partitions
from ebbtide.llm.vectors import usable
from ebbtide.session import materialize

SHARD_BYTES = 8 << 20
BLOCK_QUERIES = 1024
LEAF = 64
TRIED, PROBES = 6, 64
#: Distances of unit vectors are exact to about 2e-8 (the root of the rounding error of a cosine near one).
SLACK = 1e-7
SEED = 42

_INDEX = "shard int, ids array<long>, starts array<int>, vectors binary, vantage array<int>, left array<int>, right array<int>, first array<int>, last array<int>, bounds array<double>"
_ROLE = f"{_INDEX}, role int"

# ---- one tree --------------------------------------------------------------------------------------------------


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest entry near one; cosines do not change by it."""
    _, exponent = np.frexp(np.abs(vectors).max(1, initial=0.0))
    return np.ldexp(vectors, -exponent[:, None])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of every row of ``a`` with the row of ``b``; sums run from the first entry to the last."""

    def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.add.accumulate(x * y, axis=1)[:, -1]

    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def distinct_points(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different vectors, their ids in ascending order without repeats, and where each one's ids start."""
    points, of = np.unique(vectors, axis=0, return_inverse=True)
    pairs = np.unique(np.column_stack([of.reshape(-1), ids]), axis=0)
    return points, pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(points) + 1))


def grow(points: np.ndarray, leaf: int = LEAF, seed: int = SEED) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Order of the points, and nodes in preorder: vantage place, children (-1: leaf), rows, distance bounds.

    Of a few random rows the one whose distances to a sample vary most becomes the vantage point.
    """
    rng = np.random.default_rng(seed)
    unit, order = _unit(points), np.arange(len(points))
    nodes: dict[str, list] = {k: [] for k in ("vantage", "left", "right", "first", "last", "bounds")}
    waiting = [(0, len(points), -1, "left")]
    while waiting:
        first, last, parent, side = waiting.pop()
        here = len(nodes["first"])
        if parent >= 0:
            nodes[side][parent] = here
        for name, value in (("vantage", -1), ("left", -1), ("right", -1), ("first", first), ("last", last), ("bounds", [0.0] * 4)):
            nodes[name].append(value)
        if last - first <= max(leaf, 2):  # a vantage point and two halves
            continue
        tried = rng.integers(first, last, TRIED)
        probes = order[rng.integers(first, last, PROBES)]
        best = tried[_distance(unit[order[tried]], unit[probes]).std(1).argmax()]
        order[[first, best]] = order[[best, first]]
        far = _distance(unit[order[first + 1 : last]], unit[order[first : first + 1]])[:, 0]
        half = len(far) // 2
        turn = np.argpartition(far, half)
        order[first + 1 : last], far = order[first + 1 : last][turn], far[turn]
        middle = first + 1 + half
        nodes["vantage"][here] = first
        nodes["bounds"][here] = [far[:half].min(), far[:half].max(), far[half:].min(), far[half:].max()]
        waiting += [(middle, last, here, "right"), (first + 1, middle, here, "left")]
    kinds = {k: np.array(v, np.float64 if k == "bounds" else np.int32) for k, v in nodes.items()}
    return order, kinds


class Tree:
    """A shard's tree, ready for searching; ``compared`` counts the distances taken."""

    def __init__(self, ids, starts, vectors, vantage, left, right, first, last, bounds):
        self.ids, self.starts, self.vectors = ids, starts, vectors
        self.vantage, self.left, self.right, self.first, self.last = vantage, left, right, first, last
        self.bounds = bounds.reshape(-1, 4)
        self.unit = _unit(vectors)
        self.compared = 0

    def nearest(self, own: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``query number, id, score`` of each query's ``k`` best ids of this shard but its own."""
        places, pairs = self._candidates(_unit(queries), k + 1, factor)
        return self._best(own, queries, k, places, pairs)

    def _candidates(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs ``query, point``: all met that are not further than the ``k``-th met, and possibly some more."""
        best = np.full((len(queries), k), np.inf)
        met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def meet(rows: np.ndarray, first: int, last: int, far: np.ndarray) -> None:
            """Distances ``far`` from queries ``rows`` to the points ``first`` to ``last``."""
            self.compared += far.size
            near = far <= best[rows, -1:] + SLACK
            some = near.any(1)
            if some.any():
                i, j = np.nonzero(near)
                met.append((rows[i], j + first, far[i, j]))
                rows = rows[some]
                best[rows] = np.sort(np.concatenate([best[rows], far[some]], axis=1), axis=1)[:, :k]

        start = np.zeros(len(queries), np.int32)
        going = np.arange(len(queries)) if len(self.unit) else np.empty(0, np.int64)
        waiting = [(0, going)]
        while waiting:
            node, rows = waiting.pop()
            if not len(rows):
                continue
            if self.vantage[node] < 0:
                start[rows] = node
                meet(rows, self.first[node], self.last[node], self._to(queries, rows, self.first[node], self.last[node]))
                continue
            far = self._to(queries, rows, self.vantage[node], self.vantage[node] + 1)[:, 0]
            inner = far < (self.bounds[node, 1] + self.bounds[node, 2]) / 2
            waiting += [(self.left[node], rows[inner]), (self.right[node], rows[~inner])]
        waiting = [(0, going)]
        while waiting:
            node, rows = waiting.pop()
            if self.vantage[node] < 0:
                rows = rows[start[rows] != node]
                if len(rows):
                    meet(rows, self.first[node], self.last[node], self._to(queries, rows, self.first[node], self.last[node]))
                continue
            far = self._to(queries, rows, self.vantage[node], self.vantage[node] + 1)
            meet(rows, self.vantage[node], self.vantage[node] + 1, far)
            reach = best[rows, -1] / factor + SLACK
            low, high, low_out, high_out = self.bounds[node]
            far = far[:, 0]
            for child, a, b in ((self.right[node], low_out, high_out), (self.left[node], low, high)):
                stay = rows[np.maximum(a - far, far - b) <= reach]
                if len(stay):
                    waiting.append((child, stay))
        if not met:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        rows, points, far = (np.concatenate(x) for x in zip(*met, strict=True))
        kept = far <= best[rows, -1] + SLACK
        return rows[kept], points[kept]

    def _to(self, queries: np.ndarray, rows: np.ndarray, first: int, last: int) -> np.ndarray:
        return _distance(queries[rows], self.unit[first:last])

    def _best(self, own, queries, k, rows, points):
        """Exact scores; then per query by falling score and rising id."""
        score = cosine(queries[rows], self.vectors[points])
        sizes = np.minimum(self.starts[points + 1] - self.starts[points], k + 1)  # an id list is ascending: k + 1 ids are enough
        which = np.repeat(np.arange(len(rows)), sizes)
        ids = self.ids[np.repeat(self.starts[points], sizes) + np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        rows, score = rows[which], score[which]
        other = ids != own[rows]
        rows, ids, score = rows[other], ids[other], score[other]
        order = np.lexsort((ids, -score, rows))
        rows, ids, score = rows[order], ids[order], score[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = place < k
        return rows[top], ids[top], score[top]


# ---- shards ----------------------------------------------------------------------------------------------------


def _vectors(rows: DataFrame, vector: str, row_id: str) -> tuple[DataFrame, int]:
    """``id, vector`` of the rows that take part, written once, and the dimension."""
    kept, width = usable(rows.where(F.col(row_id).isNotNull()), vector)
    kept = kept.where(F.exists(F.col(vector), lambda x: x != 0))
    return materialize(kept.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))), width


def _table(ids: pa.ChunkedArray, vectors: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids.to_numpy(), scaled(flat.reshape(-1, width))


def shard_count(n: int, width: int, least: int) -> int:
    """Enough shards for every task to have one, and for their size to stay bounded."""
    return max(1, min(least, math.ceil(n / LEAF)), math.ceil(n * width * 8 / SHARD_BYTES))


def build_index(vectors: DataFrame, width: int, shards: int, leaf: int = LEAF) -> DataFrame:
    """One row per shard: the tree of all its vectors, written once."""

    def plant(group: pa.Table) -> pa.Table:
        points, ids, starts = distinct_points(*_table(group.column("id"), group.column("vector"), width))
        order, nodes = grow(points, leaf)
        sizes = (starts[1:] - starts[:-1])[order]
        turned = np.repeat(starts[:-1][order], sizes) + np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        fields = {
            "shard": group.column("shard")[0].as_py(),
            "ids": ids[turned],
            "starts": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32),
            "vectors": points[order].tobytes(),
            **{k: v.ravel() for k, v in nodes.items()},
        }
        return pa.table({k: [v] for k, v in fields.items()}, schema=_arrow_schema())

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return materialize(dealt.groupBy("shard").applyInArrow(plant, _INDEX))


def _arrow_schema(role: bool = False) -> pa.Schema:
    lists = {"ids": pa.int64(), "starts": pa.int32(), **{k: pa.int32() for k in ("vantage", "left", "right", "first", "last")}, "bounds": pa.float64()}
    fields = [("shard", pa.int32()), ("ids", pa.list_(lists["ids"])), ("starts", pa.list_(lists["starts"])), ("vectors", pa.binary())]
    fields += [(k, pa.list_(lists[k])) for k in ("vantage", "left", "right", "first", "last", "bounds")]
    return pa.schema(fields + ([("role", pa.int32())] if role else []))


def query_blocks(queries: DataFrame, width: int, n: int, shards: int) -> DataFrame:
    """Queries packed into blocks, each block once for every shard; in the columns of the index."""

    def pack(group: pa.Table) -> pa.Table:
        ids, vectors = _table(group.column("id"), group.column("vector"), width)
        return pa.table({"ids": [ids], "vectors": [vectors.tobytes()]}, schema=pa.schema([("ids", pa.list_(pa.int64())), ("vectors", pa.binary())]))

    block = F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(n / BLOCK_QUERIES)))).cast("int")
    packed = materialize(queries.withColumn("block", block).groupBy("block").applyInArrow(pack, "ids array<long>, vectors binary"))
    return packed.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "ids", "vectors")


def _search(batches: Iterator[pa.RecordBatch], width: int, k: int, factor: float) -> Iterator[pa.RecordBatch]:
    """Streams over the sorted shards: a tree is held, the blocks of queries behind it pass by."""
    tree, shard = None, None
    for batch in batches:
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            values = {k: v[i] for k, v in columns.items()}
            points = np.frombuffer(values["vectors"].as_buffer(), np.float64).reshape(-1, width)
            ids = values["ids"].values.to_numpy()
            if values["role"].as_py() == 0:
                rest = [values[k].values.to_numpy() for k in ("vantage", "left", "right", "first", "last", "bounds")]
                tree, shard = Tree(ids, values["starts"].values.to_numpy(), points, *rest), values["shard"].as_py()
            elif shard == values["shard"].as_py():
                rows, found, score = tree.nearest(ids, points, k, factor)
                marks = np.array([xxhash.xxh64_intdigest(p.tobytes()) for p in points], np.uint64).view(np.int64) if len(np.unique(ids)) < len(ids) else np.zeros(len(ids), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows]), pa.array(marks[rows]), pa.array(found), pa.array(score)], names=["query_id", "mark", "vec_id", "score"]
                )


def search(index: DataFrame, queries: DataFrame, width: int, k: int = 5, factor: float = 1.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every query (``id, vector``)."""
    shards = index.agg(F.max("shard").alias("most")).first().most
    schema = "query_id long, mark long, vec_id long, score double"
    if shards is None:
        found = index.sparkSession.createDataFrame([], schema)
    else:
        blocks = query_blocks(queries, width, queries.count(), shards + 1)
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in index.schema if f.name not in ("shard", "ids", "vectors")]
        asked = blocks.select("*", *nothing).select(*index.columns, F.lit(1).alias("role"))
        met = index.select("*", F.lit(0).alias("role")).unionByName(asked)
        dealt = met.repartition(max(partitions(index.sparkSession), shards + 1), "shard").sortWithinPartitions("shard", "role")
        found = dealt.mapInArrow(lambda batches: _search(batches, width, k, factor), schema)
    rank = F.row_number().over(W.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(
    rows: DataFrame, asked, k: int = 5, factor: float = 1.0, vector: str = "embedding", row_id: str = "vec_id", leaf: int = LEAF
) -> DataFrame:
    """The ``k`` nearest other rows of every row for which ``asked`` (a predicate of the id column) holds."""
    vectors, width = _vectors(rows, vector, row_id)
    n = vectors.count()
    index = build_index(vectors, width, shard_count(n, width, partitions(rows.sparkSession)), leaf)
    return search(index, vectors.where(asked(F.col("id"))).distinct(), width, k, factor)
