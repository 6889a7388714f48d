"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows below which a table is hinted for broadcast; every hint in this package counts its rows first.
BROADCAST_ROWS = 500_000

#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = 500


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(column: str, modulus: int) -> Column:
    """``crc32`` of the id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the counted rows stay under ``limit``; otherwise leave the join to the planner."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def windows_of(data: bytes, size: int, overlap: int) -> Iterator[bytes]:
    """Consecutive pieces of ``data`` whose ends overlap, so that no n-gram is lost or counted twice."""
    start = 0
    while True:
        yield data[start : start + size]
        start += size - overlap
        if start + overlap >= len(data):
            return


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let the session's Arrow batches hold ``rows`` rows at most; a smaller setting stays.

    The default of 10,000 whole texts is held several times over, by the executor and by its Python worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
