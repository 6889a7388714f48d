"""Readers and writers: Parquet and CSV tables, views, inventories."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS_SCHEMA = T.StructType(
    [
        T.StructField("ACCOUNT_ID", T.StringType()),
        T.StructField("DURATION_DAYS", T.IntegerType()),
        T.StructField("EVENT_FLAG", T.IntegerType()),
    ]
)
BINARY_LABELS_SCHEMA = T.StructType(
    [T.StructField("ACCOUNT_ID", T.StringType()), T.StructField("CHURN", T.IntegerType())]
)
SCORING_SCHEMA = T.StructType([T.StructField("ACCOUNT_ID", T.StringType())])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_parquet(spark: SparkSession, *paths: str, view: str | None = None) -> DataFrame:
    """Files, folders or globs as one table, optionally named for SQL."""
    df = spark.read.parquet(*paths)
    if view:
        df.createOrReplaceTempView(view)
    return df


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Iterable[str] = ()) -> None:
    """Write a result folder; CSV files carry a header."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if names := list(partition_by):
        writer = writer.partitionBy(*names)
    writer.save(path)


def parse_transactions(raw: DataFrame) -> DataFrame:
    """Transaction files as read (``TRX_DATETIME`` text) → ``src, dst, kind, typ, amt, d, hr, trx_id``."""
    stamp = F.col("TRX_DATETIME").cast("string")
    return raw.select(
        F.col("SRC_ACCOUNT").alias("src"),
        F.col("DST_ACCOUNT").alias("dst"),
        F.substring("DST_ACCOUNT", 1, 4).alias("kind"),
        F.col("TRX_TYPE").alias("typ"),
        F.col("TRX_AMT").cast("double").alias("amt"),
        F.substring(stamp, 1, 10).cast("date").alias("d"),
        F.substring(stamp, 12, 2).cast("int").alias("hr"),
        F.col("TrxID").alias("trx_id"),
    )


def parse_balances(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("ACCOUNT_ID").alias("id"),
        F.col("DATE").cast("date").alias("d"),
        F.col("AVAILABLE_BALANCE").cast("double").alias("b"),
    )


def parse_profile(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("ACCOUNT_ID").alias("id"),
        F.col("ACCOUNT_TYPE").alias("account_type"),
        F.col("ACCOUNT_OPEN_DATE").cast("date").alias("open_date"),
        "GENDER",
        "REGION",
    )


def inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows ``(source, n)``; a Parquet count reads footers only."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), "n")
        out = row if out is None else out.unionByName(row)
    return out
