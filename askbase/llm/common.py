"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from askbase.session import scratch_path

#: Bytes a table may have before a broadcast hint is left out (measured, not assumed).
BROADCAST_BYTES = 32 << 20


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back.

    Cuts lineage in a way that survives lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows, of at most ``row_bytes`` each,
    are counted to fit ``limit``; otherwise unchanged, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def text_key(col: str = "text") -> Column:
    """Two independent 64-bit hashes of a text, as one struct: with the id, the
    identity of a row by its content, so that repeated rows stay well defined."""
    return F.struct(F.xxhash64(F.lit(1), F.col(col)).alias("a"), F.xxhash64(F.lit(2), F.col(col)).alias("b"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def hash_sample(df: DataFrame, col: str, rows: int, total: int, seed: int) -> DataFrame:
    """About ``rows`` of the ``total`` rows, chosen by the hash of ``col``; all if they are no more."""
    share = rows / max(total, 1)
    if share >= 1:
        return df
    return df.filter(F.xxhash64(F.lit(seed), col) < F.lit(int(share * (1 << 63)) * 2 - (1 << 63)))
