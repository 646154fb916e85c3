"""A stored table in key buckets, so that an upsert rewrites only the buckets it touches.

The number of buckets is part of the layout (``of_buckets=64/store_bucket=3``), so every upsert deals its keys as the
first write did. Choose it so that one bucket is a few files of a task's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from greenlight.operators.changes import upsert

LAYOUT = ("of_buckets", "store_bucket")


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, keys: list[str], buckets: int, mode: str) -> None:
    dealt = df.withColumns({"of_buckets": F.lit(buckets), "store_bucket": _bucket(keys, buckets)})
    dealt.repartition("store_bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(path)


def write_store(df: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """A new store of ``df``, which holds each key once and at least one row."""
    _write(df, path, keys, buckets, "errorifexists")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(*LAYOUT)


def upsert_store(spark: SparkSession, path: str, changes: DataFrame, keys: list[str]) -> list[int]:
    """Upsert ``changes`` (each key once, the given columns only) into a store; the buckets that were rewritten.

    Only touched buckets are read (partition pruning) and replaced when the job commits; a job that fails before
    that leaves the store as it was. The driver learns at most one number a bucket.
    """
    stored = spark.read.parquet(path)
    buckets = stored.select("of_buckets").first()["of_buckets"]
    touched = sorted(r["b"] for r in changes.select(_bucket(keys, buckets).alias("b")).distinct().collect())
    if touched:
        held = stored.where(F.col("store_bucket").isin(touched)).drop(*LAYOUT)
        _write(upsert(held, changes, keys), path, keys, buckets, "overwrite")
    return touched
