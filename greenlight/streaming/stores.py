"""Streams that end in files: nothing of their results goes through the driver.

``append_to_files`` runs an append stream over what has arrived into the exactly-once file sink. The version store
keeps the newest row of every version: the stream's state is that one row, each batch writes the versions it changed
into a folder of its own, named by the batch, so that a batch that runs again replaces what it wrote. Readers take the
newest row of each version over the last compaction and the batches after it. The active version of a record is then
one maximum over its versions that still stand, so a discard that arrives late gives the record back to the version
that was active before, however many versions the record has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from greenlight.functions.text import filled, natural_key
from greenlight.operators.versions import EDITOR

STORED = "version_id string, seq long, discarded boolean, origin string, record_id string, created_at timestamp"


def feed(rows: DataFrame, folder: str) -> None:
    """Let rows arrive in a folder that a stream reads."""
    rows.write.mode("append").parquet(folder)


def append_to_files(stream: DataFrame, folder: str) -> None:
    """Run an append-mode stream over all that has arrived; ``appended`` reads what has come out so far."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows")
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def appended(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/rows")


# -- the version store --------------------------------------------------------


def open_store(spark: SparkSession, folder: str) -> None:
    """An empty store: a compaction that goes through no batch, and a batch before the first."""
    none = spark.createDataFrame([], STORED)
    none.write.mode("overwrite").parquet(f"{folder}/compact/through=-1")
    none.write.mode("overwrite").parquet(f"{folder}/batches/batch=-1")


def newest(rows: DataFrame) -> DataFrame:
    """The row with the highest ``seq`` of each version; of equal ones a discard wins."""
    order = F.struct("seq", "discarded", "origin", "record_id", "created_at")
    return rows.where("version_id IS NOT NULL").groupBy("version_id").agg(F.max(order).alias("v")).select("version_id", "v.*")


def keep_versions(changes: DataFrame, folder: str) -> None:
    """Run a stream of changed versions over all that has arrived into an open store.

    ``changes`` has the columns of ``STORED``; ``seq`` orders the changes of one version, which may arrive in any order.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batches/batch={batch_id}")

    writer = newest(changes).writeStream.outputMode("update").foreachBatch(write)
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def _compacted(spark: SparkSession, folder: str) -> tuple[int, DataFrame]:
    """The last batch that a compaction covers, and its rows."""
    rows = spark.read.schema(f"{STORED}, through int").parquet(f"{folder}/compact")
    names = spark.read.format("binaryFile").load(f"{folder}/compact").select(F.max("through")).first()[0]
    return names, rows.where(F.col("through") == names).drop("through")


def read_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The newest row of every version."""
    through, base = _compacted(spark, folder)
    later = spark.read.schema(f"{STORED}, batch int").parquet(f"{folder}/batches").where(F.col("batch") > through).drop("batch")
    return newest(base.unionByName(later))


def compact(spark: SparkSession, folder: str) -> int:
    """Merge all batches so far into one folder, so that readers skip them; the last batch it covers.

    Run twice it writes the same folder again; a reader that is under way keeps its own.
    """
    last = spark.read.format("binaryFile").load(f"{folder}/batches").select(F.max("batch")).first()[0]
    through, base = _compacted(spark, folder)
    if last > through:
        added = spark.read.schema(f"{STORED}, batch int").parquet(f"{folder}/batches").where(F.col("batch").between(through + 1, last)).drop("batch")
        newest(base.unionByName(added)).write.mode("overwrite").parquet(f"{folder}/compact/through={last}")
    return last


def active_versions(stored: DataFrame) -> DataFrame:
    """(record_id, version_id) of the active version of each record."""
    rank = F.struct((F.col("origin") == EDITOR).alias("editor"), natural_key("version_id").alias("key"), F.col("created_at"), F.col("version_id"))
    standing = stored.filter(~F.coalesce(F.col("discarded"), F.lit(False)) & filled("record_id"))
    return standing.groupBy("record_id").agg(F.max(rank).alias("best")).select("record_id", F.col("best.version_id").alias("version_id"))
