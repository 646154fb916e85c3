"""Chosen files, processing state, file inventory, and references between them."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from greenlight.functions.text import file_extension, file_name, filled
from greenlight.session import release, shared_dir


def chosen_path(kind: str) -> Column:
    """The corrected file wins even when it is missing on disk."""
    corrected, original = f"corrected_{kind}", f"{kind}_file"
    return F.when(filled(corrected), F.col(corrected)).when(filled(original), F.col(original)).otherwise("")


def attach_files(v: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``pdf_current_hash`` and ``source_current_hash`` of the chosen files; NULL when missing."""
    out = v
    for kind in ("pdf", "source"):
        known = files.select(
            F.col("path").alias(f"_{kind}"), F.col("sha256").alias(f"{kind}_current_hash")
        )
        out = out.withColumn(f"_{kind}", chosen_path(kind)).join(known, f"_{kind}", "left").drop(f"_{kind}")
    return out


def file_exists(kind: str) -> Column:
    return F.col(f"{kind}_current_hash").isNotNull()


def file_state(kind: str) -> Column:
    """corrected / corrected_missing / original / missing."""
    exists = file_exists(kind)
    return (
        F.when(filled(f"corrected_{kind}"), F.when(exists, "corrected").otherwise("corrected_missing"))
        .when(exists, "original")
        .otherwise("missing")
    )


def persisted_file_state(kind: str) -> Column:
    """As ``file_state`` from the stored paths alone."""
    return (
        F.when(filled(f"corrected_{kind}"), "corrected")
        .when(filled(f"{kind}_file"), "original")
        .otherwise("missing")
    )


def display_path(kind: str) -> Column:
    """For reading only: falls back to the original when the corrected file is missing."""
    return (
        F.when(filled(f"corrected_{kind}") & F.col(f"corrected_{kind}_exists"), F.col(f"corrected_{kind}"))
        .when(filled(f"{kind}_file") & F.col(f"{kind}_file_exists"), F.col(f"{kind}_file"))
        .otherwise("")
    )


def persisted_needs_processing() -> Column:
    has_file = filled("corrected_pdf") | filled("pdf_file")
    incomplete = (
        (F.col("processing_status") != "processed")
        | F.col("pages").isNull()
        | ~filled("pdf_hash")
        | (F.coalesce("thumbnail_status", F.lit("")) != "processed")
        | ~filled("thumbnail_folder")
    )
    return has_file & incomplete


def content_stale() -> Column:
    """The present file is not the one that was processed."""
    return file_exists("pdf") & (
        (F.col("processing_status") != "processed")
        | (F.col("pdf_current_hash") != F.coalesce("pdf_hash", F.lit("")))
    )


def needs_processing() -> Column:
    """Strict form: also compares the hash of the present file."""
    return file_exists("pdf") & (
        (F.col("processing_status") != "processed")
        | F.col("pages").isNull()
        | ~filled("pdf_hash")
        | ~filled("thumbnail_folder")
        | content_stale()
    )


HASHED = "path string, length long, modified timestamp, sha256 string, bytes_read long, error string"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) of all files below a folder. The listing alone: no content is read.

    Spark's listing leaves out empty files and names that begin with a dot or an underscore.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def _reader(chunk: int):
    schema = pa.schema([
        ("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", tz="UTC")), ("sha256", pa.string()), ("bytes_read", pa.int64()), ("error", pa.string()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            digests, sizes, errors = [], [], []
            for path in batch.column("path").to_pylist():
                digest, size, error = hashlib.sha256(), 0, None
                try:
                    store, name = _store_of(path)
                    with store.open_input_stream(name, compression=None) as file:
                        while piece := file.read(chunk):
                            digest.update(piece)
                            size += len(piece)
                except (OSError, pa.ArrowInvalid) as problem:  # gone or closed to us since the listing: a row, not a failed job
                    error = str(problem)
                digests.append(None if error else digest.hexdigest())
                sizes.append(size)
                errors.append(error)
            columns = [batch.column(c) for c in ("path", "length", "modified")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], schema=schema)

    return read


def _store_of(path: str):
    """The file system of a path as Spark lists it, which isn't escaped, and the name there."""
    from pyarrow import fs

    scheme, host, name = re.fullmatch(r"(?:([A-Za-z][\w+.-]*):(?://([^/]*))?)?(/.*)", path, re.S).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), name
    store, base = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return store, base.rstrip("/") + name


def hash_files(listed: DataFrame, known: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """(path, length, modified, sha256, bytes_read, error) of all listed files, of which only new ones are read.

    ``listed`` has path, length and modified, as of ``list_files``; ``known`` is an earlier result. What was hashed
    under the same path, length and time is taken over by a join of the narrow rows. The others are dealt out evenly
    and read by the tasks themselves, ``chunk`` bytes at a time, so a file of any length takes the memory of a chunk.
    A file that can't be read is a row with its error and no digest, and is read again next time.
    """
    keys = ["path", "length", "modified"]
    hashed = known.where("sha256 IS NOT NULL").groupBy(*keys).agg(F.max("sha256").alias("sha256"))
    kept = listed.select(*keys).distinct().join(hashed, keys).select(*keys, "sha256", F.lit(0).cast("long").alias("bytes_read"), F.lit(None).cast("string").alias("error"))
    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fresh = listed.select(*keys).distinct().join(hashed, keys, "left_anti").repartition(parts)
    return kept.unionByName(fresh.mapInArrow(_reader(chunk), HASHED))


def hash_contents(files: DataFrame, known: DataFrame) -> DataFrame:
    """(path, length, modified, sha256) of rows that carry their content: those of a new signature are hashed."""
    keys = ["path", "length", "modified"]
    fresh = files.join(known.select(*keys), keys, "left_anti").select(*keys, F.sha2("content", 256).alias("sha256"))
    kept = known.join(files.select(*keys), keys, "left_semi").select(*keys, "sha256")
    return kept.unionByName(fresh)


def uploaded_files(listing: DataFrame) -> DataFrame:
    """Parse uploaded names: (name, version_id, kind, status) with invalid and ambiguous ones marked."""
    from greenlight.functions.text import upload_kind, upload_version_id

    parsed = listing.withColumns(
        {"version_id": upload_version_id("name"), "kind": upload_kind("name")}
    )
    sizes = parsed.filter("kind != ''").groupBy("version_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    joined = parsed.join(sizes, ["version_id", "kind"], "left")
    status = F.when(F.col("kind") == "", "invalid").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    return joined.withColumn("status", status).drop("n")


def upload_lookup(indexed: DataFrame) -> DataFrame:
    """One row per version with the hash of its uploaded pdf and source."""
    ok = indexed.filter("status = 'ok'")
    return ok.groupBy("version_id").agg(
        F.max(F.when(F.col("kind") == "pdf", F.col("sha256"))).alias("upload_pdf_hash"),
        F.max(F.when(F.col("kind") == "source", F.col("sha256"))).alias("upload_source_hash"),
    )


# -- inventory --------------------------------------------------------------

# Fixed value: which category keeps a path that two scans claim, strongest last
PROTECTION = ("cache", "report", "export", "thumbnail", "upload", "original")


def prefer_category(files: DataFrame, order=PROTECTION) -> DataFrame:
    """One row per path, in its most protected category."""
    rank = F.lit(-1)
    for position, name in enumerate(order):
        rank = F.when(F.col("category") == name, position).otherwise(rank)
    return (
        files.groupBy("path")
        .agg(F.max(F.struct(rank.alias("rank"), F.col("category"), F.col("length"))).alias("p"))
        .select("path", "p.category", "p.length")
    )


def category_totals(files: DataFrame) -> DataFrame:
    """Bytes and files per category, plus the total as category 'total'."""
    return (
        files.rollup("category")
        .agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"))
        .withColumn("category", F.coalesce("category", F.lit("total")))
    )


def tree_key(path: Column) -> Column:
    """A path as a text in whose order everything within a folder follows the folder at once: the separator sorts
    before any other character, and each part is ended by one."""
    return F.concat(F.regexp_replace(F.regexp_replace(path, "/+$", ""), "/", "\x01"), F.lit("\x01"))


def covered_paths(paths: DataFrame, trees: DataFrame) -> DataFrame:
    """The distinct paths that are one of the folders ``trees`` or lie below one.

    Paths and folders are laid in ranges of one order, in which a folder stands right before all it holds. The texts
    it holds end with that folder's last one, and such stretches lie apart or within one another, so a path is covered
    if the greatest end of the folders up to it is not before it: a running maximum in each range, and one row a
    range to carry it on. No path is exploded and no folder is a key, so a folder with a third of all files is as
    good as any other.
    """
    asked = paths.select("path").distinct()
    return _with_cover(asked, trees).where("covered").select("path")


def _with_cover(files: DataFrame, trees: DataFrame) -> DataFrame:
    """``files`` with ``covered``, as ``covered_paths`` tells it. The rows are held once, as a table of the shared folder
    without the order's own texts, which follow from the path."""
    spark, key = files.sparkSession, tree_key(F.col("path"))
    folders = trees.where("path != ''").select("path", F.lit(True).alias("_folder")).distinct()
    rows = files.withColumn("_folder", F.lit(False)).unionByName(folders, allowMissingColumns=True)
    held = f"{shared_dir(spark)}/greenlight/laid-{uuid.uuid4().hex}"
    rows.repartitionByRange(key).withColumn("_range", F.spark_partition_id()).write.parquet(held)
    release(spark)
    laid = spark.read.parquet(held)
    at = tree_key(F.col("path"))
    laid = laid.withColumns({"_at": at, "_end": F.when(F.col("_folder"), F.concat(at, F.lit("\U0010ffff")))})
    so_far = Window.partitionBy("_range").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = laid.groupBy("_range").agg(F.max("_end").alias("last"))
    earlier = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    carried = ends.select("_range", F.max("last").over(earlier).alias("_carried"))
    reach = laid.withColumn("_reach", F.max("_end").over(so_far)).join(F.broadcast(carried), "_range").where(~F.col("_folder"))
    covered = F.coalesce(F.greatest("_reach", "_carried") >= F.col("_at"), F.lit(False))
    return reach.select(*files.columns, covered.alias("covered"))


def unreferenced_files(files: DataFrame, refs: DataFrame) -> DataFrame:
    """Files named by no reference, neither exactly nor through a folder of kind 'tree'. A file without a path is none
    of what a reference names."""
    exact = refs.filter("kind != 'tree'").select("path").distinct()
    left = files.join(exact, "path", "left_anti")
    return _with_cover(left, refs.filter("kind = 'tree'").select("path")).where("NOT covered").drop("covered")


def missing_references(refs: DataFrame, files: DataFrame) -> DataFrame:
    return refs.filter("path != ''").join(files.select("path"), "path", "left_anti")


def cleanup_candidates(unreferenced: DataFrame, policies, protected) -> DataFrame:
    """Unreferenced files a policy allows to delete.

    ``policies`` is [(name, category, extensions, prefix)]; paths under ``protected``
    never qualify.
    """
    path, ext = F.col("path"), file_extension("path")
    policy = F.lit(None).cast("string")
    for name, category, extensions, prefix in reversed(list(policies)):
        test = (F.col("category") == category) & path.startswith(prefix)
        if extensions:
            test = test & ext.isin(*extensions)
        policy = F.when(test, name).otherwise(policy)
    guarded = F.lit(False)
    for root in protected:
        guarded = guarded | path.startswith(root)
    return unreferenced.withColumn("policy", F.when(guarded, None).otherwise(policy)).filter(
        F.col("policy").isNotNull()
    )


def candidate_totals(candidates: DataFrame, scan_errors: DataFrame) -> DataFrame:
    """Files and bytes per policy; ``blocked`` when the scan had any error."""
    errors = scan_errors.agg((F.count(F.lit(1)) > 0).alias("blocked"))
    totals = candidates.groupBy("policy").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )
    return totals.withColumn("blocked", errors.scalar())


def largest(files: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` largest files; ties go to the path that sorts first."""
    return files.orderBy(F.desc("length"), "path").limit(k)


def artifact_counts(files: DataFrame, classes) -> DataFrame:
    """Count by the first pattern contained in the path; ``classes`` is [(pattern, name)]."""
    name = F.when(F.lit(False), "")
    for pattern, shown in classes:
        name = name.when(F.col("path").contains(pattern), shown)
    return files.groupBy(name.otherwise("other").alias("artifact")).agg(F.count(F.lit(1)).alias("files"))


def outside_snapshot(refs: DataFrame, roots) -> DataFrame:
    """Referenced artifacts that no snapshot folder contains."""
    inside = F.lit(False)
    for root in roots:
        inside = inside | F.col("path").startswith(root)
    return refs.filter((F.col("path") != "") & ~inside).select("path", file_name("path").alias("name"))
