"""Readers: delimited files in unknown encodings, the event log, file listings, snapshots."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from greenlight.functions.text import nonblank, strip

# Fixed value: encodings in the order they are tried; the last one accepts any bytes
ENCODINGS = ("utf-8-sig", "utf-8", "cp950", "big5", "gb18030", "cp1252", "latin1")
# encodings the CSV scan takes itself; the others are read as bytes and decoded per column
SCANNED = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "latin1": "ISO-8859-1"}


def detect_encodings(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """(path, encoding, header): the first encoding that decodes the whole file, and its first line; one row per file."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, headers = [], []
            for content in batch["content"]:
                chosen = encodings[-1]
                for name in encodings:
                    if name == "utf-8-sig" and not content.startswith(b"\xef\xbb\xbf"):
                        continue
                    try:
                        content.decode(name)
                    except UnicodeDecodeError:
                        continue
                    chosen = name
                    break
                found.append(chosen)
                headers.append(content.split(b"\n", 1)[0].rstrip(b"\r").decode(chosen, "replace"))
            yield pd.DataFrame({"path": batch["path"], "encoding": found, "header": headers})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(probe, "path string, encoding string, header string")


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lstrip("﻿").lower() for c in df.columns])


def _redecode(encoding: str):
    @F.pandas_udf("string")
    def redecode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None else v.encode("latin1").decode(encoding, "replace"))

    return redecode


def _read_group(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    """One CSV scan. Other encodings keep ASCII delimiters, so their bytes pass through ISO-8859-1."""
    scan = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("encoding", SCANNED.get(encoding, "ISO-8859-1"))
        .csv(paths)
    )
    if encoding in SCANNED:
        return normalize_columns(scan)
    redecode = _redecode(encoding)
    names = [c.encode("latin1").decode(encoding, "replace") for c in scan.columns]
    return normalize_columns(scan.toDF(*[f"c{i}" for i in range(len(names))]).select(*[redecode(f"c{i}") for i in range(len(names))]).toDF(*names))


def read_delimited(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """CSV files of any of the encodings, missing values as ''.

    The files are probed in parallel; the driver sees one row per encoding and header line, and
    each such group is read by one ordinary CSV scan, since a scan takes one header for all its files.
    """
    groups = (
        detect_encodings(spark, path, encodings)
        .groupBy("encoding", "header")
        .agg(F.collect_list("path").alias("paths"))  # file names, not data
        .collect()
    )
    out = None
    for group in sorted(groups, key=lambda g: (g["encoding"], g["header"])):
        part = _read_group(spark, group["paths"], group["encoding"])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no files at {path}")
    return out.na.fill("")


class MissingColumns(ValueError):
    pass


def alias_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]], required: Sequence[str] = ()) -> DataFrame:
    """Logical columns from the first non-empty of several header names.

    A file without any header of a required column is refused with the full list.
    """
    missing = [name for name in required if not any(a in df.columns for a in aliases.get(name, (name,)))]
    if missing:
        raise MissingColumns("file is missing required columns: " + ", ".join(missing))
    columns = []
    for name, options in aliases.items():
        present = [o for o in options if o in df.columns]
        if present:
            filled = [F.when(nonblank(o), strip(o)) for o in present]
            columns.append(F.coalesce(*filled, F.lit("")).alias(name))
    return df.select(*columns)


MASTER_ALIASES = {
    "record_id": ("paper_id", "submission id", "initial_submission_id"),
    "accept_status": ("acceptance_status", "accept status", "acceptance status"),
    "title": ("title",),
    "authors": ("authors",),
    "notes": ("notes",),
}
VERSION_ALIASES = {
    "version_id": ("final_submission_id", "submission id"),
    "entered_id": ("start2_paper_id_raw", "author_entered_paper_id", "paper-id", "paper_id_filled", "paper_id"),
    "title": ("final_submission_title", "title"),
    "authors": ("final_submission_authors", "authors"),
    "upload_date": ("upload_date",),
    "original_file_name": ("original_file_name",),
}

LOG_SCHEMA = (
    "timestamp string, event_id string, app_version string, actor string, action string, status string, "
    "message string, object_type string, paper_id string, final_submission_id string, "
    "changed_fields array<string>, before map<string,string>, after map<string,string>, "
    "reset_flags map<string,string>, file_changes map<string,string>, result_counts map<string,string>, "
    "error string, _corrupt string"
)


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """Text lines (column ``value``) -> events; a bad line becomes an ``unparseable_log_line``."""
    parsed = lines.filter(nonblank("value")).select(
        F.col("value").alias("raw"),
        F.from_json("value", LOG_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"),
    )
    bad = F.col("e._corrupt").isNotNull() | F.col("e").isNull()
    kept = [f for f in ("event_id", "actor", "object_type", "paper_id", "final_submission_id", "changed_fields",
                        "before", "after", "reset_flags", "file_changes", "result_counts", "error")]
    return parsed.select(
        "raw",
        F.when(bad, "").otherwise(F.col("e.timestamp")).alias("timestamp"),
        F.when(bad, None).otherwise(F.col("e.timestamp").try_cast("timestamp")).alias("ts"),
        F.when(bad, "unparseable_log_line").otherwise(F.col("e.action")).alias("action"),
        F.when(bad, "error").otherwise(F.col("e.status")).alias("status"),
        F.when(bad, F.substring("raw", 1, 500)).otherwise(F.col("e.message")).alias("message"),
        *[F.when(~bad, F.col(f"e.{f}")).alias(f) for f in kept],
    )


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log_lines(spark.read.text(path))


def read_file_inventory(spark: SparkSession, roots: Mapping[str, str]) -> DataFrame:
    """(category, path, length, modified) of every file below the roots; content is never read."""
    out = None
    for category, root in roots.items():
        part = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .load(root)
            .select(F.lit(category).alias("category"), "path", "length", F.col("modificationTime").alias("modified"))
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no roots given")
    return out


def read_upload_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, length, sha256) of uploaded files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        F.substring_index(F.url_decode("path"), "/", -1).alias("name"), "path", "length", F.sha2("content", 256).alias("sha256")
    )


def load_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """A snapshot read: a fixed set of paths per table."""
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in names}
