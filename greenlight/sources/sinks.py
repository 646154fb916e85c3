"""Sinks: the log, report sheets, safe CSV, snapshots and their validation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from greenlight.functions.digest import table_digest
from greenlight.functions.text import formula_safe


def append_event(events: DataFrame, path: str) -> None:
    """Append one JSON line per event, keys sorted."""
    line = F.to_json(F.struct(*sorted(events.columns)))
    events.select(line.alias("value")).write.mode("append").text(path)


def csv_safe(df: DataFrame) -> DataFrame:
    """Strings that a spreadsheet would run as a formula get a leading apostrophe."""
    return df.select(*[formula_safe(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def write_csv_safe(df: DataFrame, path: str) -> None:
    """CSV with header and a byte order mark in the first header cell of every part."""
    safe = csv_safe(df)
    named = safe.withColumnRenamed(safe.columns[0], "﻿" + safe.columns[0])
    named.write.mode("errorifexists").option("header", True).option("encoding", "UTF-8").csv(path)


class ReportError(RuntimeError):
    pass


def write_report(sheets: Mapping[str, DataFrame], folder: str, run_id: str) -> DataFrame:
    """One parquet directory per sheet under a run id, then a checked manifest, then the pointer.

    Counts are observed while the sheets are written and compared with a reread; the
    pointer row, written last, is what readers follow, so a failed run is never seen.
    """
    if not sheets:
        raise ReportError("a report needs at least one sheet")
    for name in sheets:
        if not name or len(name) > 31 or any(c in name for c in "[]:*?/\\"):
            raise ReportError(f"invalid sheet name: {name!r}")
    spark = next(iter(sheets.values())).sparkSession
    base = f"{folder.rstrip('/')}/{run_id}"
    rows = []
    for order, (name, df) in enumerate(sheets.items()):
        path = f"{base}/{name}"
        df.write.mode("errorifexists").parquet(path)
        rows.append((order, name, path, spark.read.parquet(path).count(), len(df.columns)))
    manifest = spark.createDataFrame(rows, "sheet_order int, sheet string, path string, n_rows long, n_columns int")
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{base}/_manifest_rows")
    check_report(spark, folder, run_id, list(sheets))
    pointer = spark.createDataFrame([(run_id,)], "run_id string").withColumn("published_at", F.current_timestamp())
    pointer.coalesce(1).write.mode("append").parquet(f"{folder.rstrip('/')}/pointer")
    return manifest


def check_report(spark: SparkSession, folder: str, run_id: str, expected: list[str]) -> None:
    base = f"{folder.rstrip('/')}/{run_id}"
    rows = spark.read.parquet(f"{base}/_manifest_rows").orderBy("sheet_order").collect()  # one row per sheet
    if [r["sheet"] for r in rows] != expected:
        raise ReportError("sheets differ from the plan")
    for row in rows:
        if spark.read.parquet(row["path"]).count() != row["n_rows"]:
            raise ReportError(f"sheet {row['sheet']} changed after it was written")


def current_report(spark: SparkSession, folder: str) -> str:
    """The run id readers should follow."""
    pointer = spark.read.parquet(f"{folder.rstrip('/')}/pointer")
    return pointer.agg(F.max_by("run_id", "published_at").alias("r")).first()["r"]


def snapshot_tables(tables: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Parquet per table and a manifest of row counts and order-free digests."""
    base, manifest = folder.rstrip("/"), None
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{base}/{name}")
        stored = df.sparkSession.read.parquet(f"{base}/{name}")
        row = table_digest(stored).select(
            F.lit(name).alias("table_name"), "n_rows", F.col("lane_sum").cast("string").alias("lane_sum"), "lane_xor"
        )
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{base}/manifest")
    return df.sparkSession.read.parquet(f"{base}/manifest")


def validate_snapshot(spark: SparkSession, folder: str, schemas: Mapping[str, Mapping[str, str]], checks: Mapping[str, list] = {}) -> DataFrame:
    """Error rows (table_name, problem, n); empty means the snapshot is good.

    ``schemas`` is table -> {column: type}; ``checks`` is table -> [(problem, bad-row condition)].
    The settings table must hold exactly one row.
    """
    base = folder.rstrip("/")
    manifest = {r["table_name"]: r for r in spark.read.parquet(f"{base}/manifest").collect()}  # one row per table
    errors: list[tuple] = []
    frames = []
    for name, columns in schemas.items():
        if name not in manifest:
            errors.append((name, "table is missing", 1))
            continue
        df = spark.read.parquet(f"{base}/{name}")
        found = dict(df.dtypes)
        for column, kind in columns.items():
            if column not in found:
                errors.append((name, f"column {column} is missing", 1))
            elif found[column] != kind:
                errors.append((name, f"column {column} is {found[column]}, not {kind}", 1))
        digest = table_digest(df).select("n_rows", F.col("lane_sum").cast("string").alias("lane_sum"), "lane_xor")
        expected = manifest[name]
        frames.append(
            digest.filter(~F.col("n_rows").eqNullSafe(F.lit(expected["n_rows"]))).select(
                F.lit(name).alias("table_name"), F.lit("row count differs from the manifest").alias("problem"), F.col("n_rows").alias("n")
            )
        )
        frames.append(
            digest.filter(
                (F.col("n_rows") == expected["n_rows"])
                & ~(F.col("lane_sum").eqNullSafe(F.lit(expected["lane_sum"])) & F.col("lane_xor").eqNullSafe(F.lit(expected["lane_xor"])))
            ).select(F.lit(name).alias("table_name"), F.lit("content differs from the manifest").alias("problem"), F.col("n_rows").alias("n"))
        )
        if name == "settings" and expected["n_rows"] != 1:
            errors.append((name, "exactly one settings row is required", expected["n_rows"]))
        tests = [(p, c) for p, c in checks.get(name, [])]
        if tests:
            counted = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, (_p, c) in enumerate(tests)])
            for i, (problem, _c) in enumerate(tests):
                frames.append(
                    counted.filter(F.col(f"c{i}") > 0).select(
                        F.lit(name).alias("table_name"), F.lit(problem).alias("problem"), F.col(f"c{i}").alias("n")
                    )
                )
    out = spark.createDataFrame(errors, "table_name string, problem string, n long")
    for frame in frames:
        out = out.unionByName(frame)
    return out
