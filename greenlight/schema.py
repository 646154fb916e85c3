"""Data-quality checks that the store's constraints used to enforce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenlight.catalog import ENUMS
from greenlight.functions.text import filled, strip


def duplicate_master_keys(m: DataFrame) -> DataFrame:
    """Ids equal after trimming and lowering: (key, n, first_id)."""
    return (
        m.groupBy(F.lower(strip("record_id")).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_id"))
        .filter("n > 1")
    )


def decision_consistent() -> Column:
    """Status, reason, notes and time of an exclusion agree."""
    decision, reason, notes = F.col("decision"), filled("exclusion_reason"), filled("exclusion_notes")
    dated = F.col("excluded_at").isNotNull()
    return (
        ((decision == "publishing") & ~reason & ~notes & ~dated)
        | ((decision == "not_publishing") & reason & dated)
        | (decision == "decision_required")
    )


def master_checks() -> list[tuple[str, Column]]:
    return [
        ("record id is blank or not trimmed", (F.col("record_id") != strip("record_id")) | ~filled("record_id")),
        ("unknown decision", ~F.col("decision").isin(*ENUMS["decision"])),
        ("decision and exclusion fields disagree", ~decision_consistent()),
    ]


def version_checks() -> list[tuple[str, Column]]:
    out = [("version id is blank", ~filled("version_id")), ("negative page count", F.col("pages") < 0)]
    for column in ("origin", "review_status", "duplicate_review_status", "processing_status", "format_status",
                   "extraction_status", "verification_status", "exclusion_reason", "title_author_source"):
        out.append((f"unknown {column}", ~F.coalesce(column, F.lit("")).isin(*ENUMS[column])))
    for column in ("similarity", "single"):
        out.append((f"{column} outside 0..100", (F.col(column) < 0) | (F.col(column) > 100)))
    return out


def quality_report(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """(problem, n) of every check in one scan."""
    counts = df.agg(
        F.array(
            *[
                F.struct(F.lit(p).alias("problem"), F.count_if(F.coalesce(c, F.lit(False))).alias("n"))
                for p, c in checks
            ]
        ).alias("rows")
    )
    return counts.select(F.inline("rows"))


def mapped_masters(m: DataFrame, v: DataFrame) -> DataFrame:
    """Master rows that may not be deleted because versions point at them."""
    return m.join(v.select("record_id"), "record_id", "left_semi")
