"""The combined list: open master records and orphan versions with all statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenlight.functions.text import contains_joined
from greenlight.operators import duplicates, scope, status, versions
from greenlight.settings import Settings

SEARCHED = (
    "m_accept_status", "m_title", "m_authors", "m_notes", "version_id", "entered_id", "record_id", "title",
    "authors", "extracted_title", "extracted_authors", "similarity", "single",
)


def combined_rows(m: DataFrame, v: DataFrame, s: Settings) -> DataFrame:
    """Master rows that are not excluded with their single version, plus orphan versions."""
    groups = versions.record_groups(v, m).select(
        "record_id", "n_active", versions.is_origin_conflict().alias("origin_conflict")
    )
    open_masters = m.filter(F.col("decision") != scope.EXCLUDED)
    prefixed = open_masters.select(
        "record_id", *[F.col(c).alias(f"m_{c}") for c in m.columns if c != "record_id"]
    )
    scoped = scope.in_scope(v, m)
    # a record with several active versions shows none of them
    single = scoped.join(groups.filter("n_active = 1").select("record_id"), "record_id", "left_semi")
    master_rows = (
        prefixed.join(groups, "record_id", "left")
        .join(single, "record_id", "left")
        .withColumn("row_type", F.lit("master"))
    )
    orphan_rows = scope.orphans(v, m).withColumn("row_type", F.lit("unmatched"))
    rows = master_rows.unionByName(orphan_rows, allowMissingColumns=True)
    flags = duplicates.duplicate_flags(duplicates.member_keys(scoped, s))
    return status.with_statuses(rows.join(flags, "version_id", "left"), s)


def combined_list(m, v, s: Settings, name: str = "all", text: str = "", record_id: str = "") -> DataFrame:
    """Searched and filtered rows with predicates and the attention priority as columns."""
    rows = combined_rows(m, v, s)
    tests = status.predicates()
    if record_id:
        rows, name = rows.filter(F.col("record_id") == record_id), "all"
    elif text.strip():
        rows = rows.filter(contains_joined(SEARCHED, text))
    rows = rows.withColumns({f"is_{k}": test for k, test in tests.items() if k != "all"})
    rows = rows.withColumn("priority", status.attention_priority({
        k: F.col(f"is_{k}") for k in tests if k != "all"
    }))
    if name in status.FILTERS and name != "all":
        rows = rows.filter(F.col(f"is_{name}"))
    return rows


def combined_summary(rows: DataFrame) -> DataFrame:
    """Counters of a filtered list, in one aggregate."""
    counters = {
        "total_rows": F.lit(True),
        "missing_final": F.col("is_missing_final"),
        "unverified": ((F.col("row_type") == "unmatched") | status.has_version()) & ~F.col("verified"),
        "verified_title_differences": F.col("is_verified_title_differences"),
        "pdf_issues": F.col("is_pdf_issues"),
        "source_issues": F.col("is_source_issues"),
        "extraction_issues": F.col("is_extraction_issues"),
        "format_issues": F.col("is_format_not_ok"),
        "page_errors": F.col("is_page_issues"),
        "missing_plagiarism": F.col("is_missing_plagiarism"),
        "plagiarism_issues": F.col("is_score_problem"),
        "publication_duplicates": status.has_version() & F.col("has_duplicate"),
        "duplicate_author_issues": F.col("repeats_open"),
        "version_conflicts": F.col("is_version_conflicts"),
        "needs_process_pdfs": F.col("to_process"),
    }
    return rows.agg(*[F.count_if(test).alias(name) for name, test in counters.items()])


# Counter -> (label, level)
METRICS = {
    "missing_final": ("No Final", "danger"),
    "unverified": ("Paper ID Review", "danger"),
    "pdf_issues": ("PDF Issues", "danger"),
    "page_errors": ("Page Issues", "warning"),
    "source_issues": ("Source File Issues", "danger"),
    "extraction_issues": ("Extraction Review", "warning"),
    "missing_plagiarism": ("No Plagiarism", "warning"),
    "plagiarism_issues": ("P/S Issues", "danger"),
    "format_issues": ("Formatting Not OK", "warning"),
    "publication_duplicates": ("Duplicates", "danger"),
    "version_conflicts": ("Version Conflicts", "danger"),
    "duplicate_author_issues": ("Duplicate Authors", "danger"),
}


def blocker_metrics(summary: DataFrame) -> DataFrame:
    """The non-zero counters as rows (metric, label, level, value)."""
    long = summary.unpivot([], list(METRICS), "metric", "value").filter("value > 0")
    label, level = F.lit(""), F.lit("")
    for name, (shown, kind) in METRICS.items():
        label = F.when(F.col("metric") == name, shown).otherwise(label)
        level = F.when(F.col("metric") == name, kind).otherwise(level)
    return long.select("metric", label.alias("label"), level.alias("level"), "value")


def process_labels(rows: DataFrame, limit: int = 12) -> DataFrame:
    """The first labels to process, with how many more there are."""
    todo = rows.filter("to_process")
    first = todo.orderBy("priority", "record_id", "version_id").limit(limit).select(
        F.concat(
            F.when(F.col("record_id") == "", "No Paper ID").otherwise(F.col("record_id")),
            F.lit(" / Final "), F.col("version_id"),
        ).alias("label")
    )
    more = todo.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("more"))
    return first.withColumn("more", more.scalar())
