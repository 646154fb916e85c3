"""The dashboard: counts over publishable rows, master rows, groups and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenlight.functions.text import filled
from greenlight.operators import aggregates, exceptions, files, names, rules, scope, versions
from greenlight.operators.measures import with_measures
from greenlight.settings import Settings


def version_tests(s: Settings) -> dict[str, Column]:
    """Counters over publishable versions joined with their master."""
    mapped = F.col("m_decision").isNotNull()
    match, verified = rules.titles_match_master(), rules.effectively_verified()
    title, people = filled("extracted_title"), filled("extracted_authors")
    review = F.col("review_status")
    pages, page_ok = F.col("pages"), exceptions.waiver_valid("page")
    plag = exceptions.exception_status("plagiarism_percent", s)
    single = exceptions.exception_status("single_percent", s)
    open_states = ("not_allowed", "stale")
    counted = pages.isNotNull() & (pages != 0)
    return {
        "active_versions": F.lit(True),
        "candidates": mapped,
        "unverified_ids": ~verified,
        "title_mismatches": mapped & ~match & ~verified,
        "verified_title_differences": mapped & ~match & verified,
        "reviewed_title_differences": (review == "review_ok") & title & filled("title")
        & ((F.col("x_extracted") == "") | (F.col("x_extracted") != F.col("x_title"))),
        "not_in_master": ~mapped,
        "page_limit_errors": counted & (pages > s.page_limit) & ~page_ok,
        "page_minimum_errors": counted & (pages < s.page_minimum) & ~page_ok,
        "missing_pdfs": ~files.file_exists("pdf"),
        "missing_extraction": ~title | ~people,
        "title_author_pending": review == "pending",
        "title_author_red_flag": review == "red_flag",
        "title_author_review_ok": review == "review_ok",
        "unverified_extraction": title & people & (review != "review_ok"),
        "title_author_attention": ~title | ~people | (review != "review_ok"),
        "over_name_limit": (F.col("x_count") > s.record_name_limit)
        & ~exceptions.waiver_valid("author_number"),
        "duplicate_name_records": rules.unresolved_repeats(),
        "missing_scores": rules.missing_score(),
        "similarity_over": plag.isin(*open_states),
        "single_over": single.isin(*open_states),
        "score_issue_records": plag.isin(*open_states) | single.isin(*open_states),
        "allowed_score_records": (plag == "allowed") | (single == "allowed"),
        "stale_score_exceptions": (plag == "stale") | (single == "stale"),
        "format_pending": F.col("format_status") == "pending",
        "format_needs_edit": F.col("format_status") == "needs_edit",
        "to_process": (F.col("m_decision") == scope.PUBLISHING) & files.needs_processing(),
        "_plag_allowed": plag == "allowed",
        "_single_allowed": single == "allowed",
    }


def dashboard_counts(m: DataFrame, v: DataFrame, waivers: DataFrame, s: Settings,
                     counts: DataFrame | None = None) -> DataFrame:
    """One row of all counters: five scans, each one aggregate."""
    titled = m.select("record_id", F.col("decision").alias("m_decision"), F.col("title").alias("m_title"))
    publishable = scope.active_versions(v).join(titled, "record_id", "left").filter(scope.is_publishable())
    counts = names.name_counts(scope.in_scope(v, m), waivers, s) if counts is None else counts
    per_version = aggregates.filter_counts(with_measures(publishable), version_tests(s))
    per_version = per_version.withColumns(
        {
            "allowed_score_approvals": F.col("_plag_allowed") + F.col("_single_allowed"),
            "format_not_ok": F.col("format_pending") + F.col("format_needs_edit"),
        }
    ).drop("_plag_allowed", "_single_allowed")
    per_group = aggregates.filter_counts(
        versions.record_groups(v, m),
        {
            "total_records": F.col("decision").isNotNull(),
            "scope_records": F.col("decision") == scope.PUBLISHING,
            "excluded_records": F.col("decision") == scope.EXCLUDED,
            "undecided_records": F.col("decision") == scope.UNDECIDED,
            "integrity_conflicts": versions.n_mismatched() > 0,
            "origin_conflicts": versions.is_origin_conflict(),
            "missing_versions": (F.col("decision") == scope.PUBLISHING) & (F.col("n_active") == 0),
        },
    )
    all_versions = aggregates.filter_counts(
        v, {"total_versions": F.lit(True), "replaced_versions": F.col("replaced") & ~F.col("discarded")}
    )
    per_name = aggregates.filter_counts(
        counts, {"names_over_limit": F.col("over_limit") & ~F.col("waiver_valid")}
    )
    return aggregates.side_by_side(per_group, per_version, all_versions, per_name)


def workflow_alerts(m: DataFrame, v: DataFrame) -> DataFrame:
    """The two header counters: files to process and origin conflicts."""
    conflicts = versions.origin_conflicts(v, m).agg(F.count(F.lit(1)).alias("origin_conflicts"))
    waiting = scope.in_scope(v, m).agg(F.count_if(files.needs_processing()).alias("to_process"))
    return aggregates.side_by_side(waiting, conflicts)


def dashboard(m, v, waivers, s: Settings) -> dict[str, DataFrame]:
    """Counts, workflow groups, top categories and the ready flag, sharing their inputs."""
    scoped = scope.in_scope(v, m)
    counts = names.name_counts(scoped, waivers, s)
    found = rules.readiness_findings(m, v, waivers, s, counts=counts)
    return {
        "counts": dashboard_counts(m, v, waivers, s, counts),
        "groups": aggregates.action_groups(found, names.name_records(scoped)),
        "top": aggregates.top_categories(found),
        "ready": rules.readiness(found, m),
    }
