"""The registered queries: each operator over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from greenlight import domain
from greenlight.operators import (
    aggregates,
    duplicates,
    exceptions,
    files,
    names,
    resolve,
    rules,
    scope,
    status,
    versions,
    worklists,
)
from greenlight.operators.measures import with_measures
from greenlight.plans import combined, dashboard

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Callable[[domain.Snapshot], DataFrame]) -> Callable:
    """Register a function of the snapshot under its own name."""
    REGISTRY[fn.__name__] = lambda spark, sf_dir: fn(domain.load(spark, sf_dir))
    return fn


def stamp(column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


# -- versions and scope -------------------------------------------------------


@query
def select_active(d):
    return versions.select_active(d.claims).select("version_id", "record_id", "active")


@query
def select_active_by_date(d):
    return versions.active_map(d.claims, "upload_date")


@query
def mark_replaced(d):
    return versions.mark_replaced(d.claims).select("version_id", "record_id", "origin")


@query
def rule_change_preview(d):
    return versions.preview_rule_change(d.claims, "final_id", "upload_date")


@query
def missing_versions(d):
    return scope.missing_versions(d.master, d.versions).select("record_id", "title", "notes")


@query
def orphan_versions(d):
    return scope.orphans(d.versions, d.master).select("version_id", "record_id", "entered_id")


@query
def in_scope(d):
    return d.scoped.select("version_id", "record_id", "title", "pages")


@query
def publishable(d):
    return d.publishable.select("version_id", "record_id", "m_decision")


@query
def master_with_active(d):
    return scope.master_with_active(d.master, d.versions).select(
        "record_id", "m_title", "m_accept_status", "version_id", "title", "pages"
    )


@query
def scope_counts(d):
    return scope.scope_counts(d.master)


@query
def decision_worklists(d):
    return scope.decision_worklists(d.master, d.versions)


@query
def multiple_active(d):
    return versions.multiple_active(d.versions, d.master)


@query
def multiple_active_members(d):
    groups = versions.multiple_active(d.versions, d.master)
    return versions.group_members(scope.active_versions(d.versions), groups)


@query
def origin_conflicts(d):
    return versions.origin_conflicts(d.versions, d.master)


@query
def mixed_decisions(d):
    return versions.mixed_decisions(d.versions, d.master)


@query
def mixed_decision_members(d):
    groups = versions.mixed_decisions(d.versions, d.master)
    return versions.group_members(d.versions, groups, {"excluded": F.col("excluded")})


@query
def decision_integrity(d):
    return versions.decision_integrity(d.versions, d.master)


@query
def decision_backfill(d):
    out = versions.decision_backfill(d.master, d.versions)
    return out.withColumn("excluded_at", stamp("excluded_at"))


@query
def versions_per_record(d):
    return versions.versions_per_record(d.versions)


@query
def latest_by_update(d):
    return versions.latest_by_update(d.versions)


@query
def old_versions(d):
    return versions.classify_old(d.versions).select(
        "version_id", "record_id", "old_status", "inactive_reason", "origin_label", "replacement_id", "note_summary"
    )


# -- names and duplicates -----------------------------------------------------


@query
def name_counts(d):
    return names.name_counts(d.scoped, d.waivers, d.settings).select(
        "norm", "display_name", "n_records", "n_repeat_records", "first_record_id", "over_limit", "waiver_valid", "status"
    )


@query
def name_records(d):
    return names.name_records(d.scoped)


@query
def duplicate_names(d):
    return names.duplicate_names(d.versions)


@query
def duplicate_groups(d):
    return duplicates.duplicate_groups(duplicates.member_keys(d.scoped, d.settings)).drop("base_name")


@query
def duplicate_members(d):
    members = duplicates.member_keys(d.scoped, d.settings)
    return duplicates.duplicate_members(members).select("kind", "key", "version_id", "record_id", "n_others")


@query
def filename_collisions(d):
    members = duplicates.member_keys(d.scoped, d.settings).filter("kind = 'filename'")
    return duplicates.duplicate_groups(members).select("key", "n_members")


@query
def duplicate_detail(d):
    """Partners of the first member of every duplicate group."""
    members = duplicates.member_keys(d.scoped, d.settings)
    requests = duplicates.duplicate_groups(members).select(
        "kind", "key", F.col("first_version_id").alias("version_id")
    )
    return duplicates.duplicate_detail(members, requests)


# -- rules --------------------------------------------------------------------


@query
def findings(d):
    return rules.error_findings(d.master, d.versions, d.waivers, d.settings).select(
        *rules.FINDING, F.col("group").alias("finding_group"), "level", "severity"
    )


@query
def exception_rows(d):
    counts = names.name_counts(d.scoped, d.waivers, d.settings)
    return exceptions.exception_rows(d.publishable, counts, d.settings)


@query
def batch_gate(d):
    return rules.batch_gate(d.master, d.versions)


def _found(d, include_allowed=False):
    return rules.readiness_findings(d.master, d.versions, d.waivers, d.settings, include_allowed)


@query
def severity_sections(d):
    return aggregates.severity_sections(rules.annotate(_found(d, True)))


@query
def category_options(d):
    found = _found(d, True)
    scoped = found.filter(aggregates.area_filter("files"))
    return aggregates.category_options(scoped, scoped, ["Missing PDF", "Page Limit Exceeded"])


@query
def action_groups(d):
    return aggregates.action_groups(_found(d), names.name_records(d.scoped))


@query
def affected_records(d):
    return aggregates.affected_records(_found(d), names.name_records(d.scoped))


@query
def top_categories(d):
    return aggregates.top_categories(_found(d))


@query
def readiness(d):
    return rules.readiness(_found(d), d.master)


@query
def export_gate(d):
    strict = rules.export_gate(_found(d)).withColumn("mode", F.lit("strict"))
    return strict.unionByName(rules.export_gate(_found(d), draft=True).withColumn("mode", F.lit("draft")))


@query
def exception_counts(d):
    counts = names.name_counts(d.scoped, d.waivers, d.settings)
    rows = exceptions.exception_rows(d.publishable, counts, d.settings)
    return exceptions.exception_counts(rows).withColumnRenamed("all", "n_all")


@query
def exception_actions(d):
    """One action per exception: approve, reapprove or remove by its kind, reasons from the rows."""
    counts = names.name_counts(d.scoped, d.waivers, d.settings)
    rows = exceptions.exception_rows(d.publishable, counts, d.settings)
    kind = F.col("type")
    actions = rows.select(
        "exception_key",
        F.when(kind == "page", "approve").when(kind == "single_percent", "remove").otherwise("reapprove").alias("action"),
        F.when(F.col("current_value") > 14, " checked\r\n").otherwise("").alias("reason"),
    )
    return exceptions.exception_actions(rows, actions)


@query
def dashboard_counts(d):
    return dashboard.dashboard_counts(d.master, d.versions, d.waivers, d.settings)


@query
def workflow_alerts(d):
    return dashboard.workflow_alerts(d.master, d.versions)


def _combined(d, name="all", text=""):
    return combined.combined_list(d.master, d.versions, d.settings, name, text)


@query
def combined_list(d):
    rows = _combined(d)
    shown = ["page", "identity", "score", "source", "extraction", "names"]
    return rows.select(
        "row_type", "record_id", "version_id", "blocker", "priority", "comparison", "n_names", "similarity_level",
        *[F.col(f"{c}.label").alias(f"{c}_label") for c in shown],
        *[F.col(f"{c}.level").alias(f"{c}_level") for c in shown],
    )


@query
def combined_filters(d):
    """Rows per worklist filter, all in one pass."""
    rows = _combined(d)
    tests = {f"n_{k}": F.lit(True) if k == "all" else F.col(f"is_{k}") for k in status.FILTERS}
    return aggregates.filter_counts(rows, tests)


@query
def combined_summary(d):
    return combined.combined_summary(_combined(d, "needs_attention"))


@query
def combined_search(d):
    return _combined(d, "title_issues", "dated 1998-0").select("row_type", "record_id", "version_id", "priority")


@query
def verification_badges(d):
    joined = with_measures(scope.attach_master(scope.active_versions(d.versions), d.master))
    badge = status.verification_badge()
    return joined.select("version_id", badge["label"].alias("label"), badge["level"].alias("level"))


# -- resolution and evaluation ------------------------------------------------


@query
def resolve_identifier(d):
    return resolve.resolve_identifier(d.claims, d.master)


@query
def resolve_on_reimport(d):
    """Every version typed again: even line numbers keep their text, the others add a dash."""
    typed = F.when(F.substring("version_id", 2, 1).cast("int") % 2 == 0, F.col("entered_id")).otherwise(
        F.concat(F.lit("P-"), F.regexp_replace("entered_id", "^[Pp]?-?0*", ""))
    )
    new = d.claims.select("version_id", typed.alias("entered_id"), "title")
    return resolve.resolve_on_reimport(new, d.claims, d.master)


@query
def identity_status(d):
    return resolve.evaluate_identity(d.versions, d.master, "levenshtein")


@query
def identity_status_sequence(d):
    return resolve.evaluate_identity(d.versions, d.master).select("version_id", "status", "score", "message")


@query
def extracted_title_status(d):
    return resolve.evaluate_extracted_title(d.versions, "levenshtein")


def _title_refs(d):
    joined = d.scoped.join(
        d.master.select("record_id", F.col("title").alias("m_title")), "record_id"
    )
    return joined.select(
        "version_id",
        F.inline(F.array(
            F.struct(F.lit(1).alias("position"), F.lit("Master").alias("label"), F.col("m_title").alias("title")),
            F.struct(F.lit(2).alias("position"), F.lit("Final").alias("label"), F.col("title").alias("title")),
        )),
    )


@query
def title_guard(d):
    return resolve.title_guard(_title_refs(d), d.scoped)


@query
def title_guard_summary(d):
    return resolve.title_guard_summary(resolve.title_guard(_title_refs(d), d.scoped))


@query
def best_title_match(d):
    """Nearest labelled document for every unlabelled one, by first line."""
    docs = domain.table(d.spark, d.sf_dir, "documents")
    labels = domain.table(d.spark, d.sf_dir, "labels")
    title = F.substring_index("text", "\n", 1)
    official = docs.join(labels, "doc_id", "left_semi").select(
        F.col("doc_id").cast("string").alias("record_id"), title.alias("title")
    )
    others = docs.join(labels, "doc_id", "left_anti").select(
        F.col("doc_id").cast("string").alias("version_id"), title.alias("title")
    )
    return resolve.best_title_match(others, official, threshold=0.95)


@query
def ranked_lookup(d):
    return resolve.ranked_lookup(d.master, "P12")


# -- worklists ----------------------------------------------------------------


@query
def extraction_filter_counts(d):
    rows = resolve.evaluate_extracted_title(d.scoped, "levenshtein").drop("title_verified")
    joined = d.scoped.drop("record_id", "verification_status").join(rows, "version_id")
    return aggregates.filter_counts(joined, {f"n_{k}": t for k, t in worklists.extraction_filters().items()})


@query
def extraction_overwrite_summary(d):
    return worklists.extraction_overwrite_summary(d.scoped)


@query
def formatting_filter_counts(d):
    return aggregates.filter_counts(d.scoped, {f"n_{k}": t for k, t in worklists.formatting_filters().items()})


@query
def identity_filter_counts(d):
    rows = resolve.evaluate_identity(d.publishable, d.master, "levenshtein")
    return aggregates.filter_counts(rows, {f"n_{k}": t for k, t in worklists.identity_filters().items()})


@query
def processing_filter_counts(d):
    s = d.settings
    outside = (F.col("pages") < s.page_minimum) | (F.col("pages") > s.page_limit)
    tests = worklists.processing_filters(files.persisted_needs_processing(), outside)
    return aggregates.filter_counts(d.scoped, {f"n_{k}": t for k, t in tests.items()})


@query
def version_filter_counts(d):
    groups = versions.record_groups(d.versions, d.master).select(
        "record_id", versions.is_origin_conflict().alias("origin_conflict")
    )
    rows = d.versions.join(groups, "record_id", "left")
    return aggregates.filter_counts(rows, {f"n_{k}": t for k, t in worklists.version_list_filters().items()})


@query
def name_filter_counts(d):
    rows = names.name_counts(d.scoped, d.waivers, d.settings)
    tests = ("all", "attention", "over_limit", "duplicates", "allowed")
    return aggregates.filter_counts(rows, {f"n_{k}": names.name_filter(k) for k in tests})


@query
def old_version_counts(d):
    rows = versions.classify_old(d.versions)
    tests = ("all", "replaced", "discarded", "editor_uploads", "start2", "other")
    return aggregates.filter_counts(rows, {f"n_{k}": versions.old_filter(k) for k in tests})


@query
def combined_page_2(d):
    rows = _combined(d)
    order = [*status.combined_order("needs_attention"), F.col("version_id").asc()]
    return worklists.page(rows.select("priority", "record_id", "version_id", "blocker"), order, 2)


@query
def natural_sort_page(d):
    order = worklists.version_order("paper_id_desc") + [F.col("version_id").asc()]
    return worklists.page(d.versions, order, 3, 50, key="version_id").select("version_id", "record_id", "title")


@query
def name_page(d):
    rows = names.name_counts(d.scoped, d.waivers, d.settings)
    return worklists.page(rows.select("norm", "n_records", "n_repeat_records", "over_limit", "waiver_valid"),
                          names.name_order("attention"), 2)


@query
def queue_neighbours(d):
    return worklists.queue_neighbours(
        d.scoped, "version_id", worklists.formatting_order(), F.col("format_status") != "review_ok"
    )
