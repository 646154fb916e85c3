"""Categories, severities, workflow groups, labels and log actions.

They are the vocabulary of the results, so they are written out plainly. Tables are
exposed as small local relations, whose size Spark knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# group -> (level, categories)
GROUPS = {
    "Paper ID / Mapping": ("danger", (
        "Invalid Paper ID",
        "Unclassified Final Not In Master",
        "Unverified Paper ID",
        "Final Title / Paper Master Title Mismatch",
        "Missing Final Submission",
        "Publication Decision Required",
        "Publication Decision Integrity Conflict",
        "Replaced Final Submission",
        "Multiple Active Final Submissions",
        "Mixed Not Publishing Decision",
        "Start2/Editor Version Conflict",
    )),
    "Files / PDF Processing": ("warning", (
        "Missing PDF",
        "Missing Corrected PDF",
        "Corrected PDF Not Processed",
        "Missing Source File",
        "Missing Corrected Source",
        "Source Review Hash Missing",
        "Source Changed After Review",
        "PDF Not Processed",
        "Page Limit Exceeded",
        "Below Page Minimum",
        "PDF Processing Error",
        "Allowed Page Exception",
    )),
    "Title / Author": ("warning", (
        "Missing Extracted Title",
        "Missing Extracted Authors",
        "Title/Author Red Flag",
        "Unverified Title/Author Extraction",
        "Manual Title/Author Override",
        "Duplicate Author In Paper",
        "Author Over Limit",
        "Allowed Author Number Exception",
        "Allowed Author Paper Count Exception",
    )),
    "Formatting": ("warning", ("Formatting Not Review OK",)),
    "Plagiarism": ("warning", (
        "Missing Plagiarism Result",
        "Stale Plagiarism Report",
        "Plagiarism % Over Threshold",
        "Single % Over Threshold",
        "Stale Plagiarism % Exception",
        "Stale Single % Exception",
        "Allowed Plagiarism % Exception",
        "Allowed Single % Exception",
    )),
    "Publication Duplicates": ("danger", (
        "Duplicate Publication Title",
        "Duplicate Publication PDF",
        "Duplicate Publication Source",
        "Duplicate Publication Filename",
    )),
    "Version Tracking": ("info", (
        "Discarded Final Submission",
        "Not Publishing Final Submission",
        "Not Publishing Paper",
    )),
    "Other": ("secondary", ()),
}
# severity -> (label, level); the order is the rank
SEVERITIES = {
    "critical": ("Critical", "danger"),
    "medium": ("Medium", "warning"),
    "info": ("Info", "info"),
}
MEDIUM = (
    "Final Title / Paper Master Title Mismatch",
    "Missing Extracted Title",
    "Missing Extracted Authors",
    "Title/Author Red Flag",
    "Unverified Title/Author Extraction",
    "Formatting Not Review OK",
    "Missing Plagiarism Result",
    "Stale Plagiarism Report",  # not listed anywhere, so it takes the default
)
INFO = (
    "Manual Title/Author Override",
    "Allowed Plagiarism % Exception",
    "Allowed Single % Exception",
    "Replaced Final Submission",
    "Discarded Final Submission",
    "Not Publishing Final Submission",
    "Not Publishing Paper",
    "Allowed Page Exception",
    "Allowed Author Number Exception",
    "Allowed Author Paper Count Exception",
)
# categories offered by the report filter even when nothing was found
UNLISTED = ("Stale Plagiarism Report",)
AREAS = {
    "mapping": tuple(c for c in GROUPS["Paper ID / Mapping"][1] if c != "Replaced Final Submission"),
    "files": GROUPS["Files / PDF Processing"][1],
    "authors": (
        "Duplicate Author In Paper",
        "Author Over Limit",
        "Allowed Author Number Exception",
        "Allowed Author Paper Count Exception",
    ),
}
DRAFT_UNSAFE = (
    "Multiple Active Final Submissions",
    "Mixed Not Publishing Decision",
    "Publication Decision Required",
    "Publication Decision Integrity Conflict",
    "Duplicate Publication Filename",
)
# workflow key -> (title, ((breakdown singular, plural, categories), ...))
WORKFLOWS = {
    "mapping": ("Paper mapping and version decisions", (
        ("missing final", "missing finals", ("Missing Final Submission",)),
        ("publication decision", "publication decisions", (
            "Unclassified Final Not In Master",
            "Publication Decision Required",
            "Publication Decision Integrity Conflict",
            "Mixed Not Publishing Decision",
        )),
        ("Paper ID review", "Paper ID reviews", (
            "Invalid Paper ID",
            "Unverified Paper ID",
            "Final Title / Paper Master Title Mismatch",
        )),
        ("version conflict", "version conflicts", (
            "Multiple Active Final Submissions",
            "Start2/Editor Version Conflict",
        )),
    )),
    "files": ("PDF, source, and page checks", (
        ("paper with a missing file", "papers with missing files", (
            "Missing PDF",
            "Missing Corrected PDF",
            "Missing Source File",
            "Missing Corrected Source",
        )),
        ("paper needing PDF processing", "papers needing PDF processing", (
            "PDF Not Processed",
            "Corrected PDF Not Processed",
            "PDF Processing Error",
        )),
        ("source review integrity issue", "source review integrity issues", (
            "Source Review Hash Missing",
            "Source Changed After Review",
        )),
        ("paper with a page issue", "papers with page issues", (
            "Page Limit Exceeded",
            "Below Page Minimum",
        )),
    )),
    "title_authors": ("Title and author review", (
        ("paper missing extraction", "papers missing extraction", (
            "Missing Extracted Title",
            "Missing Extracted Authors",
        )),
        ("pending metadata review", "pending metadata reviews", ("Unverified Title/Author Extraction",)),
        ("Red Flag", "Red Flags", ("Title/Author Red Flag",)),
    )),
    "formatting": ("Formatting review", (
        ("", "", ("Formatting Not Review OK",)),
    )),
    "plagiarism": ("Plagiarism results", (
        ("paper missing P/S results", "papers missing P/S results", ("Missing Plagiarism Result",)),
        ("paper over a threshold", "papers over a threshold", (
            "Plagiarism % Over Threshold",
            "Single % Over Threshold",
        )),
        ("stale report", "stale reports", ("Stale Plagiarism Report",)),
        ("stale exception", "stale exceptions", (
            "Stale Plagiarism % Exception",
            "Stale Single % Exception",
        )),
    )),
    "authors": ("Author limits and duplicates", (
        ("paper affected by an author limit", "papers affected by author limits", ("Author Over Limit",)),
        ("duplicate-author review", "duplicate-author reviews", ("Duplicate Author In Paper",)),
    )),
    "duplicates": ("Publication duplicates", (
        ("paper with a duplicate title", "papers with duplicate titles", ("Duplicate Publication Title",)),
        ("paper with duplicate file content", "papers with duplicate file content", (
            "Duplicate Publication PDF",
            "Duplicate Publication Source",
        )),
        ("paper with a filename collision", "papers with filename collisions", (
            "Duplicate Publication Filename",
        )),
    )),
}
LABELS = {
    "version": {
        "current_final": "Current final",
        "replaced": "Replaced",
        "discarded": "Discarded",
        "other_inactive": "Other inactive",
        "conflict": "Version conflict",
    },
    "origin": {"start2": "Start2", "editor_upload": "Editor Upload"},
    "identity": {
        "verified": "Verified",
        "auto_verified": "Auto-verified by title",
        "verified_title_differs": "Verified, title differs",
        "needs_review": "Paper ID needs review",
        "title_mismatch": "Paper ID title mismatch",
        "not_in_master": "Paper ID not in Master List",
    },
    "decision": {
        "publishing": "Publishing",
        "not_publishing": "Not Publishing",
        "decision_required": "Decision required",
        "integrity_conflict": "Integrity conflict",
        "excluded": "Excluded from publication",
    },
    "review": {
        "pending": "Pending",
        "red_flag": "Red Flag",
        "review_ok": "Review OK",
        "needs_edit": "Needs edit",
    },
    "processing": {
        "needs_processing": "Needs processing",
        "processed": "Processed",
        "error": "PDF error",
    },
    "exception": {
        "not_allowed": "Not allowed",
        "allowed": "Allowed exception",
        "stale": "Stale allowed exception",
    },
    "file": {
        "original": "Original",
        "corrected": "Corrected",
        "no_pdf": "No PDF",
        "no_source": "No source",
    },
    "exclusion_reason": {
        "": "Not excluded",
        "unpaid": "Unpaid",
        "withdrawn": "Withdrawn",
        "not_in_master": "Not in Master List",
        "other": "Other",
    },
}
ACTION_CATEGORIES = {
    "paper_data": "Paper Data & Imports",
    "submissions": "Submissions & Versions",
    "reviews": "Editorial Review",
    "formatting": "Formatting",
    "processing": "PDF Processing",
    "plagiarism": "CrossCheck & Plagiarism",
    "exceptions": "Exceptions",
    "exports": "Reports & Exports",
    "administration": "Settings & Storage",
    "system_state": "System & Backup",
    "other": "Other",
}
# code, label, category, former codes
ACTIONS = (
    ("paper_master_save", "Save Paper Master", "paper_data", ()),
    ("paper_master_edit_preview", "Preview Paper Master Edit", "paper_data", ()),
    ("paper_master_edit_cancel", "Cancel Paper Master Edit", "paper_data", ()),
    ("paper_master_delete", "Delete Paper Master", "paper_data", ()),
    ("paper_master_import_preview", "Preview Paper Master Import", "paper_data", ("initial_import_preview",)),
    ("paper_master_import_apply", "Apply Paper Master Import", "paper_data", ("initial_import_apply",)),
    ("final_submission_import_preview", "Preview Final Submission Import", "paper_data", ("final_import_preview",)),
    ("final_submission_import_apply", "Apply Final Submission Import", "paper_data", ("final_import_apply",)),
    ("import_apply", "Apply Import", "paper_data", ()),
    ("import_preview", "Preview Import", "paper_data", ()),
    ("final_submission_create", "Create Final Submission", "submissions", ("final_submission_manual_create",)),
    ("final_submission_edit", "Edit Final Submission", "submissions", ("final_submission_manual_edit",)),
    ("final_submission_edit_preview", "Preview Final Submission Edit", "submissions", ()),
    ("final_submission_edit_cancel", "Cancel Final Submission Edit", "submissions", ()),
    ("final_submission_delete", "Delete Final Submission", "submissions", ("final_submission_delete_blocked",)),
    ("final_submission_version_action", "Final Submission Version Action", "submissions",
     ("final_submission_list_action", "final_submission_discard_action")),
    ("final_submission_discard", "Discard Final Submission", "submissions", ("discard_submission",)),
    ("final_submission_discard_undo", "Undo Final Submission Discard", "submissions", ("undo_discard_submission",)),
    ("editor_upload_preview", "Preview Editor Upload", "submissions", ()),
    ("editor_upload_apply", "Apply Editor Upload", "submissions", ("editor_upload_confirm", "editor_upload_create")),
    ("editor_upload_cancel", "Cancel Editor Upload", "submissions",
     ("editor_upload_preview_cancel", "editor_upload_preview_canceled")),
    ("publication_exclusion_apply", "Mark Not Publishing", "submissions", ("mark_not_publishing",)),
    ("publication_exclusion_undo", "Undo Not Publishing", "submissions", ("undo_not_publishing",)),
    ("paper_id_verify", "Verify Paper ID", "reviews", ("verify_paper_id",)),
    ("paper_id_unverify", "Move Paper ID Back to Review", "reviews", ("unverify_paper_id",)),
    ("title_author_extract_builtin", "Extract Title/Authors with Built-in Extractor", "reviews",
     ("title_author_extract",)),
    ("title_author_extract_builtin_batch", "Extract Title/Authors Needing Review", "reviews",
     ("title_author_extract_needs_review",)),
    ("title_author_extract_builtin_all", "Re-extract All Title/Authors", "reviews", ("title_author_reextract_all",)),
    ("title_author_extract_grobid", "Extract Title/Authors with GROBID", "reviews",
     ("grobid_title_author_extract",)),
    ("title_author_extract_grobid_batch", "Extract Suspicious Title/Authors with GROBID", "reviews",
     ("grobid_title_author_extract_batch",)),
    ("title_author_manual_override", "Override Extracted Title/Authors", "reviews", ()),
    ("title_author_review_update", "Update Title/Author Review", "reviews", ("title_author_review_status",)),
    ("title_match_verify", "Verify Extracted Title Match", "reviews", ("verify_extracted_title_match",)),
    ("title_match_unverify", "Move Extracted Title Match Back to Review", "reviews",
     ("unverify_extracted_title_match",)),
    ("duplicate_author_review", "Review Duplicate Author", "reviews", ()),
    ("duplicate_author_review_reset", "Reset Duplicate Author Review", "reviews", ()),
    ("formatting_review_update", "Update Formatting Review", "formatting", ("formatting_update",)),
    ("formatting_upload_apply", "Apply Formatting Upload", "formatting", ("formatting_upload_confirm",)),
    ("formatting_upload_preview", "Preview Formatting Upload", "formatting", ()),
    ("formatting_upload_cancel", "Cancel Formatting Upload", "formatting", ("formatting_upload_preview_canceled",)),
    ("formatting_issue_record", "Record Formatting Issue", "formatting",
     ("formatting_issue_recorded_from_pdf_preview",)),
    ("pdf_process", "Process Publication PDFs", "processing", ("process_pdfs",)),
    ("publication_pdf_debug_sync", "Sync Publication PDF Debug Copies", "processing",
     ("sync_publication_pdf_debug",)),
    ("crosscheck_pdf_export", "Export CrossCheck PDFs", "plagiarism", ("crosscheck_export",)),
    ("crosscheck_result_import", "Import CrossCheck Results", "plagiarism", ()),
    ("crosscheck_report_upload", "Upload CrossCheck Reports", "plagiarism", ()),
    ("external_results_import", "Import External Results", "plagiarism", ()),
    ("exception_allow", "Allow Exception", "exceptions", ()),
    ("exception_remove", "Remove Exception", "exceptions", ()),
    ("report_active_versions_export", "Export Active Versions", "exports", ("export_active_versions",)),
    ("report_author_count_export", "Export Author Count", "exports", ("export_author_count",)),
    ("report_editorial_workbook_export", "Export Editorial Publication Workbook", "exports",
     ("export_editorial_review_workbook",)),
    ("report_error_export", "Export Readiness Issues", "exports", ("export_error_report",)),
    ("report_old_versions_export", "Export Old Versions", "exports", ("export_old_versions",)),
    ("publication_package_export", "Export Publication Package", "exports", ()),
    ("settings_update", "Update Settings", "administration", ("settings_save",)),
    ("settings_folder_reset", "Reset Settings Folders", "administration", ("settings_reset_folders",)),
    ("settings_active_version_rule_preview", "Preview Active Version Rule Change", "administration", ()),
    ("settings_active_version_rule_apply", "Apply Active Version Rule Change", "administration", ()),
    ("settings_active_version_rule_cancel", "Cancel Active Version Rule Change", "administration", ()),
    ("storage_cleanup_preview", "Preview Storage Cleanup", "administration", ()),
    ("storage_cleanup_apply", "Apply Storage Cleanup", "administration", ()),
    ("database_clear_request", "Request Clear Database", "administration", ("clear_database_requested",)),
    ("database_clear_apply", "Apply Clear Database", "administration", ("clear_database_apply",)),
    ("database_clear_complete", "Complete Clear Database", "administration", ("clear_database_applied",)),
    ("audit_log_archive_clear", "Archive and Clear Audit Log", "administration",
     ("audit_log_archived_and_cleared",)),
    ("system_state_export_request", "Request System State Export", "system_state",
     ("system_state_export_requested",)),
    ("system_state_export", "Export System State", "system_state", ()),
    ("system_state_restore_preview", "Preview System State Restore", "system_state", ()),
    ("system_state_restore_apply", "Apply System State Restore", "system_state", ()),
    ("system_state_restore_cleanup", "Clean Up System State Restore", "system_state",
     ("system_state_restore_cleanup_warning",)),
)
ENUMS = {
    "decision": ("publishing", "not_publishing", "decision_required"),
    "origin": ("start2", "editor_upload"),
    "review_status": ("pending", "red_flag", "review_ok"),
    "duplicate_review_status": ("pending", "review_ok"),
    "processing_status": ("pending", "processed", "error"),
    "format_status": ("pending", "needs_edit", "review_ok"),
    "extraction_status": ("pending", "extracted", "error"),
    "verification_status": ("pending", "verified", "title_mismatch", "invalid_paper_id"),
    "title_match_status": ("pending", "verified", "title_mismatch", "missing"),
    "exclusion_reason": ("", "unpaid", "withdrawn", "not_in_master", "other"),
    "title_author_source": (
        "unknown", "built_in_extractor", "grobid", "manual_override", "manual",
        "external_import", "external_script",
    ),
}
MASTER_REASONS = ("unpaid", "withdrawn", "other")


def severity_of(category: str) -> str:
    return "medium" if category in MEDIUM else "info" if category in INFO else "critical"


def group_of(category: str) -> str:
    for group, (_level, categories) in GROUPS.items():
        if category in categories:
            return group
    return "Other"


def all_categories() -> list[str]:
    return [c for _level, categories in GROUPS.values() for c in categories]


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def local_table(spark: SparkSession, columns, rows) -> DataFrame:
    """A constant table whose size is known when the plan is made."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def category_table(spark: SparkSession) -> DataFrame:
    groups, severities = list(GROUPS), list(SEVERITIES)
    rows = []
    for category in all_categories():
        group, severity = group_of(category), severity_of(category)
        rows.append((
            category, group, groups.index(group), GROUPS[group][0],
            severity, severities.index(severity), *SEVERITIES[severity],
        ))
    return local_table(
        spark,
        ("category", "group", "group_rank", "level", "severity", "severity_rank", "severity_label",
         "severity_level"),
        rows,
    )


def action_table(spark: SparkSession) -> DataFrame:
    """raw_action (code or former code) -> action, label, category."""
    rows = [
        (raw, code, label, category, ACTION_CATEGORIES[category])
        for code, label, category, former in ACTIONS
        for raw in (code, *former)
    ]
    return local_table(
        spark, ("raw_action", "action", "action_label", "category", "category_label"), rows
    )


def workflow_table(spark: SparkSession) -> DataFrame:
    rows = [
        (rank, key, title, order, one, many, category)
        for rank, (key, (title, parts)) in enumerate(WORKFLOWS.items())
        for order, (one, many, categories) in enumerate(parts)
        for category in categories
    ]
    return local_table(
        spark,
        ("workflow_rank", "workflow", "title", "part_rank", "singular", "plural", "category"),
        rows,
    )


def label(group: str, value: Column) -> Column:
    """Code -> label; an unknown code stays as it is."""
    out = F.when(F.lit(False), "")
    for code, shown in LABELS[group].items():
        out = out.when(value == code, shown)
    return out.otherwise(value)
