"""The append-only log: actions, filters, change summaries and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenlight import catalog
from greenlight.functions.text import display_value, strip, title_case_code

# Labels of log fields that are not just their title-cased name
FIELD_LABELS = {
    "paper_id": "Paper ID",
    "record_id": "Official Paper ID",
    "entered_id": "Author-entered ID",
    "version_id": "Final ID",
    "title": "Master Title",
    "authors": "Master Authors",
    "accept_status": "Accept Status",
    "notes": "Notes",
    "upload_date": "Upload Date",
    "pdf_file": "Original PDF",
    "source_file": "Original Source",
    "report_file": "Plagiarism Report",
    "similarity": "Plagiarism %",
    "single": "Single %",
    "identity_recalculated": "Paper ID review recalculated",
    "pdf_reset": "PDF-dependent checks reset",
    "source_reset": "Source-dependent checks reset",
    "plagiarism_stale": "Plagiarism report marked old",
    "active_versions_recalculated": "Active versions recalculated",
    "corrected_files_archived": "Corrected files archived and unlinked",
    "extracted_metadata_reset": "Title/Author review reset",
    "review_status_guarded": "Invalid review status corrected",
    "not_publishing_changed": "Publication decision changed",
}


def field_label(field: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, shown in FIELD_LABELS.items():
        out = out.when(field == name, shown)
    return out.otherwise(title_case_code(field))


def with_action_metadata(events: DataFrame) -> DataFrame:
    """Canonical action, label and category; an unknown action is title-cased in 'other'."""
    table = F.broadcast(catalog.action_table(events.sparkSession)).withColumnRenamed("action", "code")  # about 130 rows
    raw = events.withColumn("raw_action", strip("action"))
    joined = raw.join(table, "raw_action", "left")
    shown = title_case_code(F.col("raw_action"))
    return joined.withColumns(
        {
            "registered": F.col("code").isNotNull(),
            "action": F.coalesce("code", "raw_action"),
            "action_label": F.coalesce("action_label", F.when(shown == "", "Unknown Action").otherwise(shown)),
            "category": F.coalesce("category", F.lit("other")),
            "category_label": F.coalesce("category_label", F.lit(catalog.ACTION_CATEGORIES["other"])),
        }
    ).drop("code")


def canonical_code(action: str) -> str:
    for code, _label, _category, former in catalog.ACTIONS:
        if action == code or action in former:
            return code
    return action


def log_filter(events: DataFrame, query: str = "", category: str = "", action: str = "", status: str = "") -> DataFrame:
    """AND of the given filters over ``with_action_metadata``; ``query`` searches raw text and labels."""
    out = events
    if category:
        out = out.filter(F.col("category") == category)
    if action.strip():
        out = out.filter(F.col("action") == canonical_code(action.strip()))
    if status.strip():
        out = out.filter(F.col("status") == status.strip())
    needle = query.strip().lower()
    if needle:
        raw = ["raw"] if "raw" in events.columns else []
        searched = [*raw, "message", "action", "raw_action", "action_label", "category", "category_label"]
        text = F.lower(F.concat_ws(" ", *searched))
        test = text.contains(needle)
        code = canonical_code(needle).lower()
        if code != needle:
            test = test | text.contains(code)
        out = out.filter(test)
    return out


def tail_events(events: DataFrame, n: int = 300) -> DataFrame:
    """The newest n events, newest first: a top-k, never a full sort in one task."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def log_changes(events: DataFrame) -> DataFrame:
    """One row per change: kind user/system/reset, field, label, old and new.

    Works on the maps of one event, so nothing is shuffled.
    """
    fields, before, after = F.col("changed_fields"), F.col("before"), F.col("after")

    def entry(kind: str, field: Column, old: Column, new: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), field.alias("field"), old.alias("old"), new.alias("new"))

    def value(source: Column, key: Column) -> Column:
        return F.try_element_at(source, key)

    user = F.transform(
        F.filter(fields, lambda k: F.map_contains_key(before, k) | F.map_contains_key(after, k)),
        lambda k: entry("user", k, value(before, k), value(after, k)),
    )
    keys = F.array_except(F.array_union(F.map_keys(before), F.map_keys(after)), fields)
    system = F.transform(
        F.filter(keys, lambda k: ~value(before, k).eqNullSafe(value(after, k))),
        lambda k: entry("system", k, value(before, k), value(after, k)),
    )
    nothing = ("false", "", "0")
    reset = F.transform(
        F.filter(F.map_entries("reset_flags"), lambda e: e["value"].isNotNull() & ~e["value"].isin(*nothing)),
        lambda e: entry("reset", e["key"], F.lit(None).cast("string"), e["value"]),
    )
    rows = events.select("event_id", F.inline(F.concat(user, system, reset)))
    return rows.select(
        "event_id", "kind", "field", field_label(F.col("field")).alias("label"),
        F.when(F.col("kind") == "reset", "").otherwise(display_value("old")).alias("old"),
        display_value("new").alias("new"),
    )


def log_facets(spark) -> DataFrame:
    """Categories and actions offered as filters, grouped and ordered by label."""
    rows = [(code, label, category, catalog.ACTION_CATEGORIES[category]) for code, label, category, _ in catalog.ACTIONS]
    return catalog.local_table(spark, ("action", "action_label", "category", "category_label"), rows)


def facet_counts(events: DataFrame) -> DataFrame:
    """Events per (category, action, status) for the filter bar."""
    return with_action_metadata(events).groupBy("category", "category_label", "action", "action_label", "status").agg(
        F.count(F.lit(1)).alias("n")
    )
