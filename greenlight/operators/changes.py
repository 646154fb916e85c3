"""Change detection, reset of dependent state, upsert and optimistic checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenlight.functions.digest import row_digest
from greenlight.functions.scores import equal_ignoring_micros
from greenlight.functions.text import clean_note, filled, strip, text
from greenlight.operators.aggregates import duplicate_keys
from greenlight.operators.resolve import resolve_on_reimport

# -- resets ------------------------------------------------------------------

_TITLE_MATCH = {
    "title_verified": False,
    "title_verify_blocked": True,
    "title_verified_at": None,
    "title_match_status": "pending",
    "title_match_score": None,
}
_REVIEW = {"review_status": "pending", "review_verified_at": None}
_DUPLICATE_REVIEW = {
    "duplicate_review_status": "pending",
    "duplicate_review_notes": "",
    "duplicate_reviewed_at": None,
}
_OVERRIDE = {"override_reason": "", "override_at": None}


def _waiver(prefix: str) -> dict:
    return {f"{prefix}_approved": False, f"{prefix}_reason": "", f"{prefix}_value": None, f"{prefix}_at": None}


# Changed evidence -> the fields that lose their meaning and what they go back to
RESETS = {
    "identity": {
        "id_verified": False,
        "auto_verify_blocked": False,
        "verified_at": None,
        "verification_status": "pending",
        "id_match_score": None,
    },
    "title_match": _TITLE_MATCH,
    "pdf": {
        "pages": None,
        **_waiver("page_waiver"),
        "pdf_hash": "",
        "source_hash": "",
        "thumbnail_folder": "",
        "thumbnail_status": "",
        "processing_status": "pending",
        "extracted_title": "",
        "extracted_authors": "",
        "title_author_source": "unknown",
        "extraction_status": "pending",
        **_OVERRIDE,
        **_REVIEW,
        **_DUPLICATE_REVIEW,
        **_waiver("name_waiver"),
        **_TITLE_MATCH,
        "similarity": None,
        "single": None,
        **_waiver("similarity_waiver"),
        **_waiver("single_waiver"),
        "report_path": "",
        "report_stale": False,
        "format_status": "pending",
    },
    "source": {
        "source_hash": "",
        "format_status": "pending",
        **_OVERRIDE,
        **_REVIEW,
        **_DUPLICATE_REVIEW,
        **_TITLE_MATCH,
    },
    "authors": _REVIEW,
    "authors_manual": {**_REVIEW, **_DUPLICATE_REVIEW, **_waiver("name_waiver")},
    "extraction_manual": {
        "title_author_source": "manual",
        "extraction_status": "extracted",
        **_OVERRIDE,
        **_REVIEW,
        **_DUPLICATE_REVIEW,
        **_TITLE_MATCH,
    },
    "extraction_external": {
        "title_author_source": "external_import",
        "extraction_status": "extracted",
        **_OVERRIDE,
        **_REVIEW,
        **_DUPLICATE_REVIEW,
        "title_verified": False,
        "title_verified_at": None,
        "title_verify_blocked": False,
    },
    "name_waiver": _waiver("name_waiver"),
    "page_waiver": _waiver("page_waiver"),
    "corrected": {"corrected_pdf": "", "corrected_source": ""},
}


def reset_dependents(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Apply resets by flag; fields the frame does not carry are left out."""
    types = dict(df.dtypes)
    columns = {}
    for name, flag in flags.items():
        hit = F.coalesce(flag, F.lit(False))
        for field, default in RESETS[name].items():
            if field in types:
                current = columns.get(field, F.col(field))
                columns[field] = F.when(hit, F.lit(default).cast(types[field])).otherwise(current)
    return df.withColumns(columns)


# -- upsert ------------------------------------------------------------------


def upsert(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``target`` with the given columns replaced, plus the rows that are new.

    Columns absent from ``changes`` keep their value; a given NULL does overwrite.
    """
    given = [c for c in changes.columns if c not in keys]
    renamed = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in given], F.lit(True).alias("_hit"))
    joined = target.join(renamed, keys, "full")
    hit = F.coalesce("_hit", F.lit(False))
    return joined.select(
        *[
            F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c)
            for c in target.columns
        ]
    )


def touched_domains(changed_fields: list[str], domains: dict[str, tuple]) -> list[str]:
    """Projections that a set of changed columns touches."""
    return [name for name, fields in domains.items() if set(fields) & set(changed_fields)]


# The five projections of the wide version row
DOMAINS = {
    "identity": (
        "entered_id", "record_id", "title", "authors", "upload_date", "origin", "active", "replaced",
        "discarded", "discard_notes", "editor_notes", "id_verified", "auto_verify_blocked",
        "verification_status", "verification_message",
    ),
    "file": (
        "pdf_file", "source_file", "corrected_pdf", "corrected_source", "pdf_hash", "source_hash", "pages",
        "thumbnail_folder", "thumbnail_status", "processing_status", "processing_message",
    ),
    "review": (
        "extracted_title", "extracted_authors", "title_author_source", "extraction_status", "review_status",
        "duplicate_review_status", "override_reason", "title_verified", "title_verify_blocked",
        "name_waiver_approved", "name_waiver_reason", "name_waiver_value", "page_waiver_approved",
        "page_waiver_reason", "page_waiver_value", "format_status",
    ),
    "publication": ("excluded", "exclusion_reason", "exclusion_notes", "excluded_at"),
    "plagiarism": (
        "similarity", "single", "similarity_waiver_approved", "similarity_waiver_reason",
        "similarity_waiver_value", "single_waiver_approved", "single_waiver_reason", "single_waiver_value",
        "report_path", "report_stale",
    ),
}


def state_domain(v: DataFrame, domain: str) -> DataFrame:
    return v.select("version_id", *[c for c in DOMAINS[domain] if c in v.columns])


# -- field changes -----------------------------------------------------------


def with_differences(df: DataFrame, fields, open_row: Column) -> DataFrame:
    """Add a boolean ``d_<name>`` per text field: does it differ from its ``old_`` column?

    Flags and counts read these; the change list below is only built where it is shown.
    """
    return df.withColumns(
        {
            f"d_{name}": F.coalesce(open_row, F.lit(False)) & (text(f"old_{name}") != text(name))
            for name, _label, _note in fields
        }
    )


def any_difference(fields) -> Column:
    out = F.lit(False)
    for name, _label, _note in fields:
        out = out | F.col(f"d_{name}")
    return out


def field_changes(fields) -> Column:
    """array<struct<field,label,old,new,reset>> of the fields marked by ``with_differences``.

    ``fields`` is [(name, label, reset note)].
    """
    options = [
        F.when(
            F.col(f"d_{name}"),
            F.struct(
                F.lit(name).alias("field"),
                F.lit(label).alias("label"),
                text(f"old_{name}").alias("old"),
                text(name).alias("new"),
                F.lit(note).alias("reset"),
            ),
        )
        for name, label, note in fields
    ]
    return F.filter(F.array(*options), lambda c: c.isNotNull())


MASTER_FIELDS = (
    ("accept_status", "Accept Status", ""),
    ("title", "Master Title", "Paper ID review will reset"),
    ("authors", "Master Authors", ""),
    ("notes", "Notes", ""),
)
VERSION_FIELDS = (
    ("entered_id", "Author-entered ID", "Paper ID review will reset"),
    ("record_id", "Official Paper ID", "Paper ID review will reset"),
    ("title", "Final Title", "Paper ID review and title match review will reset"),
    ("authors", "Final Authors", ""),
)


def orphan_transition(v: DataFrame) -> DataFrame:
    """Per record id: mapped versions and how many of them are excluded."""
    return (
        v.filter(filled("record_id"))
        .groupBy("record_id")
        .agg(F.count(F.lit(1)).alias("n_affected"), F.count_if("excluded").alias("n_excluded"))
    )


def diff_master(new: DataFrame, m: DataFrame, v: DataFrame) -> DataFrame:
    """Compare an imported master list with the table.

    ``new`` has row_no, record_id, accept_status, title, authors, notes. Every row comes
    back with ``status`` new/changed/unchanged/error; a new id whose versions were already
    excluded asks for a decision.
    """
    rows = new.select(
        "row_no",
        strip("record_id").alias("typed_id"),
        F.lower(strip("record_id")).alias("key"),
        *[strip(c).alias(c) for c in ("accept_status", "title", "authors")],
        clean_note("notes").alias("notes"),
    ).filter("typed_id != ''")
    rows = duplicate_keys(rows, ["key"])
    known = m.select(
        F.lower(strip("record_id")).alias("key"),
        F.col("record_id").alias("known_id"),
        *[F.col(c).alias(f"old_{c}") for c, _, _ in MASTER_FIELDS],
    )
    # several master ids that differ only in case: keep one row, remember the number
    one = known.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_known"), F.min(F.struct(*[c for c in known.columns if c != "key"])).alias("k")
    ).select("key", "n_known", "k.*")
    joined = rows.join(one, "key", "left")
    joined = joined.withColumn("record_id", F.coalesce("known_id", "typed_id")).join(
        orphan_transition(v), "record_id", "left"
    )
    repeated = F.col("row_no") != F.col("first_row")
    collides = F.coalesce(F.col("n_known"), F.lit(0)) > 1
    error = (
        F.when(
            repeated,
            F.concat(F.lit("Duplicate id in rows "), F.col("first_row").cast("string"), F.lit(" and "),
                     F.col("row_no").cast("string"), F.lit(".")),
        )
        .when(collides, "Id matches several existing records by capitalization.")
        .otherwise("")
    )
    is_new = F.col("known_id").isNull()
    out = with_differences(joined.withColumn("error", error), MASTER_FIELDS, ~is_new)
    ok, title_changed = F.col("error") == "", F.col("d_title")
    n_excluded = F.coalesce(F.col("n_excluded"), F.lit(0))
    return out.select(
        "row_no",
        "record_id",
        "accept_status",
        "title",
        "authors",
        "notes",
        F.when(~ok, "error")
        .when(is_new, "new")
        .when(any_difference(MASTER_FIELDS), "changed")
        .otherwise("unchanged")
        .alias("status"),
        field_changes(MASTER_FIELDS).alias("changes"),
        (ok & title_changed).alias("id_review_reset"),
        (ok & F.col("d_notes")).alias("notes_changed"),
        F.when(ok & (is_new | title_changed), F.coalesce("n_affected", F.lit(0))).otherwise(0).alias("n_affected"),
        (ok & is_new & (n_excluded > 0)).alias("decision_required"),
        F.when(ok & is_new, n_excluded).otherwise(0).alias("n_excluded"),
        "error",
    )


def diff_versions(new: DataFrame, v: DataFrame, m: DataFrame, uploads: DataFrame | None = None) -> DataFrame:
    """Compare an imported version list with the table.

    ``new`` has row_no, version_id, entered_id, title, authors, upload_date; ``uploads``
    is ``files.upload_lookup``. Editor uploads are protected; every flag says which
    dependent state an apply has to reset.
    """
    rows = new.select(
        "row_no", *[strip(c).alias(c) for c in ("version_id", "entered_id", "title", "authors")], "upload_date"
    ).filter("version_id != ''")
    rows = duplicate_keys(rows, ["version_id"])
    first = F.col("row_no") == F.col("first_row")
    resolved = resolve_on_reimport(rows.filter(first), v, m)
    old = v.select(
        "version_id",
        F.lit(True).alias("known"),
        *[F.col(c).alias(f"old_{c}") for c in ("entered_id", "record_id", "title", "authors", "upload_date")],
        F.col("origin").alias("old_origin"),
        F.col("discarded").alias("old_discarded"),
        (filled("corrected_pdf") | filled("corrected_source")).alias("old_corrected"),
        F.col("pdf_current_hash").alias("old_pdf"),
        F.col("source_current_hash").alias("old_source"),
    )
    masters = m.select("record_id", F.col("decision").alias("m_decision"))
    joined = rows.filter(first).join(resolved, "version_id").join(old, "version_id", "left").join(
        masters, "record_id", "left"
    )
    if uploads is None:
        joined = joined.withColumns(
            {f"upload_{k}_hash": F.lit(None).cast("string") for k in ("pdf", "source")}
        )
    else:
        joined = joined.join(uploads, "version_id", "left")
    is_new = F.col("known").isNull()
    protected = F.coalesce(F.col("old_origin") == "editor_upload", F.lit(False))

    def file_status(kind: str) -> Column:
        sent, present = F.col(f"upload_{kind}_hash"), F.col(f"old_{kind}")
        return (
            F.when(protected, "")
            .when(sent.isNull(), F.when(is_new, "missing").otherwise("not uploaded"))
            .when(is_new | present.isNull(), "new")
            .when(present == sent, "same")
            .otherwise("different")
        )

    date_changed = ~is_new & F.col("upload_date").isNotNull() & ~equal_ignoring_micros("old_upload_date", "upload_date")
    compared = with_differences(joined, VERSION_FIELDS, ~is_new & ~protected).withColumns(
        {
            "date_changed": F.coalesce(date_changed & ~protected, F.lit(False)),
            "pdf_status": file_status("pdf"),
            "source_status": file_status("source"),
        }
    )
    new_pdf = F.col("pdf_status").isin("new", "different")
    new_source = F.col("source_status").isin("new", "different")
    any_change = any_difference(VERSION_FIELDS) | F.col("date_changed") | new_pdf | new_source
    title, people = F.col("d_title"), F.col("d_authors")
    open_row = ~protected
    invalid = open_row & (~filled("record_id") | F.col("m_decision").isNull())
    resolution = F.when(protected, "protected_editor_upload").otherwise(F.col("resolution"))
    found = compared.select(
        "row_no",
        "version_id",
        "entered_id",
        "record_id",
        "title",
        "authors",
        "upload_date",
        F.when(is_new, "new").when(protected, "unchanged").when(any_change, "changed").otherwise("unchanged").alias("status"),
        field_changes(VERSION_FIELDS).alias("changes"),
        "date_changed",
        "pdf_status",
        "source_status",
        (open_row & (is_new | F.col("d_entered_id") | F.col("d_record_id") | title)).alias("id_review_reset"),
        F.when(is_new, new_pdf).otherwise(title | new_pdf | new_source).alias("title_match_reset"),
        F.when(is_new, new_pdf).otherwise(new_pdf | new_source | people).alias("review_reset"),
        new_pdf.alias("pdf_reset"),
        new_source.alias("source_reset"),
        (~is_new & (new_pdf | new_source) & F.coalesce("old_corrected", F.lit(False))).alias("corrected_archived"),
        (~is_new & people).alias("authors_changed"),
        invalid.alias("invalid_master"),
        protected.alias("protected"),
        F.coalesce("old_discarded", F.lit(False)).alias("currently_discarded"),
        (F.coalesce(F.col("m_decision"), F.lit("")) == "not_publishing").alias("master_excluded"),
        (F.coalesce(F.col("m_decision"), F.lit("")) == "decision_required").alias("master_undecided"),
        resolution.alias("resolution"),
        F.lit("").alias("error"),
    )
    repeated = rows.filter(~first).select(
        "row_no",
        "version_id",
        F.lit("error").alias("status"),
        F.concat(F.lit("Duplicate id in rows "), F.col("first_row").cast("string"), F.lit(" and "),
                 F.col("row_no").cast("string"), F.lit(".")).alias("error"),
    )
    return found.unionByName(repeated, allowMissingColumns=True)


def import_stats(preview: DataFrame) -> DataFrame:
    """Rows by status and by each reset flag, in one aggregate."""
    statuses = ("new", "changed", "unchanged", "error")
    flags = ("id_review_reset", "title_match_reset", "review_reset", "pdf_reset", "source_reset",
             "corrected_archived", "invalid_master", "protected")
    return preview.agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses],
        *[F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f"n_{f}") for f in flags if f in preview.columns],
    )


def change_text() -> Column:
    """"field: old -> new" of every change, joined."""
    return F.array_join(
        F.transform("changes", lambda c: F.concat(c["field"], F.lit(": "), c["old"], F.lit(" -> "), c["new"])), "; "
    )


# -- optimistic checks -------------------------------------------------------


def stale_check(actions: DataFrame, current: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Accept an action only when the digest it saw is still that of the row."""
    now = current.select(key, row_digest(columns).alias("now_digest"))
    joined = actions.join(now, key, "left")
    reason = (
        F.when(F.col("now_digest").isNull(), "missing")
        .when(F.col("seen_digest") != F.col("now_digest"), "stale")
        .otherwise("")
    )
    return joined.withColumns({"accepted": reason == "", "reason": reason}).drop("now_digest")


IDENTITY_FIELDS = ("version_id", "entered_id", "record_id", "title")
SCORE_FIELDS = ("plagiarism_status", "similarity", "single")


def edit_impacts(edits: DataFrame) -> DataFrame:
    """Consequences of a set of changed fields.

    ``edits`` has version_id, changed_fields, has_corrected, report_path. One row per
    (version, consequence).
    """

    def touches(*names) -> Column:
        return F.arrays_overlap("changed_fields", F.array(*[F.lit(n) for n in names]))

    impacts = [
        (touches(*IDENTITY_FIELDS), "warning", "Paper ID review will be recalculated"),
        (touches("title"), "warning", "Extracted title comparison will reset"),
        (touches("authors"), "warning", "Title/Author Review will return to Pending"),
        (touches("pdf_file"), "danger", "PDF-dependent checks will reset"),
        (touches("source_file"), "danger", "Source-dependent checks will reset"),
        (touches("pdf_file", "source_file") & F.col("has_corrected"), "danger",
         "Corrected files will be archived and unlinked"),
        (touches("version_id", "record_id", "upload_date"), "warning", "Active versions will be recalculated"),
        (touches(*SCORE_FIELDS) & filled("report_path") & ~touches("report_file"), "warning",
         "Existing plagiarism report will be marked old"),
    ]
    options = [
        F.when(test, F.struct(F.lit(level).alias("level"), F.lit(label).alias("label")))
        for test, level, label in impacts
    ]
    return edits.select("version_id", F.inline(F.filter(F.array(*options), lambda i: i.isNotNull())))
