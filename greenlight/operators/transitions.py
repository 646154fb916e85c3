"""Set-based state transitions: decisions, discards, reviews, edits and applied results.

Each takes the current table and a frame of requested actions and returns either the
new table or the actions with ``accepted`` and a reason; rejected rows are never lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenlight.catalog import MASTER_REASONS
from greenlight.functions.similarity import title_similarity
from greenlight.functions.text import clean_note, filled, nonblank, sanitize, strip, titles_identical
from greenlight.operators import versions
from greenlight.operators.changes import RESETS, reset_dependents, upsert
from greenlight.operators.files import chosen_path
from greenlight.operators.scope import EXCLUDED, PUBLISHING, UNDECIDED

EXCLUSION = ("excluded", "exclusion_reason", "exclusion_notes", "excluded_at")


def mirror_decision(v: DataFrame, m: DataFrame) -> DataFrame:
    """Copy the master decision to its versions; an undecided or missing master changes nothing."""
    decided = m.select(
        "record_id",
        F.col("decision").alias("_d"),
        *[F.col(c).alias(f"_{c}") for c in ("exclusion_reason", "exclusion_notes", "excluded_at")],
    )
    joined = v.join(decided, "record_id", "left")
    out, back = F.col("_d") == EXCLUDED, F.col("_d") == PUBLISHING
    kind = dict(v.dtypes)
    return joined.withColumns(
        {
            "excluded": F.when(out, True).when(back, False).otherwise(F.col("excluded")),
            **{
                c: F.when(out, F.col(f"_{c}")).when(back, F.lit("")).otherwise(F.col(c))
                for c in ("exclusion_reason", "exclusion_notes")
            },
            "excluded_at": F.when(out, F.col("_excluded_at"))
            .when(back, F.lit(None).cast(kind["excluded_at"]))
            .otherwise(F.col("excluded_at")),
        }
    ).select(*v.columns)


def mark_excluded(m: DataFrame, decisions: DataFrame) -> DataFrame:
    """(record_id, action, reason, notes, at) against the master: new state or a refusal.

    ``action`` is exclude or undo; an exclusion needs a known reason.
    """
    joined = decisions.join(m.select("record_id", F.col("decision").alias("old_decision")), "record_id", "left")
    out = F.col("action") == "exclude"
    refusal = (
        F.when(F.col("old_decision").isNull(), "Record is not in the master list.")
        .when(~F.col("action").isin("exclude", "undo"), "Unknown action.")
        .when(out & ~strip("reason").isin(*MASTER_REASONS), "Select a valid Not Publishing reason.")
        .otherwise("")
    )
    ok = refusal == ""
    return joined.select(
        "record_id",
        "action",
        ok.alias("accepted"),
        refusal.alias("refusal"),
        F.when(ok & out, EXCLUDED).when(ok, PUBLISHING).otherwise(F.col("old_decision")).alias("decision"),
        F.when(ok & out, strip("reason")).otherwise("").alias("exclusion_reason"),
        F.when(ok & out, clean_note("notes")).otherwise("").alias("exclusion_notes"),
        F.when(ok & out, F.col("at")).alias("excluded_at"),
    )


def apply_decisions(m: DataFrame, outcome: DataFrame) -> DataFrame:
    """The master after accepted decisions."""
    accepted = outcome.filter("accepted").select(
        "record_id", "decision", "exclusion_reason", "exclusion_notes", "excluded_at"
    )
    return upsert(m, accepted, ["record_id"])


def discard(v: DataFrame, actions: DataFrame, rule: str = "final_id") -> DataFrame:
    """(version_id, action, notes): discard needs a note; then active and replaced are set again."""
    ok = actions.filter((F.col("action") == "undo") | nonblank("notes")).select(
        "version_id", F.lit(True).alias("_hit"), (F.col("action") == "discard").alias("_to"), strip("notes").alias("_notes")
    )
    joined = v.join(ok, "version_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    changed = joined.withColumns(
        {
            "discarded": F.when(hit, F.col("_to")).otherwise(F.col("discarded")),
            "discard_notes": F.when(hit & F.col("_to"), F.col("_notes")).when(hit, "").otherwise(F.col("discard_notes")),
        }
    ).select(*v.columns)
    return versions.recompute(changed, rule)


def _orphan_exclusions(v: DataFrame) -> DataFrame:
    """record_id -> whether any version of the group is excluded."""
    return v.filter(filled("record_id")).groupBy("record_id").agg(F.bool_or("excluded").alias("any_excluded"))


def guard_remap(changes: DataFrame, v: DataFrame, m: DataFrame) -> DataFrame:
    """(version_id, new_record_id): may the version move to another record?"""
    current = v.select("version_id", strip("record_id").alias("old_record_id"))
    groups = _orphan_exclusions(v)

    def side(name: str) -> DataFrame:
        decided = m.select(F.col("record_id").alias(name), F.col("decision").alias(f"{name}_decision"))
        return decided

    def group(name: str) -> DataFrame:
        return groups.select(F.col("record_id").alias(name), F.col("any_excluded").alias(f"{name}_excluded"))

    joined = changes.select("version_id", strip("new_record_id").alias("new_record_id")).join(current, "version_id")
    for name in ("old_record_id", "new_record_id"):
        joined = joined.join(side(name), name, "left").join(group(name), name, "left")
    closed = (EXCLUDED, UNDECIDED)

    def orphan_excluded(name: str) -> Column:
        return F.col(f"{name}_decision").isNull() & F.coalesce(F.col(f"{name}_excluded"), F.lit(False))

    reason = (
        F.when(F.col("old_record_id") == F.col("new_record_id"), "")
        .when(F.col("old_record_id_decision").isin(*closed), "current record is excluded or undecided")
        .when(F.col("new_record_id_decision").isin(*closed), "target record is excluded or undecided")
        .when(orphan_excluded("old_record_id"), "current group holds an excluded version")
        .when(orphan_excluded("new_record_id"), "target group holds an excluded version")
        .otherwise("")
    )
    return joined.select(
        "version_id", "old_record_id", "new_record_id", (reason == "").alias("accepted"), reason.alias("reason")
    )


def guard_master_rename(changes: DataFrame, v: DataFrame) -> DataFrame:
    """(record_id, new_record_id): a mapped record may be neither renamed nor deleted (NULL)."""
    mapped = v.filter(filled("record_id")).groupBy("record_id").agg(F.count(F.lit(1)).alias("n_mapped"))
    joined = changes.join(mapped, "record_id", "left").na.fill(0, ["n_mapped"])
    moves = ~F.col("record_id").eqNullSafe(F.col("new_record_id"))
    return joined.withColumn("accepted", ~(moves & (F.col("n_mapped") > 0)))


def verify_identity(requests: DataFrame, v: DataFrame, m: DataFrame) -> DataFrame:
    """(version_id, target_id): verification of a record id with all its guards."""
    current = v.select("version_id", strip("record_id").alias("old_record_id"))
    groups = _orphan_exclusions(v)
    joined = requests.select("version_id", strip("target_id").alias("target_id")).join(current, "version_id")
    for name, tag in (("target_id", "t"), ("old_record_id", "s")):
        joined = joined.join(
            m.select(F.col("record_id").alias(name), F.col("decision").alias(f"{tag}_decision")), name, "left"
        ).join(
            groups.select(F.col("record_id").alias(name), F.col("any_excluded").alias(f"{tag}_excluded")), name, "left"
        )
    reason = (
        F.when(F.col("t_decision").isNull(), "ID not in master list")
        .when(F.col("t_decision") == EXCLUDED, "target record is excluded")
        .when(F.col("t_decision") == UNDECIDED, "target record needs a decision")
        .when(F.col("s_decision") == EXCLUDED, "current record is excluded")
        .when(F.col("s_decision") == UNDECIDED, "current record needs a decision")
        .when(F.coalesce("s_excluded", F.lit(False)), "current group holds an excluded version")
        .when(F.coalesce("t_excluded", F.lit(False)), "target group holds an excluded version")
        .otherwise("")
    )
    return joined.select(
        "version_id", "old_record_id", "target_id", (reason == "").alias("accepted"), reason.alias("reason")
    )


def unverify(v: DataFrame, ids: DataFrame) -> DataFrame:
    """Back to review: the automatic verification by title is blocked as well."""
    joined = v.join(ids.select("version_id", F.lit(True).alias("_hit")), "version_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return joined.withColumns(
        {
            "id_verified": F.when(hit, False).otherwise(F.col("id_verified")),
            "auto_verify_blocked": F.when(hit, True).otherwise(F.col("auto_verify_blocked")),
            "verification_status": F.when(hit, "pending").otherwise(F.col("verification_status")),
        }
    ).select(*v.columns)


def set_review_status(v: DataFrame, requests: DataFrame) -> DataFrame:
    """(version_id, status): title/author review; OK needs a title and authors."""
    state = v.select("version_id", "extracted_title", "extracted_authors", F.col("review_status").alias("old_status"))
    joined = requests.join(state, "version_id", "left")
    ok = F.col("status") == "review_ok"
    reason = (
        F.when(F.col("old_status").isNull(), "version does not exist")
        .when(~F.col("status").isin("pending", "red_flag", "review_ok"), "unknown status")
        .when(ok & ~(nonblank("extracted_title") & nonblank("extracted_authors")), "extraction is incomplete")
        .otherwise("")
    )
    return joined.select(
        "version_id", "old_status", (reason == "").alias("accepted"), reason.alias("reason"),
        F.when(reason == "", F.col("status")).otherwise(F.col("old_status")).alias("review_status"),
    )


def guard_review(v: DataFrame, scorer=title_similarity) -> DataFrame:
    """Reset review states their evidence no longer supports; adds ``guarded``."""
    title, people = nonblank("extracted_title"), nonblank("extracted_authors")
    review = (F.col("review_status") == "review_ok") & ~(title & people)
    duplicate = (F.col("duplicate_review_status") == "review_ok") & ~people
    near = titles_identical("title", "extracted_title") | F.coalesce(scorer("title", "extracted_title") >= 90, F.lit(False))
    match = F.col("title_verified") & ~(nonblank("title") & title & near)
    return v.withColumns(
        {
            "review_status": F.when(review, "pending").otherwise(F.col("review_status")),
            "duplicate_review_status": F.when(duplicate, "pending").otherwise(F.col("duplicate_review_status")),
            "title_verified": F.when(match, False).otherwise(F.col("title_verified")),
            "guarded": review | duplicate | match,
        }
    )


def apply_measurements(v: DataFrame, measured: DataFrame) -> DataFrame:
    """(version_id, sha256, pages) against the version table.

    ``measured`` covers the chosen files; a version without a row has no file. Adds
    ``disposition``: skipped, processed, integrity_reset or error.
    """
    seen = measured.select(
        "version_id", F.col("sha256").alias("_sha"), F.col("pages").alias("_pages"), F.lit(True).alias("_seen")
    )
    joined = v.join(seen, "version_id", "left")
    has_file = F.coalesce("_seen", F.lit(False)) & F.col("_sha").isNotNull()
    unreadable = has_file & F.col("_pages").isNull()
    same = F.col("pdf_hash") == F.col("_sha")
    skipped = (
        has_file & same & (F.col("processing_status") == "processed") & F.col("pages").isNotNull()
        & filled("thumbnail_folder")
    )
    outside = has_file & filled("pdf_hash") & ~same
    disposition = (
        F.when(~has_file, "error")
        .when(skipped, "skipped")
        .when(unreadable, "error")
        .when(outside, "integrity_reset")
        .otherwise("processed")
    )
    tagged = joined.withColumns(
        {"disposition": disposition, "_old_pages": F.when(outside, F.lit(None).cast("int")).otherwise(F.col("pages"))}
    )
    done = F.col("disposition").isin("processed", "integrity_reset")
    # a page waiver is bound to the count it was given for
    new_count = done & ~F.col("_old_pages").eqNullSafe(F.col("_pages"))
    reset = reset_dependents(
        tagged, {"pdf": F.col("disposition") == "integrity_reset", "page_waiver": new_count}
    )
    message = (
        F.when(~has_file, "Missing PDF file.")
        .when(F.col("disposition") == "error", "PDF processing failed.")
        .when(done, "PDF page count, hash, and thumbnails computed.")
        .otherwise(F.col("processing_message"))
    )
    return reset.withColumns(
        {
            "pages": F.when(done, F.col("_pages")).otherwise(F.col("pages")),
            "pdf_hash": F.when(done, F.col("_sha")).otherwise(F.col("pdf_hash")),
            "processing_status": F.when(done, "processed")
            .when(F.col("disposition") == "error", "error")
            .otherwise(F.col("processing_status")),
            "processing_message": message,
            "thumbnail_status": F.when(done, "processed").otherwise(F.col("thumbnail_status")),
            "thumbnail_folder": F.when(done, F.concat(F.lit("thumbs/"), F.col("version_id"))).otherwise(
                F.col("thumbnail_folder")
            ),
        }
    ).select(*v.columns, "disposition")


def apply_extraction(v: DataFrame, extracted: DataFrame, chosen: Column | None = None) -> DataFrame:
    """(version_id, new_title, new_authors, error) into the version table, with ``disposition``.

    ``chosen`` says which rows an extraction run covers; others are skipped. An error keeps
    the old values but sends the reviews back to pending.
    """
    rows = extracted.select(
        "version_id", strip("new_title").alias("_t"), strip("new_authors").alias("_a"), F.col("error").alias("_e"),
        F.lit(True).alias("_hit"),
    )
    joined = v.join(rows, "version_id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & (F.lit(True) if chosen is None else F.coalesce(chosen, F.lit(False)))
    failed = F.coalesce(F.col("_e"), F.lit("")) != ""
    tagged = joined.withColumn(
        "disposition", F.when(~hit, "skipped").when(failed, "error").otherwise("extracted")
    )
    good, bad = F.col("disposition") == "extracted", F.col("disposition") == "error"
    reset = reset_dependents(tagged, {"title_match": good, "authors_manual": good})
    for field, value in {**RESETS["authors"], "duplicate_review_status": "pending"}.items():
        if field in v.columns:
            reset = reset.withColumn(field, F.when(bad, F.lit(value)).otherwise(F.col(field)))
    return reset.withColumns(
        {
            "extracted_title": F.when(good, F.col("_t")).otherwise(F.col("extracted_title")),
            "extracted_authors": F.when(good, F.col("_a")).otherwise(F.col("extracted_authors")),
            "title_author_source": F.when(good, "built_in_extractor").otherwise(F.col("title_author_source")),
            "extraction_status": F.when(good, "extracted").when(bad, "error").otherwise(F.col("extraction_status")),
            "override_reason": F.when(good, "").otherwise(F.col("override_reason")),
            "title_verify_blocked": F.when(good, False).otherwise(F.col("title_verify_blocked")),
        }
    ).select(*v.columns, "disposition")


def apply_override(v: DataFrame, overrides: DataFrame) -> DataFrame:
    """(version_id, new_title, new_authors, reason): manual title/names, with the refusals.

    Returns the override rows with ``accepted``, ``refusal`` and the values to write.
    """
    rows = overrides.select(
        "version_id", strip("new_title").alias("extracted_title"), strip("new_authors").alias("extracted_authors"),
        strip("reason").alias("override_reason"),
    ).join(v.select("version_id", F.lit(True).alias("_known")), "version_id", "left")
    refusal = (
        F.when(F.col("_known").isNull(), "version does not exist")
        .when(F.col("override_reason") == "", "reason is required")
        .when((F.col("extracted_title") == "") & (F.col("extracted_authors") == ""), "title or authors are required")
        .otherwise("")
    )
    return rows.select(
        "version_id", (refusal == "").alias("accepted"), refusal.alias("refusal"), "extracted_title",
        "extracted_authors", "override_reason", F.lit("manual_override").alias("title_author_source"),
        F.lit("pending").alias("review_status"), F.lit("pending").alias("duplicate_review_status"),
    )


def apply_format_review(v: DataFrame, reviews: DataFrame) -> DataFrame:
    """(version_id, status, new_corrected_pdf, new_corrected_source, issue, page): formatting review.

    OK binds the hash of the chosen source and needs one; a new corrected file on an OK
    row returns it to pending; a corrected PDF resets what depended on the old one but
    keeps the extraction for reference; an issue note is appended.
    """
    rows = reviews.select(
        "version_id", F.lit(True).alias("_hit"), F.col("status").alias("_status"),
        F.coalesce("new_corrected_pdf", F.lit("")).alias("_pdf"),
        F.coalesce("new_corrected_source", F.lit("")).alias("_src"),
        clean_note("issue").alias("_issue"), F.col("page").alias("_page"),
    )
    joined = v.join(rows, "version_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    new_pdf = hit & (F.coalesce("_pdf", F.lit("")) != "")
    new_source = hit & (F.coalesce("_src", F.lit("")) != "")
    has_source = chosen_path("source") != ""
    present = has_source & F.col("source_current_hash").isNotNull()
    was_ok = F.col("format_status") == "review_ok"
    has_issue = hit & (F.coalesce("_issue", F.lit("")) != "")
    outside = has_issue & F.coalesce(
        (F.col("_page") < 1) | (F.col("_page") > F.col("pages")), F.lit(False)
    )
    wanted = F.when(has_issue, "needs_edit").when((new_pdf | new_source) & was_ok, "pending").otherwise(F.col("_status"))
    refusal = (
        F.when(outside, "page is outside the document")
        .when(hit & (wanted == "review_ok") & ~present, "no source file to approve")
        .otherwise("")
    )
    tagged = joined.withColumns(
        {
            "refusal": refusal,
            "_go": hit & (refusal == ""),
            "_wanted": wanted,
            "_keep_title": F.col("extracted_title"),
            "_keep_authors": F.col("extracted_authors"),
            "_keep_source": F.when(F.col("title_author_source") == "manual_override", "unknown").otherwise(F.col("title_author_source")),
            "_pdf_in": new_pdf,
            "_src_in": new_source,
        }
    )
    go = F.col("_go")
    reset = reset_dependents(
        tagged, {"pdf": go & F.col("_pdf_in"), "source": go & F.col("_src_in") & ~F.col("_pdf_in")}
    )
    kept = go & F.col("_pdf_in")
    note = F.when(
        F.col("_page").isNotNull(), F.concat(F.lit("Page "), F.col("_page").cast("string"), F.lit(": "), F.col("_issue"))
    ).otherwise(F.col("_issue"))
    return reset.select(
        "version_id",
        "refusal",
        F.when(go, F.col("_wanted")).otherwise(F.col("format_status")).alias("format_status"),
        F.when(go & (F.col("_wanted") == "review_ok"), F.col("source_current_hash"))
        .when(go, "")
        .otherwise(F.col("source_hash"))
        .alias("source_hash"),
        F.when(kept, F.col("_keep_title")).otherwise(F.col("extracted_title")).alias("extracted_title"),
        F.when(kept, F.col("_keep_authors")).otherwise(F.col("extracted_authors")).alias("extracted_authors"),
        F.when(kept, F.col("_keep_source")).otherwise(F.col("title_author_source")).alias("title_author_source"),
        F.when(go & F.col("_pdf_in"), F.col("_pdf")).otherwise(F.col("corrected_pdf")).alias("corrected_pdf"),
        F.when(go & F.col("_src_in"), F.col("_src")).otherwise(F.col("corrected_source")).alias("corrected_source"),
        "pages",
        "processing_status",
        "review_status",
        F.when(go & has_issue, note).otherwise("").alias("added_note"),
    )


def apply_edits(v: DataFrame, edits: DataFrame) -> DataFrame:
    """Manual edits: (version_id, changed_fields, and any of the edited columns with prefix ``new_``).

    Unlike an import, an authors edit also resets the duplicate-name review and the
    name waiver.
    """
    given = [c[4:] for c in edits.columns if c.startswith("new_") and c[4:] in v.columns]
    joined = v.join(edits.withColumn("_hit", F.lit(True)), "version_id", "left")
    fields = F.coalesce("changed_fields", F.array().cast("array<string>"))

    def touched(*names) -> Column:
        return F.arrays_overlap(fields, F.array(*[F.lit(n) for n in names]))

    written = joined.withColumns(
        {c: F.when(touched(c), F.col(f"new_{c}")).otherwise(F.col(c)) for c in given}
    )
    pdf, source = touched("pdf_file"), touched("source_file")
    scores = touched("similarity", "single", "plagiarism_status")
    out = reset_dependents(
        written,
        {
            "identity": touched("entered_id", "record_id", "title"),
            "corrected": pdf | source,
            "pdf": pdf,
            "source": source & ~pdf,
            "extraction_manual": touched("extracted_title", "extracted_authors") & ~pdf,
            "name_waiver": touched("extracted_authors") & ~pdf,
            "authors_manual": touched("authors") & ~(pdf | source),
            "title_match": touched("title") & ~pdf,
        },
    )
    return out.withColumn(
        "report_stale",
        F.when(scores & filled("report_path") & ~touched("report_path"), True)
        .when(touched("report_path"), False)
        .otherwise(F.col("report_stale")),
    ).select(*v.columns)


def apply_master_edits(m: DataFrame, v: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(record_id, and any of accept_status, title, authors, notes) -> new master, new versions, affected counts.

    A changed title sends the identity review of every mapped version back to pending.
    """
    old = m.select("record_id", F.col("title").alias("_old"))
    retitled = (
        edits.join(old, "record_id").filter(F.col("title") != F.col("_old")).select("record_id", F.lit(True).alias("_hit"))
        if "title" in edits.columns
        else old.limit(0).select("record_id", F.lit(True).alias("_hit"))
    )
    joined = v.join(retitled, "record_id", "left")
    reset = reset_dependents(joined, {"identity": F.col("_hit")}).select(*v.columns)
    counts = v.join(retitled, "record_id", "left_semi").groupBy("record_id").agg(F.count(F.lit(1)).alias("n_affected"))
    return upsert(m, edits, ["record_id"]), reset, counts


def next_sequence_ids(bases: DataFrame, existing: DataFrame) -> DataFrame:
    """The smallest free ``base-NNN`` for every base, set-based.

    A used number whose successor is free ends a run; the smallest end, or nothing when 1
    itself is free, gives the answer.
    """
    number = F.regexp_extract("version_id", r"-(\d{3,})$", 1)
    base = F.regexp_replace("version_id", r"-\d{3,}$", "")
    used = (
        existing.select(base.alias("base"), number.try_cast("long").alias("n"), number.alias("digits"))
        .filter("n >= 1 AND digits = format_string('%03d', n)")
        .select("base", "n")
        .distinct()
        .join(bases.select("base"), "base", "left_semi")
    )
    # a number is the end of the first run when its successor is free; the smallest such end wins
    successor = used.select("base", (F.col("n") - 1).alias("n"), F.lit(True).alias("next"))
    ends = used.join(successor, ["base", "n"], "left").filter("next IS NULL")
    first = ends.groupBy("base").agg(F.min("n").alias("end"))
    starts = used.filter("n = 1").select("base", F.lit(True).alias("has_one"))
    joined = bases.select("base").distinct().join(first, "base", "left").join(starts, "base", "left")
    nxt = F.when(F.col("has_one").isNull(), 1).otherwise(F.col("end") + 1)
    return joined.select("base", F.concat("base", F.lit("-"), F.format_string("%03d", nxt)).alias("next_id"))


def editor_base(record_id) -> Column:
    return F.concat(F.lit("EDITOR-"), sanitize(record_id))


def apply_editor_uploads(v: DataFrame, m: DataFrame, uploads: DataFrame, rule: str = "final_id") -> DataFrame:
    """(record_id, title, authors, upload_date, notes): one new editor version per record, then recomputed.

    The new version takes the next free id and inherits the master decision.
    """
    based = uploads.withColumn("base", editor_base("record_id"))
    ids = next_sequence_ids(based, v)
    new = based.join(ids, "base").select(
        F.col("next_id").alias("version_id"), "record_id", F.col("record_id").alias("entered_id"), "title", "authors",
        "upload_date", F.lit("editor_upload").alias("origin"), F.col("notes").alias("editor_notes"),
        F.lit(False).alias("discarded"), F.lit(False).alias("excluded"), F.lit("").alias("exclusion_reason"),
        F.lit("").alias("exclusion_notes"), F.col("upload_date").alias("created_at"),
        F.col("upload_date").alias("updated_at"),
    )
    new = new.withColumn("excluded_at", F.lit(None).cast(dict(v.dtypes)["excluded_at"]))
    mirrored = mirror_decision(new, m)
    return versions.recompute(v.unionByName(mirrored, allowMissingColumns=True), rule)


def is_refused(preview: DataFrame) -> DataFrame:
    """One row: whether a preview has an error."""
    return preview.agg(F.coalesce(F.max(F.col("status") == "error"), F.lit(False)).alias("refused"))


def accepted(preview: DataFrame) -> DataFrame:
    """The new and changed rows of a preview; none if any of its rows is an error, which refuses the whole file."""
    return preview.filter("status IN ('new', 'changed')").filter(~is_refused(preview).scalar())


def apply_master(m: DataFrame, preview: DataFrame, keep_notes: bool = True) -> DataFrame:
    """Apply ``changes.diff_master``: new rows are inserted, changed ones updated; a preview with errors changes nothing."""
    rows = accepted(preview)
    old = m.select("record_id", F.col("notes").alias("_old_notes"), F.col("decision").alias("_d"))
    joined = rows.join(old, "record_id", "left")
    known = F.col("_d").isNotNull()
    notes = F.when(known & F.lit(keep_notes), F.col("_old_notes")).otherwise(F.col("notes"))
    decision = F.when(known, F.col("_d")).when(F.col("decision_required"), UNDECIDED).otherwise(PUBLISHING)
    return upsert(
        m,
        joined.select("record_id", "accept_status", "title", "authors", notes.alias("notes"), decision.alias("decision")),
        ["record_id"],
    )


def apply_versions(v: DataFrame, m: DataFrame, preview: DataFrame, rule: str = "final_id") -> DataFrame:
    """Apply ``changes.diff_versions``: values, resets, mirrored decision, then active and replaced. A preview with
    errors changes nothing, which is settled first: only the keys of the file are read for it, and a file that is
    refused meets no table."""
    if not preview.filter("status = 'error'").select(F.lit(1)).isEmpty():
        return v
    flags = ("id_review_reset", "title_match_reset", "pdf_reset", "source_reset", "corrected_archived", "authors_changed")
    rows = preview.filter("status IN ('new', 'changed') AND NOT protected").select(
        "version_id", F.lit(True).alias("_hit"), (F.col("status") == "new").alias("_new"),
        *[F.col(c).alias(f"_{c}") for c in ("entered_id", "record_id", "title", "authors", "upload_date")], *flags,
    )
    joined = v.join(rows, "version_id", "full")
    hit, new = F.coalesce("_hit", F.lit(False)), F.coalesce("_new", F.lit(False))
    date = F.coalesce("_upload_date", "upload_date")
    written = joined.withColumns(
        {
            **{c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("entered_id", "record_id", "title", "authors")},
            "upload_date": F.when(hit, date).otherwise(F.col("upload_date")),
            "created_at": F.coalesce("created_at", date),
            "updated_at": F.coalesce("updated_at", date),
            "origin": F.when(new, "start2").otherwise(F.col("origin")),
            **{c: F.when(new, F.lit(False)).otherwise(F.col(c)) for c in ("discarded", "excluded")},
        }
    )
    reset = reset_dependents(
        written,
        {
            "identity": F.col("id_review_reset"),
            "title_match": F.col("title_match_reset"),
            "pdf": F.col("pdf_reset"),
            "source": F.col("source_reset"),
            "authors": F.col("authors_changed"),
            "corrected": F.col("corrected_archived"),
        },
    ).select(*v.columns)
    return versions.recompute(mirror_decision(reset, m), rule)
