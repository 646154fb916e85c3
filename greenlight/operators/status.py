"""Status labels, blockers and worklist predicates as columns.

Each status is a struct column from one ``when`` chain; each worklist predicate is a
boolean column, so filters, counts and sort ranks all read the same definitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenlight import catalog
from greenlight.functions.scores import score_level
from greenlight.functions.text import filled, strip
from greenlight.operators import exceptions, files, names, rules
from greenlight.operators.scope import EXCLUDED, UNDECIDED
from greenlight.operators.measures import with_measures
from greenlight.settings import Settings


def _status(*cases, otherwise) -> Column:
    """``when`` chain to struct(label, level, key)."""

    def pack(label, level, key="") -> Column:
        def lift(value):
            return value if isinstance(value, Column) else F.lit(value)

        return F.struct(lift(label).alias("label"), lift(level).alias("level"), lift(key).alias("key"))

    out = None
    for test, values in cases:
        out = F.when(test, pack(*values)) if out is None else out.when(test, pack(*values))
    return out.otherwise(pack(*otherwise))


def has_version() -> Column:
    return F.col("version_id").isNotNull()


def page_status(s: Settings) -> Column:
    pages = F.col("pages")
    waived = exceptions.exception_status("page", s)
    has_pdf = files.persisted_file_state("pdf") != "missing"
    low = F.when(waived == "allowed", "info").otherwise("warning")
    high = F.when(waived == "allowed", "info").when(waived == "stale", "warning").otherwise("danger")
    return _status(
        (~has_version(), ("No final", "danger", "no_final")),
        (~has_pdf, ("Requires PDF", "secondary", "requires_pdf")),
        (F.col("processing_status") == "error", ("PDF error", "danger", "pdf_error")),
        (pages.isNull(), ("Needs processing", "warning", "needs_processing")),
        (pages < s.page_minimum, (f"Below min {s.page_minimum}", low, "below_minimum")),
        (pages > s.page_limit, (f"Over limit {s.page_limit}", high, "over_limit")),
        otherwise=("Page OK", "secondary", "page_ok"),
    )


def identity_status() -> Column:
    shown = catalog.LABELS
    decision = F.col("m_decision")
    manual = F.col("id_verified")
    return _status(
        (F.coalesce("n_active", F.lit(0)) > 1, ("Multiple active finals", "danger")),
        (~has_version(), ("No final", "secondary")),
        (decision == EXCLUDED, (shown["decision"]["excluded"], "secondary")),
        (decision == UNDECIDED, (shown["decision"]["decision_required"], "danger")),
        (decision.isNull() & F.col("excluded"), (shown["decision"]["excluded"], "secondary")),
        (decision.isNull(), ("Needs decision", "danger")),
        (manual & ~rules.titles_match_master(), (shown["identity"]["verified_title_differs"], "warning")),
        (rules.effectively_verified() & manual, (shown["identity"]["verified"], "success")),
        (rules.effectively_verified(), (shown["identity"]["auto_verified"], "success")),
        (F.col("verification_status") == "title_mismatch", (shown["identity"]["title_mismatch"], "warning")),
        otherwise=(shown["identity"]["needs_review"], "danger"),
    )


def score_status() -> Column:
    return _status(
        (has_version() & rules.missing_score(), ("No result", "danger")), otherwise=("", "secondary")
    )


def source_status(verify_content: bool = False) -> Column:
    state = files.file_state("source") if verify_content else files.persisted_file_state("source")
    reviewed = F.col("format_status") == "review_ok"
    cases = [
        (~has_version(), ("", "secondary")),
        (state == "corrected_missing", ("Corrected missing", "danger")),
        (state == "missing", ("No source", "danger")),
        (reviewed & ~filled("source_hash"), ("Review hash missing", "danger")),
    ]
    if verify_content:
        changed = F.col("source_current_hash") != F.col("source_hash")
        cases.append((reviewed & changed, ("Changed after review", "danger")))
    cases.append((state == "corrected", ("Corrected", F.when(reviewed, "success").otherwise("secondary"))))
    return _status(*cases, otherwise=("Original", "secondary"))


def extraction_status() -> Column:
    title, people, review = filled("extracted_title"), filled("extracted_authors"), F.col("review_status")
    return _status(
        (~has_version(), ("", "secondary")),
        (review == "red_flag", ("Red Flag", "danger")),
        (title & people & (review == "review_ok"), ("Review OK", "success")),
        (title & people, ("Pending", "warning")),
        (~title & ~people, ("No extracted title/authors", "danger")),
        (~title, ("No extracted title", "danger")),
        otherwise=("No extracted authors", "danger"),
    )


def name_status(s: Settings) -> Column:
    n = F.col("x_count")
    state = exceptions.exception_status("author_number", s)
    over = n > s.record_name_limit
    level = (
        F.when(over & (state == "allowed"), "info")
        .when(state == "stale", "warning")
        .when(over | rules.unresolved_repeats(), "danger")
        .otherwise("secondary")
    )
    label = F.concat(n.cast("string"), F.lit(" author"), F.when(n == 1, "").otherwise("s"))
    return _status(
        (~has_version(), ("--", "secondary")),
        (~filled("extracted_authors"), ("Awaiting extraction", "secondary")),
        otherwise=(label, level),
    )


def title_pair(reference: str, normal: str, extracted: str = "extracted_title") -> Column:
    """missing / identical / soft (formatting only) / hard."""
    return (
        F.when(~filled(reference) | ~filled(extracted), "missing")
        .when(strip(reference) == strip(extracted), "identical")
        .when((F.col(normal) != "") & (F.col(normal) == F.col("x_extracted")), "soft")
        .otherwise("hard")
    )


def title_comparison() -> Column:
    """Three-way text of master, claimed and extracted title."""
    titles = {"Master": "m_title", "Final": "title", "Extracted": "extracted_title"}
    raw = {k: strip(c) for k, c in titles.items()}
    norm = {k: F.col(c) for k, c in zip(titles, ("x_master", "x_title", "x_extracted"))}
    missing = F.concat_ws(", ", *[F.when(raw[k] == "", k) for k in titles])
    same = (raw["Master"] == raw["Final"]) & (raw["Final"] == raw["Extracted"])
    alike = (norm["Master"] != "") & (norm["Master"] == norm["Final"]) & (norm["Final"] == norm["Extracted"])
    differs = F.concat_ws(
        "; ", *[F.when(norm[k] != norm["Extracted"], f"{k} title differs") for k in ("Master", "Final")]
    )
    return (
        F.when(missing != "", F.concat(F.lit("Missing "), missing))
        .when(same, "All titles match")
        .when(alike, "Formatting-only difference")
        .when(differs != "", differs)
        .otherwise("Master and Final titles differ")
    )


def verification_badge() -> Column:
    """Short identity badge of the version list."""
    shown = catalog.LABELS["identity"]
    decision = F.col("m_decision")
    outside = (decision == EXCLUDED) | (decision.isNull() & F.col("excluded"))
    manual = F.col("id_verified")
    verified, match = rules.effectively_verified(), F.coalesce(rules.titles_match_master(), F.lit(False))
    return _status(
        (F.coalesce(outside, F.lit(False)), (catalog.LABELS["decision"]["excluded"], "secondary")),
        (manual & ~match, (shown["verified_title_differs"], "warning")),
        (verified & manual, (shown["verified"], "success")),
        (verified, (shown["auto_verified"], "success")),
        (F.col("verification_status") == "title_mismatch", (shown["title_mismatch"], "warning")),
        (F.col("verification_status") == "invalid_paper_id", (shown["not_in_master"], "warning")),
        otherwise=(shown["needs_review"], "danger"),
    )


def primary_blocker() -> Column:
    """The one thing to settle first; '' when the row is a single publication candidate."""
    return (
        F.when(F.coalesce(F.col("n_active"), F.lit(0)) > 1, "multiple_active")
        .when(F.col("m_decision") == UNDECIDED, "publication_decision")
        .when(F.col("row_type") == "unmatched", "needs_decision")
        .when(~has_version(), "missing_final")
        .otherwise("")
    )


BADGES = ("dup_title", "dup_pdf", "dup_source", "dup_filename")


def with_statuses(rows: DataFrame, s: Settings) -> DataFrame:
    """Add every status, comparison and helper column to the combined rows."""
    badge = F.lit(False)
    for name in BADGES:
        badge = badge | F.coalesce(name, F.lit(False))
    plag = exceptions.exception_status("plagiarism_percent", s)
    single = exceptions.exception_status("single_percent", s)
    open_states = ("not_allowed", "stale")
    return with_measures(rows).withColumns(
        {
            "blocker": primary_blocker(),
            "page": page_status(s),
            "page_exception": exceptions.exception_status("page", s),
            "identity": identity_status(),
            "score": score_status(),
            "source": source_status(),
            "extraction": extraction_status(),
            "names": name_status(s),
            "n_names": F.when(has_version() & filled("extracted_authors"), F.col("x_count")),
            "name_exception": exceptions.exception_status("author_number", s),
            "over_name_limit": has_version() & filled("extracted_authors") & (F.col("x_count") > s.record_name_limit),
            "repeats_open": has_version() & F.coalesce(rules.unresolved_repeats(), F.lit(False)),
            "similarity_level": score_level("similarity", s.similarity_limit),
            "single_level": score_level("single", s.single_limit),
            "over_threshold": has_version() & (plag.isin(*open_states) | single.isin(*open_states)),
            "master_pair": title_pair("m_title", "x_master"),
            "claimed_pair": title_pair("title", "x_title"),
            "comparison": title_comparison(),
            "has_duplicate": badge,
            "has_pdf": has_version() & (files.persisted_file_state("pdf") != "missing"),
            "verified": has_version() & F.coalesce(rules.effectively_verified(), F.lit(False)),
            "titles_match": has_version() & F.coalesce(rules.titles_match_master(), F.lit(False)),
            "to_process": has_version()
            & (F.col("row_type") == "master")
            & F.coalesce(files.persisted_needs_processing(), F.lit(False)),
        }
    )


def predicates() -> dict[str, Column]:
    """The worklist filters and their parts, over ``with_statuses``."""
    free = (F.col("blocker") == "") & has_version()

    def level(name, *levels):
        return F.col(f"{name}.level").isin(*levels)

    no_score = F.col("similarity").isNull() | F.col("single").isNull()
    review_done = (
        filled("extracted_title")
        & filled("title")
        & (F.col("title_verified") | (F.col("review_status") == "review_ok"))
    )
    hard = (F.col("master_pair") == "hard") | (F.col("claimed_pair") == "hard")
    soft_pair = (F.col("master_pair") == "soft") | (F.col("claimed_pair") == "soft")
    verified_differs = F.col("id_verified") & (F.col("identity.label") == "Verified, title differs")
    page = free & F.col("has_pdf") & level("page", "danger", "warning")
    pdf = free & (
        ~F.col("has_pdf") | F.col("to_process") | F.col("page.key").isin("pdf_error", "needs_processing")
    )
    source = free & level("source", "danger")
    extraction = free & level("extraction", "danger", "warning")
    missing_score = free & no_score
    other_score = free & (F.col("over_threshold") | F.col("report_stale"))
    formatting = free & (F.col("format_status") != "review_ok")
    missing_title = free & (~filled("m_title") | ~filled("title") | ~filled("extracted_title"))
    unverified_title = free & filled("title") & filled("extracted_title") & ~review_done
    hard_title = free & (verified_differs | (review_done & hard))
    soft_title = free & soft_pair
    title = missing_title | unverified_title | hard_title | soft_title
    over_names = F.col("over_name_limit") & (F.col("name_exception") != "allowed")
    people = free & (over_names | F.col("repeats_open"))
    conflict = has_version() & F.coalesce("origin_conflict", F.lit(False))
    identity = level("identity", "danger", "warning")
    blocked = F.col("blocker") != ""
    issues = (
        F.col("has_duplicate") | conflict | identity | pdf | page | title | people | source | extraction
        | missing_score | other_score | formatting
    )
    out = {
        "all": F.lit(True),
        "needs_attention": blocked | issues,
        "missing_final": F.col("blocker") == "missing_final",
        "paper_id_review": has_version() & ((F.col("blocker") == "needs_decision") | (~blocked & identity)),
        "version_conflicts": conflict | (F.coalesce(F.col("n_active"), F.lit(0)) > 1),
        "title_issues": title,
        "verified_title_differences": has_version() & F.col("verified") & ~F.col("titles_match"),
        "no_authors": free & F.col("n_names").isNull(),
        "author_over_limit": over_names,
        "page_issues": page,
        "pdf_issues": pdf,
        "source_issues": source,
        "extraction_issues": extraction,
        "missing_plagiarism": missing_score,
        "plagiarism_issues": missing_score | other_score,
        "publication_duplicates": F.col("has_duplicate"),
        "format_not_ok": formatting,
        # parts used by sort and summary
        "score_problem": other_score,
        "missing_title": missing_title,
        "unverified_title": unverified_title,
        "hard_title": hard_title,
        "soft_title": soft_title,
        "name_issues": people,
        "conflict": conflict,
        "identity_danger": level("identity", "danger"),
    }
    return {name: F.coalesce(test, F.lit(False)) for name, test in out.items()}


FILTERS = (
    "all", "needs_attention", "missing_final", "paper_id_review", "version_conflicts", "title_issues",
    "verified_title_differences", "no_authors", "author_over_limit", "page_issues", "pdf_issues",
    "source_issues", "extraction_issues", "missing_plagiarism", "plagiarism_issues",
    "publication_duplicates", "format_not_ok",
)


def attention_priority(p: dict[str, Column]) -> Column:
    """0 is most urgent, 99 needs nothing."""
    ranked = [
        (p["missing_final"], 0),
        ((F.col("blocker") != "") | p["identity_danger"], 1),
        (p["conflict"], 2),
        (~F.col("has_pdf"), 3),
        (F.col("has_duplicate"), 4),
        (p["pdf_issues"], 5),
        (p["page_issues"], 6),
        (p["source_issues"], 7),
        (p["missing_title"], 8),
        (p["unverified_title"], 9),
        (p["extraction_issues"], 10),
        (p["name_issues"], 11),
        (p["plagiarism_issues"], 12),
        (p["format_not_ok"], 13),
        (p["hard_title"], 14),
        (p["soft_title"], 15),
    ]
    out = F.when(ranked[0][0], ranked[0][1])
    for test, rank in ranked[1:]:
        out = out.when(test, rank)
    return out.otherwise(99)


def format_rank(column="format_status") -> Column:
    c = F.col(column)
    return F.when(c == "pending", 0).when(c == "needs_edit", 1).when(c == "review_ok", 2).otherwise(3)


def combined_order(sort: str) -> list[Column]:
    """Sort keys of the combined list; an unknown name is attention first."""
    key = F.col("record_id")
    return {
        "paper_id_asc": [key.asc()],
        "paper_id_desc": [key.desc()],
        "page_count_asc": [F.col("pages").asc_nulls_last(), key.asc()],
        "page_count_desc": [
            F.when(F.coalesce(F.col("pages"), F.lit(0)) == 0, -1).otherwise(F.col("pages")).desc(), key.desc()
        ],
        "author_count_desc": [F.coalesce(F.col("n_names"), F.lit(-1)).desc(), key.desc()],
        "similarity_desc": [F.coalesce(F.col("similarity"), F.lit(-1)).desc(), key.desc()],
        "format_status": [
            F.when(~has_version(), 0).otherwise(format_rank()).asc(), key.asc()
        ],
    }.get(sort, [F.col("priority").asc(), key.asc()])
