"""Readiness rules: one pass of row rules, joined frames for group rules.

A row rule is (category, condition, message, exception key) over the frame of master
rows with their current version. All of them become one ``array`` column that is
filtered and inlined, so 40 rules cost one scan. Group rules add their own frames.
``register`` is the extension point.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenlight import catalog
from greenlight.functions.scores import whole_percent_label as pct
from greenlight.functions.text import filled, strip
from greenlight.operators import duplicates, exceptions, files, names, scope, versions
from greenlight.operators.aggregates import side_by_side
from greenlight.operators.measures import repeated_label, with_measures
from greenlight.settings import Settings

FINDING = ("category", "record_id", "version_id", "message", "exception_key")


@dataclass(frozen=True)
class Rule:
    category: str
    when: Column
    message: Column
    exception_key: Column | None = None
    allowed: bool = False  # a permitted exception: informative, never blocking


RowRules = Callable[[Settings], list[Rule]]
_ROW_RULES: list[RowRules] = []


def register(make: RowRules) -> RowRules:
    """Add a function returning rules over the record frame."""
    _ROW_RULES.append(make)
    return make


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _or(value: str, default: str) -> Column:
    return F.when(filled(value), F.col(value)).otherwise(default)


# -- predicates shared with the worklists ------------------------------------


def titles_match_master() -> Column:
    return (F.col("x_title") != "") & (F.col("x_title") == F.col("x_master"))


def effectively_verified() -> Column:
    """Manually verified, or equal titles unless that was blocked; only for a publishing master."""
    return F.coalesce(F.col("m_decision") == "publishing", F.lit(False)) & (
        F.col("id_verified") | (~F.col("auto_verify_blocked") & titles_match_master())
    )


def missing_score() -> Column:
    return F.col("similarity").isNull() | F.col("single").isNull()


def unresolved_repeats() -> Column:
    return F.col("x_repeats") & (F.col("duplicate_review_status") != "review_ok")


# -- row rules ---------------------------------------------------------------


@register
def identity_rules(s: Settings) -> list[Rule]:
    return [
        Rule(
            "Unverified Paper ID",
            ~effectively_verified(),
            _or("verification_message", "Nobody has confirmed this Paper ID yet."),
        ),
        Rule(
            "Final Title / Paper Master Title Mismatch",
            ~titles_match_master() & ~F.col("id_verified"),
            _or("verification_message", "The submitted title and the master title differ."),
        ),
    ]


@register
def file_rules(s: Settings) -> list[Rule]:
    label = _say(F.col("version_id"), " / ", F.col("record_id"))
    pdf, source = files.file_state("pdf"), files.file_state("source")
    reviewed = F.col("format_status") == "review_ok"
    present = source.isin("corrected", "original")
    bound = filled("source_hash")
    return [
        Rule(
            "Missing Corrected PDF",
            pdf == "corrected_missing",
            F.lit("The corrected PDF chosen for release cannot be found. Put it back or choose another; the original is never used instead."),
        ),
        Rule("Missing PDF", pdf == "missing", _say("There is no PDF for ", label, ".")),
        Rule(
            "PDF Not Processed",
            files.needs_processing(),
            F.lit("Page count and hash of the PDF are not known yet; process it first."),
        ),
        Rule(
            "Corrected PDF Not Processed",
            (pdf == "corrected") & files.content_stale(),
            F.lit("Page count and hash are older than the corrected PDF; process it again."),
        ),
        Rule(
            "Missing Corrected Source",
            source == "corrected_missing",
            F.lit("The corrected source chosen for release cannot be found. Put it back or choose another; the original is never used instead."),
        ),
        Rule("Missing Source File", source == "missing", _say("There is no source for ", label, ".")),
        Rule(
            "Source Review Hash Missing",
            present & reviewed & ~bound,
            F.lit("The formatting review does not say which source it saw; repeat it on the present source."),
        ),
        Rule(
            "Source Changed After Review",
            present & reviewed & bound & (F.col("source_current_hash") != F.col("source_hash")),
            F.lit("The source is not the one that passed the formatting review; repeat the review on the present source."),
        ),
        Rule(
            "PDF Processing Error",
            F.col("processing_status") == "error",
            F.coalesce("processing_message", F.lit("")),
        ),
    ]


@register
def page_rules(s: Settings) -> list[Rule]:
    pages = F.col("pages")
    counted = pages.isNotNull() & (pages != 0)  # zero pages is "no pages" here
    valid, key = exceptions.waiver_valid("page"), exceptions.exception_key("page")
    above = _say(pages.cast("string"), " pages, over the limit of ", str(s.page_limit), ".")
    below = _say(pages.cast("string"), " pages, under the minimum of ", str(s.page_minimum), ".")
    reason = F.col("page_waiver_reason")
    over, under = counted & (pages > s.page_limit), counted & (pages < s.page_minimum)
    return [
        Rule("Page Limit Exceeded", over & ~valid, above, key),
        Rule("Below Page Minimum", under & ~valid, below, key),
        Rule("Allowed Page Exception", over & valid, _say(above, " Allowed: ", reason), key, True),
        Rule("Allowed Page Exception", under & valid, _say(below, " Allowed: ", reason), key, True),
    ]


@register
def extraction_rules(s: Settings) -> list[Rule]:
    n = F.col("x_count")
    valid, key = exceptions.waiver_valid("author_number"), exceptions.exception_key("author_number")
    over = n > s.record_name_limit
    text = _say(n.cast("string"), " authors, over the limit for one record of ", str(s.record_name_limit), ".")
    title, people = filled("extracted_title"), filled("extracted_authors")
    flagged = F.col("review_status") == "red_flag"
    return [
        Rule("Missing Extracted Title", ~title, F.lit("There is no extracted title.")),
        Rule("Missing Extracted Authors", ~people, F.lit("There are no extracted authors.")),
        Rule("Author Over Limit", over & ~valid, text, key),
        Rule(
            "Allowed Author Number Exception", over & valid,
            _say(text, " Allowed: ", F.col("name_waiver_reason")), key, True,
        ),
        Rule(
            "Duplicate Author In Paper",
            unresolved_repeats(),
            _say("Names that occur twice: ", repeated_label()),
        ),
        Rule(
            "Title/Author Red Flag",
            flagged,
            F.lit("A reviewer raised a red flag on the extracted title or authors; mend the file or extract again."),
        ),
        Rule(
            "Unverified Title/Author Extraction",
            ~flagged & title & people & (F.col("review_status") != "review_ok"),
            F.lit("Nobody has confirmed the extracted title and authors yet."),
        ),
        Rule(
            "Formatting Not Review OK",
            F.col("format_status") != "review_ok",
            _say("The formatting review says ", catalog.label("review", F.col("format_status")), "."),
        ),
    ]


@register
def score_rules(s: Settings) -> list[Rule]:
    rules = [
        Rule("Missing Plagiarism Result", missing_score(),
             F.lit("A similarity score is missing.")),
        Rule(
            "Stale Plagiarism Report",
            F.col("report_stale"),
            F.lit("The attached report belongs to earlier scores; attach the present one."),
        ),
    ]
    for kind, shown, column, limit in (
        ("plagiarism_percent", "Plagiarism %", "similarity", s.similarity_limit),
        ("single_percent", "Single %", "single", s.single_limit),
    ):
        status, key = exceptions.exception_status(kind, s), exceptions.exception_key(kind)
        prefix = exceptions.TYPES[kind][1]
        over = _say(pct(column), "%, above the threshold of ", f"{round(limit)}%.")
        changed = _say(
            f"Current {shown} is ", pct(column), "%, while the exception was granted for ",
            pct(f"{prefix}_value"), "%.",
        )
        rules += [
            Rule(f"{shown} Over Threshold", status == "not_allowed", over, key),
            Rule(f"Stale {shown} Exception", status == "stale", changed, key),
            Rule(
                f"Allowed {shown} Exception", status == "allowed",
                _say(over, " Allowed: ", F.col(f"{prefix}_reason")), key, True,
            ),
        ]
    return rules


def row_findings(records: DataFrame, s: Settings, include_allowed: bool = False) -> DataFrame:
    """Inline every row rule over ``scope.master_with_active``."""
    missing = F.when(
        F.col("version_id").isNull(),
        F.struct(
            F.lit("Missing Final Submission").alias("category"),
            F.lit("").alias("found_version"),
            F.lit("No active version belongs to this record.").alias("message"),
            F.lit("").alias("exception_key"),
        ),
    )
    options = [missing]
    for make in _ROW_RULES:
        for rule in make(s):
            if rule.allowed and not include_allowed:
                continue
            key = F.lit("") if rule.exception_key is None else rule.exception_key
            options.append(
                F.when(
                    F.col("version_id").isNotNull() & rule.when,
                    F.struct(
                        F.lit(rule.category).alias("category"),
                        F.col("version_id").alias("found_version"),
                        F.coalesce(rule.message, F.lit("")).alias("message"),
                        key.alias("exception_key"),
                    ),
                )
            )
    found = F.filter(F.array(*options), lambda f: f.isNotNull())
    return with_measures(records).select("record_id", F.inline(found)).select(
        "category", "record_id", F.col("found_version").alias("version_id"), "message", "exception_key"
    )


# -- group rules -------------------------------------------------------------


def _finding(df: DataFrame, category: str, message: Column, version=None, record=None, key=None) -> DataFrame:
    return df.select(
        F.lit(category).alias("category"),
        (F.col("record_id") if record is None else record).alias("record_id"),
        (F.lit("") if version is None else version).alias("version_id"),
        message.alias("message"),
        (F.lit("") if key is None else key).alias("exception_key"),
    )


def group_findings(m: DataFrame, v: DataFrame) -> DataFrame:
    """Rules about a record as a whole, all read off one ``versions.record_groups``."""
    groups = versions.record_groups(v, m)
    shown = F.when(F.col("decision") == scope.EXCLUDED, "Not Publishing").otherwise("Publishing")

    def n(name) -> Column:
        return F.col(name).cast("string")

    rules = [
        Rule(
            "Publication Decision Integrity Conflict",
            versions.n_mismatched() > 0,
            _say("Paper Master is ", shown, ", but Final Submission decision mirrors disagree for ",
                 versions.n_mismatched().cast("string"), " version(s). Resolve the publication decision "
                 "before any publication export."),
        ),
        Rule(
            "Publication Decision Required",
            F.col("decision") == scope.UNDECIDED,
            F.lit("Legacy publication decisions for this Paper ID were inconsistent. Open Not Publishing "
                  "and explicitly choose Publishing or Not Publishing."),
        ),
        Rule(
            "Mixed Not Publishing Decision",
            versions.is_mixed(),
            _say("Versions for this Paper ID disagree on the Not Publishing decision. Re-apply Mark Not "
                 "Publishing or Undo Not Publishing before export. Excluded: ", n("n_excluded"),
                 "; included: ", n("n_included"), "."),
        ),
        Rule(
            "Multiple Active Final Submissions",
            versions.is_multiple_active(),
            F.lit("More than one active final submission exists for this Paper ID. Recalculate active "
                  "versions before publication."),
        ),
        Rule(
            "Start2/Editor Version Conflict",
            versions.is_origin_conflict(),
            _say("Both Start2 and Editor-uploaded versions are undiscarded. Editor upload is currently "
                 "prioritized; discard one side before final export. Start2: ", n("n_author"),
                 "; Editor: ", n("n_editor"), "."),
        ),
    ]
    options = [
        F.when(rule.when, F.struct(F.lit(rule.category).alias("category"), rule.message.alias("message")))
        for rule in rules
    ]
    per_record = groups.select(
        "record_id", F.inline(F.filter(F.array(*options), lambda f: f.isNotNull()))
    ).select("category", "record_id", F.lit("").alias("version_id"), "message", F.lit("").alias("exception_key"))
    unmapped = _finding(
        scope.orphans(v, m),
        "Unclassified Final Not In Master",
        F.lit("Final submission is not in the Paper Master List. Correct the Paper ID or mark it as "
              "Not Publishing."),
        version=F.col("version_id"),
    )
    return per_record.unionByName(unmapped)


def name_findings(counts: DataFrame, include_allowed: bool = False) -> DataFrame:
    """One row per name over the limit; its records are in ``names.name_records``."""
    appears = _say(
        F.col("display_name"), " appears in ", F.col("n_records").cast("string"), " publication papers."
    )
    over = counts.filter("over_limit")
    blank, key = F.lit(""), F.col("exception_key")
    out = _finding(over.filter("NOT waiver_valid"), "Author Over Limit", appears, record=blank, key=key)
    if include_allowed:
        allowed = _say(appears, " Allowed: ", F.col("waiver_reason"))
        out = out.unionByName(
            _finding(over.filter("waiver_valid"), "Allowed Author Paper Count Exception", allowed,
                     record=blank, key=key)
        )
    return out


def tracking_findings(m: DataFrame, v: DataFrame) -> DataFrame:
    """Informative rows: overrides, replaced, discarded and excluded versions or records."""
    live = ~F.col("discarded")
    options = [
        F.when(
            live & (F.col("title_author_source") == "manual_override"),
            F.struct(
                F.lit("Manual Title/Author Override").alias("category"),
                _say("Extracted title/authors were manually overridden. Reason: ",
                     _or("override_reason", "No reason recorded.")).alias("message"),
            ),
        ),
        F.when(
            live & F.col("replaced"),
            F.struct(
                F.lit("Replaced Final Submission").alias("category"),
                F.lit("A newer mapped final submission exists for this Paper ID.").alias("message"),
            ),
        ),
        F.when(
            F.col("discarded"),
            F.struct(
                F.lit("Discarded Final Submission").alias("category"),
                F.trim(_say("This final submission version was discarded. ", strip("discard_notes"))).alias("message"),
            ),
        ),
    ]
    per_version = v.select(
        "record_id", "version_id", F.inline(F.filter(F.array(*options), lambda f: f.isNotNull()))
    ).select("category", "record_id", "version_id", "message", F.lit("").alias("exception_key"))
    reason = catalog.label("exclusion_reason", F.coalesce("exclusion_reason", F.lit("")))
    note = strip("exclusion_notes")
    excluded_masters = _finding(
        scope.scope_excluded(m),
        "Not Publishing Paper",
        F.trim(_say("Paper Master record marked not publishing (", reason, "). ", note)),
    )
    outside = v.filter("excluded").join(m.select("record_id"), "record_id", "left_anti")
    excluded_orphans = _finding(
        outside,
        "Not Publishing Final Submission",
        F.trim(_say("Marked not publishing (", reason, "). ", note)),
        version=F.col("version_id"),
    )
    return per_version.unionByName(excluded_masters).unionByName(excluded_orphans)


def readiness_findings(
    m: DataFrame, v: DataFrame, waivers: DataFrame, s: Settings,
    include_allowed: bool = False, strict: bool = False, counts: DataFrame | None = None,
) -> DataFrame:
    """Every blocking finding; with ``include_allowed`` the permitted exceptions too."""
    scoped = scope.in_scope(v, m)
    counts = names.name_counts(scoped, waivers, s) if counts is None else counts
    members = duplicates.member_keys(scoped, s, strict)
    return (
        group_findings(m, v)
        .unionByName(row_findings(scope.master_with_active(m, v), s, include_allowed))
        .unionByName(duplicates.duplicate_findings(members))
        .unionByName(name_findings(counts, include_allowed))
    )


def annotate(findings: DataFrame) -> DataFrame:
    """Add group, level, severity and their ranks; an unknown category is Other / medium."""
    table = F.broadcast(catalog.category_table(findings.sparkSession))  # fixed, under 50 rows
    joined = findings.join(table, "category", "left")
    default = {
        "group": F.lit("Other"),
        "group_rank": F.lit(list(catalog.GROUPS).index("Other")),
        "level": F.lit("secondary"),
        "severity": F.lit("medium"),
        "severity_rank": F.lit(1),
        "severity_label": F.lit("Medium"),
        "severity_level": F.lit("warning"),
    }
    return joined.withColumns({name: F.coalesce(name, value) for name, value in default.items()})


def error_findings(m, v, waivers, s: Settings, counts: DataFrame | None = None) -> DataFrame:
    """The whole report: blocking, allowed and informative rows, annotated."""
    return annotate(
        readiness_findings(m, v, waivers, s, include_allowed=True, counts=counts).unionByName(
            tracking_findings(m, v)
        )
    )


def finding_order() -> list[Column]:
    return [
        F.col("severity_rank").asc(), F.col("group_rank").asc(), F.lower("record_id").asc(),
        F.lower("version_id").asc(), F.col("category").asc(),
    ]


def readiness(findings: DataFrame, m: DataFrame) -> DataFrame:
    """One row: ready means no blocking finding and a non-empty master."""
    f = findings.agg(F.count(F.lit(1)).alias("n_findings"))
    n = m.agg(F.count(F.lit(1)).alias("n_masters"))
    return side_by_side(f, n).select(
        ((F.col("n_findings") == 0) & (F.col("n_masters") > 0)).alias("ready"),
        (F.col("n_findings") + F.when(F.col("n_masters") == 0, 1).otherwise(0)).alias("n_blocking"),
    )


def export_gate(findings: DataFrame, draft: bool = False) -> DataFrame:
    """Strict: any finding blocks. Draft: only the categories that could pick a wrong file."""
    blocks = F.col("category").isin(*catalog.DRAFT_UNSAFE) if draft else F.lit(True)
    return findings.agg(
        F.count_if(blocks).alias("n_blockers"),
        F.count(F.lit(1)).alias("n_findings"),
        (F.count_if(blocks) == 0).alias("allowed"),
    )


def batch_gate(m: DataFrame, v: DataFrame) -> DataFrame:
    """Why a batch may not go out: (reason, n_records), empty when it may."""
    publishing = F.col("decision") == scope.PUBLISHING
    reasons = {
        "integrity conflicts": versions.n_mismatched() > 0,
        "unresolved decisions": F.col("decision") == scope.UNDECIDED,
        "mixed decisions": versions.is_mixed(),
        "multiple active versions": publishing & (F.col("n_active") > 1),
    }
    counted = versions.record_groups(v, m).agg(
        *[F.count_if(test).alias(reason) for reason, test in reasons.items()]
    )
    return counted.unpivot([], list(reasons), "reason", "n_records").filter("n_records > 0")
