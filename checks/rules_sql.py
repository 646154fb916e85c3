"""SQL for the rules, the exception table, the dashboard and the combined list."""

from checks.base_sql import name_norm, norm, query, split_names
from checks.oracle import _MEMBERS, _MISMATCH, SQL

PUB = """
rec AS (SELECT m.record_id AS rid, m.title AS m_title, m.decision AS m_decision, c.* FROM master m
  LEFT JOIN current_v c USING (record_id) WHERE m.decision = 'publishing')
"""
NAMES_N = f"len({split_names('extracted_authors')})"
NORMS = (
    f"list_filter(list_transform({split_names('extracted_authors')}, lambda z: {name_norm('z')}), lambda z: z <> '')"
)
REPEATS = f"(len(list_distinct({NORMS})) < len({NORMS}))"
MATCH = f"({norm('title')} <> '' AND {norm('title')} = {norm('m_title')})"
VERIFIED = f"coalesce(m_decision = 'publishing' AND (id_verified OR (NOT auto_verify_blocked AND {MATCH})), false)"
PAGE_OK = "coalesce(page_waiver_approved AND trim(page_waiver_reason) <> '' AND page_waiver_value = pages, false)"
NAME_OK = f"coalesce(name_waiver_approved AND trim(name_waiver_reason) <> '' AND name_waiver_value = {NAMES_N}, false)"
SIM_OK = "coalesce(similarity_waiver_approved AND trim(similarity_waiver_reason) <> '' AND similarity_waiver_value = similarity, false)"
SGL_OK = "coalesce(single_waiver_approved AND trim(single_waiver_reason) <> '' AND single_waiver_value = single, false)"


def state(over, ok, approved):
    return f"CASE WHEN NOT coalesce({over}, false) THEN '' WHEN {ok} THEN 'allowed' WHEN {approved} THEN 'stale' ELSE 'not_allowed' END"


PAGE_ST = state("pages < 6 OR pages > 12", PAGE_OK, "page_waiver_approved")
NAME_ST = state(f"{NAMES_N} > 5", NAME_OK, "name_waiver_approved")
SIM_ST = state("similarity > 35", SIM_OK, "similarity_waiver_approved")
SGL_ST = state("single > 10", SGL_OK, "single_waiver_approved")
PDF = """CASE WHEN corrected_pdf <> '' THEN CASE WHEN pdf_current_hash IS NULL THEN 'corrected_missing' ELSE 'corrected' END
  WHEN pdf_current_hash IS NOT NULL THEN 'original' ELSE 'missing' END"""
SRC = PDF.replace("pdf", "source")
STALE = "(pdf_current_hash IS NOT NULL AND (processing_status <> 'processed' OR pdf_current_hash <> pdf_hash))"
NEEDS = f"""(pdf_current_hash IS NOT NULL AND (processing_status <> 'processed' OR pages IS NULL OR pdf_hash = ''
  OR thumbnail_folder = '' OR {STALE}))"""
REVIEW_LABEL = "CASE format_status WHEN 'pending' THEN 'Pending' WHEN 'needs_edit' THEN 'Needs edit' WHEN 'red_flag' THEN 'Red Flag' ELSE 'Review OK' END"
REPEAT_LABEL = f"""array_to_string(list_transform(list_filter(list_filter({NORMS}, lambda q, i: list_position({NORMS}, q) = i),
    lambda q: len(list_filter({NORMS}, lambda y: y = q)) > 1),
  lambda q: array_to_string(list_filter(list_filter({split_names('extracted_authors')}, lambda y: {name_norm('y')} = q),
      lambda y, i: list_position(list_filter({split_names('extracted_authors')}, lambda w: {name_norm('w')} = q), y) = i), ', ')
    || ' (' || len(list_filter({NORMS}, lambda y: y = q)) || ' times)'), '; ')"""

# category, condition, message, exception key
ROW_RULES = [
    ("Unverified Paper ID", f"NOT {VERIFIED}", "'Nobody has confirmed this Paper ID yet.'", "''"),
    ("Final Title / Paper Master Title Mismatch", f"NOT {MATCH} AND NOT id_verified",
     "'The submitted title and the master title differ.'", "''"),
    ("Missing Corrected PDF", f"{PDF} = 'corrected_missing'",
     "'The corrected PDF chosen for release cannot be found. Put it back or choose another; the original is never used instead.'", "''"),
    ("Missing PDF", f"{PDF} = 'missing'", "'There is no PDF for ' || version_id || ' / ' || rid || '.'", "''"),
    ("PDF Not Processed", NEEDS, "'Page count and hash of the PDF are not known yet; process it first.'", "''"),
    ("Corrected PDF Not Processed", f"{PDF} = 'corrected' AND {STALE}",
     "'Page count and hash are older than the corrected PDF; process it again.'", "''"),
    ("Missing Corrected Source", f"{SRC} = 'corrected_missing'",
     "'The corrected source chosen for release cannot be found. Put it back or choose another; the original is never used instead.'", "''"),
    ("Missing Source File", f"{SRC} = 'missing'", "'There is no source for ' || version_id || ' / ' || rid || '.'", "''"),
    ("Source Review Hash Missing", f"{SRC} IN ('corrected', 'original') AND format_status = 'review_ok' AND source_hash = ''",
     "'The formatting review does not say which source it saw; repeat it on the present source.'", "''"),
    ("Source Changed After Review",
     f"{SRC} IN ('corrected', 'original') AND format_status = 'review_ok' AND source_hash <> '' AND source_hash <> source_current_hash",
     "'The source is not the one that passed the formatting review; repeat the review on the present source.'", "''"),
    ("PDF Processing Error", "processing_status = 'error'", "processing_message", "''"),
    ("Page Limit Exceeded", f"pages > 12 AND NOT {PAGE_OK}", "pages || ' pages, over the limit of 12.'", "'page:' || version_id"),
    ("Below Page Minimum", f"pages <> 0 AND pages < 6 AND NOT {PAGE_OK}", "pages || ' pages, under the minimum of 6.'", "'page:' || version_id"),
    ("Allowed Page Exception", f"pages > 12 AND {PAGE_OK}",
     "pages || ' pages, over the limit of 12. Allowed: ' || page_waiver_reason", "'page:' || version_id"),
    ("Allowed Page Exception", f"pages <> 0 AND pages < 6 AND {PAGE_OK}",
     "pages || ' pages, under the minimum of 6. Allowed: ' || page_waiver_reason", "'page:' || version_id"),
    ("Missing Extracted Title", "extracted_title = ''", "'There is no extracted title.'", "''"),
    ("Missing Extracted Authors", "extracted_authors = ''", "'There are no extracted authors.'", "''"),
    ("Author Over Limit", f"{NAMES_N} > 5 AND NOT {NAME_OK}",
     f"{NAMES_N} || ' authors, over the limit for one record of 5.'", "'author_number:' || version_id"),
    ("Allowed Author Number Exception", f"{NAMES_N} > 5 AND {NAME_OK}",
     f"{NAMES_N} || ' authors, over the limit for one record of 5. Allowed: ' || name_waiver_reason", "'author_number:' || version_id"),
    ("Duplicate Author In Paper", f"{REPEATS} AND duplicate_review_status <> 'review_ok'",
     f"'Names that occur twice: ' || {REPEAT_LABEL}", "''"),
    ("Title/Author Red Flag", "review_status = 'red_flag'",
     "'A reviewer raised a red flag on the extracted title or authors; mend the file or extract again.'", "''"),
    ("Unverified Title/Author Extraction",
     "review_status NOT IN ('red_flag', 'review_ok') AND extracted_title <> '' AND extracted_authors <> ''",
     "'Nobody has confirmed the extracted title and authors yet.'", "''"),
    ("Formatting Not Review OK", "format_status <> 'review_ok'", f"'The formatting review says ' || {REVIEW_LABEL} || '.'", "''"),
    ("Missing Plagiarism Result", "similarity IS NULL OR single IS NULL", "'A similarity score is missing.'", "''"),
    ("Stale Plagiarism Report", "report_stale",
     "'The attached report belongs to earlier scores; attach the present one.'", "''"),
]
for shown, col, limit, st, pre, key in (
    ("Plagiarism %", "similarity", 35, SIM_ST, "similarity_waiver", "plagiarism_percent"),
    ("Single %", "single", 10, SGL_ST, "single_waiver", "single_percent"),
):
    ROW_RULES += [
        (f"{shown} Over Threshold", f"{st} = 'not_allowed'", f"{col} || '%, above the threshold of {limit}%.'", f"'{key}:' || version_id"),
        (f"Stale {shown} Exception", f"{st} = 'stale'",
         f"'Current {shown} is ' || {col} || '%, while the exception was granted for ' || {pre}_value || '%.'", f"'{key}:' || version_id"),
        (f"Allowed {shown} Exception", f"{st} = 'allowed'",
         f"{col} || '%, above the threshold of {limit}%. Allowed: ' || {pre}_reason", f"'{key}:' || version_id"),
    ]

_row = "\nUNION ALL ".join(
    f"SELECT '{c}' AS category, rid AS record_id, version_id, {msg} AS message, {key} AS exception_key FROM rec WHERE version_id IS NOT NULL AND ({cond})"
    for c, cond, msg, key in ROW_RULES
)
_others = "n_others || ' other publication record' || CASE WHEN n_others = 1 THEN '' ELSE 's' END"
FOUND = f"""
{PUB.strip()},
{_MEMBERS.strip()},
found AS (
{_row}
UNION ALL SELECT 'Missing Final Submission', rid, '', 'No active version belongs to this record.', '' FROM rec WHERE version_id IS NULL
UNION ALL SELECT 'Publication Decision Integrity Conflict', record_id, '', 'Paper Master is ' || CASE decision WHEN 'not_publishing' THEN 'Not Publishing' ELSE 'Publishing' END
  || ', but Final Submission decision mirrors disagree for ' || {_MISMATCH} || ' version(s). Resolve the publication decision before any publication export.', ''
  FROM record_groups WHERE {_MISMATCH} > 0
UNION ALL SELECT 'Publication Decision Required', record_id, '', 'Legacy publication decisions for this Paper ID were inconsistent. Open Not Publishing and explicitly choose Publishing or Not Publishing.', ''
  FROM master WHERE decision = 'decision_required'
UNION ALL SELECT 'Mixed Not Publishing Decision', record_id, '', 'Versions for this Paper ID disagree on the Not Publishing decision. Re-apply Mark Not Publishing or Undo Not Publishing before export. Excluded: '
  || n_excluded || '; included: ' || n_included || '.', '' FROM record_groups WHERE decision IS NULL AND n_excluded > 0 AND n_included > 0
UNION ALL SELECT 'Multiple Active Final Submissions', record_id, '', 'More than one active final submission exists for this Paper ID. Recalculate active versions before publication.', ''
  FROM record_groups WHERE decision IS NOT NULL AND n_active > 1
UNION ALL SELECT 'Start2/Editor Version Conflict', record_id, '', 'Both Start2 and Editor-uploaded versions are undiscarded. Editor upload is currently prioritized; discard one side before final export. Start2: '
  || n_author || '; Editor: ' || n_editor || '.', '' FROM record_groups WHERE decision = 'publishing' AND n_author > 0 AND n_editor > 0
UNION ALL SELECT 'Unclassified Final Not In Master', record_id, version_id, 'Final submission is not in the Paper Master List. Correct the Paper ID or mark it as Not Publishing.', ''
  FROM publishable WHERE m_decision IS NULL
UNION ALL SELECT CASE kind WHEN 'title' THEN 'Duplicate Publication Title' WHEN 'pdf' THEN 'Duplicate Publication PDF' WHEN 'source' THEN 'Duplicate Publication Source'
    ELSE 'Duplicate Publication Filename' END, record_id, version_id,
  CASE kind WHEN 'filename' THEN 'Publication filename "' || group_name || '" conflicts with ' || {_others} || ' after Paper ID/title sanitization.'
    ELSE CASE kind WHEN 'title' THEN 'Duplicate title' WHEN 'pdf' THEN 'Duplicate PDF' ELSE 'Duplicate source' END || ' with ' || {_others} || '. Key: ' || substr(key, 1, 12) || '.' END, ''
  FROM dups
UNION ALL SELECT CASE WHEN waiver_valid THEN 'Allowed Author Paper Count Exception' ELSE 'Author Over Limit' END, '', '',
  display_name || ' appears in ' || n_records || ' publication papers.' || CASE WHEN waiver_valid THEN ' Allowed: ' || waiver_reason ELSE '' END, exception_key
  FROM counts WHERE over_limit),
blocking AS (SELECT * FROM found WHERE category NOT LIKE 'Allowed%')
"""
_REASON = "CASE exclusion_reason WHEN 'unpaid' THEN 'Unpaid' WHEN 'withdrawn' THEN 'Withdrawn' WHEN '' THEN 'Not excluded' ELSE exclusion_reason END"
TRACK = f"""
tracked AS (
SELECT 'Manual Title/Author Override' AS category, record_id, version_id, 'Extracted title/authors were manually overridden. Reason: '
  || CASE WHEN override_reason = '' THEN 'No reason recorded.' ELSE override_reason END AS message, '' AS exception_key
  FROM versions WHERE NOT discarded AND title_author_source = 'manual_override'
UNION ALL SELECT 'Replaced Final Submission', record_id, version_id, 'A newer mapped final submission exists for this Paper ID.', '' FROM versions WHERE replaced AND NOT discarded
UNION ALL SELECT 'Discarded Final Submission', record_id, version_id, trim('This final submission version was discarded. ' || trim(discard_notes)), '' FROM versions WHERE discarded
UNION ALL SELECT 'Not Publishing Paper', record_id, '', trim('Paper Master record marked not publishing (' || {_REASON} || '). ' || exclusion_notes), '' FROM master WHERE decision = 'not_publishing'
UNION ALL SELECT 'Not Publishing Final Submission', record_id, version_id, trim('Marked not publishing (' || {_REASON} || '). ' || exclusion_notes), '' FROM versions
  WHERE excluded AND record_id NOT IN (SELECT record_id FROM master)),
report AS (SELECT * FROM found UNION ALL SELECT * FROM tracked)
"""
_GROUP = """CASE
  WHEN category IN ('Unclassified Final Not In Master', 'Unverified Paper ID', 'Final Title / Paper Master Title Mismatch', 'Missing Final Submission',
    'Publication Decision Required', 'Publication Decision Integrity Conflict', 'Replaced Final Submission', 'Multiple Active Final Submissions',
    'Mixed Not Publishing Decision', 'Start2/Editor Version Conflict') THEN 'Paper ID / Mapping'
  WHEN category LIKE 'Missing%PDF' OR category LIKE 'Missing%Source%' OR category LIKE '%PDF Not Processed' OR category LIKE 'Source %' OR category LIKE '%Page %'
    OR category = 'PDF Processing Error' THEN 'Files / PDF Processing'
  WHEN category LIKE '%Author%' OR category = 'Missing Extracted Title' THEN 'Title / Author'
  WHEN category = 'Formatting Not Review OK' THEN 'Formatting'
  WHEN category LIKE '%Plagiarism%' OR category LIKE '%Single%' THEN 'Plagiarism'
  WHEN category LIKE 'Duplicate Publication%' THEN 'Publication Duplicates'
  WHEN category LIKE 'Discarded%' OR category LIKE 'Not Publishing%' THEN 'Version Tracking' ELSE 'Other' END"""
_SEV = """CASE WHEN category LIKE 'Allowed%' OR category IN ('Manual Title/Author Override', 'Replaced Final Submission', 'Discarded Final Submission',
    'Not Publishing Final Submission', 'Not Publishing Paper') THEN 'info'
  WHEN category IN ('Final Title / Paper Master Title Mismatch', 'Missing Extracted Title', 'Missing Extracted Authors', 'Title/Author Red Flag',
    'Unverified Title/Author Extraction', 'Formatting Not Review OK', 'Missing Plagiarism Result', 'Stale Plagiarism Report') THEN 'medium' ELSE 'critical' END"""
_BASE = ["current", "counts", "groups"]
SQL["findings"] = query(
    _BASE,
    f"""SELECT category, record_id, version_id, message, exception_key, {_GROUP} AS finding_group, {_SEV} AS severity,
    CASE {_GROUP} WHEN 'Paper ID / Mapping' THEN 'danger' WHEN 'Publication Duplicates' THEN 'danger' WHEN 'Version Tracking' THEN 'info'
      WHEN 'Other' THEN 'secondary' ELSE 'warning' END AS level FROM report""",
    FOUND.strip() + ",\n" + TRACK.strip(),
)
SQL["severity_sections"] = query(
    _BASE,
    f"""SELECT severity, '' AS finding_group, count(category) AS n FROM (VALUES ('critical'), ('medium'), ('info')) s(severity)
      LEFT JOIN (SELECT category, {_SEV} AS severity FROM found) USING (severity) GROUP BY severity
    UNION ALL SELECT {_SEV}, {_GROUP}, count(*) FROM found GROUP BY 1, 2""",
    FOUND,
)
_FILES = f"{_GROUP} = 'Files / PDF Processing'"
SQL["category_options"] = query(
    _BASE,
    f"""SELECT category, {_GROUP} AS finding_group, {_SEV} AS severity, n, category IN ('Missing PDF', 'Page Limit Exceeded') AS selected FROM (
      SELECT category, CAST(sum(n) AS BIGINT) AS n FROM (SELECT category, 1 AS n FROM found WHERE {_FILES} UNION ALL VALUES ('Missing PDF', 0), ('Page Limit Exceeded', 0)) GROUP BY category)""",
    FOUND,
)
_AFF = """
affected AS (
  SELECT category, CASE WHEN record_id <> '' THEN record_id ELSE 'Final ' || version_id END AS id FROM blocking WHERE record_id <> '' OR version_id <> ''
  UNION ALL SELECT category, r.record_id FROM blocking b JOIN name_recs r ON b.exception_key = 'author_limit:' || r.norm WHERE b.record_id = '' AND b.version_id = '')
"""
SQL["affected_records"] = query(_BASE, "SELECT count(DISTINCT id) AS n_affected FROM affected", FOUND.strip() + ",\n" + _AFF.strip())
_PARTS = [
    ("mapping", "missing final", ["Missing Final Submission"]),
    ("mapping", "publication decision", ["Unclassified Final Not In Master", "Publication Decision Required", "Publication Decision Integrity Conflict", "Mixed Not Publishing Decision"]),
    ("mapping", "Paper ID review", ["Invalid Paper ID", "Unverified Paper ID", "Final Title / Paper Master Title Mismatch"]),
    ("mapping", "version conflict", ["Multiple Active Final Submissions", "Start2/Editor Version Conflict"]),
    ("files", "paper with a missing file", ["Missing PDF", "Missing Corrected PDF", "Missing Source File", "Missing Corrected Source"]),
    ("files", "paper needing PDF processing", ["PDF Not Processed", "Corrected PDF Not Processed", "PDF Processing Error"]),
    ("files", "source review integrity issue", ["Source Review Hash Missing", "Source Changed After Review"]),
    ("files", "paper with a page issue", ["Page Limit Exceeded", "Below Page Minimum"]),
    ("title_authors", "paper missing extraction", ["Missing Extracted Title", "Missing Extracted Authors"]),
    ("title_authors", "pending metadata review", ["Unverified Title/Author Extraction"]),
    ("title_authors", "Red Flag", ["Title/Author Red Flag"]),
    ("formatting", "", ["Formatting Not Review OK"]),
    ("plagiarism", "paper missing P/S results", ["Missing Plagiarism Result"]),
    ("plagiarism", "paper over a threshold", ["Plagiarism % Over Threshold", "Single % Over Threshold"]),
    ("plagiarism", "stale report", ["Stale Plagiarism Report"]),
    ("plagiarism", "stale exception", ["Stale Plagiarism % Exception", "Stale Single % Exception"]),
    ("authors", "paper affected by an author limit", ["Author Over Limit"]),
    ("authors", "duplicate-author review", ["Duplicate Author In Paper"]),
    ("duplicates", "paper with a duplicate title", ["Duplicate Publication Title"]),
    ("duplicates", "paper with duplicate file content", ["Duplicate Publication PDF", "Duplicate Publication Source"]),
    ("duplicates", "paper with a filename collision", ["Duplicate Publication Filename"]),
]
_values = ", ".join(f"('{w}', '{p}', '{c}')" for w, p, cs in _PARTS for c in cs)
SQL["action_groups"] = query(
    _BASE,
    """SELECT workflow, part, n_affected, CASE WHEN n_affected > 0 THEN 'open' ELSE 'completed' END AS status FROM (
      SELECT workflow, '' AS part, count(DISTINCT id) AS n_affected FROM parts LEFT JOIN affected USING (category) GROUP BY workflow
      UNION ALL SELECT workflow, part, count(DISTINCT id) FROM parts JOIN affected USING (category) WHERE part <> '' GROUP BY workflow, part)""",
    FOUND.strip() + ",\n" + _AFF.strip() + f",\nparts(workflow, part, category) AS (VALUES {_values})",
)
SQL["top_categories"] = query(_BASE, "SELECT category, count(*) AS n FROM blocking GROUP BY category ORDER BY n DESC, category LIMIT 5", FOUND)
SQL["readiness"] = query(_BASE, "SELECT count(*) = 0 AS ready, count(*) AS n_blocking FROM blocking", FOUND)
SQL["export_gate"] = query(
    _BASE,
    """SELECT 'strict' AS mode, count(*) AS n_blockers, count(*) AS n_findings, count(*) = 0 AS allowed FROM blocking
    UNION ALL SELECT 'draft', count(*) FILTER (x), count(*), count(*) FILTER (x) = 0 FROM (SELECT category IN ('Multiple Active Final Submissions',
      'Mixed Not Publishing Decision', 'Publication Decision Required', 'Publication Decision Integrity Conflict', 'Duplicate Publication Filename') AS x FROM blocking)""",
    FOUND,
)
SQL["batch_gate"] = query(
    ["groups"],
    f"""SELECT * FROM (SELECT 'integrity conflicts' AS reason, count(*) FILTER ({_MISMATCH} > 0) AS n_records FROM record_groups
    UNION ALL SELECT 'unresolved decisions', count(*) FILTER (decision = 'decision_required') FROM record_groups
    UNION ALL SELECT 'mixed decisions', count(*) FILTER (decision IS NULL AND n_excluded > 0 AND n_included > 0) FROM record_groups
    UNION ALL SELECT 'multiple active versions', count(*) FILTER (decision = 'publishing' AND n_active > 1) FROM record_groups) WHERE n_records > 0""",
)
EXC = f"""
exc AS (
SELECT record_id, version_id, record_id AS subject, 'page:' || version_id AS exception_key, 'page' AS type, 'Page count' AS type_label, {PAGE_ST} AS status,
  CAST(pages AS DOUBLE) AS current_value, '6-12 pages' AS limit_label, CAST(page_waiver_value AS DOUBLE) AS approved_value, page_waiver_reason AS reason FROM publishable WHERE {PAGE_ST} <> ''
UNION ALL SELECT record_id, version_id, record_id, 'author_number:' || version_id, 'author_number', 'Authors in paper', {NAME_ST}, CAST({NAMES_N} AS DOUBLE), 'Max 5 authors',
  CAST(name_waiver_value AS DOUBLE), name_waiver_reason FROM publishable WHERE {NAME_ST} <> ''
UNION ALL SELECT record_id, version_id, record_id, 'plagiarism_percent:' || version_id, 'plagiarism_percent', 'Plagiarism %', {SIM_ST}, CAST(similarity AS DOUBLE), 'Max 35%',
  CAST(similarity_waiver_value AS DOUBLE), similarity_waiver_reason FROM publishable WHERE {SIM_ST} <> ''
UNION ALL SELECT record_id, version_id, record_id, 'single_percent:' || version_id, 'single_percent', 'Single %', {SGL_ST}, CAST(single AS DOUBLE), 'Max 10%',
  CAST(single_waiver_value AS DOUBLE), single_waiver_reason FROM publishable WHERE {SGL_ST} <> ''
UNION ALL SELECT '', '', display_name, exception_key, 'author_limit', 'Author paper count',
  CASE WHEN waiver_valid THEN 'allowed' WHEN coalesce(waiver_approved, false) THEN 'stale' ELSE 'not_allowed' END, CAST(n_records AS DOUBLE), 'Max 3 papers',
  CAST(waiver_count AS DOUBLE), coalesce(waiver_reason, '') FROM counts WHERE over_limit)
"""
SQL["exception_rows"] = query(["counts"], "SELECT * FROM exc", EXC)
SQL["exception_counts"] = query(
    ["counts"],
    """SELECT count(*) FILTER (status = 'not_allowed') AS not_allowed, count(*) FILTER (status = 'allowed') AS allowed,
    count(*) FILTER (status = 'stale') AS stale, count(*) AS n_all FROM exc""",
    EXC,
)
SQL["exception_actions"] = query(
    ["counts"],
    """SELECT exception_key, action, message = '' AS accepted, message, message = '' AND grants AS waiver_approved,
      CASE WHEN message = '' AND grants THEN trim(reason, ' \n') ELSE '' END AS waiver_reason, CASE WHEN message = '' AND grants THEN current_value END AS waiver_value
    FROM (SELECT *, CASE
        WHEN NOT ((action = 'approve' AND status = 'not_allowed') OR (action = 'reapprove' AND status = 'stale') OR (action = 'remove' AND status IN ('allowed', 'stale')))
          THEN 'Not possible for status ' || status || '.'
        WHEN grants AND reason = '' THEN 'A reason is required.' ELSE '' END AS message
      FROM (SELECT * EXCLUDE (reason), CASE type WHEN 'page' THEN 'approve' WHEN 'single_percent' THEN 'remove' ELSE 'reapprove' END AS action,
        type <> 'single_percent' AS grants, CASE WHEN current_value > 14 THEN 'checked' ELSE '' END AS reason FROM exc))""",
    EXC,
)
_P = f"""
pv AS (SELECT p.*, m.title AS m_title FROM publishable p LEFT JOIN master m USING (record_id)),
t AS (SELECT *, coalesce({MATCH}, false) AS mt, {VERIFIED} AS vf, {SIM_ST} AS ps, {SGL_ST} AS ss, {PAGE_OK} AS pok, {NEEDS} AS np, {REPEATS} AS rp, {NAMES_N} AS nn,
  {NAME_OK} AS nok FROM pv)
"""
_ALERTS = "(SELECT count(*) FROM record_groups WHERE decision = 'publishing' AND n_author > 0 AND n_editor > 0)"
SQL["dashboard_counts"] = query(
    ["counts", "groups"],
    f"""SELECT (SELECT count(*) FROM master) AS total_records, (SELECT count(*) FROM master WHERE decision = 'publishing') AS scope_records,
    (SELECT count(*) FROM master WHERE decision = 'not_publishing') AS excluded_records, (SELECT count(*) FROM master WHERE decision = 'decision_required') AS undecided_records,
    (SELECT count(*) FROM record_groups WHERE {_MISMATCH} > 0) AS integrity_conflicts, {_ALERTS} AS origin_conflicts,
    (SELECT count(*) FROM master WHERE decision = 'publishing' AND record_id NOT IN (SELECT record_id FROM av)) AS missing_versions,
    (SELECT count(*) FROM versions) AS total_versions, (SELECT count(*) FROM versions WHERE replaced AND NOT discarded) AS replaced_versions,
    (SELECT count(*) FROM counts WHERE over_limit AND NOT waiver_valid) AS names_over_limit,
    count(*) AS active_versions, count(m_decision) AS candidates, count(*) FILTER (NOT vf) AS unverified_ids,
    count(*) FILTER (m_decision IS NOT NULL AND NOT mt AND NOT vf) AS title_mismatches, count(*) FILTER (m_decision IS NOT NULL AND NOT mt AND vf) AS verified_title_differences,
    count(*) FILTER (review_status = 'review_ok' AND extracted_title <> '' AND title <> '' AND {norm('extracted_title')} <> {norm('title')}) AS reviewed_title_differences,
    count(*) FILTER (m_decision IS NULL) AS not_in_master, count(*) FILTER (pages > 12 AND NOT pok) AS page_limit_errors,
    count(*) FILTER (pages <> 0 AND pages < 6 AND NOT pok) AS page_minimum_errors, count(*) FILTER (pdf_current_hash IS NULL) AS missing_pdfs,
    count(*) FILTER (extracted_title = '' OR extracted_authors = '') AS missing_extraction, count(*) FILTER (review_status = 'pending') AS title_author_pending,
    count(*) FILTER (review_status = 'red_flag') AS title_author_red_flag, count(*) FILTER (review_status = 'review_ok') AS title_author_review_ok,
    count(*) FILTER (extracted_title <> '' AND extracted_authors <> '' AND review_status <> 'review_ok') AS unverified_extraction,
    count(*) FILTER (extracted_title = '' OR extracted_authors = '' OR review_status <> 'review_ok') AS title_author_attention,
    count(*) FILTER (nn > 5 AND NOT nok) AS over_name_limit, count(*) FILTER (rp AND duplicate_review_status <> 'review_ok') AS duplicate_name_records,
    count(*) FILTER (similarity IS NULL OR single IS NULL) AS missing_scores, count(*) FILTER (ps IN ('not_allowed', 'stale')) AS similarity_over,
    count(*) FILTER (ss IN ('not_allowed', 'stale')) AS single_over, count(*) FILTER (ps IN ('not_allowed', 'stale') OR ss IN ('not_allowed', 'stale')) AS score_issue_records,
    count(*) FILTER (ps = 'allowed' OR ss = 'allowed') AS allowed_score_records, count(*) FILTER (ps = 'stale' OR ss = 'stale') AS stale_score_exceptions,
    count(*) FILTER (format_status = 'pending') AS format_pending, count(*) FILTER (format_status = 'needs_edit') AS format_needs_edit,
    count(*) FILTER (format_status <> 'review_ok') AS format_not_ok, count(*) FILTER (m_decision = 'publishing' AND np) AS to_process,
    count(*) FILTER (ps = 'allowed') + count(*) FILTER (ss = 'allowed') AS allowed_score_approvals FROM t""",
    _P,
)
SQL["workflow_alerts"] = query(
    ["scope", "groups"],
    f"SELECT (SELECT count(*) FROM scoped WHERE {NEEDS}) AS to_process, {_ALERTS} AS origin_conflicts",
)

# -- combined list
_HASPDF = "(corrected_pdf <> '' OR pdf_file <> '')"
COMBINED = f"""
{_MEMBERS.strip()},
base AS (
  SELECT 'master' AS row_type, m.record_id AS rid, m.title AS m_title, m.decision AS md, m.accept_status AS m_as, m.authors AS m_au, m.notes AS m_no,
    g.n_active, (g.decision = 'publishing' AND g.n_author > 0 AND g.n_editor > 0) AS oc, s.*
  FROM master m LEFT JOIN record_groups g USING (record_id) LEFT JOIN scoped s ON s.record_id = m.record_id AND g.n_active = 1
  WHERE m.decision <> 'not_publishing'
  UNION ALL SELECT 'unmatched', record_id, NULL, NULL, NULL, NULL, NULL, 0, false, p.* FROM publishable p WHERE m_decision IS NULL),
b1 AS (SELECT * EXCLUDE (m_decision), md AS m_decision, version_id IS NOT NULL AS hv, version_id IN (SELECT version_id FROM dups) AS dup FROM base),
b2 AS (SELECT *,
  CASE WHEN n_active > 1 THEN 'multiple_active' WHEN m_decision = 'decision_required' THEN 'publication_decision' WHEN row_type = 'unmatched' THEN 'needs_decision'
    WHEN NOT hv THEN 'missing_final' ELSE '' END AS blocker,
  hv AND {_HASPDF} AS has_pdf, {PAGE_ST} AS page_st, {NAME_ST} AS name_st, {SIM_ST} AS ps, {SGL_ST} AS ss,
  hv AND coalesce({MATCH}, false) AS mt, hv AND {VERIFIED} AS vf,
  CASE WHEN hv AND extracted_authors <> '' THEN {NAMES_N} END AS n_names, hv AND coalesce({REPEATS} AND duplicate_review_status <> 'review_ok', false) AS rep_open,
  hv AND row_type = 'master' AND {_HASPDF} AND (processing_status <> 'processed' OR pages IS NULL OR pdf_hash = '' OR thumbnail_status <> 'processed' OR thumbnail_folder = '') AS to_process,
  CASE WHEN coalesce(m_title, '') = '' OR coalesce(extracted_title, '') = '' THEN 'missing' WHEN trim(m_title) = trim(extracted_title) THEN 'identical'
    WHEN {norm('m_title')} = {norm('extracted_title')} THEN 'soft' ELSE 'hard' END AS mp,
  CASE WHEN coalesce(title, '') = '' OR coalesce(extracted_title, '') = '' THEN 'missing' WHEN trim(title) = trim(extracted_title) THEN 'identical'
    WHEN {norm('title')} = {norm('extracted_title')} THEN 'soft' ELSE 'hard' END AS cp,
  concat_ws(', ', CASE WHEN coalesce(trim(m_title), '') = '' THEN 'Master' END, CASE WHEN coalesce(trim(title), '') = '' THEN 'Final' END,
    CASE WHEN coalesce(trim(extracted_title), '') = '' THEN 'Extracted' END) AS miss FROM b1),
b3 AS (SELECT *,
  CASE WHEN NOT hv THEN 'No final' WHEN NOT has_pdf THEN 'Requires PDF' WHEN processing_status = 'error' THEN 'PDF error' WHEN pages IS NULL THEN 'Needs processing'
    WHEN pages < 6 THEN 'Below min 6' WHEN pages > 12 THEN 'Over limit 12' ELSE 'Page OK' END AS page_label,
  CASE WHEN NOT hv THEN 'danger' WHEN NOT has_pdf THEN 'secondary' WHEN processing_status = 'error' THEN 'danger' WHEN pages IS NULL THEN 'warning'
    WHEN pages < 6 THEN CASE page_st WHEN 'allowed' THEN 'info' ELSE 'warning' END
    WHEN pages > 12 THEN CASE page_st WHEN 'allowed' THEN 'info' WHEN 'stale' THEN 'warning' ELSE 'danger' END ELSE 'secondary' END AS page_level,
  CASE WHEN n_active > 1 THEN 'Multiple active finals' WHEN NOT hv THEN 'No final' WHEN m_decision = 'decision_required' THEN 'Decision required' WHEN m_decision IS NULL AND excluded THEN 'Excluded from publication'
    WHEN m_decision IS NULL THEN 'Needs decision' WHEN id_verified AND NOT mt THEN 'Verified, title differs' WHEN vf AND id_verified THEN 'Verified'
    WHEN vf THEN 'Auto-verified by title' WHEN verification_status = 'title_mismatch' THEN 'Paper ID title mismatch' ELSE 'Paper ID needs review' END AS identity_label,
  CASE WHEN NOT hv THEN '' WHEN corrected_source = '' AND source_file = '' THEN 'No source' WHEN format_status = 'review_ok' AND source_hash = '' THEN 'Review hash missing'
    WHEN corrected_source <> '' THEN 'Corrected' ELSE 'Original' END AS source_label,
  CASE WHEN NOT hv THEN '' WHEN review_status = 'red_flag' THEN 'Red Flag' WHEN extracted_title <> '' AND extracted_authors <> ''
      THEN CASE review_status WHEN 'review_ok' THEN 'Review OK' ELSE 'Pending' END
    WHEN extracted_title = '' AND extracted_authors = '' THEN 'No extracted title/authors' WHEN extracted_title = '' THEN 'No extracted title' ELSE 'No extracted authors' END AS extraction_label,
  CASE WHEN NOT hv THEN '--' WHEN extracted_authors = '' THEN 'Awaiting extraction' ELSE n_names || ' author' || CASE WHEN n_names = 1 THEN '' ELSE 's' END END AS names_label,
  CASE WHEN hv AND (similarity IS NULL OR single IS NULL) THEN 'No result' ELSE '' END AS score_label,
  CASE WHEN miss <> '' THEN 'Missing ' || miss WHEN trim(m_title) = trim(title) AND trim(title) = trim(extracted_title) THEN 'All titles match'
    WHEN {norm('m_title')} <> '' AND {norm('m_title')} = {norm('title')} AND {norm('title')} = {norm('extracted_title')} THEN 'Formatting-only difference'
    WHEN {norm('m_title')} = {norm('extracted_title')} AND {norm('title')} = {norm('extracted_title')} THEN 'Master and Final titles differ'
    ELSE concat_ws('; ', CASE WHEN {norm('m_title')} <> {norm('extracted_title')} THEN 'Master title differs' END,
      CASE WHEN {norm('title')} <> {norm('extracted_title')} THEN 'Final title differs' END) END AS comparison FROM b2),
b4 AS (SELECT *,
  CASE WHEN identity_label IN ('No final', 'Excluded from publication') THEN 'secondary' WHEN identity_label IN ('Multiple active finals', 'Decision required', 'Needs decision', 'Paper ID needs review') THEN 'danger'
    WHEN identity_label IN ('Verified, title differs', 'Paper ID title mismatch') THEN 'warning' ELSE 'success' END AS identity_level,
  CASE WHEN source_label = '' THEN 'secondary' WHEN source_label IN ('No source', 'Review hash missing') THEN 'danger'
    WHEN source_label = 'Corrected' AND format_status = 'review_ok' THEN 'success' ELSE 'secondary' END AS source_level,
  CASE WHEN extraction_label = '' THEN 'secondary' WHEN extraction_label = 'Review OK' THEN 'success' WHEN extraction_label = 'Pending' THEN 'warning' ELSE 'danger' END AS extraction_level,
  CASE WHEN names_label IN ('--', 'Awaiting extraction') THEN 'secondary' WHEN n_names > 5 AND name_st = 'allowed' THEN 'info' WHEN name_st = 'stale' THEN 'warning'
    WHEN n_names > 5 OR rep_open THEN 'danger' ELSE 'secondary' END AS names_level,
  CASE WHEN score_label = '' THEN 'secondary' ELSE 'danger' END AS score_level,
  CASE WHEN similarity IS NULL THEN 'secondary' WHEN similarity > 35 THEN 'danger' ELSE 'light' END AS similarity_level,
  blocker = '' AND hv AS free,
  coalesce(extracted_title <> '' AND title <> '' AND (title_verified OR review_status = 'review_ok'), false) AS done FROM b3),
b5 AS (SELECT *,
  free AND has_pdf AND page_level IN ('danger', 'warning') AS page_i, free AND (NOT has_pdf OR to_process OR page_label IN ('PDF error', 'Needs processing')) AS pdf_i,
  free AND source_level = 'danger' AS src_i, free AND extraction_level IN ('danger', 'warning') AS ext_i, free AND (similarity IS NULL OR single IS NULL) AS miss_s,
  free AND (ps IN ('not_allowed', 'stale') OR ss IN ('not_allowed', 'stale') OR report_stale) AS oth_s, free AND format_status <> 'review_ok' AS fmt_i,
  free AND (m_title = '' OR title = '' OR extracted_title = '') AS miss_t, free AND title <> '' AND extracted_title <> '' AND NOT done AS unv_t,
  free AND ((id_verified AND identity_label = 'Verified, title differs') OR (done AND (mp = 'hard' OR cp = 'hard'))) AS hard_t, free AND (mp = 'soft' OR cp = 'soft') AS soft_t,
  coalesce(hv AND n_names > 5 AND name_st <> 'allowed', false) AS over_n, hv AND coalesce(oc, false) AS conf, identity_level IN ('danger', 'warning') AS id_i FROM b4),
comb AS (SELECT *,
  free AND (over_n OR rep_open) AS name_i, (miss_t OR unv_t OR hard_t OR soft_t) AS title_i,
  CASE WHEN blocker = 'missing_final' THEN 0 WHEN blocker <> '' OR identity_level = 'danger' THEN 1 WHEN conf THEN 2 WHEN NOT has_pdf THEN 3 WHEN dup THEN 4 WHEN pdf_i THEN 5
    WHEN page_i THEN 6 WHEN src_i THEN 7 WHEN miss_t THEN 8 WHEN unv_t THEN 9 WHEN ext_i THEN 10 WHEN free AND (over_n OR rep_open) THEN 11 WHEN miss_s OR oth_s THEN 12
    WHEN fmt_i THEN 13 WHEN hard_t THEN 14 WHEN soft_t THEN 15 ELSE 99 END AS priority,
  blocker <> '' OR dup OR conf OR id_i OR pdf_i OR page_i OR miss_t OR unv_t OR hard_t OR soft_t OR (free AND (over_n OR rep_open)) OR src_i OR ext_i OR miss_s OR oth_s OR fmt_i AS attention
  FROM b5)
"""
_CB = ["scope", "groups"]
SQL["combined_list"] = query(
    _CB,
    """SELECT row_type, rid AS record_id, version_id, blocker, priority, comparison, n_names, similarity_level, page_label, identity_label, score_label, source_label, extraction_label,
    names_label, page_level, identity_level, score_level, source_level, extraction_level, names_level FROM comb""",
    COMBINED,
)
_TESTS = {
    "all": "true", "needs_attention": "attention", "missing_final": "blocker = 'missing_final'",
    "paper_id_review": "hv AND (blocker = 'needs_decision' OR (blocker = '' AND id_i))", "version_conflicts": "conf OR coalesce(n_active > 1, false)",
    "title_issues": "title_i", "verified_title_differences": "hv AND vf AND NOT mt", "no_authors": "free AND n_names IS NULL", "author_over_limit": "over_n",
    "page_issues": "page_i", "pdf_issues": "pdf_i", "source_issues": "src_i", "extraction_issues": "ext_i", "missing_plagiarism": "miss_s",
    "plagiarism_issues": "miss_s OR oth_s", "publication_duplicates": "dup", "format_not_ok": "fmt_i",
}
SQL["combined_filters"] = query(
    _CB, "SELECT " + ", ".join(f"count(*) FILTER ({t}) AS n_{k}" for k, t in _TESTS.items()) + " FROM comb", COMBINED
)
SQL["combined_summary"] = query(
    _CB,
    """SELECT count(*) AS total_rows, count(*) FILTER (blocker = 'missing_final') AS missing_final,
    count(*) FILTER ((row_type = 'unmatched' OR hv) AND NOT vf) AS unverified, count(*) FILTER (hv AND vf AND NOT mt) AS verified_title_differences,
    count(*) FILTER (pdf_i) AS pdf_issues, count(*) FILTER (src_i) AS source_issues, count(*) FILTER (ext_i) AS extraction_issues, count(*) FILTER (fmt_i) AS format_issues,
    count(*) FILTER (page_i) AS page_errors, count(*) FILTER (miss_s) AS missing_plagiarism, count(*) FILTER (oth_s) AS plagiarism_issues,
    count(*) FILTER (hv AND dup) AS publication_duplicates, count(*) FILTER (rep_open) AS duplicate_author_issues,
    count(*) FILTER (conf OR coalesce(n_active > 1, false)) AS version_conflicts, count(*) FILTER (to_process) AS needs_process_pdfs FROM comb WHERE attention""",
    COMBINED,
)
SQL["combined_search"] = query(
    _CB,
    """SELECT row_type, rid AS record_id, version_id, priority FROM comb WHERE title_i AND lower(concat_ws(' ', m_as, m_title, m_au, m_no, version_id, entered_id, rid,
    title, authors, extracted_title, extracted_authors, similarity, single)) LIKE '%dated 1998-0%'""",
    COMBINED,
)
SQL["verification_badges"] = query(
    ["scope"],
    f"""SELECT version_id, CASE WHEN m_decision = 'not_publishing' OR (m_decision IS NULL AND excluded) THEN 'Excluded from publication' WHEN id_verified AND NOT mt THEN 'Verified, title differs'
      WHEN vf AND id_verified THEN 'Verified' WHEN vf THEN 'Auto-verified by title' WHEN verification_status = 'title_mismatch' THEN 'Paper ID title mismatch' ELSE 'Paper ID needs review' END AS label,
    CASE WHEN m_decision = 'not_publishing' OR (m_decision IS NULL AND excluded) THEN 'secondary' WHEN id_verified AND NOT mt THEN 'warning' WHEN vf THEN 'success'
      WHEN verification_status = 'title_mismatch' THEN 'warning' ELSE 'danger' END AS level
    FROM (SELECT *, coalesce({MATCH}, false) AS mt, {VERIFIED} AS vf FROM (SELECT av.*, m.title AS m_title, m.decision AS m_decision FROM av LEFT JOIN master m USING (record_id)))""",
)
