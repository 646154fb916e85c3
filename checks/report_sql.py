"""SQL for reports, the log, text functions and streams."""

from checks.base_sql import name_norm, norm, query, split_names
from checks.oracle import SQL
from checks.rules_sql import EXC, FOUND, NAMES_N

_REASON = "CASE {0} WHEN 'unpaid' THEN 'Unpaid' WHEN 'withdrawn' THEN 'Withdrawn' WHEN '' THEN 'Not excluded' ELSE {0} END"
_ORIGIN = "CASE {0} WHEN 'editor_upload' THEN 'Editor Upload' ELSE 'Start2' END"
_PCT = "type IN ('plagiarism_percent', 'single_percent')"


def shown(x):
    return f"CAST(CAST({x} AS BIGINT) AS VARCHAR) || CASE WHEN {_PCT} THEN '%' ELSE '' END"


PER = f"""
ex_txt AS (SELECT *, type_label || ': ' || concat_ws(' - ', CASE status WHEN 'allowed' THEN 'Allowed exception' WHEN 'stale' THEN 'Stale allowed exception' ELSE 'Not allowed' END,
    'current ' || {shown('current_value')}, limit_label, 'approved ' || {shown('approved_value')}) || CASE WHEN reason <> '' THEN E'\\nReason: ' || reason ELSE '' END AS txt FROM exc),
ex_on AS (SELECT record_id AS rid, type, exception_key, txt FROM ex_txt WHERE record_id <> ''
  UNION ALL SELECT r.record_id, type, exception_key, txt FROM ex_txt JOIN name_recs r ON exception_key = 'author_limit:' || r.norm WHERE ex_txt.record_id = ''),
ex_rec AS (SELECT rid, string_agg(txt, E'\\n\\n' ORDER BY type, exception_key) AS exceptions, count(*) AS n_exceptions FROM ex_on WHERE rid IN (SELECT record_id FROM master) GROUP BY rid)
"""
DETAIL = f"""
{FOUND.strip()},
{EXC.strip()},
{PER.strip()},
bl_on AS (SELECT record_id AS rid, category, version_id, message FROM blocking WHERE record_id <> ''
  UNION ALL SELECT r.record_id, category, version_id, message FROM blocking b JOIN name_recs r ON exception_key = 'author_limit:' || r.norm WHERE b.record_id = ''),
bl_rec AS (SELECT rid, string_agg(category || ': ' || message, E'\\n' ORDER BY category, version_id || ' ' || message) AS blocking_text, count(*) AS n_blocking FROM bl_on WHERE rid IN (SELECT record_id FROM master) GROUP BY rid),
det AS (SELECT m.record_id AS mid, m.title AS m_title, m.decision AS md, g.n_active, a.* FROM master m LEFT JOIN record_groups g USING (record_id)
  LEFT JOIN av a ON a.record_id = m.record_id AND g.n_active = 1)
"""
_MISSING = "concat_ws(', ', CASE WHEN trim(m_title) = '' THEN 'Master' END, CASE WHEN coalesce(trim(title), '') = '' THEN 'Final' END, CASE WHEN coalesce(trim(extracted_title), '') = '' THEN 'Extracted' END)"
SQL["record_detail"] = query(
    ["current", "counts", "groups"],
    f"""SELECT mid AS record_id, coalesce(version_id, '') AS version_id, n_active, CASE WHEN version_id IS NULL THEN '' ELSE {_ORIGIN.format('origin')} END AS origin,
      coalesce(extracted_title, '') AS extracted_title, m_title, coalesce(title, '') AS title,
      CASE WHEN {_MISSING} <> '' THEN 'Missing ' || {_MISSING} WHEN trim(m_title) = trim(title) AND trim(title) = trim(extracted_title) THEN 'All titles match'
        WHEN {norm('m_title')} <> '' AND {norm('m_title')} = {norm('title')} AND {norm('title')} = {norm('extracted_title')} THEN 'Formatting-only difference'
        WHEN {norm('m_title')} = {norm('extracted_title')} AND {norm('title')} = {norm('extracted_title')} THEN 'Master and Final titles differ'
        ELSE concat_ws('; ', CASE WHEN {norm('m_title')} <> {norm('extracted_title')} THEN 'Master title differs' END, CASE WHEN {norm('title')} <> {norm('extracted_title')} THEN 'Final title differs' END) END AS comparison,
      coalesce(extracted_authors, '') AS extracted_authors, CASE WHEN extracted_authors <> '' THEN {NAMES_N} END AS n_names, pages, similarity, single,
      coalesce(exceptions, '') AS exceptions, coalesce(n_exceptions, 0) AS n_exceptions,
      CASE md WHEN 'not_publishing' THEN 'Not publishing' WHEN 'decision_required' THEN 'Decision required' ELSE CASE WHEN n_blocking IS NOT NULL OR version_id IS NULL THEN 'Not ready' ELSE 'Ready' END END AS readiness,
      coalesce(blocking_text, '') AS blocking, coalesce(n_blocking, 0) AS n_blocking
    FROM det LEFT JOIN ex_rec ON ex_rec.rid = mid LEFT JOIN bl_rec ON bl_rec.rid = mid""",
    DETAIL,
)
SQL["record_lines"] = query(
    ["current", "counts", "groups"],
    """SELECT record_id, 'version' AS kind, version_id AS sort_1, '' AS sort_2, version_id AS text FROM av WHERE record_id IN (SELECT record_id FROM master)
    UNION ALL SELECT rid, 'exception', type, exception_key, txt FROM ex_on WHERE rid IN (SELECT record_id FROM master)
    UNION ALL SELECT rid, 'blocking', category, version_id || ' ' || message, category || ': ' || message FROM bl_on WHERE rid IN (SELECT record_id FROM master)""",
    DETAIL,
)
SQL["manifest"] = query(
    ["current", "counts"],
    f"""SELECT record_id, extracted_title, extracted_authors, CASE WHEN extracted_authors <> '' THEN {NAMES_N} END AS n_names, pages, similarity, single, coalesce(exceptions, '') AS exceptions, coalesce(n_exceptions, 0) AS n_exceptions
    FROM current_v LEFT JOIN ex_rec ON rid = record_id WHERE pdf_current_hash IS NOT NULL AND source_current_hash IS NOT NULL""",
    EXC.strip() + ",\n" + PER.strip(),
)
SQL["warnings"] = query(
    ["current", "counts", "groups"],
    """SELECT 'Readiness blocker' AS type, record_id, version_id, category, message FROM blocking
    UNION ALL SELECT 'Skipped from draft package', rid, coalesce(version_id, ''), c, CASE c WHEN 'Missing Final Submission' THEN 'Left out: no active version.'
      WHEN 'Missing PDF' THEN 'Left out: its PDF is not there.' ELSE 'Left out: its source file is not there.' END
    FROM (SELECT rid, version_id, CASE WHEN version_id IS NULL THEN 'Missing Final Submission' WHEN pdf_current_hash IS NULL THEN 'Missing PDF' WHEN source_current_hash IS NULL THEN 'Missing Source File' END AS c FROM rec)
    WHERE c IS NOT NULL""",
    FOUND,
)
_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
SQL["excluded_report"] = query(
    ["scope"],
    f"""SELECT 'Paper Master decision' AS record_type, coalesce(v.version_id, '') AS version_id, coalesce(v.entered_id, '') AS entered_id, m.record_id, v.version_id IS NOT NULL AS active,
      CASE WHEN v.version_id IS NULL THEN 'No final submitted' ELSE 'Current final' END AS version_state, CASE WHEN v.version_id IS NULL THEN '' ELSE {_ORIGIN.format('v.origin')} END AS origin, '' AS replacement_id,
      coalesce(v.title, '') AS title, {_REASON.format('m.exclusion_reason')} AS reason, m.exclusion_notes AS notes, {_TS.format('m.excluded_at')} AS marked_at
    FROM master m LEFT JOIN (SELECT * FROM av WHERE version_id IN (SELECT min(version_id) FROM av GROUP BY record_id)) v USING (record_id) WHERE m.decision = 'not_publishing'
    UNION ALL SELECT 'Final outside Paper Master', v.version_id, v.entered_id, v.record_id, v.active, CASE WHEN v.active THEN 'Current final' ELSE 'Inactive old version' END, {_ORIGIN.format('v.origin')},
      CASE WHEN a.rep = v.version_id THEN '' ELSE coalesce(a.rep, '') END, v.title, {_REASON.format('v.exclusion_reason')}, v.exclusion_notes, {_TS.format('v.excluded_at')}
    FROM versions v LEFT JOIN (SELECT record_id, max(version_id) AS rep FROM av WHERE record_id <> '' GROUP BY 1) a USING (record_id)
    WHERE v.excluded AND NOT v.discarded AND v.record_id NOT IN (SELECT record_id FROM master)""",
)
SQL["master_report"] = query(
    ["master"],
    f"""SELECT record_id, accept_status, title, authors, notes, CASE decision WHEN 'publishing' THEN 'Publishing' WHEN 'not_publishing' THEN 'Not Publishing' ELSE 'Decision required' END AS decision,
    CASE WHEN decision = 'not_publishing' THEN {_REASON.format('exclusion_reason')} ELSE '' END AS exclusion_reason, exclusion_notes, {_TS.format('excluded_at')} AS excluded_at,
    {_TS.format('created_at')} AS created_at, {_TS.format('updated_at')} AS updated_at FROM master""",
)
SQL["note_summary"] = query(["master"], "SELECT record_id, title, notes FROM master WHERE notes <> ''")
_REV = "CASE {0} WHEN 'pending' THEN 'Pending' WHEN 'needs_edit' THEN 'Needs edit' WHEN 'red_flag' THEN 'Red Flag' ELSE 'Review OK' END"
SQL["version_export"] = query(
    ["master", "versions"],
    f"""SELECT v.version_id, v.record_id, m.title AS m_title, m.decision AS m_decision, {_ORIGIN.format('v.origin')} AS origin_label,
    CASE m.decision WHEN 'publishing' THEN 'Publishing' WHEN 'not_publishing' THEN 'Not Publishing' WHEN 'decision_required' THEN 'Decision required' ELSE '' END AS decision_label,
    {_REV.format('v.format_status')} AS format_label, {_REV.format('v.review_status')} AS review_label, {_REASON.format('v.exclusion_reason')} AS exclusion_label, m.record_id IS NOT NULL AS in_master
    FROM versions v LEFT JOIN master m USING (record_id)""",
)
SQL["duplicate_master_keys"] = query(
    ["claims"], "SELECT lower(trim(entered_id)) AS key, count(*) AS n, min(entered_id) AS first_id FROM claims GROUP BY 1 HAVING count(*) > 1"
)

# -- log
_RAW = "CASE event_type WHEN 'signup' THEN 'mark_not_publishing' WHEN 'purchase' THEN 'exception_allow' WHEN 'view' THEN 'pdf_process' WHEN 'click' THEN 'process_pdfs' ELSE 'node_failure' END"
LOG = f"""
log AS (SELECT event_id, ts, 'user' || user_id AS actor, {_RAW} AS raw_action, CASE WHEN event_type = 'error' THEN 'failed' WHEN value >= 10 THEN 'success' ELSE 'previewed' END AS status, props AS message,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
meta AS (SELECT *, CASE raw_action WHEN 'mark_not_publishing' THEN 'publication_exclusion_apply' WHEN 'process_pdfs' THEN 'pdf_process' ELSE raw_action END AS action,
  CASE raw_action WHEN 'mark_not_publishing' THEN 'Mark Not Publishing' WHEN 'exception_allow' THEN 'Allow Exception' WHEN 'node_failure' THEN 'Node Failure' ELSE 'Process Publication PDFs' END AS action_label,
  CASE raw_action WHEN 'mark_not_publishing' THEN 'submissions' WHEN 'exception_allow' THEN 'exceptions' WHEN 'node_failure' THEN 'other' ELSE 'processing' END AS category,
  CASE raw_action WHEN 'mark_not_publishing' THEN 'Submissions & Versions' WHEN 'exception_allow' THEN 'Exceptions' WHEN 'node_failure' THEN 'Other' ELSE 'PDF Processing' END AS category_label,
  raw_action <> 'node_failure' AS registered FROM log)
"""
SQL["log_actions"] = "WITH " + LOG + "SELECT event_id, raw_action, action, action_label, category, category_label, registered FROM meta"
SQL["log_filter"] = "WITH " + LOG + """SELECT event_id, action, status, message FROM meta WHERE category = 'processing' AND action = 'pdf_process' AND status = 'success' AND message LIKE '%k": 1%'"""
SQL["log_changes"] = "WITH " + LOG + """SELECT event_id, kind, field, label, old, new FROM (
  SELECT event_id, 'user' AS kind, 'title' AS field, 'Master Title' AS label, 'T' || k AS old, 'T' || (k + 1) AS new FROM log
  UNION ALL SELECT event_id, 'user', 'pages', 'Pages', CAST(k AS VARCHAR), CAST(CASE WHEN k % 2 = 0 THEN k ELSE k + 2 END AS VARCHAR) FROM log WHERE k % 3 <> 0
  UNION ALL SELECT event_id, 'system', 'pages', 'Pages', CAST(k AS VARCHAR), CAST(k + 2 AS VARCHAR) FROM log WHERE k % 3 = 0 AND k % 2 <> 0
  UNION ALL SELECT event_id, 'system', 'notes', 'Notes', 'Empty', 'checked' FROM log WHERE k > 90
  UNION ALL SELECT event_id, 'reset', 'pdf_reset', 'PDF-dependent checks reset', '', 'Yes' FROM log WHERE k % 5 = 0)"""
SQL["log_facets"] = "WITH " + LOG + "SELECT category, category_label, action, action_label, status, count(*) AS n FROM meta GROUP BY ALL"
SQL["log_tail"] = "WITH " + LOG + f"SELECT event_id, action, {_TS.format('ts')} AS ts FROM meta ORDER BY meta.ts DESC, event_id DESC LIMIT 100"
SQL["log_hourly"] = "WITH " + LOG + f"SELECT {_TS.format('date_trunc($$hour$$, ts)')} AS window_start, category, status, count(*) AS n FROM meta GROUP BY ALL"
SQL["log_sessions"] = "WITH " + LOG + f""",
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY actor ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS brk FROM log),
s AS (SELECT *, sum(brk) OVER (PARTITION BY actor ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT actor, count(*) AS n_events, {_TS.format('min(ts)')} AS started, {_TS.format('max(ts) + INTERVAL 2 HOUR')} AS expires FROM s GROUP BY actor, sid"""
SQL["active_stream"] = query(["claims", "ranked"], "SELECT record_id, version_id FROM claims JOIN ranked USING (version_id) WHERE rn = 1")

# -- text, digests
SQL["duplicate_text"] = f"""SELECT sha256({norm('text')}) AS key_hash, count(*) AS n_rows, min(doc_id) AS first_id FROM documents
WHERE {norm('text')} <> '' GROUP BY {norm('text')} HAVING count(*) > 1"""
SQL["content_hash"] = "SELECT doc_id, sha256(text) AS sha256 FROM documents"


def sanitize(x):
    inner = f"trim(regexp_replace(regexp_replace({x}, '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '._-')"
    return f"CASE WHEN {inner} = '' THEN 'UNTITLED' ELSE {inner} END"


_W = "regexp_extract_all(text, '[A-Za-z0-9]+')[1:5]"
_SN = split_names("text")
_NOTE = r"""trim(regexp_replace(regexp_replace(regexp_replace(E'\r\n ' || text || E'\r\n\r\n\r\n x  \n', '\r\n?', E'\n', 'g'), '[^\S\n]*\n[^\S\n]*', E'\n', 'g'), '\n{3,}', E'\n\n', 'g'), E' \t\n\r')"""
SQL["text_functions"] = f"""SELECT conv_id, turn, {sanitize('text')} AS sanitized,
  'C_' || conv_id || '-' || CASE WHEN len({_W}) = 0 THEN 'UNTITLED' ELSE array_to_string({_W}, ' ') END AS file_name, {_NOTE} AS note,
  upper(role) || ':' || turn AS canonical, {name_norm('text')} AS name, len({_SN}) AS n_names,
  CASE len({_SN}) WHEN 0 THEN '' WHEN 1 THEN {_SN}[1] WHEN 2 THEN {_SN}[1] || ' and ' || {_SN}[2] ELSE array_to_string({_SN}[1:len({_SN}) - 1], ', ') || ', and ' || {_SN}[len({_SN})] END AS formatted,
  CASE WHEN turn % 2 = 0 THEN ''' =' || text WHEN regexp_matches(text, '^[ \\t\\r\\n]*[=+\\-@]') THEN '''' || text ELSE text END AS safe,
  upper(role) || '-' || conv_id AS built FROM conversations"""
_FN = "lower(regexp_extract(url, '([^/]*)$', 1))"
SQL["file_names"] = f"""SELECT page_id, CASE WHEN regexp_matches({_FN}, '\\.tar\\.(gz|bz2|xz)$') THEN regexp_extract({_FN}, '(\\.tar\\.(?:gz|bz2|xz))$', 1)
    WHEN regexp_matches({_FN}, '.\\.[^.]+$') THEN regexp_extract({_FN}, '.(\\.[^.]+)$', 1) ELSE '.source' END AS ext,
  CASE lower(regexp_extract(url, '([^.]*)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'zip' THEN 'source' ELSE 'unknown' END AS kind,
  CASE WHEN p LIKE '/m.thththth.example.net/%' THEN 'media:' || substr(p, 25) ELSE regexp_extract(p, '([^/]*)$', 1) END AS path,
  'v' || page_id AS upload_id, CASE WHEN page_id % 2 = 0 THEN 'source' ELSE 'pdf' END AS upload_kind,
  CASE WHEN sz < 1024 THEN sz || ' B' WHEN sz < 1048576 THEN printf('%.2f KB', sz / 1024.0) WHEN sz < 1073741824 THEN printf('%.2f MB', sz / 1048576.0) ELSE printf('%.2f GB', sz / 1073741824.0) END AS size
FROM (SELECT *, regexp_replace(url, '^https?:/', '') AS p, length(html) * page_id * 37 AS sz FROM pages)"""
SQL["parse_percent"] = """SELECT raw, count(*) AS n,
  CASE WHEN n1 AND q = 1 AND NOT x THEN 1 WHEN n1 OR x THEN NULL ELSE q END AS value,
  CASE WHEN NOT x AND (NOT n1 OR q = 1) THEN '' ELSE 'Single % must be blank (meaning missing), a number from 0 to 100, or ''<1''.' END AS error,
  CASE WHEN n1 THEN 1 WHEN x THEN NULL ELSE q END AS loose
FROM (SELECT CASE l_linenumber WHEN 1 THEN '< ' WHEN 2 THEN '+' ELSE '' END || CAST(l_quantity AS VARCHAR) || CASE l_returnflag WHEN 'A' THEN ' %' WHEN 'N' THEN '' ELSE 'x' END AS raw,
  l_linenumber = 1 AS n1, l_returnflag = 'R' AS x, l_quantity AS q FROM lineitem) GROUP BY ALL"""
SQL["parse_batch_name"] = """SELECT page_id, CASE WHEN err = '' THEN split_part(stem, '_', 1) END AS record_id, CASE WHEN err = '' THEN substr(stem, strpos(stem, '_') + 1) END AS token, err AS error,
  CASE WHEN err = '' THEN regexp_matches(substr(stem, strpos(stem, '_') + 1), '^[A-Za-z0-9_-]+$') ELSE false END AS valid
FROM (SELECT *, CASE WHEN strpos(stem, '_') = 0 THEN 'Filename must use RecordID_token format.' WHEN strpos(stem, '_') = 1 THEN 'Record ID is missing before underscore.'
    WHEN substr(stem, strpos(stem, '_') + 1) = '' THEN 'Token is missing after underscore.' ELSE '' END AS err
  FROM (SELECT page_id, regexp_replace(regexp_extract(trim(url), '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem FROM pages))"""
_DW = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
SQL["find_phrase"] = f"""WITH w AS (SELECT doc_id, {_DW} AS w FROM documents),
h AS (SELECT doc_id, i AS start, w[i] AS a, w[i + 1] AS b, w[3] AS p, w[4] AS q FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) >= 4)),
m AS (SELECT doc_id, start, regexp_matches(substr(b, length(q) + 1, 1), '\\pL') AS partial FROM h
  WHERE (a = p OR regexp_replace(a, '^[^\\pL\\pN]+', '') = p) AND starts_with(b, q)),
c AS (SELECT *, bool_or(NOT partial) OVER (PARTITION BY doc_id) AS has_complete FROM m)
SELECT doc_id, start, partial FROM c WHERE NOT has_complete OR NOT partial"""
SQL["file_totals"] = query(
    ["versions"],
    """SELECT coalesce(category, 'total') AS category, CAST(sum(n) AS BIGINT) AS bytes, count(*) AS files FROM (
      SELECT 'original' AS category, length(pdf_file) AS n FROM versions WHERE pdf_file <> '' UNION ALL SELECT 'upload', length(source_file) FROM versions WHERE source_file <> ''
      UNION ALL SELECT 'export', length(corrected_pdf) FROM versions WHERE corrected_pdf <> '' UNION ALL SELECT 'report', length(report_path) FROM versions WHERE report_path <> '') GROUP BY ROLLUP (category)""",
)
SQL["unreferenced_files"] = query(
    ["scope"],
    """SELECT 'store/' || format_status || '/' || pdf_file AS path FROM versions WHERE pdf_file <> '' AND format_status <> 'needs_edit' AND version_id NOT IN (SELECT version_id FROM scoped)""",
)

# -- review lists
from checks.rules_sql import COMBINED  # noqa: E402
from checks.worklist_sql import XT, ident, lev  # noqa: E402

SQL["identity_list"] = query(
    ["scope"], "SELECT version_id, record_id, status, sc AS score FROM idt WHERE NOT ex AND NOT is_verified", ident("publishable")
)
SQL["identity_suggestions"] = query(
    ["scope"],
    f"""SELECT version_id, record_id, status, CASE WHEN mdd IS NULL THEN best.score ELSE sc END AS score,
      CASE WHEN mdd IS NULL AND best.id IS NULL THEN 'No master record has this id; no title comes within 80%.'
        WHEN mdd IS NULL THEN 'No master record has this id; closest title: ' || best.id || ' (' || best.score || '%).'
        WHEN sc IS NULL THEN 'A title is missing, so none were compared.'
        WHEN same THEN 'Same title as ' || record_id || ', but taken back to unverified by hand.'
        WHEN sc < 80 AND best.id <> record_id THEN 'Title agrees with the present record to ' || sc || '%; closest title: ' || best.id || ' (' || best.score || '%).'
        ELSE 'Title agrees with ' || record_id || ' to ' || sc || '%.' END AS message
    FROM idt LEFT JOIN (SELECT a, max(score) AS score, min_by(id, (-score, id)) AS id FROM alike GROUP BY a) best ON best.a = {norm('idt.title')}
    WHERE NOT ex AND NOT is_verified""",
    ident("publishable")
    + f""", asked AS (SELECT DISTINCT {norm('title')} AS a FROM idt WHERE NOT ex AND NOT is_verified AND (mdd IS NULL OR sc < 80) AND {norm('title')} <> ''),
    official AS (SELECT {norm('title')} AS b, min(record_id) AS id FROM master WHERE {norm('title')} <> '' GROUP BY 1),
    alike AS (SELECT * FROM (SELECT a, id, round(100.0 * (1.0 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE)), 2) AS score
      FROM asked JOIN official ON abs(length(a) - length(b)) <= 0.21 * greatest(length(a), length(b))) WHERE score >= 80)""",
)
SQL["extraction_list"] = query(
    ["scope"],
    """SELECT version_id, record_id, status, sc AS score FROM xt WHERE review_status = 'review_ok' AND NOT same AND (lower(version_id) LIKE '%dated 199%' OR lower(record_id) LIKE '%dated 199%'
      OR lower(title) LIKE '%dated 199%' OR lower(extracted_title) LIKE '%dated 199%' OR lower(extracted_authors) LIKE '%dated 199%')""",
    XT.replace("SRC", "scoped"),
)
SQL["processing_list"] = query(
    ["scope"],
    "SELECT version_id, record_id, pages FROM scoped WHERE (pages < 6 OR pages > 12) AND lower(record_id || ' ' || version_id || ' ' || title) LIKE '%customer 1%'",
)
SQL["formatting_list"] = query(
    ["scope"],
    """SELECT version_id, record_id, format_status FROM scoped WHERE (corrected_pdf <> '' OR corrected_source <> '') AND (lower(version_id) LIKE '%revised%' OR lower(record_id) LIKE '%revised%'
      OR lower(title) LIKE '%revised%' OR lower(authors) LIKE '%revised%')""",
)
SQL["version_list"] = query(
    ["groups"],
    """SELECT version_id, record_id, origin FROM versions WHERE NOT discarded AND (lower(version_id || '|' || entered_id || '|' || record_id || '|' || title || '|' || authors) LIKE '%shipment 1%')
      AND record_id IN (SELECT record_id FROM record_groups WHERE decision = 'publishing' AND n_author > 0 AND n_editor > 0)""",
)
SQL["finding_exceptions"] = query(
    ["current", "counts", "groups"],
    "SELECT category, b.record_id, b.version_id, b.exception_key, status AS exception_status, current_value, limit_label FROM blocking b LEFT JOIN exc ON b.exception_key = exc.exception_key AND b.exception_key <> ''",
    FOUND.strip() + ",\n" + EXC.strip(),
)
SQL["not_allowed_scores"] = query(
    ["counts"], f"SELECT exception_key, type, current_value, approved_value FROM exc WHERE status = 'stale' AND {_PCT}", EXC
)
SQL["explode_ids"] = query(
    ["master", "versions"],
    """SELECT version_id, record_id FROM (SELECT version_id, 'P' || n AS record_id FROM k UNION ALL SELECT version_id, 'P' || (n - 1) FROM k) JOIN master USING (record_id)""",
    "k AS (SELECT version_id, CAST(regexp_extract(version_id, '(\\d+)$', 1) AS BIGINT) AS n FROM versions)",
)
SQL["active_report"] = query(
    ["master", "versions"],
    f"SELECT v.version_id, v.record_id, m.title AS m_title, {_ORIGIN.format('v.origin')} AS origin_label, m.record_id IS NOT NULL AS in_master FROM versions v LEFT JOIN master m USING (record_id) WHERE v.active",
)
SQL["old_report"] = (
    "SELECT o.version_id, o.old_status, o.inactive_reason, o.replacement_id, CASE m.o_orderstatus WHEN 'F' THEN 'Publishing' WHEN 'O' THEN 'Not Publishing' WHEN 'P' THEN 'Decision required' ELSE '' END AS decision_label "
    f"FROM ({SQL['old_versions']}) o LEFT JOIN orders m ON 'P' || m.o_orderkey = o.record_id"
)
SQL["guard_review"] = query(
    ["versions"],
    f"""SELECT version_id, CASE WHEN r THEN 'pending' ELSE review_status END AS review_status, CASE WHEN d THEN 'pending' ELSE duplicate_review_status END AS duplicate_review_status,
      title_verified AND NOT t AS title_verified, r OR d OR t AS guarded FROM (
      SELECT *, review_status = 'review_ok' AND (trim(extracted_title) = '' OR trim(extracted_authors) = '') AS r, duplicate_review_status = 'review_ok' AND trim(extracted_authors) = '' AS d,
        title_verified AND NOT (trim(title) <> '' AND trim(extracted_title) <> '' AND ({norm('title')} = {norm('extracted_title')} OR coalesce({lev('title', 'extracted_title')} >= 90, false))) AS t FROM versions)""",
)
_METRICS = [
    ("missing_final", "No Final", "danger", "blocker = 'missing_final'"), ("unverified", "Paper ID Review", "danger", "(row_type = 'unmatched' OR hv) AND NOT vf"),
    ("pdf_issues", "PDF Issues", "danger", "pdf_i"), ("page_errors", "Page Issues", "warning", "page_i"), ("source_issues", "Source File Issues", "danger", "src_i"),
    ("extraction_issues", "Extraction Review", "warning", "ext_i"), ("missing_plagiarism", "No Plagiarism", "warning", "miss_s"), ("plagiarism_issues", "P/S Issues", "danger", "oth_s"),
    ("format_issues", "Formatting Not OK", "warning", "fmt_i"), ("publication_duplicates", "Duplicates", "danger", "hv AND dup"),
    ("version_conflicts", "Version Conflicts", "danger", "conf OR coalesce(n_active > 1, false)"), ("duplicate_author_issues", "Duplicate Authors", "danger", "rep_open"),
]
SQL["combined_metrics"] = query(
    ["scope", "groups"],
    "SELECT * FROM (" + "\nUNION ALL ".join(
        f"SELECT '{m}' AS metric, '{label}' AS label, '{level}' AS level, count(*) FILTER ({test}) AS value FROM comb" for m, label, level, test in _METRICS
    ) + ") WHERE value > 0",
    COMBINED,
)
SQL["hash_reuse"] = "SELECT 'd/' || doc_id AS path, n_chars AS length, CASE WHEN doc_id % 2 = 0 THEN 'stored' ELSE sha256(text) END AS sha256 FROM documents"
