"""SQL for imports, batch results and transitions."""

from checks.base_sql import natkey, query
from checks.oracle import SQL
from checks.worklist_sql import _resolve

EVEN = "coalesce(pages % 2 = 0, false)"
RN = "CAST(regexp_extract({0}, '(\\d+)$', 1) AS BIGINT)"


def rn(x):
    return RN.format(x)


MIMP = f"""
listed AS (SELECT {rn('record_id')} AS row_no, lower(record_id) AS typed, record_id AS rid, accept_status,
    trim(CASE WHEN accept_status = '1-URGENT' THEN title || ' II' ELSE title END) AS title, authors,
    CASE WHEN accept_status = '1-URGENT' THEN E'Expedite\\n\\nnow' ELSE notes END AS notes FROM master),
mimp AS (SELECT * FROM listed UNION ALL SELECT row_no + 10000000, typed, rid, accept_status, title, authors, notes FROM listed WHERE accept_status = '5-LOW'
  UNION ALL SELECT {rn('record_id')}, record_id, record_id, 'accepted', 'Late ' || record_id, '', '' FROM (SELECT DISTINCT record_id FROM versions WHERE record_id LIKE 'X%')),
mdiff AS (SELECT i.row_no, i.rid AS record_id, i.accept_status, i.title, i.authors, i.notes, m.decision, m.title AS mt, m.notes AS mn,
    CASE WHEN f.fr <> i.row_no THEN 'error' WHEN m.record_id IS NULL THEN 'new' WHEN m.title <> i.title OR m.notes <> i.notes THEN 'changed' ELSE 'unchanged' END AS status,
    CASE WHEN f.fr <> i.row_no THEN 'Duplicate id in rows ' || f.fr || ' and ' || i.row_no || '.' ELSE '' END AS error, coalesce(o.n, 0) AS n, coalesce(o.x, 0) AS x
  FROM mimp i JOIN (SELECT typed, min(row_no) AS fr FROM mimp GROUP BY typed) f USING (typed) LEFT JOIN master m ON m.record_id = i.rid
  LEFT JOIN (SELECT record_id, count(*) AS n, count(*) FILTER (excluded) AS x FROM versions WHERE record_id <> '' GROUP BY 1) o ON o.record_id = i.rid)
"""
SQL["master_import_diff"] = query(
    ["master", "versions"],
    """SELECT row_no, record_id, accept_status, title, authors, notes, status, error,
      CASE WHEN decision IS NULL THEN '' ELSE concat_ws('; ', CASE WHEN mt <> title THEN 'title: ' || mt || ' -> ' || title END, CASE WHEN mn <> notes THEN 'notes: ' || mn || ' -> ' || notes END) END AS changes,
      error = '' AND coalesce(mt <> title, false) AS id_review_reset, error = '' AND coalesce(mn <> notes, false) AS notes_changed,
      CASE WHEN error = '' AND (decision IS NULL OR mt <> title) THEN n ELSE 0 END AS n_affected, error = '' AND decision IS NULL AND x > 0 AS decision_required,
      CASE WHEN error = '' AND decision IS NULL THEN x ELSE 0 END AS n_excluded FROM mdiff""",
    MIMP,
)
SQL["apply_master_import"] = query(
    ["master", "versions"],
    """SELECT record_id, title, notes, decision, accept_status FROM (
      SELECT m.record_id, coalesce(d.title, m.title) AS title, m.notes, m.decision, m.accept_status FROM master m
        LEFT JOIN (SELECT * FROM mdiff WHERE status = 'changed') d USING (record_id)
      UNION ALL SELECT record_id, title, notes, CASE WHEN x > 0 THEN 'decision_required' ELSE 'publishing' END, accept_status FROM mdiff WHERE status = 'new')""",
    MIMP,
)
VIMP = f"""
vl AS (SELECT {rn('version_id')} AS row_no, version_id,
    CASE WHEN CAST(substr(version_id, 2, 1) AS INTEGER) % 2 = 0 THEN entered_id ELSE 'P-' || regexp_replace(entered_id, '^[Pp]?-?0*', '') END AS entered_id,
    trim(CASE WHEN {EVEN} THEN title || ' v2' ELSE title END) AS title,
    CASE WHEN format_status = 'needs_edit' THEN authors || ', Extra Name' ELSE authors END AS authors,
    CASE WHEN similarity = 10 THEN upload_date + INTERVAL 1 DAY WHEN single = 4 THEN NULL ELSE upload_date END AS upload_date, format_status FROM versions),
vimp AS (SELECT * EXCLUDE (format_status) FROM vl UNION ALL SELECT row_no + 10000000, version_id, entered_id, title, authors, upload_date FROM vl WHERE format_status = 'pending'
  UNION ALL SELECT {rn('record_id')}, 'N' || record_id, record_id, title, authors, created_at FROM master),
firsts AS (SELECT version_id, min(row_no) AS first_row, count(*) AS n_same FROM vimp GROUP BY 1),
vfirst AS (SELECT v.* FROM vimp v JOIN firsts f ON f.version_id = v.version_id AND f.first_row = v.row_no),
{_resolve('vfirst').strip()},
ups AS (SELECT version_id, CASE WHEN {EVEN} THEN sha256(version_id) ELSE pdf_current_hash END AS up, CASE WHEN similarity = 20 THEN sha256(version_id) END AS us
  FROM versions WHERE format_status = 'needs_edit'),
w1 AS (SELECT i.row_no, i.version_id, i.entered_id, i.title, i.authors, i.upload_date, o.version_id IS NULL AS isnew, coalesce(o.origin = 'editor_upload', false) AS prot,
    CASE WHEN o.version_id IS NULL THEN 'new_submission' WHEN o.entered_id = i.entered_id AND o.record_id <> '' THEN 'preserved' WHEN o.entered_id = i.entered_id THEN 'resolved_missing'
      ELSE 'author_entered_id_changed' END AS resol, r.resolved_id, o.entered_id AS oe, o.record_id AS orid, o.title AS ot, o.authors AS oa, o.upload_date AS od, o.discarded AS odis,
    (o.corrected_pdf <> '' OR o.corrected_source <> '') AS oc, o.pdf_current_hash AS op, o.source_current_hash AS os, u.up, u.us
  FROM vfirst i JOIN resolved r USING (version_id) LEFT JOIN versions o USING (version_id) LEFT JOIN ups u USING (version_id)),
w2 AS (SELECT *, CASE WHEN resol = 'preserved' THEN orid ELSE resolved_id END AS record_id FROM w1),
w3 AS (SELECT w2.*, m.decision, NOT isnew AND NOT prot AND oe <> entered_id AS ce, NOT isnew AND NOT prot AND orid <> w2.record_id AS cr, NOT isnew AND NOT prot AND ot <> w2.title AS ct,
    NOT isnew AND NOT prot AND oa <> w2.authors AS ca, coalesce(NOT isnew AND NOT prot AND w2.upload_date IS NOT NULL AND date_trunc('second', od) <> date_trunc('second', w2.upload_date), false) AS date_changed,
    CASE WHEN prot THEN '' WHEN up IS NULL THEN CASE WHEN isnew THEN 'missing' ELSE 'not uploaded' END WHEN isnew OR op IS NULL THEN 'new' WHEN op = up THEN 'same' ELSE 'different' END AS pdf_status,
    CASE WHEN prot THEN '' WHEN us IS NULL THEN CASE WHEN isnew THEN 'missing' ELSE 'not uploaded' END WHEN isnew OR os IS NULL THEN 'new' WHEN os = us THEN 'same' ELSE 'different' END AS source_status
  FROM w2 LEFT JOIN master m ON m.record_id = w2.record_id),
w4 AS (SELECT *, pdf_status IN ('new', 'different') AS np, source_status IN ('new', 'different') AS ns FROM w3),
vdiff AS (SELECT row_no, version_id, entered_id, record_id, title, authors, upload_date,
    CASE WHEN isnew THEN 'new' WHEN prot THEN 'unchanged' WHEN ce OR cr OR ct OR ca OR date_changed OR np OR ns THEN 'changed' ELSE 'unchanged' END AS status,
    concat_ws('; ', CASE WHEN ce THEN 'entered_id: ' || oe || ' -> ' || entered_id END, CASE WHEN cr THEN 'record_id: ' || orid || ' -> ' || record_id END,
      CASE WHEN ct THEN 'title: ' || ot || ' -> ' || title END, CASE WHEN ca THEN 'authors: ' || oa || ' -> ' || authors END) AS changes,
    date_changed, pdf_status, source_status, NOT prot AND (isnew OR ce OR cr OR ct) AS id_review_reset,
    CASE WHEN isnew THEN np ELSE ct OR np OR ns END AS title_match_reset, CASE WHEN isnew THEN np ELSE np OR ns OR ca END AS review_reset, np AS pdf_reset, ns AS source_reset,
    NOT isnew AND (np OR ns) AND coalesce(oc, false) AS corrected_archived, NOT isnew AND ca AS authors_changed, NOT prot AND (record_id = '' OR decision IS NULL) AS invalid_master, prot AS protected,
    coalesce(odis, false) AS currently_discarded, coalesce(decision, '') = 'not_publishing' AS master_excluded, coalesce(decision, '') = 'decision_required' AS master_undecided,
    CASE WHEN prot THEN 'protected_editor_upload' ELSE resol END AS resolution, '' AS error FROM w4),
vbad AS (SELECT v.row_no, v.version_id, 'Duplicate id in rows ' || f.first_row || ' and ' || v.row_no || '.' AS error FROM vimp v JOIN firsts f USING (version_id) WHERE f.first_row <> v.row_no)
"""
_MV = ["master", "versions"]
SQL["import_diff"] = query(
    _MV,
    """SELECT * REPLACE (strftime(upload_date, '%Y-%m-%d %H:%M:%S') AS upload_date) FROM (
    SELECT * FROM vdiff UNION ALL BY NAME SELECT row_no, version_id, 'error' AS status, error FROM vbad)""",
    VIMP,
)
_FLAGS = ("id_review_reset", "title_match_reset", "review_reset", "pdf_reset", "source_reset", "corrected_archived", "invalid_master", "protected")
SQL["import_stats"] = query(
    _MV,
    "SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in ("new", "changed", "unchanged"))
    + ", (SELECT count(*) FROM vbad) AS n_error, " + ", ".join(f"count(*) FILTER ({f}) AS n_{f}" for f in _FLAGS) + " FROM vdiff",
    VIMP,
)
SQL["duplicate_keys_in_file"] = query(
    _MV, "SELECT row_no, version_id, n_same, first_row FROM vimp JOIN firsts USING (version_id) WHERE row_no <> first_row", VIMP
)
_RANK = f"""row_number() OVER (PARTITION BY record_id ORDER BY origin = 'editor_upload' DESC, {natkey('version_id')} DESC, created_at DESC, version_id DESC)"""


def flags(source):
    """active and replaced recomputed over source."""
    return f"""
rk AS (SELECT version_id, {_RANK} AS rn FROM {source} WHERE NOT discarded AND record_id <> ''),
final AS (SELECT s.*, coalesce(rn = 1, false) AS active2, coalesce(rn > 1, false) AS replaced2 FROM {source} s LEFT JOIN rk USING (version_id))
"""


SQL["apply_version_import"] = query(
    _MV,
    """SELECT version_id, record_id, title, origin, excluded, id_verified, pages, review_status, format_status, corrected_pdf, active2 AS active, replaced2 AS replaced FROM final""",
    VIMP.strip() + """,
chg AS (SELECT * FROM vdiff WHERE status IN ('new', 'changed') AND NOT protected),
app AS (SELECT coalesce(c.version_id, v.version_id) AS version_id, CASE WHEN c.version_id IS NOT NULL THEN c.record_id ELSE v.record_id END AS record_id,
    CASE WHEN c.version_id IS NOT NULL THEN c.title ELSE v.title END AS title, CASE WHEN c.status = 'new' THEN 'start2' ELSE v.origin END AS origin,
    CASE WHEN c.status = 'new' THEN false ELSE v.discarded END AS discarded, CASE WHEN c.status = 'new' THEN false ELSE v.excluded END AS ex0,
    coalesce(v.created_at, c.upload_date) AS created_at,
    CASE WHEN c.id_review_reset THEN false ELSE v.id_verified END AS id_verified, CASE WHEN c.pdf_reset THEN NULL ELSE v.pages END AS pages,
    CASE WHEN c.pdf_reset OR c.source_reset OR c.authors_changed THEN 'pending' ELSE v.review_status END AS review_status,
    CASE WHEN c.pdf_reset OR c.source_reset THEN 'pending' ELSE v.format_status END AS format_status, CASE WHEN c.corrected_archived THEN '' ELSE v.corrected_pdf END AS corrected_pdf
  FROM versions v FULL JOIN chg c USING (version_id)),
mir AS (SELECT a.*, CASE m.decision WHEN 'not_publishing' THEN true WHEN 'publishing' THEN false ELSE ex0 END AS excluded FROM app a LEFT JOIN master m USING (record_id)),
""" + flags("mir"),
)
SQL["refuse_master_import"] = query(["master"], "SELECT record_id, title, notes, decision, accept_status FROM master")
SQL["refuse_version_import"] = query(
    _MV,
    "SELECT version_id, record_id, title, origin, excluded, id_verified, pages, review_status, format_status, corrected_pdf, active, replaced FROM versions",
)
SQL["reset_dependents"] = query(
    ["versions"],
    f"""SELECT version_id, CASE WHEN p THEN NULL ELSE pages END AS pages, CASE WHEN p THEN '' ELSE pdf_hash END AS pdf_hash, CASE WHEN p OR s THEN '' ELSE source_hash END AS source_hash,
      CASE WHEN p THEN '' ELSE extracted_title END AS extracted_title, CASE WHEN p OR s THEN 'pending' ELSE review_status END AS review_status,
      CASE WHEN i THEN false ELSE id_verified END AS id_verified, CASE WHEN p OR s THEN 'pending' ELSE format_status END AS format_status,
      CASE WHEN p AND corrected_pdf <> '' THEN '' ELSE corrected_pdf END AS corrected_pdf, CASE WHEN p THEN NULL ELSE CAST(similarity AS DOUBLE) END AS similarity,
      p OR s OR title_verify_blocked AS title_verify_blocked
    FROM (SELECT *, {EVEN} AS p, format_status = 'pending' AS s, coalesce(similarity = 10, false) AS i FROM versions)""",
)
SQL["upsert_result"] = query(
    _MV,
    """SELECT record_id, CASE WHEN decision = 'decision_required' THEN upper(title) ELSE title END AS title, CASE WHEN decision = 'decision_required' THEN NULL ELSE notes END AS notes, decision FROM master
    UNION ALL SELECT DISTINCT record_id, 'new', '', NULL FROM versions WHERE record_id LIKE 'X%'""",
)
SQL["state_domains"] = query(
    ["versions"], "SELECT version_id, excluded, exclusion_reason, exclusion_notes, strftime(excluded_at, '%Y-%m-%d %H:%M:%S') AS excluded_at FROM versions"
)
SQL["stale_actions"] = query(
    _MV,
    f"""SELECT version_id, NOT {EVEN} AS accepted, CASE WHEN {EVEN} THEN 'stale' ELSE '' END AS reason FROM versions
    UNION ALL SELECT 'gone-' || record_id, false, 'missing' FROM master""",
)
SQL["edit_impacts"] = query(
    ["versions"],
    f"""SELECT version_id, level, label FROM (SELECT *, {EVEN} AS t, format_status = 'pending' AS p FROM versions), (VALUES
      (1, 'warning', 'Paper ID review will be recalculated'), (2, 'warning', 'Extracted title comparison will reset'), (3, 'danger', 'PDF-dependent checks will reset'),
      (4, 'danger', 'Corrected files will be archived and unlinked'), (5, 'warning', 'Active versions will be recalculated'), (6, 'warning', 'Existing plagiarism report will be marked old')) i(k, level, label)
    WHERE (k IN (1, 2) AND t) OR (k = 3 AND p) OR (k = 4 AND p AND corrected_pdf <> '') OR (k = 5 AND origin = 'editor_upload') OR (k = 6 AND similarity = 10 AND report_path <> '')""",
)
_EXT = f"""e0 AS (SELECT {rn('version_id')} AS row_no, CASE WHEN {EVEN} THEN '' ELSE version_id END AS ex, record_id,
      CASE WHEN similarity = 0 THEN 1 WHEN similarity = 5 THEN NULL ELSE CAST(floor(similarity + 1) AS DOUBLE) END AS ns, CAST(single AS DOUBLE) AS sg, format_status FROM av),
    ext AS (SELECT * FROM e0 UNION ALL SELECT row_no + 10000000, ex, record_id, ns, sg, format_status FROM e0 WHERE format_status = 'pending')"""


def _scores(rows):
    """Targets, problems and new scores of an external file."""
    return f"""SELECT x.*, v.similarity AS os, v.single AS og, v.report_path AS rp, v.report_stale AS rs, count(*) FILTER (problem = '') OVER (PARTITION BY CASE WHEN problem = '' THEN target ELSE 'none' || row_no END) AS nt FROM (
        SELECT r.*, CASE WHEN ex <> '' THEN ex WHEN c.n = 1 THEN c.vid END AS target, CASE WHEN ex = '' AND c.n > 1 THEN 'ambiguous' WHEN ex = '' AND c.n IS NULL THEN 'unmatched' ELSE '' END AS problem
        FROM {rows} r LEFT JOIN (SELECT record_id, count(*) AS n, min(version_id) AS vid FROM scoped GROUP BY 1) c USING (record_id)) x LEFT JOIN versions v ON v.version_id = x.target"""


def _dispositions(rows):
    return f"""SELECT row_no, CASE WHEN problem = '' THEN target END AS version_id,
      CASE WHEN problem <> '' THEN problem WHEN nt > 1 THEN 'duplicate' WHEN worst > 1 THEN 'refused' ELSE 'updated' END AS disposition,
      CASE WHEN problem = '' THEN ns END AS similarity, CASE WHEN problem = '' THEN sg END AS single,
      CASE WHEN problem = '' THEN CASE WHEN (ns IS DISTINCT FROM os OR sg IS DISTINCT FROM og) AND rp <> '' THEN true ELSE rs END END AS report_stale
      FROM (SELECT *, max(CASE WHEN problem = '' THEN nt ELSE 0 END) OVER () AS worst FROM ({_scores(rows)}))"""


SQL["apply_scores"] = query(["scope"], _dispositions("ext"), _EXT)
SQL["apply_scores_once"] = query(["scope"], _dispositions("e0"), _EXT)
SQL["write_scores"] = query(
    ["scope"],
    f"""SELECT v.version_id, CAST(CASE WHEN w.version_id IS NULL THEN v.similarity ELSE w.similarity END AS DOUBLE) AS similarity,
      CAST(CASE WHEN w.version_id IS NULL THEN v.single ELSE w.single END AS DOUBLE) AS single, CASE WHEN w.version_id IS NULL THEN v.report_stale ELSE w.report_stale END AS report_stale
    FROM versions v LEFT JOIN (SELECT * FROM ({_dispositions("(SELECT * FROM e0 WHERE sg = 2)")}) WHERE disposition = 'updated') w ON w.version_id = v.version_id""",
    _EXT,
)
BATCH = f"""
prov AS (SELECT record_id, version_id, CASE WHEN format_status = 'needs_edit' THEN sha256(version_id) ELSE pdf_current_hash END AS sha FROM scoped WHERE pdf_current_hash IS NOT NULL
  UNION ALL SELECT record_id, version_id || 'x', pdf_current_hash FROM scoped WHERE pdf_current_hash IS NOT NULL AND pages = 3),
pg AS (SELECT record_id, count(DISTINCT version_id || '/' || sha) AS n, min(version_id) AS vid, min(sha) AS sha FROM prov GROUP BY 1),
br0 AS (SELECT {rn('version_id')} AS row_no, CASE WHEN pages = 5 THEN record_id || '-B1.pdf' WHEN pages = 7 THEN record_id || '_B 1.pdf' ELSE record_id || '_B1.pdf' END AS filename,
    CASE WHEN similarity = 0 THEN '< 1' WHEN similarity = 5 THEN 'high' WHEN similarity = 10 THEN '101' WHEN similarity = 15 THEN '' ELSE similarity || '.5%' END AS pp, single AS sp FROM versions WHERE active),
br AS (SELECT * FROM br0 UNION ALL SELECT row_no + 10000000, filename, pp, sp FROM br0 WHERE row_no % 97 = 0),
bn AS (SELECT *, CASE WHEN filename NOT LIKE '%\\_%' ESCAPE '\\' THEN 'Filename must use RecordID_token format.' WHEN filename LIKE '\\_%' ESCAPE '\\' THEN 'Record ID is missing before underscore.' ELSE '' END AS nerr FROM br),
bk AS (SELECT *, split_part(filename, '_', 1) AS record_id, replace(split_part(filename, '_', 2), '.pdf', '') AS token FROM bn WHERE nerr = ''),
bm AS (SELECT bk.*, count(*) OVER (PARTITION BY bk.record_id, token) AS n_same, pg.vid,
    CASE WHEN token LIKE '% %' THEN 'Batch token may only contain letters, numbers, underscore, or hyphen.'
      WHEN pg.n IS NULL THEN 'No durable batch record was found for this id and token; prepare a new batch.'
      WHEN pg.n > 1 THEN 'The token refers to different versions or file hashes.'
      WHEN pg.sha <> v.pdf_current_hash THEN 'The publication PDF changed after this batch was prepared.' ELSE '' END AS reason
  FROM bk LEFT JOIN pg ON pg.record_id = bk.record_id AND token NOT LIKE '% %' LEFT JOIN versions v ON v.version_id = pg.vid),
bs AS (SELECT bm.*, CASE WHEN reason = '' THEN '' WHEN reason LIKE 'Batch token%' THEN 'unmatched' ELSE 'stale' END AS kind,
    CASE pp WHEN 'high' THEN 'Plagiarism % must be blank (meaning missing), a number from 0 to 100, or ''<1''.' WHEN '101' THEN 'Plagiarism % must be between 0 and 100.' ELSE '' END AS perr,
    CASE WHEN pp = '< 1' THEN 1 WHEN pp = '' OR pp IS NULL OR pp IN ('high', '101') THEN NULL ELSE CAST(replace(pp, '.5%', '') AS DOUBLE) + 1 END AS ns FROM bm)
"""
SQL["batch_dispositions"] = query(
    ["scope"],
    """SELECT row_no, filename, NULL AS record_id, NULL AS token, NULL AS version_id, 'invalid' AS disposition, nerr AS reason, NULL AS before_similarity, NULL AS before_single, NULL AS similarity,
      NULL AS single, NULL AS report_stale FROM bn WHERE nerr <> ''
    UNION ALL SELECT row_no, filename, b.record_id, token, CASE WHEN d = 'updated' THEN vid END, d, r, CAST(CASE WHEN d = 'updated' THEN v.similarity END AS DOUBLE), CAST(CASE WHEN d = 'updated' THEN v.single END AS DOUBLE),
      CASE WHEN d = 'updated' THEN ns END, CAST(CASE WHEN d = 'updated' THEN sp END AS DOUBLE),
      CASE WHEN d = 'updated' THEN ((v.similarity IS DISTINCT FROM ns OR v.single IS DISTINCT FROM sp) AND v.report_path <> '') OR v.report_stale END
    FROM (SELECT *, CASE WHEN n_same > 1 THEN 'invalid' WHEN kind <> '' THEN kind WHEN perr <> '' THEN 'invalid' ELSE 'updated' END AS d,
      CASE WHEN n_same > 1 THEN 'The same id and batch token appears more than once.' WHEN kind <> '' THEN reason ELSE perr END AS r FROM bs) b LEFT JOIN versions v ON v.version_id = b.vid""",
    BATCH,
)
_REPORTS = BATCH.replace("br AS (SELECT * FROM br0", "br AS (SELECT row_no, CASE WHEN row_no % 89 = 0 THEN regexp_replace(filename, 'pdf$', 'docx') ELSE filename END AS filename, pp, sp FROM (SELECT * FROM br0").replace(
    "FROM br0 WHERE row_no % 97 = 0)", "FROM br0 WHERE row_no % 97 = 0))"
).replace("WHERE nerr = ''),", "WHERE nerr = '' AND filename LIKE '%.pdf'),", 1)
SQL["batch_report_dispositions"] = query(
    ["scope"],
    """SELECT row_no, filename, NULL AS record_id, NULL AS token, NULL AS version_id, 'invalid' AS disposition, CASE WHEN nerr <> '' THEN nerr ELSE 'A report must be a PDF file.' END AS reason,
      NULL AS report_path FROM bn WHERE nerr <> '' OR filename NOT LIKE '%.pdf'
    UNION ALL SELECT row_no, filename, record_id, token, CASE WHEN d = 'updated' THEN vid END, d, CASE WHEN n_same > 1 THEN 'The same id and batch token appears more than once.'
      WHEN d = 'updated' THEN '' WHEN d = 'invalid' THEN 'Several reports for one version.' ELSE reason END,
      CASE WHEN d = 'updated' THEN 'in/' || filename END FROM (
      SELECT *, CASE WHEN n_same > 1 THEN 'invalid' WHEN kind <> '' THEN kind WHEN count(*) FILTER (kind = '' AND n_same = 1) OVER (PARTITION BY vid) > 1 THEN 'invalid' ELSE 'updated' END AS d FROM bs)""",
    _REPORTS,
)
_MAN = """SELECT '{s}' AS scope, record_id, version_id, record_id || '_B2.pdf' AS file_name, pdf_current_hash AS sha256,
  CASE WHEN pdf_current_hash IS NULL THEN 'No publication PDF.' WHEN count(pdf_current_hash) OVER (PARTITION BY record_id) > 1 THEN 'Export file name is not unique.' ELSE '' END AS reason,
  similarity IS NULL AS missing_similarity, single IS NULL AS missing_single FROM (SELECT * FROM scoped WHERE {w})"""
SQL["batch_manifest"] = query(
    ["scope"], _MAN.format(s="all", w="true") + "\nUNION ALL " + _MAN.format(s="missing_results", w="similarity IS NULL OR single IS NULL")
)
SQL["token_bindings"] = query(
    ["scope"],
    """SELECT s.record_id, s.version_id, p.version_id AS bound_version FROM scoped s JOIN (SELECT DISTINCT * FROM prov) p USING (record_id)
    WHERE s.pdf_current_hash IS NOT NULL AND (s.version_id <> p.version_id OR s.pdf_current_hash <> p.sha)""",
    BATCH,
)
SQL["mirror_decision"] = query(
    _MV,
    """SELECT v.version_id, CASE m.decision WHEN 'not_publishing' THEN true WHEN 'publishing' THEN false ELSE v.excluded END AS excluded,
      CASE m.decision WHEN 'not_publishing' THEN m.exclusion_reason WHEN 'publishing' THEN '' ELSE v.exclusion_reason END AS exclusion_reason,
      CASE m.decision WHEN 'not_publishing' THEN m.exclusion_notes WHEN 'publishing' THEN '' ELSE v.exclusion_notes END AS exclusion_notes,
      strftime(CASE m.decision WHEN 'not_publishing' THEN m.excluded_at WHEN 'publishing' THEN NULL ELSE v.excluded_at END, '%Y-%m-%d %H:%M:%S') AS excluded_at
    FROM versions v LEFT JOIN master m USING (record_id)""",
)
SQL["mark_excluded"] = query(
    ["master"],
    """SELECT record_id, CASE WHEN decision = 'not_publishing' THEN 'publishing' WHEN bad THEN decision ELSE 'not_publishing' END AS decision,
      CASE WHEN decision = 'not_publishing' OR bad THEN '' ELSE 'unpaid' END AS exclusion_reason, CASE WHEN decision = 'not_publishing' OR bad THEN '' ELSE E'a\\n\\nb' END AS exclusion_notes,
      CASE WHEN decision = 'not_publishing' OR bad THEN NULL ELSE strftime(updated_at, '%Y-%m-%d %H:%M:%S') END AS excluded_at,
      decision = 'not_publishing' OR NOT bad AS accepted, CASE WHEN decision <> 'not_publishing' AND bad THEN 'Select a valid Not Publishing reason.' ELSE '' END AS refusal
    FROM (SELECT *, accept_status = '1-URGENT' AS bad FROM master)""",
)
SQL["discard_versions"] = query(
    ["versions"],
    "SELECT version_id, discarded, discard_notes, active2 AS active, replaced2 AS replaced FROM final",
    f"""dis AS (SELECT * REPLACE (CASE WHEN discarded THEN false WHEN {EVEN} THEN true ELSE false END AS discarded,
      CASE WHEN discarded THEN '' WHEN {EVEN} THEN 'bad scan' ELSE discard_notes END AS discard_notes) FROM versions),""" + flags("dis"),
)
_GRP = "(SELECT record_id, bool_or(excluded) AS x FROM versions WHERE record_id <> '' GROUP BY 1)"
SQL["guard_remap"] = query(
    _MV,
    f"""SELECT version_id, o AS old_record_id, nw AS new_record_id, reason = '' AS accepted, reason FROM (
      SELECT t.*, CASE WHEN o = nw THEN '' WHEN mo.decision IN ('not_publishing', 'decision_required') THEN 'current record is excluded or undecided'
        WHEN mn.decision IN ('not_publishing', 'decision_required') THEN 'target record is excluded or undecided' WHEN mo.decision IS NULL AND coalesce(go.x, false) THEN 'current group holds an excluded version'
        WHEN mn.decision IS NULL AND coalesce(gn.x, false) THEN 'target group holds an excluded version' ELSE '' END AS reason
      FROM (SELECT version_id, record_id AS o, CASE WHEN {EVEN} THEN 'P' || ({rn('version_id')} + 1) ELSE 'X' || {rn('version_id')} END AS nw FROM versions) t
      LEFT JOIN master mo ON mo.record_id = o LEFT JOIN master mn ON mn.record_id = nw LEFT JOIN {_GRP} go ON go.record_id = o LEFT JOIN {_GRP} gn ON gn.record_id = nw)""",
)
SQL["verify_identity"] = query(
    _MV,
    f"""SELECT version_id, o AS old_record_id, nw AS target_id, reason = '' AS accepted, reason FROM (
      SELECT t.*, CASE WHEN mn.decision IS NULL THEN 'ID not in master list' WHEN mn.decision = 'not_publishing' THEN 'target record is excluded' WHEN mn.decision = 'decision_required' THEN 'target record needs a decision'
        WHEN mo.decision = 'not_publishing' THEN 'current record is excluded' WHEN mo.decision = 'decision_required' THEN 'current record needs a decision'
        WHEN coalesce(go.x, false) THEN 'current group holds an excluded version' WHEN coalesce(gn.x, false) THEN 'target group holds an excluded version' ELSE '' END AS reason
      FROM (SELECT version_id, record_id AS o, CASE WHEN {EVEN} THEN record_id ELSE 'P' || {rn('version_id')} END AS nw FROM versions) t
      LEFT JOIN master mo ON mo.record_id = o LEFT JOIN master mn ON mn.record_id = nw LEFT JOIN {_GRP} go ON go.record_id = o LEFT JOIN {_GRP} gn ON gn.record_id = nw)""",
)
SQL["review_requests"] = query(
    ["versions"],
    f"""SELECT version_id, review_status AS old_status, reason = '' AS accepted, reason, CASE WHEN reason = '' THEN s ELSE review_status END AS review_status FROM (
      SELECT *, CASE WHEN s = 'done' THEN 'unknown status' WHEN s = 'review_ok' AND (trim(extracted_title) = '' OR trim(extracted_authors) = '') THEN 'extraction is incomplete' ELSE '' END AS reason
      FROM (SELECT *, CASE WHEN {EVEN} THEN 'review_ok' WHEN similarity = 5 THEN 'done' ELSE 'red_flag' END AS s FROM versions))""",
)
SQL["apply_measurements"] = query(
    ["scope"],
    """SELECT version_id, disp AS disposition, CASE WHEN done THEN np ELSE pages END AS pages, CASE WHEN done THEN pdf_current_hash ELSE pdf_hash END AS pdf_hash,
      CASE WHEN done THEN 'processed' WHEN disp = 'error' THEN 'error' ELSE processing_status END AS processing_status,
      CASE WHEN disp = 'integrity_reset' OR (done AND op IS DISTINCT FROM np) THEN false ELSE page_waiver_approved END AS page_waiver_approved,
      CASE WHEN disp = 'integrity_reset' THEN 'pending' ELSE review_status END AS review_status, CASE WHEN disp = 'integrity_reset' THEN 'pending' ELSE format_status END AS format_status
    FROM (SELECT *, disp IN ('processed', 'integrity_reset') AS done, CASE WHEN disp = 'integrity_reset' THEN NULL ELSE pages END AS op FROM (
      SELECT *, CASE WHEN pdf_current_hash IS NULL THEN 'error' WHEN pdf_hash = pdf_current_hash AND processing_status = 'processed' AND pages IS NOT NULL AND thumbnail_folder <> '' THEN 'skipped'
        WHEN np IS NULL THEN 'error' WHEN pdf_hash <> '' AND pdf_hash <> pdf_current_hash THEN 'integrity_reset' ELSE 'processed' END AS disp
      FROM (SELECT *, CASE WHEN format_status = 'pending' THEN NULL ELSE coalesce(pages, 7) + CASE WHEN pages % 3 = 0 THEN 1 ELSE 0 END END AS np FROM scoped)))""",
)
SQL["apply_extraction"] = query(
    ["scope"],
    """SELECT version_id, d AS disposition, CASE WHEN d = 'extracted' THEN trim(title) ELSE extracted_title END AS extracted_title,
      CASE WHEN d = 'extracted' THEN 'A. One and B. Two' ELSE extracted_authors END AS extracted_authors, CASE d WHEN 'skipped' THEN extraction_status ELSE d END AS extraction_status,
      CASE WHEN d = 'skipped' THEN review_status ELSE 'pending' END AS review_status, CASE WHEN d = 'skipped' THEN duplicate_review_status ELSE 'pending' END AS duplicate_review_status,
      CASE WHEN d = 'extracted' THEN false ELSE name_waiver_approved END AS name_waiver_approved
    FROM (SELECT *, CASE WHEN NOT ((extracted_title = '' AND extracted_authors = '') OR review_status IN ('pending', 'red_flag') OR extraction_status = 'error') THEN 'skipped'
      WHEN format_status = 'pending' THEN 'error' ELSE 'extracted' END AS d FROM scoped)""",
)
SQL["apply_override"] = query(
    ["scope"],
    f"""SELECT version_id, r = '' AS accepted, r AS refusal, t AS extracted_title, why AS override_reason FROM (
      SELECT *, CASE WHEN why = '' THEN 'reason is required' WHEN t = '' THEN 'title or authors are required' ELSE '' END AS r
      FROM (SELECT version_id, CASE WHEN {EVEN} THEN title ELSE '' END AS t, CASE WHEN format_status = 'pending' THEN '' ELSE 'layout' END AS why FROM scoped))""",
)
SQL["format_review"] = query(
    ["scope"],
    f"""SELECT version_id, refusal, CASE WHEN go THEN w ELSE format_status END AS format_status, CASE WHEN go AND w = 'review_ok' THEN source_current_hash WHEN go THEN '' ELSE source_hash END AS source_hash,
      extracted_title, extracted_authors, CASE WHEN go AND np AND title_author_source = 'manual_override' THEN 'unknown' ELSE title_author_source END AS title_author_source,
      CASE WHEN go AND np THEN 'new/' || version_id || '.pdf' ELSE corrected_pdf END AS corrected_pdf, CASE WHEN go AND ns THEN 'new/' || version_id || '.zip' ELSE corrected_source END AS corrected_source,
      CASE WHEN go AND np THEN NULL ELSE pages END AS pages, CASE WHEN go AND np THEN 'pending' ELSE processing_status END AS processing_status,
      CASE WHEN go AND (np OR ns) THEN 'pending' ELSE review_status END AS review_status, CASE WHEN go AND iss THEN 'Page 3: margins too wide' ELSE '' END AS added_note
    FROM (SELECT *, refusal = '' AS go FROM (SELECT *, CASE WHEN iss AND pages < 3 THEN 'page is outside the document'
        WHEN w = 'review_ok' AND ((corrected_source = '' AND source_file = '') OR source_current_hash IS NULL) THEN 'no source file to approve' ELSE '' END AS refusal
      FROM (SELECT *, CASE WHEN iss THEN 'needs_edit' WHEN (np OR ns) AND format_status = 'review_ok' THEN 'pending' WHEN {EVEN} THEN 'review_ok' ELSE 'needs_edit' END AS w
        FROM (SELECT *, coalesce(similarity = 10, false) AS np, coalesce(similarity = 20, false) AS ns, coalesce(similarity = 25, false) AS iss FROM scoped))))""",
)
SQL["apply_edits"] = query(
    ["scope"],
    f"""SELECT version_id, CASE WHEN e THEN upper(title) ELSE title END AS title, CASE WHEN s THEN 'new.zip' ELSE source_file END AS source_file, CASE WHEN a THEN 'C. Three' ELSE authors END AS authors,
      CAST(CASE WHEN sc THEN 12 ELSE similarity END AS DOUBLE) AS similarity, CASE WHEN e THEN false ELSE id_verified END AS id_verified,
      CASE WHEN sc AND report_path <> '' THEN true ELSE report_stale END AS report_stale, CASE WHEN s OR a THEN 'pending' ELSE review_status END AS review_status,
      CASE WHEN s OR a THEN 'pending' ELSE duplicate_review_status END AS duplicate_review_status, CASE WHEN a AND NOT s THEN false ELSE name_waiver_approved END AS name_waiver_approved,
      CASE WHEN s THEN '' ELSE corrected_pdf END AS corrected_pdf, CASE WHEN s THEN '' ELSE source_hash END AS source_hash, e OR s OR title_verify_blocked AS title_verify_blocked
    FROM (SELECT *, {EVEN} AS e, format_status = 'pending' AS s, coalesce(similarity = 20, false) AS a, coalesce(similarity = 10, false) AS sc FROM scoped)""",
)
SQL["editor_uploads"] = query(
    _MV,
    "SELECT version_id, record_id, origin, excluded, active2 AS active, replaced2 AS replaced FROM final",
    """edu AS (SELECT version_id, record_id, origin, excluded, discarded, created_at FROM versions
      UNION ALL SELECT 'EDITOR-' || record_id || '-001', record_id, 'editor_upload', decision = 'not_publishing', false, created_at FROM master),""" + flags("edu"),
)
