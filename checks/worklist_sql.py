"""SQL for resolution, title evaluation, worklist counts, pages and queues."""

from checks.base_sql import natkey, norm, query
from checks.oracle import SQL
from checks.rules_sql import COMBINED

CANON_RAW = "regexp_replace(upper(trim({0})), '[\\s_-]+', '', 'g')"
CANON = (
    "CASE WHEN regexp_matches(" + CANON_RAW + ", '^[A-Z]+\\d+$') THEN regexp_extract(" + CANON_RAW
    + ", '^([A-Z]+)', 1) || ':' || regexp_extract(" + CANON_RAW + ", '^[A-Z]+0*(\\d+)$', 1) ELSE " + CANON_RAW + " END"
)


def canon(x):
    return CANON.format(x)


def _resolve(source):
    """CTE resolved(version_id, entered, resolved_id, step) for source(version_id, entered_id, title)."""
    number = "CASE WHEN regexp_matches(record_id, '^[A-Za-z]+\\d+$') THEN CAST(regexp_extract(record_id, '(\\d+)$', 1) AS HUGEINT) END"
    return f"""
e1 AS (SELECT lower(record_id) AS k, count(*) AS n, min(record_id) AS hit FROM master GROUP BY 1),
e2 AS (SELECT {canon('record_id')} AS k, min(record_id) AS hit FROM master GROUP BY 1 HAVING count(*) = 1),
e3 AS (SELECT {number} AS k, {norm('title')} AS tt, min(record_id) AS hit FROM master GROUP BY 1, 2 HAVING count(*) = 1),
resolved AS (
  SELECT version_id, entered, CASE step WHEN 'exact' THEN h1 WHEN 'canonical' THEN h2 WHEN 'number_and_title' THEN h3 ELSE entered END AS resolved_id, step FROM (
    SELECT c.version_id, c.entered, e1.hit AS h1, e2.hit AS h2, e3.hit AS h3,
      CASE WHEN c.entered = '' THEN 'blank' WHEN e1.n = 1 THEN 'exact' WHEN e1.n > 1 THEN 'ambiguous' WHEN e2.hit IS NOT NULL THEN 'canonical'
        WHEN e3.hit IS NOT NULL THEN 'number_and_title' ELSE 'raw' END AS step
    FROM (SELECT version_id, trim(entered_id) AS entered, title FROM {source}) c
    LEFT JOIN e1 ON e1.k = lower(c.entered) LEFT JOIN e2 ON e2.k = {canon('c.entered')}
    LEFT JOIN e3 ON regexp_matches(c.entered, '^\\d+$') AND e3.k = TRY_CAST(c.entered AS HUGEINT) AND e3.tt = {norm('c.title')} AND e3.tt <> ''))
"""


SQL["resolve_identifier"] = query(
    ["master", "claims"], "SELECT version_id, entered, resolved_id, step FROM resolved", _resolve("claims")
)
SQL["resolve_on_reimport"] = query(
    ["master", "claims"],
    """SELECT version_id, CASE resolution WHEN 'preserved' THEN record_id ELSE resolved_id END AS record_id, resolution FROM (
      SELECT r.version_id, c.record_id, r.resolved_id, CASE WHEN c.entered_id = r.entered AND c.record_id <> '' THEN 'preserved'
        WHEN c.entered_id = r.entered THEN 'resolved_missing' ELSE 'author_entered_id_changed' END AS resolution
      FROM resolved r JOIN claims c USING (version_id))""",
    """again AS (SELECT version_id, title, CASE WHEN CAST(substr(version_id, 2, 1) AS INTEGER) % 2 = 0 THEN entered_id
      ELSE 'P-' || regexp_replace(entered_id, '^[Pp]?-?0*', '') END AS entered_id FROM claims),""" + _resolve("again"),
)


def lev(a, b):
    na, nb = norm(a), norm(b)
    return (
        f"CASE WHEN {na} = '' OR {nb} = '' THEN NULL ELSE round(100.0 * (1.0 - levenshtein({na}, {nb}) / "
        f"CAST(greatest(length({na}), length({nb})) AS DOUBLE)), 2) END"
    )


def ident(source):
    return f"""
i1 AS (SELECT v.*, m.title AS mtt, m.decision AS mdd, CASE WHEN m.decision IS NOT NULL THEN {lev('v.title', 'm.title')} END AS sc,
    coalesce({norm('v.title')} <> '' AND {norm('v.title')} = {norm('m.title')}, false) AS same FROM {source} v LEFT JOIN master m USING (record_id)),
i2 AS (SELECT *, coalesce(mdd = 'not_publishing', excluded) AS ex FROM i1),
i3 AS (SELECT *, CASE WHEN ex OR mdd IS NULL THEN 'invalid_paper_id' WHEN sc IS NULL THEN CASE WHEN id_verified THEN 'verified' ELSE 'pending' END
    WHEN same AND auto_verify_blocked THEN 'pending' WHEN same THEN 'verified' WHEN sc >= 80 THEN CASE WHEN id_verified THEN 'verified' ELSE 'pending' END
    WHEN id_verified THEN 'verified' ELSE 'title_mismatch' END AS status FROM i2),
idt AS (SELECT *, NOT ex AND (id_verified OR (status = 'verified' AND same)) AS is_verified FROM i3)
"""


SQL["identity_status"] = query(
    ["master", "versions"],
    """SELECT version_id, record_id, status, CASE WHEN NOT ex THEN sc END AS score,
      CASE WHEN ex THEN 'Left out of the publication.' WHEN mdd IS NULL THEN 'No master record has this id; titles were not searched.'
        WHEN sc IS NULL AND id_verified THEN 'Id confirmed by hand; a title is missing, so none were compared.'
        WHEN sc IS NULL THEN 'A title is missing, so none were compared.'
        WHEN same AND auto_verify_blocked THEN 'Same title as ' || record_id || ', but taken back to unverified by hand.'
        WHEN same THEN 'Same title as ' || record_id || '; verified automatically.'
        WHEN sc >= 80 THEN 'Title agrees with ' || record_id || ' to ' || sc || '%.'
        WHEN id_verified THEN 'Id confirmed by hand. Title agrees with ' || record_id || ' to ' || sc || '% only.'
        ELSE 'Title agrees with ' || record_id || ' to ' || sc || '%.' END AS message,
      NOT ex AND same AS is_identical, is_verified, is_verified AND NOT same AS verified_with_diff, NOT ex AND NOT is_verified AS needs_verification FROM idt""",
    ident("versions"),
)
XT = f"""
x1 AS (SELECT *, {lev('title', 'extracted_title')} AS sc, {norm('title')} <> '' AND {norm('title')} = {norm('extracted_title')} AS same,
  title = '' OR extracted_title = '' AS miss FROM SRC),
x2 AS (SELECT *, CASE WHEN miss THEN 'missing' WHEN same AND title_verify_blocked THEN 'pending' WHEN same THEN 'verified'
    WHEN coalesce(sc >= 90, false) THEN CASE WHEN title_verified THEN 'verified' ELSE 'pending' END ELSE 'title_mismatch' END AS status,
  CASE WHEN miss THEN false WHEN same AND NOT title_verify_blocked THEN true ELSE title_verified END AS nv FROM x1),
xt AS (SELECT *, nv OR (review_status = 'review_ok' AND NOT miss) AS done FROM x2)
"""
SQL["extracted_title_status"] = query(
    ["versions"],
    """SELECT version_id, record_id, status, sc AS score,
      CASE WHEN miss THEN 'One of the two titles is missing.' WHEN same AND title_verify_blocked
        THEN 'Same titles, but taken back to unverified by hand.' WHEN same THEN 'Same titles; verified automatically.'
        ELSE 'The extracted title agrees to ' || CASE WHEN coalesce(sc, 0) = 0 THEN '0' ELSE CAST(sc AS VARCHAR) END || '%.' END AS message,
      nv AS title_verified, same AS is_identical, done AS is_verified, done AND NOT same AS verified_with_diff, NOT miss AND NOT done AS needs_verification FROM xt""",
    XT.replace("SRC", "versions"),
)
GUARD = f"""
refs AS (SELECT version_id, 1 AS position, 'Master' AS label, m.title FROM scoped s JOIN master m USING (record_id)
  UNION ALL SELECT version_id, 2, 'Final', s.title FROM scoped s),
grp AS (SELECT version_id, min(position) AS position, string_agg(label, ' = ' ORDER BY position) AS labels, max(trim(title)) AS ref_title FROM refs
  GROUP BY version_id, CASE WHEN trim(title) = '' THEN chr(1) || position ELSE trim(title) END),
guard AS (SELECT version_id, position, labels, ref_title, available, state,
    CASE state WHEN 'unavailable' THEN 'danger' WHEN 'missing' THEN 'danger' WHEN 'exact' THEN 'success' WHEN 'formatting' THEN 'info' ELSE 'warning' END AS level FROM (
  SELECT g.*, a.available, CASE WHEN NOT a.available THEN 'unavailable' WHEN ref_title = '' THEN 'missing' WHEN ref_title = x THEN 'exact'
    WHEN {norm('ref_title')} <> '' AND {norm('ref_title')} = {norm('x')} THEN 'formatting' ELSE 'differs' END AS state
  FROM grp g JOIN (SELECT version_id, trim(extracted_title) AS x, extraction_status = 'extracted' AND trim(extracted_title) <> '' AS available FROM scoped) a USING (version_id)))
"""
SQL["title_guard"] = query(["scope"], "SELECT * FROM guard", GUARD)
SQL["title_guard_summary"] = query(
    ["scope"],
    """SELECT version_id, CASE r WHEN 3 THEN 'danger' WHEN 2 THEN 'warning' WHEN 1 THEN 'info' ELSE 'success' END AS summary_level,
      CASE WHEN NOT av THEN 'PDF title could not be checked' WHEN r = 3 THEN 'Title reference is incomplete' WHEN r = 2 THEN 'Possible wrong paper'
        WHEN r = 1 THEN 'Formatting-only title difference' ELSE 'Titles match' END AS summary_label
    FROM (SELECT version_id, max(CASE level WHEN 'danger' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 ELSE 0 END) AS r, bool_and(available) AS av FROM guard GROUP BY version_id)""",
    GUARD,
)
SQL["ranked_lookup"] = query(
    ["master"],
    """SELECT record_id, title, tier FROM (SELECT record_id, title, CASE WHEN lower(record_id) = 'p12' THEN 0 WHEN lower(record_id) LIKE 'p12%' THEN 1
      WHEN lower(record_id) LIKE '%p12%' THEN 2 WHEN lower(title) LIKE '%p12%' THEN 3 WHEN lower(authors) LIKE '%p12%' THEN 4 END AS tier FROM master)
    WHERE tier IS NOT NULL ORDER BY tier, record_id LIMIT 20""",
)


def counts(tests):
    return "SELECT " + ", ".join(f"count(*) FILTER ({t}) AS n_{k}" for k, t in tests.items())


_MISS = "(extracted_title = '' AND extracted_authors = '')"
SQL["extraction_filter_counts"] = query(
    ["scope"],
    counts({
        "needs_verification": f"{_MISS} OR review_status IN ('pending', 'red_flag') OR extraction_status = 'error'", "pending": "review_status = 'pending'",
        "red_flag": "review_status = 'red_flag'", "review_ok": "review_status = 'review_ok'", "reviewed_differences": "review_status = 'review_ok' AND NOT same",
        "missing": _MISS, "verified": "review_status = 'review_ok'", "errors": "extraction_status = 'error'", "manual_override": "title_author_source = 'manual_override'",
        "title_mismatch": "status = 'title_mismatch'", "all": "true",
    }) + " FROM xt",
    XT.replace("SRC", "scoped"),
)
SQL["extraction_overwrite_summary"] = query(
    ["scope"],
    """SELECT count(*) AS active, count(*) FILTER (extracted_title <> '' OR extracted_authors <> '') AS with_extraction,
    count(*) FILTER (review_status = 'review_ok') AS reviewed, count(*) FILTER (title_verified) AS matched FROM scoped""",
)
_ED = "(corrected_pdf <> '' OR corrected_source <> '')"
SQL["formatting_filter_counts"] = query(
    ["scope"],
    counts({
        "needs_attention": "format_status <> 'review_ok'", "pending": "format_status = 'pending'", "needs_edit": "format_status = 'needs_edit'",
        "review_ok": "format_status = 'review_ok'", "review_ok_no_edit": f"format_status = 'review_ok' AND NOT {_ED}", "edited": _ED, "all": "true",
    }) + " FROM scoped",
)
SQL["identity_filter_counts"] = query(
    ["scope"],
    counts({
        "all": "true", "needs_verification": "NOT ex AND NOT is_verified", "verified_with_diff": "is_verified AND NOT same", "identical": "NOT ex AND same",
        "title_mismatch": "status = 'title_mismatch' AND NOT is_verified",
    }) + " FROM idt",
    ident("publishable"),
)
_NP = "((corrected_pdf <> '' OR pdf_file <> '') AND (processing_status <> 'processed' OR pages IS NULL OR pdf_hash = '' OR thumbnail_status <> 'processed' OR thumbnail_folder = ''))"
SQL["processing_filter_counts"] = query(
    ["scope"],
    counts({
        "needs_processing": _NP, "page_issues": "pages < 6 OR pages > 12",
        "processed": f"processing_status = 'processed' AND NOT {_NP} AND (corrected_pdf <> '' OR pdf_file <> '')", "all": "true",
    }) + " FROM scoped",
)
SQL["version_filter_counts"] = query(
    ["groups"],
    counts({
        "all": "true", "version_conflicts": "NOT discarded AND record_id IN (SELECT record_id FROM record_groups WHERE decision = 'publishing' AND n_author > 0 AND n_editor > 0)",
        "editor_uploads": "origin = 'editor_upload'", "discarded": "discarded", "start2": "origin = 'start2'",
    }) + " FROM versions",
)
SQL["name_filter_counts"] = query(
    ["counts"],
    counts({
        "all": "true", "attention": "over_limit OR n_repeat_records > 0", "over_limit": "over_limit", "duplicates": "n_repeat_records > 0", "allowed": "over_limit AND waiver_valid",
    }) + " FROM counts",
)
_OLD = SQL["old_versions"]
SQL["old_version_counts"] = (
    "SELECT count(*) AS n_all, count(*) FILTER (old_status = 'replaced') AS n_replaced, count(*) FILTER (old_status = 'discarded') AS n_discarded, "
    "count(*) FILTER (origin_label = 'Editor Upload') AS n_editor_uploads, count(*) FILTER (origin_label = 'Start2') AS n_start2, "
    f"count(*) FILTER (old_status = 'other') AS n_other FROM ({_OLD})"
)
SQL["combined_page_2"] = query(
    ["scope", "groups"],
    "SELECT priority, rid AS record_id, version_id, blocker FROM comb ORDER BY priority, rid, version_id LIMIT 25 OFFSET 25",
    COMBINED,
)
SQL["natural_sort_page"] = query(
    ["versions"],
    f"""SELECT version_id, record_id, title FROM versions ORDER BY record_id = '', {natkey('record_id')} DESC, upload_date DESC, created_at DESC, version_id
    LIMIT 50 OFFSET 100""",
)
SQL["name_page"] = query(
    ["counts"],
    """SELECT norm, n_records, n_repeat_records, over_limit, waiver_valid FROM counts
    ORDER BY over_limit AND NOT waiver_valid DESC, n_repeat_records > 0 DESC, n_records DESC, norm LIMIT 25 OFFSET 25""",
)
SQL["queue_neighbours"] = query(
    ["scope"],
    """SELECT version_id AS key, last_value(e IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_key,
      first_value(e IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_key,
      count(e) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eligible_up_to,
      count(e) OVER () - count(e) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eligible_after
    FROM (SELECT *, CASE WHEN format_status <> 'review_ok' THEN version_id END AS e,
      CASE format_status WHEN 'pending' THEN 0 WHEN 'needs_edit' THEN 1 WHEN 'review_ok' THEN 2 ELSE 3 END AS fr FROM scoped)
    WINDOW w AS (ORDER BY fr, record_id, version_id)""",
)
