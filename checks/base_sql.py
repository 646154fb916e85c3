"""DuckDB text for the shared inputs: the same tables, written independently in SQL."""

NATKEY = (
    "list_transform(regexp_extract_all({0}, '(\\d+|\\D+)'), lambda p: CASE WHEN regexp_matches(p, '^\\d') "
    "THEN {{'t': 0, 'n': length(regexp_replace(p, '^0+(\\d)', '\\1')), 's': regexp_replace(p, '^0+(\\d)', '\\1')}} "
    "ELSE {{'t': 1, 'n': 0, 's': lower(p)}} END)"
)
NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
NAME_SEP = (
    "(?i)[\\r\\n]+|[^\\S\\r\\n]*,[^\\S\\r\\n]*(?:and|&)[^\\S\\r\\n]+|[^\\S\\r\\n]+(?:and|&)[^\\S\\r\\n]+"
    "|[^\\S\\r\\n]*[;,][^\\S\\r\\n]*"
)
SPLIT = (
    "list_filter(list_transform(regexp_split_to_array({0}, '" + NAME_SEP + "'), lambda p: trim(p, ' \t,;')), "
    "lambda p: p <> '')"
)
NAME_NORM = (
    "trim(regexp_replace(regexp_replace(lower({0}), '[[:punct:]]', '', 'g'), '\\s+', ' ', 'g'))"
)


def natkey(x):
    return NATKEY.format(x)


def norm(x):
    return NORM.format(x)


def split_names(x):
    return SPLIT.format(x)


def name_norm(x):
    return NAME_NORM.format(x)


MASTER = """
master AS (
  SELECT 'P' || o_orderkey AS record_id, o_orderpriority AS accept_status,
    CASE WHEN o_custkey % 50 = 0 THEN '' ELSE 'Shipment ' || o_orderkey || ' for customer ' || o_custkey
      || ' dated ' || strftime(o_orderdate, '%Y-%m-%d') END AS title,
    'Customer ' || o_custkey AS authors,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'Expedite' ELSE '' END AS notes,
    CASE o_orderstatus WHEN 'F' THEN 'publishing' WHEN 'O' THEN 'not_publishing' ELSE 'decision_required' END AS decision,
    CASE WHEN o_orderstatus <> 'O' THEN '' WHEN o_custkey % 2 = 0 THEN 'unpaid' ELSE 'withdrawn' END AS exclusion_reason,
    CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN 'low priority' ELSE '' END AS exclusion_notes,
    CASE WHEN o_orderstatus = 'O' THEN o_orderdate END AS excluded_at,
    o_orderdate AS created_at, o_orderdate AS updated_at
  FROM orders)
"""

CLAIMS = """
raw AS (
  SELECT l.*, CAST(round(l_discount * 100) AS INTEGER) AS d, CAST(round(l_tax * 100) AS INTEGER) AS t,
    l_linenumber AS n, CAST(l_quantity AS INTEGER) AS q, l_returnflag AS rf, l_linestatus AS ls,
    'F' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_orderkey AS vid,
    o_orderstatus AS os,
    CASE WHEN o_custkey % 50 = 0 THEN '' ELSE 'Shipment ' || o_orderkey || ' for customer ' || o_custkey
      || ' dated ' || strftime(o_orderdate, '%Y-%m-%d') END AS mt
  FROM lineitem l LEFT JOIN orders ON o_orderkey = l_orderkey),
raw2 AS (
  SELECT *,
    (d = 10 AND rf = 'N') AS orphan, (d = 10 AND rf = 'A' AND t = 0) AS blank,
    CASE WHEN n = 3 AND rf = 'N' THEN 'error' WHEN n = 4 AND rf = 'R' THEN 'pending' ELSE 'processed' END AS state,
    CASE WHEN t <= 4 THEN 'review_ok' WHEN t <= 6 THEN 'needs_edit' ELSE 'pending' END AS fmt,
    list_transform(range(0, n + 1), lambda i: CASE WHEN rf = 'R' THEN upper('W. Author-' || (l_partkey + i * l_suppkey))
      ELSE 'W. Author-' || (l_partkey + i * l_suppkey) END) AS people,
    sha256('pdf-' || l_partkey || '-' || l_suppkey) AS pdf_sha, sha256('src-' || l_partkey || '-' || n) AS src_sha,
    CASE WHEN mt = '' OR t = 8 THEN '' WHEN ls = 'F' AND rf = 'A' THEN mt WHEN ls = 'F' AND rf = 'N' THEN upper(mt) || '!'
      WHEN ls = 'F' THEN mt || ' revised' ELSE mt || ' volume ' || n END AS ttl
  FROM raw),
raw3 AS (
  SELECT *, CASE WHEN orphan OR blank THEN q > 25 ELSE (os = 'O') <> (t = 8 AND n = 7) END AS excl,
    CASE rf WHEN 'A' THEN array_to_string(people, ', ') WHEN 'N' THEN array_to_string(people, '; ')
      ELSE array_to_string(people, ' and ') END AS joined,
    CASE WHEN state = 'processed' AND d <> 10 THEN CAST(floor(q / 3.0) AS INTEGER) END AS pg,
    CASE WHEN l_suppkey % 10 = 0 THEN '' ELSE 'pdf/' || vid || '.pdf' END AS pdf_f,
    CASE WHEN l_suppkey % 10 = 1 THEN '' ELSE 'src/' || vid || '.zip' END AS src_f,
    CASE WHEN n = 6 THEN 'fixed/' || vid || '.pdf' ELSE '' END AS fix_p,
    CASE WHEN n = 6 AND t >= 4 THEN 'fixed/' || vid || '.zip' ELSE '' END AS fix_s,
    (rf = 'A' AND n >= 5) AS name_ok, (rf = 'A' AND q >= 36) AS page_ok,
    (rf IN ('A', 'R') AND d >= 8) AS sim_ok, (rf = 'A' AND t >= 6) AS single_ok
  FROM raw2),
claims AS (
  SELECT vid AS version_id,
    CASE rf WHEN 'A' THEN 'p-00' || l_orderkey WHEN 'N' THEN 'P' || l_orderkey ELSE CAST(l_orderkey AS VARCHAR) END AS entered_id,
    CASE WHEN orphan THEN 'X' || l_orderkey WHEN blank THEN '' ELSE 'P' || l_orderkey END AS record_id,
    ttl AS title, joined AS authors, l_shipdate AS upload_date,
    CASE WHEN rf = 'R' AND t >= 6 THEN 'editor_upload' ELSE 'start2' END AS origin,
    (ls = 'O' AND rf = 'N' AND n >= 5) AS discarded,
    CASE WHEN ls = 'O' AND rf = 'N' AND n = 5 THEN ' superseded ' ELSE '' END AS discard_notes,
    CASE WHEN rf = 'R' AND t >= 6 AND n = 1 THEN 'late fix' ELSE '' END AS editor_notes,
    excl AS excluded,
    CASE WHEN NOT excl THEN '' WHEN q % 2 = 0 THEN 'unpaid' ELSE 'withdrawn' END AS exclusion_reason,
    CASE WHEN excl AND n = 1 THEN 'per office' ELSE '' END AS exclusion_notes,
    CASE WHEN excl THEN l_shipdate END AS excluded_at,
    pdf_f AS pdf_file, src_f AS source_file, fix_p AS corrected_pdf, fix_s AS corrected_source,
    CASE WHEN fix_p = '' AND pdf_f = '' THEN NULL WHEN fix_p <> '' AND d = 1 THEN NULL
      WHEN n = 2 AND rf = 'R' THEN sha256('new-' || l_partkey) ELSE pdf_sha END AS pdf_current_hash,
    CASE WHEN state = 'processed' THEN pdf_sha ELSE '' END AS pdf_hash,
    state AS processing_status, CASE WHEN state = 'error' THEN 'unreadable file' ELSE '' END AS processing_message,
    CASE WHEN state = 'processed' THEN 'processed' ELSE '' END AS thumbnail_status,
    CASE WHEN state = 'processed' THEN 'thumbs/' || vid ELSE '' END AS thumbnail_folder,
    pg AS pages,
    CASE WHEN fmt = 'review_ok' AND t <> 1 THEN src_sha ELSE '' END AS source_hash,
    CASE WHEN fix_s = '' AND src_f = '' THEN NULL WHEN fix_s <> '' AND d = 2 THEN NULL
      WHEN d = 5 AND rf = 'A' THEN sha256('src2-' || l_partkey) ELSE src_sha END AS source_current_hash,
    fmt AS format_status,
    CASE WHEN d = 9 THEN '' WHEN ls = 'F' THEN ttl ELSE mt END AS extracted_title,
    CASE WHEN d = 8 AND rf = 'R' THEN '' ELSE joined END AS extracted_authors,
    CASE WHEN n = 7 AND rf = 'R' THEN 'manual_override' ELSE 'built_in_extractor' END AS title_author_source,
    CASE WHEN n = 7 AND rf = 'R' AND d > 5 THEN 'layout unreadable' ELSE '' END AS override_reason,
    CASE WHEN n = 3 AND rf = 'A' THEN 'error' ELSE 'extracted' END AS extraction_status,
    CASE WHEN d <= 1 AND rf = 'R' THEN 'red_flag' WHEN d >= 6 THEN 'pending' ELSE 'review_ok' END AS review_status,
    CASE WHEN t >= 4 THEN 'review_ok' ELSE 'pending' END AS duplicate_review_status,
    name_ok AS name_waiver_approved, CASE WHEN name_ok AND d <> 0 THEN 'consortium' ELSE '' END AS name_waiver_reason,
    CASE WHEN name_ok THEN CASE WHEN d = 3 THEN n ELSE n + 1 END END AS name_waiver_value,
    page_ok AS page_waiver_approved, CASE WHEN page_ok THEN 'survey paper' ELSE '' END AS page_waiver_reason,
    CASE WHEN page_ok THEN CASE WHEN t = 2 THEN pg - 1 ELSE pg END END AS page_waiver_value,
    CASE WHEN NOT (t = 7 AND rf = 'N') THEN d * 5 END AS similarity,
    CASE WHEN NOT (d = 7 AND rf = 'N') THEN t * 2 END AS single,
    sim_ok AS similarity_waiver_approved, CASE WHEN sim_ok THEN 'cited text' ELSE '' END AS similarity_waiver_reason,
    CASE WHEN sim_ok THEN CASE WHEN rf = 'A' THEN d * 5 ELSE d * 5 - 5 END END AS similarity_waiver_value,
    single_ok AS single_waiver_approved,
    CASE WHEN single_ok AND n <> 2 THEN 'own preprint' ELSE '' END AS single_waiver_reason,
    CASE WHEN single_ok THEN CASE WHEN n = 1 THEN t * 2 - 1 ELSE t * 2 END END AS single_waiver_value,
    CASE WHEN n >= 4 THEN 'reports/' || vid || '.pdf' ELSE '' END AS report_path, (n = 5 AND rf = 'A') AS report_stale,
    (rf = 'R' OR (rf = 'N' AND ls = 'O')) AS id_verified, (n = 2 AND rf = 'A') AS auto_verify_blocked,
    CASE WHEN ls = 'O' THEN 'title_mismatch' ELSE 'pending' END AS verification_status, '' AS verification_message,
    (d <= 2) AS title_verified, (d = 2 AND n = 1) AS title_verify_blocked,
    l_shipdate AS created_at, l_shipdate AS updated_at,
    (n = 7 AND rf = 'A' AND t = 5 AND ls = 'F') AS stale_active
  FROM raw3)
"""


def ranked(rule="final_id"):
    """claims + rn: 1 for the version the rule selects; NULL when it does not compete."""
    date = "upload_date DESC, " if rule == "upload_date" else ""
    name = "ranked" if rule == "final_id" else "ranked_date"
    return f"""
{name} AS (
  SELECT version_id, row_number() OVER (PARTITION BY record_id ORDER BY origin = 'editor_upload' DESC, {date}
    {natkey('version_id')} DESC, created_at DESC, version_id DESC) AS rn
  FROM claims WHERE NOT discarded AND record_id <> '')
"""


VERSIONS = """
versions AS (
  SELECT c.* EXCLUDE (stale_active), (coalesce(rn = 1, false) OR stale_active) AS active,
    (coalesce(rn > 1, false)) AS replaced
  FROM claims c LEFT JOIN ranked USING (version_id))
"""

WAIVERS = """
waivers AS (
  SELECT 'w author' || doc_id AS norm, quality = 1 AS approved, CASE WHEN toxic = 1 THEN '' ELSE 'series editor' END AS reason,
    CAST(doc_id % 4 + 4 AS INTEGER) AS approved_count FROM labels)
"""

SCOPE = """
av AS (SELECT * FROM versions WHERE active AND NOT discarded),
publishable AS (
  SELECT av.*, m.decision AS m_decision FROM av LEFT JOIN master m USING (record_id)
  WHERE CASE WHEN m.decision IS NULL THEN NOT excluded ELSE m.decision = 'publishing' END),
scoped AS (SELECT * FROM publishable WHERE m_decision = 'publishing')
"""

CURRENT = """
current_v AS (
  SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY upload_date, created_at, version_id) AS rk FROM scoped)
  WHERE rk = 1)
"""

ENTRIES = f"""
entries AS (
  SELECT record_id, version_id, position, name, {name_norm('name')} AS norm FROM (
    SELECT record_id, version_id, unnest(nm) AS name, unnest(range(1, len(nm) + 1)) AS position
    FROM (SELECT record_id, version_id, {split_names('extracted_authors')} AS nm FROM scoped))
  WHERE {name_norm('name')} <> '')
"""

COUNTS = """
name_recs AS (
  SELECT norm, record_id, max(n) > 1 AS repeats FROM
    (SELECT norm, record_id, version_id, count(*) AS n FROM entries GROUP BY ALL) GROUP BY norm, record_id),
spelled AS (
  SELECT norm, string_agg(name, '; ' ORDER BY r, p, name) AS display_name FROM (
    SELECT norm, name, arg_min(record_id, {'r': record_id, 'p': position}) AS r,
      arg_min(position, {'r': record_id, 'p': position}) AS p FROM entries GROUP BY norm, name) GROUP BY norm),
counts AS (
  SELECT *, n_records > 3 AS over_limit,
    coalesce(waiver_approved AND trim(waiver_reason) <> '' AND waiver_count = n_records, false) AS waiver_valid,
    'author_limit:' || norm AS exception_key
  FROM (SELECT r.norm, count(*) AS n_records, count(*) FILTER (repeats) AS n_repeat_records, min(record_id) AS first_record_id
        FROM name_recs r GROUP BY r.norm) x
  JOIN spelled USING (norm)
  LEFT JOIN (SELECT norm, approved AS waiver_approved, reason AS waiver_reason, approved_count AS waiver_count FROM waivers) w USING (norm))
"""

GROUPS = """
record_groups AS (
  SELECT coalesce(g.record_id, m.record_id) AS record_id, m.decision,
    coalesce(n_versions, 0) AS n_versions, coalesce(n_all_excluded, 0) AS n_all_excluded, coalesce(n_active, 0) AS n_active,
    coalesce(n_excluded, 0) AS n_excluded, coalesce(n_included, 0) AS n_included, coalesce(n_author, 0) AS n_author,
    coalesce(n_editor, 0) AS n_editor
  FROM (SELECT record_id, count(*) AS n_versions, count(*) FILTER (excluded) AS n_all_excluded,
      count(*) FILTER (NOT discarded AND active) AS n_active, count(*) FILTER (NOT discarded AND excluded) AS n_excluded,
      count(*) FILTER (NOT discarded AND NOT excluded) AS n_included,
      count(*) FILTER (NOT discarded AND origin <> 'editor_upload') AS n_author,
      count(*) FILTER (NOT discarded AND origin = 'editor_upload') AS n_editor
    FROM versions WHERE record_id <> '' GROUP BY record_id) g
  FULL JOIN master m ON m.record_id = g.record_id)
"""

_ORDER = {
    "master": MASTER,
    "claims": CLAIMS,
    "ranked": ranked(),
    "ranked_date": ranked("upload_date"),
    "versions": VERSIONS,
    "waivers": WAIVERS,
    "scope": SCOPE,
    "current": CURRENT,
    "entries": ENTRIES,
    "counts": COUNTS,
    "groups": GROUPS,
}
_NEEDS = {
    "ranked": ("claims",),
    "ranked_date": ("claims",),
    "versions": ("claims", "ranked"),
    "scope": ("master", "claims", "ranked", "versions"),
    "current": ("master", "claims", "ranked", "versions", "scope"),
    "entries": ("master", "claims", "ranked", "versions", "scope"),
    "counts": ("master", "claims", "ranked", "versions", "scope", "entries", "waivers"),
    "groups": ("master", "claims", "ranked", "versions"),
}


def query(parts, body, extra=""):
    """WITH the named inputs (and what they need), optional further CTEs, then the body."""
    wanted = set(parts)
    for part in parts:
        wanted |= set(_NEEDS.get(part, ()))
    ctes = [text.strip() for name, text in _ORDER.items() if name in wanted]
    if extra:
        ctes.append(extra.strip())
    return "WITH " + ",\n".join(ctes) + "\n" + body
