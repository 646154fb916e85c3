"""SQL for the registered queries, by query name."""

from checks.base_sql import name_norm, norm, query, split_names

SQL: dict[str, str] = {}

SQL["select_active"] = query(
    ["claims", "ranked"],
    "SELECT version_id, record_id, coalesce(rn = 1, false) AS active FROM claims LEFT JOIN ranked USING (version_id)",
)
SQL["select_active_by_date"] = query(
    ["claims", "ranked_date"],
    "SELECT record_id, version_id FROM claims JOIN ranked_date USING (version_id) WHERE rn = 1",
)
SQL["mark_replaced"] = query(
    ["claims", "ranked"],
    "SELECT version_id, record_id, origin FROM claims JOIN ranked USING (version_id) WHERE rn > 1",
)
SQL["rule_change_preview"] = query(
    ["claims", "ranked", "ranked_date"],
    """SELECT coalesce(b.record_id, a.record_id) AS record_id, coalesce(b.version_id, '') AS before_id,
      coalesce(a.version_id, '') AS after_id
    FROM (SELECT record_id, version_id FROM claims JOIN ranked USING (version_id) WHERE rn = 1) b
    FULL JOIN (SELECT record_id, version_id FROM claims JOIN ranked_date USING (version_id) WHERE rn = 1) a
      ON a.record_id = b.record_id
    WHERE a.version_id IS DISTINCT FROM b.version_id""",
)
SQL["missing_versions"] = query(
    ["scope"],
    """SELECT record_id, title, notes FROM master WHERE decision = 'publishing'
    AND NOT EXISTS (SELECT 1 FROM av WHERE av.record_id = master.record_id)""",
)
SQL["orphan_versions"] = query(
    ["scope"], "SELECT version_id, record_id, entered_id FROM publishable WHERE m_decision IS NULL"
)
SQL["in_scope"] = query(["scope"], "SELECT version_id, record_id, title, pages FROM scoped")
SQL["publishable"] = query(["scope"], "SELECT version_id, record_id, m_decision FROM publishable")
SQL["master_with_active"] = query(
    ["current"],
    """SELECT m.record_id, m.title AS m_title, m.accept_status AS m_accept_status, c.version_id, c.title, c.pages
    FROM master m LEFT JOIN current_v c USING (record_id) WHERE m.decision = 'publishing'""",
)
SQL["scope_counts"] = query(
    ["master"],
    """SELECT count(*) AS total, count(*) FILTER (decision = 'publishing') AS publishing,
    count(*) FILTER (decision = 'not_publishing') AS excluded,
    count(*) FILTER (decision = 'decision_required') AS undecided FROM master""",
)
SQL["decision_worklists"] = query(
    ["scope"],
    """SELECT 'orphans_needing_decision' AS worklist, record_id, version_id FROM publishable WHERE m_decision IS NULL
    UNION ALL SELECT 'excluded_orphans', record_id, version_id FROM versions v WHERE NOT discarded AND excluded
      AND record_id NOT IN (SELECT record_id FROM master)
    UNION ALL SELECT 'excluded_masters', record_id, '' FROM master WHERE decision = 'not_publishing'
    UNION ALL SELECT 'undecided_or_inconsistent', record_id, '' FROM (
      SELECT record_id FROM master WHERE decision = 'decision_required'
      UNION SELECT v.record_id FROM versions v JOIN master m USING (record_id)
        WHERE m.decision <> 'decision_required' AND v.excluded <> (m.decision = 'not_publishing'))
    UNION ALL SELECT 'masters_without_version', record_id, '' FROM master m WHERE decision = 'publishing'
      AND record_id NOT IN (SELECT record_id FROM av)""",
)
SQL["multiple_active"] = query(
    ["groups"], "SELECT record_id, n_active FROM record_groups WHERE decision IS NOT NULL AND n_active > 1"
)
SQL["multiple_active_members"] = query(
    ["groups", "scope"],
    """SELECT record_id, version_id FROM av WHERE record_id IN
    (SELECT record_id FROM record_groups WHERE decision IS NOT NULL AND n_active > 1)""",
)
SQL["origin_conflicts"] = query(
    ["groups"],
    "SELECT record_id, n_author, n_editor FROM record_groups WHERE decision = 'publishing' AND n_author > 0 AND n_editor > 0",
)
SQL["mixed_decisions"] = query(
    ["groups"],
    "SELECT record_id, n_excluded, n_included FROM record_groups WHERE decision IS NULL AND n_excluded > 0 AND n_included > 0",
)
SQL["mixed_decision_members"] = query(
    ["groups"],
    """SELECT record_id, version_id, excluded FROM versions WHERE NOT discarded AND record_id IN
    (SELECT record_id FROM record_groups WHERE decision IS NULL AND n_excluded > 0 AND n_included > 0)""",
)
_MISMATCH = "CASE decision WHEN 'not_publishing' THEN n_versions - n_all_excluded WHEN 'publishing' THEN n_all_excluded ELSE 0 END"
SQL["decision_integrity"] = query(
    ["groups"],
    f"SELECT record_id, decision, {_MISMATCH} AS n_mismatched FROM record_groups WHERE decision IS NOT NULL AND {_MISMATCH} > 0",
)
SQL["decision_backfill"] = query(
    ["master", "versions"],
    """SELECT m.record_id,
      CASE WHEN coalesce(x, 0) = 0 THEN 'publishing' WHEN x = n THEN 'not_publishing' ELSE 'decision_required' END AS decision,
      CASE WHEN x > 0 AND x = n THEN er ELSE '' END AS exclusion_reason,
      CASE WHEN x > 0 AND x = n THEN en ELSE '' END AS exclusion_notes,
      CASE WHEN x > 0 AND x = n THEN strftime(ea, '%Y-%m-%d %H:%M:%S') END AS excluded_at
    FROM master m LEFT JOIN (
      SELECT record_id, count(*) AS n, count(*) FILTER (excluded) AS x FROM versions GROUP BY record_id) g USING (record_id)
    LEFT JOIN (SELECT record_id, exclusion_reason AS er, exclusion_notes AS en, excluded_at AS ea FROM (
      SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY active DESC, excluded_at DESC NULLS LAST, version_id DESC) AS r
      FROM versions WHERE excluded) WHERE r = 1) p USING (record_id)""",
)
SQL["versions_per_record"] = query(
    ["versions"],
    """SELECT CASE WHEN record_id <> '' THEN record_id ELSE version_id END AS group_id, count(*) AS n_versions,
    count(*) FILTER (active) AS n_active, count(*) FILTER (discarded) AS n_discarded FROM versions GROUP BY 1""",
)
SQL["latest_by_update"] = query(
    ["claims"],
    """SELECT record_id, version_id FROM (SELECT *, row_number() OVER (PARTITION BY record_id
      ORDER BY updated_at DESC, version_id DESC) AS r FROM claims WHERE record_id <> '') WHERE r = 1""",
)
SQL["old_versions"] = query(
    ["versions"],
    """SELECT version_id, record_id,
      CASE WHEN discarded THEN 'discarded' WHEN replaced OR rep <> '' THEN 'replaced' ELSE 'other' END AS old_status,
      CASE WHEN discarded THEN 'Discarded by editor' WHEN replaced OR rep <> '' THEN 'Replaced by active final version'
        ELSE 'Inactive without replacement/discard marker' END AS inactive_reason,
      CASE origin WHEN 'editor_upload' THEN 'Editor Upload' ELSE 'Start2' END AS origin_label, rep AS replacement_id,
      concat_ws('; ', CASE WHEN discard_notes <> '' THEN 'Discard note: ' || discard_notes END,
        CASE WHEN editor_notes <> '' THEN 'Editor note: ' || editor_notes END,
        CASE WHEN exclusion_notes <> '' THEN 'Not publishing note: ' || exclusion_notes END) AS note_summary
    FROM (SELECT v.*, coalesce(a.rep, '') AS rep FROM versions v LEFT JOIN (
        SELECT record_id, max(version_id) AS rep FROM versions WHERE active AND NOT discarded AND record_id <> ''
        GROUP BY record_id) a USING (record_id) WHERE NOT v.active)""",
)

# -- names and duplicates

SQL["name_counts"] = query(
    ["counts"],
    """SELECT norm, display_name, n_records, n_repeat_records, first_record_id, over_limit, waiver_valid,
    CASE WHEN over_limit AND waiver_valid THEN 'Allowed' WHEN over_limit THEN 'Over limit' ELSE 'OK' END AS status FROM counts""",
)
SQL["name_records"] = query(["counts"], "SELECT norm, record_id, repeats FROM name_recs")
SQL["duplicate_names"] = query(
    ["versions"],
    f"""SELECT version_id, record_id, norm, array_to_string(list_distinct_first(names), '; ') AS spellings,
      len(names) AS n_times, array_to_string(ps, ',') AS positions FROM (
      SELECT version_id, record_id, norm, list(name ORDER BY position) AS names, list(position ORDER BY position) AS ps FROM (
        SELECT record_id, version_id, position, name, {name_norm('name')} AS norm FROM (
          SELECT record_id, version_id, unnest(nm) AS name, unnest(range(1, len(nm) + 1)) AS position
          FROM (SELECT record_id, version_id, {split_names('extracted_authors')} AS nm FROM versions)))
      WHERE norm <> '' GROUP BY ALL) WHERE len(names) > 1""".replace(
        "list_distinct_first(names)",
        "list_filter(names, lambda x, i: list_position(names, x) = i)",
    ),
)
_WORDS = (
    "CASE WHEN len(regexp_extract_all(extracted_title, '[A-Za-z0-9]+')) = 0 THEN 'UNTITLED' "
    "ELSE array_to_string(regexp_extract_all(extracted_title, '[A-Za-z0-9]+')[1:5], ' ') END"
)
_MEMBERS = f"""
named AS (SELECT *, record_id || '-' || {_WORDS} AS base_name FROM scoped),
members AS (
  SELECT 'title' AS kind, {norm('extracted_title')} AS key, version_id, record_id, base_name FROM named WHERE extracted_title <> ''
  UNION ALL SELECT 'pdf', pdf_hash, version_id, record_id, base_name FROM named WHERE (corrected_pdf <> '' OR pdf_file <> '')
    AND processing_status = 'processed' AND pages IS NOT NULL AND thumbnail_status = 'processed' AND thumbnail_folder <> '' AND pdf_hash <> ''
  UNION ALL SELECT 'source', source_hash, version_id, record_id, base_name FROM named WHERE (corrected_source <> '' OR source_file <> '')
    AND format_status = 'review_ok' AND source_hash <> ''
  UNION ALL SELECT 'filename', lower(base_name), version_id, record_id, base_name FROM named),
dup_groups AS (SELECT kind, key, count(*) AS n_members, min(version_id) AS first_version_id,
  arg_min(base_name, version_id) AS group_name FROM members GROUP BY kind, key HAVING count(*) > 1),
dups AS (SELECT m.*, g.n_members - 1 AS n_others, g.group_name FROM members m JOIN dup_groups g USING (kind, key))
"""
SQL["duplicate_groups"] = query(["scope"], "SELECT kind, key, n_members, first_version_id FROM dup_groups", _MEMBERS)
SQL["duplicate_members"] = query(["scope"], "SELECT kind, key, version_id, record_id, n_others FROM dups", _MEMBERS)
SQL["filename_collisions"] = query(["scope"], "SELECT key, n_members FROM dup_groups WHERE kind = 'filename'", _MEMBERS)
SQL["duplicate_detail"] = query(
    ["scope"],
    """SELECT kind, key, g.first_version_id AS of_version_id, version_id,
    CASE WHEN record_id = '' THEN 'No Paper ID' ELSE record_id END || ' / Final ' || version_id AS other_label,
    substr(key, 1, 12) AS key_summary
    FROM members m JOIN dup_groups g USING (kind, key) WHERE version_id <> g.first_version_id""",
    _MEMBERS,
)
