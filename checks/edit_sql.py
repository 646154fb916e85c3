"""SQL of the queries about edits, the stored table and the largest files."""

from checks.base_sql import query
from checks.change_sql import _MV, EVEN, flags, rn
from checks.oracle import SQL
from checks.page_sql import INVENTORY

_EDITS = f"""
ed AS (SELECT version_id, record_id AS f, (CASE WHEN {EVEN} THEN 'X' ELSE 'P' END) || ({rn('version_id')} + 1) AS t FROM versions WHERE similarity IN (10, 50)),
st AS (SELECT id, coalesce(m.decision IN ('not_publishing', 'decision_required'), false) AS dm,
    m.record_id IS NULL AND id IN (SELECT record_id FROM versions WHERE excluded) AS dg
  FROM (SELECT f AS id FROM ed UNION SELECT t FROM ed) LEFT JOIN master m ON m.record_id = id WHERE id <> ''),
oc AS (SELECT ed.*, CASE WHEN a.dm THEN 'the present record is excluded or waits for a decision' WHEN b.dm THEN 'the new record is excluded or waits for a decision'
    WHEN a.dg THEN 'versions of the present id, which has no master record, are excluded' WHEN b.dg THEN 'versions of the new id, which has no master record, are excluded' ELSE '' END AS refusal
  FROM ed LEFT JOIN st a ON a.id = f LEFT JOIN st b ON b.id = t)"""

SQL["edit_outcomes"] = query(_MV, "SELECT version_id, refusal = '' AS accepted, refusal FROM oc", _EDITS)
SQL["edited_versions"] = query(
    _MV,
    "SELECT version_id, record_id, excluded, id_verified, active2 AS active, replaced2 AS replaced FROM final",
    _EDITS + """,
aft AS (SELECT v.version_id, coalesce(e.t, v.record_id) AS record_id, v.origin, v.discarded, v.created_at, v.id_verified AND e.t IS NULL AS id_verified,
    CASE WHEN e.t IS NULL THEN v.excluded WHEN m.decision = 'publishing' THEN false ELSE v.excluded END AS excluded
  FROM versions v LEFT JOIN (SELECT * FROM oc WHERE refusal = '') e USING (version_id) LEFT JOIN master m ON m.record_id = e.t),
""" + flags("aft"),
)
SQL["upsert_store"] = SQL["upsert_result"]
SQL["largest_files"] = query(["scope"], "SELECT path, category, length FROM inventory ORDER BY length DESC, path LIMIT 20", INVENTORY)
