"""Registered queries: edits of versions with what they set off, a stored table that is upserted, the largest files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from greenlight.operators import edits, files, versions
from greenlight.plans.change_queries import even_pages
from greenlight.plans.page_queries import _inventory
from greenlight.plans.queries import query
from greenlight.session import cut_lineage, release, shared_dir
from greenlight.sources import store


def _moves(d):
    """Edits that file versions under the next record, or under an id without a master record."""
    order = F.regexp_extract("version_id", r"(\d+)$", 1).cast("long")
    to = F.concat(F.when(even_pages(), "X").otherwise("P"), (order + 1).cast("string"))
    return d.versions.filter("similarity IN (10, 50)").select("version_id", F.array(F.lit("record_id")).alias("changed_fields"), to.alias("new_record_id"))


@query
def edit_outcomes(d):
    return edits.edit_outcomes(d.versions, d.master, _moves(d))


#: What a move to another record reads or changes of a version, besides the flags; the rest of a row stays where it is.
MOVED = ("version_id", "record_id", "origin", "discarded", "created_at", "id_verified", "report_path", "report_stale",
         "excluded", "exclusion_reason", "exclusion_notes", "excluded_at")


@query
def edited_versions(d):
    """The version table after the edits, judged again only where an edit touched."""
    current = versions.recompute(d.versions.select(*MOVED))  # the table as it stands, with flags that hold; read in pruned columns, not copied
    outcomes = cut_lineage(edits.edit_outcomes(current, d.master, _moves(d)))
    release(d.spark)
    out = edits.edit_versions(current, d.master, _moves(d), outcomes)
    return out.select("version_id", "record_id", "excluded", "id_verified", "active", "replaced")


@query
def upsert_store(d):
    """The same upsert as ``upsert_result``, in a store on disk that is read back."""
    path = f"{shared_dir(d.spark)}/master-store-{uuid.uuid4().hex}"
    store.write_store(d.master.select("record_id", "title", "notes", "decision"), path, ["record_id"], 16)
    listed = d.master.filter("decision = 'decision_required'").select("record_id", F.upper("title").alias("title"), F.lit(None).cast("string").alias("notes"))
    fresh = d.versions.filter("record_id LIKE 'X%'").select("record_id").distinct().select("record_id", F.lit("new").alias("title"), F.lit("").alias("notes"))
    store.upsert_store(d.spark, path, listed.unionByName(fresh), ["record_id"])
    return store.read_store(d.spark, path)


@query
def largest_files(d):
    return files.largest(_inventory(d.versions))
