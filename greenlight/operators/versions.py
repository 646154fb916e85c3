"""Version selection, replaced versions, and per-record version groups.

Winners come from a grouped ``max`` over a narrow struct (partial aggregation first)
and are joined back by the record id, one winner a record, so that rows dealt out by
record stay where they are. No window ever holds all versions of one record, and a join
that one record makes skewed can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenlight import catalog
from greenlight.functions.text import filled, natural_key
from greenlight.operators import scope

EDITOR = "editor_upload"


def _winners(v: DataFrame, rule: str) -> DataFrame:
    eligible = v.filter(~F.col("discarded") & filled("record_id"))
    order = [(F.col("origin") == EDITOR).alias("editor")]
    if rule == "upload_date":
        order.append(F.col("upload_date"))
    order += [natural_key("version_id").alias("key"), F.col("created_at"), F.col("version_id")]
    best = eligible.groupBy("record_id").agg(F.max(F.struct(*order)).alias("best"))
    return best.select("record_id", F.col("best.version_id").alias("version_id"))


def active_map(v: DataFrame, rule: str = "final_id") -> DataFrame:
    """record_id -> the version the rule makes active."""
    return _winners(v, rule)


def recompute(v: DataFrame, rule: str = "final_id") -> DataFrame:
    """Set ``active`` and ``replaced`` on every row, in one pass."""
    winners = _winners(v, rule).select("record_id", F.col("version_id").alias("won"))
    base = v.drop("active", "replaced").join(winners, "record_id", "left")
    eligible = ~F.col("discarded") & filled("record_id")
    won = F.coalesce(eligible & (F.col("won") == F.col("version_id")), F.lit(False))
    return base.withColumns({"active": won, "replaced": eligible & ~won}).drop("won")


def recompute_touched(v: DataFrame, changed: DataFrame, rule: str = "final_id", was: DataFrame | None = None) -> DataFrame:
    """``v`` with the rows of ``changed`` in place of those with their ids (or added), and the flags as a full
    ``recompute`` would set them. ``v`` must carry current flags: only records that a changed row is or was filed
    under are judged again, all other rows pass through without a shuffle of their own where ``v`` lies by record.
    ``was`` has the former record ids of the changed rows, where the caller knows them."""
    own = changed.select("version_id")
    was = v.join(own, "version_id", "left_semi").select("record_id") if was is None else was
    ids = was.union(changed.select("record_id")).filter("record_id IS NOT NULL").distinct()
    named, unnamed = v.filter("record_id IS NOT NULL"), v.filter("record_id IS NULL")
    others = named.join(ids, "record_id", "left_semi").join(own, "version_id", "left_anti")
    again = others.unionByName(changed.select(*v.columns))
    rest = named.join(ids, "record_id", "left_anti").unionByName(unnamed.join(own, "version_id", "left_anti"))
    return rest.select(*v.columns).unionByName(recompute(again, rule).select(*v.columns))


def select_active(v: DataFrame, rule: str = "final_id") -> DataFrame:
    return recompute(v, rule).drop("replaced")


def mark_replaced(v: DataFrame, rule: str = "final_id") -> DataFrame:
    return recompute(v, rule).filter("replaced")


def active_change_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Records whose active version differs between two maps, either side may be missing."""
    b = before.select("record_id", F.col("version_id").alias("before_id"))
    a = after.select("record_id", F.col("version_id").alias("after_id"))
    joined = b.join(a, "record_id", "full")
    return joined.filter(~F.col("before_id").eqNullSafe(F.col("after_id"))).select(
        "record_id",
        F.coalesce("before_id", F.lit("")).alias("before_id"),
        F.coalesce("after_id", F.lit("")).alias("after_id"),
    )


def preview_rule_change(v: DataFrame, now: str, then: str) -> DataFrame:
    return active_change_diff(active_map(v, now), active_map(v, then))


def record_groups(v: DataFrame, m: DataFrame) -> DataFrame:
    """Every per-record count the group rules need, beside the master decision.

    One aggregate over narrow columns (partial aggregation first) and one full join on
    the record id; ``decision`` is NULL for an orphan id. Blank ids are left out.
    """
    live, excluded, editor = ~F.col("discarded"), F.col("excluded"), F.col("origin") == EDITOR
    counts = {
        "n_versions": F.count(F.lit(1)),
        "n_all_excluded": F.count_if(excluded),
        "n_active": F.count_if(live & F.col("active")),
        "n_excluded": F.count_if(live & excluded),
        "n_included": F.count_if(live & ~excluded),
        "n_author": F.count_if(live & ~editor),
        "n_editor": F.count_if(live & editor),
    }
    grouped = v.filter(filled("record_id")).groupBy("record_id").agg(
        *[agg.alias(name) for name, agg in counts.items()]
    )
    joined = grouped.join(m.select("record_id", "decision"), "record_id", "full")
    return joined.na.fill(0, list(counts))


def is_multiple_active() -> Column:
    return F.col("decision").isNotNull() & (F.col("n_active") > 1)


def is_mixed() -> Column:
    return F.col("decision").isNull() & (F.col("n_excluded") > 0) & (F.col("n_included") > 0)


def is_origin_conflict() -> Column:
    return (F.col("decision") == scope.PUBLISHING) & (F.col("n_author") > 0) & (F.col("n_editor") > 0)


def n_mismatched() -> Column:
    """Versions whose flag is not the one a decided master implies."""
    wrong = F.when(F.col("decision") == scope.EXCLUDED, F.col("n_versions") - F.col("n_all_excluded")).when(
        F.col("decision") == scope.PUBLISHING, F.col("n_all_excluded")
    )
    return F.coalesce(wrong, F.lit(0))


def multiple_active(v: DataFrame, m: DataFrame) -> DataFrame:
    """Master records with more than one active version: (record_id, n_active)."""
    return record_groups(v, m).filter(is_multiple_active()).select("record_id", "n_active")


def mixed_decisions(v: DataFrame, m: DataFrame) -> DataFrame:
    """Orphan ids whose undiscarded versions disagree on the exclusion flag."""
    return record_groups(v, m).filter(is_mixed()).select("record_id", "n_excluded", "n_included")


def origin_conflicts(v: DataFrame, m: DataFrame) -> DataFrame:
    """Publishing records with undiscarded versions of both origins."""
    return record_groups(v, m).filter(is_origin_conflict()).select("record_id", "n_author", "n_editor")


def group_members(v: DataFrame, groups: DataFrame, kinds: dict | None = None) -> DataFrame:
    """The versions behind a set of record groups, one row each instead of a list per group."""
    rows = v.filter(~F.col("discarded")).join(groups.select("record_id"), "record_id", "left_semi")
    extra = [expr.alias(name) for name, expr in (kinds or {}).items()]
    return rows.select("record_id", "version_id", *extra)


def decision_integrity(v: DataFrame, m: DataFrame) -> DataFrame:
    """Decided master records whose versions mirror another decision."""
    groups = record_groups(v, m).withColumn("n_mismatched", n_mismatched())
    return groups.filter("n_mismatched > 0").select("record_id", "decision", "n_mismatched")


def decision_backfill(m: DataFrame, v: DataFrame) -> DataFrame:
    """Derive the master decision from the flags of its versions."""
    excluded = F.col("excluded")
    # rank inside the group: active, then latest exclusion (NULL lowest), then id
    preferred = F.max(
        F.when(
            excluded,
            F.struct(
                F.col("active"), F.col("excluded_at"), F.col("version_id"),
                F.col("exclusion_reason"), F.col("exclusion_notes"),
            ),
        )
    )
    groups = v.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(excluded).alias("n_excluded"), preferred.alias("p")
    )
    n_excluded = F.coalesce(F.col("n_excluded"), F.lit(0))
    all_excluded = (n_excluded > 0) & (n_excluded == F.col("n"))
    return m.select("record_id").join(groups, "record_id", "left").select(
        "record_id",
        F.when(n_excluded == 0, scope.PUBLISHING)
        .when(all_excluded, scope.EXCLUDED)
        .otherwise(scope.UNDECIDED)
        .alias("decision"),
        F.when(all_excluded, F.col("p.exclusion_reason")).otherwise("").alias("exclusion_reason"),
        F.when(all_excluded, F.col("p.exclusion_notes")).otherwise("").alias("exclusion_notes"),
        F.when(all_excluded, F.col("p.excluded_at")).alias("excluded_at"),
    )


def versions_per_record(v: DataFrame) -> DataFrame:
    """Size of each version group; a version with a blank record id is its own group."""
    key = F.when(filled("record_id"), F.col("record_id")).otherwise(F.col("version_id"))
    return v.groupBy(key.alias("group_id")).agg(
        F.count(F.lit(1)).alias("n_versions"),
        F.count_if(F.col("active")).alias("n_active"),
        F.count_if(F.col("discarded")).alias("n_discarded"),
    )


def latest_by_update(v: DataFrame) -> DataFrame:
    """Per record the version with the greatest (updated_at, version_id)."""
    return (
        v.filter(filled("record_id"))
        .groupBy("record_id")
        .agg(F.max(F.struct("updated_at", "version_id")).alias("p"))
        .select("record_id", F.col("p.version_id").alias("version_id"))
    )


def latest_replacement(old: DataFrame, v: DataFrame) -> DataFrame:
    """Add ``replacement_id``: the active version of the same record, never the row itself."""
    active = (
        scope.active_versions(v)
        .filter(filled("record_id"))
        .groupBy("record_id")
        .agg(F.max("version_id").alias("replacement_id"))
    )
    joined = old.join(active, "record_id", "left")
    itself = F.col("replacement_id") == F.col("version_id")
    return joined.withColumn(
        "replacement_id", F.when(itself, "").otherwise(F.coalesce("replacement_id", F.lit("")))
    )


def classify_old(v: DataFrame) -> DataFrame:
    """Inactive versions with status, reason, replacement and joined notes."""
    rows = latest_replacement(v.filter(~F.col("active")), v)
    discarded, gone = F.col("discarded"), F.col("replaced") | (F.col("replacement_id") != "")
    status = F.when(discarded, "discarded").when(gone, "replaced").otherwise("other")
    reason = (
        F.when(discarded, "Discarded by editor")
        .when(gone, "Replaced by active final version")
        .otherwise("Inactive without replacement/discard marker")
    )
    notes = [("Discard note", "discard_notes"), ("Editor note", "editor_notes"),
             ("Not publishing note", "exclusion_notes")]
    parts = [F.when(filled(c), F.concat(F.lit(f"{shown}: "), F.col(c))) for shown, c in notes]
    return rows.withColumns(
        {
            "old_status": status,
            "inactive_reason": reason,
            "origin_label": catalog.label("origin", F.col("origin")),
            "note_summary": F.concat_ws("; ", *parts),
        }
    )




def old_filter(name: str):
    """Predicate of an old-version tab; an unknown tab shows all."""
    editor = F.col("origin") == EDITOR
    return {
        "replaced": F.col("old_status") == "replaced",
        "discarded": F.col("old_status") == "discarded",
        "editor_uploads": editor,
        "start2": ~editor,
        "other": F.col("old_status") == "other",
    }.get(name, F.lit(True))
