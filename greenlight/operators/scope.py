"""Which rows count: decisions, active versions, publishable, in scope, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenlight.functions.text import text

PUBLISHING, EXCLUDED, UNDECIDED = "publishing", "not_publishing", "decision_required"


def scope_publishing(m: DataFrame) -> DataFrame:
    return m.filter(F.col("decision") == PUBLISHING)


def scope_excluded(m: DataFrame) -> DataFrame:
    return m.filter(F.col("decision") == EXCLUDED)


def scope_undecided(m: DataFrame) -> DataFrame:
    return m.filter(F.col("decision") == UNDECIDED)


def active_versions(v: DataFrame) -> DataFrame:
    return v.filter(F.col("active") & ~F.col("discarded"))


def with_decision(v: DataFrame, m: DataFrame) -> DataFrame:
    """``v`` plus ``m_decision`` (NULL for an orphan): one narrow equi-join serves every scope test."""
    narrow = m.select("record_id", F.col("decision").alias("m_decision"))
    return v.join(narrow, "record_id", "left")


def is_publishable() -> Column:
    """Over ``with_decision``: publishing, or an orphan that is not excluded."""
    return F.when(F.col("m_decision").isNull(), ~F.col("excluded")).otherwise(
        F.col("m_decision") == PUBLISHING
    )


def publishable(v: DataFrame, m: DataFrame) -> DataFrame:
    return with_decision(active_versions(v), m).filter(is_publishable())


def in_scope(v: DataFrame, m: DataFrame) -> DataFrame:
    return active_versions(v).join(scope_publishing(m).select("record_id"), "record_id", "left_semi")


def orphans(v: DataFrame, m: DataFrame) -> DataFrame:
    """Publishable versions whose id, blank included, is in no master row."""
    return (
        active_versions(v)
        .filter(~F.col("excluded"))
        .join(m.select("record_id"), "record_id", "left_anti")
    )


def attach_master(v: DataFrame, m: DataFrame) -> DataFrame:
    """All master columns with an ``m_`` prefix; unmatched versions are kept."""
    prefixed = m.select(
        "record_id", *[F.col(c).alias(f"m_{c}") for c in m.columns if c != "record_id"]
    )
    return v.join(prefixed, "record_id", "left")


def current_version(scoped: DataFrame) -> DataFrame:
    """One version per record: the oldest of several active ones, as the reports read them.

    A narrow aggregate picks the id; the wide rows are joined by the unique version
    id, so a record with very many versions does not skew the join.
    """
    picked = (
        scoped.groupBy("record_id")
        .agg(F.min(F.struct("upload_date", "created_at", "version_id")).alias("p"))
        .select(F.col("p.version_id").alias("version_id"))
    )
    return scoped.join(picked, "version_id", "left_semi")


def master_with_active(m: DataFrame, v: DataFrame) -> DataFrame:
    """Publishing master rows with their current version; missing ones are kept."""
    publishing = scope_publishing(m)
    prefixed = publishing.select(
        "record_id", *[F.col(c).alias(f"m_{c}") for c in m.columns if c != "record_id"]
    )
    return prefixed.join(current_version(in_scope(v, m)), "record_id", "left")


def missing_versions(m: DataFrame, v: DataFrame) -> DataFrame:
    return scope_publishing(m).join(
        active_versions(v).select("record_id"), "record_id", "left_anti"
    )


def scope_counts(m: DataFrame) -> DataFrame:
    decision = F.col("decision")
    return m.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(decision == PUBLISHING).alias("publishing"),
        F.count_if(decision == EXCLUDED).alias("excluded"),
        F.count_if(decision == UNDECIDED).alias("undecided"),
    )


def decision_worklists(m: DataFrame, v: DataFrame) -> DataFrame:
    """The five decision row sets as (worklist, record_id, version_id)."""
    live = v.filter(~F.col("discarded"))
    outside = live.join(m.select("record_id"), "record_id", "left_anti")
    open_orphans = outside.filter(F.col("active") & ~F.col("excluded"))
    closed_orphans = outside.filter(F.col("excluded"))
    mirror = v.join(
        m.filter(F.col("decision") != UNDECIDED).select("record_id", F.col("decision").alias("d")),
        "record_id",
    ).filter(F.col("excluded") != (F.col("d") == EXCLUDED))
    inconsistent = scope_undecided(m).select("record_id").union(mirror.select("record_id")).distinct()

    def rows(df: DataFrame, name: str, version: Column) -> DataFrame:
        return df.select(F.lit(name).alias("worklist"), text("record_id").alias("record_id"),
                         version.alias("version_id"))

    none = F.lit("")
    return (
        rows(open_orphans, "orphans_needing_decision", F.col("version_id"))
        .unionByName(rows(closed_orphans, "excluded_orphans", F.col("version_id")))
        .unionByName(rows(scope_excluded(m), "excluded_masters", none))
        .unionByName(rows(inconsistent, "undecided_or_inconsistent", none))
        .unionByName(rows(missing_versions(m, v), "masters_without_version", none))
    )
