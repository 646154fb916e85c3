"""Manual edits of versions: the guard of a new record id, and what an edit sets off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenlight.functions.text import strip
from greenlight.operators import scope, transitions, versions
from greenlight.session import cut_lineage, release

MISSING = "the version no longer exists"
REPEATED = "the version is edited twice"
FROM_DECIDED = "the present record is excluded or waits for a decision"
TO_DECIDED = "the new record is excluded or waits for a decision"
FROM_GROUP = "versions of the present id, which has no master record, are excluded"
TO_GROUP = "versions of the new id, which has no master record, are excluded"


def edit_outcomes(v: DataFrame, m: DataFrame, edits: DataFrame) -> DataFrame:
    """(version_id, accepted, refusal), one row for each edit.

    A new record id is refused where either id stands under a decision that the move would slip past: the
    master's, or for ids without a master record the exclusion of any version of the group. All edits are
    judged against the table before them.
    """
    asked = edits.select(
        "version_id", F.array_contains("changed_fields", "record_id").alias("_moves"), F.coalesce(strip("new_record_id"), F.lit("")).alias("_to")
    )
    several = asked.groupBy("version_id").agg(F.count(F.lit(1)).alias("_n"))
    known = v.join(several, "version_id").select("version_id", "_n", F.coalesce(strip("record_id"), F.lit("")).alias("_from"))
    asked = asked.join(known, "version_id", "left")
    moves = asked.filter("_moves AND _from <> _to")
    ids = moves.select(F.col("_from").alias("record_id")).union(moves.select("_to")).filter("record_id <> ''").distinct()
    decided = m.join(ids, "record_id", "left_semi").select("record_id", "decision", F.lit(True).alias("_known"))
    grouped = v.filter("excluded").join(ids, "record_id", "left_semi").select("record_id").distinct().withColumn("_out", F.lit(True))
    state = ids.join(decided, "record_id", "left").join(grouped, "record_id", "left").select(
        "record_id",
        F.coalesce(F.col("decision").isin(scope.EXCLUDED, scope.UNDECIDED), F.lit(False)).alias("by_master"),
        (F.col("_known").isNull() & F.col("_out").isNotNull()).alias("by_group"),
    )
    for side in ("_from", "_to"):
        asked = asked.join(state.select(F.col("record_id").alias(side), F.col("by_master").alias(f"{side}_master"), F.col("by_group").alias(f"{side}_group")), side, "left")
    moved = F.coalesce(F.col("_moves"), F.lit(False)) & (F.col("_from") != F.col("_to"))
    refusal = (
        F.when(F.col("_n").isNull(), MISSING)
        .when(F.col("_n") > 1, REPEATED)
        .when(moved & F.col("_from_master"), FROM_DECIDED)
        .when(moved & F.col("_to_master"), TO_DECIDED)
        .when(moved & F.col("_from_group"), FROM_GROUP)
        .when(moved & F.col("_to_group"), TO_GROUP)
        .otherwise("")
    )
    return asked.select("version_id", (refusal == "").alias("accepted"), refusal.alias("refusal"))


def edit_versions(v: DataFrame, m: DataFrame, edits: DataFrame, outcomes: DataFrame, rule: str = "final_id") -> DataFrame:
    """The versions after the accepted edits: dependent state reset, the master's decision mirrored, and the flags
    of the records named by an old or a new id computed again. Rows of other records pass through as they are."""
    accepted = edits.join(outcomes.filter("accepted").select("version_id"), "version_id", "left_semi")
    before = v.join(accepted.select("version_id"), "version_id", "left_semi")
    before = before.withColumn("_was", F.col("record_id"))
    changed = cut_lineage(transitions.mirror_decision(transitions.apply_edits(before, accepted), m))  # edited rows only, read three times
    del accepted, before
    release(v.sparkSession)  # the shuffles behind them, before those of the next step
    return versions.recompute_touched(v, changed.drop("_was"), rule, changed.select(F.col("_was").alias("record_id")))
