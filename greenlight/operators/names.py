"""People across records: exploded names, repeats inside a record, counts and waivers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenlight.functions.text import nonblank, normalize_name, split_names, strip
from greenlight.settings import Settings


def name_entries(v: DataFrame, column: str = "extracted_authors") -> DataFrame:
    """(record_id, version_id, position, name, norm), positions counted from 1."""
    exploded = v.select(
        "record_id", "version_id", F.posexplode(split_names(column)).alias("pos0", "name")
    )
    return exploded.select(
        "record_id",
        "version_id",
        (F.col("pos0") + 1).alias("position"),
        "name",
        normalize_name("name").alias("norm"),
    ).filter("norm != ''")


def normalized_names(column) -> Column:
    return F.filter(F.transform(split_names(column), normalize_name), lambda n: n != "")


def has_repeated_name(column) -> Column:
    names = normalized_names(column)
    return F.size(F.array_distinct(names)) < F.size(names)


def duplicate_names(v: DataFrame, column: str = "extracted_authors") -> DataFrame:
    """Names repeated inside one list: spellings in first-seen order, count and positions.

    The group is one (version, name), bounded by one list; lists without a repeat
    are dropped before the explode.
    """
    entries = name_entries(v.filter(has_repeated_name(column)), column)
    # both lists come out of one ordered array, so they agree on the order
    return (
        entries.groupBy("version_id", "record_id", "norm")
        .agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("e"))
        .filter(F.size("e") > 1)
        .select(
            "version_id",
            "record_id",
            "norm",
            F.array_join(F.array_distinct(F.col("e.name")), "; ").alias("spellings"),
            F.size("e").cast("long").alias("n_times"),
            F.array_join(F.transform(F.col("e.position"), lambda p: p.cast("string")), ",").alias("positions"),
        )
    )


def name_records(scoped: DataFrame) -> DataFrame:
    """One row per (norm, record_id): where a name appears and whether it repeats there."""
    per_list = (
        name_entries(scoped)
        .groupBy("norm", "record_id", "version_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_list.groupBy("norm", "record_id").agg((F.max("n") > 1).alias("repeats"))


def name_spellings(scoped: DataFrame) -> DataFrame:
    """One row per (norm, spelling) with its first place in (record, position) order."""
    return (
        name_entries(scoped)
        .groupBy("norm", "name")
        .agg(F.min(F.struct("record_id", "position")).alias("first_seen"))
    )


def name_counts(scoped: DataFrame, waivers: DataFrame, s: Settings) -> DataFrame:
    """Per normalised name: spellings, records, over-limit, waiver state and repeats.

    A name may sit in a third of all records, so records are counted by two grouped
    steps and never listed; ``name_records`` has the members. Only the distinct
    spellings of a name, which normalise to the same text, are joined into one label.
    """
    counted = name_records(scoped).groupBy("norm").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if("repeats").alias("n_repeat_records"),
        F.min("record_id").alias("first_record_id"),
    )
    spelled = name_spellings(scoped).groupBy("norm").agg(
        F.array_sort(F.collect_list(F.struct("first_seen", "name"))).alias("e")
    ).select("norm", F.array_join(F.col("e.name"), "; ").alias("display_name"))
    approved = waivers.select(
        "norm",
        F.col("approved").alias("waiver_approved"),
        strip("reason").alias("waiver_reason"),
        F.col("approved_count").alias("waiver_count"),
        *[F.col(c).alias("waiver_at") for c in waivers.columns if c == "approved_at"],
    )
    joined = counted.join(spelled, "norm").join(approved, "norm", "left")
    over = F.col("n_records") > s.name_record_limit
    valid = F.coalesce(
        F.col("waiver_approved") & nonblank("waiver_reason") & (F.col("waiver_count") == F.col("n_records")),
        F.lit(False),
    )
    return joined.withColumns(
        {
            "over_limit": over,
            "waiver_valid": valid,
            "waiver_reason": F.coalesce("waiver_reason", F.lit("")),
            "status": F.when(over & valid, "Allowed").when(over, "Over limit").otherwise("OK"),
            "exception_key": F.concat(F.lit("author_limit:"), F.col("norm")),
        }
    )


def name_filter(name: str) -> Column:
    """Predicate of a name-count tab over ``name_counts``."""
    over, repeats = F.col("over_limit"), F.col("n_repeat_records") > 0
    return {
        "attention": over | repeats,
        "over_limit": over,
        "duplicates": repeats,
        "allowed": over & F.col("waiver_valid"),
    }.get(name, F.lit(True))


def name_order(sort: str) -> list[Column]:
    count, norm = F.col("n_records"), F.col("norm")
    open_limit = F.col("over_limit") & ~F.col("waiver_valid")
    return {
        "count_desc": [count.desc(), norm.asc()],
        "count_asc": [count.asc(), norm.asc()],
        "name": [norm.asc()],
    }.get(sort, [open_limit.desc(), (F.col("n_repeat_records") > 0).desc(), count.desc(), norm.asc()])
