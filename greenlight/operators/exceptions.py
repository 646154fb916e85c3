"""Value-bound waivers: conditions, the exception table and its transitions.

Conditions read the columns of ``measures.with_measures``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenlight import catalog
from greenlight.functions.scores import equal_decimal
from greenlight.functions.text import clean_note, nonblank
from greenlight.operators.measures import with_measures
from greenlight.settings import Settings

# Exception type -> (label, column prefix of the stored waiver)
TYPES = {
    "page": ("Page count", "page_waiver"),
    "author_number": ("Authors in paper", "name_waiver"),
    "plagiarism_percent": ("Plagiarism %", "similarity_waiver"),
    "single_percent": ("Single %", "single_waiver"),
}


def current_value(kind: str) -> Column:
    return {
        "page": F.col("pages"),
        "author_number": F.col("x_count"),
        "plagiarism_percent": F.col("similarity"),
        "single_percent": F.col("single"),
    }[kind]


def over_limit(kind: str, s: Settings) -> Column:
    """Out of bounds; a missing value never is."""
    value = current_value(kind)
    test = {
        "page": (value < s.page_minimum) | (value > s.page_limit),
        "author_number": value > s.record_name_limit,
        "plagiarism_percent": value > F.lit(s.similarity_limit),
        "single_percent": value > F.lit(s.single_limit),
    }[kind]
    return F.coalesce(test, F.lit(False))


def waiver_valid(kind: str) -> Column:
    """Approved, with a reason, for exactly the present value."""
    prefix = TYPES[kind][1]
    value = current_value(kind)
    bound = equal_decimal(F.col(f"{prefix}_value"), value) & value.isNotNull()
    return F.coalesce(F.col(f"{prefix}_approved") & nonblank(f"{prefix}_reason") & bound, F.lit(False))


def exception_status(kind: str, s: Settings) -> Column:
    """'', allowed, stale (approved for another value) or not_allowed."""
    return (
        F.when(~over_limit(kind, s), "")
        .when(waiver_valid(kind), "allowed")
        .when(F.coalesce(F.col(f"{TYPES[kind][1]}_approved"), F.lit(False)), "stale")
        .otherwise("not_allowed")
    )


def exception_key(kind: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col("version_id"))


def limit_label(kind: str, s: Settings) -> str:
    return {
        "page": f"{s.page_minimum}-{s.page_limit} pages",
        "author_number": f"Max {s.record_name_limit} authors",
        "plagiarism_percent": f"Max {s.similarity_limit:g}%",
        "single_percent": f"Max {s.single_limit:g}%",
    }[kind]


def exception_rows(publishable: DataFrame, counts: DataFrame, s: Settings) -> DataFrame:
    """The five exception types as rows: four per version in one pass, one per name."""
    options = [
        F.when(
            exception_status(kind, s) != "",
            F.struct(
                exception_key(kind).alias("exception_key"),
                F.lit(kind).alias("type"),
                F.lit(TYPES[kind][0]).alias("type_label"),
                exception_status(kind, s).alias("status"),
                current_value(kind).cast("double").alias("current_value"),
                F.lit(limit_label(kind, s)).alias("limit_label"),
                F.col(f"{TYPES[kind][1]}_value").cast("double").alias("approved_value"),
                F.coalesce(f"{TYPES[kind][1]}_reason", F.lit("")).alias("reason"),
            ),
        )
        for kind in TYPES
    ]
    per_version = with_measures(publishable).select(
        "record_id", "version_id", F.col("record_id").alias("subject"),
        F.inline(F.filter(F.array(*options), lambda e: e.isNotNull())),
    )
    status = (
        F.when(F.col("waiver_valid"), "allowed")
        .when(F.coalesce("waiver_approved", F.lit(False)), "stale")
        .otherwise("not_allowed")
    )
    per_name = counts.filter("over_limit").select(
        F.lit("").alias("record_id"),
        F.lit("").alias("version_id"),
        F.col("display_name").alias("subject"),
        "exception_key",
        F.lit("author_limit").alias("type"),
        F.lit("Author paper count").alias("type_label"),
        status.alias("status"),
        F.col("n_records").cast("double").alias("current_value"),
        F.lit(f"Max {s.name_record_limit} papers").alias("limit_label"),
        F.col("waiver_count").cast("double").alias("approved_value"),
        F.col("waiver_reason").alias("reason"),
    )
    return per_version.unionByName(per_name)


def exception_filter(status: str = "not_allowed", kind: str = "all") -> Column:
    """Tabs of the exception list; ``plagiarism`` means both score types."""
    shown = F.lit(True) if status == "all" else F.col("status") == (
        status if status in catalog.LABELS["exception"] else "not_allowed"
    )
    if kind == "all":
        return shown
    wanted = ("plagiarism_percent", "single_percent") if kind == "plagiarism" else (kind,)
    return shown & F.col("type").isin(*wanted)


def exception_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        *[F.count_if(F.col("status") == k).alias(k) for k in catalog.LABELS["exception"]],
        F.count(F.lit(1)).alias("all"),
    )


# Action -> the statuses it may start from
LEGAL_FROM = {
    "approve": ("not_allowed",),
    "reapprove": ("stale",),
    "remove": ("allowed", "stale"),
}


def exception_actions(rows: DataFrame, actions: DataFrame) -> DataFrame:
    """Apply (exception_key, action, reason) to the exception table.

    Each action row comes back with ``accepted``, a message, and the waiver state it
    leads to: an approval binds the current value, a removal clears everything.
    """
    joined = actions.join(
        rows.select("exception_key", "type", "status", "current_value"), "exception_key", "left"
    )
    action, reason = F.col("action"), clean_note("reason")
    grants = action.isin("approve", "reapprove")
    legal = F.lit(False)
    for name, starts in LEGAL_FROM.items():
        legal = legal | ((action == name) & F.col("status").isin(*starts))
    message = (
        F.when(F.col("status").isNull(), "Exception no longer exists.")
        .when(~action.isin(*LEGAL_FROM), "Unknown action.")
        .when(~legal, F.concat(F.lit("Not possible for status "), F.col("status"), F.lit(".")))
        .when(grants & (reason == ""), "A reason is required.")
        .otherwise("")
    )
    accepted = message == ""
    return joined.select(
        "exception_key",
        "action",
        accepted.alias("accepted"),
        message.alias("message"),
        (accepted & grants).alias("waiver_approved"),
        F.when(accepted & grants, reason).otherwise("").alias("waiver_reason"),
        F.when(accepted & grants, F.col("current_value")).alias("waiver_value"),
    )
