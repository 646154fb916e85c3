"""Derived columns that many rules read, computed once per row.

Splitting and normalising text is the costly part of a rule; the rules below refer to
these columns instead of repeating the expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenlight.functions.text import normalize_name, normalize_title, split_names


def with_measures(df: DataFrame) -> DataFrame:
    """Add the ``x_`` columns; ``m_title`` is optional."""
    split = df.withColumn("x_names", split_names("extracted_authors"))
    columns = {
        "x_norms": F.filter(F.transform("x_names", normalize_name), lambda n: n != ""),
        "x_count": F.size("x_names"),
        "x_title": normalize_title("title"),
        "x_extracted": normalize_title("extracted_title"),
    }
    if "m_title" in df.columns:
        columns["x_master"] = normalize_title("m_title")
    measured = split.withColumns(columns)
    return measured.withColumn("x_repeats", F.size(F.array_distinct("x_norms")) < F.size("x_norms"))


def repeated_label() -> Column:
    """"A, a. (2 times); B (3 times)" in order of first appearance."""
    spelled, norms = F.col("x_names"), F.col("x_norms")

    def shown(norm: Column) -> Column:
        same = F.filter(spelled, lambda s: normalize_name(s) == norm)
        return F.concat(
            F.array_join(F.array_distinct(same), ", "), F.lit(" ("), F.size(same).cast("string"), F.lit(" times)")
        )

    repeated = F.filter(
        F.array_distinct(norms), lambda n: F.size(F.filter(norms, lambda x: x == n)) > 1
    )
    return F.when(F.col("x_repeats"), F.array_join(F.transform(repeated, shown), "; "))
