"""Content, row, group and table digests used to detect a changed basis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(content) -> Column:
    content = content if isinstance(content, Column) else F.col(content)
    return F.sha2(content, 256)


def row_digest(columns) -> Column:
    """SHA-256 of the sorted-key JSON of the columns; NULL stays visible."""
    ordered = sorted(columns)
    return F.sha2(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}), 256)


def _folded(df: DataFrame, columns) -> list[Column]:
    """Order-free fold of the row hashes: a count, a sum and an xor lane of 60 bits.

    Every term merges in partial aggregates, so no group is ever gathered in one
    task; the decimal sum cannot overflow below 2**66 rows.
    """
    digest = row_digest(columns)
    first = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")
    second = F.conv(F.substring(digest, 16, 15), 16, 10).cast("bigint")
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(first).alias("lane_sum"),
        F.bit_xor(second).alias("lane_xor"),
    ]


def table_digest(df: DataFrame, columns=None) -> DataFrame:
    """One row (n_rows, lane_sum, lane_xor): equal for equal bags of rows."""
    return df.agg(*_folded(df, columns or df.columns))


def group_digest(df: DataFrame, group, columns=None) -> DataFrame:
    keys = [group] if isinstance(group, str) else list(group)
    rest = columns or [c for c in df.columns if c not in keys]
    folded = df.groupBy(*keys).agg(*_folded(df, rest))
    return folded.select(
        *keys,
        F.sha2(F.concat_ws(":", "n_rows", "lane_sum", "lane_xor"), 256).alias("digest"),
        "n_rows",
    )


class ChangedBasis(RuntimeError):
    """The tables changed between a read and the write that relies on it."""


def assert_unchanged(before: DataFrame, after: DataFrame) -> None:
    """Compare two one-row table digests."""
    if before.first() != after.first():
        raise ChangedBasis("state changed while it was being used; read again")
