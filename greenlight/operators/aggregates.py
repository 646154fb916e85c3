"""Counts over findings and rows: sections, options, workflow groups, conditional counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenlight import catalog
from greenlight.functions.text import filled


def filter_counts(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Many conditional counts in one scan."""
    return df.agg(*[F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in tests.items()])


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One-row frames with different columns as one row, without a product: union and fold."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def severity_sections(annotated: DataFrame) -> DataFrame:
    """(severity, finding_group, n): per severity ('') and per severity and group; empty severities stay."""
    rows = annotated.select("severity", F.col("group").alias("finding_group"))
    both = rows.groupingSets(
        [["severity"], ["severity", "finding_group"]], "severity", "finding_group"
    ).agg(F.count(F.lit(1)).alias("n")).withColumn("finding_group", F.coalesce("finding_group", F.lit("")))
    known = catalog.local_table(
        annotated.sparkSession, ("severity", "finding_group"), [(s, "") for s in catalog.SEVERITIES]
    )
    return both.join(known, ["severity", "finding_group"], "full").na.fill(0, ["n"])


def group_sections(annotated: DataFrame) -> DataFrame:
    return (
        annotated.groupBy(F.col("group").alias("finding_group"), "group_rank", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def area_filter(area: str) -> Column:
    """Findings of one area; an unknown area keeps all."""
    categories = catalog.AREAS.get(area)
    return F.col("category").isin(*categories) if categories else F.lit(True)


def known_categories(requested) -> list[str]:
    """Requested categories in order, once each, without unknown ones."""
    known = set(catalog.all_categories())
    seen = dict.fromkeys(str(c or "").strip() for c in requested)
    return [c for c in seen if c in known]


def category_filter(requested) -> Column:
    chosen = known_categories(requested)
    return F.col("category").isin(*chosen) if chosen else F.lit(True)


def category_options(scope_rows: DataFrame, count_rows: DataFrame, selected=()) -> DataFrame:
    """Filter options: categories of the scope with their counts; a selected one stays at zero."""
    spark = scope_rows.sparkSession
    chosen = known_categories(selected)
    table = catalog.category_table(spark).select(
        "category", F.col("group").alias("finding_group"), "severity"
    )
    present = scope_rows.select("category").distinct().join(table, "category")
    if chosen:
        present = present.unionByName(table.filter(F.col("category").isin(*chosen))).distinct()
    counted = count_rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    is_chosen = F.col("category").isin(*chosen) if chosen else F.lit(False)
    return (
        present.join(counted, "category", "left")
        .na.fill(0, ["n"])
        .withColumn("selected", is_chosen)
        .filter("n > 0 OR selected")
    )


def affected_ids(findings: DataFrame, name_records: DataFrame) -> DataFrame:
    """(category, affected): record ids behind findings; a version stands in where there is none.

    A name finding affects every record of the name; those come from ``name_records``
    by key instead of from a list in the finding.
    """
    direct = findings.filter(filled("record_id") | filled("version_id")).select(
        "category",
        F.when(filled("record_id"), F.col("record_id"))
        .otherwise(F.concat(F.lit("Final "), F.col("version_id")))
        .alias("affected"),
    )
    keyed = name_records.select(
        F.concat(F.lit("author_limit:"), F.col("norm")).alias("exception_key"),
        F.col("record_id").alias("affected"),
    )
    named = (
        findings.filter(~filled("record_id") & ~filled("version_id") & filled("exception_key"))
        .select("category", "exception_key")
        .join(keyed, "exception_key")
        .select("category", "affected")
    )
    return direct.unionByName(named)


def affected_records(findings: DataFrame, name_records: DataFrame) -> DataFrame:
    return affected_ids(findings, name_records).agg(F.count_distinct("affected").alias("n_affected"))


def action_groups(findings: DataFrame, name_records: DataFrame) -> DataFrame:
    """Workflow groups with affected counts, in total ('') and per breakdown part.

    A group without findings comes out with status 'completed'; findings of no group
    make the group 'other'.
    """
    table = F.broadcast(catalog.workflow_table(findings.sparkSession))  # fixed, under 40 rows
    hits = affected_ids(findings, name_records).join(table, "category", "left").select(
        F.coalesce("workflow", F.lit("other")).alias("workflow"),
        F.coalesce("singular", F.col("category")).alias("part"),
        "affected",
    )
    counted = hits.groupingSets([["workflow"], ["workflow", "part"]], "workflow", "part").agg(
        F.count_distinct("affected").alias("n_affected")
    )
    counted = counted.withColumn("part", F.coalesce("part", F.lit(""))).groupBy("workflow", "part").agg(
        F.max("n_affected").alias("n_affected")
    )
    known = catalog.local_table(
        findings.sparkSession, ("workflow", "part"), [(k, "") for k in catalog.WORKFLOWS]
    )
    return (
        counted.join(known, ["workflow", "part"], "full")
        .na.fill(0, ["n_affected"])
        .withColumn("status", F.when(F.col("n_affected") > 0, "open").otherwise("completed"))
    )


def top_categories(findings: DataFrame, k: int = 5) -> DataFrame:
    """The k most common categories; ties by name, so the result is fixed."""
    return (
        findings.groupBy("category")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "category")
        .limit(k)
    )


def first_and_more(df: DataFrame, text: Column, order: list[Column], limit: int = 10) -> DataFrame:
    """The first ``limit`` texts joined, then "+N more": a bounded preview of any number of rows."""
    first = df.select(text.alias("t"), *[o.alias(f"o{i}") for i, o in enumerate(order)]).orderBy(
        *[f"o{i}" for i in range(len(order))]
    ).limit(limit)
    # at most ``limit`` rows reach this aggregate
    keys = [f"o{i}" for i in range(len(order))]
    joined = first.agg(F.array_sort(F.collect_list(F.struct(*keys, "t"))).alias("e")).select(
        F.array_join(F.col("e.t"), "; ").alias("shown")
    )
    total = df.agg(F.count(F.lit(1)).alias("n"))
    return side_by_side(joined, total).select(
        F.concat(
            "shown",
            F.when(F.col("n") > limit, F.concat(F.lit(" +"), (F.col("n") - limit).cast("string"), F.lit(" more")))
            .otherwise(""),
        ).alias("preview"),
        "n",
    )


def duplicate_keys(rows: DataFrame, keys: list[str], row_number: str = "row_no") -> DataFrame:
    """Mark rows of an import file whose key occurs before: adds ``first_row`` and ``n_same``.

    Two narrow grouped values are joined back, so a key repeated any number of times
    needs no window over its rows.
    """
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_same"), F.min(row_number).alias("first_row"))
    return rows.join(groups, keys)
