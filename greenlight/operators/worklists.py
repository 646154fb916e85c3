"""Filters, orders, pages and queues of the review worklists."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from greenlight.functions.text import filled, natural_key, natural_parts, natural_piece
from greenlight.operators.status import format_rank
from greenlight.session import cut_lineage, shared_dir

PAGE_SIZES = (25, 50, 100, 200)


# -- filters -----------------------------------------------------------------


def extraction_filters() -> dict[str, Column]:
    """Title/author review tabs over versions joined with ``evaluate_extracted_title``."""
    review = F.col("review_status")
    missing = ~filled("extracted_title") & ~filled("extracted_authors")
    return {
        "needs_verification": missing | review.isin("pending", "red_flag") | (F.col("extraction_status") == "error"),
        "pending": review == "pending",
        "red_flag": review == "red_flag",
        "review_ok": review == "review_ok",
        "reviewed_differences": (review == "review_ok") & ~F.col("is_identical"),
        "missing": missing,
        "verified": review == "review_ok",
        "errors": F.col("extraction_status") == "error",
        "manual_override": F.col("title_author_source") == "manual_override",
        "title_mismatch": F.col("status") == "title_mismatch",
        "all": F.lit(True),
    }


def needs_extraction() -> Column:
    nothing = ~filled("extracted_title") & ~filled("extracted_authors")
    return nothing | F.col("review_status").isin("pending", "red_flag") | (F.col("extraction_status") == "error")


def suspicious() -> Column:
    return (F.col("extraction_status") == "error") | (F.col("review_status") == "red_flag")


def extraction_overwrite_summary(scoped: DataFrame) -> DataFrame:
    return scoped.agg(
        F.count(F.lit(1)).alias("active"),
        F.count_if(filled("extracted_title") | filled("extracted_authors")).alias("with_extraction"),
        F.count_if(F.col("review_status") == "review_ok").alias("reviewed"),
        F.count_if(F.col("title_verified")).alias("matched"),
    )


def formatting_filters() -> dict[str, Column]:
    state = F.col("format_status")
    edited = filled("corrected_pdf") | filled("corrected_source")
    return {
        "needs_attention": state != "review_ok",
        "pending": state == "pending",
        "needs_edit": state == "needs_edit",
        "review_ok": state == "review_ok",
        "review_ok_no_edit": (state == "review_ok") & ~edited,
        "edited": edited,
        "all": F.lit(True),
    }


def identity_filters() -> dict[str, Column]:
    """Identity review tabs over ``evaluate_identity``."""
    return {
        "all": F.lit(True),
        "needs_verification": F.col("needs_verification"),
        "verified_with_diff": F.col("verified_with_diff"),
        "identical": F.col("is_identical"),
        "title_mismatch": (F.col("status") == "title_mismatch") & ~F.col("is_verified"),
    }


def processing_filters(needs: Column, out_of_range: Column) -> dict[str, Column]:
    has_file = filled("corrected_pdf") | filled("pdf_file")
    return {
        "needs_processing": needs,
        "page_issues": F.coalesce(out_of_range, F.lit(False)),
        "processed": ~needs & has_file & (F.col("processing_status") == "processed"),
        "all": F.lit(True),
    }


def version_list_filters() -> dict[str, Column]:
    """Tabs of the version list; ``origin_conflict`` comes from ``versions.record_groups``."""
    editor = F.col("origin") == "editor_upload"
    return {
        "all": F.lit(True),
        "version_conflicts": F.coalesce(F.col("origin_conflict"), F.lit(False)) & ~F.col("discarded"),
        "editor_uploads": editor,
        "discarded": F.col("discarded"),
        "start2": ~editor,
    }


def pick(tests: dict[str, Column], name: str, default: str = "all") -> Column:
    return tests.get(name, tests[default])


# -- orders ------------------------------------------------------------------


def version_order(sort: str) -> list[Column]:
    """Version list orders; an unknown name is current first. Ids order naturally."""
    blank = (~filled("record_id")).asc()
    record, version = natural_key("record_id"), natural_key("version_id")
    date, made = F.col("upload_date"), F.col("created_at")
    newest = [date.desc(), made.desc()]
    return {
        "paper_id_asc": [blank, record.asc(), *newest],
        "paper_id_desc": [blank, record.desc(), *newest],
        "final_id_asc": [version.asc()],
        "final_id_desc": [version.desc()],
        "upload_date_asc": [date.asc(), made.asc(), version.asc()],
        "upload_date_desc": [*newest, version.desc()],
        "title_asc": [natural_key("title").asc(), record.asc()],
    }.get(sort, [F.col("active").desc(), F.col("discarded").asc(), record.asc(), version.asc()])


def master_order(sort: str) -> list[Column]:
    record = F.col("record_id").asc()
    return {
        "paper_id_desc": [natural_key("record_id").desc()],
        "title_asc": [F.col("title").asc(), record],
        "title_desc": [F.col("title").desc(), record],
        "acceptance_status": [F.col("accept_status").asc(), record],
        "updated_desc": [F.col("updated_at").desc(), record],
    }.get(sort, [natural_key("record_id").asc()])


def identity_order() -> list[Column]:
    rank = (
        F.when(F.col("needs_verification"), 0)
        .when(F.col("verified_with_diff"), 1)
        .when(F.col("is_identical"), 2)
        .otherwise(3)
    )
    return [rank.asc(), natural_key("record_id").asc(), F.col("created_at").asc()]


def formatting_order() -> list[Column]:
    return [format_rank(), F.col("record_id"), F.col("version_id")]


# -- pages -------------------------------------------------------------------


@dataclass(frozen=True)
class PageInfo:
    number: int
    pages: int
    total: int
    start: int
    end: int
    has_previous: bool
    has_next: bool


def page_info(total: int, number: int, size: int | str) -> PageInfo:
    """Clamped position of a page; 'all' is one page, an unknown size is 25."""
    if size != "all" and size not in PAGE_SIZES:
        size = PAGE_SIZES[0]
    per_page = max(total, 1) if size == "all" else size
    pages = max(1, -(-total // per_page))
    number = min(max(1, number), pages)
    start = (number - 1) * per_page
    end = min(total, start + per_page)
    return PageInfo(number, pages, total, start + 1 if total else 0, end, number > 1, number < pages)


def page(df: DataFrame, order: list[Column], number: int, size: int = 25, key: str | None = None) -> DataFrame:
    """Rows of one page of a total order, as an offset and a limit: no global row numbers.

    With ``key`` only the sort keys travel through the sort; the wide rows are then
    fetched for the page by a semi join.
    """
    if size not in PAGE_SIZES:
        raise ValueError(f"a page has one of {PAGE_SIZES} rows")
    skip = (max(1, number) - 1) * size
    if key is None:
        return df.orderBy(*order).offset(skip).limit(size)
    keys = df.orderBy(*order).select(key).offset(skip).limit(size)
    return df.join(F.broadcast(keys), key, "left_semi")  # at most ``size`` keys


#: The natural keys in the orders of the version list that many rows come down to, and their places; else current first.
NATURAL = {
    "paper_id_asc": [("record_id", 1)], "paper_id_desc": [("record_id", 1)], "final_id_asc": [("version_id", 0)], "final_id_desc": [("version_id", 0)],
    "upload_date_asc": [], "upload_date_desc": [], "title_asc": [("record_id", 1), ("title", 0)],
}


def first_versions(v: DataFrame, sort: str, last: int) -> DataFrame:
    """(version_id, position) of the first ``last`` versions in an order of the version list.

    The first parts of a natural key are compared before the whole key, so that it is made for the rows that tie in
    them only.
    """
    order = version_order(sort)
    for name, place in NATURAL.get(sort, [("record_id", 2)]):  # the last place first
        parts, start = f"_parts_{name}", f"_start_{name}"
        v = v.withColumn(parts, natural_parts(name))
        v = v.withColumn(start, F.struct(*[F.when(F.size(parts) > i, natural_piece(F.get(parts, F.lit(i)))) for i in range(4)])).drop(parts)
        order.insert(place, F.col(start).desc() if sort.endswith("_desc") else F.col(start).asc())
    return first_rows(v, order, "version_id", last)


def first_rows(df: DataFrame, order: list[Column], key: str, last: int) -> DataFrame:
    """(key, position) of the first ``last`` rows in the order, which ``key`` makes a total one; for pages near the front.

    Each task keeps as many rows as are asked for and nothing else leaves it. An expression of the order is only
    evaluated where those before it tie.
    """
    total = (*order, F.col(key).asc())
    top = df.orderBy(*total).limit(last)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*total))  # ``last`` rows at most
    return top.select(key, place.cast("long").alias("position"))


@dataclass(frozen=True)
class Ranges:
    """The narrow rows of a list, stored in ranges of its order: one folder a range, so that a page reads one or two."""

    folder: str
    schema: StructType
    key: str
    order: tuple[Column, ...]
    sizes: tuple[tuple[int, int], ...]  # (range, rows) in order

    @property
    def total(self) -> int:
        return sum(n for _, n in self.sizes)

    def before(self) -> dict[int, int]:
        """How many rows precede each range."""
        out, seen = {}, 0
        for number, n in self.sizes:
            out[number] = seen
            seen += n
        return out


def in_ranges(df: DataFrame, order: list[Column], key: str, columns: list[str], ranges: int | None = None) -> Ranges:
    """Store ``key`` and the ``columns`` the order needs in ranges of that order, which ``key`` makes a total one.

    One shuffle, once for all pages of a list. Only the number of rows of each range comes to the driver; there are
    as many ranges as shuffle partitions unless ``ranges`` says otherwise.
    """
    spark = df.sparkSession
    total = (*order, F.col(key).asc())
    folder = f"{shared_dir(spark)}/ranges-{uuid.uuid4().hex}"
    narrow = df.select(*dict.fromkeys([key, *columns])).repartitionByRange(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), *total)
    narrow = narrow.withColumn("range", F.spark_partition_id())
    narrow.write.partitionBy("range").parquet(folder)
    counted = spark.read.schema(narrow.schema).parquet(folder).groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()
    return Ranges(folder, narrow.schema, key, total, tuple(sorted((r["range"], r["n"]) for r in counted)))


def page_of(spark: SparkSession, held: Ranges, number: int, size: int | str = 25) -> tuple[PageInfo, DataFrame]:
    """A page of a stored order: its facts, and (key, position) of its rows, counted from 1.

    A number beyond the last page is the last page; 'all' is one page. Only the ranges that hold rows of the page are
    read, and their rows are counted range by range, so that the last page costs what the first does.
    """
    info = page_info(held.total, number, size)
    before = held.before()
    wanted = [k for k, n in held.sizes if before[k] < info.end and before[k] + n >= info.start]
    stored = spark.read.schema(held.schema).parquet(held.folder)
    rows = stored if len(wanted) == len(held.sizes) else stored.where(F.col("range").isin(wanted))
    offsets = spark.createDataFrame([(k, before[k]) for k in wanted] or [(-1, 0)], "range int, before long")  # a row a range
    place = F.row_number().over(Window.partitionBy("range").orderBy(*held.order)) + F.col("before")
    placed = rows.join(F.broadcast(offsets), "range").select(held.key, place.alias("position"))
    return info, placed.where(F.col("position").between(info.start, info.end))


def rows_of_page(df: DataFrame, held: Ranges, number: int, size: int | str = 25) -> tuple[PageInfo, DataFrame]:
    """A page with the wide rows of ``df`` and their position; at most a page of keys meets the table."""
    info, keys = page_of(df.sparkSession, held, number, size)
    if size != "all":
        keys = F.broadcast(keys)  # a page of rows
    return info, df.join(keys, held.key)


# -- queues ------------------------------------------------------------------


def neighbours_of(df: DataFrame, order: Column, eligible: Column, cursor: Column) -> DataFrame:
    """Previous and next eligible key around one cursor, its position, and what remains: one aggregate."""
    before, after = order < cursor, order > cursor
    return df.agg(
        F.max(F.when(eligible & before, order)).alias("previous"),
        F.min(F.when(eligible & after, order)).alias("next"),
        (F.count_if(eligible & before) + 1).alias("position"),
        F.count_if(eligible).alias("remaining"),
    )


def queue_neighbours(df: DataFrame, key: str, order: list[Column], eligible: Column) -> DataFrame:
    """For every row the previous and next eligible key in a total ascending order, and the count up to it.

    The narrow rows are range partitioned by the order and checkpointed, which fixes the
    ranges. Windows run inside one range each; what crosses ranges is carried by a table
    with one row per range, whose number is the shuffle parallelism.
    """
    named = [o.alias(f"o{i}") for i, o in enumerate(order)]
    keys = [f"o{i}" for i in range(len(order))]
    ranged = (
        df.select(F.col(key).alias("key"), F.coalesce(eligible, F.lit(False)).alias("eligible"), *named)
        .repartitionByRange(*keys)
        .withColumn("range", F.spark_partition_id())
    )
    ranged = cut_lineage(ranged)
    chosen = F.when(F.col("eligible"), F.col("key"))
    inside = Window.partitionBy("range").orderBy(*keys)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    # looking forward is looking back in the reverse order: a growing frame, not one recomputed per row
    reverse = Window.partitionBy("range").orderBy(*[F.col(k).desc() for k in keys])
    after = reverse.rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns(
        {
            "p": F.last(chosen, ignorenulls=True).over(before),
            "n": F.last(chosen, ignorenulls=True).over(after),
            "seen": F.count(chosen).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    ordering = F.struct(*keys)
    totals = ranged.groupBy("range").agg(
        F.count(chosen).alias("c"),
        F.max_by("key", F.when(F.col("eligible"), ordering)).alias("last_key"),
        F.min_by("key", F.when(F.col("eligible"), ordering)).alias("first_key"),
    )
    across = Window.partitionBy(F.lit(1)).orderBy("range")  # one row per range
    carried = totals.select(
        "range",
        F.last("last_key", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("carry_p"),
        F.first("first_key", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("carry_n"),
        F.coalesce(F.sum("c").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carry_c"),
        F.sum("c").over(Window.partitionBy(F.lit(1))).alias("total"),
    )
    return local.join(carried, "range").select(
        "key",
        F.coalesce("p", "carry_p").alias("previous_key"),
        F.coalesce("n", "carry_n").alias("next_key"),
        (F.col("seen") + F.col("carry_c")).alias("eligible_up_to"),
        (F.col("total") - F.col("seen") - F.col("carry_c")).alias("eligible_after"),
    )


def preview_order(kind: str) -> list[Column]:
    """Order of import previews: what needs a look first, then natural id."""
    if kind == "master":
        rank = (
            F.when(F.col("decision_required"), 0)
            .when(F.col("id_review_reset"), 1)
            .when(F.col("status") == "new", 2)
            .when(F.col("status") == "changed", 3)
            .otherwise(4)
        )
        return [rank.asc(), F.col("record_id").asc()]
    files_reset = F.col("pdf_reset") | F.col("source_reset") | F.col("corrected_archived")
    review_reset = F.col("id_review_reset") | F.col("title_match_reset") | F.col("review_reset")
    rank = (
        F.when(F.col("protected") | F.col("invalid_master"), 0)
        .when((F.col("status") != "new") & ~files_reset & review_reset, 1)
        .when(files_reset, 2)
        .when(F.col("status") == "new", 3)
        .when(F.col("status") == "changed", 4)
        .otherwise(5)
    )
    return [rank.asc(), natural_key("version_id").asc()]
