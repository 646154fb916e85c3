import re

from pyspark.sql import functions as F

from greenlight.operators import aggregates, worklists
from tests.conftest import versions


def test_page_info_clamps():
    p = worklists.page_info(205, 99, 25)
    assert (p.number, p.pages, p.start, p.end, p.has_next) == (9, 9, 201, 205, False)
    assert worklists.page_info(205, 2, 25).start == 26
    assert worklists.page_info(205, 1, "all").end == 205
    assert worklists.page_info(0, 3, 33) == worklists.PageInfo(1, 1, 0, 0, 0, False, False)


def test_page_rows(spark):
    df = spark.range(205).select(F.format_string("P%04d", F.col("id") + 1).alias("k"), F.lit("wide").alias("w"))
    rows = worklists.page(df, [F.col("k").asc()], 2, 25, key="k").orderBy("k").collect()
    assert (rows[0]["k"], rows[-1]["k"], len(rows)) == ("P0026", "P0050", 25)


def test_neighbours_around_one_cursor(spark):
    df = spark.range(10).select("id", (F.col("id") % 3 == 0).alias("ok"))
    r = worklists.neighbours_of(df, F.col("id"), F.col("ok"), F.lit(4)).first()
    assert (r["previous"], r["next"], r["position"], r["remaining"]) == (3, 6, 3, 4)


def test_queue_neighbours_crosses_ranges(spark):
    n = 400
    df = spark.range(n).select(F.col("id").cast("string").alias("key"), "id", ((F.col("id") < 3) | (F.col("id") > 395)).alias("ok"))
    got = {int(r["key"]): r for r in worklists.queue_neighbours(df, "key", [F.col("id")], F.col("ok")).collect()}
    assert len(got) == n
    assert (got[200]["previous_key"], got[200]["next_key"], got[200]["eligible_up_to"], got[200]["eligible_after"]) == ("2", "396", 3, 4)
    assert got[0]["previous_key"] is None and got[399]["next_key"] is None


def test_bounded_preview(spark):
    df = spark.range(14).select(F.format_string("b%02d", "id").alias("t"))
    row = aggregates.first_and_more(df, F.col("t"), [F.col("t")], 3).first()
    assert row["preview"] == "b00; b01; b02 +11 more"


def test_known_categories():
    assert aggregates.known_categories(["Missing PDF", "nope", "Missing PDF", " "]) == ["Missing PDF"]


def test_deep_pages_read_only_their_ranges(spark):
    n = 1003
    df = spark.range(n).selectExpr("concat('k', (id * 7919) % 1003) AS k", "id % 5 AS g", "'wide' AS w")
    order = [F.col("g").desc()]
    held = worklists.in_ranges(df, order, "k", ["g"], ranges=8)
    assert held.total == n and len(held.sizes) > 4
    want = [r["k"] for r in df.orderBy(F.col("g").desc(), "k").collect()]
    for number, size in [(1, 25), (2, 100), (21, 50), (10**6, 25), (0, 25), (-3, 25), (4, 7)]:
        info, rows = worklists.page_of(spark, held, number, size)
        got = [(r["position"], r["k"]) for r in rows.orderBy("position").collect()]
        assert got == [(p, want[p - 1]) for p in range(info.start, info.end + 1)]
        pruned = re.search(r"PartitionFilters: \[(.*?)\]", rows._jdf.queryExecution().executedPlan().toString()).group(1)
        assert 1 <= len(re.search(r"range#\d+ (?:IN \([\d,]+\)|= \d+)", pruned).group(0).split(",")) <= 2
    info, rows = worklists.page_of(spark, held, 3, "all")
    assert (info.number, info.pages, rows.count()) == (1, 1, n)
    info, rows = worklists.rows_of_page(df, held, 10**6, 50)
    assert sorted((r["position"], r["k"], r["w"]) for r in rows.collect()) == [(p, want[p - 1], "wide") for p in range(1001, 1004)]


def test_deep_pages_of_few_rows(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("c", 1)], "k string, g int")
    held = worklists.in_ranges(df, [F.col("g").asc()], "k", ["g"])
    assert [r["k"] for r in worklists.page_of(spark, held, 5)[1].orderBy("position").collect()] == ["a", "b", "c"]
    none = worklists.in_ranges(df.limit(0), [F.col("g").asc()], "k", ["g"])
    info, rows = worklists.page_of(spark, none, 2)
    assert (info.total, info.start, rows.count()) == (0, 0, 0)


def test_first_versions_agree_with_the_whole_order_and_write_nothing(spark):
    ids = [f"{a}{n}-{k}{'0' * (n % 3)}{n % 7}" for n in range(60) for a, k in (("F", 10), ("f", 9), ("", 1), ("X0", 8))]
    rows = [{"version_id": f"{i}#{k}", "record_id": ["", "P1", "P01", "P10", "X"][k % 5] + "7" * (k % 3), "title": i, "active": k % 2 == 0, "upload_date": f"2024-01-0{k % 4 + 1}"} for k, i in enumerate(ids)]
    v = versions(spark, *rows)
    for sort in ("paper_id_asc", "paper_id_desc", "final_id_asc", "final_id_desc", "upload_date_asc", "upload_date_desc", "title_asc", "current_first"):
        first = worklists.first_versions(v, sort, 100)
        plan = first._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
        got = [r["version_id"] for r in first.orderBy("position").collect()]
        assert got == [r["version_id"] for r in v.orderBy(*worklists.version_order(sort), "version_id").limit(100).collect()], sort
