import pytest
from pyspark.sql import functions as F

from greenlight.functions import scores, text


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("A and B", ["A", "B"]),
        ("A, B", ["A", "B"]),
        ("A and B and C", ["A", "B", "C"]),
        ("A, B, and C", ["A", "B", "C"]),
        ("A; B; C", ["A", "B", "C"]),
        ("A & B", ["A", "B"]),
        ("A\nB\r\n and C", ["A", "B", "C"]),
        ("Anders Holland", ["Anders Holland"]),
        (" ;, ", []),
        (None, []),
    ],
)
def test_split_names(spark, raw, expected):
    assert one(spark, text.split_names("x"), raw) == expected


@pytest.mark.parametrize("names, shown", [([], ""), (["A"], "A"), (["A", "B"], "A and B"), (["A", "B", "C"], "A, B, and C")])
def test_format_names(spark, names, shown):
    df = spark.createDataFrame([(names,)], "n array<string>")
    assert df.select(text.format_names("n")).first()[0] == shown


def test_natural_key_orders_numbers_as_numbers(spark):
    ids = ["A10B2", "a9", "34", "A9B3", "9", "A10", "A9B3", "00009x", "123456789012345678901234567890"]
    df = spark.createDataFrame([(i,) for i in ids], "x string")
    got = [r["x"] for r in df.orderBy(text.natural_key("x"), "x").collect()]
    assert got == ["9", "00009x", "34", "123456789012345678901234567890", "a9", "A9B3", "A9B3", "A10", "A10B2"]


@pytest.mark.parametrize("raw, key", [("p-003", "P:3"), ("P 03", "P:3"), ("R003x", "R003X"), ("12", "12"), (None, "")])
def test_canonical_key(spark, raw, key):
    assert one(spark, text.canonical_key("x"), raw) == key


def test_clean_note(spark):
    assert one(spark, text.clean_note("x"), "\r\n a \r\n\r\n\r\n b\t\n") == "a\n\nb"


def test_sanitize_and_publication_name(spark):
    assert one(spark, text.sanitize("x"), " a/b__c. ") == "a_b_c"
    assert one(spark, text.sanitize("x"), "///") == "UNTITLED"
    assert one(spark, text.publication_name(F.lit("P/1"), "x", 2), "Deep, learning now") == "P_1-Deep learning"


def test_upload_names(spark):
    assert one(spark, text.upload_version_id("x"), "F12_file_Submit_PDF.pdf") == "F12"
    assert one(spark, text.upload_kind("x"), "F12_file_Submit_Source.tar.gz") == "source"
    assert one(spark, text.upload_kind("x"), "F12_file_submit_PDF.zip") == "source"
    assert one(spark, text.upload_kind("x"), "F12.zip") == ""


def test_formula_safe(spark):
    assert one(spark, text.formula_safe("x"), " =1+1") == "' =1+1"
    assert one(spark, text.formula_safe("x"), "a=1") == "a=1"


def test_batch_name(spark):
    assert tuple(one(spark, text.batch_name("x"), "P001_T_1.pdf")) == ("P001", "T_1", "")
    assert one(spark, text.batch_name("x"), "P001.pdf")["error"].startswith("Filename")
    assert one(spark, text.batch_name("x"), "_T.pdf")["error"].startswith("Record ID")
    assert one(spark, text.batch_name("x"), "P_.pdf")["error"].startswith("Token")


@pytest.mark.parametrize(
    "raw, value, bad",
    [("", None, False), ("<1", 1, False), ("< 1.0 %", 1, False), ("12.5%", 13, False), ("+3.", 3, False), (".4", 0, False),
     ("101", None, True), ("-1", None, True), ("x", None, True), ("1e2", None, True), ("NaN", None, True)],
)
def test_parse_percent(spark, raw, value, bad):
    got = one(spark, scores.parse_percent("x"), raw)
    assert (got["value"] if got["value"] is None else int(got["value"]), got["error"] != "") == (value, bad)


def test_parse_decimal_is_lenient(spark):
    assert int(one(spark, scores.parse_decimal("x"), "2.5 %")) == 3
    assert int(one(spark, scores.parse_decimal("x"), "<5")) == 1
    assert one(spark, scores.parse_decimal("x"), "n/a") is None


def test_parse_timestamp_zone(spark):
    now = F.lit("2000-01-01 00:00:00").cast("timestamp")
    show = lambda v: one(spark, F.date_format(scores.parse_timestamp("x", "America/Chicago", now), "yyyy-MM-dd HH:mm"), v)
    assert show("2024-01-15 12:00:00") == "2024-01-15 18:00"
    assert show("2024-01-15T12:00:00+00:00") == "2024-01-15 12:00"
    assert show("soon") == show("") == "2000-01-01 00:00"


def test_size_label_and_extension(spark):
    assert one(spark, scores.size_label(F.lit(1536)), "") == "1.5 KB"
    assert one(spark, text.file_extension("x"), "a/b.TAR.GZ") == ".tar.gz"
    assert one(spark, text.file_extension("x"), "a/b") == ".source"


def test_portable_path(spark):
    f = text.portable_path("x", {"media": "/srv/media"})
    assert one(spark, f, "/srv/media/a/b.pdf") == "media:a/b.pdf"
    assert one(spark, f, "/other/b.pdf") == "b.pdf"
    assert one(spark, f, "rel/b.pdf") == "rel/b.pdf"


def test_size_label_rounds_a_half_to_even_and_keeps_null(spark):
    sizes = spark.createDataFrame([(1152,), (1408,), (3 * 131072 + 2**20,), (5 * 2**30,), (None,)], "n long")
    assert [r[0] for r in sizes.select(scores.size_label("n", 2)).collect()] == ["1.12 KB", "1.38 KB", "1.38 MB", "5.00 GB", None]
    assert [r[0] for r in sizes.select(scores.size_label("n")).collect()] == ["1.1 KB", "1.4 KB", "1.4 MB", "5.0 GB", None]


def test_file_names_of_a_page_without_html_or_url(spark, tmp_path):
    from greenlight.plans import report_queries  # noqa: F401
    from greenlight.plans.queries import REGISTRY

    pages = [(1, "https://a.example/x/y.pdf", "h" * (128 * 9)), (2, None, "h"), (3, "https://a.example/z", None), (4, "ftp://a.example/q/r", "h")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in REGISTRY["file_names"](spark, str(tmp_path)).collect()}
    assert [got[k]["path"] for k in (1, 2, 3, 4)] == ["y.pdf", None, "z", "r"]
    assert [got[k]["size"] for k in (1, 2, 3, 4)] == ["41.62 KB", "74 B", None, "148 B"]
