import random
import re

from pyspark.sql import functions as F

from greenlight.operators import layout

SCHEMA = "doc string, line int, span int, size double, bold boolean, superscript boolean, text string"


def test_page_with_title_names_and_affiliation(spark):
    rows = [
        ("d", 0, 0, 18.0, False, False, "A Study of Things"),
        ("d", 1, 0, 12.0, False, False, "Ann Lee, Bo Chen"), ("d", 1, 1, 8.0, False, True, "1"), ("d", 1, 2, 12.0, False, False, ","),
        ("d", 2, 0, 12.0, False, False, "Cy Doe, Di Eng and Ed Fox"),
        ("d", 3, 0, 10.0, False, False, "University of Somewhere"),
    ]
    got = layout.extract_title_names(spark.createDataFrame(rows, SCHEMA)).first()
    assert (got["title"], got["n_names"]) == ("A Study of Things", 5)
    assert got["authors"] == "Ann Lee, Bo Chen, Cy Doe, Di Eng, and Ed Fox"


def brute(lines):
    """The heuristic spelled out line by line, to compare with the fold."""
    in_title = in_names = False
    size0, title, people = 0.0, "", ""
    for size, bold, text, marked in lines:
        if not in_title and (size > 13.5 or bold):
            in_title, size0 = True, size
        elif in_title and abs(size0 - size) > 1:
            in_title, in_names = False, True
        if in_title:
            title += text + " "
        if not in_names:
            continue
        shown = marked.strip()
        if not people:
            if shown:
                people = marked.replace("#", " ")
            continue
        stop = re.match(r"^[#\d]", shown) or shown.lower().startswith(layout.AFFILIATIONS)
        if stop or not (re.match(r".+\W(\s*and)?$", people.strip()) or shown.startswith((",", "and "))):
            break
        people += " " + marked.replace("#", " ")
    return re.sub(r"\s+", " ", title.strip())


def test_fold_equals_line_by_line(spark):
    rng = random.Random(3)
    bits = ["Deep nets", "Ann Lee,", "Bo Chen and", "University of X", "1 Dept", ", Cy", "and Di", " ", "Éva Nö"]
    rows, expected = [], {}
    for d in range(80):
        lines = []
        for n in range(rng.randint(1, 8)):
            size, bold, text = rng.choice([9.0, 12.0, 12.5, 14.0, 18.0]), rng.random() < 0.15, rng.choice(bits)
            sup = rng.random() < 0.3
            rows.append((f"d{d}", n, 0, size, bold, False, text))
            if sup:
                rows.append((f"d{d}", n, 1, size, bold, True, "2"))
            lines.append((size, bold, text + ("2" if sup else ""), text + ("#" if sup else "")))
        expected[f"d{d}"] = brute(lines)
    got = {r["doc"]: r["title"] for r in layout.extract_title_names(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == expected


def find(spark, words, phrase):
    df = spark.createDataFrame([(words, phrase)], "w array<string>, p array<string>")
    return [tuple(h) for h in df.select(layout.find_phrase(F.col("w"), F.col("p"))).first()[0]]


def test_find_phrase(spark):
    assert find(spark, ["by", "*Ann", "Lee1,", "Ann", "Leeds"], ["Ann", "Lee"]) == [(2, False)]
    assert find(spark, ["Ann", "Leeds"], ["Ann", "Lee"]) == [(1, True)]
    assert find(spark, ["Ann", "B.", "Lee"], ["Ann", "B.", "Lee"]) == [(1, False)]
    assert find(spark, ["Anna"], ["Ann"]) == [(1, True)]
    assert find(spark, ["x"], ["x", "y"]) == []
    assert find(spark, ["x"], []) == []
