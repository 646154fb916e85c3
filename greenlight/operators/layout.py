"""Title and names from page layout, and phrase search in page words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenlight.functions.text import SPACE, format_names, split_names

# What starts a title line and what ends the names
TITLE_SIZE = 13.5
AFFILIATIONS = ("university ", "department ", "school ", "college ", "institute ")


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def page_lines(spans: DataFrame) -> DataFrame:
    """(doc, line, span, size, bold, superscript, text) -> one row per line, spans in order.

    Size and weight are those of the first span; a superscript becomes '#'.
    """
    marked = F.when(F.col("superscript"), "#").otherwise(F.col("text"))
    return (
        spans.groupBy("doc", "line")
        .agg(
            F.min_by("size", "span").alias("size"),
            F.min_by("bold", "span").alias("bold"),
            F.array_sort(F.collect_list(F.struct("span", "text", marked.alias("marked")))).alias("s"),
        )
        .select(
            "doc", "line", "size", "bold", F.array_join(F.col("s.text"), "").alias("text"),
            F.array_join(F.col("s.marked"), "").alias("buffer"),
        )
    )


def extract_title_names(spans: DataFrame) -> DataFrame:
    """(doc, title, authors, n_names) by the layout heuristic.

    A title begins at a large or bold line and ends where the size differs by more than
    one; names follow until a line that neither continues the list nor may: a marker, an
    affiliation, or text after a complete name. The lines of one first page are folded in
    the JVM.
    """
    lines = (
        page_lines(spans)
        .groupBy("doc")
        .agg(F.array_sort(F.collect_list(F.struct("line", "size", "bold", "text", "buffer"))).alias("lines"))
    )
    start = F.struct(
        F.lit(False).alias("in_title"), F.lit(0.0).alias("title_size"), F.lit("").alias("title"),
        F.lit(False).alias("in_names"), F.lit("").alias("names"), F.lit(False).alias("done"),
    )

    def step(acc: Column, line: Column) -> Column:
        begins = ~acc["in_title"] & ((line["size"] > TITLE_SIZE) | line["bold"])
        ends = acc["in_title"] & (F.abs(acc["title_size"] - line["size"]) > 1)
        in_title, in_names = begins | (acc["in_title"] & ~ends), acc["in_names"] | ends
        shown = _strip(line["buffer"])
        plain = F.replace(line["buffer"], F.lit("#"), F.lit(" "))
        first = acc["names"] == ""
        stop_word = F.lit(False)
        for word in AFFILIATIONS:
            stop_word = stop_word | F.lower(shown).startswith(word)
        open_end = _strip(acc["names"]).rlike(r"(?U)^.+\W(\s*and)?$") | shown.startswith(",") | shown.startswith("and ")
        goes_on = ~(shown.rlike(r"^[#\d]") | stop_word) & open_end
        names = (
            F.when(~in_names | (first & (shown == "")), acc["names"])
            .when(first, plain)
            .when(goes_on, F.concat(acc["names"], F.lit(" "), plain))
            .otherwise(acc["names"])
        )
        new = F.struct(
            in_title.alias("in_title"),
            F.when(begins, line["size"]).otherwise(acc["title_size"]).alias("title_size"),
            F.when(in_title, F.concat(acc["title"], line["text"], F.lit(" "))).otherwise(acc["title"]).alias("title"),
            in_names.alias("in_names"),
            names.alias("names"),
            (in_names & ~first & ~goes_on).alias("done"),
        )
        return F.when(acc["done"], acc).otherwise(new)

    folded = lines.select("doc", F.aggregate("lines", start, step).alias("r"))
    title = F.trim(F.regexp_replace(_strip(F.col("r.title")), r"\s+", " "))
    people = F.regexp_replace(F.replace(_strip(F.col("r.names")), F.lit("*"), F.lit("")), r"\s+", " ")
    people = F.regexp_replace(people, r"\s*,\s*", ", ")
    return folded.select("doc", title.alias("title"), split_names(people).alias("list")).select(
        "doc", "title", format_names("list").alias("authors"), F.size("list").alias("n_names")
    )


def find_phrase(words: Column, phrase: Column) -> Column:
    """Where a word sequence occurs: array<struct<start,partial>>, starts counted from 1.

    Inner words must be equal. The first may carry leading marks other than letters and
    digits, the last may carry trailing text; a letter right after it makes the hit
    partial. Complete hits suppress partial ones.
    """
    n = F.size(phrase)
    starts = F.when((n > 0) & (F.size(words) >= n), F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(
        F.array().cast("array<int>")
    )
    target = F.element_at(phrase, -1)

    def unmarked(word: Column) -> Column:
        return F.regexp_replace(word, r"^[^\p{L}\p{N}]+", "")

    def hit(start: Column) -> Column:
        window = F.slice(words, start, n)
        head, last = F.element_at(window, 1), F.element_at(window, -1)
        head_ok = (head == F.element_at(phrase, 1)) | (unmarked(head) == F.element_at(phrase, 1))
        inner = F.greatest(n - 2, F.lit(0))
        inner_ok = F.slice(window, 2, inner) == F.slice(phrase, 2, inner)
        # a phrase of one word takes the marks and the trailing text on the same word
        shown = F.when((n == 1) & ~last.startswith(target), unmarked(last)).otherwise(last)
        matched = shown.startswith(target) & ((n == 1) | (head_ok & inner_ok))
        partial = F.substring(shown, F.length(target) + 1, 1).rlike(r"\p{L}")
        return F.struct(start.alias("start"), partial.alias("partial"), matched.alias("matched"))

    hits = F.filter(F.transform(starts, hit), lambda h: h["matched"])
    complete = F.filter(hits, lambda h: ~h["partial"])
    kept = F.when(F.size(complete) > 0, complete).otherwise(hits)
    return F.transform(kept, lambda h: F.struct(h["start"].alias("start"), h["partial"].alias("partial")))
