"""Text expressions: identifiers, titles, names, notes and file names.

All are Column -> Column and stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide the results and must not drift.
SPACE = " \t\n\r\x0b\x0c"
NAME_SEPARATOR = (
    r"(?i)[\r\n]+"
    r"|[^\S\r\n]*,[^\S\r\n]*(?:and|&)[^\S\r\n]+"
    r"|[^\S\r\n]+(?:and|&)[^\S\r\n]+"
    r"|[^\S\r\n]*[;,][^\S\r\n]*"
)
UPLOAD_NAME = r"(?i)^(.+?)_file_Submit_(PDF|Source)\..+$"
TOKEN = r"^[A-Za-z0-9_-]+$"
SOURCE_EXTENSIONS = (
    "doc", "docx", "tex", "zip", "rar", "7z", "tar", "gz", "bz2", "xz", "rtf", "odt",
)
DOUBLE_EXTENSIONS = (".tar.gz", ".tar.bz2", ".tar.xz")


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def text(value) -> Column:
    """NULL and '' mean the same: missing."""
    return F.coalesce(_col(value).cast("string"), F.lit(""))


def strip(value) -> Column:
    return F.btrim(text(value), F.lit(SPACE))


def filled(value) -> Column:
    return text(value) != ""


def nonblank(value) -> Column:
    return strip(value) != ""


def squeeze(value) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def clean_identifier(value, is_number: bool = False) -> Column:
    """Trimmed text; a whole number read as a float loses its '.0'."""
    out = strip(value)
    return F.regexp_replace(out, r"^(-?\d+)\.0+$", "$1") if is_number else out


def canonical_key(value) -> Column:
    """Upper case without blanks, '_' and '-'; ``LETTERS+digits`` drops leading zeros."""
    raw = F.regexp_replace(F.upper(strip(value)), r"[\s_-]+", "")
    letters = F.regexp_extract(raw, r"^([A-Z]+)\d+$", 1)
    digits = F.regexp_extract(raw, r"^[A-Z]+0*(\d+)$", 1)
    return F.when(letters != "", F.concat(letters, F.lit(":"), digits)).otherwise(raw)


def natural_key(value) -> Column:
    """Orderable key in which digit runs compare as numbers and sort before text.

    A number is (0, digits without leading zeros by length, digits), so any
    length is exact; text is (1, 0, lower case).
    """
    return F.transform(natural_parts(value), natural_piece)


def natural_parts(value) -> Column:
    return F.regexp_extract_all(text(value), F.lit(r"(\d+|\D+)"), 1)


def natural_piece(part: Column) -> Column:
    """A part of a natural key; without patterns, since it runs for each part of each row."""
    digits = F.ltrim(part, F.lit("0"))
    digits = F.when(digits == "", "0").otherwise(digits)
    number = (part >= "0") & (part < ":")  # a part is all digits or has none
    return F.struct(
        F.when(number, 0).otherwise(1).alias("t"),
        F.when(number, F.length(digits)).otherwise(0).alias("n"),
        F.when(number, digits).otherwise(F.lower(part)).alias("s"),
    )


def normalize_title(value) -> Column:
    return F.trim(F.regexp_replace(F.lower(text(value)), "[^a-z0-9]+", " "))


def titles_identical(left, right) -> Column:
    a, b = normalize_title(left), normalize_title(right)
    return (a != "") & (a == b)


def normalize_name(value) -> Column:
    return squeeze(F.regexp_replace(F.lower(text(value)), r"\p{Punct}", ""))


def split_names(value) -> Column:
    parts = F.split(text(value), NAME_SEPARATOR, -1)
    trimmed = F.transform(parts, lambda p: F.btrim(p, F.lit(" \t,;")))
    return F.filter(trimmed, lambda p: p != "")


def name_count(value) -> Column:
    return F.size(split_names(value))


def format_names(names) -> Column:
    names = _col(names)
    size = F.size(names)
    head = F.array_join(F.slice(names, 1, F.greatest(size - 1, F.lit(0))), ", ")
    return (
        F.when(size <= 0, F.lit(""))
        .when(size == 1, F.element_at(names, 1))
        .when(size == 2, F.array_join(names, " and "))
        .otherwise(F.concat(head, F.lit(", and "), F.element_at(names, -1)))
    )


def clean_note(value) -> Column:
    out = F.regexp_replace(text(value), r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[^\S\n]*\n[^\S\n]*", "\n")
    return F.btrim(F.regexp_replace(out, r"\n{3,}", "\n\n"), F.lit(SPACE))


def sanitize(value) -> Column:
    out = F.regexp_replace(text(value), r"[^A-Za-z0-9._-]+", "_")
    out = F.btrim(F.regexp_replace(out, "_+", "_"), F.lit("._-"))
    return F.when(out == "", "UNTITLED").otherwise(out)


def publication_name(record_id, title, words: int) -> Column:
    found = F.slice(F.regexp_extract_all(text(title), F.lit("([A-Za-z0-9]+)"), 1), 1, words)
    stem = F.array_join(found, " ")
    stem = F.when(stem == "", "UNTITLED").otherwise(stem)
    return F.concat(sanitize(record_id), F.lit("-"), stem)


def file_name(path) -> Column:
    return F.substring_index(text(path), "/", -1)


def file_extension(path) -> Column:
    name = F.lower(file_name(path))
    out = F.when(F.lit(False), "")
    for known in DOUBLE_EXTENSIONS:
        out = out.when(name.endswith(known), known)
    single = F.regexp_extract(name, r".(\.[^.]+)$", 1)
    return out.otherwise(F.when(single == "", ".source").otherwise(single))


def classify_file(name) -> Column:
    name = text(name)
    ext = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    return F.when(ext == "pdf", "pdf").when(ext.isin(*SOURCE_EXTENSIONS), "source").otherwise("unknown")


def upload_version_id(name) -> Column:
    return strip(F.regexp_extract(text(name), UPLOAD_NAME, 1))


def upload_kind(name) -> Column:
    """What the bytes are by extension, else what the name declares; '' for a foreign name."""
    declared = F.lower(F.regexp_extract(text(name), UPLOAD_NAME, 2))
    actual = classify_file(name)
    return (
        F.when(declared == "", "")
        .when(actual != "unknown", actual)
        .otherwise(declared)
    )


def formula_safe(value) -> Column:
    value = _col(value)
    return F.when(value.rlike(r"^[ \t\r\n]*[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def batch_name(name) -> Column:
    """``RECORD_TOKEN.ext`` -> struct(record_id, token, error)."""
    base = file_name(strip(name))
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    record = F.substring_index(stem, "_", 1)
    token = F.substring(stem, F.length(record) + 2, 2147483647)
    error = (
        F.when(~stem.contains("_"), "Filename must use RecordID_token format.")
        .when(record == "", "Record ID is missing before underscore.")
        .when(token == "", "Token is missing after underscore.")
        .otherwise("")
    )
    ok = error == ""
    return F.struct(
        F.when(ok, record).alias("record_id"),
        F.when(ok, token).alias("token"),
        error.alias("error"),
    )


def valid_token(value) -> Column:
    return strip(value).rlike(TOKEN)


def build_id(number, track) -> Column:
    track_part = F.regexp_replace(F.upper(text(track)), "[^A-Za-z0-9]+", "")
    track_part = F.when(track_part == "", "TRACK").otherwise(track_part)
    number_part = F.regexp_replace(text(number), "[^A-Za-z0-9]+", "")
    return F.when(~filled(track), strip(number)).otherwise(
        F.concat(track_part, F.lit("-"), number_part)
    )


def portable_path(path, roots: dict[str, str]) -> Column:
    """Replace a known root by its label; a foreign absolute path keeps only its base name."""
    path = text(path)
    out = F.when(path == "", "")
    for label, root in roots.items():
        prefix = root.rstrip("/") + "/"
        out = out.when(
            path.startswith(prefix),
            F.concat(F.lit(f"{label}:"), F.substring(path, len(prefix) + 1, 2147483647)),
        )
    return out.when(path.startswith("/"), file_name(path)).otherwise(path)


def title_case_code(value) -> Column:
    return F.initcap(F.trim(F.regexp_replace(text(value), "_", " ")))


def display_value(value) -> Column:
    value = _col(value)
    as_text = value.cast("string")
    return (
        F.when(as_text.isNull() | (as_text == ""), "Empty")
        .when(as_text == "true", "Yes")
        .when(as_text == "false", "No")
        .otherwise(as_text)
    )


def contains_ci(columns, query: str) -> Column:
    """Case-insensitive 'contains' over any of the columns."""
    needle = query.strip().lower()
    out = F.lit(False)
    for column in columns:
        out = out | F.lower(text(column)).contains(needle)
    return out if needle else F.lit(True)


def contains_joined(columns, query: str) -> Column:
    """As ``contains_ci`` over the space-joined row text, so a hit may span columns."""
    needle = query.strip().lower()
    if not needle:
        return F.lit(True)
    return F.lower(F.concat_ws(" ", *[text(c) for c in columns])).contains(needle)
