"""Numbers, percentages, timestamps and size labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from greenlight.functions.text import _col, strip, text

# Accepted spellings of a percentage.
BELOW_ONE = r"^<\s*1(?:\.0+)?\s*%?$"
PERCENT = r"^([+-]?(?:\d+(?:\.\d*)?|\.\d+))\s*%?$"
SCORE = "decimal(5,2)"


def _decimal(value: Column) -> Column:
    return value.try_cast("decimal(38,10)")


def parse_decimal(value) -> Column:
    """A score as whole percent, half up; '<…' is 1; anything else unreadable is NULL."""
    raw = strip(F.regexp_replace(text(value), "%", ""))
    return (
        F.when(raw == "", F.lit(None).cast(SCORE))
        .when(raw.startswith("<"), F.lit(1).cast(SCORE))
        .otherwise(F.round(_decimal(raw), 0).try_cast(SCORE))
    )


def parse_percent(value, label: str = "Percent") -> Column:
    """Strict form: struct(value, error); blank is a missing value, not an error."""
    raw = strip(value)
    digits = F.regexp_replace(F.regexp_extract(raw, PERCENT, 1), r"\.$", "")
    number = _decimal(digits)
    malformed = f"{label} must be blank (meaning missing), a number from 0 to 100, or '<1'."
    outside = f"{label} must be between 0 and 100."
    error = (
        F.when((raw == "") | raw.rlike(BELOW_ONE), "")
        .when(~raw.rlike(PERCENT), malformed)
        .when(number.isNull() | (number < 0) | (number > 100), outside)
        .otherwise("")
    )
    parsed = F.when(raw.rlike(BELOW_ONE), F.lit(1).cast(SCORE)).when(
        (error == "") & (raw != ""), F.round(number, 0).try_cast(SCORE)
    )
    return F.struct(parsed.alias("value"), error.alias("error"))


def whole_percent(value) -> Column:
    """Truncated, as the reports show it."""
    return _col(value).cast("int")


def whole_percent_label(value) -> Column:
    """Rounded half to even, as messages show it."""
    value = _col(value)
    return F.when(value.isNull(), "").otherwise(F.bround(value.cast("double"), 0).cast("int").cast("string"))


def score_level(value, limit: float) -> Column:
    value = _col(value)
    return F.when(value.isNull(), "secondary").when(value > F.lit(limit), "danger").otherwise("light")


TIMESTAMP_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
)


def parse_timestamp(value, zone: str, now: Column | None = None) -> Column:
    """Lenient: an explicit offset wins, naive text is in ``zone``, blank or bad means now."""
    raw = strip(value)
    aware = F.when(raw.rlike(r"\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$"), raw.try_cast("timestamp"))
    naive = F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in TIMESTAMP_FORMATS])
    return F.coalesce(aware, F.to_utc_timestamp(naive, zone), F.current_timestamp() if now is None else now)


def local_naive(value, zone: str) -> Column:
    return F.from_utc_timestamp(_col(value), zone).cast("timestamp_ntz")


def equal_ignoring_micros(left, right) -> Column:
    return F.date_trunc("second", _col(left)).eqNullSafe(F.date_trunc("second", _col(right)))


def equal_decimal(left, right) -> Column:
    return _col(left).cast("decimal(38,10)").eqNullSafe(_col(right).cast("decimal(38,10)"))


def size_label(value, places: int = 1) -> Column:
    """Bytes, KB, MB or GB; a half rounds to even, as in Python and SQL (format_string alone rounds it up)."""
    size = _col(value).cast("double")
    shown = lambda power, unit: F.format_string(f"%.{places}f {unit}", F.bround(size / 1024**power, places))
    out = F.when(size < 1024, F.format_string("%d B", _col(value).cast("long")))
    for power, unit in ((1, "KB"), (2, "MB")):
        out = out.when(size < 1024 ** (power + 1), shown(power, unit))
    return out.when(size.isNotNull(), shown(3, "GB"))
