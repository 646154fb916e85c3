"""Sequence similarity and Unicode folding: the few things Spark cannot express.

All are Arrow-batched pandas UDFs over distinct inputs chosen by Spark; the helpers
work on one pair of short texts.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from greenlight.functions.text import normalize_title

DIFF = T.ArrayType(
    T.StructType(
        [
            T.StructField("op", T.StringType()),
            T.StructField("old", T.StringType()),
            T.StructField("new", T.StringType()),
        ]
    )
)
# Fixed value: how a text is cut into units for a word diff.
WORD_UNITS = re.compile(r"\s+|\w+|[^\w\s]", re.UNICODE)


@F.pandas_udf(T.DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    matcher = SequenceMatcher(None)
    out, current = [], None
    for a, b in zip(left, right):
        if not a or not b:
            out.append(None)
            continue
        if b != current:  # the matcher indexes its second text, so keep it while it repeats
            matcher.set_seq2(b)
            current = b
        matcher.set_seq1(a)
        out.append(round(matcher.ratio() * 100, 2))
    return pd.Series(out, dtype="float64")


def title_similarity(left, right) -> Column:
    """0..100 with two places over normalised titles; NULL when either is empty."""
    a, b = normalize_title(left), normalize_title(right)
    return (
        F.when((a == "") | (b == ""), F.lit(None).cast("double"))
        .when(a == b, F.lit(100.0))
        .otherwise(_ratio(a, b))
    )


def normalized_ratio(left, right) -> Column:
    """As ``title_similarity`` for texts that are normalised already."""
    return _ratio(left, right)


def levenshtein_similarity(left, right) -> Column:
    """SQL-only sibling: 100 * (1 - distance / longer length) over normalised titles."""
    a, b = normalize_title(left), normalize_title(right)
    longer = F.greatest(F.length(a), F.length(b))
    score = F.round(F.lit(100.0) * (F.lit(1.0) - F.levenshtein(a, b) / longer), 2)
    return F.when((a == "") | (b == ""), F.lit(None).cast("double")).otherwise(score)


def _opcodes(old, new) -> list[dict]:
    return [
        {"op": tag, "old": "".join(old[i1:i2]), "new": "".join(new[j1:j2])}
        for tag, i1, i2, j1, j2 in SequenceMatcher(None, old, new).get_opcodes()
    ]


@F.pandas_udf(DIFF)
def word_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    cut = WORD_UNITS.findall
    return pd.Series([_opcodes(cut(a or ""), cut(b or "")) for a, b in zip(old, new)])


@F.pandas_udf(DIFF)
def char_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([_opcodes(list(a or ""), list(b or "")) for a, b in zip(old, new)])


@F.pandas_udf(T.StringType())
def _fold_unicode(values: pd.Series) -> pd.Series:
    out = []
    for value in values:
        folded = unicodedata.normalize("NFKC", value or "").casefold()
        out.append(" ".join("".join(c if c.isalnum() else " " for c in folded).split()))
    return pd.Series(out)


def normalize_title_unicode(value) -> Column:
    """NFKC, case fold, other than letters and digits to blanks, squeezed.

    ASCII text never leaves the JVM: there the fold is plain lower case. The branch
    is chosen per row, the UDF sees '' for the ASCII rows.
    """
    value = value if isinstance(value, Column) else F.col(value)
    value = F.coalesce(value, F.lit(""))
    ascii_only = ~value.rlike(r"[^\x00-\x7F]")
    plain = F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))
    return F.when(ascii_only, plain).otherwise(_fold_unicode(F.when(~ascii_only, value).otherwise("")))


def register_functions(spark) -> None:
    """Make the vectorised functions callable from SQL."""
    spark.udf.register("title_ratio", _ratio)
    spark.udf.register("fold_unicode", _fold_unicode)
    spark.udf.register("word_diff", word_diff)
    spark.udf.register("char_diff", char_diff)
