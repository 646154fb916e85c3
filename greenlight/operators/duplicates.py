"""Exact duplicates by title, content hash and generated file name.

Members stay in rows: group size comes from a grouped count joined back by the key,
which AQE splits when one key is hot. Partners are looked up per requested member, so
nothing ever lists all pairs of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenlight.functions.similarity import normalize_title_unicode
from greenlight.functions.text import filled, publication_name
from greenlight.settings import Settings

# Kind -> (category, label)
KINDS = {
    "title": ("Duplicate Publication Title", "Duplicate title"),
    "pdf": ("Duplicate Publication PDF", "Duplicate PDF"),
    "source": ("Duplicate Publication Source", "Duplicate source"),
    "filename": ("Duplicate Publication Filename", "Duplicate publication filename"),
}


def persisted_hash(kind: str, chosen: Column | None = None) -> Column:
    """The stored hash, only where the stage that bound it is complete; else ''."""
    if kind == "pdf":
        usable = (
            (filled("corrected_pdf") | filled("pdf_file"))
            & (F.col("processing_status") == "processed")
            & F.col("pages").isNotNull()
            & (F.col("thumbnail_status") == "processed")
            & filled("thumbnail_folder")
        )
        return F.when(usable, F.coalesce("pdf_hash", F.lit(""))).otherwise("")
    usable = (filled("corrected_source") | filled("source_file")) & (F.col("format_status") == "review_ok")
    return F.when(usable, F.coalesce("source_hash", F.lit(""))).otherwise("")


def member_keys(scoped: DataFrame, s: Settings, strict: bool = False) -> DataFrame:
    """(kind, key, version_id, record_id, base_name): every duplicate key of every row, one pass. The base name goes
    with the file name's key only.

    ``strict`` uses the hashes of the present files instead of the stored ones.
    """
    base = publication_name("record_id", "extracted_title", s.filename_words)
    if strict:
        pdf = F.coalesce("pdf_current_hash", F.lit(""))
        source = F.coalesce("source_current_hash", F.lit(""))
    else:
        pdf, source = persisted_hash("pdf"), persisted_hash("source")
    none = F.lit(None).cast("string")
    keyed = scoped.select(
        "version_id",
        "record_id",
        F.explode(
            F.array(
                F.struct(F.lit("title").alias("kind"), normalize_title_unicode("extracted_title").alias("key"), none.alias("base_name")),
                F.struct(F.lit("pdf").alias("kind"), pdf.alias("key"), none.alias("base_name")),
                F.struct(F.lit("source").alias("kind"), source.alias("key"), none.alias("base_name")),
                F.struct(F.lit("filename").alias("kind"), F.lower(base).alias("key"), base.alias("base_name")),
            )
        ).alias("k"),
    )
    return keyed.select("k.kind", "k.key", "version_id", "record_id", "k.base_name").filter("key != ''")


def duplicate_groups(members: DataFrame) -> DataFrame:
    """(kind, key, n_members, first_version_id, base_name) of the groups with more than one member."""
    return (
        members.groupBy("kind", "key")
        .agg(
            F.count(F.lit(1)).alias("n_members"),
            F.min(F.struct("version_id", "base_name")).alias("f"),
        )
        .filter("n_members > 1")
        .select("kind", "key", "n_members", F.col("f.version_id").alias("first_version_id"),
                F.col("f.base_name").alias("base_name"))
    )


def duplicate_members(members: DataFrame) -> DataFrame:
    """Every member of a duplicate group with the number of the others."""
    # the first version is looked for only where its name is told, so that counts of the other kinds shuffle alone
    named = F.when(F.col("kind") == "filename", F.struct("version_id", "base_name"))
    groups = members.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n_members"), F.min(named)["base_name"].alias("group_name"))
    groups = groups.filter("n_members > 1")
    return members.drop("base_name").join(groups, ["kind", "key"]).withColumn(
        "n_others", F.col("n_members") - 1
    )


def _plural(n: Column, one: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" other {one}"), F.when(n == 1, "").otherwise("s"))


def duplicate_findings(members: DataFrame) -> DataFrame:
    """Compact finding rows: the partner count and the key summary, not the partner list."""
    rows = duplicate_members(members)
    kind, others = F.col("kind"), F.col("n_others")
    category, label = F.lit(""), F.lit("")
    for name, (cat, shown) in KINDS.items():
        category = F.when(kind == name, cat).otherwise(category)
        label = F.when(kind == name, shown).otherwise(label)
    message = F.when(
        kind == "filename",
        F.concat(
            F.lit('Publication filename "'), F.col("group_name"), F.lit('" conflicts with '),
            _plural(others, "publication record"), F.lit(" after Paper ID/title sanitization."),
        ),
    ).otherwise(
        F.concat(
            label, F.lit(" with "), _plural(others, "publication record"),
            F.lit(". Key: "), F.substring("key", 1, 12), F.lit("."),
        )
    )
    return rows.select(
        category.alias("category"), "record_id", "version_id", message.alias("message"),
        F.lit("").alias("exception_key"),
    )


def duplicate_flags(members: DataFrame) -> DataFrame:
    """version_id -> which duplicate kinds it is in, as a bounded set of four labels."""
    return duplicate_members(members).groupBy("version_id").agg(
        *[F.max(F.when(F.col("kind") == k, 1).otherwise(0)).cast("boolean").alias(f"dup_{k}") for k in KINDS]
    )


def duplicate_detail(members: DataFrame, requests: DataFrame) -> DataFrame:
    """The other members for each requested (kind, key, version_id), one row each."""
    wanted = requests.select("kind", "key", F.col("version_id").alias("of_version_id"))
    others = members.join(wanted, ["kind", "key"]).filter("version_id != of_version_id")
    label = F.concat(
        F.when(filled("record_id"), F.col("record_id")).otherwise("No Paper ID"),
        F.lit(" / Final "), F.col("version_id"),
    )
    return others.select(
        "kind", "key", "of_version_id", "version_id", label.alias("other_label"),
        F.substring("key", 1, 12).alias("key_summary"),
    )


def exact_text_groups(df: DataFrame, key: Column, id_column: str) -> DataFrame:
    """Groups of equal keys over any table: (key, n_rows, first id)."""
    return (
        df.select(key.alias("key"), F.col(id_column).alias("id"))
        .filter("key != ''")
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("first_id"))
        .filter("n_rows > 1")
    )
