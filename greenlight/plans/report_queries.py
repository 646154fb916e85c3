"""Registered queries for reports, the log, text functions, layout and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from greenlight import domain, schema
from greenlight.functions import digest, scores, similarity, text
from greenlight.operators import duplicates, events, exceptions, files, layout, names, rules, scope, titles, transitions
from greenlight.plans import combined, lists, reports
from greenlight.plans.queries import query, stamp
from greenlight.session import shared_dir
from greenlight.streaming import log, stores


@query
def record_detail(d):
    return reports.record_detail(d.master, d.versions, d.waivers, d.settings)


@query
def excluded_report(d):
    return reports.excluded_report(d.master, d.versions).withColumn("marked_at", stamp("marked_at"))


@query
def master_report(d):
    out = reports.master_report(d.master)
    return out.withColumns({c: stamp(c) for c in ("excluded_at", "created_at", "updated_at")})


@query
def note_summary(d):
    return reports.note_summary(d.master)


@query
def record_lines(d):
    """Versions, exceptions and blocking findings of every record, a row each."""
    return reports.record_lines(d.master, d.versions, d.waivers, d.settings)


@query
def manifest(d):
    return reports.manifest(d.master, d.versions, d.waivers, d.settings, draft=True)


@query
def warnings(d):
    return reports.warnings(d.master, d.versions, d.waivers, d.settings)


@query
def version_export(d):
    out = reports.version_export(d.versions, d.master)
    return out.select("version_id", "record_id", "m_title", "m_decision", "origin_label", "decision_label", "format_label",
                      "review_label", "exclusion_label", "in_master")


@query
def quality_checks(d):
    m = schema.quality_report(d.master, schema.master_checks()).withColumn("source", F.lit("master"))
    v = schema.quality_report(d.versions, schema.version_checks()).withColumn("source", F.lit("versions"))
    return m.unionByName(v)


@query
def duplicate_master_keys(d):
    """Typed ids of all versions checked as if they were a master list."""
    return schema.duplicate_master_keys(d.claims.select(F.col("entered_id").alias("record_id")))


# -- log ----------------------------------------------------------------------


def _log(d):
    return events.with_action_metadata(domain.event_log(d.spark, d.sf_dir))


@query
def log_actions(d):
    return _log(d).select("event_id", "raw_action", "action", "action_label", "category", "category_label", "registered")


@query
def log_filter(d):
    return events.log_filter(_log(d), query="k\": 1", category="processing", action="process_pdfs", status="success").select(
        "event_id", "action", "status", "message"
    )


@query
def log_changes(d):
    return events.log_changes(domain.event_log(d.spark, d.sf_dir))


@query
def log_facets(d):
    return events.facet_counts(domain.event_log(d.spark, d.sf_dir))


@query
def log_tail(d):
    return events.tail_events(_log(d), 100).select("event_id", "action", stamp("ts").alias("ts"))


def _arrivals(d, name):
    """A folder of its own for what arrives in a stream and what comes out of it."""
    return f"{shared_dir(d.spark)}/{name}-{uuid.uuid4().hex}"


def _end(rows):
    """A row long after all others, which lets the watermark pass them; its own window never closes."""
    return rows.orderBy(F.col("ts").desc(), "event_id").limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1000 DAYS")).withColumn("event_id", F.lit(-1).cast(rows.schema["event_id"].dataType))


@query
def log_hourly(d):
    """Events an hour, category and status, counted by a stream that appends closed hours to files."""
    folder = _arrivals(d, "hourly")
    rows = domain.event_log(d.spark, d.sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (rows, _end(rows)):
        stores.feed(part, f"{folder}/in")
        stores.append_to_files(log.event_counts(d.spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), delay="1 day"), folder)
    return stores.appended(d.spark, folder).withColumn("window_start", stamp("window_start"))


@query
def log_sessions(d):
    """Sessions by a stream in append mode. The log arrives in two halves; some events of the last half hour of the
    first come late, with the second, and others come twice."""
    folder = _arrivals(d, "sessions")
    rows = domain.event_log(d.spark, d.sf_dir).select("event_id", "actor", F.col("ts").cast("timestamp").alias("ts"))
    middle = F.lit(rows.agg(F.timestamp_seconds((F.min(F.unix_micros("ts")) + F.max(F.unix_micros("ts"))) / 2e6)).first()[0])
    recent = (F.col("ts") < middle) & (F.col("ts") >= middle - F.expr("INTERVAL 30 MINUTES"))
    late, twice = recent & (F.col("event_id") % 2 == 0), recent & (F.col("event_id") % 2 == 1)
    for part in (rows.where((F.col("ts") < middle) & ~late), rows.where((F.col("ts") >= middle) | late | twice), _end(rows)):
        stores.feed(part, f"{folder}/in")
        stores.append_to_files(log.log_sessions(d.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")), folder)
    out = stores.appended(d.spark, folder)
    return out.select("actor", "n_events", stamp("started").alias("started"), stamp("expires").alias("expires"))


@query
def active_stream(d):
    """Active versions by a stream into the version store: all versions arrive standing, then the discards retract
    some, after a compaction."""
    folder = _arrivals(d, "active")
    rows = d.claims.select("version_id", "discarded", "origin", "record_id", F.col("created_at").cast("timestamp").alias("created_at"))
    columns = [c.split(" ")[0] for c in stores.STORED.split(", ")]
    stores.open_store(d.spark, folder)
    for seq, part in enumerate((rows.withColumn("discarded", F.lit(False)), rows.where("discarded"))):
        stores.feed(part.withColumn("seq", F.lit(seq).cast("long")).select(*columns), f"{folder}/in")
        stores.keep_versions(d.spark.readStream.schema(stores.STORED).parquet(f"{folder}/in"), folder)
        if not seq:
            stores.compact(d.spark, folder)
    return stores.active_versions(stores.read_versions(d.spark, folder))


# -- text, digests, layout ----------------------------------------------------


def _docs(d):
    return domain.table(d.spark, d.sf_dir, "documents")


@query
def duplicate_text(d):
    return duplicates.exact_text_groups(_docs(d), text.normalize_title("text"), "doc_id").select(
        F.sha2("key", 256).alias("key_hash"), "n_rows", "first_id"
    )


@query
def content_hash(d):
    return _docs(d).select("doc_id", digest.content_hash(F.col("text").cast("binary")).alias("sha256"))


@query
def row_digest(d):
    return d.master.select("record_id", digest.row_digest(["record_id", "title", "decision", "notes"]).alias("digest"))


@query
def group_digest(d):
    return digest.group_digest(d.versions.select("record_id", "version_id", "title", "pages", "excluded"), "record_id")


@query
def table_digest(d):
    return digest.table_digest(d.master.select("record_id", "title", "decision", "notes"))


@query
def text_functions(d):
    lines = domain.table(d.spark, d.sf_dir, "conversations")
    t = F.col("text")
    return lines.select(
        "conv_id", "turn",
        text.sanitize("text").alias("sanitized"),
        text.publication_name(F.concat(F.lit("C "), F.col("conv_id").cast("string")), t, 5).alias("file_name"),
        text.clean_note(F.concat(F.lit("\r\n "), t, F.lit("\r\n\r\n\r\n x  \n"))).alias("note"),
        text.canonical_key(F.concat(F.col("role"), F.lit("-00"), F.col("turn").cast("string"))).alias("canonical"),
        text.normalize_name("text").alias("name"),
        text.name_count("text").cast("long").alias("n_names"),
        text.format_names(text.split_names("text")).alias("formatted"),
        text.formula_safe(F.concat(F.when(F.col("turn") % 2 == 0, " =").otherwise(""), t)).alias("safe"),
        text.build_id(F.col("conv_id"), F.col("role")).alias("built"),
    )


@query
def file_names(d):
    pages = domain.table(d.spark, d.sf_dir, "pages")
    path = F.regexp_replace("url", "^https?:/", "")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("//"), path))  # no url is a path of the store
    return pages.select(
        "page_id", text.file_extension("url").alias("ext"), text.classify_file("url").alias("kind"),
        F.when(path.isNotNull(), text.portable_path(path, {"media": "/m.thththth.example.net"})).alias("path"),
        text.upload_version_id(F.concat(F.lit("v"), F.col("page_id").cast("string"), F.lit("_file_submit_pdf.ZIP"))).alias("upload_id"),
        text.upload_kind(F.concat(F.lit("v"), F.col("page_id").cast("string"), F.lit("_file_submit_pdf."), F.when(F.col("page_id") % 2 == 0, "zip").otherwise("bin"))).alias("upload_kind"),
        scores.size_label(F.length("html") * F.col("page_id") * 37, 2).alias("size"),
    )


@query
def parse_percent(d):
    raw = F.concat(
        F.when(F.col("l_linenumber") == 1, "< ").when(F.col("l_linenumber") == 2, "+").otherwise(""),
        F.col("l_quantity").cast("string"),
        F.when(F.col("l_returnflag") == "A", " %").when(F.col("l_returnflag") == "N", "").otherwise("x"),
    )
    li = domain.table(d.spark, d.sf_dir, "lineitem").withColumn("raw", raw)
    p = scores.parse_percent("raw", "Single %")
    return li.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select(
        "raw", "n", p["value"].cast("double").alias("value"), p["error"].alias("error"),
        scores.parse_decimal("raw").cast("double").alias("loose"),
    )


@query
def parse_batch_name(d):
    pages = domain.table(d.spark, d.sf_dir, "pages")
    n = text.batch_name("url")
    return pages.select("page_id", n["record_id"].alias("record_id"), n["token"].alias("token"), n["error"].alias("error"),
                        F.coalesce(text.valid_token(n["token"]), F.lit(False)).alias("valid"))


@query
def title_unicode(d):
    return _docs(d).select("doc_id", similarity.normalize_title_unicode("text").alias("folded"))


@query
def word_diff(d):
    """Each answer against the question before it."""
    c = domain.table(d.spark, d.sf_dir, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("old"))
    pairs = c.join(before, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.explode(similarity.word_diff("old", "text")).alias("d")).select(
        "conv_id", "turn", "d.op", "d.old", "d.new"
    )


# How tags of a web page stand for a font size
TAG_SIZES = {"title": 18.0, "h1": 16.0, "h2": 14.0, "p": 12.0}


def page_spans(d):
    """Text nodes of every page as layout spans."""
    pages = domain.table(d.spark, d.sf_dir, "pages")
    pattern = F.lit("<(\\w+)[^>]*>([^<>]+)<")
    nodes = pages.select(
        F.col("page_id").alias("doc"),
        F.posexplode(F.arrays_zip(
            F.regexp_extract_all("html", pattern, 1).alias("tag"), F.regexp_extract_all("html", pattern, 2).alias("text")
        )).alias("line", "n"),
    )
    size = F.lit(10.0)
    for tag, value in TAG_SIZES.items():
        size = F.when(F.col("n.tag") == tag, value).otherwise(size)
    return nodes.select(
        "doc", "line", F.lit(0).alias("span"), size.alias("size"), (F.col("n.tag") == "b").alias("bold"),
        (F.col("n.tag") == "sup").alias("superscript"), F.col("n.text").alias("text"),
    )


@query
def extract_title(d):
    return layout.extract_title_names(page_spans(d))


@query
def find_phrase(d):
    """Where the third and fourth word of a document occur in it."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = _docs(d).select("doc_id", words.alias("w")).filter(F.size("w") >= 4)
    hits = layout.find_phrase(F.col("w"), F.slice("w", 3, 2))
    return rows.select("doc_id", F.inline(hits))


@query
def file_totals(d):
    """Version files as an inventory: bytes and files per category and in total."""
    kinds = {"pdf_file": "original", "source_file": "upload", "corrected_pdf": "export", "report_path": "report"}
    listed = d.versions.select(F.inline(F.filter(F.array(*[
        F.when(F.col(c) != "", F.struct(F.lit(k).alias("category"), F.col(c).alias("path"), F.length(c).cast("long").alias("length")))
        for c, k in kinds.items()
    ]), lambda x: x.isNotNull())))
    return files.category_totals(listed)


@query
def unreferenced_files(d):
    """Original files referenced neither exactly nor through a reviewed folder."""
    listed = d.versions.filter("pdf_file != ''").select(F.concat(F.lit("store/"), F.col("format_status"), F.lit("/"), F.col("pdf_file")).alias("path"))
    exact = d.scoped.select(F.lit("file").alias("kind"), F.concat(F.lit("store/"), F.col("format_status"), F.lit("/"), F.col("pdf_file")).alias("path"))
    trees = d.scoped.filter("format_status = 'needs_edit'").select(F.lit("tree").alias("kind"), F.lit("store/needs_edit").alias("path")).distinct()
    return files.unreferenced_files(listed, exact.unionByName(trees))


# -- review lists -------------------------------------------------------------


@query
def identity_list(d):
    out = lists.identity_list(d.versions, d.master, "needs_verification", scorer="levenshtein")
    return out.select("version_id", "record_id", "status", "score")


@query
def identity_suggestions(d):
    """Versions to verify, with the closest master title at 80% for unknown ids and unlike titles."""
    out = lists.identity_list(d.versions, d.master, "needs_verification", scorer="levenshtein", suggest=0.8)
    return out.select("version_id", "record_id", "status", "score", "message")


@query
def title_suggestions(d):
    """The closest master title at 80%, by sequence similarity, for every version that is to be published under an unknown id."""
    unknown = scope.publishable(d.versions, d.master).join(d.master.select("record_id"), "record_id", "left_anti")
    return titles.search(unknown, d.master, 0.8)


@query
def extraction_list(d):
    out = lists.extraction_list(d.versions, d.master, "reviewed_differences", text="dated 199", scorer="levenshtein")
    return out.select("version_id", "record_id", "status", "score")


@query
def processing_list(d):
    out = lists.processing_list(d.versions, d.master, d.settings, "page_issues", "customer 1")
    return out.select("version_id", "record_id", "pages")


@query
def formatting_list(d):
    return lists.formatting_list(d.versions, d.master, "edited", "REVISED").select("version_id", "record_id", "format_status")


@query
def version_list(d):
    return lists.version_list(d.versions, d.master, "version_conflicts", "shipment 1").select("version_id", "record_id", "origin")


@query
def finding_exceptions(d):
    counts = names.name_counts(d.scoped, d.waivers, d.settings)
    found = rules.readiness_findings(d.master, d.versions, d.waivers, d.settings, counts=counts)
    rows = exceptions.exception_rows(d.publishable, counts, d.settings)
    return lists.attach_exceptions(found, rows).select(
        "category", "record_id", "version_id", "exception_key", "exception_status", "current_value", "limit_label"
    )


@query
def not_allowed_scores(d):
    counts = names.name_counts(d.scoped, d.waivers, d.settings)
    rows = exceptions.exception_rows(d.publishable, counts, d.settings)
    return rows.filter(exceptions.exception_filter("stale", "plagiarism")).select("exception_key", "type", "current_value", "approved_value")


@query
def explode_ids(d):
    """The record ids of both neighbours of every version, as a comma list, kept where they exist."""
    n = F.regexp_extract("version_id", r"(\d+)$", 1).cast("long")
    lists_of = F.concat(F.lit("P"), (n - 1).cast("string"), F.lit(", P"), n.cast("string"), F.lit(" ,P"), n.cast("string"), F.lit(",,Z9"))
    rows = d.versions.select("version_id", lists_of.alias("ids"))
    return lists.explode_ids(rows, "ids", d.master).select("version_id", "record_id")


@query
def active_report(d):
    return reports.active_report(d.versions, d.master).select("version_id", "record_id", "m_title", "origin_label", "in_master")


@query
def old_report(d):
    return reports.old_report(d.versions, d.master).select("version_id", "old_status", "inactive_reason", "replacement_id", "decision_label")


@query
def guard_review(d):
    out = transitions.guard_review(d.versions, similarity.levenshtein_similarity)
    return out.select("version_id", "review_status", "duplicate_review_status", "title_verified", "guarded")


@query
def combined_metrics(d):
    rows = combined.combined_list(d.master, d.versions, d.settings)
    return combined.blocker_metrics(combined.combined_summary(rows))


@query
def hash_reuse(d):
    """Document bytes hashed again only where the stored length is not that of the text."""
    docs = _docs(d).select(
        F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("length"),
        F.lit("2024-01-01").cast("timestamp").alias("modified"), F.col("text").cast("binary").alias("content"),
    )
    even = F.substring("path", -1, 1).cast("int") % 2 == 0
    known = docs.select("path", F.when(even, F.col("length")).otherwise(-1).alias("length"), "modified", F.lit("stored").alias("sha256"))
    return files.hash_contents(docs, known).select("path", "length", "sha256")
