"""The driver tables seen as master, versions, waivers and log.

Orders are the master list, line items the versions that claim to belong to them,
labels the approvals, events the log. Every row of every table takes part; the
review state of a version is derived from its own columns.

What is stored of a version are the facts its columns follow from: a few numbers and its
order's date, customer and status. The wide columns (titles, name lists, hashes) are
derived where a query reads them and never lie on disk.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from greenlight.operators import scope, versions
from greenlight.session import release, shared_dir
from greenlight.settings import Settings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cat(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _if(condition: Column, then, otherwise) -> Column:
    return F.when(condition, then).otherwise(otherwise)


def title_of_order(order: Column) -> Column:
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd")
    return _if(
        F.col("o_custkey") % 50 == 0,
        "",
        _cat("Shipment ", order, " for customer ", F.col("o_custkey"), " dated ", stamp),
    )


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    out = status == "O"
    return o.select(
        _cat("P", F.col("o_orderkey")).alias("record_id"),
        F.col("o_orderpriority").alias("accept_status"),
        title_of_order(F.col("o_orderkey")).alias("title"),
        _cat("Customer ", F.col("o_custkey")).alias("authors"),
        _if(F.col("o_orderpriority") == "1-URGENT", "Expedite", "").alias("notes"),
        F.when(status == "F", "publishing").when(out, "not_publishing").otherwise("decision_required").alias("decision"),
        F.when(~out, "").when(F.col("o_custkey") % 2 == 0, "unpaid").otherwise("withdrawn").alias("exclusion_reason"),
        _if(out & (F.col("o_orderpriority") == "5-LOW"), "low priority", "").alias("exclusion_notes"),
        F.when(out, F.col("o_orderdate")).alias("excluded_at"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )


#: Columns of the stored table beside the flags.
FACTS = ("record_id", "order", "part", "supp", "n", "q", "d", "t", "flag", "line", "l_shipdate", "o_orderstatus", "o_custkey", "o_orderdate")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of a version that its line item has."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_linenumber").alias("n"),
        F.col("l_quantity").cast("int").alias("q"),
        F.round(F.col("l_discount") * 100).cast("int").alias("d"),
        F.round(F.col("l_tax") * 100).cast("int").alias("t"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("line"),
        "l_shipdate",
    )
    order = F.col("order")
    return li.withColumn("record_id", _if(_orphan(), _cat("X", order), _if(_blank(), "", _cat("P", order))))


def _orphan() -> Column:
    return (F.col("d") == 10) & (F.col("flag") == "N")


def _blank() -> Column:
    return (F.col("d") == 10) & (F.col("flag") == "A") & (F.col("t") == 0)


def version_facts(spark: SparkSession, sf_dir: str, chosen: Column | None = None) -> list[DataFrame]:
    """The facts of all versions in two parts, each with whole records: those under their own order's id (of the records
    ``chosen``, if given), which meet the order by that id, and the few under another id or none, always all. So the
    line items are dealt out by record."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order"), "o_orderstatus", "o_custkey", "o_orderdate")
    li = line_items(spark, sf_dir)
    own = F.coalesce(F.col("record_id").startswith("P"), F.lit(False))
    named = o.select(_cat("P", F.col("order")).alias("record_id"), "o_orderstatus", "o_custkey", "o_orderdate")
    mine = li.filter(own)
    if chosen is not None:
        named, mine = named.filter(chosen), mine.filter(chosen)
    return [mine.join(named, "record_id", "left").select(*FACTS), li.filter(~own).join(o, "order", "left").select(*FACTS)]


def version_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as versions, without the derived ``active`` and ``replaced`` flags."""
    own, others = version_facts(spark, sf_dir)
    return version_rows(own.unionByName(others))


def version_rows(facts: DataFrame, *kept: str) -> DataFrame:
    """The columns of versions out of their facts; ``kept`` columns stay beside them."""
    facts = facts.withColumnRenamed("record_id", "rid")
    # shared parts first, so that the wide projection below refers to columns, not to copies
    li = facts.select(
        "*",
        F.coalesce(title_of_order(F.col("order")), F.lit("")).alias("mt"),
        _cat("F", F.col("n"), "-", F.col("part"), "-", F.col("supp"), "-", F.col("order")).alias("vid"),
        F.sha2(_cat("pdf-", F.col("part"), "-", F.col("supp")), 256).alias("pdf_sha"),
        F.sha2(_cat("src-", F.col("part"), "-", F.col("n")), 256).alias("src_sha"),
        F.transform(
            F.sequence(F.lit(0), F.col("n")),
            lambda i: F.concat(F.lit("W. Author-"), (F.col("part") + i * F.col("supp")).cast("string")),
        ).alias("people"),
    )
    d, t, n, q, part, supp, order, flag, line, vid, mt, pdf_sha, src_sha, people = (
        F.col(c)
        for c in ("d", "t", "n", "q", "part", "supp", "order", "flag", "line", "vid", "mt", "pdf_sha", "src_sha", "people")
    )
    A, N, R = flag == "A", flag == "N", flag == "R"
    outside = _orphan() | _blank()
    excluded = _if(
        outside, q > 25, (F.col("o_orderstatus") == "O") != ((t == 8) & (n == 7))
    )
    state = F.when((n == 3) & N, "error").when((n == 4) & R, "pending").otherwise("processed")
    done = state == "processed"
    pages = F.when(done & (d != 10), F.floor(q / 3).cast("int"))
    fmt = F.when(t <= 4, "review_ok").when(t <= 6, "needs_edit").otherwise("pending")
    pdf = _if(supp % 10 == 0, "", _cat("pdf/", vid, ".pdf"))
    source = _if(supp % 10 == 1, "", _cat("src/", vid, ".zip"))
    fixed_pdf = _if(n == 6, _cat("fixed/", vid, ".pdf"), "")
    fixed_source = _if((n == 6) & (t >= 4), _cat("fixed/", vid, ".zip"), "")
    claimed = (
        F.when(t == 8, "")
        .when((line == "F") & A, mt)
        .when((line == "F") & N, _cat(F.upper(mt), "!"))
        .when(line == "F", _cat(mt, " revised"))
        .otherwise(_cat(mt, " volume ", n))
    )
    title = _if(mt == "", "", claimed)
    people = _if(R, F.transform(people, F.upper), people)
    joined = (
        F.when(A, F.array_join(people, ", ")).when(N, F.array_join(people, "; ")).otherwise(F.array_join(people, " and "))
    )
    score, single = d * 5, t * 2
    name_ok = A & (n >= 5)
    page_ok = A & (q >= 36)
    sim_ok = (A | R) & (d >= 8)
    single_ok = A & (t >= 6)
    dec = "decimal(5,2)"
    cols = {
        "version_id": vid,
        "entered_id": F.when(A, _cat("p-00", order)).when(N, _cat("P", order)).otherwise(order.cast("string")),
        "record_id": F.col("rid"),
        "title": title,
        "authors": joined,
        "upload_date": F.col("l_shipdate"),
        "origin": _if(R & (t >= 6), "editor_upload", "start2"),
        "discarded": (line == "O") & N & (n >= 5),
        "discard_notes": _if((line == "O") & N & (n == 5), " superseded ", ""),
        "editor_notes": _if(R & (t >= 6) & (n == 1), "late fix", ""),
        "excluded": excluded,
        "exclusion_reason": F.when(~excluded, "").when(q % 2 == 0, "unpaid").otherwise("withdrawn"),
        "exclusion_notes": _if(excluded & (n == 1), "per office", ""),
        "excluded_at": F.when(excluded, F.col("l_shipdate")),
        "pdf_file": pdf,
        "source_file": source,
        "corrected_pdf": fixed_pdf,
        "corrected_source": fixed_source,
        "pdf_current_hash": F.when((fixed_pdf == "") & (pdf == ""), None)
        .when((fixed_pdf != "") & (d == 1), None)
        .when((n == 2) & R, F.sha2(_cat("new-", part), 256))
        .otherwise(pdf_sha),
        "pdf_hash": _if(done, pdf_sha, ""),
        "processing_status": state,
        "processing_message": _if(state == "error", "unreadable file", ""),
        "thumbnail_status": _if(done, "processed", ""),
        "thumbnail_folder": _if(done, _cat("thumbs/", vid), ""),
        "pages": pages,
        "source_hash": _if((fmt == "review_ok") & (t != 1), src_sha, ""),
        "source_current_hash": F.when((fixed_source == "") & (source == ""), None)
        .when((fixed_source != "") & (d == 2), None)
        .when((d == 5) & A, F.sha2(_cat("src2-", part), 256))
        .otherwise(src_sha),
        "format_status": fmt,
        "extracted_title": F.when(d == 9, "").when(line == "F", title).otherwise(mt),
        "extracted_authors": _if((d == 8) & R, "", joined),
        "title_author_source": _if((n == 7) & R, "manual_override", "built_in_extractor"),
        "override_reason": _if((n == 7) & R & (d > 5), "layout unreadable", ""),
        "extraction_status": _if((n == 3) & A, "error", "extracted"),
        "review_status": F.when((d <= 1) & R, "red_flag").when(d >= 6, "pending").otherwise("review_ok"),
        "duplicate_review_status": _if(t >= 4, "review_ok", "pending"),
        "name_waiver_approved": name_ok,
        "name_waiver_reason": _if(name_ok & (d != 0), "consortium", ""),
        "name_waiver_value": F.when(name_ok, _if(d == 3, n, n + 1)),
        "page_waiver_approved": page_ok,
        "page_waiver_reason": _if(page_ok, "survey paper", ""),
        "page_waiver_value": F.when(page_ok, _if(t == 2, pages - 1, pages)),
        "similarity": F.when(~((t == 7) & N), score.cast(dec)),
        "single": F.when(~((d == 7) & N), single.cast(dec)),
        "similarity_waiver_approved": sim_ok,
        "similarity_waiver_reason": _if(sim_ok, "cited text", ""),
        "similarity_waiver_value": F.when(sim_ok, _if(A, score, score - 5).cast(dec)),
        "single_waiver_approved": single_ok,
        "single_waiver_reason": _if(single_ok & (n != 2), "own preprint", ""),
        "single_waiver_value": F.when(single_ok, _if(n == 1, single - 1, single).cast(dec)),
        "report_path": _if(n >= 4, _cat("reports/", vid, ".pdf"), ""),
        "report_stale": (n == 5) & A,
        "id_verified": R | (N & (line == "O")),
        "auto_verify_blocked": (n == 2) & A,
        "verification_status": _if(line == "O", "title_mismatch", "pending"),
        "verification_message": F.lit(""),
        "title_verified": d <= 2,
        "title_verify_blocked": (d == 2) & (n == 1),
        "created_at": F.col("l_shipdate"),
        "updated_at": F.col("l_shipdate"),
        # a flag the last recomputation left behind, so that conflicts exist
        "stale_active": (n == 7) & A & (t == 5) & (line == "F"),
    }
    return li.select(*[c.alias(k) for k, c in cols.items()], *kept)


def waivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    la = table(spark, sf_dir, "labels")
    return la.select(
        _cat("w author", F.col("doc_id")).alias("norm"),
        (F.col("quality") == 1).alias("approved"),
        _if(F.col("toxic") == 1, "", "series editor").alias("reason"),
        (F.col("doc_id") % 4 + 4).cast("int").alias("approved_count"),
    )


# event type -> raw action code: current codes, former codes and an unknown one
EVENT_ACTIONS = {
    "signup": "mark_not_publishing",
    "purchase": "exception_allow",
    "view": "pdf_process",
    "click": "process_pdfs",
    "error": "node_failure",
}


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the shape of the log: flat fields plus before/after/reset maps."""
    e = table(spark, sf_dir, "events")
    action = F.lit(None).cast("string")
    for kind, code in EVENT_ACTIONS.items():
        action = F.when(F.col("event_type") == kind, code).otherwise(action)
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id"),
        F.col("ts"),
        _cat("user", F.col("user_id")).alias("actor"),
        action.alias("action"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("value") >= 10, "success")
        .otherwise("previewed").alias("status"),
        F.col("props").alias("message"),
        _cat("P", F.col("user_id")).alias("record_id"),
        _if(k % 3 == 0, F.array(F.lit("title")), F.array(F.lit("title"), F.lit("pages"))).alias("changed_fields"),
        F.create_map(
            F.lit("title"), _cat("T", k), F.lit("pages"), k.cast("string"), F.lit("notes"), F.lit("")
        ).alias("before"),
        F.create_map(
            F.lit("title"), _cat("T", k + 1), F.lit("pages"), _if(k % 2 == 0, k, k + 2).cast("string"),
            F.lit("notes"), _if(k > 90, "checked", ""),
        ).alias("after"),
        F.create_map(
            F.lit("pdf_reset"), _if(k % 5 == 0, "true", "false"), F.lit("source_reset"), F.lit("false")
        ).alias("reset_flags"),
    )


#: A larger table of versions is made in so many shares, each with whole buckets, so that only one share is on its way
#: through a shuffle at a time. The number is fixed, so the input is read a fixed number of times.
SHARES = 4
SMALL_ROWS = 2_000_000


def write_versions(spark: SparkSession, sf_dir: str, settings: Settings, path: str, small_rows: int = SMALL_ROWS) -> str:
    """Store the facts of all versions with their flags; the table's name.

    The rows lie in as many buckets of the record id as a shuffle has parts, so that what joins or groups versions by
    record finds them dealt out. The facts are dealt out by record and judged where they lie: no table but the result
    is written.
    """
    name, buckets = f"greenlight_versions_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = 1 if table(spark, sf_dir, "lineitem").count() <= small_rows else min(SHARES, buckets)
    bucket = F.pmod(F.hash("record_id"), F.lit(buckets))  # as bucketBy deals rows out
    for k in range(shares):
        own, others = version_facts(spark, sf_dir, bucket % shares == k if shares > 1 else None)
        for facts in [own, others] if k == 0 else [own]:
            done = versions.recompute(version_rows(facts, *FACTS[1:]), settings.active_rule)
            done = done.withColumn("active", F.col("active") | F.col("stale_active")).select(*FACTS, "active", "replaced")
            done.write.mode("append").option("path", path).bucketBy(buckets, "record_id").sortBy("record_id").saveAsTable(name)
        del own, others, facts, done
        release(spark)
    return name


@dataclass(frozen=True)
class Snapshot:
    """One consistent set of inputs, read lazily from a fixed set of paths."""

    spark: SparkSession
    sf_dir: str
    settings: Settings = Settings()

    @cached_property
    def master(self) -> DataFrame:
        return master(self.spark, self.sf_dir)

    @cached_property
    def versions(self) -> DataFrame:
        stored = self.spark.table(_stored(self.spark, self.sf_dir, self.settings))
        return version_rows(stored, "active", "replaced").drop("stale_active")

    @cached_property
    def claims(self) -> DataFrame:
        """Versions before any selection."""
        return self.versions.drop("active", "replaced")

    @cached_property
    def waivers(self) -> DataFrame:
        return waivers(self.spark, self.sf_dir)

    @cached_property
    def scoped(self) -> DataFrame:
        return scope.in_scope(self.versions, self.master)

    @cached_property
    def publishable(self) -> DataFrame:
        return scope.publishable(self.versions, self.master)


_written: dict[tuple[str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str, settings: Settings) -> str:
    """The table of the versions' facts, written to the shared folder once per session, as a store would hold it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        path = f"{shared_dir(spark)}/greenlight/{key[0]}/{sf_dir.strip('/').replace('/', '_').replace(':', '_')}/versions-{uuid.uuid4().hex}"
        _written[key] = write_versions(spark, sf_dir, settings, path)
    return _written[key]


def load(spark: SparkSession, sf_dir: str) -> Snapshot:
    """The snapshot of a folder. The version table is written when a query first reads versions; every query then
    reads it with pruned columns, and a lost executor costs no more than a reread."""
    return Snapshot(spark, sf_dir)
