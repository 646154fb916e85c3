from pyspark.sql import functions as F

from greenlight.operators import scope, versions
from tests.conftest import master, versions as make


def active(df):
    return sorted(r["version_id"] for r in df.filter("active").collect())


def test_natural_order_decides(spark):
    v = make(spark, {"version_id": "A9B3"}, {"version_id": "A10B2"})
    out = versions.recompute(v)
    assert active(out) == ["A10B2"]
    assert [r["version_id"] for r in out.filter("replaced").collect()] == ["A9B3"]


def test_editor_rows_compete_alone(spark):
    v = make(spark, {"version_id": "F9"}, {"version_id": "F1", "origin": "editor_upload"}, {"version_id": "F2", "origin": "editor_upload", "discarded": True})
    out = versions.recompute(v)
    assert active(out) == ["F1"]
    assert [r["version_id"] for r in out.filter("replaced").collect()] == ["F9"]


def test_date_rule_and_preview(spark):
    v = make(spark, {"version_id": "F2", "upload_date": "2024-01-01"}, {"version_id": "F1", "upload_date": "2024-02-01"})
    assert active(versions.recompute(v, "upload_date")) == ["F1"]
    change = versions.preview_rule_change(v, "final_id", "upload_date").collect()
    assert [(r["before_id"], r["after_id"]) for r in change] == [("F2", "F1")]


def test_blank_record_is_never_active(spark):
    assert active(versions.recompute(make(spark, {"version_id": "F1", "record_id": ""}))) == []


def test_scope_splits(spark):
    m = master(spark, {"record_id": "P1"}, {"record_id": "P2", "decision": "not_publishing"}, {"record_id": "P3", "decision": "decision_required"}, {"record_id": "P4"})
    v = make(
        spark, {"version_id": "F1"}, {"version_id": "F2", "record_id": "P2"}, {"version_id": "F3", "record_id": "P3"},
        {"version_id": "F5", "record_id": "X"}, {"version_id": "F6", "record_id": "Y", "excluded": True}, {"version_id": "F7", "record_id": ""},
    )
    ids = lambda df, c="version_id": sorted(r[c] for r in df.collect())
    assert ids(scope.publishable(v, m)) == ["F1", "F5", "F7"]
    assert ids(scope.in_scope(v, m)) == ["F1"]
    assert ids(scope.orphans(v, m)) == ["F5", "F7"]
    assert ids(scope.missing_versions(m, v), "record_id") == ["P4"]


def test_group_checks(spark):
    m = master(spark, {"record_id": "P1"}, {"record_id": "P2", "decision": "not_publishing"})
    v = make(
        spark, {"version_id": "F1"}, {"version_id": "F2", "origin": "editor_upload"}, {"version_id": "F3", "record_id": "P2"},
        {"version_id": "F4", "record_id": "X", "excluded": True}, {"version_id": "F5", "record_id": "X"},
    )
    assert [(r["record_id"], r["n_active"]) for r in versions.multiple_active(v, m).collect()] == [("P1", 2)]
    assert [(r["record_id"], r["n_author"], r["n_editor"]) for r in versions.origin_conflicts(v, m).collect()] == [("P1", 1, 1)]
    assert [r["record_id"] for r in versions.mixed_decisions(v, m).collect()] == ["X"]
    assert [(r["record_id"], r["n_mismatched"]) for r in versions.decision_integrity(v, m).collect()] == [("P2", 1)]


def test_one_record_may_own_most_rows(spark):
    """A third of all rows in one record: one winner, everything else replaced."""
    base = make(spark, {"version_id": "x"}).drop("version_id", "record_id")
    ids = spark.range(6000).select(
        F.concat(F.lit("F"), F.col("id")).alias("version_id"),
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("P"), F.col("id"))).alias("record_id"),
    )
    v = ids.crossJoin(base)
    out = versions.recompute(v)
    assert out.filter("record_id = 'HOT' AND active").select("version_id").first()[0] == "F5997"
    assert out.filter("replaced").count() == 1999
    assert out.count() == 6000


def test_classify_old(spark):
    v = versions.recompute(make(
        spark, {"version_id": "F1"}, {"version_id": "F2"}, {"version_id": "F3", "discarded": True, "discard_notes": "bad"}, {"version_id": "F4", "record_id": ""},
    ))
    got = {r["version_id"]: (r["old_status"], r["replacement_id"], r["note_summary"]) for r in versions.classify_old(v).collect()}
    assert got == {"F1": ("replaced", "F2", ""), "F3": ("discarded", "F2", "Discard note: bad"), "F4": ("other", "", "")}


def test_stored_versions_are_narrow_and_dealt_out_by_record(spark):
    """Only facts are stored, the rows are those of the whole derivation, and what joins versions to the master by record does not shuffle them."""
    from greenlight import domain

    folder = "/root/testdata/sf0.001"
    d = domain.load(spark, folder)
    key = (spark.sparkContext.applicationId, folder)
    assert key not in domain._written  # queries that read no versions write none
    columns = ["version_id", "record_id", "title", "authors", "excluded", "pdf_current_hash", "active", "replaced"]
    whole = versions.recompute(domain.version_claims(spark, folder))
    whole = whole.withColumn("active", F.col("active") | F.col("stale_active"))
    assert sorted(d.versions.select(columns).collect()) == sorted(whole.select(columns).collect())
    assert set(spark.table(domain._written[key]).columns) == {*domain.FACTS, "active", "replaced"}
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = scope.in_scope(d.versions, d.master)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert plan.count("Exchange hashpartitioning") == 1  # the master's


def test_versions_written_in_shares_are_the_same_and_leave_no_second_table(spark, tmp_path):
    """A table over the size of one share is made share by share: the same rows, each bucket whole, no table of facts beside it."""
    from greenlight import domain
    from greenlight.settings import Settings

    folder = "/root/testdata/sf0.001"
    before = {t.name for t in spark.catalog.listTables()}
    name = domain.write_versions(spark, folder, Settings(), str(tmp_path / "v"), small_rows=1000)
    stored = spark.table(name)
    whole = versions.recompute(domain.version_claims(spark, folder))
    whole = whole.withColumn("active", F.col("active") | F.col("stale_active"))
    columns = ["version_id", "record_id", "active", "replaced"]
    kept = domain.version_rows(stored, "active", "replaced").select(columns)
    assert sorted(kept.collect()) == sorted(whole.select(columns).collect())
    assert {t.name for t in spark.catalog.listTables()} - before == {name}
    files = [f.name for f in (tmp_path / "v").iterdir() if f.suffix == ".parquet"]
    bucket = [f.split("_")[-1].split(".")[0] for f in files]
    assert max(bucket.count(b) for b in bucket) <= 2  # one of the own records and one of the others
