import json

import pytest
from pyspark.sql import functions as F

from greenlight import schema
from greenlight.operators import events
from greenlight.sources import readers, sinks
from tests.conftest import master, versions


def test_delimited_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Paper_ID, Title \nP1,Café\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("paper_id,title\nP2,Größe\n".encode("latin1"))
    (tmp_path / "c.csv").write_bytes("Submission ID,title\nP3,論文標題研究\n".encode("big5"))
    df = readers.read_delimited(spark, str(tmp_path))
    named = readers.alias_columns(df, readers.MASTER_ALIASES, required=("record_id", "title"))
    got = {r["record_id"]: r["title"] for r in named.collect()}
    assert got["P1"] == "Café" and got["P3"] == "論文標題研究" and set(got) == {"P1", "P2", "P3"}
    with pytest.raises(readers.MissingColumns, match="nope"):
        readers.alias_columns(df, readers.MASTER_ALIASES, required=("nope",))


def test_delimited_header_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("paper_id,title\nP1,One\n")
    (tmp_path / "b.csv").write_text("title,paper_id\nTwo,P2\n")
    (tmp_path / "c.csv").write_bytes("title,paper_id\r\nÉté,P3\r\n".encode("cp1252"))
    rows = readers.read_delimited(spark, str(tmp_path)).collect()
    assert sorted((r.paper_id, r.title) for r in rows) == [("P1", "One"), ("P2", "Two"), ("P3", "Été")]


def test_log_round_trip_with_bad_line(spark, tmp_path):
    lines = [
        json.dumps({"timestamp": "2024-01-01T00:00:00+00:00", "event_id": "1", "action": "verify_paper_id", "status": "success", "changed_fields": ["title"],
                    "before": {"title": "a", "x": "1"}, "after": {"title": "b", "x": "2"}, "reset_flags": {"pdf_reset": True, "source_reset": False}}),
        "not json " + "y" * 600,
        "",
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    log = events.with_action_metadata(readers.read_event_log(spark, str(tmp_path)))
    got = {r["raw_action"]: r for r in log.collect()}
    assert got["verify_paper_id"]["action"] == "paper_id_verify" and got["verify_paper_id"]["category"] == "reviews"
    bad = got["unparseable_log_line"]
    assert (bad["status"], len(bad["message"]), bad["action_label"]) == ("error", 500, "Unparseable Log Line")
    rows = {(r["kind"], r["field"], r["old"], r["new"]) for r in events.log_changes(log.filter("event_id = '1'")).collect()}
    assert rows == {("user", "title", "a", "b"), ("system", "x", "1", "2"), ("reset", "pdf_reset", "", "Yes")}
    out = tmp_path / "out"
    sinks.append_event(log.select("event_id", "action", "status"), str(out))
    sinks.append_event(log.select("event_id", "action", "status"), str(out))
    assert spark.read.text(str(out)).count() == 4


def test_csv_safe(spark, tmp_path):
    df = spark.createDataFrame([("=1", 2), ("é", 3)], "a string, b int")
    sinks.write_csv_safe(df.coalesce(1), str(tmp_path / "c"))
    raw = next((tmp_path / "c").glob("part-*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfa,b") and b"'=1,2" in raw


def test_report_is_published_last(spark, tmp_path):
    df = spark.range(5).toDF("id")
    manifest = sinks.write_report({"detail": df, "more": df.limit(2)}, str(tmp_path), "run1")
    assert [(r["sheet"], r["n_rows"]) for r in manifest.orderBy("sheet_order").collect()] == [("detail", 5), ("more", 2)]
    assert sinks.current_report(spark, str(tmp_path)) == "run1"
    with pytest.raises(sinks.ReportError):
        sinks.write_report({"a/b": df}, str(tmp_path), "run2")
    assert sinks.current_report(spark, str(tmp_path)) == "run1"


def test_snapshot_validation(spark, tmp_path):
    folder = str(tmp_path / "snap")
    settings = spark.createDataFrame([(6,)], "page_minimum int")
    m = master(spark, {"record_id": "P1"}, {"record_id": "P2"})
    sinks.snapshot_tables({"settings": settings, "master": m}, folder)
    schemas = {"settings": {"page_minimum": "int"}, "master": {"record_id": "string"}}
    assert sinks.validate_snapshot(spark, folder, schemas, {"master": schema.master_checks()}).count() == 0
    wrong = {"settings": {"page_minimum": "string"}, "master": {"nope": "int"}, "waivers": {}}
    problems = {(r["table_name"], r["problem"]) for r in sinks.validate_snapshot(spark, folder, wrong).collect()}
    assert problems == {("settings", "column page_minimum is int, not string"), ("master", "column nope is missing"), ("waivers", "table is missing")}
    m.limit(1).write.mode("overwrite").parquet(f"{folder}/master")
    assert [r["problem"] for r in sinks.validate_snapshot(spark, folder, schemas).collect()] == ["row count differs from the manifest"]
    tables = readers.load_tables(spark, folder, ["settings"])
    assert tables["settings"].first()[0] == 6


def test_inventory_and_uploads(spark, tmp_path):
    (tmp_path / "x" / "deep").mkdir(parents=True)
    (tmp_path / "x" / "deep" / "F1_file_Submit_PDF.pdf").write_bytes(b"abc")
    inventory = readers.read_file_inventory(spark, {"upload": str(tmp_path / "x")}).first()
    assert (inventory["category"], inventory["length"]) == ("upload", 3)
    sent = readers.read_upload_files(spark, str(tmp_path / "x")).first()
    assert sent["name"] == "F1_file_Submit_PDF.pdf" and sent["sha256"].startswith("ba7816bf8f01cfea")


def test_quality_checks(spark):
    m = master(spark, {"record_id": " P1"}, {"record_id": "p1", "decision": "not_publishing"}, {"record_id": "P2", "decision": "maybe"})
    got = {r["problem"]: r["n"] for r in schema.quality_report(m, schema.master_checks()).collect()}
    assert got == {"record id is blank or not trimmed": 1, "unknown decision": 1, "decision and exclusion fields disagree": 2}
    assert [r["key"] for r in schema.duplicate_master_keys(m).collect()] == ["p1"]
    v = versions(spark, {"version_id": "F1", "origin": "fax", "similarity": 101})
    bad = {r["problem"] for r in schema.quality_report(v, schema.version_checks()).filter("n > 0").collect()}
    assert bad == {"unknown origin", "similarity outside 0..100"}
    assert schema.mapped_masters(m, v).count() == 0


def test_tail_and_filter(spark):
    rows = [(f"{i}", "process_pdfs" if i % 2 else "exception_allow", "success", f"m{i}", f"2024-01-0{i}") for i in range(1, 6)]
    log = spark.createDataFrame(rows, "event_id string, action string, status string, message string, d string").withColumn("ts", F.col("d").cast("timestamp"))
    log = events.with_action_metadata(log)
    assert [r["event_id"] for r in events.tail_events(log, 2).collect()] == ["5", "4"]
    assert events.log_filter(log, action="process_pdfs").count() == 3
    assert events.log_filter(log, query="process_pdfs").count() == 3
    assert events.log_filter(log, query="ALLOW exc", category="exceptions").count() == 2
