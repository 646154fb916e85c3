import json
import random

from pyspark.sql import functions as F

from greenlight.streaming import log, stores


def event(i, ts, actor="a", action="process_pdfs"):
    return json.dumps({"event_id": str(i), "timestamp": ts, "actor": actor, "action": action, "status": "success"})


def test_log_windows_and_sessions(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "1.jsonl").write_text("\n".join([
        event(1, "2024-01-01T10:05:00+00:00"), event(1, "2024-01-01T10:05:00+00:00"), event(2, "2024-01-01T10:50:00+00:00"),
        event(3, "2024-01-01T14:00:00+00:00"), event(4, "2024-01-02T00:00:00+00:00", "b"), "broken",
    ]))
    stream = log.event_stream(spark, str(folder))
    counts = log.drain(log.event_counts(stream.filter("ts IS NOT NULL")), "t_counts", "update")
    got = {(str(r["window_start"]), r["category"]): r["n"] for r in counts.collect()}
    assert got[("2024-01-01 10:00:00", "processing")] == 3
    sessions = log.drain(log.log_sessions(log.event_stream(spark, str(folder)).filter("ts IS NOT NULL")), "t_sessions", "append")
    rows = {(r["actor"], str(r["started"])): r["n_events"] for r in sessions.collect()}
    assert rows[("a", "2024-01-01 10:05:00")] == 2 and rows[("a", "2024-01-01 14:00:00")] == 1


def test_late_editor_row_takes_over(spark, tmp_path):
    source, sink, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    schema = "version_id string, record_id string, origin string, discarded boolean, created_at timestamp"

    def add(*rows):
        spark.createDataFrame([(*r, False, None) for r in rows], schema).write.mode("append").parquet(str(source))

    def run():
        stream = log.active_stream(spark.readStream.schema(schema).parquet(str(source)))
        query = (
            stream.writeStream.outputMode("update").foreachBatch(log.upsert_sink(str(sink)))
            .option("checkpointLocation", str(check)).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return {r["record_id"]: r["version_id"] for r in log.read_upserts(spark, str(sink)).collect()}

    add(("F2", "P1", "start2"), ("F10", "P1", "start2"), ("F1", "P2", "start2"))
    assert run() == {"P1": "F10", "P2": "F1"}
    add(("F3", "P1", "editor_upload"))
    assert run() == {"P1": "F3", "P2": "F1"}


def test_alert_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(1).write.parquet(str(source))
    changes = spark.readStream.schema("id long").parquet(str(source))
    query = log.alert_stream(changes, lambda: spark.range(1).select(F.lit(3).alias("n")), str(tmp_path / "out"), "1 second")
    run = query.option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert spark.read.parquet(str(tmp_path / "out")).first()["n"] == 3


def test_version_store_retracts_and_compacts(spark, tmp_path):
    folder, rng = str(tmp_path / "store"), random.Random(4)
    stores.open_store(spark, folder)
    assert stores.active_versions(stores.read_versions(spark, folder)).count() == 0
    held = {}

    def add(*rows):
        for version, seq, discarded, origin, record in rows:
            if version is not None and (version not in held or (seq, discarded) > held[version][:2]):
                held[version] = (seq, discarded, origin, record)
        stores.feed(spark.createDataFrame([(*r, None) for r in rows], stores.STORED), folder + "/in")
        stores.keep_versions(spark.readStream.schema(stores.STORED).parquet(folder + "/in"), folder)
        best = {}
        for version, (_, discarded, origin, record) in held.items():
            rank = (origin == "editor_upload", int(version[1:]))
            if not discarded and record and rank > best.get(record, ((), ""))[0]:
                best[record] = (rank, version)
        got = {r["record_id"]: r["version_id"] for r in stores.active_versions(stores.read_versions(spark, folder)).collect()}
        assert got == {record: version for record, (_, version) in best.items()}
        return got

    assert add(("F2", 1, False, "start2", "P1"), ("F10", 1, False, "start2", "P1"), (None, 1, False, "start2", "P1"), ("F7", 1, False, "start2", "")) == {"P1": "F10"}
    assert add(("F3", 1, False, "editor_upload", "P1")) == {"P1": "F3"}
    assert stores.compact(spark, folder) == stores.compact(spark, folder) >= 1
    assert add(("F3", 2, True, "editor_upload", "P1")) == {"P1": "F10"}  # the discard gives the record back
    assert add(("F10", 3, True, "start2", "P1"), ("F10", 2, False, "start2", "P1"), ("F10", 3, True, "start2", "P1")) == {"P1": "F2"}
    assert add(("F2", 5, False, "start2", "P2"), ("F2", 4, True, "start2", "P1")) == {"P2": "F2"}  # out of order
    stores.compact(spark, folder)
    add(*[(f"F{rng.randint(1, 15)}", rng.randint(1, 9), rng.random() < 0.4, rng.choice(["start2", "editor_upload"]), "P1") for _ in range(1)])


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "store")
    stores.open_store(spark, folder)
    stores.feed(spark.createDataFrame([("F1", 1, False, "start2", "P1", None)], stores.STORED), folder + "/in")
    for checkpoint in ("one", "two"):  # without its checkpoint the stream starts anew at batch 0
        stores.keep_versions(spark.readStream.schema(stores.STORED).parquet(folder + "/in"), folder)
        (tmp_path / "store" / "checkpoint").rename(tmp_path / checkpoint)
    rows = spark.read.parquet(folder + "/batches")
    assert rows.where("batch = 0").count() == rows.count() == 1


def test_sessions_of_late_and_repeated_events(spark, tmp_path):
    folder, source = str(tmp_path / "out"), str(tmp_path / "in")
    rows = [(1, "a", "2024-01-01 10:00:00"), (2, "a", "2024-01-01 10:50:00"), (3, "b", "2024-01-01 10:55:00")]
    late = [(2, "a", "2024-01-01 10:50:00"), (4, "a", "2024-01-01 10:20:00"), (5, "a", "2024-01-01 12:45:00"), (6, "b", "2024-01-01 14:00:00")]
    too_late, end = [(7, "a", "2024-01-01 09:00:00")], [(8, "z", "2025-01-01 00:00:00")]
    for part in (rows, late, too_late, end):
        stores.feed(spark.createDataFrame(part, "event_id long, actor string, ts string"), source)
        stream = spark.readStream.schema("event_id long, actor string, ts string").parquet(source)
        stores.append_to_files(log.log_sessions(stream), folder)
    got = sorted((r["actor"], str(r["started"])[11:16], str(r["expires"])[11:16], r["n_events"]) for r in stores.appended(spark, folder).collect())
    assert got == [("a", "10:00", "14:45", 4), ("b", "10:55", "12:55", 1), ("b", "14:00", "16:00", 1)]
