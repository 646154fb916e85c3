import hashlib
import random
from datetime import datetime

from pyspark.sql import functions as F

from greenlight.functions import digest
from greenlight.operators import changes, files, resolve, results, transitions
from tests.conftest import master, versions


def test_resolution_steps(spark):
    m = master(spark, {"record_id": "R003", "title": "T one"}, {"record_id": "S3", "title": "T two"}, {"record_id": "ab-1"}, {"record_id": "AB-1"})
    v = spark.createDataFrame(
        [("1", "r003", ""), ("2", "R3", ""), ("3", "3", "T, two"), ("4", "3", "none"), ("5", "Ab-1", ""), ("6", " ", ""), ("7", "zz", "")],
        "version_id string, entered_id string, title string",
    )
    got = {r["version_id"]: (r["resolved_id"], r["step"]) for r in resolve.resolve_identifier(v, m).collect()}
    assert got == {
        "1": ("R003", "exact"), "2": ("R003", "canonical"), "3": ("S3", "number_and_title"), "4": ("3", "raw"),
        "5": ("Ab-1", "ambiguous"), "6": ("", "blank"), "7": ("zz", "raw"),
    }


def test_upsert_keeps_ungiven_columns_and_writes_nulls(spark):
    t = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "k string, v string, w string")
    c = spark.createDataFrame([("b", None), ("c", "3")], "k string, v string")
    got = sorted(tuple(r) for r in changes.upsert(t, c, ["k"]).collect())
    assert got == [("a", "1", "x"), ("b", None, "y"), ("c", "3", None)]


def test_master_import_reports_case_collisions(spark):
    m = master(spark, {"record_id": "P1"}, {"record_id": "Q1"}, {"record_id": "q1"})
    new = spark.createDataFrame(
        [(2, "p1 ", "", "A Fine Title", "", ""), (3, "P1", "", "x", "", ""), (4, "Q1", "", "x", "", ""), (5, "N1", "", "x", "", "")],
        "row_no long, record_id string, accept_status string, title string, authors string, notes string",
    )
    v = versions(spark, {"version_id": "F1", "record_id": "N1", "excluded": True})
    got = {r["row_no"]: r for r in changes.diff_master(new, m, v).collect()}
    assert (got[2]["record_id"], got[2]["status"]) == ("P1", "unchanged")
    assert got[3]["status"] == "error" and "rows 2 and 3" in got[3]["error"]
    assert got[4]["status"] == "error" and "capitalization" in got[4]["error"]
    assert (got[5]["status"], got[5]["decision_required"], got[5]["n_excluded"]) == ("new", True, 1)


def test_next_ids_fill_the_first_gap(spark):
    used = spark.createDataFrame([("B-001",), ("B-002",), ("B-004",), ("C-002",), ("D-1",), ("E-001",), ("E-0002",)], "version_id string")
    bases = spark.createDataFrame([("B",), ("C",), ("D",), ("E",)], "base string")
    got = {r["base"]: r["next_id"] for r in transitions.next_sequence_ids(bases, used).collect()}
    assert got == {"B": "B-003", "C": "C-001", "D": "D-001", "E": "E-002"}


def test_stale_action_is_refused(spark):
    now = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    seen = spark.createDataFrame([("a", 1), ("b", 9), ("c", 1)], "k string, x int")
    actions = seen.select("k", digest.row_digest(["k", "x"]).alias("seen_digest"))
    got = {r["k"]: r["reason"] for r in changes.stale_check(actions, now, "k", ["k", "x"]).collect()}
    assert got == {"a": "", "b": "stale", "c": "missing"}


def test_digest_is_order_free_and_sees_changes(spark):
    a = spark.createDataFrame([("a", 1), ("b", None), ("b", None)], "k string, x int")
    b = spark.createDataFrame([("b", None), ("a", 1), ("b", None)], "k string, x int")
    c = spark.createDataFrame([("b", None), ("a", 1)], "k string, x int")
    digest.assert_unchanged(digest.table_digest(a), digest.table_digest(b))
    try:
        digest.assert_unchanged(digest.table_digest(a), digest.table_digest(c))
    except digest.ChangedBasis:
        pass
    else:
        raise AssertionError("a lost duplicate must be seen")


def test_batch_results(spark):
    m = master(spark, {"record_id": "P1"}, {"record_id": "P2"}, {"record_id": "P3"}, {"record_id": "P4"})
    v = versions(
        spark, {"version_id": "F1", "report_path": "r.pdf"}, {"version_id": "F2", "record_id": "P2", "active": False},
        {"version_id": "F3", "record_id": "P3", "pdf_current_hash": "other"}, {"version_id": "F4", "record_id": "P4"},
    )
    prov = spark.createDataFrame(
        [("T", "all", "P1", "F1", "H1"), ("T", "missing_results", "P1", "F1", "h1"), ("T", "all", "P2", "F2", "h1"), ("T", "all", "P3", "F3", "h1"),
         ("T", "all", "P4", "F4", "h1"), ("T", "missing_results", "P4", "F9", "h1"), ("U", "all", "P1", "F1", "")],
        "token string, scope string, record_id string, version_id string, sha256 string",
    )
    rows = spark.createDataFrame(
        [(2, "P1_T.pdf", "<1", "2.5%"), (3, "P2_T.pdf", "1", "1"), (4, "P3_T.pdf", "1", "1"), (5, "P4_T.pdf", "1", "1"), (6, "P1_X.pdf", "1", "1"),
         (7, "P9.pdf", "1", "1"), (8, "P1_U.pdf", "1", "1"), (9, "P1_a b.pdf", "1", "1"), (10, "P7_T.pdf", "", ""), (11, "P7_T.pdf", "", "")],
        "row_no long, filename string, plagiarism_percent string, single_percent string",
    )
    got = {r["row_no"]: r for r in results.apply_batch_scores(rows, prov, v, m).collect()}
    assert got[2]["disposition"] == "updated" and (int(got[2]["similarity"]), int(got[2]["single"])) == (1, 3)
    assert got[2]["report_stale"] is True
    assert [got[i]["reason"] for i in (3, 4, 5, 6, 8)] == [results.NOT_CURRENT, results.CHANGED, results.SEVERAL, results.NO_PROVENANCE, results.UNBOUND]
    assert all(got[i]["disposition"] == "stale" for i in (3, 4, 5, 6, 8))
    assert got[9]["disposition"] == "unmatched"
    assert {got[i]["disposition"] for i in (7, 10, 11)} == {"invalid"}


def test_external_scores(spark):
    m = master(spark, {"record_id": "P1"}, {"record_id": "P2"})
    v = versions(spark, {"version_id": "F1", "report_path": "r"}, {"version_id": "F2", "record_id": "P2"}, {"version_id": "F3", "record_id": "P2"})
    rows = spark.createDataFrame(
        [(2, "F1", "", "40.5"), (3, "gone", "P1", "1"), (4, "", "P2", "1"), (5, "", "P9", "1")],
        "row_no long, version_id string, record_id string, similarity string",
    )
    out = results.apply_scores(rows, v, m)
    got = {r["row_no"]: (r["disposition"], r["report_stale"]) for r in out.collect()}
    assert got == {2: ("updated", True), 3: ("unmatched", None), 4: ("ambiguous", None), 5: ("unmatched", None)}
    after = results.write_scores(v, out).filter("version_id = 'F1'").first()
    assert (int(after["similarity"]), int(after["single"]), after["report_stale"]) == (41, 1, True)


def test_a_score_file_with_two_rows_for_a_version_is_refused(spark):
    m = master(spark, {"record_id": "P1"}, {"record_id": "P2"})
    v = versions(spark, {"version_id": "F1"}, {"version_id": "F2", "record_id": "P2"})
    rows = spark.createDataFrame(
        [(2, "F1", "", "40"), (3, "", "P2", "50"), (4, "", "P1", "60"), (5, "gone", "", "1")], "row_no long, version_id string, record_id string, similarity string"
    )
    out = results.apply_scores(rows, v, m)
    assert {r["row_no"]: r["disposition"] for r in out.collect()} == {2: "duplicate", 3: "refused", 4: "duplicate", 5: "unmatched"}
    assert results.write_scores(v, out).exceptAll(v).count() == 0
    none = results.apply_scores(rows.limit(0), v, m)
    assert none.count() == 0 and results.write_scores(v, none).exceptAll(v).count() == 0


def test_reports_that_come_twice_are_invalid_before_they_are_looked_up(spark):
    m = master(spark, {"record_id": "P1"}, {"record_id": "P2"})
    v = versions(spark, {"version_id": "F1"}, {"version_id": "F2", "record_id": "P2"})
    prov = spark.createDataFrame(
        [("T", "all", "P1", "F1", "h1"), ("U", "all", "P1", "F1", "h1"), ("T", "all", "P2", "F2", "h1")], "token string, scope string, record_id string, version_id string, sha256 string"
    )
    names = ["P1_T.pdf", "P1_U.pdf", "P2_T.pdf", "P2_T.docx", "P9_X.pdf", "P9_X.PDF", "P9_Y.pdf", "P2.pdf"]
    files_in = spark.createDataFrame([(k, n, f"in/{n}") for k, n in enumerate(names)], "row_no long, filename string, path string")
    got = {names[r["row_no"]]: (r["disposition"], r["reason"], r["version_id"]) for r in results.apply_batch_reports(files_in, prov, v, m).collect()}
    several, repeated = "Several reports for one version.", results.REPEATED
    assert got["P1_T.pdf"] == got["P1_U.pdf"] == ("invalid", several, None)
    assert got["P2_T.pdf"] == ("updated", "", "F2") and got["P2_T.docx"] == ("invalid", results.NOT_PDF, None)
    assert got["P9_X.pdf"] == got["P9_X.PDF"] == ("invalid", repeated, None)
    assert got["P9_Y.pdf"][0] == "stale" and got["P2.pdf"][0] == "invalid"


def test_manual_and_imported_author_edits_differ(spark):
    v = versions(spark, {"version_id": "F1", "duplicate_review_status": "review_ok", "name_waiver_approved": True})
    edits = spark.createDataFrame([("F1", ["authors"], "New")], "version_id string, changed_fields array<string>, new_authors string")
    manual = transitions.apply_edits(v, edits).first()
    assert (manual["authors"], manual["review_status"], manual["duplicate_review_status"], manual["name_waiver_approved"]) == ("New", "pending", "pending", False)
    imported = changes.reset_dependents(v, {"authors": F.lit(True)}).first()
    assert (imported["review_status"], imported["duplicate_review_status"], imported["name_waiver_approved"]) == ("pending", "review_ok", True)


def test_measurements(spark):
    v = versions(
        spark, {"version_id": "same"}, {"version_id": "changed", "page_waiver_approved": True}, {"version_id": "fresh", "pdf_hash": "", "pages": None, "processing_status": "pending"}, {"version_id": "none"},
    )
    measured = spark.createDataFrame([("same", "h1", 8), ("changed", "h2", 9), ("fresh", "h1", 7)], "version_id string, sha256 string, pages int")
    got = {r["version_id"]: r for r in transitions.apply_measurements(v, measured).collect()}
    assert {k: r["disposition"] for k, r in got.items()} == {"same": "skipped", "changed": "integrity_reset", "fresh": "processed", "none": "error"}
    assert got["changed"]["review_status"] == "pending" and got["changed"]["pages"] == 9 and not got["changed"]["page_waiver_approved"]
    assert got["fresh"]["processing_status"] == "processed" and got["none"]["processing_status"] == "error"


def test_guard_review(spark):
    v = versions(
        spark, {"version_id": "ok", "title_verified": True}, {"version_id": "no_names", "extracted_authors": " ", "duplicate_review_status": "review_ok"},
        {"version_id": "far", "extracted_title": "Something else", "title_verified": True},
    )
    got = {r["version_id"]: r for r in transitions.guard_review(v).collect()}
    assert not got["ok"]["guarded"] and got["ok"]["title_verified"]
    assert (got["no_names"]["review_status"], got["no_names"]["duplicate_review_status"]) == ("pending", "pending")
    assert got["far"]["guarded"] and not got["far"]["title_verified"]


def test_master_edit_resets_identity(spark):
    m, v = master(spark, {"record_id": "P1"}, {"record_id": "P2"}), versions(spark, {"version_id": "F1"}, {"version_id": "F2", "record_id": "P2"})
    edits = spark.createDataFrame([("P1", "New Title"), ("P2", "A Fine Title")], "record_id string, title string")
    new_m, new_v, counts = transitions.apply_master_edits(m, v, edits)
    assert {r["record_id"]: r["title"] for r in new_m.collect()} == {"P1": "New Title", "P2": "A Fine Title"}
    assert {r["version_id"]: r["id_verified"] for r in new_v.collect()} == {"F1": False, "F2": True}
    assert [(r["record_id"], r["n_affected"]) for r in counts.collect()] == [("P1", 1)]


def test_uploaded_files(spark):
    names = ["F1_file_Submit_PDF.pdf", "F1_file_Submit_PDF.docx", "F1_file_Submit_Source.zip", "x.pdf", "F2_file_Submit_PDF.pdf"]
    listing = spark.createDataFrame([(n, f"s-{n}") for n in names], "name string, sha256 string")
    index = files.uploaded_files(listing)
    got = {r["name"]: (r["kind"], r["status"]) for r in index.collect()}
    assert got == {
        names[0]: ("pdf", "ok"), names[1]: ("source", "ambiguous"), names[2]: ("source", "ambiguous"), "x.pdf": ("", "invalid"), names[4]: ("pdf", "ok"),
    }
    lookup = {r["version_id"]: (r["upload_pdf_hash"], r["upload_source_hash"]) for r in files.upload_lookup(index).collect()}
    assert lookup == {"F1": (f"s-{names[0]}", None), "F2": (f"s-{names[4]}", None)}


def test_hashes_are_reused_by_signature(spark):
    at = datetime(2024, 1, 1)
    schema = "path string, length long, modified timestamp, content binary"
    listed = spark.createDataFrame([("a", 1, at, b"a"), ("b", 1, at, b"b"), ("c", 2, at, b"cc")], schema)
    known = spark.createDataFrame([("a", 1, at, "kept"), ("b", 9, at, "old"), ("z", 1, at, "gone")], "path string, length long, modified timestamp, sha256 string")
    got = {r["path"]: r["sha256"] for r in files.hash_contents(listed, known).collect()}
    assert got["a"] == "kept" and got["b"].startswith("3e23e8160039594a") and set(got) == {"a", "b", "c"}


def test_references(spark):
    listed = spark.createDataFrame([("r/a/x",), ("r/a/y",), ("r/b/z",), ("r/ab",)], "path string")
    refs = spark.createDataFrame([("tree", "r/a"), ("file", "r/b/z"), ("file", "r/gone")], "kind string, path string")
    assert [r["path"] for r in files.unreferenced_files(listed, refs).collect()] == ["r/ab"]
    assert [r["path"] for r in files.missing_references(refs.filter("kind = 'file'"), listed).collect()] == ["r/gone"]


def test_covered_paths_equal_a_prefix_test(spark):
    rng = random.Random(3)
    part = lambda: rng.choice(["a", "b", "a-b", "a b", "é", "aa", "."])
    paths = sorted({"/".join(part() for _ in range(rng.randint(1, 5))) for _ in range(400)} | {"/abs/a", "a" * 3000 + "/b"})
    for trees in (["a/b", "a", "b/a-b/", "aa/aa/aa", "/abs", "é/é", "a" * 3000], ["a/b/a", "a-b"], [""], []):
        want = [p for p in paths if any(t and (p + "/").startswith(t.rstrip("/") + "/") for t in trees)]
        found = files.covered_paths(
            spark.createDataFrame([(p, 1) for p in paths + paths[:5]], "path string, end int"), spark.createDataFrame([(t,) for t in trees + trees[:1]], "path string").repartition(3)
        )
        assert sorted(r["path"] for r in found.collect()) == want


def test_only_new_files_are_read(spark, tmp_path):
    store = tmp_path / "store"
    (store / "sub folder").mkdir(parents=True)
    contents = {"a.pdf": b"alpha", "sub folder/b%20c.zip": bytes(range(256)) * 5000, "old": b"old", "sub folder/é.pdf": b"e"}
    for name, data in contents.items():
        (store / name).write_bytes(data)
    listed = files.list_files(spark, str(store))
    assert "content" not in listed.columns
    none = spark.createDataFrame([], files.HASHED)
    first = files.hash_files(listed, none, chunk=1000)
    first.write.parquet(str(tmp_path / "first"))
    first = spark.read.parquet(str(tmp_path / "first"))
    digests = sorted(hashlib.sha256(data).hexdigest() for data in contents.values())
    assert sorted(r["sha256"] for r in first.collect()) == digests
    assert {r["bytes_read"] == r["length"] and r["error"] is None for r in first.collect()} == {True}
    (store / "a.pdf").write_bytes(b"beta and more")
    (store / "new.pdf").write_bytes(b"new")
    (store / "old").unlink()
    second = files.hash_files(files.list_files(spark, str(store)), first).collect()
    assert sum(r["bytes_read"] for r in second) == len(b"beta and more") + len(b"new")
    assert len(second) == 5 - 1 and hashlib.sha256(b"old").hexdigest() not in {r["sha256"] for r in second}


def test_a_file_that_is_gone_is_a_row_with_its_error(spark, tmp_path):
    at = datetime(2024, 1, 1)
    listed = spark.createDataFrame([(f"file:{tmp_path}/gone.pdf", 3, at)] * 2, "path string, length long, modified timestamp")
    known = listed.selectExpr("*", "cast(null as string) AS sha256", "0L AS bytes_read", "'gone' AS error")
    rows = files.hash_files(listed, known).collect()
    assert [(r["sha256"], r["bytes_read"]) for r in rows] == [(None, 0)] and rows[0]["error"]


def test_unreferenced_files_keep_their_rows_and_are_held_once(spark):
    """Repeated rows, rows without a path and all columns stay; the rows pass one exact lookup and one order, not a second join."""
    listed = spark.createDataFrame([("a/x", 1), ("a/x", 2), ("a/b/y", 3), ("ab", 4), (None, 5), ("z", 6)], "path string, length int")
    refs = spark.createDataFrame([("file", "z"), ("tree", "a/b"), ("tree", "")], "kind string, path string")
    out = files.unreferenced_files(listed, refs)
    assert sorted(out.collect(), key=lambda r: r["length"]) == [("a/x", 1), ("a/x", 2), ("ab", 4), (None, 5)]
    assert "LeftAnti" not in out._jdf.queryExecution().executedPlan().toString()


def test_base_names_go_with_file_name_keys_only(spark):
    """The message names the first version's file name; no other kind's row carries it."""
    from greenlight.operators import duplicates
    from greenlight.settings import Settings

    text = {"pdf_file": "a.pdf", "corrected_pdf": "", "processing_status": "processed", "thumbnail_status": "processed", "thumbnail_folder": "t", "pdf_hash": "h",
            "source_file": "", "corrected_source": "", "format_status": "review_ok", "source_hash": "", "extracted_title": "One Title"}
    scoped = spark.createDataFrame([{**text, "version_id": v, "record_id": "P1", "pages": 3} for v in ("F1", "F2")])
    members = duplicates.member_keys(scoped, Settings())
    assert members.where("(kind = 'filename') = (base_name IS NULL)").count() == 0
    name = members.where("kind = 'filename'").first()["base_name"]
    told = duplicates.duplicate_findings(members).where("category = 'Duplicate Publication Filename'").collect()
    assert len(told) == 2 and all(f'"{name}"' in r["message"] for r in told)


def test_a_refused_version_file_meets_no_table(spark):
    """The file is judged by its own keys: the result is the table as it is read, without a join or a shuffle."""
    m, v = master(spark, {"record_id": "P1"}), versions(spark, {"version_id": "F1"}, {"version_id": "F2"})
    rows = [(1, "F1", "P1", "New", "", None), (2, "F1", "P1", "New", "", None)]
    new = spark.createDataFrame(rows, "row_no long, version_id string, entered_id string, title string, authors string, upload_date timestamp")
    out = transitions.apply_versions(v, m, changes.diff_versions(new, v, m))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert sorted((r["version_id"], r["title"], r["active"]) for r in out.collect()) == [("F1", "A Fine Title", True), ("F2", "A Fine Title", True)]
    once = transitions.apply_versions(v, m, changes.diff_versions(new, v, m).filter("status <> 'error'"))
    assert sorted((r["version_id"], r["title"]) for r in once.collect()) == [("F1", "New"), ("F2", "A Fine Title")]
