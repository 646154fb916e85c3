from greenlight import Settings
from greenlight.operators import exceptions, names, rules, scope
from greenlight.plans import reports
from tests.conftest import master, versions, waivers

S = Settings()


def categories(spark, *overrides, masters=({"record_id": "P1"},), waiver_rows=(), allowed=False):
    m = master(spark, *masters)
    v = versions(spark, *[{"version_id": f"F{i}", **o} for i, o in enumerate(overrides)])
    found = rules.readiness_findings(m, v, waivers(spark, *waiver_rows), S, include_allowed=allowed)
    return sorted(r["category"] for r in found.collect())


def test_a_ready_record_has_no_findings(spark):
    assert categories(spark, {}) == []


CASES = [
        ({"pages": 13}, ["Page Limit Exceeded"]),
        ({"pages": 5}, ["Below Page Minimum"]),
        ({"pages": 0}, []),
        ({"pages": 13, "page_waiver_approved": True, "page_waiver_reason": "ok", "page_waiver_value": 13}, []),
        ({"pages": 13, "page_waiver_approved": True, "page_waiver_reason": " ", "page_waiver_value": 13}, ["Page Limit Exceeded"]),
        ({"pages": 13, "page_waiver_approved": True, "page_waiver_reason": "ok", "page_waiver_value": 14}, ["Page Limit Exceeded"]),
        ({"pdf_current_hash": None}, ["Missing PDF"]),
        ({"corrected_pdf": "c.pdf", "pdf_current_hash": None}, ["Missing Corrected PDF"]),
        ({"corrected_pdf": "c.pdf", "pdf_current_hash": "h2"}, ["Corrected PDF Not Processed", "PDF Not Processed"]),
        ({"source_current_hash": None}, ["Missing Source File"]),
        ({"source_hash": ""}, ["Source Review Hash Missing"]),
        ({"source_current_hash": "s2"}, ["Source Changed After Review"]),
        ({"processing_status": "error"}, ["PDF Not Processed", "PDF Processing Error"]),
        ({"extracted_title": ""}, ["Missing Extracted Title"]),
        ({"extracted_authors": ""}, ["Missing Extracted Authors"]),
        ({"extracted_authors": "A, a., B"}, ["Duplicate Author In Paper"]),
        ({"extracted_authors": "A, a., B", "duplicate_review_status": "review_ok"}, []),
        ({"extracted_authors": "A, B, C, D, E, F"}, ["Author Over Limit"]),
        ({"review_status": "red_flag"}, ["Title/Author Red Flag"]),
        ({"review_status": "pending"}, ["Unverified Title/Author Extraction"]),
        ({"format_status": "pending"}, ["Formatting Not Review OK"]),
        ({"similarity": None}, ["Missing Plagiarism Result"]),
        ({"report_stale": True}, ["Stale Plagiarism Report"]),
        ({"similarity": 36}, ["Plagiarism % Over Threshold"]),
        ({"similarity": 36, "similarity_waiver_approved": True, "similarity_waiver_reason": "ok", "similarity_waiver_value": 35}, ["Stale Plagiarism % Exception"]),
        ({"similarity": 36, "similarity_waiver_approved": True, "similarity_waiver_reason": "ok", "similarity_waiver_value": 36}, []),
        ({"single": 11}, ["Single % Over Threshold"]),
        ({"title": "Other", "id_verified": False}, ["Final Title / Paper Master Title Mismatch", "Unverified Paper ID"]),
        ({"title": "a FINE title {i}!", "id_verified": False}, []),
        ({"id_verified": False, "auto_verify_blocked": True}, ["Unverified Paper ID"]),
        ({"excluded": True}, ["Publication Decision Integrity Conflict"]),
        ({"active": False}, ["Missing Final Submission"]),
    ]


def test_one_change_breaks_one_rule(spark):
    """Every case is a record of its own, so all of them are judged in one run."""
    masters, rows = [], []
    for i, (change, _) in enumerate(CASES):
        own = {
            "version_id": f"F{i}", "record_id": f"P{i}", "title": f"A Fine Title {i}", "extracted_title": f"{i} A Fine Title",
            "extracted_authors": f"Ann{i} Lee and Bo{i} Chen", "pdf_hash": f"h{i}", "pdf_current_hash": f"h{i}",
            "source_hash": f"s{i}", "source_current_hash": f"s{i}",
        }
        change = {k: x.replace("{i}", str(i)) if isinstance(x, str) else x for k, x in change.items()}
        masters.append({"record_id": f"P{i}", "title": f"A Fine Title {i}"})
        rows.append({**own, **change})
    found = rules.readiness_findings(master(spark, *masters), versions(spark, *rows), waivers(spark), Settings(name_record_limit=9))
    got = {}
    for r in found.collect():
        got.setdefault(r["record_id"], []).append(r["category"])
    for i, (change, expected) in enumerate(CASES):
        assert sorted(got.get(f"P{i}", [])) == sorted(expected), change


def test_duplicates_are_compact(spark):
    m = master(spark, {"record_id": "P1"}, {"record_id": "P2"}, {"record_id": "P3"})
    v = versions(spark, *[{"version_id": f"F{i}", "record_id": f"P{i}", "pdf_hash": f"h{i}", "pdf_current_hash": f"h{i}", "source_hash": f"s{i}", "source_current_hash": f"s{i}"} for i in (1, 2, 3)])
    found = rules.readiness_findings(m, v, waivers(spark), S).filter("category LIKE 'Duplicate%'").collect()
    assert sorted({r["category"] for r in found}) == ["Duplicate Publication Title"]
    assert {r["message"] for r in found} == {"Duplicate title with 2 other publication records. Key: a fine title."}


def test_name_limit_and_waiver(spark):
    masters = [{"record_id": f"P{i}", "title": f"T{i}"} for i in range(5)]
    rows = [
        {"record_id": f"P{i}", "title": f"T{i}", "extracted_title": f"T{i}", "extracted_authors": "Ann Lee" if i < 4 else "Bo", "pdf_hash": f"h{i}",
         "pdf_current_hash": f"h{i}", "source_hash": f"s{i}", "source_current_hash": f"s{i}"}
        for i in range(5)
    ]
    assert categories(spark, *rows, masters=masters) == ["Author Over Limit"]
    ok = [{"norm": "ann lee", "approved": True, "reason": "chair", "approved_count": 4}]
    assert categories(spark, *rows, masters=masters, waiver_rows=ok) == []
    assert categories(spark, *rows, masters=masters, waiver_rows=ok, allowed=True) == ["Allowed Author Paper Count Exception"]


def test_readiness_needs_a_master(spark):
    m, v = master(spark), versions(spark)
    row = rules.readiness(rules.readiness_findings(m, v, waivers(spark), S), m).first()
    assert (row["ready"], row["n_blocking"]) == (False, 1)


def test_findings_are_annotated(spark):
    m, v = master(spark, {"record_id": "P1"}), versions(spark, {"version_id": "F0", "pages": 13, "discarded": False})
    row = rules.error_findings(m, v, waivers(spark), S).first()
    assert (row["group"], row["severity"], row["level"]) == ("Files / PDF Processing", "critical", "warning")


def test_extension_point(spark):
    @rules.register
    def extra(s):
        from pyspark.sql import functions as F

        return [rules.Rule("Custom", F.col("pages") == 8, F.lit("eight"))]

    try:
        assert categories(spark, {}) == ["Custom"]
        m, v = master(spark, {"record_id": "P1"}), versions(spark, {"version_id": "F0"})
        assert rules.error_findings(m, v, waivers(spark), S).first()["group"] == "Other"
    finally:
        rules._ROW_RULES.remove(extra)


def test_exception_actions(spark):
    m, v = master(spark, {"record_id": "P1"}), versions(spark, {"version_id": "F1", "pages": 13, "similarity": 36, "similarity_waiver_approved": True, "similarity_waiver_reason": "r", "similarity_waiver_value": 35})
    counts = names.name_counts(scope.in_scope(v, m), waivers(spark), S)
    rows = exceptions.exception_rows(scope.publishable(v, m), counts, S)
    actions = spark.createDataFrame(
        [("page:F1", "approve", "survey"), ("page:F1", "reapprove", "x"), ("plagiarism_percent:F1", "reapprove", " "), ("plagiarism_percent:F1", "remove", ""), ("gone", "approve", "x")],
        "exception_key string, action string, reason string",
    )
    got = {(r["exception_key"], r["action"]): (r["accepted"], r["waiver_value"]) for r in exceptions.exception_actions(rows, actions).collect()}
    assert got[("page:F1", "approve")] == (True, 13.0)
    assert got[("page:F1", "reapprove")] == (False, None)
    assert got[("plagiarism_percent:F1", "reapprove")] == (False, None)
    assert got[("plagiarism_percent:F1", "remove")] == (True, None)
    assert got[("gone", "approve")] == (False, None)


def test_record_detail(spark):
    m = master(spark, {"record_id": "P1"}, {"record_id": "P2"})
    v = versions(spark, {"version_id": "F1"}, {"version_id": "F2", "record_id": "P2", "pages": 20, "pdf_hash": "h2", "pdf_current_hash": "h2", "source_hash": "s2", "source_current_hash": "s2", "extracted_title": "Else"})
    got = {r["record_id"]: r for r in reports.record_detail(m, v, waivers(spark), S).collect()}
    assert got["P1"]["readiness"] == "Ready" and got["P1"]["comparison"] == "All titles match"
    assert got["P2"]["readiness"] == "Not ready"
    assert (got["P2"]["n_blocking"], got["P2"]["n_exceptions"], got["P1"]["n_blocking"]) == (1, 1, 0)
    lines = {(r["record_id"], r["kind"]): r["text"] for r in reports.record_lines(m, v, waivers(spark), S).collect()}
    assert lines[("P2", "blocking")] == "Page Limit Exceeded: 20 pages, over the limit of 12."
    assert lines[("P2", "exception")] == "Page count: Not allowed - current 20 - 6-12 pages"


def test_lines_of_a_record_with_several_versions(spark):
    """A record of several active versions shows none of them in its row, and all of them and their messages as lines."""
    m = master(spark, {"record_id": "P1"})
    v = versions(spark, {"version_id": "F1", "pages": 20}, {"version_id": "F2", "pages": 21}, {"version_id": "F9", "record_id": "gone"})
    row = reports.record_detail(m, v, waivers(spark), S).first()
    lines = reports.record_lines(m, v, waivers(spark), S).collect()
    assert (row["version_id"], row["n_active"], row["readiness"]) == ("", 2, "Not ready")
    assert sorted(r["text"] for r in lines if r["kind"] == "version") == ["F1", "F2"]
    assert {r["text"] for r in lines if r["kind"] == "exception" and r["text"].startswith("Page count")} == {f"Page count: Not allowed - current {n} - 6-12 pages" for n in (20, 21)}
    assert row["n_exceptions"] == sum(r["kind"] == "exception" for r in lines) and row["n_blocking"] == sum(r["kind"] == "blocking" for r in lines) > 2


def test_detail_and_manifest_name_every_exception_and_blocker(spark):
    """Also of a record with several active versions, whose messages are all in its row."""
    m = master(spark, {"record_id": "P1"}, {"record_id": "P2"})
    v = versions(spark, {"version_id": "F1", "pages": 20}, {"version_id": "F2", "pages": 21}, {"version_id": "F3", "record_id": "P2", "title": "Else"})
    got = {r["record_id"]: r for r in reports.record_detail(m, v, waivers(spark), S).collect()}
    assert got["P1"]["exceptions"] == "\n\n".join(f"Page count: Not allowed - current {n} - 6-12 pages" for n in (20, 21))
    lines = reports.record_lines(m, v, waivers(spark), S).filter("record_id = 'P1' AND kind = 'blocking'").orderBy("sort_1", "sort_2").collect()
    assert got["P1"]["blocking"].split("\n") == [r["text"] for r in lines] and len(lines) > 3
    assert (got["P2"]["exceptions"], got["P2"]["n_exceptions"]) == ("", 0)
    sheet = {r["record_id"]: r["exceptions"] for r in reports.manifest(m, v, waivers(spark), S).collect()}
    assert sheet == {"P1": got["P1"]["exceptions"], "P2": ""}
