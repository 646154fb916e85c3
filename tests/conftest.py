import pytest

from greenlight.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", partitions=4)
    yield session
    session.stop()


MASTER = (
    "record_id string, accept_status string, title string, authors string, notes string, decision string, "
    "exclusion_reason string, exclusion_notes string, excluded_at timestamp, created_at timestamp, updated_at timestamp"
)
VERSION = (
    "version_id string, entered_id string, record_id string, title string, authors string, upload_date timestamp, "
    "origin string, active boolean, replaced boolean, discarded boolean, discard_notes string, editor_notes string, "
    "excluded boolean, exclusion_reason string, exclusion_notes string, excluded_at timestamp, pdf_file string, "
    "source_file string, corrected_pdf string, corrected_source string, pdf_current_hash string, pdf_hash string, "
    "processing_status string, processing_message string, thumbnail_status string, thumbnail_folder string, pages int, "
    "source_hash string, source_current_hash string, format_status string, extracted_title string, "
    "extracted_authors string, title_author_source string, override_reason string, extraction_status string, "
    "review_status string, duplicate_review_status string, name_waiver_approved boolean, name_waiver_reason string, "
    "name_waiver_value int, page_waiver_approved boolean, page_waiver_reason string, page_waiver_value int, "
    "similarity decimal(5,2), single decimal(5,2), similarity_waiver_approved boolean, similarity_waiver_reason string, "
    "similarity_waiver_value decimal(5,2), single_waiver_approved boolean, single_waiver_reason string, "
    "single_waiver_value decimal(5,2), report_path string, report_stale boolean, id_verified boolean, "
    "auto_verify_blocked boolean, verification_status string, verification_message string, title_verified boolean, "
    "title_verify_blocked boolean, created_at timestamp, updated_at timestamp"
)
WAIVER = "norm string, approved boolean, reason string, approved_count int"


def _defaults(schema):
    out = {}
    for part in schema.replace("decimal(5,2)", "decimal").split(", "):
        name, kind = part.split(" ")
        out[name] = {"string": "", "boolean": False}.get(kind)
    return out


def _rows(spark, schema, rows, base):
    from datetime import datetime
    from decimal import Decimal

    defaults = {**_defaults(schema), **base}
    kinds = dict(p.split(" ") for p in schema.replace("decimal(5,2)", "decimal").split(", "))
    full = []
    for row in rows:
        merged = {**defaults, **row}
        unknown = set(merged) - set(defaults)
        assert not unknown, unknown
        values = []
        for name in defaults:
            value = merged[name]
            if kinds[name] == "decimal" and value is not None:
                value = Decimal(str(value))
            if kinds[name] == "timestamp" and isinstance(value, str):
                value = datetime.fromisoformat(value)
            values.append(value)
        full.append(tuple(values))
    return spark.createDataFrame(full, schema)


def master(spark, *rows):
    """Master rows; a row without overrides is publishing."""
    return _rows(spark, MASTER, rows, {"decision": "publishing", "title": "A Fine Title", "created_at": "2024-01-01", "updated_at": "2024-01-01"})


READY = {
    "record_id": "P1", "entered_id": "P1", "title": "A Fine Title", "upload_date": "2024-01-02", "origin": "start2", "active": True,
    "pdf_file": "a.pdf", "source_file": "a.zip", "pdf_current_hash": "h1", "pdf_hash": "h1", "processing_status": "processed",
    "thumbnail_status": "processed", "thumbnail_folder": "t", "pages": 8, "source_hash": "s1", "source_current_hash": "s1",
    "format_status": "review_ok", "extracted_title": "A Fine Title", "extracted_authors": "Ann Lee and Bo Chen", "extraction_status": "extracted",
    "title_author_source": "built_in_extractor", "review_status": "review_ok", "duplicate_review_status": "pending", "similarity": 1, "single": 1,
    "id_verified": True, "verification_status": "verified", "created_at": "2024-01-02", "updated_at": "2024-01-02",
}


def versions(spark, *rows):
    """Version rows; without overrides a version of P1 that is ready to publish."""
    return _rows(spark, VERSION, rows, READY)


def waivers(spark, *rows):
    return _rows(spark, WAIVER, rows, {})
