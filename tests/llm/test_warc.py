import base64
import gzip
import hashlib
import io

import pytest

from greenlight.llm import warc

PAGES = [
    (3, "http://a/x", "<p>same</p>"), (1, "http://a/y", "<p>same</p>"), (2, None, "<p>other é</p>"), (4, "u", None), (5, "u\nbreak", ""),
    (None, "n", "<p>same</p>"), (6, "http://big", "b" * 300_000), (7, "v", "\r\n\r\nWARC/1.1\r\n\r\n"), (1, "again", "<p>same</p>"), (None, "only", "lonely"),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    rows = warc.round_trip(pages, f"file://{tmp_path}").collect()
    first = {}
    for p, _, h in PAGES:
        if p is not None:
            first[digest(h)] = min(p, first.get(digest(h), p))
    want = []
    for p, _, h in PAGES:
        f = first.get(digest(h))
        revisit = f is not None and p != f
        want.append((str(p), len((h or "").encode()), digest(h), "revisit" if revisit else "response", str(f if revisit else None), True))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to), r.valid) for r in rows) == sorted(want)


def test_small_payloads_are_not_revisited(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = warc.round_trip(pages, f"file://{tmp_path}", min_revisit_bytes=100).collect()
    assert len(rows) == len(PAGES) and {r.record_type for r in rows} == {"response"}


def test_files_are_gzip_members_of_bounded_size(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=200).collect()
    assert sum(m.records for m in manifest) == len(PAGES) and len(manifest) > 1
    for m in manifest:
        with open(m.path, "rb") as f:
            assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\n")


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_reader_streams_and_marks_damage(chunk):
    good = [warc.encode_record(k, "u", b"x" * k * 10, None, False) for k in range(1, 6)]
    assert [r["page_id"] for r in warc.read_file(io.BytesIO(b"".join(good)), chunk)] == [1, 2, 3, 4, 5]
    lied = gzip.decompress(good[1]).replace(b"xxxx", b"yyyy")
    rows = list(warc.read_file(io.BytesIO(good[0] + gzip.compress(lied) + good[2]), chunk))
    assert [r["valid"] for r in rows] == [True, False, True]
    rows = list(warc.read_file(io.BytesIO(good[0] + good[1][:-9]), chunk))
    assert [r["valid"] for r in rows] == [True, False]


def test_empty(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}").count() == 0
