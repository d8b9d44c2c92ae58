import hashlib

import pytest

from slotwise.llm import warc
from slotwise.llm.storage import open_for_ranges
from slotwise.session import shared_folder

LONG = "<p>é" + "x" * 200


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (5, "http://a/1", LONG, "z"), (3, "http://a/2", LONG, "z"), (9, None, LONG, "z"), (None, "http://n/", LONG, "z"), (3, "http://a/2", LONG, "z"),
        (1, "http://b/\r\nx%", "short", "z"), (2, "http://b/2", "short", "z"), (4, "http://c/", None, "z"), (6, "http://c/", "", "z"), (7, "u", "y" * 3_000_000, "z"),
        (None, "v", "only null ids " * 20, "z"), (None, "v", "only null ids " * 20, "z"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_records_and_revisits(pages):
    got = sorted(((r.page_id or -1), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.report(pages).collect())
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(3, LONG), (3, LONG), (1, "short"), (2, "short"), (4, ""), (6, ""), (7, "y" * 3_000_000)] + [(-1, "only null ids " * 20)] * 2
    want = [(i, len(t.encode()), digest(t), "response", 0) for i, t in want] + [(i, len(LONG.encode()), digest(LONG), "revisit", 3) for i in (5, 9, -1)]
    assert got == sorted(want)


def test_round_trip_and_random_access(spark, pages, monkeypatch):
    index = warc.write_archives(pages, shared_folder(spark, "test-warc"))
    records = {r.record_id: r for r in warc.read_bundles(index).collect()}
    assert len(records) == pages.count() and {r.url for r in records.values()} == {r.url for r in pages.collect()}
    assert {bytes(r.payload).decode() for r in records.values() if r.record_type == "response"} == {p.html or "" for p in pages.collect()}
    wanted = index.where("page_id in (7, 5)")
    assert {r.record_id: r for r in warc.read_records(index, wanted).collect()} == {r.record_id: records[r.record_id] for r in wanted.collect()}


def test_bundles_are_independent_frames_with_a_seek_table(spark, pages):
    import zstandard

    index = warc.write_archives(pages.coalesce(1), shared_folder(spark, "test-warc"))
    [uri] = {r.bundle for r in index.collect()}
    with open_for_ranges(uri) as file:
        frames = warc.seek_table(file)
        parts = [warc.frame_bytes(file, frames, k) for k in range(len(frames))]
        whole = file.read_at(file.size(), 0)
    assert len(frames) > 1 and [len(p) for p in parts] == [f[2] for f in frames]
    # a plain decoder reads the frames one after the other and skips the table
    reader = zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True)
    assert reader.read() == b"".join(parts)
    for r in index.collect():
        headers, _, _ = warc.parse(parts[r.frame], r.offset)
        assert headers["WARC-Record-ID"] == f"<{r.record_id}>"


def test_no_pages(pages):
    assert warc.report(pages.where("false")).count() == 0


def test_a_changed_payload_is_noticed():
    data = warc.record("urn:x", 1, "u", b"abc", hashlib.sha256(b"abd").hexdigest(), None)
    with pytest.raises(ValueError):
        warc.row_of(*warc.parse(data, 0)[:2])
