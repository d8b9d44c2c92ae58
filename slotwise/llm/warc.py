"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``FRAME_BYTES``; a bundle ends with a
skippable frame that holds the seek table (compressed and original size of every frame). The index
maps each record identifier to (bundle, frame, offset inside the original bytes of the frame,
length), so one record costs one ranged read and one frame. ``read_bundles`` reads whole archives
by their seek tables, ``read_records`` only the frames that chosen identifiers point to.

Payloads of at least ``REVISIT_BYTES`` that occur more than once are stored once: the record with
the smallest page_id is the response, the others are revisits that name it. The decision joins each
record with the few digests that repeat; a digest shared by a third of all records is split by
Spark's skewed join, as one row stands on the other side.

Defined cases: a null html is an empty payload; empty and short payloads are always responses;
records that share both payload and the smallest page_id (repeated rows) are all responses, so no
record refers to itself; a null page_id comes after all others, and where every copy of a payload
has a null page_id all are responses; a null url gives a record without target; an empty table gives
no bundle; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from slotwise.llm.common import kept
from slotwise.llm.storage import NewFile, open_for_ranges
from slotwise.session import shared_folder

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
REVISIT_BYTES = 100
LEVEL = 3
# Fixed by the public formats: skippable frame, seek table footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"
RECORDS = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record(record_id: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no block of its own, but names the digest and length of the full payload."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html;charset=utf-8", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes | memoryview, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, offset of the next record) of the record at an offset."""
    data = bytes(data) if isinstance(data, memoryview) else data
    end = data.index(b"\r\n\r\n", at)
    head = data[at:end].decode().split("\r\n")
    if not head[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    headers = dict(line.split(": ", 1) for line in head[1:])
    start = end + 4
    stop = start + int(headers["Content-Length"])
    return headers, data[start:stop], stop + 4


def row_of(headers: dict[str, str], block: bytes) -> tuple:
    """A record's fields, after its block has been held against its digest."""
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = headers["WARC-Type"] == "revisit"
    if not revisit and hashlib.sha256(block).hexdigest() != digest:
        raise ValueError(f"payload of {headers['WARC-Record-ID']} doesn't match its digest")
    number = lambda key: int(headers[key]) if key in headers else None
    url = headers.get("WARC-Target-URI")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return (
        headers["WARC-Record-ID"][1:-1], number("X-Page-ID"), url, headers["WARC-Type"], number("X-Refers-To-Page-ID"),
        number("X-Payload-Length"), digest, None if revisit else block,
    )


class Bundle:
    """Writes frames, then the seek table."""

    def __init__(self, folder: str):
        import zstandard

        self.file, self.frames, self.buffer = NewFile(folder, ".warc.zst"), [], bytearray()
        self.codec = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset) of the record."""
        if self.buffer and len(self.buffer) + len(data) > FRAME_BYTES:
            self.flush()
        place = len(self.frames), len(self.buffer)
        self.buffer += data
        return place

    def flush(self) -> None:
        packed = self.codec.compress(bytes(self.buffer))
        self.frames.append((len(packed), len(self.buffer)))
        self.file.write(packed)
        self.buffer = bytearray()

    def close(self) -> None:
        if self.buffer:
            self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.file.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed size, original size) per frame, from the end of the bundle."""
    size = file.size()
    n, _, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    raw = file.read_at(8 * n, size - 9 - 8 * n)
    frames, at = [], 0
    for packed, original in struct.iter_unpack("<II", raw):
        frames.append((at, packed, original))
        at += packed
    return frames


def frame_bytes(file, frames: list[tuple[int, int, int]], k: int) -> bytes:
    import zstandard

    at, packed, original = frames[k]
    return zstandard.ZstdDecompressor().decompress(file.read_at(packed, at), max_output_size=original)


def with_roles(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to (null for responses)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    long_enough = rows.where(F.octet_length("payload") >= REVISIT_BYTES)
    repeated = (
        long_enough.groupBy(F.col("payload_digest").alias("digest"))
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    )
    repeated = kept(repeated.select("digest", "first"), "warc-repeated")
    role = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(repeated, rows.payload_digest == repeated.digest, "left").select(
        "page_id", "url", "payload", "payload_digest", role.alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the bundles and returns their index (kept as a table, so archives are written once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                out = []
                for r in whole.slice(at, 256).to_pylist():
                    if bundle is None or bundle.file.size > BUNDLE_BYTES:
                        if bundle is not None:
                            bundle.close()
                        bundle, n = Bundle(folder), 0
                    name = bundle.file.uri.rpartition("/")[2].partition(".")[0]
                    record_id, n = f"urn:record:{name}:{n}", n + 1
                    data = record(record_id, r["page_id"], r["url"], r["payload"], r["payload_digest"], r["refers_to"])
                    frame, offset = bundle.add(data)
                    out.append((record_id, r["page_id"], bundle.file.uri, frame, offset, len(data)))
                columns = list(zip(*out, strict=True))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["record_id", "page_id", "bundle", "frame", "offset", "length"],
                )
        if bundle is not None:
            bundle.close()

    return kept(with_roles(pages).mapInArrow(run, INDEX), "warc-index")


KINDS = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
NAMES = [part.split()[0] for part in RECORDS.split(", ")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)


def read_bundles(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of every bundle, frame after frame; digests are checked. Memory: one frame per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch["bundle"].to_pylist():
                with open_for_ranges(uri) as file:
                    frames = seek_table(file)
                    for k in range(len(frames)):
                        data, at, rows = frame_bytes(file, frames, k), 0, []
                        while at < len(data):
                            headers, block, at = parse(data, at)
                            row = row_of(headers, block)
                            rows.append(row if payloads else (*row[:-1], None))
                        yield _rows(rows)

    return index.select("bundle").distinct().mapInArrow(run, RECORDS)


def read_records(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of chosen record_ids: frames are fetched by seek table, records by their offset in the frame."""
    places = index.join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    places = places.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = k = file = frames = data = None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["bundle"] != uri:
                    uri, k, file = r["bundle"], None, open_for_ranges(r["bundle"])
                    frames = seek_table(file)
                if r["frame"] != k:
                    k, data = r["frame"], frame_bytes(file, frames, r["frame"])
                headers, block, _ = parse(data[r["offset"] : r["offset"] + r["length"]], 0)
                rows.append(row_of(headers, block))
            if rows:
                yield _rows(rows)

    return places.select("bundle", "frame", "offset", "length").mapInArrow(run, RECORDS)


def report(pages: DataFrame) -> DataFrame:
    """Writes the archives, reads them back by their seek tables, and returns what the records say."""
    index = write_archives(pages, shared_folder(pages.sparkSession, "warc"))
    return read_bundles(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with records as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), firsts as (
  select payload_digest, min(page_id) as first from records where payload_bytes >= 100 group by payload_digest having count(*) > 1
)
select r.page_id, r.payload_bytes, r.payload_digest,
  case when f.first is not null and r.page_id is distinct from f.first then 'revisit' else 'response' end as record_type,
  case when r.page_id is distinct from f.first then f.first end as refers_to
from records r left join firsts f on f.payload_digest = r.payload_digest
"""
