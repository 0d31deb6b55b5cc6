"""WARC archives in Zstandard: written and read by Spark, one frame per record, dictionary in a leading skippable frame.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself a Zstandard frame.
Every record follows as one frame compressed with that dictionary and with its content size in the header, so a
reader walks frames without decoding those it does not want. Dictionaries are trained per archive on at most
``DICTIONARY_RECORDS`` of its own first records; nothing is trained on the driver.

Defined cases: a null payload is written as zero bytes; a null page_id is written as ``null`` and read back as
null; repeated rows are repeated records, all of them responses when their page_id is the smallest of the payload;
an empty table gives no archive and an empty result; extra columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundmesh.llm.common import materialize

SKIPPABLE_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
ARCHIVE_BYTES = 8 << 20
DICTIONARY_RECORDS = 64
DICTIONARY_BYTES = 16 << 10
SAMPLE_BYTES = 16 << 10
MIN_REVISIT_BYTES = 100
RECORD_DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVES = "archive_id string, records long, content binary"
RECORDS = (
    "archive_id string, record_number long, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, payload binary"
)


def plan_records(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Decide response or revisit per page: page_id, url, payload, payload_digest, record_type, refers_to.

    The smallest page_id per digest comes from a partial aggregate, so a payload that a third of all pages share
    reaches the reducers as one row per map task; the join back is one that AQE can split.
    """
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    first = rows.where(F.length("payload") >= min_revisit_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"))
    revisit = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")))
    return rows.join(first, "payload_digest", "left").select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.length("payload").cast("long").alias("payload_bytes"),
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, length: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {RECORD_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, "WARC-Target-URI: " + " ".join(url.split()))
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from the first records; where they are too few or too uniform to train on, their raw bytes."""
    samples = [r[:SAMPLE_BYTES] for r in records[:DICTIONARY_RECORDS]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def build_archive(records: list[bytes]) -> bytes:
    dictionary = train_dictionary(records)
    packed = zstandard.ZstdCompressor(level=3).compress(dictionary.as_bytes())
    encoder = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
    parts = [struct.pack("<II", SKIPPABLE_MAGIC, len(packed)), packed]
    parts += [encoder.compress(r) for r in records]
    return b"".join(parts)


def write_archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Rows of plan_records() -> archives of about ``archive_bytes`` of raw records each; a task holds one at a time."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            content = build_archive(held)
            return pa.RecordBatch.from_pydict({"archive_id": [hashlib.sha256(content).hexdigest()[:32]], "records": [len(held)], "content": [content]}, schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                record = record_bytes(row["page_id"], row["url"], row["payload"], row["payload_bytes"], row["payload_digest"], row["record_type"], row["refers_to"])
                held.append(record)
                size += len(record)
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    schema = pa.schema([("archive_id", pa.string()), ("records", pa.int64()), ("content", pa.binary())])
    order = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.select(*order).mapInArrow(write, ARCHIVES)


def frame_length(data: memoryview, at: int) -> int:
    """Bytes of the Zstandard frame that starts at ``at``, from its block headers alone."""
    if bytes(data[at : at + 4]) != ZSTD_MAGIC:
        raise ValueError(f"no Zstandard frame at byte {at}")
    checksum = 4 if data[at + 4] & 4 else 0
    pos = at + zstandard.frame_header_size(data[at : at + 18])
    last = 0
    while not last:
        if pos + 3 > len(data):
            raise ValueError(f"frame at byte {at} is cut short")
        header = data[pos] | data[pos + 1] << 8 | data[pos + 2] << 16
        last, kind, size = header & 1, header >> 1 & 3, header >> 3
        if kind == 3:
            raise ValueError(f"reserved block type at byte {pos}")
        pos += 3 + (1 if kind == 1 else size)
    if pos + checksum > len(data):
        raise ValueError(f"frame at byte {at} is cut short")
    return pos + checksum - at


def parse_record(raw: bytes) -> dict:
    """Check one record's version line, headers, lengths and digests, and return its fields."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not blank or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"bad WARC header line {line[:60]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"WARC header {name} is missing")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {length} does not fit a record of {len(rest)} bytes")
    block = rest[:length]
    if (want := fields.get("warc-block-digest", "")).startswith("sha256:") and hashlib.sha256(block).hexdigest() != want[7:]:
        raise ValueError("the block digest does not fit")
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if fields["warc-type"] == "response":
        if declared != len(payload):
            raise ValueError(f"the payload has {len(payload)} bytes, its header says {declared}")
        found = hashlib.sha256(payload).hexdigest()
        if digest and digest != found:
            raise ValueError("the payload digest does not fit")
        digest = found
    number = lambda x: None if x in (None, "<urn:x-page:null>") else int(x.removeprefix("<urn:x-page:").rstrip(">"))
    return {
        "page_id": number(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "refers_to": number(fields.get("warc-refers-to")),
        "payload_bytes": declared,
        "payload_digest": digest,
        "payload": payload if fields["warc-type"] == "response" else None,
    }


def iterate_archive(content: bytes) -> Iterator[dict]:
    """Records of one archive. Raises ValueError on a missing dictionary, a damaged frame, header or length."""
    data = memoryview(content)
    magic, size = struct.unpack_from("<II", data) if len(data) >= 8 else (0, 0)
    if magic != SKIPPABLE_MAGIC or 8 + size > len(data):
        raise ValueError("the archive does not start with a dictionary frame")
    raw = bytes(data[8 : 8 + size])
    raw = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == ZSTD_MAGIC else raw
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    at = 8 + size
    while at < len(data):
        length = frame_length(data, at)
        yield parse_record(decoder.decompress(data[at : at + length]))
        at += length


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Archives (archive_id, content) -> one row per record, every header, length and digest checked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive_id, content in zip(batch["archive_id"].to_pylist(), batch["content"], strict=True):
                rows: list[dict] = []
                size = 0
                for n, record in enumerate(iterate_archive(content.as_py())):
                    size += len(record["payload"] or b"")
                    if not with_payload:
                        record["payload"] = None
                    rows.append({"archive_id": archive_id, "record_number": n} | record)
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ") for x in RECORDS.split(","))])
    return archives.select("archive_id", "content").mapInArrow(read, RECORDS)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of the ``*.warc.zst`` files under ``path``, one task per file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return read_archives(files.select(F.col("path").alias("archive_id"), "content"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives of ``pages`` as a table in the shared folder, read them back, and return the records."""
    return read_archives(materialize(write_archives(plan_records(pages)), "warc"), with_payload=False)
