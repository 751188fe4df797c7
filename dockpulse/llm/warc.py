"""WARC archives in Zstandard frames with an embedded dictionary: written and read by Spark tasks."""

from __future__ import annotations

import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockpulse.llm.workspace import folder, ship, stored

# Fixed by the format: magic number of the leading skippable frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

LEAST_REVISIT_BYTES = 100
DICTIONARY_BYTES = 64 * 1024
SAMPLE_BYTES = 3 * 1024 * 1024
ARCHIVE_BYTES = 256 * 1024 * 1024
LEVEL = 3

MANIFEST = "path string, records bigint, bytes bigint, dictionary_bytes bigint"
RECORDS = (
    "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes bigint, "
    "refers_to string, payload binary"
)


def deduplicated(payloads: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Rows `id, uri, payload` with `digest`, `bytes`, and `first`: the id of the response that a revisit refers to, else null.

    Of equal payloads of `least_bytes` or more, the rows with the smallest id are responses (several if rows repeat the id), the others
    revisits; smaller ones are all responses. A null payload is empty; a null id never is the smallest unless all are null.
    Payloads too small to be revisited get join keys of their own, so that a third of empty pages is no hot key.
    """
    body = F.coalesce("payload", F.lit(b""))
    rows = payloads.select("id", "uri", body.alias("payload")).select(
        "*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("bigint").alias("bytes")
    )
    large = F.col("bytes") >= least_bytes
    firsts = rows.where(large).groupBy(F.col("digest").alias("key")).agg(F.min("id").alias("least"))
    key = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("small "), F.xxhash64("id", "uri").cast("string")))
    joined = rows.withColumn("key", key).join(firsts, "key", "left")
    first = F.when(~F.col("id").eqNullSafe(F.col("least")), F.col("least"))
    return joined.select("id", "uri", "payload", "digest", "bytes", first.alias("first"))


def _uri(text: str) -> str:
    """A URI that cannot break a header line: control characters and spaces escaped, the rest as it is."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, b"WARC-Type: " + kind.encode(), b"WARC-Date: " + DATE.encode()]
    lines += [f"{name}: {value}".encode() for name, value in headers]
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(record_id: str | None, uri: str | None, payload: bytes, digest: str, size: int, first: str | None) -> bytes:
    """A response, or a revisit without the payload whose HTTP headers still tell its length."""
    headers = [("WARC-Record-ID", f"<{record_id or ''}>")]
    if uri is not None:
        headers.append(("WARC-Target-URI", _uri(uri)))
    headers.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if first is not None:
        headers += [("WARC-Refers-To", f"<{first}>"), ("WARC-Profile", REVISIT_PROFILE)]
    headers.append(("Content-Type", "application/http;msgtype=response"))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    return record("response" if first is None else "revisit", headers, http if first is not None else http + payload)


def trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary of the sample records; of too few or too uniform ones, the end of their bytes as a raw dictionary."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=1024, d=8, level=LEVEL)
    except zstandard.ZstdError:
        raw = b"".join(s[-DICTIONARY_BYTES:] for s in samples[-64:])[-DICTIONARY_BYTES:]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _target(path: str):
    return pyarrow.fs.FileSystem.from_uri(path)


def archived(records: Iterator[bytes], into: str) -> Iterator[tuple[str, int, int, int]]:
    """Write records to archives below a folder; yields (path, records, bytes, dictionary bytes) of each one.

    The first records, up to `SAMPLE_BYTES`, wait until the dictionary is built from them; then they and all others are written as
    they come, each in a frame of its own. No more than that and one record is held.
    """
    filesystem, place = _target(into)
    filesystem.create_dir(place, recursive=True)
    records = iter(records)
    ahead = next(records, None)
    while ahead is not None:
        waiting, size = [], 0
        while ahead is not None and size < SAMPLE_BYTES:
            waiting.append(ahead)
            size += len(ahead)
            ahead = next(records, None)
        dictionary = trained([w[: DICTIONARY_BYTES * 2] for w in waiting])
        content = dictionary.as_bytes()
        dictionary.precompute_compress(level=LEVEL)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        name, count = f"{uuid.uuid4().hex}.warc.zst", len(waiting)
        with filesystem.open_output_stream(f"{place}/{name}", compression=None) as out:
            out.write(DICTIONARY_MAGIC.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content)
            info = b"software: zstd dictionary archive writer\r\nformat: WARC File Format 1.1\r\n"
            about = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")]
            out.write(compressor.compress(record("warcinfo", about, info)))
            for one in waiting:
                out.write(compressor.compress(one))
            waiting = []
            while ahead is not None and out.tell() < ARCHIVE_BYTES:
                out.write(compressor.compress(ahead))
                count += 1
                ahead = next(records, None)
            written = out.tell()
        yield f"{into}/{name}", count, written, len(content)


def write_archives(pages: DataFrame, into: str) -> DataFrame:
    """Archive rows `id` (string), `uri`, `payload`, `digest`, `bytes`, `first` (string); returns the written table of the archives.

    A task that is lost or run twice leaves files that the table does not name; readers go by the table. Extra columns are ignored.
    No rows make no archives.
    """
    ship(__name__)

    def run(batches):
        names = ("id", "uri", "payload", "digest", "bytes", "first")
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in names)))
        for made in archived((page_record(*row) for row in rows), into):
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in made], ["path", "records", "bytes", "dictionary_bytes"])

    rows = pages.select("id", "uri", "payload", "digest", "bytes", "first")
    return stored(rows.mapInArrow(run, MANIFEST), "warc-manifest")


def _exactly(stream, size: int) -> bytes:
    data = stream.read(size)
    if len(data) != size:
        raise ValueError("an archive ends within a record")
    return data


def _headers(stream) -> dict[str, str]:
    found = {}
    while (line := stream.readline().rstrip(b"\r\n")) != b"":
        name, _, value = line.decode().partition(": ")
        found[name.lower()] = value
    return found


def records_of(path: str, count: int | None = None) -> Iterator[tuple]:
    """(record id, type, uri, digest, payload bytes, id referred to, payload or None) of an archive, one record in memory at a time.

    The digest of a response is computed again and has to agree with its header, as has the number of records with `count`: an
    archive that was cut off between two blocks of a frame would otherwise just seem shorter.
    """
    found = 0
    filesystem, place = _target(path)
    with filesystem.open_input_stream(place, compression=None) as file:
        head = file.read(8)
        if int.from_bytes(head[:4], "little") != DICTIONARY_MAGIC:
            raise ValueError(f"{path} does not start with a dictionary frame")
        content = _exactly(file, int.from_bytes(head[4:], "little"))
        decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
        with decompressor.stream_reader(file, read_across_frames=True) as frames:
            stream = io.BufferedReader(frames, 1 << 20)
            while line := stream.readline():
                if line.rstrip(b"\r\n") != VERSION:
                    raise ValueError(f"{path}: no record where one should start")
                headers = _headers(stream)
                block = _exactly(stream, int(headers["content-length"]))
                _exactly(stream, 4)
                kind = headers["warc-type"]
                if kind == "warcinfo":
                    continue
                http = _headers(inner := io.BytesIO(block))
                payload = inner.read() if kind == "response" else None
                digest = headers["warc-payload-digest"].removeprefix("sha256:")
                if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{path}: a payload does not have its digest")
                found += 1
                yield (
                    headers["warc-record-id"][1:-1] or None,
                    kind,
                    headers.get("warc-target-uri"),
                    digest,
                    int(http["content-length"]),
                    headers["warc-refers-to"][1:-1] if "warc-refers-to" in headers else None,
                    payload,
                )
    if count is not None and found != count:
        raise ValueError(f"{path} has {found} records of {count}")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives a written table names, the payload null for revisits (and for all without `payloads`)."""
    ship(__name__)
    names = [part.split()[0] for part in RECORDS.split(", ")]
    schema = pa.schema(
        [(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in names]
    )

    def run(batches):
        for batch in batches:
            for path, count in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                rows, size = [], 0
                for row in records_of(path, count):
                    rows.append(row if payloads else (*row[:-1], None))
                    size += len(rows[-1][-1] or b"") + 500
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    return archives.select("path", "records").repartition(max(1, archives.count()), "path").mapInArrow(run, RECORDS)


PAGE = "urn:page:"


def archive_pages(spark: SparkSession, pages: DataFrame, into: str | None = None) -> DataFrame:
    """Write a record per page (`page_id`, `url`, `html`) and read the archives back: the table of archived records, payloads left out."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("id"),
        F.col("url").alias("uri"),
        F.col("html").cast("binary").alias("payload"),
    )
    name = lambda c: F.concat(F.lit(PAGE), F.col(c).cast("string"))
    rows = deduplicated(rows).withColumn("id", name("id")).withColumn("first", name("first"))
    return read_archives(write_archives(rows, into or folder(spark, "warc")), payloads=False)
