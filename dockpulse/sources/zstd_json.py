"""JSON records in Zstandard files: a data source that decodes frames as a stream, and a writer of the same form.

Spark's own JSON reader needs a codec that the usual Hadoop builds lack, and reads an array in a file as one value. Here files come through Spark's
file listing; each is decoded a piece at a time and its records leave one by one, whether they stand one per line or in one array.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Bytes that are decoded, and of records that leave, at once.
PIECE = 1 << 20
# Bytes that are given to the decoder at once: a block of 128 KB can be four bytes, so these grow to 32 MB at most.
STEP = 1 << 10
LEVEL = 6
# Bytes of text of one frame that the writer makes, about.
FRAME = 4 << 20
# What matters inside a text and outside of one.
_IN_TEXT, _OUTSIDE = re.compile(rb'["\\]'), re.compile(rb'["{}\[\]]')
# Levels of an object that one match finds the end of; deeper ones, and those that go on in the next piece, are followed sign by sign.
LEVELS = 6


def _whole(levels: int) -> bytes:
    """A pattern without backtracking: an object or array of at most so many levels."""
    inner = rb"|" + _whole(levels - 1) if levels > 1 else b""
    return rb'[{\[](?:[^"{}\[\]]++|"(?:[^"\\]++|\\.)*+"' + inner + rb")*+[}\]]"


_WHOLE = re.compile(_whole(LEVELS), re.DOTALL)


class Splitter:
    """Cuts a stream of bytes into JSON objects: those of an array, or those that follow each other. Only the object that is open is held.

    Between objects there may be white space, commas and the brackets of one array; anything else is an error, and so is a stream that ends inside an object or array.
    """

    def __init__(self) -> None:
        self.open = bytearray()
        self.depth = 0
        self.text = self.escaped = self.array = self.began = self.ended = False

    def records(self, piece: bytes) -> Iterator[bytes]:
        at = start = 0
        while at < len(piece):
            if not self.depth:
                start = at = self._between(piece, at)
                if at == len(piece):
                    return
                if found := _WHOLE.match(piece, at):
                    start = at = found.end()
                    yield found[0]
                    continue
                self.depth, at = 1, at + 1
                continue
            at = self._inside(piece, at)
            if not self.depth:
                self.open += piece[start:at]
                yield bytes(self.open)
                self.open.clear()
                start = at
        self.open += piece[start:]

    def _between(self, piece: bytes, at: int) -> int:
        """The place of the next object."""
        while at < len(piece):
            c = piece[at]
            if c == b"{"[0] and not self.ended:
                self.began = True
                return at
            if c == b"["[0] and not self.began and not self.array:
                self.array = True
            elif c == b"]"[0] and self.array and not self.ended:
                self.ended = True
            elif c not in b" \t\r\n" and not (c == b","[0] and self.array and self.began):
                raise ValueError(f"no JSON records: {piece[at : at + 20]!r}")
            at += 1
        return at

    def _inside(self, piece: bytes, at: int) -> int:
        """The place after the open object, or the end of the piece."""
        if self.escaped and at < len(piece):
            self.escaped, at = False, at + 1
        while found := (_IN_TEXT if self.text else _OUTSIDE).search(piece, at):
            c, at = found[0], found.end()
            if c == b'"':
                self.text = not self.text
            elif c == b"\\":
                if at == len(piece):
                    self.escaped = True
                at += 1
            elif c in b"{[":
                self.depth += 1
            else:
                self.depth -= 1
                if not self.depth:
                    return at
        return len(piece)

    def finish(self) -> None:
        if self.depth or self.array != self.ended:
            raise ValueError("the file ends inside a record")


def decoded(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of all frames of a file, a piece at a time. A file that ends inside a frame is an error; skippable frames are skipped."""
    import zstandard

    frame = None
    for piece in pieces:
        for at in range(0, len(piece), STEP):
            rest = piece[at : at + STEP]
            while rest:
                frame = frame or zstandard.ZstdDecompressor().decompressobj()
                found = frame.decompress(rest)
                if found:
                    yield found
                if not frame.eof:
                    break
                rest, frame = frame.unused_data, None
    if frame is not None:
        raise ValueError("the file ends inside a frame")


class _Files(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _texts(records: list[bytes]) -> pa.RecordBatch:
    """Records as text; bytes that are no UTF-8 are an error."""
    return pa.RecordBatch.from_pydict({"value": pa.array(records, pa.binary()).cast(pa.string())})


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])

    def partitions(self) -> list[_Files]:
        return [_Files(f) for f in self.files] or [_Files("")]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        """The records of a file as batches of text."""
        if not partition.path:
            return
        splitter, found, size = Splitter(), [], 0
        for piece in decoded(_pieces(partition.path)):
            for record in splitter.records(piece):
                found.append(record)
                size += len(record)
                if size >= PIECE:
                    yield _texts(found)
                    found, size = [], 0
        splitter.finish()
        if found:
            yield _texts(found)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _pieces(path: str) -> Iterator[bytes]:
    system, inner = _place(path)
    with system.open_input_stream(inner, compression=None) as file:
        while piece := file.read(PIECE):
            yield piece


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceArrowWriter):
    """Tasks write below a folder of their own run; the commit moves the files of the tasks that count to the path. Their folder is removed after that; a task that is killed later than that can leave one again, which readers do not see."""

    def __init__(self, options: dict):
        self.path, self.array, self.level = options["path"], options["array"] == "true", int(options["level"])
        self.folder = f"{self.path.rstrip('/')}/_temporary-{options['run']}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        import zstandard
        from pyspark import TaskContext

        context, compressor = TaskContext.get(), zstandard.ZstdCompressor(level=self.level)
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.json.zst"
        system, inner = _place(f"{self.folder}/{name}")
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        part, size, some = [], 0, False
        first, between, last = (b"[", b",\n", b"]") if self.array else (b"", b"\n", b"\n")
        with system.open_output_stream(inner, compression=None) as file:
            for batch in iterator:
                for value in batch.column(0).cast(pa.binary()).to_pylist():
                    part.append(between if some else first)
                    part.append(value)
                    some, size = True, size + len(value)
                    if size >= FRAME:
                        file.write(compressor.compress(b"".join(part)))
                        part, size = [], 0
            if some:
                part.append(last)
                file.write(compressor.compress(b"".join(part)))
        if not some:
            system.delete_file(inner)
        return _Written(name if some else None)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, inner = _place(self.path)
        system.create_dir(inner, recursive=True)
        for name in [m.name for m in messages if isinstance(m, _Written) and m.name]:
            system.move(f"{_place(self.folder)[1]}/{name}", f"{inner.rstrip('/')}/{name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, inner = _place(self.folder)
        if system.get_file_info(inner).type == fs.FileType.Directory:
            system.delete_dir(inner)


class ZstdRecords(DataSource):
    """`value`: the text of each JSON record. Reads the files named in the option `files`, a JSON list, a task per file; writes below `path`."""

    @classmethod
    def name(cls) -> str:
        return "zstd_records"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """`value`: the JSON records of the Zstandard files at a path (a file, folder or pattern), each a line or an item of one array.

    Files are found by Spark and streamed by the tasks through pyarrow's file systems (local, hdfs, s3, gs). A task holds a piece of a file and the open
    record, whatever the file's size. Text that is no JSON record, and a file that is cut off, fail the job.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(ZstdRecords)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").collect()
    return spark.read.format("zstd_records").option("files", json.dumps(sorted(r["path"] for r in found))).load()


def parsed(records: DataFrame, schema: T.StructType) -> DataFrame:
    """The records under a schema; one that is no JSON or has a value of another type fails the job."""
    return records.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("record")).select("record.*")


def write_records(records: DataFrame, path: str, array: bool = False, level: int = LEVEL) -> None:
    """Rows as JSON, nulls written out, in Zstandard files of a new folder: one per partition, of frames of about FRAME bytes of text, with one record per line or as one array.

    Files are streamed; a task holds one frame. A path that exists is an error. Without rows the folder is empty.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark = records.sparkSession
    spark.dataSource.register(ZstdRecords)
    system, inner = _place(path)
    if system.get_file_info(inner).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    text = records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value"))
    options = {"path": path, "array": str(array).lower(), "level": str(level), "run": uuid.uuid4().hex}
    text.write.format("zstd_records").options(**options).mode("append").save()
