"""Zstandard dumps: frames, arrays and lines, cut-off files, and files larger than what a task holds."""

from __future__ import annotations

import json
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from dockpulse import schemas
from dockpulse.sources import tables, zstd_json
from fixtures import event_status, information_table
from test_sources import RECORD, STATUS

ODD = [{}, {"a": "}{][\\"}, {"a": '"\\"}', "b": [{"c": "\\\\"}, [], "é日\U0001f600"]}, {"a": {"b": {"c": [1, [2, {"d": None}]]}}}, {"a": "x" * 5000}]


@pytest.mark.parametrize("form", ["array", "pretty", "lines", "joined"])
def test_records_are_cut_at_any_place(form):
    forms = {
        "array": json.dumps(ODD, ensure_ascii=False),
        "pretty": json.dumps(ODD, indent=2),
        "lines": "\n".join(map(json.dumps, ODD)) + "\n",
        "joined": "".join(map(json.dumps, ODD)),
    }
    text = forms[form].encode()
    rng = random.Random(3)
    for step in [1, 2, 3, 7, 100, 10**6, None]:
        splitter, found, at = zstd_json.Splitter(), [], 0
        while at < len(text):
            size = step or rng.randrange(1, 50)
            found += splitter.records(text[at : at + size])
            at += size
        splitter.finish()
        assert [json.loads(r) for r in found] == ODD


@pytest.mark.parametrize("text", ["[]", "", " \n ", "[ ]"])
def test_no_records(text):
    splitter = zstd_json.Splitter()
    assert list(splitter.records(text.encode())) == []
    splitter.finish()


@pytest.mark.parametrize("text", ["[{}", '{"a": 1', "not json", "[{}]{}", "12", '{"a": "}', "[[{}]]", "]"])
def test_what_is_no_record(text):
    splitter = zstd_json.Splitter()
    with pytest.raises(ValueError):
        list(splitter.records(text.encode()))
        splitter.finish()


def test_frames_of_all_kinds():
    make = zstandard.ZstdCompressor()
    skippable = b"\x50\x2a\x4d\x18" + (5).to_bytes(4, "little") + b"hello"
    body = make.compress(b"one ") + skippable + make.compress(b"") + make.compress(b"two")
    for step in (1, 5, 1000):
        pieces = [body[i : i + step] for i in range(0, len(body), step)]
        assert b"".join(zstd_json.decoded(iter(pieces))) == b"one two"
    with pytest.raises(ValueError, match="inside a frame"):
        list(zstd_json.decoded(iter([body[:-2]])))


def test_dumps_as_other_programs_write_them(spark, tmp_path):
    """One array in one frame, indented; records per line in a frame each; both in one folder."""
    folder = tmp_path / "dump.json.zst"
    folder.mkdir()
    make = zstandard.ZstdCompressor()
    (folder / "a.json.zst").write_bytes(make.compress(json.dumps([STATUS, STATUS | {"station_id": "8"}], indent=1).encode()))
    (folder / "b.json.zst").write_bytes(b"".join(make.compress(json.dumps(STATUS | {"station_id": str(i)}).encode() + b"\n") for i in (1, 2)))
    rows = tables.read_status_dump(spark, str(folder)).orderBy("station_id").collect()
    assert [r.station_id for r in rows] == [1, 2, 8, 9101] and rows[0].vehicle_types_available_iconic == 4
    (tmp_path / "i.json.zst").write_bytes(make.compress(json.dumps([RECORD]).encode()))
    row = tables.read_information_dump(spark, str(tmp_path / "i.json.zst")).first()
    assert (row.id, row.bluetooth_id, row.rental_uris) == (12, "b1", ["", "", "x"])


@pytest.mark.parametrize("array", [False, True])
def test_round_trip(spark, tmp_path, array):
    status = event_status(spark)
    paths = tables.export_dump(status, information_table(spark, [{"station_id": 7001}]), str(tmp_path), zstd=True, array=array)
    assert all(p.endswith("_ever.json.zst") for p in paths)
    again = tables.read_status_dump(spark, paths[1])
    names = list(schemas.STATUS_FEED_COLUMNS)
    key = lambda r: (r.station_id, r.last_reported)
    assert sorted(again.select(names).collect(), key=key) == sorted(status.select(names).collect(), key=key)
    assert not list(tmp_path.glob("*/_temporary*"))
    with pytest.raises(FileExistsError):
        zstd_json.write_records(status, paths[1])


@pytest.mark.parametrize("bad", [b"{}", b"not json", json.dumps(RECORD | {"info_id": "twelve"}).encode()])
def test_bad_records_and_cut_off_files_raise(spark, tmp_path, bad):
    make = zstandard.ZstdCompressor()
    (tmp_path / "dump.json.zst").write_bytes(make.compress(json.dumps(RECORD).encode() + b"\n" + bad))
    with pytest.raises(Exception):
        tables.read_information_dump(spark, str(tmp_path / "dump.json.zst")).collect()
    (tmp_path / "cut.json.zst").write_bytes(make.compress(json.dumps([RECORD] * 99).encode())[:-9])
    with pytest.raises(Exception, match="ends inside"):
        tables.read_information_dump(spark, str(tmp_path / "cut.json.zst")).collect()


def test_a_file_larger_than_a_task_holds(tmp_path):
    """300 MB of text in one array pass through the reader, which holds a piece and the open record."""
    path = tmp_path / "large.json.zst"
    record = json.dumps({"a": "x" * 30_000}).encode()
    with zstandard.ZstdCompressor().stream_writer(path.open("wb")) as out:
        out.write(b"[" + record)
        for _ in range(9_999):
            out.write(b",\n" + record)
        out.write(b"]")
    reader = zstd_json._Reader({"files": json.dumps([str(path)])})
    largest = rows = 0
    for batch in reader.read(reader.partitions()[0]):
        rows, largest = rows + len(batch), max(largest, batch.nbytes)
    assert max(map(len, zstd_json.decoded(zstd_json._pieces(str(path))))) <= 40 << 20
    assert rows == 10_000 and largest < 4 * zstd_json.PIECE


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    rows = spark.range(0, 100, 1, 4).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("no")).cast("bigint")).alias("id"))
    with pytest.raises(Exception):
        zstd_json.write_records(rows, str(tmp_path / "t.json.zst"))
    assert not list(tmp_path.glob("t.json.zst/[!_]*"))


def test_whole_records_are_cut_by_one_match(monkeypatch):
    """Records inside a piece are not followed sign by sign; deeper ones and those that a piece ends in are."""
    deep = json.loads('{"a":' * 20 + "1" + "}" * 20)
    text, calls, inside = json.dumps([*ODD, deep, *ODD]).encode(), [], zstd_json.Splitter._inside
    monkeypatch.setattr(zstd_json.Splitter, "_inside", lambda self, piece, at: calls.append(at) or inside(self, piece, at))
    splitter = zstd_json.Splitter()
    assert [json.loads(r) for r in splitter.records(text)] == [*ODD, deep, *ODD]
    splitter.finish()
    assert len(calls) == 1
