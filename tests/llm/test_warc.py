from __future__ import annotations

import hashlib
import io
import os

import pytest
import zstandard

from dockpulse.llm import warc

PAGES = [
    (1, "http://a/", "x" * 150),
    (2, "http://b/", "x" * 150),
    (3, "http://c/\r\nWARC-Type: bad x", "x" * 99),
    (4, None, "x" * 99),
    (5, "http://e/", None),
    (6, "http://f/", ""),
    (7, "http://g/é", "é\r\n\r\nWARC/1.1\r\n" * 4000),
    (0, "http://h/", "x" * 150),
    (0, "http://h/", "x" * 150),
    (None, "http://i/", "x" * 150),
    (9, "http://j/", "y" * 2_000_000),
]


def expected():
    out = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        same = [j for j, _, h in PAGES if (h or "") == (html or "") and j is not None]
        first = min(same) if len(data) >= 100 and same else i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=str)


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, digest int")


def test_pages_come_back(spark):
    number = lambda t: int(t.removeprefix(warc.PAGE)) if t else None
    found = [
        (number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to))
        for r in warc.archive_pages(spark, frame(spark)).collect()
    ]
    assert sorted(found, key=str) == expected()


def test_no_pages(spark):
    assert warc.archive_pages(spark, frame(spark, [])).collect() == []


def records(n, size=2000):
    for i in range(n):
        body = (f"page {i} " + "some words that all pages share " * (size // 32)).encode()
        yield warc.page_record(f"urn:page:{i}", f"http://x/{i}", body, hashlib.sha256(body).hexdigest(), len(body), None)


def test_round_trip_and_layout(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 200_000)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 60_000)
    made = list(warc.archived(records(900), str(tmp_path)))
    assert len(made) > 1 and sum(m[1] for m in made) == 900
    found = [r for m in made for r in warc.records_of(m[0])]
    assert [r[0] for r in found] == [f"urn:page:{i}" for i in range(900)]
    assert all(hashlib.sha256(r[6]).hexdigest() == r[3] and len(r[6]) == r[4] for r in found)
    path, count, size, dictionary_bytes = made[0]
    data = open(path, "rb").read()
    assert len(data) == size == os.path.getsize(path)
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    assert int.from_bytes(data[4:8], "little") == dictionary_bytes > 0
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + dictionary_bytes])
    assert dictionary.dict_id() > 0
    frames, rest = 0, data[8 + dictionary_bytes :]
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        assert one.decompress(rest).startswith(b"WARC/1.1\r\n")
        rest, frames = one.unused_data, frames + 1
    assert frames == count + 1


def test_few_records_have_a_raw_dictionary(tmp_path):
    made = list(warc.archived(records(1, 64), str(tmp_path)))
    assert made[0][3] > 0 and len(list(warc.records_of(made[0][0]))) == 1
    assert list(warc.archived(iter([]), str(tmp_path))) == []


def test_damage_is_found(tmp_path):
    made = next(warc.archived(records(5), str(tmp_path)))
    data = open(made[0], "rb").read()
    open(made[0], "wb").write(data[:-20])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.records_of(made[0], made[1]))
    assert io.BytesIO(data).read(4) == warc.DICTIONARY_MAGIC.to_bytes(4, "little")
