"""Resampling against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest

from dockpulse.llm import queries, resample

SF_DIR = "/root/testdata/sf0.001"


def plain_features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return words, [zlib.crc32(r.encode()) % 10000 for r in runs]


def plain(docs, target, drawn=5, least=20):
    """Rows (doc_id, n_features, weight, score, rank), in the order of `docs`."""
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for b in plain_features(text)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    found, open_ = [], []
    for i, (doc_id, text) in enumerate(docs):
        words, buckets = plain_features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        found.append([doc_id, len(buckets), weight, score, None])
        if len(words) >= least:
            open_.append((-score, doc_id is None, doc_id or 0, i))
    for rank, key in enumerate(sorted(open_)[: drawn * len(open_) // 100], 1):
        found[key[3]][4] = rank
    return [tuple(r) for r in found]


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))


def corpus():
    rng = random.Random(1)
    words = ["the", "Zürich", "x" * 300, "a1", "ÉCOLE", "b", "日本", "ok-go", "q\x7fr", "A_B"]
    rows = [(None, None), (None, "no id " * 30), (1, ""), (2, " \n\x0b"), (3, "one"), (4, "one two")]
    rows += [(5, "the same " * 40)] * 60 + [(6, " ".join(f"w{i}" for i in range(60_000)))]
    rows += [(i, " ".join(rng.choice(words) + rng.choice(["", ",", "."]) for _ in range(rng.randrange(50)))) for i in range(7, 500)]
    return rows


@pytest.mark.parametrize("pivots, drawn, part", [(31, 5, 1 << 22), (1, 60, 500), (4, 100, 5000)])
def test_rows_are_those_of_plain_python(spark, monkeypatch, pivots, drawn, part):
    monkeypatch.setattr(resample, "PART_BYTES", part)
    monkeypatch.setattr(resample.kth_key, "__defaults__", (pivots,))
    rows, target = corpus(), ["the Zürich a1 b", None, "", "b b b ok go"]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, rank string, key int").repartition(4)
    found = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), drawn).collect()
    assert order(map(tuple, found)) == order(plain(rows, target, drawn))


def test_whole_tables(spark):
    table = lambda name: spark.read.parquet(f"{SF_DIR}/{name}.parquet").collect()
    wanted = plain([(r.doc_id, r.text) for r in table("documents")], [r.text for r in table("benchmark")])
    found = queries.op11_resampling(spark, SF_DIR)
    assert dict(found.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    assert order(map(tuple, found.collect())) == order(wanted)
    assert sum(r[4] is not None for r in wanted) > 0


def test_empty_tables(spark):
    empty, one = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert resample.resample(empty, empty).collect() == []
    assert [tuple(r) for r in resample.resample(one, empty).collect()] == plain([(1, "a b")], [])
