from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dockpulse.llm import packing


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: own.encode(text or "", add_special_tokens=False).ids


WORDS = ["the", "don't", "we'll", "x'sy", "1234", "3.14", "naïve", "日本語", "a\nb", "a\tb", "…", "​", "é", "😀😀", "ÅÄÖ", "..", "'", "s"]
TEXTS = [
    None,
    "",
    " ",
    "\n",
    "a",
    " a",
    "a ",
    "  a",
    "a  b",
    "a   b",
    "a \nb",
    "a\n b",
    "a\n\n b",
    "\n\na\t\tb \r\n",
    "a b  c",
    "a\x1c b",
    "a <|endoftext|> b",
    "<|endoftext|>",
    "<|endoftext|><|endoftext|> a",
    "a<|endoftext|>",
    "a  <|endoftext|>\n<|endoftext|",
    "<|<|endoftext|>endoftext|> <|endoftext |> x",
    "word " * 3000 + "<|endoftext|>" + " word" * 3000,
    "x" * 9000,
    "word " * 9000,
    "new\n" * 3000,
    "end\n",
    "\nstart",
    " start",
]


def mixed_texts(n=300, seed=1):
    rng = random.Random(seed)
    gaps = [" "] * 12 + ["\n", "  ", " \n", "\t", " "]
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(WORDS) + rng.choice(gaps) for _ in range(rng.randrange(1, 60))))
        if rng.random() < 0.7:
            out[-1] = " ".join(out[-1].split())
    return out


def test_ids_are_the_librarys(library, monkeypatch):
    texts = [t or "" for t in TEXTS] + mixed_texts()
    own = packing.Encoder(public_tokenizers.path(packing.RANKS))
    for _ in range(2):
        flat, counts = own.encode(texts)
        parts = np.split(flat, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == [library(t) for t in texts]
    monkeypatch.setattr(packing, "MEMORY", 10)
    flat, counts = own.encode(texts[::-1])
    assert flat.tolist() == [i for t in texts[::-1] for i in library(t)]


def expected_pieces(library, rows):
    out = []
    for doc_id, text in rows:
        ids = np.array([*library(text), 0], "<u4")
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(edges, edges[1:])):
            out.append((doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    return sorted(out, key=str)


def check_places(found):
    bins: dict = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins)


def test_pieces_and_places(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS + mixed_texts(400, 2))] + [(None, "no id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, piece int")
    found = packing.pack_documents(docs).collect()
    got = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=str)
    assert got == expected_pieces(library, rows)
    check_places(found)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack_documents(docs).collect() == []


def test_sequences_hold_the_ids(spark, library):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in packing.sequences(docs).collect():
        assert len(r.ids) <= 2048
        at = 0
        for part in r.parts:
            ids = [*library(dict(rows)[part.doc_id]), 0]
            start = dict(enumerate(packing.cut(len(ids))))[part.piece][0]
            assert part.offset == at and r.ids[at : at + part.length] == ids[start : start + part.length]
            at += part.length
        assert at == len(r.ids)


def plain_best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [(room, i) for i, room in enumerate(rooms) if room >= x]
        if fits:
            rooms[min(fits)[1]] -= x
        else:
            rooms.append(capacity - x)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit(seed):
    rng = random.Random(seed)
    lengths = np.array([rng.choice([rng.randrange(1, 2049), rng.randrange(1, 300)]) for _ in range(500)])
    bins, places, rooms = packing.best_fit(lengths)
    assert sorted(rooms.tolist()) == plain_best_fit(lengths.tolist(), 2048)
    for b in range(len(rooms)):
        own = sorted(zip(places[bins == b].tolist(), lengths[bins == b].tolist()))
        assert [p for p, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist()


def fewest(lengths, capacity):
    """The true number of bins of a small set, by trying all assignments."""
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i] and rooms[j] not in rooms[:j]:
                go(i + 1, [*rooms[:j], rooms[j] - lengths[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("capacity", [10, 13, 20])
def test_bound_never_exceeds_the_optimum(capacity):
    rng = random.Random(capacity)
    hit = 0
    for _ in range(150):
        lengths = sorted((rng.randrange(1, capacity + 1) for _ in range(8)), reverse=True)
        true = fewest(lengths, capacity)
        low = packing.bound(np.array(lengths), capacity)
        assert low <= true
        hit += low == true
    assert hit > 110
    assert packing.bound(np.array([6] * 5), 10) == 5


def test_exchange_saves_sequences(spark, monkeypatch):
    """Small partitions leave gaps; the documents they give up are packed better together."""
    monkeypatch.setattr(packing, "GROUP", 40)
    rng = random.Random(3)
    lengths = [rng.randrange(30, 1400) for _ in range(1200)]
    rows = [(i, i, 0, 0, n, 0) for i, n in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    monkeypatch.setattr(packing, "ROUNDS", 1)
    alone = check_places(packing.pack_pieces(pieces).collect())
    monkeypatch.setattr(packing, "ROUNDS", 4)
    found = packing.pack_pieces(pieces).collect()
    assert sorted(r.doc_id for r in found) == list(range(1200))
    assert packing.bound(np.array(lengths)) <= check_places(found) < alone
