from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dockpulse.llm import simhash
from dockpulse.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps: dict):
    """fps: node -> fingerprint. node -> smallest node reachable, by comparing all pairs."""
    nodes, root = sorted(fps), {}
    for start in nodes:
        if start in root:
            continue
        todo = [start]
        root[start] = start
        while todo:
            at = todo.pop()
            for other in nodes:
                if other not in root and (fps[at] ^ fps[other]).bit_count() <= 2:
                    root[other] = start
                    todo.append(other)
    return root


TEXTS = ["", None, " \t\n", "one", "One  two", "one TWO", "a b c", "É a B c d", "é A b c d", "x " * 5000, "\x0b\x0ca b\rc"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    row = spark.createDataFrame([("the quick é",)], "t string").select(F.xxhash64("t")).first()
    assert row[0] & (2**64 - 1) == xxhash.xxh64("the quick é".encode(), seed=42).intdigest()


def test_code_words_of_neighbours_meet():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)

    def sets(values):
        at, index = simhash.codewords(values)
        found = defaultdict(set)
        for a, i in zip(at.tolist(), index.tolist()):
            found[a].add(i)
        return found

    own = sets(words)
    assert {len(s) for s in own.values()} == {1, 6}
    for bit in range(23):
        other = sets(words ^ (1 << bit))
        assert all(own[i] & other[i] for i in range(len(words)))


def test_keys_meet_within_two_bits():
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(300)]
    near = [f ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2]))) for f in fps]

    def sets(values):
        at, key = simhash.keys(np.array(values, np.uint64))
        found = defaultdict(set)
        for a, k in zip(at.tolist(), key.tolist()):
            found[a].add(k)
        return found

    a, b = sets(fps), sets(near)
    assert all(a[i] & b[i] for i in range(len(fps)))


def cloud(n, seed=3):
    """Fingerprints of which many differ in few bits, in chains."""
    rng = random.Random(seed)
    fps = [0, rng.getrandbits(64)]
    while len(fps) < n:
        base = rng.choice(fps) if rng.random() < 0.9 else rng.getrandbits(64)
        fps.append(base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3]))))
    return fps


@pytest.mark.parametrize("block", [4096, 16])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    fps = dict(enumerate(cloud(700)))
    fps[5] = fps[4]
    signed = [(i, i, f - 2**64 if f >> 63 else f) for i, f in fps.items()]
    prints = spark.createDataFrame(signed, "uid bigint, doc_id bigint, fp bigint")
    found = {r["doc_id"]: r["component_id"] for r in simhash.grouped(prints).collect()}
    assert found == plain_groups(fps)
    assert len(set(found.values())) < len(fps) - 100


def test_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "", "x"), (3, "one", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    found = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    groups = plain_groups({i: plain_fingerprint(t) for i, t in enumerate(TEXTS)})
    expected = [(i, f"{plain_fingerprint(t):016x}", groups[i]) for i, t in enumerate(TEXTS)]
    expected += [(None, "0" * 16, 0), (3, expected[3][1], 3)]
    assert sorted(found, key=str) == sorted(expected, key=str)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups.values()))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.drop_near_duplicates(docs).collect() == []


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100)] + [(200, 200 + i) for i in range(1, 50)]
    pairs += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    found = components(spark.createDataFrame(pairs, "a bigint, b bigint"))
    assert {r["node"]: r["root"] for r in found.collect()} == {x: find(x) for x in list(root)}
