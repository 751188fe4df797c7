from __future__ import annotations

import random

import numpy as np
import pytest

from dockpulse.llm import minhash, simhash


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or 100 * len(a & b) >= 80 * len(a | b)


def plain_groups(texts: dict):
    """node -> smallest node reachable, by comparing all pairs."""
    sets, root = {i: plain_set(t) for i, t in texts.items()}, {}
    for start in sorted(sets):
        todo = [] if start in root else [start]
        root.setdefault(start, start)
        while todo:
            at = todo.pop()
            for other in sets:
                if other not in root and similar(sets[at], sets[other]):
                    root[other] = start
                    todo.append(other)
    return root


def corpus():
    """Texts of 60 to 300 words, some short and empty ones, and copies of earlier texts with up to a few words replaced."""
    rng = random.Random(4)
    texts = ["", None, " \n", "one", "ONE ", "one two", "a b c d e", "a b c d f"]
    while len(texts) < 250:
        if len(texts) < 30 or rng.random() < 0.3:
            words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        else:
            words = (rng.choice(texts[8:]) or "").split()
            for _ in range(rng.choice([1, 1, 2, 3, 6, 12])):
                words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    return dict(enumerate(texts))


def blob(n=60):
    """Copies of one text, each with changes of its own: about 0.7 to 0.85 similar, so some pairs are linked and some are not, and no single copy has all links."""
    rng, words = random.Random(9), [f"b{i}" for i in range(120)]
    texts = {}
    for i in range(n):
        copy = list(words)
        for _ in range(rng.choice([1, 2, 3])):
            copy[rng.randrange(len(copy))] = f"c{rng.randrange(10**6)}"
        texts[1000 + i] = " ".join(copy)
    return texts


@pytest.mark.parametrize("block", [512, 4])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = corpus() | blob()
    groups = plain_groups(texts)
    assert 20 < len(texts) - len(set(groups.values())) < len(texts) - 20
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id bigint, text string, node string")
    kept = minhash.drop_near_duplicates(docs.repartition(3))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups.values()))


def test_near_copies_that_fingerprints_miss(spark):
    """The stage drops copies above 0.8 whose fingerprints differ in more than two bits."""
    import corpus_pipeline

    words = [f"w{i}" for i in range(200)]
    other = [f"new{i}" if i in (30, 80, 130, 170) else w for i, w in enumerate(words)]
    texts = {0: " ".join(words), 1: " ".join(other)}
    assert similar(plain_set(texts[0]), plain_set(texts[1]))
    a, b = map(simhash.fingerprint, texts.values())
    assert (a ^ b).bit_count() > 2
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [0]


def test_near_copies_that_shingles_miss(spark):
    """The stage goes by fingerprints too, and what links of both kinds connect is one group: 1 and 2 by fingerprint only, 2 and 3 by shingles only."""
    import corpus_pipeline

    line = "the same five word line " * 40
    ends = [" ".join(f"{name}{i}" for i in range(60)) for name in "xyz"]
    texts = {1: line + ends[0], 2: line + ends[1], 3: line + ends[1] + " short tail of five words" * 40, 4: ends[2]}
    bits, sets = ({i: of(t) for i, t in texts.items()} for of in (simhash.fingerprint, plain_set))
    pairs = [(1, 2), (2, 3), (1, 3)]
    assert [(bits[i] ^ bits[j]).bit_count() <= 2 for i, j in pairs] == [True, False, False]
    assert [similar(sets[i], sets[j]) for i, j in pairs] == [False, True, False]
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 4]


def test_common_shingles_are_counted_exactly(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 60)).astype(np.uint64)) for _ in range(40)]
    counts = minhash.common(sets)
    assert counts.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]


def test_links_of_a_block_span_it():
    rng = np.random.default_rng(2)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: 100 - k], rng.integers(1000, 10**6, k).astype(np.uint64)])) for k in rng.integers(2, 14, 50)]
    nodes, root = np.arange(50), np.arange(50) // 2
    found = minhash.spanning(nodes, root, sets, 80)
    assert len(found) < 25
    plain = [(i, j) for i in range(50) for j in range(i) if similar(set(sets[i].tolist()), set(sets[j].tolist()))]

    def groups(pairs):
        of = list(root)
        for a, b in pairs:
            of = [of[a] if x == of[b] else x for x in of]
        return {frozenset(i for i in range(50) if of[i] == g) for g in of}

    assert groups(found) == groups(plain)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert minhash.drop_near_duplicates(docs).collect() == []
