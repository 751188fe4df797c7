from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dockpulse.llm import suffix_tree, workspace

START, END = "<start>", "<end>"


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def is_held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


class Plain:
    """The same tree over dictionaries, one token at a time."""

    def __init__(self, rows, least_context, least_entry, least_divergence, depth, discount):
        self.learned = [words_of(t) for i, t in rows if not is_held_out(i)]
        self.depth = depth
        self.c = Counter(w for words in self.learned for w in [*words, END])
        self.n = sum(self.c.values())
        self.v = len(self.c)
        frequent = {w for w in self.c if self.c[w] >= suffix_tree.least(least_entry, self.n)}
        as_context = {w for w in frequent - {END} if self.c[w] >= suffix_tree.least(least_context, self.n)} | {START}
        counts: Counter = Counter()
        followed: Counter = Counter()
        for words in self.learned:
            row = [START, *words, END]
            for t in range(1, len(row)):
                for d in range(1, depth + 1):
                    if t < d or not set(row[t - d : t]) <= as_context:
                        break
                    followed[tuple(row[t - d : t])] += 1
                    if row[t] in frequent | {END}:
                        counts[tuple(row[t - d : t]), row[t]] += 1
        self.counts = {k: n for k, n in counts.items() if n >= suffix_tree.least(least_entry, self.n)}
        self.after: dict = {}
        for (context, w), n in self.counts.items():
            self.after.setdefault(context, {})[w] = n
        self.candidates = {s for s in self.after if followed[s] >= suffix_tree.least(least_context, self.n)}
        self.followed, self.discount = followed, discount
        self.kept = set(self.candidates)
        chosen = set()
        for s in self.candidates:
            gain, rest = 0.0, 1.0
            for w, n in self.after[s].items():
                share = n / followed[s]
                gain += share * math.log(self.chance(s, w) / self.chance(s[1:], w))
                rest -= share
            left = 1 - sum(max(n - discount, 0) / followed[s] for n in self.after[s].values())
            if gain + max(rest, 0) * math.log(left) >= least_divergence:
                chosen |= {s[i:] for i in range(len(s))}
        self.kept = chosen

    def base(self, w):
        return (self.c.get(w, 0) + 0.5) / (self.n + 0.5 * (self.v + 1))

    def chance(self, context, w):
        if not context:
            return self.base(w)
        if context not in self.kept:
            return self.chance(context[1:], w)
        own = self.after[context]
        rest = 1 - sum(max(n - self.discount, 0) / self.followed[context] for n in own.values())
        return max(own.get(w, 0) - self.discount, 0) / self.followed[context] + rest * self.chance(context[1:], w)

    def score(self, text):
        row = [START, *words_of(text), END]
        base = sum(math.log10(self.base(w)) for w in row[1:])
        total = 0.0
        for t in range(1, len(row)):
            context: tuple = ()
            for d in range(1, self.depth + 1):
                if t < d or tuple(row[t - d : t]) not in self.kept:
                    break
                context = tuple(row[t - d : t])
            total += math.log10(self.chance(context, row[t]))
        return base, total


def corpus():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    rows = [(0, None), (1, ""), (2, " \x0b\n"), (3, "ONE One öne ÖNE"), (None, "no id"), (5, "twice a a a"), (5, "twice a a a"), (6, "the same line again " * 40)]
    for i in range(7, 160):
        text, at = [], 0
        for _ in range(int(rng.integers(1, 60))):
            at = int((at * 3 + rng.integers(0, 4)) % 30)
            text.append(words[at].upper() if rng.random() < 0.1 else words[at])
        rows.append((i, "\t ".join(text) + (f" rare{i}" if i % 3 == 0 else "")))
    return rows


@pytest.mark.parametrize(
    "least_context, least_entry, block, size",
    [(suffix_tree.LEAST_CONTEXT, suffix_tree.LEAST_ENTRY, 4096, 16 << 20), (5e-5, 5e-6, 4096, 400), (0.01, 0.002, 20, 16 << 20)],
)
def test_scores_are_those_of_the_plain_tree(spark, monkeypatch, least_context, least_entry, block, size):
    monkeypatch.setattr(suffix_tree, "LEAST_CONTEXT", least_context)
    monkeypatch.setattr(suffix_tree, "LEAST_ENTRY", least_entry)
    monkeypatch.setattr(suffix_tree, "BLOCK_ROWS", block)
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", size)
    rows = corpus()
    plain = Plain(rows, least_context, least_entry, suffix_tree.LEAST_DIVERGENCE, suffix_tree.DEPTH, suffix_tree.DISCOUNT)
    assert plain.kept and len(plain.kept) < len(plain.candidates)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, block string")
    found = suffix_tree.score(docs.repartition(3)).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for r in found:
        words = words_of(texts[r.doc_id])
        base, score = plain.score(texts[r.doc_id])
        assert r.held_out == is_held_out(r.doc_id)
        assert r.n_tokens == len(words) + 1
        assert r.n_known == sum(plain.c[w] > 0 for w in [*words, END])
        assert r.train_tokens == plain.n
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=1e-9)


def test_chances_sum_to_one():
    plain = Plain(corpus(), 0.01, 0.002, 0.01, 3, 0.75)
    for context in [(), *sorted(plain.kept)[:40]]:
        total = sum(plain.chance(context, w) for w in [*plain.c, "never seen"])
        assert total == pytest.approx(1.0)


def test_held_out_texts_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in suffix_tree.score(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert sum(r.score > r.base_score for r in rows) > 0.8 * len(rows)


def test_nothing_to_learn_from(spark):
    schema = "doc_id bigint, text string"
    assert suffix_tree.score(spark.createDataFrame([], schema)).collect() == []
    held = next(i for i in range(100) if is_held_out(i))
    (row,) = suffix_tree.score(spark.createDataFrame([(held, "a b")], schema)).collect()
    assert (row.train_tokens, row.n_tokens, row.n_known) == (0, 3, 0)
    assert row.score == row.base_score == pytest.approx(0.0)


def test_counts_needed_do_not_rise_with_the_corpus(spark):
    """A phrase seen five times in 400 000 other tokens is a context: by shares of all tokens it would need twenty occurrences."""
    learned = [i for i in range(100) if not is_held_out(i)]
    rows = [(i, "alpha beta gamma") for i in learned[:5]] + [(learned[5], "x " * 400_000)]
    held = next(i for i in range(100) if is_held_out(i))
    docs = spark.createDataFrame([*rows, (held, "alpha beta gamma")], "doc_id bigint, text string")
    (found,) = [r for r in suffix_tree.score(docs).collect() if r.held_out]
    assert found.score > found.base_score + 5


def test_what_a_run_keeps_on_disk(spark, monkeypatch, tmp_path):
    """Only what the result is still to be computed from is left; tables and shuffle files of steps that are over are gone."""
    monkeypatch.setattr(workspace, "shared_dir", lambda _: str(tmp_path))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = suffix_tree.score(docs)
    left = {re.sub(r"-[0-9a-f]{32}$", "", p.name) for p in tmp_path.glob("llm/*")}
    assert left == {"blocks", *(f"grams-{k}" for k in range(1, suffix_tree.DEPTH + 2)), *(f"rests-{k}" for k in range(1, suffix_tree.DEPTH + 1))}
    assert found.count() == docs.count()


def test_a_gram_is_asked_for_in_a_few_bytes():
    """Pairs of a block of random words, most of them different, take less than 8 bytes each; with key, prefix, suffix and count they took 29."""
    rng = np.random.default_rng(1)
    words = np.sort(rng.integers(0, 1 << 62, 2000).astype(np.uint64))
    place = rng.integers(0, 2000, 100_000).astype(np.uint32)
    row = {"block": 0, "size": [50_000, 50_000], "held_out": [False, True], "words": suffix_tree._pack(words), "place": suffix_tree._pack(place)}
    block = suffix_tree.Block(row, 4)
    single = block.single()
    pairs = block.longer(2, single, np.arange(len(single.a)) + (3 << suffix_tree.RANK_BITS))
    assert len(pairs.a) > 90_000
    assert block.asks(pairs).nbytes < 8 * len(pairs.a)
    assert block.asks(pairs).column("shard").to_pylist() == [0, 1, 2, 3]


def test_parts_that_ask_each_other_find_the_plain_tree(spark, monkeypatch):
    """Many shards, a few to a part, so that contexts and suffixes of an entry are in other parts than itself."""
    monkeypatch.setattr(suffix_tree, "SHARD_WORDS", 300)
    monkeypatch.setattr(suffix_tree, "PART_SHARDS", 3)
    monkeypatch.setattr(suffix_tree, "BLOCK_ROWS", 60)
    rows = corpus()
    plain = Plain(rows, suffix_tree.LEAST_CONTEXT, suffix_tree.LEAST_ENTRY, suffix_tree.LEAST_DIVERGENCE, suffix_tree.DEPTH, suffix_tree.DISCOUNT)
    texts = dict(rows)
    found = suffix_tree.score(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.base_score, r.score) == pytest.approx(plain.score(texts[r.doc_id]), rel=1e-9)


def test_the_divergence_test_writes_few_rows(spark, monkeypatch):
    """Rows are per block and shard or per pair of parts. With a row per entry and context, the JVM took 529 of 1439 CPU seconds a GB."""
    written, write = {}, workspace.Passing.write

    def counting(self, frame, name):
        table = write(self, frame, name)
        written[name] = table.count()
        return table

    monkeypatch.setattr(workspace.Passing, "write", counting)
    suffix_tree.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert max(written.values()) < 100


def test_order_by_parts_whatever_their_width():
    rng = np.random.default_rng(2)
    ids = lambda shards, ranks, n: rng.integers(0, shards, n).astype(np.uint64) << np.uint64(suffix_tree.RANK_BITS) | rng.integers(0, ranks, n).astype(np.uint64)
    cases = [(rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2), np.zeros(500, np.uint64))]
    cases += [(ids(*size, 5000), ids(*size, 5000)) for size in ((1, 1), (1, 40), (5, 9), (3000, 1 << 18), (1 << 20, 1 << 30), (1 << 31, 3))]
    for a, b in cases:
        a, b = np.append(a, a[:50]), np.append(b, b[:50])
        order, new = suffix_tree._by_parts(a, b)
        rising = sorted(zip(a.tolist(), b.tolist()))
        assert list(zip(a[order].tolist(), b[order].tolist())) == rising
        assert new.tolist() == [i == 0 or rising[i] != rising[i - 1] for i in range(len(rising))]


@pytest.mark.parametrize("most", [1, 20, 1 << 20, 1 << 31])
def test_equal_pairs_whatever_their_width(most):
    rng = np.random.default_rng(4)
    number = rng.integers(max(0, most - 20), most, 2000).astype(np.int32)
    places = np.sort(rng.choice(np.arange(1, 2000), 900, replace=False)).astype(np.int32)
    first, second, at, begins = suffix_tree._alike(number, places)
    where: dict = {}
    for p in places.tolist():
        where.setdefault((int(number[p - 1]), int(number[p])), set()).add(p)
    assert list(zip(first.tolist(), second.tolist())) == sorted(where)
    assert [set(g.tolist()) for g in np.split(at, begins[1:])] == [where[k] for k in sorted(where)]


def test_packs_keep_numbers_of_any_width():
    for values in ([], [0, 0], [255, 256], [1 << 16, 0], [1 << 32, 7], [-1, 5], [-(1 << 62), 3]):
        array = np.array(values, np.int64)
        assert suffix_tree._unpack(suffix_tree._pack(array), np.int64).tolist() == values
    shares = np.array([0.1, np.nan, -3.0])
    np.testing.assert_array_equal(suffix_tree._unpack(suffix_tree._pack(shares), np.float64), shares)
    assert len(suffix_tree._pack(np.arange(1000) % 256)) < 2 * 1000
