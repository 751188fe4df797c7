from __future__ import annotations

import math
import random
import re

import duckdb
import pytest

from dockpulse.llm import mixing


def plain_targets(sizes: dict, weights=(5, 2, 1), budget=1.5, most=2):
    """Share, cap, and share what was cut off among the others, until nothing is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        rest = budget * sum(sizes.values()) - sum(target.values())
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total >= most * sizes[s]}
        if not over:
            return target | {s: rest * weight[s] / total for s in open_}
        target |= {s: float(most * sizes[s]) for s in over}
        open_ -= over
    return target


def plain_tilt(sizes: list, goal: float, most=2):
    """The dual solution by bisection."""
    sizes = [s for s in sizes if s]
    mean = sum(sizes) / len(sizes)
    low, high = -500.0, 500.0
    for _ in range(200):
        tilt = (low + high) / 2
        taken = sum(s * most / (1 + math.exp(-max(-700.0, min(700.0, tilt * s / mean)))) for s in sizes)
        low, high = (tilt, high) if taken < goal else (low, tilt)
    return tilt


def corpus(n=3000, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "a", "b", "c", "é", "Z", "d", None])
        rows.append((i, "w " * min(5000, int(rng.lognormvariate(3.5, 1.2))), source))
    return [*rows, (n, None, "a"), (n + 1, "", None), (n + 2, None, "nothing"), (5, "same row", "b"), (5, "same row", "b")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, source string, size int")


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def mixed_rows(spark):
    rows = corpus()
    return rows, mixing.mix(frame(spark, rows)).collect()


def test_targets(mixed_rows):
    rows, found = mixed_rows
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size_of(text)
    goals = plain_targets(sizes)
    assert len(found) == len(rows)
    for r in found:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(goals[r.source])
    assert sum(goals.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_copies_come_near_the_targets(mixed_rows):
    rows, found = mixed_rows
    for source in {r.source for r in found}:
        own = [r for r in found if r.source == source]
        longest = max(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= longest / 2 + 1
    assert all(0 <= r.copies <= 2 and r.taken == r.copies * r.size for r in found)


def test_rates_are_the_dual_solution(spark, mixed_rows):
    rows, found = mixed_rows
    data: dict = {}
    for r in found:
        data.setdefault(r.source, []).append(r.size)
    goals = {r.source: r.target for r in found}
    counts: dict = {}
    for s, sizes in data.items():
        for size in sizes:
            counts[s, size] = counts.get((s, size), 0) + 1
    table = spark.createDataFrame([(*k, n) for k, n in counts.items()], "source string, size bigint, n bigint")
    goal_rows = [(s, sum(data[s]), float(g)) for s, g in goals.items()]
    goal_table = spark.createDataFrame(goal_rows, "source string, source_size bigint, target double")
    dual = {r.source: r for r in mixing.tilts(table, goal_table).collect()}
    assert dual
    for s, r in dual.items():
        assert r.tilt == pytest.approx(plain_tilt(data[s], goals[s]), rel=1e-3, abs=1e-4)


def test_reruns_agree(spark, mixed_rows):
    rows, found = mixed_rows
    shuffled = frame(spark, random.Random(9).sample(rows, len(rows))).repartition(7)
    again = mixing.mix(shuffled).collect()
    key = lambda r: (r.doc_id, str(r.source), r.size, r.taken)
    assert sorted(map(key, found)) == sorted(map(key, again))


@pytest.mark.parametrize("group", [1 << 16, 5])
def test_groups_of_equal_documents(spark, monkeypatch, group):
    monkeypatch.setattr(mixing, "GROUP", group)
    rows = [(i, "one two three", "a") for i in range(300)] + [(i, "w " * 40, "b") for i in range(300, 340)]
    rows += [(i, "x", "c") for i in range(340, 360)]
    found = mixing.mix(frame(spark, rows)).collect()
    for source in "abc":
        own = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)


def test_documents(spark):
    rows = corpus(400)
    docs = frame(spark, rows)
    times: dict = {}
    for r in mixing.mix(docs).collect():
        times.setdefault((r.doc_id, r.size), []).append(r.copies if r.size else 1)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got: dict = {}
    for r in out.collect():
        got[r.doc_id, size_of(r.text)] = got.get((r.doc_id, size_of(r.text)), 0) + 1
    assert got == {k: sum(v) for k, v in times.items() if sum(v)}


def test_empty(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    assert mixing.mixed(frame(spark, [])).collect() == []
    assert [r.taken for r in mixing.mix(frame(spark, [(1, None, None)])).collect()] == [0]


def test_whole_words(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    sizes = {i: size_of(t) for i, t in duckdb.connect().execute(f"select doc_id, text from '{path}'").fetchall()}
    assert {r.doc_id: r.size for r in mixing.mix(spark.read.parquet(path)).collect()} == sizes


@pytest.mark.parametrize("weights, budget", [((5, 2, 1), 1.5), ((1,), 0.3), ((7, 1), 1.9), ((5, 2, 1), 2.0)])
def test_targets_of_many_sources(spark, weights, budget):
    """A source per host, many of them full in turn, with ties, empty ones and none; a window without a key would be one task."""
    rng = random.Random(8)
    sizes = {f"h{i}": rng.choice([0, 3, 3, int(rng.lognormvariate(4, 2.5))]) for i in range(3000)} | {None: 17, "é": 40}
    sources = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint").repartition(5)
    found = mixing.targets(sources, weights, budget)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    goals = plain_targets(sizes, weights, budget)
    assert {r.source: r.target for r in found.collect()} == pytest.approx(goals, rel=1e-9)
    assert mixing.targets(sources.limit(0), weights, budget).collect() == []
    nothing = spark.createDataFrame([("a", 0), (None, 0)], "source string, source_size bigint")
    assert [r.target for r in mixing.targets(nothing, weights, budget).collect()] == [0.0, 0.0]
