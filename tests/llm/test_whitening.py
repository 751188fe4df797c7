"""Whitening against a dense eigensolver."""

from __future__ import annotations

import math

import numpy as np
import pytest

from dockpulse.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, x string, id int"


def plain(rows, components=16):
    """(vec_id, component) -> (n, deviation, |whitened|, explained) of rows of one length."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in kept])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    y = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = []
    for (i, _), row in zip(kept, x):
        deviation = sum((n * int(v) - s) ** 2 for v, s in zip(row, sums))
        for c in range(min(components, len(values))):
            if values[c] > 1e-9 * values.sum():
                white = float((row - fit.mean(axis=0)) @ vectors[:, c]) / math.sqrt(values[c])
                found.append((i, c + 1, n, deviation, white, values[c] / values.sum()))
    return found


def compare(found, wanted):
    assert len(found) == len(wanted)
    by = lambda r: ((r[0] is None, r[0] or 0), r[1], r[3])
    found, wanted = sorted((tuple(r) for r in found), key=by), sorted(wanted, key=by)
    signs: dict = {}
    for f, w in zip(found, wanted):
        assert f[:4] == w[:4]
        assert f[5] == pytest.approx(w[5], rel=1e-9)
        assert f[6] <= 1e-9
        sign = signs.setdefault(f[1], 1 if abs(f[4] - w[4]) < abs(f[4] + w[4]) else -1) if abs(w[4]) > 0.01 else signs.get(f[1])
        if sign:
            assert f[4] == pytest.approx(sign * w[4], abs=1e-6)


def corpus(length, n, seed=3):
    rng = np.random.default_rng(seed)
    turn = rng.standard_normal((length, length)) * np.linspace(3, 0.5, length)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.standard_normal((n, length)) @ turn.T)]
    same = rows[5][1]
    rows += [(10_000 + i, same) for i in range(n // 3)]  # a vector with many copies
    rows += [(1, rows[1][1]), (None, rows[2][1]), (20_000, None), (20_001, []), (20_002, [math.nan, *same[1:]])]
    return rows + [(20_003, [*same[1:], None]), (20_004, [math.inf, *same[1:]])]


@pytest.mark.parametrize("length, n, tasks", [(64, 600, 64), (100, 900, 1), (20, 300, 64), (3, 50, 64)])
def test_rows_are_those_of_a_dense_solver(spark, monkeypatch, length, n, tasks):
    monkeypatch.setattr(whitening, "DIRECT_TASKS", tasks)
    rows = corpus(length, n)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows] + [(7, [1.0] * (length + 1), "other length", 2)], SCHEMA).repartition(6)
    compare(whitening.whiten(frame).collect(), plain(rows))


def test_components_of_no_variance_are_left_out(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.standard_normal(2) @ rng.standard_normal((2, 40)).round()).tolist()) for i in range(1)]
    base = rng.integers(-5, 5, (2, 40))
    rows = [(i, (a * base[0] + b * base[1]).astype(float).tolist()) for i, (a, b) in enumerate(rng.integers(-9, 9, (80, 2)))]
    found = whitening.whiten(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)).collect()
    compare(found, plain(rows))
    assert {r.component for r in found} == {1, 2}


def test_equal_eigenvalues(spark):
    """Every pair of opposite unit vectors once: all 40 eigenvalues are the same, any orthonormal vectors are right."""
    rows = [(2 * i + s, [(2.0 * s - 1) * (i == j) for j in range(40)], "", 0) for i in range(40) for s in (0, 1)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 80 * 16
    assert all(r.identity_error < 1e-9 and r.explained == pytest.approx(1 / 40) for r in found)


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, "", 0), (2, [], "", 0)], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "", 0)] * 3, SCHEMA)).collect() == []


def test_deviations_are_exact():
    x = np.array([[3, -4], [2**40, 1]])
    assert whitening.deviations(x, 10**5, [7, 9]) == [(3 * 10**5 - 7) ** 2 + (4 * 10**5 + 9) ** 2, None]
    assert whitening.deviations(x, 3, [7, 9]) == [2**2 + 21**2, None]
    assert whitening._sums(np.array([[2**45, 1], [2**45, -1]])) == ([2**46, 0], 2**91 + 2)


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    compare(queries.op13_whitening(spark, sf_dir).collect(), plain([(r.vec_id, r.embedding) for r in table]))
