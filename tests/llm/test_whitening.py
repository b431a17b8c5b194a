"""Whitening against a plain eigenvalue computation, and its exact parts against integers."""

import math

import numpy as np
import pytest

from surveyspark.llm import whitening as wh

SCHEMA = "vec_id bigint, embedding array<float>, vector string, n int"


def frame(spark, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def random_rows(n=300, d=12, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * (1 + np.arange(d))).astype(np.float32)


def test_polynomial_is_exact():
    rng = np.random.default_rng(5)
    b = rng.integers(-9, 9, (6, 4))
    matrix = (b @ b.T).astype(object)  # two roots are zero
    primes = wh.primes_for(matrix)
    residues = wh.polynomials_mod(matrix, primes)
    # Faddeev-LeVerrier on integers.
    m, want = np.zeros((6, 6), object), [1]
    for k in range(1, 7):
        m = matrix @ m + want[-1] * np.eye(6, dtype=int).astype(object)
        want.append(-int(np.trace(matrix @ m)) // k)
    for row, p in zip(residues, primes):
        assert row.tolist() == [c % p for c in reversed(want)]


def test_roots_count_repeats():
    # (x - 7)^2 (x - 3) x
    poly = [0, -147, 91, -17, 1]
    assert [wh.roots_above(poly, a) for a in (-1, 0, 2, 3, 6, 7)] == [4, 3, 3, 2, 2, 0]
    found = wh.largest_roots(poly, 20, 17, 4)
    assert [(r / (1 << 20), m) for r, m in found] == [(7.0, 2), (3.0, 1), (0.0, 1)]


def test_whitened_equals_plain_computation(spark):
    vectors = list(random_rows())
    vectors += [None, [None] * 12, [math.nan] + [0.0] * 11, [math.inf] + [0.0] * 11, [1.0, 2.0], [], [0.0] * 12, vectors[0]]
    got = wh.whitened(frame(spark, vectors)).collect()
    used = [i for i, v in enumerate(vectors) if v is not None and len(v) == 12 and all(x is not None and math.isfinite(x) for x in v)]
    x = np.floor(1024 * np.array([vectors[i] for i in used], np.float64)).astype(np.int64) + 100000
    n, s = len(used), x.sum(axis=0)
    centred = x - s / n
    value, axes = np.linalg.eigh(centred.T @ centred / n)
    value, axes = value[::-1][:8], axes[:, ::-1][:, :8]
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(i, int(v)) for i, v in zip(used, ((n * x - s) ** 2).sum(axis=1))}
    table = np.zeros((n, 8))
    for r in got:
        table[used.index(r["vec_id"]), r["component"] - 1] = r["whitened"]
        assert r["explained"] == pytest.approx(value[r["component"] - 1] / np.trace(centred.T @ centred / n), rel=1e-12)
        assert r["identity_error"] < 1e-12
    want = centred @ axes / np.sqrt(value)
    signs = np.sign((table * want).sum(axis=0))
    assert np.allclose(table * signs, want, atol=1e-9)


def test_equal_roots_and_lost_rank(spark):
    # Twelve dimensions, four with variance, two pairs of them alike.
    rows = [[s * a if j == i else 0.0 for j in range(12)] for i, a in enumerate((2, 2, 1, 1)) for s in (1, -1)]
    got = wh.whitened(frame(spark, rows)).collect()
    assert len(got) == 8 * 8
    table = np.full((8, 8), np.nan)
    for r in got:
        if r["whitened"] is not None:
            table[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.allclose(table[:, :4].T @ table[:, :4] / 8, np.eye(4)) and np.isnan(table[:, 4:]).all()
    assert {r["component"]: round(r["explained"], 12) for r in got} == {1: .4, 2: .4, 3: .1, 4: .1, 5: 0, 6: 0, 7: 0, 8: 0}
    assert {r["identity_error"] < 1e-12 for r in got} == {True}


def test_small_tables(spark):
    assert wh.whitened(frame(spark, [])).collect() == []
    assert wh.whitened(frame(spark, [None])).collect() == []
    one = wh.whitened(frame(spark, [[1.0, 2.0]])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]


def test_large_entries_stay_exact(spark):
    rows = [[2.0 ** 40, 1.0], [-2.0 ** 40, 3.0], [2.0 ** 41, 7.0]]
    got = wh.whitened(spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>")).collect()
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in rows]
    s = [sum(c) for c in zip(*x)]
    exact = {i: sum((3 * c - t) ** 2 for c, t in zip(v, s)) for i, v in enumerate(x)}
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(i, v if v < 1 << 63 else None) for i, v in exact.items()}
    assert {r["identity_error"] < 1e-6 for r in got} == {True}
    with pytest.raises(Exception, match="too large"):
        wh.whitened(spark.createDataFrame([(1, [2.0 ** 60, 0.0])], "vec_id bigint, embedding array<double>"))
