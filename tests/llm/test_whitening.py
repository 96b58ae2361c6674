"""Whitening against exact rational sums and numpy, with every odd case."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from tidewatch.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n string, component int, whitened string"


def _vectors(n, d, seed=5, spread=1.0):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d)) * np.geomspace(1, 0.02, d)
    return (rng.normal(size=(n, d)) @ mix * spread + rng.normal(size=d)).tolist()


def _frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "clash", 1, "clash") for i, v in rows], SCHEMA).repartition(parts)


def _brute(vectors):
    x = [[math.floor(64 * c) + 1000000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    c = [[n * r[j] - s[j] for j in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in c), n**3)) for j in range(d)] for i in range(d)])
    return c, v


@pytest.mark.parametrize("n,d,fan_in", [(60, 3, 2), (300, 8, 32), (40, 40, 3)])
def test_whitened_is_what_exact_sums_give(spark, n, d, fan_in):
    vectors = _vectors(n, d)
    got = whitening.whitened(_frame(spark, enumerate(vectors), 7), 32, fan_in).collect()
    c, v = _brute(vectors)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    k = int((values[:32] > np.trace(v) * d * 2**-52).sum())
    y = np.array(c) / n @ (axes / np.sqrt(np.maximum(values, 1e-300)))
    assert len(got) == n * k and {r["n"] for r in got} == {n} and all(r["identity_error"] <= 1e-9 for r in got)
    signs = {}
    for r in sorted(got, key=lambda r: -abs(r["whitened"])):
        i, j = r["vec_id"], r["component"] - 1
        sign = signs.setdefault(j, np.sign(y[i, j]) * np.sign(r["whitened"]))
        assert r["whitened"] == pytest.approx(sign * y[i, j], abs=1e-8)
        assert r["deviation"] == sum(e * e for e in c[i])
        assert r["explained"] == pytest.approx(values[j] / np.trace(v), rel=1e-9)


def test_products_are_exact_far_from_zero(spark):
    rng = np.random.default_rng(1)
    c = rng.integers(-(1 << 46), 1 << 46, size=(3000, 4))
    total = whitening.DoubleDouble(np.zeros((4, 4)))
    for at in range(0, 3000, whitening.BLOCK):
        for product in whitening.outer_products(c[at : at + whitening.BLOCK]):
            total.add(product)
    for i in range(4):
        for j in range(4):
            assert int(total.high[i, j]) + int(total.low[i, j]) == sum(int(r[i]) * int(r[j]) for r in c)


def test_odd_vectors_take_no_part(spark):
    vectors = _vectors(30, 4)
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [1.0, math.nan, 0.0, 0.0]), (104, [math.inf, 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0, 0.0])]
    rows = [*enumerate(vectors), (None, vectors[3]), (5, vectors[5])]
    clean = whitening.whitened(_frame(spark, rows)).collect()
    got = whitening.whitened(_frame(spark, rows + odd, 5)).collect()
    key = lambda r: (r["vec_id"] is None, r["vec_id"], r["component"], r["whitened"])
    assert len(got) == 32 * 4 and sum(r["vec_id"] is None for r in got) == 4 and sum(r["vec_id"] == 5 for r in got) == 8
    for a, b in zip(sorted(clean, key=key), sorted(got, key=key), strict=True):
        assert a["vec_id"] == b["vec_id"] and a["deviation"] == b["deviation"] and a["whitened"] == pytest.approx(b["whitened"], abs=1e-9)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)]):
        assert whitening.whitened(_frame(spark, rows)).collect() == []
    flat = [(i, [float(i), 1.0, 2.0 * i]) for i in range(9)]
    assert {r["component"] for r in whitening.whitened(_frame(spark, flat)).collect()} == {1}
