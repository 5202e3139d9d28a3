"""Exact top-k by inner product against all pairs."""

import math

import brute
import numpy as np
import pytest
from compare import connect, differences

from chatlens.llm import innerproducts
from chatlens.llm.queries import ORACLE, QUERIES

SCHEMA = "vec_id long, embedding array<double>, row string, norm int, size int, first int, slice int"


def plain(rows, k=10):
    """(query_id, rank, vec_id, score) of every row whose id is divisible by 5, over distinct usable rows."""
    usable = set()
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(1024 * x) for x in v):
            continue
        usable.add((i, tuple(math.floor(1024 * x) for x in v)))
    out = []
    for i, v in sorted(usable):
        if i % 5 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in usable if len(w) == len(v) and (j, w) != (i, v))
            out += [(i, r, j, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "clash", 1, 2, 3, 4) for i, v in rows], SCHEMA)
    return sorted(map(tuple, innerproducts.top_inner_products(df, df.where("vec_id % 5 = 0"), **options).collect()))


@pytest.mark.parametrize("kind", ["unit", "lengths", "flat", "low rank", "copies"])
def test_equals_all_pairs(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 12))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    if kind == "lengths":
        x *= rng.lognormal(0, 2, (900, 1))
    elif kind == "flat":
        x = rng.integers(-2, 3, (900, 12)).astype(float)
    elif kind == "low rank":
        x = rng.standard_normal((900, 2)) @ rng.standard_normal((2, 12)) + 0.01 * x
    elif kind == "copies":
        x[100:700] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert found(spark, rows, head=100, part_bytes=20_000, slice_bytes=8_000) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, -1.0]), (5, [0.0, 0.0]), (10, []), (11, []), (15, [1.0]), (20, None),
        (25, [1.0, None]), (30, [math.nan, 1.0]), (35, [math.inf, 1.0]), (None, [1.0, 1.0]), (1, [-1.0, -2.0]), (2, [1.0, 2.0]),
        (40, [1e306, 0.0]), (45, [1e30, -1e30]), (46, [1e30, 1e30]), (47, [-1e30, 1e29]), (48, [1e170, 1.0]), (50, [1e170, -1e170]),
        (60, [0.00049, -0.00049]), (-5, [2.5, 2.5]), (55, [1e12, 1e12, 1.0]), (56, [1e12, -1e12, 1e-3]), (57, [1e12, -1e12, 5.0]),
    ] + [(100 + i, [1.0, 2.0]) for i in range(15)]
    for k in (3, 10, 50):
        assert found(spark, rows, k=k) == plain(rows, k)
    assert found(spark, []) == []
    assert found(spark, [(5, [1.0])]) == []


def test_bounds_drop_most_pairs():
    """With falling lengths and a fast spectrum hardly a pair is left to score, and none is lost."""
    rng = np.random.default_rng(6)
    y = np.floor(1024 * rng.standard_normal((6000, 32)) * np.exp(-np.arange(32) / 4) * rng.lognormal(0, 1, (6000, 1)))
    y = y[np.argsort(-(y * y).sum(1))]
    x = y[::60]
    norms = [np.sqrt((m * m).sum(1)) for m in (x, y)]
    turn = np.linalg.eigh(y.T @ y)[1][:, ::-1]
    best = innerproducts._search(
        (np.arange(100), np.zeros(100, int), x, norms[0]), (np.arange(6000), np.ones(6000, int), y, norms[1]),
        np.full(100, -math.inf), turn, 10, innerproducts.STAGES)
    truth = x @ y.T
    for q in range(100):
        want = np.lexsort((np.arange(6000), -truth[q]))[:10]
        assert best.vector[best.query == q].tolist() == want.tolist()
    sides = [innerproducts._prepared(m, n, turn, innerproducts.STAGES) for m, n in zip((x, y), norms)]
    reach = np.sort(truth, 1)[:, -10]
    by_length = (np.outer(*norms) >= reach[:, None]).mean()
    left = innerproducts._open_pairs(*sides, np.ones((100, 6000), bool), reach, 10).mean()
    assert by_length < 0.5 and left < 0.01


def test_given_vectors(spark, small):
    assert differences(QUERIES["op13_inner_products"](spark, small), connect(small), ORACLE["op13_inner_products"]) is None


def test_very_long_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((15, 3000)))]
    assert found(spark, rows) == plain(rows)
    assert brute.empty(spark).count() == 0
