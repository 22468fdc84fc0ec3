import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import ann


def brute(vectors, queries, k):
    out = []
    for q in queries:
        near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(vectors[q], v))), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        out += [(q, r, i, d) for r, (d, i) in enumerate(near[:k], 1)]
    return out


def got(df, **how):
    rows = ann.nearest(df, F.col("vec_id") % 10 == 0, **how).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rows)


def same(a, b):
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert np.allclose([x[3] for x in a], [x[3] for x in b], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("kind,block", [("float", 4096), ("double", 7), ("float", 16)])
def test_equals_brute_force(spark, kind, block):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 9)).astype(np.float32)
    x[40:60] = x[0] + rng.normal(size=(20, 9)).astype(np.float32) * 1e-3  # many near ties
    x[61] = x[60]
    vectors = {i: [float(v) for v in row] for i, row in enumerate(x)}
    df = spark.createDataFrame(list(vectors.items()), f"vec_id long, embedding array<{kind}>")
    same(got(df, block=block), brute(vectors, range(0, 120, 10), 10))


def test_ties_go_to_the_smaller_id(spark):
    rows = [(0, [0.0, 1.0])] + [(i, [1.0, 1.0]) for i in range(30, 1, -1)]
    out = got(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4, block=5)
    assert [(r[0], r[2]) for r in out if r[0] == 0] == [(0, 2), (0, 3), (0, 4), (0, 5)]


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (10, None), (20, []), (30, [0.0, 0.0]), (40, [float("nan"), 1.0]), (50, [float("inf"), 1.0]),
        (1, [None, 1.0]), (None, [1.0, 1.0]), (2, [3.0, 4.0]), (3, [1.0, 2.0, 3.0]), (60, [9.0, 9.0, 9.0]),
    ]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, rank int, score double")
    same(got(df), [(0, 1, 2, math.sqrt(8)), (60, 1, 3, math.sqrt(64 + 49 + 36))])
    assert got(df.limit(0)) == []


def test_bounds_hold():
    rng = np.random.default_rng(6)
    q, c = rng.normal(size=(40, 33)) * 100, rng.normal(size=(500, 33)) * 100
    out = ann.tile(np.arange(40), q, np.arange(1000, 1500), c, 10, step=64)
    d = np.sqrt(((q[:, None] - c[None]) ** 2).sum(axis=2))
    for i in range(40):
        mine = out[out["query_id"] == i].sort_values(["score", "vec_id"])
        assert mine["vec_id"].tolist() == (np.argsort(d[i], kind="stable")[:10] + 1000).tolist()


@pytest.mark.parametrize("size", [1e200, 1e154, 3e307])
def test_components_whose_squares_leave_the_range(size):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 6)) * np.where(rng.random(60) < 0.5, size, 1.0)[:, None]
    v[0] = v[1] = size  # a tie at distance 0
    ids = np.arange(60)
    with np.errstate(all="ignore"):
        got = ann.tile(ids[:9], v[:9], ids, v, 5, step=16)
        wide = v.astype(np.longdouble)
        for i in range(9):
            d = np.sqrt(((wide[i] - wide) ** 2).sum(axis=1)).astype(float)
            want = sorted((x, j) for j, x in enumerate(d) if j != i)[:5]
            mine = sorted((r.score, r.vec_id) for r in got[got.query_id == i].itertuples())
            assert [j for _, j in mine] == [j for _, j in want]
            assert np.allclose([x for x, _ in mine], [x for x, _ in want], rtol=1e-12)
