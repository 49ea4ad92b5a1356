import random

import pytest
from pyspark.sql import functions as F

from kmerweave.llm import topk


def brute(rows, k, every):
    import math

    v = []
    for i, x in rows:
        if i is not None and x is not None and all(e is not None and math.isfinite(e) for e in x):
            v.append((i, [math.floor(256 * e) for e in x]))
    out = []
    for q, x in {i: x for i, x in v if i % every == 0}.items():
        got = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in v if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(got, 1)]
    return sorted(out)


@pytest.mark.parametrize(("scale", "pivots"), [(1.0, 8), (4e5, 5)])
def test_like_brute_force(spark, monkeypatch, scale, pivots):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "ANNULUS", 7)
    monkeypatch.setattr(topk, "GROUP", 3)
    rng = random.Random(9)
    # float32 values, so that both sides read the same numbers
    f = lambda x: float(__import__("numpy").float32(x * scale))
    rows = [(i, [f(rng.gauss(i % 4, 1)) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(50)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")]), (2003, []), (2004, [f(1.0)]), (2005, [float("inf")]), (2010, [0.0] * 6)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, q int").repartition(4)
    got = topk.top_k(d, F.col("id") % 10 == 0, pivots=pivots)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 10)


def test_few_rows(spark):
    rows = [(0, [1.0]), (50, [2.0]), (7, [-1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(d, F.col("id") % 50 == 0).collect())) == brute(rows, 5, 50)
    assert topk.top_k(d.limit(0), F.col("id") % 50 == 0).count() == 0
    assert topk.top_k(d.limit(1), F.lit(True)).count() == 0


def test_bounds_skip_blocks():
    import numpy as np

    pivots = topk.choose_pivots(np.array([[0.0, 0], [0, 0], [9, 0], [0, 5]]), 3)
    assert sorted(map(tuple, pivots)) == [(0.0, 0.0), (0.0, 5.0), (9.0, 0.0)]
