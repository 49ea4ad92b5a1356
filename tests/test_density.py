"""The spanning tree of mutual reachability and its cuts, against loops over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerweave.operators import density


def cloud(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8)) * 6
    x = np.concatenate([centres[rng.integers(0, 6, n - 40)] + rng.normal(size=(n - 40, 8)), rng.normal(size=(30, 8)) * 15, np.repeat(centres[:1], 10, axis=0)])
    return x


def literal_tree(x, samples):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(samples, len(x)) - 1]
    m = np.maximum(np.maximum(d, core[:, None]), core[None])
    edges = sorted((m[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x)))
    up, tree = list(range(len(x))), []

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for w, i, j in edges:
        a, b = find(i), find(j)
        if a != b:
            up[a] = b
            tree.append((i, j, w))
    return core, tree


@pytest.fixture(scope="module")
def found(spark):
    x = cloud(500, 1)
    df = spark.createDataFrame([(i, v.tolist(), "k") for i, v in enumerate(x)], "id long, v array<double>, block string").repartition(4)
    return x, df, density.spanning_tree(df, "id", "v", 5, 40)


def test_core_distances(spark):
    x = cloud(300, 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    rows, apart = density.blocks(df, "id", "v", 30)
    assert rows.groupBy("block").count().agg(F.max("count")).first()[0] < 300
    got = {r.id: r.core for r in density.core_distances(rows, apart, 5).collect()}
    assert np.allclose([got[i] for i in range(300)], literal_tree(x, 5)[0])


def test_tree_of_500(found):
    x, _, tree = found
    _, want = literal_tree(x, 5)
    got = sorted((r.a, r.b, r.weight) for r in tree.collect())
    assert len(got) == 499 and np.isclose(sum(w for *_, w in got), sum(w for *_, w in want))
    assert [(a, b) for a, b, _ in got] == sorted((a, b) for a, b, _ in want)


def test_cuts(spark, found):
    x, df, tree = found
    _, want = literal_tree(x, 5)
    for distance, least in ((2.5, 5), (4.0, 20)):
        label = list(range(len(x)))
        for a, b, w in want:
            if w <= distance:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if c == old else c for c in label]
        expected = {i: c if label.count(c) >= least else None for i, c in enumerate(label)}
        got = {r.id: r.cluster for r in density.clusters(tree, df.select("id"), distance, least).collect()}
        assert got == expected
        row = density.profile(tree, df.select("id"), [distance], least).first()
        kept = [c for c in expected.values() if c is not None]
        assert (row.n_clusters, row.n_noise, row.largest) == (len(set(kept)), len(x) - len(kept), max(map(kept.count, set(kept))))


def test_merging_by_tables(spark, monkeypatch):
    x = cloud(90, 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    here = sorted(map(tuple, density.spanning_tree(df, "id", "v", 4, 20).collect()))
    monkeypatch.setattr(density, "DRIVER_EDGES", 0)
    assert here == sorted(map(tuple, density.spanning_tree(df, "id", "v", 4, 20).collect()))
    assert [(a, b) for a, b, _ in here] == sorted((a, b) for a, b, _ in literal_tree(x, 4)[1])


def test_small_inputs(spark):
    schema = "id long, v array<double>"
    assert density.spanning_tree(spark.createDataFrame([], schema), "id", "v").count() == 0
    bad = [(1, None), (2, [float("nan"), 1.0]), (3, [1.0, 2.0])]
    assert density.spanning_tree(spark.createDataFrame(bad, schema), "id", "v").count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(7)], schema)
    assert [(r.a, r.b, r.weight) for r in density.spanning_tree(same, "id", "v", 3).orderBy("b").collect()] == [(0, i, 0.0) for i in range(1, 7)]


def test_grid_of_cells(spark, monkeypatch):
    """Blocks are dealt out over cells, not joined by pairs; neighbours and tree are those of all pairs, copies too."""
    monkeypatch.setattr(density, "VALUES", 512)
    monkeypatch.setattr(density, "TILE", 1024)
    monkeypatch.setattr(density, "LISTED", 3)
    x = np.concatenate([cloud(130, 4), np.repeat([[1.5] * 8], 40, axis=0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    rows, apart = density.blocks(df, "id", "v", 20)
    monkeypatch.setattr(density, "BLOCK", 16)
    got = {r.id: [n.id for n in r.near] for r in density.neighbours(rows, apart, 6).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert got == {i: np.lexsort((np.arange(len(x)), d[i]))[:6].tolist() for i in range(len(x))}
    tree = sorted((r.a, r.b) for r in density.spanning_tree(df, "id", "v", 2, 20).collect())
    assert tree == sorted((a, b) for a, b, _ in literal_tree(x, 2)[1])
