"""Neighbours, their weights and the map on a plane, against loops over all pairs."""

import numpy as np

from kmerweave.operators import density, neighbour_map

SCHEMA = "id long, v array<double>"


def groups():
    rng = np.random.default_rng(7)
    centres = np.array([[0] * 6, [12] * 6, [12, -12] * 3])
    return np.concatenate([c + rng.normal(size=(40, 6)) for c in centres])


def test_neighbours_and_weights(spark):
    x = groups()
    x[1] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    rows, apart = density.blocks(df, "id", "v", 20)
    near = density.neighbours(rows, apart, 30)
    got = {r.id: [(n.d, n.id) for n in r.near] for r in near.collect()}
    for i in range(len(x)):
        want = sorted((float(np.sqrt(((x[i] - y) ** 2).sum())), j) for j, y in enumerate(x) if j != i)[:30]
        assert [j for _, j in got[i]] == [j for _, j in want] and np.allclose([d for d, _ in got[i]], [d for d, _ in want])
    p = {}
    for r in neighbour_map.weights(near, 8.0).collect():
        p.setdefault(r.id, []).append(r.p)
    assert len(p) == len(x)
    for w in map(np.array, p.values()):
        w = w[w > 0]
        assert np.isclose(w.sum(), 1) and np.isclose(np.exp(-(w * np.log(w)).sum()), 8, atol=1e-3)


def test_repulsion_of_all(spark):
    y = np.random.default_rng(8).normal(size=(30, 2))
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(y)], "id long, x double, y double")
    got = {r.id: (r.rx, r.ry, r.z) for r in neighbour_map._repelled(points, points.collect(), 30).collect()}
    for i in range(30):
        away = y[i] - np.delete(y, i, 0)
        q = 1 / (1 + (away**2).sum(1))
        assert np.allclose(got[i], [*((q**2)[:, None] * away).sum(0), q.sum()])


def test_groups_stay_together(spark):
    x = groups()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    points, losses = neighbour_map.placed(df, "id", "v", 10.0, 40, 40)
    y = np.array([(r.x, r.y) for r in points.orderBy("id").collect()])
    assert len(y) == 120 and np.isfinite(y).all() and losses[-1] < 0.6 * losses[0]
    d = ((y[:, None] - y[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert (d.argsort(1)[:, :10] // 40 == np.arange(120)[:, None] // 40).mean() > 0.98


def test_few_vectors(spark):
    assert neighbour_map.placed(spark.createDataFrame([], SCHEMA), "id", "v").points.count() == 0
    bad = spark.createDataFrame([(1, None), (2, [float("nan"), 1.0]), (3, [1.0, 2.0])], SCHEMA)
    assert [tuple(r) for r in neighbour_map.placed(bad, "id", "v").points.collect()] == [(3, 0.0, 0.0)]
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], SCHEMA)
    points = neighbour_map.placed(same, "id", "v", rounds=2).points.collect()
    assert len(points) == 4 and all(np.isfinite([r.x, r.y]).all() for r in points)


def test_all_points_repel(spark, monkeypatch):
    """Over the grid every point counts: repulsion is that of all pairs, on planes of one tile and of several."""
    for seed, wide, spacing, side in (9, 0.01, 2**-10, 512), (10, 8, 1 / 8, 512), (11, 25, 1 / 8, 64):
        monkeypatch.setattr(neighbour_map, "TILE", side)
        y = np.random.default_rng(seed).normal(size=(1500, 2)) * wide
        points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(y)], "id long, x double, y double")
        found, done, width = neighbour_map._repelled_by_all(points, spacing)
        got = np.array([(r.rx, r.ry, r.z) for r in found.orderBy("id").collect()])
        done()
        away = y[:, None] - y[None]
        q = 1 / (1 + (away**2).sum(-1))
        np.fill_diagonal(q, 0)
        want = np.column_stack([((q**2)[:, :, None] * away).sum(1), q.sum(1)])
        assert (np.abs(got - want).max(0) < 3e-5 * np.abs(want).max(0)).all() and np.ptp(y, axis=0).max() <= width


def test_map_of_many_depends_on_no_sample(spark, monkeypatch):
    """With more points than any sample had, other ids give the same divergences, and so do all pairs and the grid."""
    x = np.concatenate([c + np.random.default_rng(12).normal(size=(400, 3)) for c in ([0] * 3, [6] * 3, [6, -6, 0])])

    def losses(first, pairs):
        monkeypatch.setattr(neighbour_map, "PAIRS", pairs, raising=False)
        df = spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
        return neighbour_map.placed(df, "id", "v", 5.0, 9).losses

    one, other, all_ = losses(0, 0), losses(5000, 0), losses(0, 4096)
    assert np.allclose(one, all_, rtol=1e-6) and np.allclose(one, other, rtol=1e-4)


def test_neighbours_by_few_first(spark, monkeypatch):
    """A bound from the first few vectors leaves out no neighbour: many equal vectors, ties, and vectors far from all."""
    monkeypatch.setattr(density, "FEW", 3)
    x = np.round(np.concatenate([np.zeros((40, 3)), np.random.default_rng(5).normal(size=(60, 3)), [[1e6, 0, 0], [-1e6, 1, 0]]]), 1)
    df = spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    rows, apart = density.blocks(df, "id", "v", 30)
    for r in density.neighbours(rows, apart, 7).collect():
        d = np.sqrt(((x - x[r.id // 3]) ** 2).sum(1))
        assert [(n.id, n.d) for n in r.near] == [(3 * j, e) for e, j in sorted((e, j) for j, e in enumerate(d) if 3 * j != r.id)[:7]]
