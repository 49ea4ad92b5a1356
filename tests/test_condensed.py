"""The condensed tree and its chosen clusters, against a walk from the heaviest edge down."""

import numpy as np
import pytest

from kmerweave.operators import condensed, density
from test_density import cloud, literal_tree


def literal(tree, n, least, root=False):
    """The clusters as {frozenset of vectors: (parent's, birth, stability, chosen)} and each vector's (cluster, own, left)."""
    order = sorted(range(len(tree)), key=lambda i: (tree[i][2], *sorted(tree[i][:2])))
    # merge upwards: every node is (members, weight, left node, right node)
    node = {i: (frozenset([i]), None, None, None) for i in range(n)}
    at = {i: i for i in range(n)}
    for i in order:
        a, b, w = tree[i]
        x, y = node[at[a]], node[at[b]]
        new = (x[0] | y[0], w, x, y)
        key = min(new[0])
        node[key] = new
        for v in new[0]:
            at[v] = key
    found, points = {}, {}
    dense = lambda w: 1 / max(w, condensed.FLOOR)
    todo = [(node[k], None, None) for k in {at[i] for i in range(n)} if len(node[k][0]) >= least]
    while todo:
        (members, w, x, y), parent, birth = todo.pop()
        since, stability, now = 0.0 if birth is None else dense(birth), 0.0, (members, w, x, y)
        while True:
            big = [s for s in now[2:] if len(s[0]) >= least]
            small = [v for s in now[2:] if len(s[0]) < least for v in s[0]]
            for v in small:
                points[v] = (members, now[1])
            stability += (dense(now[1]) - since) * len(small)
            if len(big) == 2:
                stability += (dense(now[1]) - since) * len(now[0])
                todo += [(s, members, now[1]) for s in big]
            if len(big) != 1:
                break
            now = big[0]
        found[members] = [parent, birth, stability, False]
    best = {}
    for c in sorted(found, key=len):
        below = sum(best[d] for d in found if found[d][0] == c)
        found[c][3] = found[c][2] >= below and (root or found[c][0] is not None)
        best[c] = max(found[c][2], below)
    label = {}
    for v, (own, left) in points.items():
        c, top = own, None
        while c is not None:
            top, c = (c if found[c][3] else top), found[c][0]
        label[v] = (top, own, left)
    chosen = {c for c, _, _ in label.values()}
    return {c: (p, b, s, c in chosen or (k and not any(found[u][3] for u in found if u > c))) for c, (p, b, s, k) in found.items()}, label


def same(spark, tree, n, least, root=False):
    df = spark.createDataFrame([(*sorted((int(a), int(b))), float(w)) for a, b, w in tree], "a long, b long, weight double").repartition(3)
    got = condensed.condense(df, spark.range(n), least, root)
    want, label = literal(tree, n, least, root)
    points = {r.id: r for r in got.points.collect()}
    clusters = {r.cluster: r for r in got.clusters.collect()}
    assert len(points) == n and len(clusters) == len(want)
    under = {c: set() for c in clusters}
    for v, r in points.items():
        c = r.own
        while c is not None:
            under[c].add(v)
            c = clusters[c].parent
    for c, r in clusters.items():
        parent, birth, stability, chosen = want[frozenset(under[c])]
        assert r.size == len(under[c]) and (frozenset(under[r.parent]) if r.parent is not None else None) == parent
        assert r.birth == birth and np.isclose(r.stability, stability) and r.chosen == chosen
    for v, r in points.items():
        if v not in label:
            assert (r.cluster, r.own, r.left) == (None, None, None)
            continue
        top, own, left = label[v]
        assert (frozenset(under[r.cluster]) if r.cluster is not None else None) == top and frozenset(under[r.own]) == own and r.left == left
    return got


def test_cloud(spark):
    _, tree = literal_tree(cloud(300, 4), 5)
    same(spark, tree, 300, 5)


def test_ties_and_root_by_tables(spark, monkeypatch):
    monkeypatch.setattr(density, "DRIVER_EDGES", 0)
    rng = np.random.default_rng(5)
    same(spark, [(int(rng.integers(0, i)), i, float(rng.integers(0, 4))) for i in range(1, 120)], 120, 3, root=True)


def shifted(edges, by):
    return [(a + by, b + by, w) for a, b, w in edges]


def test_deep_dendrograms(spark):
    """A path of rising weights, whose dendrogram is one chain; splits within splits; a star with ties; parts too small; single vectors."""
    path = [(i, i + 1, float(i + 1)) for i in range(200)]
    chain = spark.createDataFrame([(i, *e) for i, e in enumerate(path)], "e long, a long, b long, weight double")
    assert condensed.chains(chain)[2] == 1
    # pairs of a comb, each hung on the one before by a heavier edge
    comb = [(2 * i, 2 * i + 1, 0.5) for i in range(60)] + [(2 * i - 2, 2 * i, float(i)) for i in range(1, 60)]
    star, few = [(0, i, float(i % 7)) for i in range(1, 60)], [(0, 1, 1.0), (2, 1, 1.0)]
    same(spark, path + shifted(comb, 300) + shifted(star, 500) + shifted(few, 600), 610, 4)


def test_small_inputs(spark):
    empty = spark.createDataFrame([], "a long, b long, weight double")
    none = condensed.condense(empty, spark.range(3), 2)
    assert none.clusters.count() == 0 and [tuple(r) for r in none.points.orderBy("id").collect()] == [(i, None, None, None) for i in range(3)]
    with pytest.raises(ValueError):
        condensed.condense(empty, spark.range(3), 1)


def test_from_vectors(spark):
    """Well-parted clouds come out as clusters."""
    rng = np.random.default_rng(6)
    x = np.concatenate([c + rng.normal(size=(40, 4)) * 0.3 for c in (np.zeros(4), np.full(4, 9.0), np.array([9.0, -9, 9, -9]))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = condensed.condense(density.spanning_tree(df, "id", "v", 5, 40), df, 15).points.collect()
    label = {r.id: r.cluster for r in got}
    groups = [{label[i] for i in range(40 * k, 40 * k + 40)} - {None} for k in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


def test_no_stability_is_negative_where_all_leave_at_the_distance_of_birth(spark):
    edges, n = [], 14
    for t in range(40):  # trees of two groups of seven, all edges of one weight, the joining one the last
        w, at = 1.1 + t / 977, lambda i, t=t: n * t + i
        edges += [(at(i), at(i + 1), w) for i in range(5)] + [(at(0), at(13), w)] + [(at(i), at(i + 1), w) for i in range(6, 12)] + [(at(12), at(13), w)]
    tree = spark.createDataFrame(edges, "a long, b long, weight double")
    rows = condensed.condense(tree, spark.range(40 * n), 7).clusters.collect()
    assert len(rows) == 120
    assert {r.stability for r in rows if r.parent is not None} == {0.0}
