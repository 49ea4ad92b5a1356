import random
from collections import deque

import pytest

from kmerweave.jobs.build import build_hierarchy
from kmerweave.operators import graph


def make(spark, n, pairs):
    e = spark.createDataFrame(pairs or [(0, 0)], "src long, dst long")
    return graph.undirected(e), spark.range(n)


def random_graph(n, m, seed):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def neighbours(n, pairs):
    out = {i: set() for i in range(n)}
    for a, b in pairs:
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return out


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(params=[(30, 25, 1), (40, 90, 2)])
def case(request, spark):
    n, m, seed = request.param
    pairs = random_graph(n, m, seed)
    return (*make(spark, n, pairs), n, neighbours(n, pairs))


def test_simple_operators(case):
    e, v, n, adj = case
    assert rows(graph.degrees(e, v)) == [(i, len(adj[i])) for i in range(n)]
    assert [r[0] for r in rows(graph.isolates(e, v))] == [i for i in range(n) if not adj[i]]
    want = sorted({(x, u) for u in range(n) for w in adj[u] for x in adj[w] if x != u and x not in adj[u]})
    assert rows(graph.transitive_pairs(e)) == want
    assert rows(graph.fraternal_pairs(e)) == [p for p in want if p[0] < p[1]]


def test_asymmetric(spark):
    arcs = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "src long, dst long")
    assert rows(graph.asymmetric(arcs)) == [(3, 1)]


def test_pendants_stay_as_isolates(spark):
    e, v = make(spark, 4, [(0, 1), (1, 2), (2, 3)])
    nodes = v.selectExpr("id", "case when id = 0 then 1.0 else 5.0 end as abund")
    assert rows(graph.disconnect_pendants(e, nodes)) == [(1, 2), (2, 1), (2, 3), (3, 2)]


def test_hops_and_components(case):
    e, v, n, adj = case
    dist, q = {0: 0, 7: 0}, deque([0, 7])
    while q:
        x = q.popleft()
        for y in adj[x] - dist.keys():
            dist[y] = dist[x] + 1
            q.append(y)
    got = graph.within_hops(e, v.where("id in (0, 7)"), 2)
    assert rows(got) == sorted((x, d) for x, d in dist.items() if d <= 2)
    comp = {}
    for i in range(n):
        if i not in comp:
            comp[i], q = i, deque([i])
            while q:
                for y in adj[q.popleft()] - comp.keys():
                    comp[y] = i
                    q.append(y)
    assert rows(graph.components(e, v)) == sorted(comp.items())


def test_pieces_and_contraction(case):
    e, v, n, adj = case
    got = graph.dominating_set(e, v)
    chosen = {r.id for r in got.collect()}
    piece = dict(rows(graph.assign_pieces(e, v, got)))
    assert piece == {i: i if i in chosen else min(adj[i] & chosen) for i in range(n)}
    dom = rows(graph.contract(e, graph.assign_pieces(e, v, got)))
    assert dom == sorted({(piece[a], piece[b]) for a in range(n) for b in adj[a] if piece[a] != piece[b]})


def test_orientation_keeps_edges_and_is_acyclic(case):
    e, v, n, adj = case
    arcs = rows(graph.orient(e, graph.peel_order(e, v)))
    assert sorted(arcs + [(b, a) for a, b in arcs]) == sorted((a, b) for a in range(n) for b in adj[a])
    left, heads = set(range(n)), {i: {a for a, b in arcs if b == i} for i in range(n)}
    while free := {i for i in left if not heads[i] & left}:
        left -= free
    assert not left


def test_complete_graph_orientation(spark):
    e, v = make(spark, 25, [(a, b) for a in range(25) for b in range(a)])
    assert graph.orient(e, graph.peel_order(e, v)).count() == 300


def test_pieces_at_radius_two(spark):
    e, v = make(spark, 7, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6)])
    got = dict(rows(graph.assign_pieces(e, v, v.where("id in (0, 4)"), 2)))
    assert got == {0: 0, 1: 0, 2: 0, 3: 4, 4: 4, 5: 4, 6: 4}


def test_hierarchy_is_a_tree(case):
    e, v, n, adj = case
    h = build_hierarchy(e, v, top=3)
    nodes, child, piece = h.nodes.collect(), rows(h.child), rows(h.piece)
    ids = sorted(r.id for r in nodes)
    assert ids == list(range(len(ids)))
    root = max(ids)
    assert sorted(c for _, c in child) == ids[:-1] and all(p > c for p, c in child)  # one parent each
    assert sorted(x for _, x in piece) == list(range(n))
    level = {r.id: r.level for r in nodes}
    assert {i for i, _ in piece} == {i for i in ids if level[i] == 1} and level[root] == max(level.values())


def test_renumber(spark):
    d = spark.createDataFrame([(str(i * 7 % 101),) for i in range(101)], "k string").repartition(5)
    assert rows(graph.renumber(d, "k")) == [(k, i) for i, k in enumerate(sorted(str(i * 7 % 101) for i in range(101)))]
