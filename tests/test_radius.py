"""Dominating sets and hierarchies at radius 2 against brute force."""

import random

from kmerweave.jobs.build import build_hierarchy
from kmerweave.operators import graph


def test_hierarchy_at_radius_two(spark):
    rng = random.Random(6)
    n = 24
    pairs = [(i, i + 1) for i in range(n - 3)] + [(rng.randrange(n - 2), rng.randrange(n - 2)) for _ in range(5)]
    adj = {i: set() for i in range(n)}
    for a, b in pairs:
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    near = {i: {i} | adj[i] | {y for x in adj[i] for y in adj[x]} for i in range(n)}
    e = graph.undirected(spark.createDataFrame(pairs, "src long, dst long"))
    chosen = {r.id for r in graph.dominating_set(e, spark.range(n), 2).collect()}
    assert all(near[i] & chosen for i in range(n))
    piece = {i: i for i in chosen}
    for _ in range(2):
        piece = {i: min(piece[x] for x in adj[i] & piece.keys()) for i in range(n) if i not in piece and adj[i] & piece.keys()} | piece
    h = build_hierarchy(e, spark.range(n), radius=2, top=len(chosen))  # one level and the root
    vertex = {r.id: r.vertex for r in h.nodes.where("level = 1").collect()}
    assert set(vertex.values()) == chosen
    assert {r.leaf: vertex[r.id] for r in h.piece.collect()} == piece
