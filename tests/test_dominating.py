"""Orientation, dominating sets and their rounds against a literal reading of their rules."""

import math
import random
from collections import Counter
from pathlib import Path

import pytest
from published import published
from pyspark.sql import functions as F

from kmerweave.jobs.build import build_hierarchy
from kmerweave.operators import graph

GRAPH = published("*/*/*k21/*.gxt")


def neighbours(n, pairs):
    out = {i: set() for i in range(n)}
    for a, b in pairs:
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return out


def within(adj, i, radius):
    seen = {i}
    for _ in range(radius):
        seen |= {y for x in seen for y in adj[x]}
    return seen


def star_and_more(seed):
    """Two stars that share leaves, a grid, a path, random edges and isolated vertices."""
    rng = random.Random(seed)
    pairs = [(0, i) for i in range(2, 30)] + [(1, i) for i in range(20, 50)]
    pairs += [(50 + 6 * i + j, 50 + 6 * i + j + 1) for i in range(6) for j in range(5)] + [(50 + 6 * i + j, 56 + 6 * i + j) for i in range(5) for j in range(6)]
    pairs += [(90 + i, 91 + i) for i in range(30)] + [(rng.randrange(125), rng.randrange(125)) for _ in range(20)]
    return 130, pairs


def literal_peel(n, adj):
    left, order, round_ = set(range(n)), {}, 0
    while left:
        d = {i: len(adj[i] & left) for i in left}
        most, round_ = 2 * sum(d.values()) // len(left), round_ + 1
        gone = {i for i in left if d[i] <= most}
        order.update({i: (round_, d[i], i) for i in gone})
        left -= gone
    return order


def literal_set(n, adj, arcs, hashes, radius):
    """Round by round, with loops."""
    into = Counter(b for _, b in arcs)
    at = {i: (-into[i], hashes[i], i) for i in range(n)}
    near = {i: within(adj, i, radius) for i in range(n)}
    left, members, most = set(range(n)), {}, (2 * radius) ** 2
    out_of = {}
    for a, b in arcs:
        out_of.setdefault(a, []).append(b)
    tally, round_ = Counter(), 0
    while left:
        round_ += 1
        candidates = {i for i in left if all(at[i] <= at[j] for j in near[i] & left)}
        risen = {u for u, bs in out_of.items() if len(bs) > most and u not in members and tally[u] + sum(b in candidates for b in bs) > most and any(b in candidates for b in bs)}
        new = {i for i in candidates if not near[i] & risen}
        for u, bs in out_of.items():
            tally[u] += sum(b in new for b in bs)
        members.update(dict.fromkeys(new, (False, round_)) | dict.fromkeys(risen, (True, round_)))
        left -= {j for i in new | risen for j in near[i]}
    return members


@pytest.mark.parametrize("radius", [1, 2])
def test_like_the_rules(spark, radius):
    n, pairs = star_and_more(3)
    adj = neighbours(n, pairs)
    e, v = graph.undirected(spark.createDataFrame(pairs, "src long, dst long")), spark.range(n)
    order = {r.id: (r.round, r.degree, r.id) for r in graph.peel_order(e, v).collect()}
    assert order == literal_peel(n, adj)
    arcs = [tuple(r) for r in graph.low_degree_arcs(e).collect()]
    assert sorted(arcs) == sorted((a, b) for a in range(n) for b in adj[a] if order[a] > order[b])
    if radius == 2:
        arcs = [(r.src, r.dst) for r in graph.augment(e, 2, graph.low_degree_arcs).collect()]
    hashes = {r.id: r.h for r in v.select("id", F.xxhash64("id").alias("h")).collect()}
    got = {r.id: (r.promoted, r.round) for r in graph.dominating_set(e, v, radius).collect()}
    assert got == literal_set(n, adj, arcs, hashes, radius)
    plain = {i for i, (p, _) in got.items() if not p}
    assert radius == 2 or any(p for p, _ in got.values())
    assert all(within(adj, i, radius) & got.keys() for i in range(n))
    assert all(within(adj, i, radius) & plain == {i} for i in plain)


@pytest.mark.parametrize("shape", ["path", "grid", "star"])
def test_few_rounds(spark, shape):
    n = 10_000
    i = F.col("id")
    arcs = {
        "path": spark.range(n - 1).select(i.alias("src"), (i + 1).alias("dst")),
        "grid": spark.range(n).select(i.alias("src"), (i + 1).alias("dst")).where("src % 100 < 99").union(spark.range(n - 100).select(i, i + 100)),
        "star": spark.range(1, n).select(F.lit(0).cast("long").alias("src"), i.alias("dst")),
    }[shape]
    e, v = graph.undirected(arcs), spark.range(n)
    order = graph.peel_order(e, v)
    assert order.count() == n and order.agg(F.max("round")).first()[0] <= math.log2(n) + 1
    into = graph.low_degree_arcs(e).groupBy("dst").count().agg(F.max("count")).first()[0]
    assert into <= {"path": 4, "grid": 8, "star": 4}[shape]  # four times the degeneracy
    got = graph.dominating_set(e, v)
    assert got.agg(F.max("round")).first()[0] <= 40
    if shape == "star":
        assert [tuple(r)[:2] for r in got.collect()] == [(0, True)]


@pytest.mark.skipif(not GRAPH, reason="the file isn't here")
def test_published_graph(spark):
    """736 vertices, 714 arcs: 580 dominators at the first level, 126 at the second."""
    lines = spark.read.text(GRAPH).where("value like '% %'").select(F.split("value", " ").alias("x"))
    e = graph.undirected(lines.select(F.col("x")[0].cast("long").alias("src"), F.col("x")[1].cast("long").alias("dst")))
    assert e.count() == 714
    h = build_hierarchy(e, spark.range(736))
    levels = {r.level: r["count"] for r in h.nodes.groupBy("level").count().collect()}
    assert levels[1] == 580 and levels[2] == 126
    assert h.piece.count() == 736


def test_no_table_is_left(spark):
    """A loop's tables go with its rounds: members alone stay."""
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    e, v = graph.undirected(spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")), spark.range(41)
    before = set(root.iterdir())
    graph.dominating_set(e, v).count()
    assert {p.name.split("-")[0] for p in set(root.iterdir()) - before} <= {"members", "tally", "peeled"}
    before = set(root.iterdir())
    graph.components(e, v).count()
    assert len(set(root.iterdir()) - before) == 1


def test_empty_graphs(spark):
    e = spark.createDataFrame([], "src long, dst long")
    assert graph.peel_order(e, spark.range(0)).count() == 0 and graph.dominating_set(e, spark.range(0)).count() == 0
    assert sorted(r.id for r in graph.dominating_set(e, spark.range(3)).collect()) == [0, 1, 2]
    assert graph.low_degree_arcs(e).count() == 0
