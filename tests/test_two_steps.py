"""Pairs over two arcs, found in cells, against loops over all paths."""

import random

import pytest

from kmerweave.operators import graph, two_steps


def wanted(arcs, outs):
    near = {(a, b) for s, d in arcs for a, b in ((s, d), (d, s))}
    two = {(x, u) for u, v in arcs for w, x in arcs if w == v} if outs else {(x, y) for x, v in arcs for y, w in arcs if w == v and x < y}
    return sorted(p for p in two if p[0] != p[1] and p not in near)


@pytest.mark.parametrize("most", [1, 40])
def test_pairs_of_odd_ids(spark, monkeypatch, most):
    """Ids below 0 and far apart, a hub whose paths take several cells, arcs both ways, loops; pairs aren't shuffled."""
    monkeypatch.setattr(graph, "SHARE", most)
    monkeypatch.setattr(graph, "PATHS", 1)
    monkeypatch.setattr(two_steps, "SPREAD", 7)
    if most == 1:
        monkeypatch.setattr(two_steps, "MARKS", 0)
    rng = random.Random(3)
    ids = [-(2**40), -5, *range(20), 2**50]
    arcs = {(rng.choice(ids), rng.choice(ids)) for _ in range(70)} | {(i, 3) for i in ids} | {(3, i) for i in range(8)}
    table = graph.staged(spark.createDataFrame(sorted(arcs), "src long, dst long"), "test-arcs")
    for outs, found, names in (True, graph.transitive_pairs, "xu"), (False, graph.fraternal_pairs, "xy"):
        df = found(table)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(f"hashpartitioning({c}#" in plan for c in names), "pairs were shuffled"
        assert sorted((r[0], r[1]) for r in df.collect()) == wanted(arcs, outs)
    none = spark.createDataFrame([], "src long, dst long")
    assert graph.transitive_pairs(none).count() == graph.fraternal_pairs(none).count() == 0


def test_lists_travel_once_where_ids_are_near(spark):
    """Heads of the same tails: what is dealt out grows with the arcs, not with the paths."""
    arcs = graph.staged(spark.createDataFrame([(t, 1000 + h) for h in range(60) for t in range(40)], "src long, dst long"), "test-arcs")
    pairs = graph.fraternal_pairs(arcs)
    assert sorted(map(tuple, pairs.collect())) == [(x, y) for x in range(40) for y in range(x + 1, 40)]
    sent = written(pairs)
    assert sent and max(sent) <= 60, sent  # a row for every head


def written(df):
    """Rows that every exchange of a plan that was run has written."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "ShuffleExchange" in node.getClass().getSimpleName():
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        kids = [node.executedPlan()] if "AdaptiveSparkPlan" in node.getClass().getSimpleName() else [node.plan()] if "QueryStage" in node.getClass().getSimpleName() else []
        seq = node.children()
        todo += kids + [seq.apply(i) for i in range(seq.size())]
    return out
