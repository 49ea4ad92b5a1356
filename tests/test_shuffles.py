"""What large k-mer jobs shuffle, and their results on odd texts against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kmerweave import queries as library
from kmerweave.functions import sequence
from kmerweave.jobs import regions
from kmerweave.operators import annotate, graph, hierarchy, index, sketch


def odd_nodes(spark):
    rng = random.Random(5)
    word = lambda n, letters="ACGTxy é\U0001f600": "".join(rng.choice(letters) for _ in range(n))
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    one, two = word(300), word(40_000, "ACGT")
    rows = [(1, one), (2, one[50:120] + word(20)), (3, turned(one)[:90]), (4, two), (4, two[:500]), (5, "A" * 700), (6, "TTTTT" * 30), (7, ""), (8, None), (9, "short"), (None, word(200)), (None, one[:80])]
    rows += [(20 + i, "a common line of words that all of these texts hold " * 3 + word(30)) for i in range(20)]
    return spark.createDataFrame(rows, "id long, seq string"), rows


def canonical(s):
    return min(s, s[::-1].translate(str.maketrans("ACGT", "TGCA")))


def holders(rows, k, form=canonical):
    out = defaultdict(set)
    for i, s in rows:
        for j in range(len(s or "") - k + 1):
            out[form(s[j : j + k])].add(i)
    return out


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x.split("[plan_id")[0] for x in plan.split("Exchange hashpartitioning(")[1:]]


def test_spans_of_odd_texts(spark):
    nodes, rows = odd_nodes(spark)
    for k in (31, 13, 10, 5):
        held = [h - {None} for h in holders(rows, k).values()]
        assert index.collisions(nodes, k).first()[:] == (len(held), sum(len(h) > 1 for h in held))
        own = [next(iter(h)) for h in held if len(h) == 1]
        assert sorted(r.id for r in index.unique_index(nodes, k).collect()) == sorted(own)


def test_spans_shuffle_no_kmers(spark):
    nodes, _ = odd_nodes(spark)
    assert not any(x.startswith(("kmer", "h#")) for x in exchanges(index.collisions(nodes, 31)))


def test_distinct_kmers_of_odd_texts(spark, monkeypatch):
    nodes, rows = odd_nodes(spark)
    for long_ in (sequence.LONG, 1000):
        monkeypatch.setattr(sequence, "LONG", long_)
        for k, both in ((31, False), (5, True)):
            n = defaultdict(int)
            for h in holders(rows, k, canonical if both else str).values():
                for i in h:
                    n[i] += 1
            assert {r.id: r.n for r in sequence.distinct_kmers(nodes, "seq", k, "id", both).collect()} == n


def test_distinct_kmers_shuffle_texts_only(spark, tmp_path):
    odd_nodes(spark)[0].select(F.col("id").alias("doc_id"), F.col("seq").alias("text"), F.lit("s").alias("source"), F.lit("l").alias("lang")).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("kmer_count", "canonical_kmer"):
        dealt = exchanges(library.QUERIES[name](spark, str(tmp_path)))
        # keys of many characters have a path of their own, which is empty here
        assert any(x.startswith("_key#") and x.count("#") == 1 for x in dealt), dealt


def test_own_kmers_in_reads(spark):
    nodes, rows = odd_nodes(spark)
    reads = [(c, t, s) for c, (_, s) in enumerate(rows) for t in (0, 1)] + [(99, 0, "A" * 50), (99, None, rows[0][1][:40])]
    table = spark.createDataFrame(reads, "conv_id long, turn long, seq string")
    own = {x: next(iter(h - {None})) for x, h in holders(rows, 13).items() if len(h - {None}) == 1}
    labels, hits = set(), defaultdict(int)
    for c, t, s in reads:
        for j in range(len(s or "") - 12):
            i = own.get(canonical(s[j : j + 13]))
            if i is not None:
                labels.add((c, t, i))
                hits[i] += 1
    assert {tuple(r) for r in index.own_labels(nodes, table, 13, "conv_id", "turn").collect()} == labels
    assert {r.id: r.abund for r in index.own_hits(nodes, table, 13).collect()} == hits


def test_bottom_sketch_ranks_few_hashes(spark):
    nodes, rows = odd_nodes(spark)
    want = defaultdict(set)
    for x, h in holders(rows, 31).items():
        for i in h:
            want[i].add(int(hashlib.md5(x.encode()).hexdigest()[:15], 16))
    df = sketch.bottom_sketch(nodes, 31, 5, "id")
    assert {(r.id, r["rank"], r.hash) for r in df.collect()} == {(i, k + 1, h) for i, s in want.items() for k, h in enumerate(sorted(s)[:5])}


def test_tasks_that_drop_repeated_edges_grow_with_the_items(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph, "SHARE", 50)
    spark.range(1000).select((F.col("id") % 90).alias("l_partkey"), (F.col("id") % 7).alias("l_suppkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = library._edges(spark, str(tmp_path))
    assert edges.count() == 2 * 90 * 7
    assert "hashpartitioning(src#" in (plan := edges._jdf.queryExecution().executedPlan().toString()) and ", 40), REPARTITION_BY_NUM" in plan


def test_pairs_in_tasks_of_bounded_rows(spark, monkeypatch):
    """Pairs over a vertex are dealt out by their number before repeated ones go; arcs of weight 2 are those of all pairs."""
    monkeypatch.setattr(graph, "SHARE", 20)
    rng = random.Random(9)
    pairs = sorted({(2 * rng.randrange(30), 2 * rng.randrange(8) + 1) for _ in range(90)})
    edges = graph.undirected(spark.createDataFrame(pairs, "src long, dst long"))
    arcs = graph.staged(edges.where("src > dst"), "test-arcs")
    found = graph.transitive_pairs(arcs)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    low = {(max(p), min(p)) for p in pairs}
    got = sorted(map(tuple, found.collect()))
    assert got == sorted({(x, u) for u, v in low for w, x in low if w == v and x != u and (u, x) not in low and (x, u) not in low})
    n = {i: sum(i in p for p in pairs) for p in pairs for i in p}
    one = {max(((n[i], i, j), (n[j], j, i)))[1:] for i, j in pairs}
    two = {(x, y) for x, h in one for y, g in one if h == g and x < y} | {(min(u, x), max(u, x)) for u, v in one for w, x in one if w == v}
    told = graph.augment(edges, 2).collect()
    assert {(r.src, r.dst) for r in told if r.weight == 1} == one
    assert sorted((min(r.src, r.dst), max(r.src, r.dst)) for r in told if r.weight == 2) == sorted(two - {tuple(sorted(p)) for p in pairs})


def test_components_in_tasks_of_bounded_rows(spark, monkeypatch):
    """Every round's repeated edges go in tasks of bounded rows; stars wider than those, paths, loops and lone vertices."""
    rows, once = [], graph.once
    monkeypatch.setattr(graph, "SHARE", 15)
    monkeypatch.setattr(graph, "once", lambda df, n: rows.append(n) or once(df, n))
    rng = random.Random(4)
    pairs = [(100, i) for i in range(101, 140)] + [(i, 400) for i in range(360, 390)] + [(500 + i, 501 + i) for i in range(12)] + [(7, 7), (700, 701), (701, 700), (700, 701)]
    pairs += [(rng.randrange(800, 900), rng.randrange(800, 900)) for _ in range(60)]
    vertices = sorted({i for p in pairs for i in p} | {999})
    label = {i: i for i in vertices}
    for _ in vertices:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    found = graph.components(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(i,) for i in vertices], "id long"))
    assert {r.id: r.component for r in found.collect()} == label
    assert len(rows) >= 4


def test_ancestors_in_tasks_of_bounded_rows(spark, monkeypatch):
    """Every round's repeated pairs go in tasks of bounded rows; several parents and repeated rows count once."""
    rows, once = [], graph.once
    monkeypatch.setattr(graph, "SHARE", 10)
    monkeypatch.setattr(hierarchy, "once", lambda df, n: rows.append(n) or once(df, n))
    pairs = [(i // 2, i) for i in range(2, 40)] + [(1, 9), (1, 9), (3, 30)]
    want = set(pairs)
    while more := {(a, d) for a, b in want for c, d in want if b == c} - want:
        want |= more
    child = spark.createDataFrame(pairs, "parent long, child long")
    assert sorted(map(tuple, hierarchy.ancestors(child).collect())) == sorted(want)
    level = spark.createDataFrame([(i, 1) for i in range(20, 40)] + [(i, 2) for i in range(1, 20)], "id long, level int")
    assert sorted(map(tuple, hierarchy.closure(child, level).collect())) == sorted({p for p in want if p[1] >= 20} | {(i, i) for i in range(20, 40)})
    assert rows


def test_extracted_records_are_not_shuffled(spark):
    nodes = spark.range(50).select("id", F.concat(F.lit("text "), "id").alias("seq")).repartition(3)
    ids = spark.createDataFrame([(3,), (3,), (7,), (99,), (None,)], "id long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = annotate.extract(ids, nodes)
        assert not exchanges(found) and sorted(map(tuple, found.collect())) == [(3, "text 3"), (7, "text 7")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_ancestors_of_a_tree_are_written_once(spark, monkeypatch):
    """A tree has no repeated pair, so none is looked for; loops of any length raise; the unassembled nodes take one set of pairs."""
    monkeypatch.setattr(hierarchy, "once", lambda df, n: 1 / 0)
    parent = {i: i // 3 for i in range(1, 60)}
    want = set()
    for i in parent:
        a = i
        while a in parent:
            a = parent[a]
            want.add((a, i))
    child = spark.createDataFrame([(p, c) for c, p in parent.items()], "parent long, child long")
    pairs = hierarchy.ancestors(child)
    assert sorted(map(tuple, pairs.collect())) == sorted(want)
    for loop in ([(5, 5)], [(1, 2), (2, 3), (3, 1), (3, 4)]):
        with pytest.raises(ValueError, match="lead back"):
            hierarchy.ancestors(spark.createDataFrame(loop, "parent long, child long"))
    stats = spark.createDataFrame([(i, 10, 10, 1, 1 if i in (4, 13, 40, 5, 2) else 9) for i in range(60)], "id long, kmers long, weighted long, shadow long, matched long")
    piece = spark.createDataFrame([(i, 1000 + i) for i in range(20, 60)], "id long, leaf long")
    monkeypatch.setattr(hierarchy, "ancestors", lambda child: 1 / 0)
    table, leaves = regions.unassembled(child, stats, piece, 0, 0.2, 8, pairs)
    assert {r.node_id for r in table.collect()} == {2, 4, 5}
    assert {tuple(r) for r in leaves.collect()} == {(a, 1000 + i) for a, i in want if a in (2, 4, 5) and i >= 20}


def test_labels_hash_by_columns(spark, monkeypatch):
    """Labels need no row for a k-mer in Spark's plan; ids that aren't numbers, repeated stretches that go early, and texts in any letters."""
    nodes, rows = odd_nodes(spark)
    reads = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(rows)], "r long, seq string")
    monkeypatch.setattr(index, "HELD", 64)
    own = {x: next(iter(h - {None})) for x, h in holders(rows, 13).items() if len(h - {None}) == 1}
    want = {(r, own[x]) for r, (_, s) in enumerate(rows) for x in {canonical(s[j : j + 13]) for j in range(len(s or "") - 12)} if x in own}
    labels = index.own_labels(nodes, reads, 13, "r")
    assert "Generate" not in labels._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert {tuple(r) for r in labels.collect()} == want
    named = nodes.select(F.concat(F.lit("é"), F.col("id").cast("string")).alias("id"), "seq")
    assert {tuple(r) for r in index.own_labels(named, reads, 13, "r").collect()} == {(r, f"é{i}") for r, i in want}
    short = [(1, "ünïcode wörds ünd é 😀 only here"), (2, "plain words of the second node, and no more")]
    told = index.own_labels(spark.createDataFrame(short, "id long, seq string"), spark.createDataFrame([(7, short[0][1][3:]), (8, short[1][1][:20])], "r long, seq string"), 13, "r")
    assert {tuple(r) for r in told.collect()} == {(7, 1), (8, 2)}
