"""Augmented arcs, resumed builds, older graph files, lineages, vectors and result tables."""

import csv
import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from kmerweave.jobs import regions
from kmerweave.jobs.build import build_hierarchy
from kmerweave.operators import annotate, graph, vectors
from kmerweave.sources import readers, writers


def table_of(path):
    out = []
    for p in sorted(path.glob("part-*")):
        with open(p, newline="") as f:
            out += list(csv.DictReader(f))
    return out


def some_graph(rng, n, m):
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)} | {(i, i + 1) for i in range(0, n - 3, 2)}
    return sorted(pairs)


def test_augmented_arcs_tell_distances(spark):
    rng = random.Random(11)
    n, r = 22, 3
    pairs = some_graph(rng, n, 16)
    adj = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(n)}
    far = {}
    for s in range(n):
        seen, front = {s: 0}, [s]
        while front:
            front = [y for x in front for y in adj[x] if y not in seen and not seen.update({y: seen[x] + 1})]
        far |= {(s, t): d for t, d in seen.items()}
    arcs = [tuple(a) for a in graph.augment(graph.undirected(spark.createDataFrame(pairs, "src long, dst long")), r).select("src", "dst", "weight").collect()]
    assert len({frozenset(a[:2]) for a in arcs}) == len(arcs)  # one arc a pair
    into = {i: {s: w for s, t, w in arcs if t == i} for i in range(n)}
    direct = {p: w for s, t, w in arcs for p in ((s, t), (t, s))}
    for x, y in itertools.permutations(range(n), 2):
        ways = [into[x][c] + into[y][c] for c in into[x].keys() & into[y].keys()]
        best = min([*ways, direct.get((x, y), 99)], default=99)
        d = far.get((x, y), 99)
        assert best >= d and (d > r or best == d), (x, y, d, best)


def test_build_goes_on(spark, tmp_path):
    pairs = [(i, i + 1) for i in range(19)]
    e = graph.undirected(spark.createDataFrame(pairs, "src long, dst long"))
    v = spark.range(20)
    shown = lambda h: [sorted(map(str, df.collect())) for df in (h.nodes.select("id", "level", "vertex"), h.child.select("parent", "child"), h.piece.select("id", "leaf"))]
    where = str(tmp_path / "levels")
    plain = shown(build_hierarchy(e, v, top=2))
    assert shown(build_hierarchy(e, v, top=2, folder=where)) == plain
    levels = sorted(p.name for p in (tmp_path / "levels").iterdir())
    assert len(levels) > 1
    # nothing below the level is built again: the graph isn't even at hand
    none = e.where("src < 0")
    assert shown(build_hierarchy(none, v, top=2, folder=where)) == plain
    assert shown(build_hierarchy(none, v, top=2, folder=where, resume=1)) == plain


def test_two_block_graph(spark, tmp_path):
    f = tmp_path / "g.txt"
    f.write_text("id,size,label\n7,3,a\n4,1,b\n\nsrc,dest,w\n7,4,0.5\n4,9,2\n\nno more\n")
    v, e = readers.two_block_graph(spark, str(f))
    assert sorted((r.id, r.size, r.attributes["label"]) for r in v.collect()) == [(4, 1, "b"), (7, 3, "a")]
    assert sorted((r.src, r.dst, r.attributes["w"]) for r in e.collect()) == [(4, 9, "2"), (7, 4, "0.5")]
    v, e = readers.two_block_graph(spark, str(f), consecutive=True)
    assert sorted((r.id, r["size"]) for r in v.collect()) == [(0, 3), (1, 1)]
    assert sorted((r.src, r.dst) for r in e.collect()) == [(0, 1), (1, 2)]
    f.write_text("id,size\n1,1\n\nsrc,dest\n")
    v, e = readers.two_block_graph(spark, str(f))
    assert v.count() == 1 and e.count() == 0


def test_lineages(spark, tmp_path):
    f = tmp_path / "l.csv"
    f.write_text("accession,taxid,superkingdom,phylum,class,order,family,genus,species,strain\nx,1,B,P,C,,,,,\ny,2,B,P,D,O,,,,\nz,3,,,,,,,,\n")
    known = readers.lineages(spark, str(f))
    assert {r.name: r.lineage for r in known.collect()} == {"x": ["B", "P", "C"], "y": ["B", "P", "D", "O"], "z": []}
    s = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2), ("y", 2), ("x", 3), ("y", 3), ("z", 3), ("w", 4)], "name string, hash long")
    got = {r.hash: (len(r.lineages), r.lca) for r in annotate.hash_lineages(s, known).collect()}
    assert got == {1: (1, ["B", "P", "C"]), 2: (2, ["B", "P"]), 3: (3, [])}


def test_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 5)) @ rng.normal(size=(5, 5))
    x[:, 3] = 2.0  # constant
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [1.0, None, 0.0, 0.0, 0.0]), (92, [float("nan")] * 5), (93, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    s = x.std(0)
    z = np.divide(x - x.mean(0), s, out=np.zeros_like(x), where=s > 1e-12)
    got = {r.id: r.v for r in vectors.standardised(df, "v").collect()}
    assert sorted(got) == list(range(40)) and np.allclose([got[i] for i in range(40)], z)
    out, share = vectors.principal_components(df, "id", "v", 3)
    got = {r.id: r.scores for r in out.collect()}
    _, d, vt = np.linalg.svd(z, full_matrices=False)
    want = z @ vt[:3].T
    assert np.allclose(np.abs([got[i] for i in range(40)]), np.abs(want)) and np.allclose(share, (d**2 / (d**2).sum())[:3])
    assert vectors.standardised(df.where("id > 90"), "v").count() == 0


def test_unassembled(spark, tmp_path):
    # root 9 over 5 and 6; 5 over 1 and 2; leaves 10 * node + i
    child = spark.createDataFrame([(9, 5), (9, 6), (5, 1), (5, 2), (6, 3)], "parent long, child long")
    piece = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30)], "id long, leaf long")
    stats = spark.createDataFrame([(1, 8, 16, 2, 6), (2, 4, 2, 1, 0), (3, 10, 20, 1, 1), (5, 12, 18, 3, 6), (6, 10, 20, 1, 1), (9, 22, 38, 4, 7)], "id long, kmers long, weighted long, shadow long, matched long")
    table, leaves = regions.unassembled(child, stats, piece, 9, 0.2, least=5)
    assert sorted(map(tuple, table.collect())) == [(2, 0.0, 4, 2, 0.5, 1), (6, 0.1, 10, 20, 2.0, 1)]
    assert sorted(map(tuple, leaves.collect())) == [(6, 30)]
    contigs = leaves.select(F.col("leaf").alias("id"), "region", F.lit("ACGT").alias("seq"))
    writers.unassembled(table, contigs, str(tmp_path / "u"))
    assert table_of(tmp_path / "u" / "nodes") == [
        {"node_id": "2", "contained": "0.000", "n_kmers": "4", "n_weighted_kmers": "2.0", "average_weight": "0.50", "shadow_size": "1"},
        {"node_id": "6", "contained": "0.100", "n_kmers": "10", "n_weighted_kmers": "20.0", "average_weight": "2.00", "shadow_size": "1"},
    ]
    assert readers.fasta(spark, str(tmp_path / "u" / "contigs")).select("name", "description", "sequence").first()[:] == ("30", "6", "ACGT")


def test_result_tables(spark, tmp_path):
    columns = "query containment similarity bp contigs ksize num_query_kmers best_containment cdbg_min_overhead catlas_min_overhead catlas_name".split()
    rows = [(f"q{i}", 0.5, 0.25, 10, 2, 21, 4, 1.0, 0.0, 0.0, "c") for i in (2, 0, 1)]
    writers.search_results(spark.createDataFrame(rows, columns), str(tmp_path / "r"))
    got = table_of(tmp_path / "r")
    assert [r["query"] for r in got] == ["q0", "q1", "q2"] and list(got[0]) == columns
    nodes = spark.createDataFrame([(2, 5, 7), (1, 0, 3)], "id long, abund long, size long")
    levels = spark.createDataFrame([(4, 2, 5, 10), (3, 1, 5, 10)], "dom_id long, level int, abund long, size long")
    writers.abundances(nodes, levels, str(tmp_path / "a"))
    assert table_of(tmp_path / "a" / "cdbg_abund") == [{"cdbg_id": "1", "abund": "0", "node_size": "3"}, {"cdbg_id": "2", "abund": "5", "node_size": "7"}]
    assert [r["dom_id"] for r in table_of(tmp_path / "a" / "dom_abund")] == ["3", "4"]
    hits = spark.createDataFrame([(0, 5), (0, 5), (1, 6)], "record_number long, cdbg_id long")
    writers.annotation(spark.createDataFrame([(1, "b"), (0, "a")], "record_number long, record_name string"), hits, str(tmp_path / "m"))
    assert [r["record_name"] for r in table_of(tmp_path / "m" / "records")] == ["a", "b"]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "m" / "ids")).select("record_number", "cdbg_id").collect())) == [(0, 5), (1, 6)]
    writers.annotation_hits(spark.createDataFrame([(7, "c", "f", "r"), (7, "c", "f", "r")], "hashval long, catlas_base string, filename string, record_name string"), str(tmp_path / "h"))
    assert table_of(tmp_path / "h") == [{"hashval": "7", "catlas_base": "c", "filename": "f", "record_name": "r"}]
    writers.composition(spark.createDataFrame([(1, "AA", 2), (2, "AC", 1)], "region long, kmer string, n long"), str(tmp_path / "c"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "c" / "matrix")).select("region", "AA", "AC").collect())) == [(1, 2, 0), (2, 0, 1)]
