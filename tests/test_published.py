"""Published counts of a small public graph (736 unitigs, k = 21), where its files are at hand."""

import pytest
from published import published
from pyspark.sql import functions as F

from kmerweave.functions import sequence as seq
from kmerweave.jobs import neighborhoods, regions, search
from kmerweave.operators import index, protein, sketch
from kmerweave.operators._stage import staged
from kmerweave.sources import readers, writers

K = 21
UNITIGS, BROKEN = published("*/?????.*k21.unitigs.fa"), published("*/*BROKEN*.unitigs.fa")
EDGES, TREE, MEMBERS = published("*/*/*k21/*.gxt"), published("*/*/*k21_r1/*.csv"), published("*/*/*k21_r1/first_doms.txt")
HEAD, FOREIGN, SAMPLE = published("*/*-head.fa"), published("*/*nomatch.fa"), published("*/*-subset.fq")
pytestmark = pytest.mark.skipif(not (UNITIGS and EDGES), reason="the files aren't here")


def least_hashes(nodes):
    found = seq.kmers(nodes.select("id", F.col("sequence").alias("seq")), "seq", K, "id")
    return found.select("id", seq.unsigned(seq.sketch_hash(F.col("kmer"))).alias("hash"))


@pytest.fixture(scope="module")
def graph(spark):
    """Nodes (id, seq, abund) and arcs, numbered in the text order of least hashes."""
    nodes, arcs = readers.unitigs(spark, UNITIGS)
    nodes = nodes.withColumnRenamed("name", "id")
    moved, arcs = regions.sort_nodes(nodes, arcs.distinct(), least_hashes(nodes))
    return staged(moved.select("id", F.col("sequence").alias("seq"), "abund"), "nodes"), arcs


@pytest.fixture(scope="module")
def piece(spark):
    """id (graph node), dominator (level-1 node) of the published hierarchy."""
    nodes, _ = readers.hierarchy(spark, TREE)
    members = readers.pieces(spark, MEMBERS)
    return staged(members.join(nodes.where("level = 1").select("vertex", F.col("id").alias("dominator")), "vertex").select(F.col("member").alias("id"), "dominator"), "piece")


def records(spark, path, name="q"):
    return readers.fasta(spark, path).select(F.lit(name).alias("query"), F.col("name").alias("record"), F.col("sequence").alias("seq"))


def test_graph_is_the_published_one(spark, graph):
    nodes, arcs = graph
    _, edges = readers.gxt(spark, EDGES)
    assert nodes.count() == 736
    got = {tuple(r) for r in arcs.where("src <> dst").select("src", "dst").collect()}
    assert got == {tuple(r) for r in edges.collect()} and len(got) == 714


def test_broken_links_raise(spark):
    nodes, arcs = readers.unitigs(spark, BROKEN)
    nodes = nodes.withColumnRenamed("name", "id")
    with pytest.raises(ValueError, match="counterpart"):
        regions.sort_nodes(nodes, arcs.distinct(), least_hashes(nodes))


def test_results_of_two_queries(spark, graph, piece, tmp_path):
    nodes, _ = graph
    queries = records(spark, HEAD, "two").union(records(spark, FOREIGN, "foreign")).select("query", "seq")
    sketcher = lambda df, key: sketch.murmur_sketch(df, K, 1000, seq.sketch_hash, key)
    s = neighborhoods.search_each(nodes, staged(index.unique_index(nodes, K), "index"), piece, queries, K, sketcher, "built")
    got = {r["query"]: tuple(r)[1:] for r in s.results.collect()}
    assert got["two"] == (1.0, 1.0, 1671, 2, 21, 1631, 1.0, 0.0, 0.0, "built")
    assert got["foreign"] == (0.0, 0.0, 0, 0, 21, 8, 0.0, 0.0, 0.0, "built")
    assert sorted(r.id for r in s.near.collect()) == [118, 187]
    assert s.sketch.count() == 2
    writers.search_results(s.results, str(tmp_path / "results"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "results")).collect()]
    assert "two,1.0,1.0,1671,2,21,1631,1.0,0.0,0.0,built" in lines


def test_abundances_of_a_sample(spark, graph, piece):
    nodes, _ = graph
    sizes = index.node_sizes(nodes, K)
    sample = readers.fastq(spark, SAMPLE).withColumnRenamed("sequence", "seq")
    abund = staged(search.sample_abundance(index.unique_index(nodes, K), sizes, sample, K), "abund")
    assert tuple(abund.agg(F.count("*"), F.sum("abund"), F.sum("size")).first()) == (736, 240_920, 212_475)
    level, child = readers.hierarchy(spark, TREE)
    rows = search.level_abundance(abund, piece.select(F.col("dominator").alias("id"), F.col("id").alias("leaf")), child, level.select("id", "level"))
    assert rows.count() == 2_835
    assert {(r.a, r.s) for r in rows.groupBy("level").agg(F.sum("abund").alias("a"), F.sum("size").alias("s")).collect()} == {(240_920, 212_475)}


def test_reads_of_a_neighbourhood(spark, graph, piece):
    """The reads that share a k-mer with the query's nodes, with their qualities."""
    nodes, _ = graph
    own = staged(index.unique_index(nodes, K), "index")
    reads = readers.fastq(spark, SAMPLE)
    labels = staged(seq.kmer_keys(reads.withColumnRenamed("sequence", "seq"), "seq", K, "number").join(own, "kmer").select("number", "id").distinct(), "labels")
    doms = piece.where("id in (118, 187)").select(F.lit("q").alias("query"), "dominator").distinct()
    got = neighborhoods.records_of(neighborhoods.reads_of(doms, piece, labels, "number"), reads, "number").collect()
    want = {r.number for r in labels.where("id in (118, 187)").collect()}
    assert {r.number for r in got} == want and want and all(len(r.sequence) == len(r.quality) for r in got)


@pytest.mark.parametrize(("path", "translate"), [(published("*/*prot-query.faa"), False), (published("*/*translate-query.fa"), True)])
def test_protein_records(spark, graph, path, translate):
    nodes, _ = graph
    found = protein.record_hits(nodes, protein.record_index(records(spark, path), 10, translate=translate), 10)
    assert {r.id for r in found.collect()} == {63, 145}
