"""Bloom filters, the kept index, and searches of proteins by record."""

import random

from pyspark.sql import functions as F

from kmerweave.functions import sequence
from kmerweave.functions.sequence import kmer_keys
from kmerweave.operators import bloom, index, protein
from kmerweave.operators.kept import KeptIndex


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_filter_drops_no_key_and_passes_few_others(spark):
    keys = spark.range(0, 40_000, 2).select(F.struct(F.col("id").alias("h"), F.hash("id").alias("c")).alias("k"))
    filter_ = bloom.build(keys, "k", 20_000)
    all_ = spark.range(40_000).select("id", F.struct(F.col("id").alias("h"), F.hash("id").alias("c")).alias("k"))
    got = {r.id for r in bloom.sift(all_, "k", filter_).select("id").collect()}
    assert set(range(0, 40_000, 2)) <= got
    assert (len(got) - 20_000) / 20_000 <= 2 * bloom.expected_rate() < 0.07
    assert filter_.first().bits == 64 * len(filter_.first().words)


def test_empty_and_oversized_filters(spark):
    none = spark.range(0).select(F.col("id").alias("k"))
    assert bloom.sift(spark.range(9).select(F.col("id").alias("k")), "k", bloom.build(none, "k", 0)).count() == 0
    assert bloom.build(none, "k", bloom.MOST_BITS) is None


def test_index_with_and_without_filter(spark, monkeypatch):
    rng = random.Random(2)
    seqs = [dna(rng, rng.randint(3, 60)) for _ in range(60)]
    nodes = spark.createDataFrame([(i, s + seqs[(i * 7) % 60][:20]) for i, s in enumerate(seqs)], "id long, seq string")
    wanted = kmer_keys(nodes.where("id % 3 = 0"), "seq", 9)
    plain = sorted(map(tuple, index.unique_index(nodes, 9, wanted).collect()))
    monkeypatch.setattr(index, "BROADCAST_ROWS", 0)
    assert plain == sorted(map(tuple, index.unique_index(nodes, 9, wanted).collect()))
    monkeypatch.setattr(bloom, "MOST_BITS", 0)
    assert plain == sorted(map(tuple, index.unique_index(nodes, 9, wanted).collect()))


def test_kept_index_grows_like_a_rebuild(spark, tmp_path):
    rng = random.Random(3)
    shared = dna(rng, 30)
    nodes = spark.createDataFrame([(i, dna(rng, 40) + (shared if i in (2, 7, 11) else "")) for i in range(12)] + [(12, None), (13, "AC")], "id long, seq string")
    kept = KeptIndex(spark, str(tmp_path / "grown"), 11, 4).build(nodes.where("id < 5"))
    first = kept.rows()
    before = kept.unique().count()
    assert kept.collisions().first().n_multi == 0
    kept.grow(nodes.where("id between 5 and 9")).grow(nodes.where("id > 9"))
    whole = KeptIndex(spark, str(tmp_path / "whole"), 11, 4).build(nodes)
    assert sorted(map(tuple, kept.rows().collect())) == sorted(map(tuple, whole.rows().collect()))
    assert sorted(map(tuple, kept.unique().collect())) == sorted((r.kmer.h, r.kmer.c, r.id) for r in index.unique_index(nodes, 11).collect())
    assert kept.collisions().first() == index.collisions(nodes, 11).first() and kept.collisions().first().n_multi >= 20  # the shared stretch is no node's own any more
    assert first.where("least = most").count() == before  # an older version is still there
    wanted = kmer_keys(nodes.where("id in (1, 2, 8)"), "seq", 11)
    assert sorted(map(tuple, kept.matches(wanted).collect())) == sorted(map(tuple, index.matches(index.unique_index(nodes, 11), wanted).collect()))


def test_kept_index_is_not_shuffled(spark, tmp_path):
    rng = random.Random(4)
    nodes = spark.createDataFrame([(i, dna(rng, 50)) for i in range(20)], "id long, seq string")
    kept = KeptIndex(spark, str(tmp_path / "kept"), 11, 4).build(nodes)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = kept.hits(kmer_keys(nodes, "seq", 11))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


AMINO = "ACDEFGHIKLMNPQRSTVWY"


def test_records_of_proteins(spark):
    rng = random.Random(5)
    codon = {"A": "GCT", "C": "TGT", "D": "GAT", "E": "GAA", "F": "TTT", "G": "GGT", "H": "CAT", "I": "ATT", "K": "AAA", "L": "CTT", "M": "ATG", "N": "AAT", "P": "CCT", "Q": "CAA", "R": "CGT", "S": "TCT", "T": "ACT", "V": "GTT", "W": "TGG", "Y": "TAT"}
    proteins = ["".join(rng.choice(AMINO) for _ in range(30)) for _ in range(6)]
    coded = ["".join(codon[a] for a in p) for p in proteins]
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    nodes = spark.createDataFrame([(0, coded[0]), (1, "A" + coded[1]), (2, turned("CC" + coded[2])), (3, dna(rng, 90)), (4, coded[0][15:] + coded[3]), (5, None), (6, "ACG")], "id long, seq string")
    records = spark.createDataFrame([("p0", proteins[0]), ("p1", proteins[1]), ("p2", proteins[2]), ("p3", proteins[3]), ("both", proteins[0] + proteins[3]), ("none", proteins[5]), ("empty", None)], "record string, seq string")
    got = sorted(map(tuple, protein.record_hits(nodes, protein.record_index(records, 10), 10).collect()))
    assert got == [("both", 0), ("both", 4), ("p0", 0), ("p0", 4), ("p1", 1), ("p2", 2), ("p3", 4)]
    translated = spark.createDataFrame([("q", coded[1])], "record string, seq string")
    assert [tuple(r) for r in protein.record_hits(nodes, protein.record_index(translated, 10, translate=True), 10).collect()] == [("q", 1)]
    whole = protein.protein_sketch(records, 10, 1, "record")
    assert whole.where("record = 'p0'").count() == 21
    some = protein.protein_sketch(records, 10, 4, "record")
    assert 0 < some.count() < whole.count() and some.where("hash < 0 or hash > 4611686018427387904").count() == 0


def test_kept_index_moves_and_keeps_no_row_for_every_kmer(spark, tmp_path, monkeypatch):
    """What is kept are stretches; no exchange is by k-mer, growth over the buckets' share writes anew, and wanted k-mers may come with their minimizers or not, few or many."""
    rng = random.Random(6)
    shared = dna(rng, 300)
    nodes = spark.createDataFrame([(i, dna(rng, 400) + shared[i * 9 :][:60]) for i in range(30)] + [(None, dna(rng, 90))], "id long, seq string")
    monkeypatch.setattr(sequence, "SHARE", 1000)
    kept = KeptIndex(spark, str(tmp_path / "kept"), 31, 4).build(nodes.where("id < 5"))
    assert kept.buckets == 5
    first, before = kept.rows(), kept.rows().count()
    kept.grow(nodes.where("id between 5 and 7"))
    assert kept.buckets == 5
    kept.grow(nodes.where("id > 7 or id is null"))
    assert kept.buckets == 28 and first.count() == before
    n, kmers = spark.table(kept.table).count(), kept.rows().count()
    assert kmers == kmer_keys(nodes, "seq", 31).select("kmer").distinct().count() and 4 * n < kmers
    rows = kept.rows()
    rows.collect()
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert kept.collisions().first() == index.collisions(nodes, 31).first()
    asked = nodes.where("id in (1, 4, 20)").select(F.col("id").alias("query"), "seq")
    want = sorted(map(tuple, index.matches(index.unique_index(nodes, 31), index.query_kmers(asked, 31)).collect()))
    for rows in (index.BROADCAST_ROWS, 10):
        monkeypatch.setattr(index, "BROADCAST_ROWS", rows)
        for wanted in (index.query_kmers(asked, 31), index.dealt_kmers(asked, 31)):
            assert sorted(map(tuple, kept.matches(wanted).collect())) == want
