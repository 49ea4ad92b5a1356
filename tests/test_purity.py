"""Purity of groups whose hits have several lineages."""

from kmerweave.operators import annotate


def test_several_lineages_of_a_hit_count_once(spark):
    # group 1: hash 10 has two lineages below A, hash 11 one; group 2: hash 12 has A and B, hash 13 has A
    hits = spark.createDataFrame([(1, 10, "A", "x"), (1, 10, "A", "y"), (1, 11, "A", "x"), (2, 12, "A", "x"), (2, 12, "B", "z"), (2, 13, "A", "x")], "g long, hash long, r1 string, r2 string")
    p = annotate.purity(hits, "g", ["r1", "r2"], hit="hash")
    assert sorted(map(tuple, p.collect())) == [(1, 1, "A", 1.0), (1, 2, "A;x", 1.0), (2, 1, "A", 1.0), (2, 2, "A;x", 1.0)]
