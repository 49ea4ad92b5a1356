"""Abundance of a sample under every node of a hierarchy."""

from kmerweave.jobs import search


def test_every_level_holds_all_leaves(spark):
    # leaves 0..7; level 1: 10 (0, 1), 11 (2), 12 (3, 4, 5), 13 (6, 7); level 2: 20 (10, 11), 21 (12); root 30 (20, 21, 13)
    abund = spark.createDataFrame([(i, 10 * i, i + 1) for i in range(8)], "id long, abund long, size long")
    under = {10: [0, 1], 11: [2], 12: [3, 4, 5], 13: [6, 7]}
    piece = spark.createDataFrame([(d, leaf) for d, ls in under.items() for leaf in ls], "id long, leaf long")
    child = spark.createDataFrame([(20, 10), (20, 11), (21, 12), (30, 20), (30, 21), (30, 13)], "parent long, child long")
    level = spark.createDataFrame([(10, 1), (11, 1), (12, 1), (13, 1), (20, 2), (21, 2), (30, 3)], "id long, level int")
    total = lambda ids: (sum(10 * i for i in ids), sum(i + 1 for i in ids))
    want = [(d, 1, *total(ls)) for d, ls in under.items()] + [(20, 2, *total([0, 1, 2])), (21, 2, *total([3, 4, 5])), (13, 2, *total([6, 7])), (30, 3, *total(range(8)))]
    got = search.level_abundance(abund, piece, child, level)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert search.level_abundance(abund, piece, child, level.limit(0)).count() == 0
