"""Regions, position profiles, named reads and sorted nodes against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kmerweave.jobs import regions
from kmerweave.operators import index


def rows(df):
    return sorted(map(tuple, df.collect()))


#: node -> children; leaves of level 1 in UNDER; root 30
CHILD = {20: [10, 11], 21: [12], 30: [20, 21, 13]}
UNDER = {10: [0, 1], 11: [2], 12: [3, 4, 5], 13: [6, 7]}
KMERS = {i: 3 * i + 4 for i in range(8)}


def under(n):
    return UNDER[n] if n in UNDER else [x for c in CHILD[n] for x in under(c)]


def tables(spark):
    child = spark.createDataFrame([(p, c) for p, cs in CHILD.items() for c in cs], "parent long, child long")
    piece = spark.createDataFrame([(d, x) for d, xs in UNDER.items() for x in xs], "id long, leaf long")
    stats = spark.createDataFrame([(n, len(under(n)), sum(KMERS[x] for x in under(n))) for n in [*UNDER, *CHILD]], "id long, size long, kmers long")
    return child, piece, stats


def test_decompose_and_characterise(spark):
    child, piece, stats = tables(spark)

    def first(n, most):
        if len(under(n)) <= most or n in UNDER:
            return {n}
        return set().union(*(first(c, most) for c in CHILD[n]))

    seqs = spark.createDataFrame([(i, "ACGT" * i + "AAC") for i in range(8)], "id long, seq string")
    for most, least in ((3, 0), (2, 15), (8, 0), (1, 0)):
        want = {n for n in first(30, most) if sum(KMERS[x] for x in under(n)) > least}
        got = regions.decompose(child, stats.select("id", "size"), piece, stats.select("id", "kmers"), most, least)
        assert {r.id for r in got.nodes.collect()} == want
        assert rows(got.leaves) == sorted((n, x) for n in want for x in under(n))
        kmers = sum(KMERS[x] for n in want for x in under(n))
        assert rows(got.summary) == [(len(want), sum(len(under(n)) for n in want), kmers, kmers / sum(KMERS.values()))]
    made = regions.characterise(got, seqs, "ACGT", 2)
    for n, kmer, count in map(tuple, made.select("region", "kmer", "n").collect()):
        assert count == sum(t[i : i + 2] == kmer for x in under(n) for t in ["ACGT" * x + "AAC"] for i in range(len(t) - 1))


def test_shadow_ratio(spark):
    child, piece, stats = tables(spark)
    kmers = {n: sum(KMERS[x] for x in under(n)) for n in [*UNDER, *CHILD]}

    def terminal(n, most):
        return set().union(*({c} if kmers[c] < most else terminal(c, most) if c in CHILD else set() for c in CHILD[n]))

    for most, least, fraction in ((60, 0, 0.5), (40, 5, 1.0), (200, 0, 0.3)):
        some = sorted((math.log2(kmers[n]) - math.log2(len(under(n))), n) for n in terminal(30, most) if kmers[n] > least)
        kept, run = [], 0
        for _, n in some:
            run += kmers[n]
            if run > fraction * kmers[30]:
                break
            kept.append(n)
        got = regions.shadow_ratio(child, stats.withColumnRenamed("size", "shadow"), piece, 30, most, least, fraction)
        assert [r[0] for r in rows(got.nodes)] == sorted(kept)
        assert rows(got.leaves) == sorted((n, x) for n in kept for x in under(n))


def test_position_profile(spark):
    nodes = spark.createDataFrame([(0, "GATTACAG", 5), (1, "CCCCGGTA", 5), (2, "TTTTCTTG", 6)], "id long, seq string, dominator long")
    info = spark.createDataFrame([(0, 5, 2.0), (1, 5, 1.5), (2, 5, 3.0)], "id long, n_kmers long, abund double")
    q = spark.createDataFrame([(9, "GATTANTTTTC"), (8, "AC")], "query long, seq string")
    got = regions.position_profile(q, index.unique_index(nodes, 4), nodes.select("id", "dominator"), info, 4)
    # GATT and ATTA of node 0; TTTT and TTTC of node 2; its dominator has 5 k-mers, the other 10
    want = {0: (5.0, 2, 10.0), 1: (5.0, 2, 10.0), 6: (2.5, 1, 15.0), 7: (2.5, 1, 15.0)}
    assert [tuple(r) for r in got.select("query", "pos", "var", "neighbors", "abund").orderBy("pos").collect()] == [(9, p, *want.get(p, (0.0, 0, 0.0))) for p in range(8)]


def brute_reads(reads, labels, k):
    """Reads in order, one after the other; a mate's union goes to both."""
    out, last, ids = set(), None, set()
    for number, name, seq in reads:
        if len(seq) < k:
            continue
        paired = last is not None and ((last[1].endswith("/1") and name.endswith("/2") and len(last[1]) > 2 and last[1][:-2] == name[:-2]) or (last[1] == name and name))
        if not paired:
            ids = set()
        ids = ids | {i for n, i in labels if n == number}
        out |= {(number, i) for i in ids} | ({(last[0], i) for i in ids} if paired else set())
        last = (number, name)
    return sorted(out)


def test_named_reads(spark):
    rng = random.Random(5)
    names = ["a/1", "a/2", "b", "b", "b", "c/1", "d/2", "", "", "e/1", "e/2", "e/1", "f/2", "/1", "/2"]
    for _ in range(3):
        names += [rng.choice(["g/1", "g/2", "h", "g/1"]) for _ in range(12)]
    reads = [(5 * i + 2, n, rng.choice(["ACGTA", "ACGTACC", "AC"])) for i, n in enumerate(names)]
    labels = [(r[0], rng.randint(0, 6)) for r in reads if len(r[2]) >= 4 for _ in range(rng.randint(0, 2))]
    r = spark.createDataFrame(reads, "number long, name string, seq string").repartition(3)
    lab = spark.createDataFrame(labels, "number long, id long")
    assert rows(regions.label_named_reads(r, lab, 4)) == brute_reads(reads, labels, 4)
    assert rows(regions.label_named_reads(r, lab, 4, ignore_paired=True)) == sorted(set(labels))
    with pytest.raises(ValueError):
        regions.label_named_reads(r, lab, 4, expect_paired=True, ignore_paired=True)
    with pytest.raises(ValueError):
        regions.label_named_reads(r.where("name = 'a/1'"), lab, 4, expect_paired=True)


def test_sorted_nodes_and_broken_links(spark):
    nodes = spark.createDataFrame([(4, "x"), (7, "y"), (9, "z")], "id long, seq string")
    hashes = spark.createDataFrame([(4, 30), (4, 100), (7, 9), (9, 200)], "id long, hash long")  # as text: 200 < 30 < 9
    arcs = [(4, 7), (7, 4), (9, 7), (7, 9), (4, 7)]
    d = lambda a: spark.createDataFrame(a, "src long, dst long")
    n, a = regions.sort_nodes(nodes, d(arcs), hashes.where("hash <> 100"))
    assert sorted((r.id, r.seq) for r in n.collect()) == [(0, "z"), (1, "x"), (2, "y")]
    assert rows(a) == [(0, 2), (1, 2), (2, 0), (2, 1)]
    for broken in ([(4, 7)], [(4, 5), (5, 4)]):
        with pytest.raises(ValueError):
            regions.sort_nodes(nodes, d(broken), hashes)


def test_audits_and_ranks(spark):
    leaves = spark.createDataFrame([(1,), (2,), (2,), (9,)], "leaf long")
    assert rows(regions.audit(leaves, spark.range(1, 4))) == [(3, "no leaf"), (9, "no node")]
    for ids, dense in (([0, 1, 2], True), ([0, 1, 1], False), ([1, 2], False), ([], True)):
        assert regions.densely_numbered(spark.createDataFrame([(i,) for i in ids], "id long")).first().dense is dense
    values = spark.createDataFrame([(x,) for x in "abcabcdbb"], "v string")
    assert rows(regions.ranked_counts(values, "v").select("rank", "v", F.col("n"))) == [(1, "b", 4), (2, "a", 2), (3, "c", 2), (4, "d", 1)]
