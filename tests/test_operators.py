import random

from pyspark.sql import functions as F

from kmerweave.jobs import search
from kmerweave.operators import annotate, hierarchy, index, sketch

TEXTS = ["GATTACAGATTACA", "TTTTCCCCGG", "ACGTACGTAA", "GG", "CCGATTACAGGA", "TTTTCCCC"]


def rows(df):
    return sorted(map(tuple, df.collect()))


def nodes(spark):
    return spark.createDataFrame([(i, t, i // 2) for i, t in enumerate(TEXTS)], "id long, seq string, dominator long")


def back(x):
    return x[::-1].translate(str.maketrans("ACGT", "TGCA"))


def km(t, k=4):
    """Each k-mer as the smaller of both strands."""
    return {min(t[i : i + k], back(t[i : i + k])) for i in range(len(t) - k + 1)}


def spelt(spark, df):
    """(k-mer as letters, id) of an index."""
    all_ = sorted(set().union(*map(km, TEXTS)))
    of = spark.createDataFrame([(x,) for x in all_], "word string").withColumn("kmer", F.struct(F.xxhash64("word").alias("h"), F.hash("word").alias("c")))
    return sorted(map(tuple, df.join(of, "kmer").select("word", "id").collect()))


def owners(k=4):
    out = {}
    for i, t in enumerate(TEXTS):
        for x in km(t, k):
            out.setdefault(x, set()).add(i)
    return out


def test_index_and_containment(spark):
    n = nodes(spark)
    own = {x: min(s) for x, s in owners().items() if len(s) == 1}
    idx = index.unique_index(n, 4)
    assert dict(spelt(spark, idx)) == own and idx.count() == len(own)
    q = spark.createDataFrame([(7, "GATTACATTTTCCCCG"), (8, "AA"), (9, "NNNNNN")], "query long, seq string")
    wanted = index.query_kmers(q, 4)
    got = {r.query: (r.n_query, r.n_found, r.containment) for r in index.containment(idx, wanted, q).collect()}
    mine = km("GATTACATTTTCCCCG")
    assert got == {7: (len(mine), len(mine & own.keys()), len(mine & own.keys()) / len(mine)), 8: (0, 0, 0.0), 9: (1, 0, 0.0)}
    assert dict(spelt(spark, index.unique_index(n, 4, wanted))) == {x: i for x, i in own.items() if x in mine}
    r = index.collisions(n, 4).first()
    assert (r.n_kmers, r.n_multi) == (len(owners()), sum(len(s) > 1 for s in owners().values()))


def test_both_strands_match(spark):
    n = nodes(spark)
    idx = index.unique_index(n, 4)
    for turn in (lambda x: x, back):
        q = spark.createDataFrame([(1, turn("GATTACAGATT"))], "query long, seq string")
        assert [r.id for r in search.exact_search(n, idx, q, 4).collect()] == [0]
        asked = km("GATTACAGATT")
        assert rows(index.shares_kmer(n, q, 4, "id")) == [(i,) for i, t in enumerate(TEXTS) if km(t) & asked]
        own = [x for x in (min("GATTACAGATT"[i : i + 4], back("GATTACAGATT"[i : i + 4])) for i in range(8)) if owners().get(x) == {0}]
        assert rows(search.sample_abundance(idx, index.node_sizes(n, 4), q, 4))[0] == (0, len(own), 11)
    a, b = (sketch.scaled_sketch(spark.createDataFrame([(1, x)], "id long, seq string"), 4, 1, "id") for x in ("GATTACAGATTCC", back("GATTACAGATTCC")))
    assert rows(a) == rows(b)


def test_neighborhood_search(spark):
    n = nodes(spark)
    q = spark.createDataFrame([(1, "ACGTACGT")], "query long, seq string")
    s = search.neighborhood_search(n, index.unique_index(n, 4), n.select("id", "dominator"), q, 4)
    assert rows(s.matches) == [(2, len(km("ACGTACGT")))] and [r[0] for r in rows(s.ids)] == [2, 3]
    got = s.summary.first()
    assert (got.n_matched, got.num_query_kmers, got.bp, got.best_containment) == (3, 3, 12, 1.0)
    assert s.curve.first().sum_cont == 3
    none = spark.createDataFrame([(1, "NNNNNNN")], "query long, seq string")
    assert search.neighborhood_search(n, index.unique_index(n, 4), n.select("id", "dominator"), none, 4).summary.first().best_containment == 0.0


def test_protein_search(spark):
    n = spark.createDataFrame([(1, "CCATGGCCAAATTTGG"), (2, "CCCCCCCCCCCCCCC"), (3, "CCAAATTTGGCCATGG")], "id long, seq string")
    prot = spark.createDataFrame([(1, "MAKF")], "query long, seq string")
    assert rows(search.protein_search(n, prot, 4)) == [(1,), (3,)]  # 3 is 1 read backwards
    dna = spark.createDataFrame([(1, "ATGGCCAAATTT")], "query long, seq string")
    assert (1,) in rows(search.protein_search(n, dna, 4, translate_query=True))


def test_sample_abundance(spark):
    n = nodes(spark)
    idx, sizes = index.unique_index(n, 4), index.node_sizes(n, 4)
    got = rows(search.sample_abundance(idx, sizes, n.select("seq"), 4))
    own = {x: min(s) for x, s in owners().items() if len(s) == 1}
    want = {i: [0, len(t) - 3] for i, t in enumerate(TEXTS) if len(t) >= 4}
    for t in TEXTS:
        for i in range(len(t) - 3):
            x = min(t[i : i + 4], back(t[i : i + 4]))
            if x in own:
                want[own[x]][0] += 1
    assert got == sorted((i, a, s) for i, (a, s) in want.items())


def test_gather_is_greedy(spark):
    q = spark.createDataFrame([(i,) for i in range(10)], "hash long")
    refs = spark.createDataFrame([(1, i) for i in range(6)] + [(2, i) for i in range(4, 9)] + [(3, 0), (3, 9), (4, 50)], "id long, hash long")
    assert [(r.id, r.unique) for r in sketch.gather(q, refs, "id").orderBy("rank").collect()] == [(1, 6), (2, 3), (3, 1)]
    assert [r.id for r in sketch.gather(q, refs, "id", least=0.2).orderBy("rank").collect()] == [1, 2]


def tree(spark, seed=1, n=60):
    rng = random.Random(seed)
    parent = {i: rng.randrange(max(0, i - 12), i) for i in range(1, n)}
    return parent


def test_hierarchy_cuts_against_walks(spark):
    parent = tree(spark)
    kids = {}
    for c, p in parent.items():
        kids.setdefault(p, []).append(c)
    rng = random.Random(2)
    own = {i: rng.randint(1, 9) for i in range(60)}

    def size(i):
        return own[i] if i not in kids else sum(map(size, kids[i]))

    sizes = {i: size(i) for i in range(60)}
    child = spark.createDataFrame([(p, c) for c, p in parent.items()], "parent long, child long")
    df = spark.createDataFrame(list(sizes.items()), "id long, size long")

    def walk(i, most):
        return [i] if sizes[i] <= most or i not in kids else [x for c in kids[i] for x in walk(c, most)]

    assert [r[0] for r in rows(hierarchy.antichain(child, df, 20))] == sorted(walk(0, 20))

    def ends(i, most):
        return [i] if sizes[i] < most else [x for c in kids.get(i, ()) for x in ends(c, most)]

    assert [r[0] for r in rows(hierarchy.terminal_nodes(child, df, 20, 0))] == sorted(x for c in kids[0] for x in ends(c, 20))
    odd = lambda i: sizes[i] % 3 == 0

    def firsts(i):
        return [i] if odd(i) else [x for c in kids.get(i, ()) for x in firsts(c)]

    got = hierarchy.first_below(child, df, 0, F.col("size") % 3 == 0)
    assert [r[0] for r in rows(got)] == sorted(x for c in kids[0] for x in firsts(c))


def test_curves(spark):
    rng = random.Random(3)
    parts = [(i, rng.randint(0, 5), rng.randint(0, 3)) for i in range(500)]
    df = spark.createDataFrame(parts, "id long, cont long, oh long")
    order = sorted((r for r in parts if r[1]), key=lambda r: (r[1], r[2], r[0]), reverse=True)
    want, a, b = [], 0, 0
    for k, (i, c, o) in enumerate(order, 1):
        a, b = a + c, b + o
        want.append((k, i, a, b))
    curve = hierarchy.response_curve(df)
    assert rows(curve.select("place", "id", "sum_cont", "sum_oh")) == want
    places = [r.place for r in hierarchy.sampled(curve, 50).orderBy("place").collect()]
    assert places == sorted({*range(1, len(order) + 1, len(order) // 50), len(order)})
    last = curve.orderBy(F.desc("place")).first()
    assert (last.relative_cont, last.relative_oh) == (1.0, b / a)
    kept = hierarchy.keep_prefix(df.selectExpr("id", "cont + 1 as size", "cast(oh as double) as ratio"), 0.4)
    total, run, ids = sum(c + 1 for _, c, _ in parts), 0, []
    for i, c, _ in sorted(parts, key=lambda r: (r[2], r[0])):
        run += c + 1
        if run <= 0.4 * total:
            ids.append(i)
    assert sorted(r.id for r in kept.collect()) == sorted(ids)


def test_taxonomy(spark):
    hits = spark.createDataFrame([(1, "A", "x"), (1, "A", "y"), (1, "A", "y"), (2, "B", "z"), (3, "A", "x"), (3, "B", "z")], "g long, r1 string, r2 string")
    p = annotate.purity(hits, "g", ["r1", "r2"])
    assert rows(p) == [(1, 1, "A", 1.0), (1, 2, "A;y", 2 / 3), (2, 1, "B", 1.0), (2, 2, "B;z", 1.0), (3, 1, "A", 0.5), (3, 2, "A;x", 0.5)]
    assert rows(annotate.pure_rank(p, "g")) == [(1, 1), (2, 2), (3, 0)]
    assert rows(annotate.lca(hits, "g", ["r1", "r2"])) == [(1, 1, "A"), (2, 2, "B;z"), (3, 0, "")]


def test_mates_share_labels(spark):
    reads = spark.createDataFrame([(1, 0, "u"), (1, 1, "a"), (1, 2, "u"), (1, 3, "u"), (1, 4, "a")], "c long, t long, role string")
    labels = spark.createDataFrame([(1, 0, 10), (1, 1, 11), (1, 2, 12), (1, 4, 13)], "c long, t long, id long")
    assert rows(annotate.pair_reads(labels, reads, "c", "t")) == [(1, 0, 10), (1, 0, 11), (1, 2, 12), (1, 3, 13)]


def test_ancestors_of_any_depth(spark):
    """A chain of 100 levels, and a graph whose nodes have several parents."""
    chain = [(i + 1, i) for i in range(100)]
    got = {tuple(r) for r in hierarchy.ancestors(spark.createDataFrame(chain, "parent long, child long")).collect()}
    assert got == {(a, d) for a in range(101) for d in range(a)}
    level = spark.range(101).selectExpr("id", "cast(id + 1 as int) as level")
    assert hierarchy.closure(spark.createDataFrame(chain, "parent long, child long"), level).count() == 101
    pairs = [(5, 1), (5, 2), (6, 2), (6, 3), (7, 5), (7, 6), (8, 6), (9, 7), (9, 8), (9, 1)]
    want = {(p, c) for p, c in pairs}
    while more := {(a, d) for a, m in want for n, d in want if m == n} - want:
        want |= more
    assert {tuple(r) for r in hierarchy.ancestors(spark.createDataFrame(pairs, "parent long, child long")).collect()} == want
    assert hierarchy.ancestors(spark.createDataFrame([], "parent long, child long")).count() == 0


def test_a_cycle_raises(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(hierarchy, "MOST_ROUNDS", 4)
    with pytest.raises(ValueError, match="lead back"):
        hierarchy.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "parent long, child long"))
