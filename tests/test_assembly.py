"""Unitigs and their contraction against a walk over sets."""

import random

from kmerweave.operators import assembly

PAIR = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(PAIR)


def walk(counts, k):
    """Node sequences (the smaller strand; None for those of cycles), k-mer sets and totals, and adjacent pairs of sets."""
    v = {x for c in counts for x in (c, rc(c))}
    out = {u: [w for c in "ACGT" if (w := u[1:] + c) in v] for u in v}
    into = {u: [w for c in "ACGT" if (w := c + u[:-1]) in v] for u in v}

    def step(u):
        if len(out[u]) == 1 and len(into[out[u][0]]) == 1:
            w = out[u][0]
            if w != rc(u) and u != rc(u) and w != rc(w) and u != w:
                return w
        return None

    ahead = {u: w for u in v if (w := step(u))}
    back = {w: u for u, w in ahead.items()}
    found, seen, ends = {}, set(), {}
    for u in sorted(v, key=lambda u: (u in back, u)):
        if u in seen:
            continue
        path = [u]
        while path[-1] in ahead and ahead[path[-1]] != u:
            path.append(ahead[path[-1]])
        round_ = u in back
        if round_:  # on a cycle, which is cut before its smallest k-mer
            at = min(range(len(path)), key=lambda i: min(path[i], rc(path[i])))
            path = path[at:] + path[:at]
        seen |= set(path)
        name = frozenset(min(x, rc(x)) for x in path)
        s = path[0] + "".join(x[-1] for x in path[1:])
        if round_:
            found[name] = None
        else:
            found[name] = min(found.get(name) or s, s)
        ends.setdefault(("head", path[0]), name)
        ends.setdefault(("tail", path[-1]), name)
    near = {(ends["tail", u], ends["head", w]) for u in v for w in out[u] if ("tail", u) in ends and ("head", w) in ends}
    near = {frozenset((a, b)) for a, b in near if a != b}
    return found, near


def check(got, counts, k):
    nodes, near = walk(counts, k)
    rows = got.nodes.collect()
    assert sorted(r.id for r in rows) == list(range(len(rows)))
    sets = {r.id: frozenset(min(x, rc(x)) for i in range(len(r.seq) - k + 1) for x in [r.seq[i : i + k]]) for r in rows}
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, nodes))
    for r in rows:
        want = nodes[sets[r.id]]
        assert len(r.seq) == len(sets[r.id]) + k - 1 and r.n_kmers == len(sets[r.id])
        assert want is None or r.seq == want
        assert abs(r.abund - sum(counts[x] for x in sets[r.id]) / r.n_kmers) < 1e-9
    assert {frozenset((sets[a.src], sets[a.dst])) for a in got.arcs.collect()} == near
    return sets


def counted(reads, k):
    n = {}
    for s in reads:
        for i in range(len(s) - k + 1):
            x = min(s[i : i + k], rc(s[i : i + k]))
            n[x] = n.get(x, 0) + 1
    return n


def test_unitigs(spark):
    rng = random.Random(9)
    genome = "".join(rng.choice("ACGT") for _ in range(150))
    ring = "".join(rng.choice("ACGT") for _ in range(20))
    cases = {
        7: [genome[i : i + 40] for i in range(0, 120, 10)] + [rc(genome[15:35]) + "TTTTTTTTTT", ring + ring[:8], genome[60:90]],
        5: [ring * 2, genome[:60], rc(genome[40:90]), "ACGT", ""],
    }
    df = spark.createDataFrame([(r,) for r in [*cases[5], None]], "seq string")
    check(assembly.unitigs(df, 5), counted(cases[5], 5), 5)
    often = {x: n for x, n in counted(cases[7], 7).items() if n >= 2}
    check(assembly.unitigs(spark.createDataFrame([(r,) for r in cases[7]], "seq string"), 7, 2), often, 7)
    empty = assembly.unitigs(spark.createDataFrame([], "seq string"), 7)
    assert empty.nodes.count() == empty.arcs.count() == 0


def test_contract_chains(spark):
    k = 9
    rng = random.Random(4)
    s = next(s for s in iter(lambda: "".join(rng.choice("ACGT") for _ in range(60)), None) if len({x for i in range(53) for x in (s[i : i + 8], rc(s[i : i + 8]))}) == 106)  # no overlap comes twice
    wrong = s[20:35] + ("A" if s[35] != "A" else "C") + "GG"  # an erroneous read: a branch that ends
    reads = [s, s, s, wrong]
    found = assembly.unitigs(spark.createDataFrame([(r,) for r in reads], "seq string"), k)
    assert found.nodes.count() > 2
    got = assembly.contract_chains(found, k)
    rows = sorted(got.nodes.collect(), key=lambda r: -len(r.seq))
    # the branch is cut off and the rest is one unitig again; the wrong read's first k-mers count too
    assert rows[0].seq in (s, rc(s)) and rows[0].n_kmers == len(s) - k + 1
    n = counted(reads, k)
    own = [min(s[i : i + k], rc(s[i : i + k])) for i in range(len(s) - k + 1)]
    assert abs(rows[0].abund - sum(n[x] for x in own) / len(own)) < 1e-9
    assert [r.n_kmers for r in rows[1:]] == [3] and got.arcs.count() == 0
    assert sorted(r.id for r in rows) == list(range(len(rows)))


def test_directed_path(spark):
    k = 4
    mid = "ACCGATTG"
    before, behind, side = "TTTACC", "TTGAAA", "GGGACC"
    df = spark.createDataFrame([(before, behind, mid), (behind, before, mid), (before, side, mid), (rc(before), behind, mid)], "a string, b string, s string")
    assert [r.p for r in df.select(assembly.directed_path("a", "b", "s", k).alias("p")).collect()] == [True, True, False, True]
