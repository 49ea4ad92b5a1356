import math
import random
import re
from collections import Counter, defaultdict

from kmerweave.llm import mixing


def rows(seed=5, sources=("b", "a", "Z", None, "ö", "c")):
    rng = random.Random(seed)
    out = []
    for i, s in enumerate(sources):
        for _ in range(rng.choice([3, 40, 200])):
            n = min(int(rng.paretovariate(0.8) * 4), 3000)
            out.append((len(out), s, " ".join(["wörd"] * n)))
        out.append((len(out), s, rng.choice([None, "", " \n\t"])))
        if i == 1:
            out += [(len(out) + j, s, "one two\nthree still\x0bfour\x1cstill") for j in range(500)]
    return out + [out[7], out[7]]


def literal_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full = set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        t = {s: most * sizes[s] if s in full else rest * weight[s] / free for s in order}
        over = {s for s in order if t[s] > most * sizes[s]} - full
        if not over:
            return t
        full |= over


def literal_rates(sizes, target, most=3):
    """Rates min(most, exp(x * size)) by plain bisection over x."""
    total = sum(sizes)
    if target <= 0 or target >= most * total:
        return dict.fromkeys(sizes, 0.0 if target <= 0 else float(most))
    words = lambda x: sum(s * min(most, math.exp(min(700, x * s))) for s in sizes)
    low, high = -50.0, 50.0
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if words(mid) < target else (low, mid)
    return {s: min(most, math.exp(min(700, low * s))) for s in sizes}


def frame(spark, data):
    return spark.createDataFrame([(a, b, c, 1, "x") for a, b, c in data], "doc_id long, source string, text string, size int, _source string").repartition(3)


def test_like_the_definition(spark):
    data = rows()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for _, s, t in data:
        by[s].append(size(t))
    want = literal_targets({s: sum(x) for s, x in by.items()})
    got = mixing.mix(frame(spark, data)).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((d, s, size(t)) for d, s, t in data)
    taken, per = defaultdict(int), defaultdict(lambda: [0, 0])
    for r in got:
        assert r.source_size == sum(by[r.source]) and math.isclose(r.target, want[r.source], rel_tol=1e-12)
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
        c = per[r.source, r["size"]]
        c[0], c[1] = c[0] + 1, c[1] + r.copies
    for s, sizes in by.items():
        # far less than a document; a source of a few documents misses by half the longest at most
        assert abs(taken[s] - want[s]) <= (5 if len(sizes) > 20 else max(sizes) / 2), s
        rate = literal_rates([x for x in sizes if x], want[s])
        # words follow the running sums of the tilted rates, but for half a longest document and as much of corrections
        drift = 0.0
        for n in sorted({x for x in sizes if x}, reverse=True):
            docs, k = per[s, n]
            drift += (k - docs * rate[n]) * n
            assert abs(drift) <= 1.5 * max(sizes) + 1e-6
            assert max(r.copies for r in got if (r.source, r["size"]) == (s, n)) - min(r.copies for r in got if (r.source, r["size"]) == (s, n)) <= 1


def test_rates_are_the_nearest_to_one(spark):
    """No shift of words between two sizes of a source lowers the relative entropy: log(rate) is straight in size."""
    data = [(i, "a", " ".join(["w"] * (1 + i % 90))) for i in range(900)] + [(9000 + i, "b", " ".join(["w"] * (1 + i % 50))) for i in range(200)]
    cells = spark.createDataFrame([(s, n, c) for (s, n), c in Counter((s, len(t.split())) for _, s, t in data).items()], "source string, size long, n long")
    sums = {s: sum(len(t.split()) for _, x, t in data if x == s) for s in "ab"}
    wanted = spark.createDataFrame([("a", sums["a"], 0.7 * sums["a"]), ("b", sums["b"], 2.2 * sums["b"])], "source string, source_size long, target double")
    for r in mixing.multipliers(cells, wanted).collect():
        rate = literal_rates([len(t.split()) for _, s, t in data if s == r.source], r.target)
        assert all(math.isclose(min(3.0, math.exp(r.x * n)), v, rel_tol=1e-6) for n, v in rate.items())


def test_broadcast_and_shuffle_and_reruns_agree(spark, monkeypatch):
    data = rows(8, ("a", None, "b"))
    got = sorted(map(tuple, mixing.mix(frame(spark, data)).collect()), key=repr)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert got == sorted(map(tuple, mixing.mix(frame(spark, data)).collect()), key=repr)


def test_small_inputs(spark):
    assert mixing.mix(frame(spark, rows()).limit(0)).count() == 0
    none = mixing.mix(frame(spark, [(1, None, None), (2, "a", ""), (None, "a", " ")])).collect()
    assert [(r.copies, r["size"], r.target) for r in none] == [(0, 0, 0.0)] * 3
    one = mixing.mix(frame(spark, [(1, "a", "x y z")])).collect()[0]
    assert (one.target, one.copies) == (3.0, 1)
    null_id = mixing.mix(frame(spark, [(None, "a", "x y"), (None, "a", "x y"), (3, "b", "z")])).collect()
    assert len(null_id) == 3 and all(0 <= r.copies <= 3 for r in null_id)
