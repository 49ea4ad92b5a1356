import random

import numpy as np
import pytest

from kmerweave.llm import _text, jaccard


def brute(rows, n, percent):
    """Component ids by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(s), low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def cases(seed):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, common = [], text(60)
    for _ in range(25):
        base = text(rng.choice([3, 8, 40, 120]))
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 18)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" ".join(w if rng.random() < 0.8 else w + common))
    hot = text(90)
    for _ in range(60):  # one large group of near copies, some of them far from each other
        w = list(hot)
        for _ in range(rng.choice([0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append(" ".join(w))
    rows += [" ".join(common + text(3)) for _ in range(15)] + [rows[0], rows[0].upper(), None, None, "", " \n", "one", "One", "two words", "x " * 3000]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(10 * i, rows[i]) for i in order]


@pytest.mark.parametrize(("seed", "percent", "leaders"), [(1, 85, jaccard.LEADERS), (2, 70, (1, None))])
def test_like_brute_force(spark, monkeypatch, seed, percent, leaders):
    monkeypatch.setattr(jaccard, "LEADERS", leaders)
    monkeypatch.setattr(jaccard, "CHUNK_ROWS", 17)
    rows = cases(seed)
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(3)
    got = jaccard.similar(d, 4, percent)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, percent)


def test_repeated_rows_and_empty_table(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (3, None), (3, None), (9, "A B C D E"), (4, "q r s t u")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.similar(d).collect())) == brute(rows, 4, 85)
    assert {r.doc_id for r in jaccard.keep_one(d).collect()} == {3, 4, 5}
    assert jaccard.similar(d.limit(0)).count() == 0


def test_packed_keys():
    h = _text.mix(np.arange(100, dtype=np.uint64))
    assert (jaccard._unpack(jaccard._pack(h)) == h & np.uint64(2**40 - 1)).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                m = min(root.get(a, a), root.get(b, b))
                root[a] = root[b] = m
    assert got == {k: v for k, v in root.items() if k != v}
