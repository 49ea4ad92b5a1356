import random
import zlib

import numpy as np
import pyarrow as pa

from kmerweave.llm import _text, toxicity as tx

CLEAN = "the river town people water house wind along other never always morning light stone".split()
BAD = "idiot moron stupid".split()


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [rng.choice(CLEAN) + rng.choice(["", "", "."]) for _ in range(rng.randint(20, 90))]
        if i % 3 == 0:
            for x in rng.sample(BAD, 2):
                w.insert(rng.randrange(len(w)), x)
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    return rows


def brute_kernel(a, b):
    """Sum over common gapped subsequences, from all index triples."""

    def phi(w):
        c, out = [int(tx._CODES[x]) for x in b"\x01" + w + b"\x02"], {}
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, min(len(c), i + tx.WIDTH)):
                    out[c[i], c[j], c[k]] = out.get((c[i], c[j], c[k]), 0) + tx.DECAY ** (k - i + 1 - 3)
        return out

    x, y = phi(a), phi(b)
    dot = sum(v * y.get(k, 0) for k, v in x.items())
    return dot / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())) if x and y else 0


def test_kernel_like_brute_force():
    words = [b"idiot", b"idxiot", b"moron", b"a", b"", "éàç".encode(), b"abc" * 200, b"stupid", b"aaaa"]
    marks = [b"idiot", b"moron", b"stupid", b"aaa"]
    got = tx.kernel(marks)(words)
    assert np.allclose(got, [[brute_kernel(a, b) for b in marks] for a in words], atol=1e-5)
    assert got[0, 0] > got[1, 0] > 0.5 > got[2, 0]


def test_bare():
    assert [tx.bare(w) for w in (b"id*iot,", b"i-d-i-o-t", b"idiooot", b"--", b"(scum)")] == [b"idiot", b"idiot", b"idiot", b"--", b"scum"]


def test_held_out_and_spellings(spark):
    rows = made(450, 1)
    d = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(900, None, 0.1), (901, "", 0.1), (902, "x " * 50_000, 0.1), (3, rows[3][1], 0.1)], "doc_id long, text string, score double")
    lab = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = tx.fit(d, lab)
    got = {r.doc_id: r.score for r in tx.score(d, model).collect()}
    assert got[900] == got[901] == 0.0
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([(got[i] >= tx.THRESHOLD) == y for i, _, y in held]) > 0.95
    one = lambda t: tx.score_words(model, 1, _text.split_words(pa.array([t.encode()], pa.binary()), tx._TABLE))[0]
    base = rows[1][1]
    for x in ("idiot moron", "id*iot mor-on", "i d i o t x m o r o n", "idiiiot morrron", "id1ot m0ron"):
        assert one(base + " " + x) >= tx.THRESHOLD, x
    assert abs(one(rows[7][1]) - got[7]) < 1e-6


def test_no_labels(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {r.score for r in tx.score(d, tx.fit(d, lab)).collect()} == {0.0}
    assert tx.score(d.limit(0), tx.fit(d, lab.limit(0))).count() == 0


def test_machine_like_its_definition():
    """The weights minimise the objective: no small step in any direction does better, and plain gradient descent ends there."""
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=(60, 5)), np.ones(60)])
    rows = np.arange(0, 60, 2)
    y = np.where(x[rows, 0] + 0.3 * rng.normal(size=rows.size) > 0, 1.0, -1.0)
    weight = rng.uniform(0.01, 0.1, rows.size)
    reg = 1e-3 * np.eye(6)
    reg[-1, -1] = 1e-8

    def objective(w):
        return 0.5 * w @ reg @ w + 0.5 * sum(a * max(0.0, 1 - s * (b @ w)) ** 2 for a, s, b in zip(weight, y, x[rows], strict=True))

    w = tx._squared_hinge(x, rows, y, weight, 1e-3, steps=200)
    for _ in range(200):
        assert objective(w) <= objective(w + 1e-3 * rng.normal(size=6)) + 1e-9
    slow = np.zeros(6)
    for _ in range(4000):
        slow -= 0.3 * (reg @ slow - sum(a * max(0.0, 1 - s * (b @ slow)) * s * b for a, s, b in zip(weight, y, x[rows], strict=True)))
    assert abs(objective(slow) - objective(w)) < 1e-3


def test_score_by_hand():
    """Sentences, strongest words and their layer, one document at a time from the kernel's definition."""
    model = tx.train([t for _, t, _ in made(90, 3)], [y for _, _, y in made(90, 3)])
    for text in ("The river idiot. Never moron other people", "stupid", "a b c idiot. x", "light " * 70 + "idiot"):
        words = text.lower().encode().split()
        # runs of three or more single letters are one word
        begin, runs = tx._layout(_text.split_words(pa.array([text.encode()], pa.binary()), tx._TABLE))
        spelt = [tx.bare(w) for w in words]
        for a, b in runs:
            spelt[a] = tx.bare(b"".join(words[a:b]))
        value = [float((model.kernel([w])[0].astype(float) ** 2) @ model.word) for w in spelt]
        for a, b in runs:
            value[a + 1 : b] = [0.0] * (b - a - 1)
        sentences, start = [], [i for i, x in enumerate(begin) if x] + [len(words)]
        for a, b in zip(start, start[1:], strict=False):
            sentences.append(sum(value[a:b]) / (b - a) ** 0.5 + model.bias)
        top = lambda xs, k: sum(sorted(xs, reverse=True)[:k]) / min(k, len(xs))
        f = [top(sentences, 1), top(sentences, 3), top(value, 1), top(value, 3), top(value, 8), 10 * sum(max(0, v) for v in value) / (len(words) + 20), 1.0]
        want = 1 / (1 + np.exp(-np.dot(f, model.layer)))
        got = tx.score_words(model, 77, _text.split_words(pa.array([text.encode()], pa.binary()), tx._TABLE))[0]
        assert abs(got - want) < 1e-4, text
