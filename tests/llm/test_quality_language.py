import random

import numpy as np
import pyarrow as pa

from kmerweave.llm import _text, language, quality

GOOD = "the people of this town have always been kind and the river is wide".split()
BAD = "BUY!! NOW!! $$$win ###click ###here FREE!!".split()


def made(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(GOOD if i % 3 else BAD) for _ in range(rng.randint(4, 60))), int(i % 3 > 0)) for i in range(n)]


def test_quality_learns_and_bulk_equals_single(spark):
    rows = made(300, 1)
    d = spark.createDataFrame([(i, t, "z") for i, t, _ in rows] + [(900, None, "z"), (901, "", "z"), (5, rows[5][1], "z"), (902, "x " * 200_000, "z")], "doc_id long, text string, score string")
    lab = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(d, lab)
    got = {r.doc_id: r.score for r in quality.score(d.drop("score"), model).collect()}
    out = [i for i, _, _ in rows if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == rows[i][2] for i in out]) > 0.95
    assert got[900] == got[901] == model.prior
    for i in (1, 3, 40):
        doc, ids = quality._features(_text.split_words(pa.array([rows[i][1].encode()]), _text.case_table()))
        assert abs(1 / (1 + np.exp(-(model.weight[ids].mean() + model.bias))) - got[i]) < 1e-5
    kept = quality.keep_good(d, lab)
    assert kept.columns == d.columns
    assert {900, 901} <= {r.doc_id for r in kept.collect()}


def test_quality_without_labels(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(d, quality.fit(d, lab)).collect()} == {0.5}
    assert quality.score(d.limit(0), quality.fit(d, lab)).count() == 0


def test_language(spark):
    rng = random.Random(2)
    words = {"en": "the and with house river people water".split(), "de": "der und mit haus fluss leute wasser nicht".split(), "fr": "le et avec maison rivière gens eau".split()}
    rows = [(i, " ".join(rng.choice(words[v]) for _ in range(rng.randint(3, 40))), v) for i in range(200) for v in [("en", "de", "fr")[i % 3]]]
    extra = [(800, None, "en"), (801, "", None), (802, "123 -- !", "de"), (803, "und " * 100_000, None), (804, "漢字", None)]
    d = spark.createDataFrame([(*r, "q") for r in rows + extra], "doc_id long, text string, lang string, letters string")
    got = {r.doc_id: r for r in language.predict(d, language.fit(d)).collect()}
    held = [i for i, _, _ in rows if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.95
    for i in (800, 801, 802):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[803].lang_pred == "de" and got[804].lang_pred in words
    assert all(0 <= r.score <= 1 for r in got.values())
    none = d.where("lang is null")
    assert {r.lang_pred for r in language.predict(none, language.fit(none)).collect()} == {"und"}


def test_language_of_empty_tables_and_repeated_rows(spark):
    schema = "doc_id long, text string, lang string"
    empty = spark.createDataFrame([], schema)
    model = language.fit(empty)
    assert model.languages == [] and language.predict(empty, model).count() == 0
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("the and river people", "der und fluss leute")[i % 2].split()) for _ in range(12)), ("en", "de")[i % 2]) for i in range(60)]
    once, twice = spark.createDataFrame(rows, schema), spark.createDataFrame(rows + rows, schema)
    model, again = language.fit(once), language.fit(twice)
    assert again.languages == model.languages == ["de", "en"] and np.array_equal(again.weights, model.weights)
    assert language.predict(empty, model).count() == 0
    got = sorted(map(tuple, language.predict(twice, again).collect()))
    assert len(got) == 120 and got[::2] == got[1::2]


def test_presence_kernel_by_hand():
    x = language.presence([b"ab", b"AB", b"a  b", b"", b"b"])
    assert x[0].sum() == 3 and (x[0] == x[1]).all()
    assert x[2].sum() == 6 and x[3].sum() == 0 and (x[0] & x[4]).sum() == 1


def test_training_like_plain_gradient_steps():
    """The same documents in the same order, one feature at a time in plain Python."""
    rows = made(14, 5)
    texts, labels = [t for _, t, _ in rows], [y for *_, y in rows]
    got = quality.train(texts, labels, epochs=2, rate=0.25, seed=11)
    bags = []
    for t in texts:
        _, ids = quality._features(_text.split_words(pa.array([t.encode()]), _text.case_table()))
        bags.append({int(f): float(np.mean(ids == f)) for f in np.unique(ids)})
    rng = np.random.default_rng(11)
    d = quality.DIMENSIONS
    vectors = rng.uniform(-1 / d, 1 / d, (got.weight.size, d)).astype(np.float32).astype(float)
    out, bias = [[0.0, 0.0] for _ in range(d)], [0.0, 0.0]
    steps, step = 2 * len(texts), 0
    for _ in range(2):
        for i in rng.permutation(len(texts)):
            lr = 0.25 * (1 - step / steps)
            step += 1
            hidden = [sum(w * vectors[f][k] for f, w in bags[i].items()) for k in range(d)]
            z = [sum(hidden[k] * out[k][c] for k in range(d)) + bias[c] for c in (0, 1)]
            e = [np.exp(v - max(z)) for v in z]
            wrong = [e[c] / sum(e) - (labels[i] == c) for c in (0, 1)]  # of the loss by z
            back = [sum(out[k][c] * wrong[c] for c in (0, 1)) for k in range(d)]
            for k in range(d):
                for c in (0, 1):
                    out[k][c] -= lr * hidden[k] * wrong[c]
            for c in (0, 1):
                bias[c] -= lr * wrong[c]
            for f, w in bags[i].items():
                for k in range(d):
                    vectors[f][k] -= 20 * lr * w * back[k]
    for f in set().union(*bags):
        assert abs(sum(vectors[f][k] * (out[k][1] - out[k][0]) for k in range(d)) - got.weight[f]) < 1e-4
    assert abs(bias[1] - bias[0] - got.bias) < 1e-5


def test_ridge_regression_like_its_definition():
    """Kernels from sets of n-grams, Nyström features from the landmarks' kernel matrix, weighted least squares with a ridge."""
    rng = random.Random(9)
    words = {"de": "der und mit haus fluss leute".split(), "en": "the and with house river people".split(), "fr": "le et avec maison rivière gens".split()}
    texts, langs = [], []
    for i in range(30):
        v = ("de", "en", "fr", "en")[i % 4]
        texts.append(" ".join(rng.choice(words[v]) for _ in range(rng.randint(2, 12))).encode())
        langs.append(v)
    model = language.train(texts, langs, landmarks=5)
    grams = lambda t: set(np.flatnonzero(language.presence([t])[0]).tolist())
    sets = [grams(t) for t in texts]
    k = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    names = sorted(set(langs))
    marks = [sets[i] for v in names for i in [j for j, x in enumerate(langs) if x == v][:5]]
    zz = np.array([[k(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(zz)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    f = np.array([[k(a, b) for b in marks] for a in sets]) @ root
    # the features' products are the kernel where it is that of landmarks
    assert np.allclose((np.array([[k(a, b) for b in marks] for a in marks]) @ root) @ root.T @ zz, zz, atol=1e-5)
    count = {v: langs.count(v) for v in names}
    for c, v in enumerate(names):
        y = np.array([1.0 if x == v else -1.0 for x in langs])
        w = np.array([len(langs) / len(names) / count[x] for x in langs])
        # least squares of the weighted rows, the ridge as further rows
        ridge = language.RIDGE * len(langs) / f.shape[1]
        a = np.vstack([f * np.sqrt(w)[:, None], np.sqrt(ridge) * np.eye(f.shape[1])])
        b = np.append(y * np.sqrt(w), np.zeros(f.shape[1]))
        solved = np.linalg.lstsq(a, b, rcond=None)[0]
        for t in [*texts[:6], b"people and leute", b"q"]:
            x = language.presence([t])[0]
            mine = np.array([k(grams(t), m) for m in marks]) @ root @ solved
            assert abs(mine - (x.astype(np.float32) @ model.weights)[c] / np.sqrt(max(1, x.sum()))) < 1e-3
