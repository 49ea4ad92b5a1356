import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerweave.llm import lm_score as lm
from kmerweave.llm._shared import fold


def test_lattice_counts_every_segmentation():
    pieces = [lm._MARK + b"a", lm._MARK, b"a", b"b", b"ab", b"ba", b"aba", lm._MARK + b"ab"]
    logp = np.log(np.array([0.1, 0.2, 0.15, 0.1, 0.1, 0.05, 0.05, 0.15, 0.1]))
    lat, p = lm.lattice(pieces, logp), dict(zip(pieces, np.exp(logp), strict=False))

    def brute(s):
        return 1.0 if not s else sum(p[x] * brute(s[len(x) :]) for x in pieces if s.startswith(x))

    def uses(s):
        """(probability, pieces) of each segmentation."""
        return [(1.0, ())] if not s else [(p[x] * q, (x, *y)) for x in pieces if s.startswith(x) for q, y in uses(s[len(x) :])]

    words = [b"a", b"ab", b"aba", b"abab", b"bbbaab", b"ba", b"a"]
    got = lm.word_logs(lat, words)
    assert np.allclose(np.exp(got), [brute(lm._MARK + w) for w in words])
    counts = np.arange(1, len(words) + 1)
    want = Counter()
    for w, c in zip(words, counts, strict=True):
        for q, y in uses(lm._MARK + w):
            for x in y:
                want[x] += c * q / brute(lm._MARK + w)
    assert np.allclose(lm.expected_pieces(lat, words, counts)[:-1], [want[x] for x in pieces])


def test_any_bytes_have_a_score():
    lat = lm.lattice(*lm.read_vocabulary(lm.vocabulary_path()))
    assert abs(np.logaddexp.reduce(lat.logp)) < 1e-9
    got = lm.word_logs(lat, ["hello".encode(), "漢字ñ🙂".encode(), b"\x00\x01", b"x" * 5000])
    assert np.isfinite(got).all() and (got < 0).all()


@pytest.mark.parametrize("hot", [lm.HOT_WORDS, 5, 0])
def test_scores(spark, hot):
    rng = random.Random(8)
    words = [f"Wörd{i}" for i in range(60)] + ["The", "the", "THE,"]
    rows = [(i, " ".join(rng.choice(words[: rng.randint(3, 63)]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n"), rows[4], (103, "a\x00b unseen " * 2000)]
    d = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n_tokens int").repartition(3)
    got = lm.scores(d, fold(F.col("doc_id"), 5) != 1, hot_words=hot).collect()
    tok = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i, len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok(t)), 6)) for i, t in rows)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    # the lattice from the same counts, word by word
    pieces, logp = lm.read_vocabulary(lm.vocabulary_path())
    p0, own = np.exp(logp), [w for w in c if w]
    for _ in range(lm.ROUNDS):
        uses = lm.expected_pieces(lm.lattice(pieces, logp), own, np.array([c[w] for w in own]))
        uses[-1] = c[b""]
        logp = np.log((uses + lm.PRIOR * p0) / (uses.sum() + lm.PRIOR))
    lat = lm.lattice(pieces, logp)
    for r, t in zip(sorted(got, key=lambda r: (r.doc_id, r.score)), [t for _, t in sorted(rows, key=lambda r: r[0])], strict=True):
        mine = (lm.word_logs(lat, tok(t)[:-1]).sum() + logp[-1]) / math.log(10)
        assert abs(mine - r.score) < 1e-6 * max(1, abs(mine))


def test_empty(spark):
    assert lm.scores(spark.createDataFrame([], "doc_id long, text string"), F.lit(True)).count() == 0


def test_existing_scores_are_used():
    pieces, logp = lm.read_vocabulary(lm.vocabulary_path())
    assert np.isfinite(logp).all()
    by = dict(zip(pieces, logp, strict=False))
    assert by[lm._MARK + b"t"] > by[b"in"] > by[b"er"] > by["梦".encode()]


def test_long_words_in_linear_time():
    lat = lm.lattice(*lm.read_vocabulary(lm.vocabulary_path()))
    rng = random.Random(2)
    long = bytes(rng.choice(b"abcdefgh") for _ in range(200_000))
    began = time.time()
    whole = lm.word_logs(lat, [long, b"short"])
    uses = lm.expected_pieces(lat, [long], np.ones(1))
    assert time.time() - began < 10
    assert np.isfinite(whole).all()
    # every byte of the word and its mark lies in one piece of each segmentation
    pieces, _ = lm.read_vocabulary(lm.vocabulary_path())
    assert abs(sum(u * len(p) for u, p in zip(uses, pieces, strict=False)) - len(long) - len(lm._MARK)) < 1e-3
    # both ways of summing agree on a word of a length that either can take
    for n in (lm.LONG - 3, lm.LONG - 2):
        w = long[:n]
        e = next(lm._blocks(lat, [w]))
        one = lm._sums_of_one(int(e.size[0]), e.start, e.end, lat.logp[e.piece], lat.longest)
        with np.errstate(divide="ignore"):
            all_, _ = lm._sums(e.size, e.word, e.start, e.end, lat.logp[e.piece])
        assert np.allclose(one[np.isfinite(one)], all_[np.isfinite(one)])
