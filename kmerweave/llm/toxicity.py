"""Toxicity by a subsequence string kernel and a support vector machine.

Two strings are compared by their common subsequences of three characters within
five, each weighted by a decay per character spanned and normalised, so an insult
stays close to itself when characters are put in, left out or replaced.  A
sentence's kernel with a landmark string is the sum of the squared kernels of its
words over the root of their number (a run of single letters is one word).
Landmark strings are words of the labelled documents: those that toxic ones hold
most unevenly, and common ones of the others.  They give the Nyström features in
which a linear support vector machine is trained on sentences; labels are per
document, so the sentences that speak for a toxic document are chosen again in
each round.  A logistic layer over a document's strongest sentences and words
gives its score.

The kernel is a sum over words, so every distinct word is compared with the
landmarks once per worker; documents gather and add numbers.

Defined cases: a text without words scores 0, as does every text if there are no
labelled documents of both kinds to learn from; ties need no rule; repeated rows
give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._labelled import labelled_sample
from ._shared import fold, table

#: Labelled documents of each label that are learnt from, at most.
SAMPLE = 1200
#: Sentences of a document that are learnt from, at most.
SENTENCES = 24
LANDMARKS = 144
COMMON = 36
WIDTH = 5
DECAY = 0.7
SENTENCE_WORDS = 32
ROUNDS = 3
THRESHOLD = 0.3
#: Distinct words that a worker keeps.
KEPT_WORDS = 400_000

_TABLE = _text.whitespace_table()
_EDGE = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_INNER = bytes(c for c in _EDGE if chr(c) not in "@$")
_RUN = re.compile(rb"([a-z])\1+")


def _codes() -> np.ndarray:
    """Bytes as 6-bit symbols: letters (and the digits and signs that stand for them), one symbol for other ASCII, hashed others."""
    t = np.full(256, 27, np.uint32)
    for i in range(26):
        t[97 + i] = t[65 + i] = 1 + i
    for sign, letter in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}.items():
        t[ord(sign)] = t[ord(letter)]
    t[128:] = 28 + (np.arange(128) & 31)
    t[1], t[2] = 61, 62
    return t


_CODES = _codes()
_PATTERNS = [(a, b) for b in range(2, WIDTH) for a in range(1, b)]


def _subsequences(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight): distinct ones per word, in order of words."""
    data = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in words), np.uint8)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    c = _CODES[data]
    keys, weights = [], []
    for a, b in _PATTERNS:
        n = max(0, c.size - b)
        ok = np.flatnonzero(owner[:n] == owner[b:])
        keys.append((owner[ok] << 18) | (c[ok] << 12) | (c[ok + a] << 6) | c[ok + b])
        weights.append(np.full(ok.size, DECAY ** (b + 1 - 3)))
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    w = np.bincount(at, np.concatenate(weights), key.size)
    return key >> 18, key & (2**18 - 1), w


class Kernel(NamedTuple):
    """Normalised subsequence kernel with fixed landmarks."""

    row: np.ndarray  # of each subsequence, 0 for those that no landmark has
    table: np.ndarray

    def __call__(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), self.table.shape[1]), np.float32)
        for at in range(0, len(words), 1024):
            n = len(words[at : at + 1024])
            owner, seq, w = _subsequences(words[at : at + 1024])
            norm = np.sqrt(np.maximum(np.bincount(owner, w * w, n), 1e-12))
            row = self.row[seq]
            ok = row > 0
            owner, row, w = owner[ok], row[ok], w[ok].astype(np.float32)
            count = np.bincount(owner, minlength=n)
            place = np.arange(owner.size) - (np.cumsum(count) - count)[owner]
            # words with about as many subsequences are multiplied together, padded with the empty row 0
            low = 0
            for high in (8, 16, 32, 64, 256, max(256, int(count.max(initial=0)))):
                part = np.flatnonzero((count > low) & (count <= high))
                step = max(1, 65_536 // max(1, high))
                for i in range(0, part.size, step):
                    own = part[i : i + step]
                    slot = np.full(n, -1)
                    slot[own] = np.arange(own.size)
                    take = slot[owner] >= 0
                    rows, weights = np.zeros((own.size, high), np.int64), np.zeros((own.size, 1, high), np.float32)
                    rows[slot[owner[take]], place[take]] = row[take]
                    weights[slot[owner[take]], 0, place[take]] = w[take]
                    out[at + own] = np.matmul(weights, self.table[rows])[:, 0] / norm[own, None]
                low = high
        return out


def kernel(landmarks: list[bytes]) -> Kernel:
    owner, seq, w = _subsequences(landmarks)
    norm = np.sqrt(np.bincount(owner, w * w, len(landmarks)))
    used, at = np.unique(seq, return_inverse=True)
    row = np.zeros(1 << 18, np.int32)
    row[used] = 1 + np.arange(used.size)
    tab = np.zeros((used.size + 1, len(landmarks)), np.float32)
    tab[at + 1, owner] = w / norm[owner]
    return Kernel(row, tab)


class Model(NamedTuple):
    kernel: Kernel
    word: np.ndarray  # weight of each landmark's squared kernel
    bias: float
    layer: np.ndarray  # over document features, the last for the constant


def bare(word: bytes) -> bytes:
    """A word without signs around or between its letters, runs of one letter shortened to one."""
    word = word.strip(_EDGE) or word
    if not word.isalnum():
        word = word.translate(None, _INNER) or word
    return _RUN.sub(rb"\1", word)


def _layout(words: _text.Words) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Whether a sentence starts at each word, and runs (first, behind last) of three or more single letters."""
    n = words.starts.size
    stop = np.isin(words.data[words.ends - 1], np.frombuffer(b".!?", np.uint8)) if n else np.zeros(0, bool)
    begin = np.zeros(n, bool)
    begin[words.first[words.count > 0]] = True
    begin[1:] |= stop[:-1]
    at = np.flatnonzero(begin)
    place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    begin |= place % SENTENCE_WORDS == 0
    one = np.concatenate([[0], (words.ends - words.starts == 1) & (words.data[words.starts] >= 97) & (words.data[words.starts] < 123), [0]]).astype(np.int8)
    up, down = np.flatnonzero(np.diff(one) == 1), np.flatnonzero(np.diff(one) == -1)
    doc = words.doc
    return begin, [(a, b) for a, b in zip(up.tolist(), down.tolist(), strict=True) if b - a >= 3 and doc[a] == doc[b - 1]]


def _features(words: _text.Words, value: np.ndarray, begin: np.ndarray, bias: float) -> np.ndarray:
    """Per document: the strongest sentence, the mean of the strongest three, means of the strongest words, and their density."""
    docs, doc = words.count.size, words.doc
    out = np.zeros((docs, 6))
    if not doc.size:
        return out
    at = np.flatnonzero(begin)
    length = np.diff(np.append(at, doc.size))
    sentence = np.add.reduceat(value, at) / np.sqrt(length) + bias

    def strongest(x: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
        order = np.lexsort((-x, of))
        of, x = of[order], x[order]
        first = np.searchsorted(of, np.arange(docs))
        place = np.arange(of.size) - first[of]
        keep = place < k
        n = np.minimum(k, np.bincount(of, minlength=docs))
        return np.bincount(of[keep], x[keep], docs) / np.maximum(1, n)

    sentence_doc = doc[at]
    for j, (x, of, k) in enumerate(((sentence, sentence_doc, 1), (sentence, sentence_doc, 3), (value, doc, 1), (value, doc, 3), (value, doc, 8))):
        out[:, j] = strongest(x, of, k)
    strong = np.maximum(value, 0)
    out[:, 5] = 10 * np.bincount(doc, strong, docs) / (words.count + 20)
    return out


def _squared_hinge(x: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 30) -> np.ndarray:
    """Linear support vector machine with squared hinge loss on some rows of x, by Newton steps on those within the margin; summed in blocks, so x isn't copied."""
    w = np.zeros(x.shape[1])
    reg = ridge * np.eye(x.shape[1])
    reg[-1, -1] = 1e-8
    for _ in range(steps):
        h, g = reg.copy(), np.zeros(x.shape[1])
        for i in range(0, rows.size, 4096):
            b, s = x[rows[i : i + 4096]], y[i : i + 4096]
            on = s * (b @ w) < 1
            b, a = b[on], b[on] * weight[i : i + 4096][on, None]
            h += a.T @ b
            g += a.T @ s[on]
        new = np.linalg.solve(h, g)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _altered(words: list[bytes], telling: set[bytes], rng: np.random.Generator) -> bytes | None:
    """A document with a letter put into each of its telling words."""
    out, some = [], False
    for w in words:
        x = bare(w)
        if len(x) >= 4 and x in telling:
            some = True
            i = int(rng.integers(1, len(x)))
            w = x[:i] + bytes([97 + int(rng.integers(26))]) + x[i:]
        out.append(w)
    return b" ".join(out) if some else None


class _Bags(NamedTuple):
    words: _text.Words
    names: np.ndarray  # distinct words
    ids: np.ndarray
    begin: np.ndarray
    runs: list[tuple[int, int]]


def _bags(texts: list[bytes]) -> _Bags:
    words = _text.split_words(pa.array(texts, pa.binary()), _TABLE)
    begin, runs = _layout(words)
    # one string per distinct word, not per word
    raw, seen = words.data.tobytes(), {}
    at = np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in zip(words.starts, words.ends, strict=True)), np.int64, words.starts.size)
    spelt = [bare(w) for w in seen]
    joined = [b"".join(spelt[i] for i in at[a:b]) for a, b in runs]
    names, ids = np.unique(np.array(spelt + joined, object), return_inverse=True)
    own = ids[: len(spelt)][at]
    own[[a for a, _ in runs]] = ids[len(spelt) :]
    used, own = np.unique(own, return_inverse=True)
    return _Bags(words, names[used], own, begin, runs)


def _landmarks(plain: list[bytes], y: np.ndarray, rng: np.random.Generator) -> tuple[list[bytes], list[float], list[bytes]]:
    """Landmark words, the telling ones first; the unevenness of these; altered toxic documents. The sample's bags are released on return."""
    words, names, ids, _, _ = _bags(plain)
    # how many documents of each kind hold a word
    pair = np.unique(words.doc.astype(np.int64) * names.size + ids)
    held, of = pair % names.size, y[pair // names.size]
    toxic, clean = np.bincount(held[of == 1], minlength=names.size), np.bincount(held[of == 0], minlength=names.size)
    rate, other = toxic / (y == 1).sum(), clean / (y == 0).sum()
    uneven = (rate - other) / np.sqrt(other + 2 / (y == 0).sum())
    telling = [i for i in np.argsort(-uneven, kind="stable") if toxic[i] >= 3 and uneven[i] > 0][: LANDMARKS - COMMON]
    common = [i for i in np.argsort(-other, kind="stable") if i not in set(telling)][:COMMON]
    marks = [names[i] for i in telling + common]
    # toxic documents once more, with the words misspelt that many of them and hardly any clean one hold
    set_, first = {names[i] for i in telling if rate[i] >= 0.1 and other[i] <= 0.001}, words.first.tolist()
    raw = words.data.tobytes()
    own = lambda d, n: [raw[a:b] for a, b in zip(words.starts[first[d] : first[d] + n], words.ends[first[d] : first[d] + n], strict=True)]
    more = [_altered(own(d, n), set_, rng) for d, n in enumerate(words.count.tolist()) if y[d] == 1]
    return marks, [float(uneven[i]) for i in telling], [t for t in more if t is not None]


def train(texts: list[str], labels: list[int], seed: int = 5) -> Model | None:
    if len(set(labels)) < 2:
        return None
    rng, y = np.random.default_rng(seed), np.array(labels)
    plain = [t.encode() for t in texts]
    marks, hints, more = _landmarks(plain, y, rng)
    words, names, ids, begin, runs = _bags(plain + more)
    y = np.append(y, np.ones(len(more), int))
    doc = words.doc
    k = kernel(marks)
    squared = np.zeros((names.size, len(marks)), np.float32)
    for at in range(0, names.size, 20_000):
        squared[at : at + 20_000] = k(list(names[at : at + 20_000])) ** 2
    zz = k(marks).astype(np.float64) ** 2
    values, vectors = np.linalg.eigh((zz + zz.T) / 2)
    keep = values > 1e-4 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    # sentences: an even choice of each document's, and their Nyström features
    at = np.flatnonzero(begin)
    length = np.diff(np.append(at, doc.size))
    s_doc = doc[at]
    # the first choice of sentences: by the unevenness of the nearest of the telling words
    near = squared[:, : len(hints)] @ np.clip(hints, 0, 5)
    hint = np.add.reduceat(near[ids], at) / np.sqrt(length)
    order = np.lexsort((np.where(y[s_doc] == 1, -hint, rng.random(at.size)), s_doc))
    place = np.arange(at.size) - np.searchsorted(s_doc[order], np.arange(y.size))[s_doc[order]]
    chosen = np.sort(order[place < SENTENCES])
    x = np.empty((chosen.size, root.shape[1] + 1))
    x[:, -1] = 1
    for i in range(0, chosen.size, 2000):
        part = chosen[i : i + 2000]
        rows = np.concatenate([np.arange(at[s], at[s] + length[s]) for s in part])
        sums = np.add.reduceat(squared[ids[rows]], np.append(0, np.cumsum(length[part])[:-1])) / np.sqrt(length[part])[:, None]
        x[i : i + 2000, :-1] = sums @ root
    of, score = s_doc[chosen], hint[chosen]
    w = np.zeros(x.shape[1])
    for _ in range(ROUNDS):
        # the strongest sentence speaks for a toxic document, all of a clean one speak for it
        best = np.lexsort((-score, of))
        best = best[np.r_[True, of[best][1:] != of[best][:-1]]]
        use = y[of] == 0
        use[best[y[of[best]] == 1]] = True
        sign = np.where(y[of[use]] == 1, 1.0, -1.0)
        weight = np.where(sign > 0, 1.0 / max(1, (sign > 0).sum()), 1.0 / max(1, (sign < 0).sum()))
        w = _squared_hinge(x, np.flatnonzero(use), sign, weight, 1e-3)
        score = x @ w
    per_word, bias = root @ w[:-1], float(w[-1])
    value = (squared @ per_word)[ids]
    for a, b in runs:
        value[a + 1 : b] = 0
    f = _features(words, value, begin, bias)
    f = np.column_stack([f, np.ones(len(f))])
    some = words.count > 0
    return Model(k, per_word, bias, _logistic(f[some], y[some]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, fold_out: int = 2, sample: int = SAMPLE) -> Model | None:
    rows = labelled_sample(docs, labels, label, fold(F.col("doc_id"), modulus) != fold_out, sample)
    return train([r.text for r in rows], [int(r.label) for r in rows])


_kept: dict[int, dict[int, float]] = {}


def _word_values(m: Model, token: int, words: _text.Words) -> np.ndarray:
    """The machine's value of every word; those of distinct words are kept between batches."""
    known = _kept.setdefault(token, {})
    if len(known) > KEPT_WORDS:
        known.clear()
    u, first, at = np.unique(words.hashes(), return_index=True, return_inverse=True)
    keys = u.tolist()
    new = [i for i, x in enumerate(keys) if x not in known]
    if new:
        raw = words.data.tobytes()
        strings = [bare(raw[words.starts[i] : words.ends[i]]) for i in first[new].tolist()]
        value = np.concatenate([(m.kernel(strings[i : i + 20_000]) ** 2) @ m.word for i in range(0, len(strings), 20_000)])
        known.update(zip([keys[i] for i in new], value.tolist(), strict=True))
    return np.array([known[x] for x in keys])[at]


def score_words(m: Model, token: int, words: _text.Words) -> np.ndarray:
    begin, runs = _layout(words)
    value = _word_values(m, token, words) if words.starts.size else np.zeros(0)
    if runs:
        raw = words.data.tobytes()
        joined = [b"".join(raw[words.starts[i] : words.ends[i]] for i in range(a, b)) for a, b in runs]
        for (a, b), v in zip(runs, (m.kernel(joined) ** 2) @ m.word, strict=True):
            value[a:b] = 0
            value[a] = v
    z = _features(words, value, begin, m.bias) @ m.layer[:-1] + m.layer[-1]
    return np.where(words.count > 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and ``score``, the probability of label 1."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    token = hash((model.bias, model.word.tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for old in [t for t in _kept if t != token]:
            del _kept[old]
        for b in _text.chunks(batches):
            yield pa.record_batch([b.column("doc_id"), pa.array(score_words(m, token, _text.split_words(b.column("text"), _TABLE)))], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
