"""Quality classifier: averaged hashed word and character n-gram embeddings, softmax output.

Features are hashed words, hashed byte 3- and 4-grams, and one for a word that
follows itself.

The model is trained here by stochastic gradient descent in numpy on a bounded
sample of labelled documents (``sample`` of each label).  A document is the mean
of the vectors of its word and n-gram features; with the output layer multiplied
in, scoring needs one number per feature, so whole texts are scored by gathers
and sums without a Python object per word.

Defined cases: a null or empty text has no features and gets the share of good
documents in the sample; without labelled rows of both kinds every score is that
share (0.5 if there are none); repeated rows give repeated results; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._labelled import labelled_sample
from ._shared import fold, named, table

#: Labelled documents of each label that are learnt from, at most.
SAMPLE = 1500
DIMENSIONS = 16
BITS = 16
GRAMS = (3, 4)
EPOCHS = 6
RATE = 0.25
THRESHOLD = 0.3
#: Bytes of text whose features a worker holds at once (about 100 bytes each).
HELD_BYTES = 500_000


def _features(words: _text.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word, n-gram and word pair of two equal words of a batch."""
    doc, word_doc, h = words.byte_doc, words.doc.astype(np.int32), words.hashes()
    docs, ids = [word_doc], [(h >> np.uint64(64 - BITS)).astype(np.int64)]
    if h.size:
        again = word_doc[1:][(h[1:] == h[:-1]) & (word_doc[1:] == word_doc[:-1])]
        docs.append(again)
        ids.append(np.full(again.size, (1 + len(GRAMS)) << BITS, np.int64))
    for k, n in enumerate(GRAMS, 1):
        at, gram = _text.byte_grams(words.data, doc, n, BITS)
        docs.append(doc[at])
        ids.append(gram + (k << BITS))
    return np.concatenate(docs), np.concatenate(ids)


class Model(NamedTuple):
    weight: np.ndarray  # of each feature: its vector times (good - bad) of the output layer
    bias: float
    prior: float


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> Model:
    """Vectors of hashed features and a softmax layer, by stochastic gradient descent over documents."""
    prior = float(np.mean(labels)) if labels else 0.5
    size = ((1 + len(GRAMS)) << BITS) + 1
    if len(set(labels)) < 2:
        return Model(np.zeros(size, np.float32), float(np.log((prior + 1e-3) / (1 - prior + 1e-3))), prior)
    bags = []
    tab = _text.case_table()
    for t in texts:
        _, ids = _features(_text.split_words(pa.array([t.encode()], pa.binary()), tab))
        f, n = np.unique(ids, return_counts=True)
        bags.append((f.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (size, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    steps, step = epochs * len(texts), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            f, w = bags[i]
            lr = rate * (1 - step / steps)
            step += 1
            hidden = w @ vectors[f]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= lr * p
            # a mean spreads the gradient over all features; scaled up, rare features learn too
            vectors[f] -= (lr * 20) * np.outer(w, back)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), prior)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, fold_out: int = 0, sample: int = SAMPLE) -> Model:
    """Trained on labelled documents outside the held-out fold; labels are balanced by their weight in the prior."""
    rows = labelled_sample(docs, labels, label, fold(F.col("doc_id"), modulus) != fold_out, sample)
    return train([r.text for r in rows], [int(r.label) for r in rows])


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, the kept columns, and ``score``: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tab = _text.case_table()
    columns = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in _text.chunks(batches, "_text", HELD_BYTES):
            doc, ids = _features(_text.split_words(b.column("_text"), tab))
            n = np.bincount(doc, minlength=b.num_rows)
            z = np.bincount(doc, weights=m.weight[ids], minlength=b.num_rows) / np.maximum(n, 1) + m.bias
            p = np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))), m.prior)
            yield pa.record_batch([*(b.column(c) for c in columns), pa.array(p)], [*columns, "score"])

    chosen = docs.select(*columns, F.col("text").cast("binary").alias("_text"))
    shape = T.StructType([*(docs.schema[c] for c in columns), T.StructField("score", T.DoubleType())])
    return chosen.mapInArrow(run, shape)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    # the text goes through the map as it is, so documents need no join with their scores
    plain = docs.select("doc_id", "text", F.struct(*named(docs)).alias("_row"))
    return score(plain, fit(docs, labels), "_row").where(F.col("score") >= threshold).select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
