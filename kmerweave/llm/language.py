"""Language identification by string kernels.

The kernel of two texts is the number of hashed byte n-grams (n = 1 to 4, lower
case) present in both over the geometric mean of the numbers present in each: the
blended-spectrum presence kernel.  Landmark texts give its Nyström features, and
one-versus-rest kernel ridge regression on a bounded sample (``sample`` texts of
each language, all languages) gives the classifier.  The landmark presence rows times the ridge
weights is one matrix, so blocks of texts are scored by one matrix product each.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as
is any text if no labelled text can be learnt from; ties go to the language first
in order; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _text
from ._shared import fold, table

#: Texts of each language that are learnt from, and landmarks among them, at most.
SAMPLE = 256
LANDMARKS = 48
LENGTHS = (1, 2, 3, 4)
BITS = 14
RIDGE = 1e-2
SHARPNESS = 4.0
BLOCK = 64


def _letters_table() -> np.ndarray:
    """Lower case; all ASCII that is no letter is one separator."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[:65] = t[91:97] = t[123:128] = 0
    return t


_TABLE = _letters_table()


def presence(texts: list[bytes]) -> np.ndarray:
    """Which n-gram buckets each text has: texts x (lengths * 2**BITS)."""
    out = np.zeros((len(texts), len(LENGTHS) << BITS), bool)
    for row, t in zip(out, texts, strict=True):
        data = _TABLE[np.frombuffer(t, np.uint8)].astype(np.uint32)
        data = data[np.append(True, (data[1:] | data[:-1]) != 0)] if data.size else data  # runs of separators are one
        h = np.zeros(data.size, np.uint32)
        for k, n in enumerate(LENGTHS):
            if data.size < n:
                break
            h = h[: data.size - n + 1] * np.uint32(0x01000193) + data[n - 1 :]
            row[((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)) + np.uint32(k << BITS)] = True
    return out


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # features x languages


def train(texts: list[bytes], languages: list[str], landmarks: int = LANDMARKS) -> Model:
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((len(LENGTHS) << BITS, 0), np.float32))
    x = presence(texts)
    norm = np.sqrt(np.maximum(x.sum(1), 1)).astype(np.float32)
    y = np.array([names.index(v) for v in languages])
    picked = np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(names))])
    z = x[picked].astype(np.float32) / norm[picked, None]
    k_zz = z @ z.T
    k_xz = np.concatenate([(x[i : i + BLOCK].astype(np.float32) @ z.T) / norm[i : i + BLOCK, None] for i in range(0, len(texts), BLOCK)])
    values, vectors = np.linalg.eigh(k_zz.astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    f = k_xz @ root
    # each language counts as much as any other
    weight = (1 / np.bincount(y, minlength=len(names)))[y][:, None] * len(y) / len(names)
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    ridge = np.linalg.solve(f.T @ (weight * f) + RIDGE * len(y) * np.eye(f.shape[1]) / f.shape[1], f.T @ (weight * target))
    return Model(names, (z.T @ (root @ ridge)).astype(np.float32))


def fit(docs: DataFrame, modulus: int = 4, fold_out: int = 2, sample: int = SAMPLE) -> Model:
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), modulus) != fold_out))
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = usable.select("doc_id", "lang").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= sample).select("doc_id", F.col("lang").alias("_lang"))
    rows = usable.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id").where("lang = _lang").select("text", "lang", "doc_id").distinct().collect()  # ids: sample rows of each language at most
    rows.sort(key=lambda r: (str(r.doc_id), r.lang, r.text))
    return train([r.text.encode() for r in rows], [r.lang for r in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for chunk in _text.chunks(batches):
            for at in range(0, chunk.num_rows, BLOCK):
                b = chunk.slice(at, BLOCK)
                x = presence([t or b"" for t in b.column("text").to_pylist()])
                some = np.array(b.column("letters").to_pylist(), bool) & bool(m.languages)
                lang, best = ["und"] * b.num_rows, np.zeros(b.num_rows)
                if some.any():
                    f = SHARPNESS * (x.astype(np.float32) @ m.weights) / np.sqrt(np.maximum(x.sum(1), 1))[:, None]
                    p = np.exp(f - f.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    best = np.where(some, p.max(1), 0.0)
                    lang = [m.languages[i] if s else "und" for i, s in zip(p.argmax(1).tolist(), some.tolist(), strict=True)]
                yield pa.record_batch([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.clip(best, 0, 1).astype(np.float64))], ["doc_id", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return docs.select("doc_id", letters, F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, fit(docs)).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
