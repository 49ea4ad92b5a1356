"""Benchmark decontamination by winnowing.

Every sequence of ``window`` words holds ``window - gram + 1`` word grams; the
smallest gram hash of each such window is a fingerprint.  Two texts that share
``window`` words share that fingerprint, so joining fingerprints of documents and
benchmark items misses no shared window.  Hits are extended: every window around
a hit fingerprint is looked up among the items' windows.  Items of fewer words
than a window are one window of their own length and are looked up directly.

The item side is broadcast only after its size has been checked
(``max_broadcast`` windows); a larger benchmark is joined by shuffles instead,
with the same result.

Defined cases: null or word-free texts have no words and no hits; null or
word-free items have no windows; repeated rows give repeated results; extra
columns are ignored; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _text
from ._shared import named, staged, table

WINDOW = 10
GRAM = 5
#: Item windows that are broadcast at most (8 bytes each, and 8 for the item).
MAX_BROADCAST = 2_000_000

_U = np.uint64


def _fingerprints(grams: np.ndarray, valid: np.ndarray, per: int) -> np.ndarray:
    """Positions of grams that are the smallest of a valid window of ``per`` grams."""
    n = valid.size
    low = grams[:n].copy()
    for j in range(1, per):
        np.minimum(low, grams[j : j + n], out=low)
    chosen = np.zeros(grams.size, bool)
    for j in range(per):
        chosen[j : j + n] |= valid & (grams[j : j + n] == low)
    return np.flatnonzero(chosen)


def _starts_of_windows(words: _text.Words, k: int) -> np.ndarray:
    """Whether k words from each word on lie in one text; for every start of k words in the batch."""
    total = words.starts.size
    left = np.repeat(words.first + words.count, words.count) - np.arange(total)
    return left[: max(0, total - k + 1)] >= k


@dataclass
class _Items:
    """Broadcast form of the benchmark."""

    prints: np.ndarray  # sorted fingerprints
    windows: np.ndarray  # sorted distinct window hashes
    begin: np.ndarray  # of each window's items
    items: np.ndarray  # row of names
    names: list[str]
    short: list[int]  # lengths of items under a window


def _item_windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """kind 0: fingerprint; kind n: hash of a window of n words."""
    tab = _text.alphanumeric_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.chunks(batches):
            w = _text.split_words(b.column("text"), tab)
            h = w.hashes()
            out: list[tuple[int, int, str]] = []
            for name, at, n in zip(b.column("item_id").to_pylist(), w.first.tolist(), w.count.tolist(), strict=True):
                own = h[at : at + n]
                if n >= window:
                    grams = _text.window_hashes(own, gram)
                    at_ = _fingerprints(grams, np.ones(n - window + 1, bool), window - gram + 1)
                    out += [(0, int(x), name) for x in np.unique(grams[at_])]
                    out += [(window, int(x), name) for x in np.unique(_text.window_hashes(own, window))]
                elif n:
                    out.append((n, _text.sequence_hash(own), name))
            kind, value, name_ = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch([pa.array(kind, pa.int32()), pa.array(np.array(value, _U).view(np.int64)), pa.array(name_, pa.string())], ["kind", "h", "item"])

    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return bench.where("item_id is not null").mapInArrow(run, "kind int, h long, item string")


def _broadcast_form(rows: pa.Table) -> _Items:
    kind, all_h = rows.column("kind").to_numpy(), rows.column("h").to_numpy().astype(np.int64).view(_U)
    coded = rows.column("item").combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    plain = coded.dictionary.to_pylist()
    names = sorted(plain)
    place = {x: i for i, x in enumerate(names)}
    item = np.array([place[x] for x in plain], np.int64)[coded.indices.to_numpy()] if plain else np.zeros(0, np.int64)
    h, item = all_h[kind > 0], item[kind > 0]
    order = np.lexsort((item, h))
    windows, begin = np.unique(h[order], return_index=True)
    return _Items(np.unique(all_h[kind == 0]), windows, np.append(begin, h.size), item[order], names, sorted(set(kind[kind > 0].tolist())))


def _member(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_, x)
    at[at == sorted_.size] = 0
    return sorted_[at] == x if sorted_.size else np.zeros(x.size, bool)


def _hits(words: _text.Words, h: np.ndarray, items: _Items, window: int, gram: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, starts, window hashes) of the windows that occur in items."""
    out = []
    if h.size >= window and window in items.short:
        valid = _starts_of_windows(words, window)
        grams = _text.window_hashes(h, gram)
        at = _fingerprints(grams, valid, window - gram + 1)
        at = at[_member(grams[at], items.prints)]
        near = np.unique((at[:, None] - np.arange(window - gram + 1)[None, :]).ravel())
        near = near[(near >= 0) & (near < valid.size)]
        near = near[valid[near]]
        if near.size:
            around = h[near[:, None] + np.arange(window)[None, :]].ravel()
            found = np.zeros(near.size, _U)
            for j in range(window):
                found += around[j::window] * _text._POS_KEYS[j]
            found = _text.mix(found ^ _U(window))
            ok = _member(found, items.windows)
            out.append((window, near[ok], found[ok]))
    for n in items.short:
        if n < window and h.size >= n:
            found = _text.window_hashes(h, n)
            ok = np.flatnonzero(_member(found, items.windows) & _starts_of_windows(words, n))
            out.append((n, ok, found[ok]))
    return [x for x in out if x[1].size]


def _by_broadcast(docs: DataFrame, rows: pa.Table, window: int, gram: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_broadcast_form(rows))
    tab = _text.alphanumeric_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for b in _text.chunks(batches):
            w = _text.split_words(b.column("text"), tab)
            h = w.hashes()
            hit = np.zeros(h.size + 1, np.int64)  # +1 where a window starts, -1 behind its end
            of: dict[int, set[int]] = {}
            for n, starts, found in _hits(w, h, items, window, gram):
                np.add.at(hit, starts, 1)
                np.add.at(hit, starts + n, -1)
                doc = np.searchsorted(w.first + w.count, starts, side="right")
                for d, x in zip(doc.tolist(), np.searchsorted(items.windows, found).tolist(), strict=True):
                    of.setdefault(d, set()).update(items.items[items.begin[x] : items.begin[x + 1]].tolist())
            covered = np.append(0, np.cumsum(np.cumsum(hit[:-1]) > 0))
            n_hit = covered[w.first + w.count] - covered[w.first]
            names = [sorted(items.names[i] for i in of.get(d, ())) for d in range(b.num_rows)]
            yield pa.record_batch([b.column("doc_id"), pa.array(w.count, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "items"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, items array<string>")


def _by_shuffle(docs: DataFrame, item_rows: DataFrame, window: int, gram: int) -> DataFrame:
    """The same for a benchmark of any size: joins of fingerprints, then of windows."""
    tab = _text.alphanumeric_table()
    lengths = sorted(r.kind for r in item_rows.select("kind").distinct().collect() if 0 < r.kind < window)  # under ``window`` rows
    # a row's key holds its id and text, so that repeated ids stay apart and repeated rows agree
    keyed = docs.select("doc_id", F.col("text").cast("binary").alias("text")).withColumn("key", F.concat(F.xxhash64("doc_id", "text").cast("string"), F.lit("-"), F.crc32(F.coalesce("text", F.lit(b""))).cast("string")))

    def emit(of: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _text.chunks(batches):
                w = _text.split_words(b.column("text"), tab)
                h, keys = w.hashes(), np.array(b.column("key").to_pylist(), object)
                doc = w.doc
                if of == "counts":
                    yield pa.record_batch([b.column("key"), pa.array(w.count, pa.int64())], ["key", "n_words"])
                    continue
                parts = []
                if h.size >= window:
                    valid = _starts_of_windows(w, window)
                    if of == "prints":
                        grams = _text.window_hashes(h, gram)
                        at = _fingerprints(grams, valid, window - gram + 1)
                        parts.append((0, at, grams[at]))
                    else:
                        at = np.flatnonzero(valid)
                        parts.append((window, at, _text.window_hashes(h, window)[at]))
                for n in lengths:
                    if h.size >= n and of == "prints":
                        at = np.flatnonzero(_starts_of_windows(w, n))
                        parts.append((n, at, _text.window_hashes(h, n)[at]))
                for n, at, x in parts:
                    yield pa.record_batch([pa.array(keys[doc[at]], pa.string()), pa.array(np.full(at.size, n, np.int32)), pa.array(at - w.first[doc[at]]), pa.array(x.view(np.int64))], ["key", "kind", "at", "h"])

        return run

    shape = "key string, kind int, at long, h long"
    # fingerprints and short windows; only those of items pass
    first = staged(keyed.mapInArrow(emit("prints"), shape).join(item_rows.select("kind", "h").distinct(), ["kind", "h"], "left_semi"), "prints")
    near = keyed.join(first.where("kind = 0").select("key").distinct(), "key", "left_semi")
    long_ = near.mapInArrow(emit("windows"), shape)
    found = staged(first.where("kind > 0").select("key", "kind", "at", "h").union(long_.select("key", "kind", "at", "h")).distinct().join(item_rows.where("kind > 0"), ["kind", "h"]), "windows")
    # covered words: each start adds what reaches past the farthest end before it
    spans = found.groupBy("key", "at").agg(F.max("kind").alias("n"))
    before = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    gain = F.greatest(F.lit(0), F.col("at") + F.col("n") - F.greatest("at", F.coalesce(F.max(F.col("at") + F.col("n")).over(before), F.col("at"))))
    n_hit = spans.withColumn("gain", gain).groupBy("key").agg(F.sum("gain").alias("n_hit"))
    names = found.select("key", "item").distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    counts = keyed.mapInArrow(emit("counts"), "key string, n_words long").distinct()
    return keyed.select("key", "doc_id").join(counts, "key").join(n_hit.join(names, "key"), "key", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit and the ids of occurring items, sorted as strings."""
    item_rows = staged(_item_windows(benchmark, window, gram), "items")
    # counted before any row comes to the driver
    if item_rows.count() <= max_broadcast:
        return _by_broadcast(docs, item_rows.toArrow(), window, gram)
    return _by_shuffle(docs, item_rows, window, gram)


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents without any benchmark window, with all their columns.

    Rows go by doc_id: rows that share one go together.  A null doc_id stays.
    """
    bad = contamination(docs, benchmark, **how).where("n_hit > 0").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti").select(*named(docs))


def query(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT item_id, len(w) AS n, i, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hits AS (SELECT DISTINCT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
