"""Corpus language-model scores: a word unigram base and a subword lattice.

The lattice model takes the pieces of an existing vocabulary and its scores: a
unigram vocabulary's log probabilities as they are, a merge-ranked one's ranks as
a Zipf law.  Every segmentation of a text into pieces counts, weighted by its
pieces; the log-space forward recursion over piece ends gives the marginal
probability of the text.  Pieces never cross a word start, so the recursion runs
once per distinct word and a document is the sum over its words and one end.
Expectation-maximisation over all training words (forward-backward, counts of the
whole corpus) re-estimates the piece scores, the existing ones staying as prior.

Work per distinct word, not per token: words are counted over all documents, each
distinct word is scored once, and documents look their words up.  Frequent words
(``hot`` of them at most) are broadcast as sorted hashes, all others are joined.

Defined cases: a null text is an empty one, which is its end token alone; without
training documents counts are 0 and the lattice keeps the existing scores;
repeated rows are scored each; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._shared import fold, staged, table

VOCABULARY = "piece_bpe_32k.model"
#: Words whose scores are broadcast, at most (24 bytes each).
HOT_WORDS = 400_000
#: Distinct words that a counting task holds before it passes them on.
HELD_WORDS = 300_000
#: Bytes of words whose lattices are built at once; longer words than LONG are gone through one by one.
BLOCK_BYTES = 400_000
LONG = 256
ROUNDS = 2
PRIOR = 1000.0
_U = np.uint64
_MARK = "▁".encode()


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


# ---------------------------------------------------------------- the lattice


class Lattice(NamedTuple):
    """Pieces as a trie: state 0 is the root, a step is found by (state, byte) in an open-addressed table."""

    logp: np.ndarray  # natural logarithm of each piece; the last one is the end
    keys: np.ndarray  # state * 256 + byte of each slot, or -1
    to: np.ndarray  # the state that the slot leads to
    piece: np.ndarray  # the piece that ends in each state, or -1
    longest: int

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next states, -1 where no piece goes on like this."""
        key = (state << 8) | byte
        size = self.keys.size
        slot = ((key.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(33 - size.bit_length())).astype(np.int64)
        seen = self.keys[slot]
        out = np.where(seen == key, self.to[slot], -1)
        again = np.flatnonzero((seen != key) & (seen >= 0))
        while again.size:
            slot[again] = (slot[again] + 1) & (size - 1)
            seen = self.keys[slot[again]]
            hit = seen == key[again]
            out[again[hit]] = self.to[slot[again[hit]]]
            again = again[~hit & (seen >= 0)]
        return out


def read_vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes and the log probabilities that their existing scores stand for."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[bytes, float] = {}
    spare: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            continue
        text = sp.id_to_piece(i)
        if sp.is_byte(i):
            spare[bytes([int(text[3:5], 16)])] = 0.0
        else:
            pieces[text.encode()] = sp.get_score(i)
    scores = np.array(list(pieces.values()))
    # merge ranks are whole numbers far below any log probability: the r-th best piece weighs 1 / (r + 2)
    ranked = scores.size and scores.min() < -1000 and np.array_equal(scores, np.round(scores))
    logp = -np.log(2.0 + np.argsort(np.argsort(-scores, kind="stable"), kind="stable")) if ranked else scores
    # byte pieces stand in for bytes that no piece covers
    low = (logp.min() if logp.size else 0.0) - 1.0
    spare = {b: low for b in spare if b not in pieces}
    logp = np.concatenate([logp, np.full(len(spare), low), [math.log(0.05)]])
    return [*pieces, *spare], logp - np.logaddexp.reduce(logp)


def lattice(pieces: list[bytes], logp: np.ndarray) -> Lattice:
    steps: dict[int, int] = {}
    ends: dict[int, int] = {}
    for i, p in enumerate(pieces):
        state = 0
        for c in p:
            state = steps.setdefault((state << 8) | c, len(steps) + 1)
        ends[state] = i
    size = 1 << max(4, (5 * len(steps) // 2).bit_length())
    keys, to = np.full((2, size), -1, np.int32)
    shift = 33 - size.bit_length()
    for key, state in steps.items():
        slot = (key * 2654435761 & 0xFFFFFFFF) >> shift
        while keys[slot] >= 0:
            slot = (slot + 1) & (size - 1)
        keys[slot], to[slot] = key, state
    piece = np.full(len(steps) + 1, -1, np.int32)
    piece[list(ends)] = list(ends.values())
    return Lattice(logp, keys, to, piece, max(map(len, pieces), default=0))


class _Edges(NamedTuple):
    """Spans of some words, each with its start mark, that are pieces."""

    rows: np.ndarray  # the words, longest first
    size: np.ndarray  # bytes of each
    word: np.ndarray  # of each edge: place of its word, first and last boundary, piece
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray


def _blocks(lat: Lattice, words: list[bytes]) -> Iterator[_Edges]:
    """The lattices of the words, block by block."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + len(_MARK)
    order = np.argsort(-sizes, kind="stable")
    at = 0
    while at < order.size:
        longest = int(sizes[order[at]])
        rows = order[at : at + (1 if longest > LONG else min(60_000, max(1, BLOCK_BYTES // longest)))]
        at += rows.size
        size = sizes[rows]
        data = np.frombuffer(b"".join([_MARK + words[i] for i in rows.tolist()]), np.uint8).astype(np.int32)
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(rows.size, dtype=np.int32), size)
        left = np.repeat(first + size, size) - np.arange(data.size)
        # all starts go one byte further at once; those that no piece goes on from are done
        pos, state, found = np.arange(data.size), np.zeros(data.size, np.int32), []
        for n in range(1, lat.longest + 1):
            state = lat.step(state, data[pos + n - 1])
            live = state >= 0
            pos, state = pos[live], state[live]
            piece = lat.piece[state]
            hit = piece >= 0
            found.append((pos[hit], n, piece[hit]))
            more = left[pos] > n
            pos, state = pos[more], state[more]
            if not pos.size:
                break
        begin = np.concatenate([f[0] for f in found])
        w = word[begin]
        start = (begin - first[w]).astype(np.int32)
        yield _Edges(rows, size, w, start, start + np.repeat(np.array([f[1] for f in found], np.int32), [f[0].size for f in found]), np.concatenate([f[2] for f in found]))


def _sums(size: np.ndarray, word: np.ndarray, start: np.ndarray, end: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the summed weight of all paths from boundary 0 to every boundary of each word, and the place of each word's boundary 0."""
    top = int(size[0])
    first = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), -np.inf)
    out[first] = 0
    order = np.argsort(end.astype(np.uint16) if top < 65536 else end, kind="stable")
    word, logp = word[order], logp[order]
    source = first[word] + start[order]
    cut = np.append(0, np.cumsum(np.bincount(end, minlength=top + 1)))
    alive = np.searchsorted(-size, -np.arange(top + 1), side="right")  # words that reach each boundary
    for j in range(1, top + 1):
        edges = slice(cut[j], cut[j + 1])
        w = word[edges]
        v = out[source[edges]] + logp[edges]
        m = np.full(alive[j], -np.inf)
        np.maximum.at(m, w, v)
        m[np.isneginf(m)] = 0
        out[first[: alive[j]] + j] = m + np.log(np.bincount(w, np.exp(v - m[w]), alive[j]))
    return out, first


def _sums_of_one(size: int, start: np.ndarray, end: np.ndarray, logp: np.ndarray, back: int) -> np.ndarray:
    """The same for one long word: plain products, rescaled in the ``back`` places that an edge can reach back to."""
    order = np.argsort(end, kind="stable")
    starts, weights = start[order].tolist(), np.exp(logp[order]).tolist()
    cut = np.append(0, np.cumsum(np.bincount(end, minlength=size + 1))).tolist()
    value, out, scale = [0.0] * (size + 1), [-math.inf] * (size + 1), 0.0
    value[0], out[0] = 1.0, 0.0
    for j in range(1, size + 1):
        total = 0.0
        for e in range(cut[j], cut[j + 1]):
            total += value[starts[e]] * weights[e]
        value[j] = total
        if total:
            out[j] = math.log(total) + scale
            if total < 1e-100:
                for i in range(max(0, j - back), j + 1):
                    value[i] /= total
                scale = out[j]
    return np.array(out)


def _paths(lat: Lattice, e: _Edges, logp: np.ndarray, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Summed log weights up to every boundary, or with ``backward`` from it to the word's end (by boundary from the end)."""
    n = e.size[e.word].astype(np.int32)
    start, end = (n - e.end, n - e.start) if backward else (e.start, e.end)
    if e.size[0] > LONG:
        return _sums_of_one(int(e.size[0]), start, end, logp, lat.longest), np.zeros(1, np.int64)
    return _sums(e.size, e.word, start, end, logp)


def word_logs(lat: Lattice, words: list[bytes]) -> np.ndarray:
    """Natural log of each word's marginal probability over all segmentations."""
    out = np.zeros(len(words))
    with np.errstate(divide="ignore"):
        for e in _blocks(lat, words):
            alpha, first = _paths(lat, e, lat.logp[e.piece])
            out[e.rows] = alpha[first + e.size]
    return out


def expected_pieces(lat: Lattice, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece over the words, each as often as counted."""
    out = np.zeros(lat.logp.size)
    with np.errstate(divide="ignore", invalid="ignore"):
        for e in _blocks(lat, words):
            logp = lat.logp[e.piece]
            alpha, first = _paths(lat, e, logp)
            beta, _ = _paths(lat, e, logp, backward=True)
            at, n = first[e.word], e.size[e.word]
            share = np.exp(alpha[at + e.start] + logp + beta[at + n - e.end] - alpha[at + n]) * counts[e.rows][e.word]
            ok = np.isfinite(share)
            out += np.bincount(e.piece[ok], share[ok], out.size)
    return out


# ---------------------------------------------------------------- the corpus


_TABLE = _text.whitespace_table()


def _plain(word: bytes) -> bytes:
    return word.replace(b"\xff", b"\0")


def word_counts(docs: DataFrame, training) -> DataFrame:
    """h (hash), word, n (all documents) and c (training documents) of every word; the end token is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[int, bytes] = {}
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def passed_on() -> pa.RecordBatch:
            h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n, c = (np.bincount(at, np.concatenate([p[k] for p in parts]), h.size).astype(np.int64) for k in (1, 2))
            out = pa.record_batch([pa.array(h.view(np.int64)), pa.array([words[x] for x in h.tolist()], pa.binary()), pa.array(n), pa.array(c)], ["h", "word", "n", "c"])
            words.clear()
            parts.clear()
            return out

        ends = [0, 0]
        for b in _text.chunks(batches):
            w = _text.split_words(b.column("text"), _TABLE)
            train = b.column("training").to_numpy(zero_copy_only=False).astype(bool)
            ends[0] += b.num_rows
            ends[1] += int(train.sum())
            h, first, at = np.unique(w.hashes(), return_index=True, return_inverse=True)
            raw = w.data
            for x, i in zip(h.tolist(), first.tolist(), strict=True):
                if x not in words:
                    words[x] = _plain(raw[w.starts[i] : w.ends[i]].tobytes())
            parts.append((h, np.bincount(at, minlength=h.size), np.bincount(at, train[w.doc], h.size)))
            if len(words) > HELD_WORDS:
                yield passed_on()
        if parts:
            yield passed_on()
        if ends[0]:
            yield pa.record_batch([pa.array([0], pa.int64()), pa.array([b""], pa.binary()), pa.array([ends[0]]), pa.array([ends[1]])], ["h", "word", "n", "c"])

    seen = docs.select(F.col("text").cast("binary").alias("text"), training.alias("training"))
    return seen.mapInArrow(run, "h long, word binary, n long, c long").groupBy("h", "word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def fit_lattice(counts: DataFrame, path: str, rounds: int = ROUNDS, prior: float = PRIOR) -> Lattice:
    """Piece scores re-estimated on all training words; what comes to the driver is one number per piece."""
    pieces, logp = read_vocabulary(path)
    p0, sc = np.exp(logp), counts.sparkSession.sparkContext
    ends = counts.where("h = 0").agg(F.sum("c")).first()[0] or 0
    for _ in range(rounds):
        shared = sc.broadcast(lattice(pieces, logp))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lat = shared.value
            total = np.zeros(lat.logp.size)
            for b in batches:
                total += expected_pieces(lat, b.column("word").to_pylist(), b.column("c").to_numpy())
            used = np.flatnonzero(total)
            yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], ["piece", "uses"])

        uses = counts.where("c > 0 and h <> 0").select("word", "c").mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        total = np.zeros(logp.size)
        for r in uses.collect():
            total[r.piece] = r.uses
        total[-1] = ends
        logp = np.log((total + prior * p0) / (total.sum() + prior))
        shared.unpersist()
    return lattice(pieces, logp)


class _Hot(NamedTuple):
    h: np.ndarray
    base: np.ndarray
    lat: np.ndarray
    known: np.ndarray


def scores(docs: DataFrame, training, path: str | None = None, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    spark = docs.sparkSession
    counts = staged(word_counts(docs, training), "words")
    lat = fit_lattice(counts, path or vocabulary_path())
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    floor = total + 0.5 * (distinct + 1)
    shared_lat = spark.sparkContext.broadcast(lat)

    def log_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared_lat.value
        for b in batches:
            words = b.column("word").to_pylist()
            own = word_logs(m, words)
            own[[i for i, w in enumerate(words) if not w]] = m.logp[-1]
            yield pa.record_batch([b.column("h"), b.column("n"), b.column("c"), pa.array(own / math.log(10))], ["h", "n", "c", "lat"])

    base = F.log10((F.col("c") + 0.5) / F.lit(float(floor)))
    known = staged(counts.mapInArrow(log_words, "h long, n long, c long, lat double").select("h", "n", F.col("c").cast("boolean").cast("int").alias("known"), base.alias("base"), "lat"), "scored")
    # the least power of two that leaves no more than hot_words words, so the broadcast stays bounded
    sizes = {r.level: r["count"] for r in known.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).count().collect()}
    level, held = 64, 0
    while level > 0 and held + sizes.get(level - 1, 0) <= hot_words:
        level -= 1
        held += sizes.get(level, 0)
    at_least = float(2**level)
    top = known.where(F.col("n") >= at_least).select("h", "base", "lat", "known").toPandas()
    h = top["h"].to_numpy(np.int64).view(_U)
    order = np.argsort(h)
    hot = spark.sparkContext.broadcast(_Hot(h[order], *(top[c].to_numpy()[order] for c in ("base", "lat", "known"))))
    end = known.where("h = 0").first()
    end_row = (end.base, end.lat, end.known) if end else (0.0, 0.0, 0)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["uid", "h", "tf", "doc_id", "n_tokens", "n_known", "base", "lat"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, uid = hot.value, (TaskContext.get().partitionId() << 40)
        for b in _text.chunks(batches):
            w = _text.split_words(b.column("text"), _TABLE)
            rows = b.num_rows
            u, at = np.unique(w.hashes(), return_inverse=True)
            place = np.minimum(np.searchsorted(m.h, u), max(0, m.h.size - 1))
            found = m.h[place] == u if m.h.size else np.zeros(u.size, bool)
            doc = w.doc
            sums = [np.bincount(doc, np.where(found, x[place] if m.h.size else 0.0, 0.0)[at], rows) for x in (m.base, m.lat, m.known)]
            ids = uid + np.arange(rows)
            uid += rows
            # a document's own row has no word; its key is its own number, so these rows spread
            own = pa.record_batch([pa.array(ids), pa.array(ids), pa.array(np.zeros(rows, np.int64)), b.column("doc_id"), pa.array(w.count + 1), pa.array(sums[2].astype(np.int64) + end_row[2]), pa.array(sums[0] + end_row[0]), pa.array(sums[1] + end_row[1])], names)
            yield own
            rest = np.flatnonzero(~found[at])
            if rest.size:
                pair, tf = np.unique(doc[rest] * u.size + at[rest], return_counts=True)
                d, x = np.divmod(pair, u.size)
                none = lambda t, n=pair.size: pa.nulls(n, t)
                yield pa.record_batch([pa.array(ids[d]), pa.array(u[x].view(np.int64)), pa.array(tf.astype(np.int64)), none(own.schema.field("doc_id").type), none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.float64())], names)

    tokens = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(look_up, f"uid long, h long, tf long, doc_id {kind}, n_tokens long, n_known long, base double, lat double")
    rare = known.where(F.col("n") < at_least).select("h", F.col("known").alias("w_known"), F.col("base").alias("w_base"), F.col("lat").alias("w_lat"))
    each = tokens.join(rare, (tokens.h == rare.h) & (tokens.tf > 0), "left")
    plus = lambda own, word: F.sum(F.coalesce(F.col(own), F.lit(0)) + F.coalesce(F.col("tf") * F.col(word), F.lit(0)))
    return (
        each.groupBy("uid")
        .agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), plus("n_known", "w_known").cast("long").alias("n_known"), plus("base", "w_base").alias("base_score"), plus("lat", "w_lat").alias("score"))
        .select("doc_id", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
    )


def query(spark, sf_dir: str) -> DataFrame:
    found = scores(table(spark, sf_dir, "documents"), F.coalesce(fold(F.col("doc_id"), 5) != 1, F.lit(False)))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
