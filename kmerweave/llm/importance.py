"""Importance resampling towards a target distribution of hashed word features.

Features of a text are its words and its pairs of neighbouring words; the bucket of
a feature is the crc32 of its bytes modulo ``buckets``.  The gain of a bucket is the
logarithm of how much more frequent it is in the target than in the corpus, the
weight of a document the mean gain of its features.  Documents are drawn without
replacement by weight plus Gumbel noise, which their ids give.

Texts are hashed with a head-tail vocabulary.  The head holds the most frequent words
of the corpus with their exact states of the crc register, and the most frequent
pairs of them with their buckets; both are broadcast, ``HEAD_WORDS`` and
``HEAD_PAIRS`` entries at most, and found by comparing whole words, not hashes.  All
other features take the crc itself: a word's register is summed from its blocks of 32
bytes, a pair's from the registers of its two words, since the crc is linear.  Head
and tail give the same buckets, so the head's choice changes no result.

Totals of buckets are exact sums over all texts: every task adds up its own, so
``buckets`` rows a task are shuffled.  Ranks come from the counts of each score (a
few ten thousand whole numbers, bounded by the logarithm of the totals) and the order
within a score.

Defined cases: null, empty and word-free texts have no features and weight 0; repeated
rows are documents each; a null doc_id has no noise, so it has neither score nor rank
and doesn't count as a document to draw from; empty tables are fine; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _text
from ._shared import named, staged, table

BUCKETS = 10_000
SEED = 7
#: Percent of the documents with at least MIN_WORDS words that are drawn.
PERCENT = 25
MIN_WORDS = 20
#: Words of the head at most, of up to 16 bytes each; pairs are counted among the first PAIR_WORDS of them.
HEAD_WORDS, PAIR_WORDS, HEAD_PAIRS = 65_536, 4_096, 262_144
#: Distinct words or pairs that a task holds before it hands on their counts.
HELD = 400_000

_U, _U4 = np.uint64, np.uint32
_ONES = _U4(0xFFFFFFFF)


# ---------------------------------------------------------------- the crc of many words at once


def _byte_table() -> np.ndarray:
    """Register after one byte, for the reflected polynomial 0xEDB88320."""
    t = np.arange(256, dtype=_U4)
    for _ in range(8):
        t = np.where(t & _U4(1), (t >> _U4(1)) ^ _U4(0xEDB88320), t >> _U4(1))
    return t


_T = _byte_table()


def _step(register: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _T[(register ^ np.asarray(byte).astype(_U4)) & _U4(0xFF)] ^ (register >> _U4(8))


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Tables (n, byte of the register, its value) for n = 0 to 63 zero bytes, and for 64, 128, 256, ... of them."""
    one = (np.arange(256, dtype=_U4)[None, :] << (_U4(8) * np.arange(4, dtype=_U4)[:, None])).astype(_U4)
    small = [one]
    for _ in range(64):
        small.append(_step(small[-1], 0))
    apply = lambda t, x: t[0][x & _U4(255)] ^ t[1][(x >> _U4(8)) & _U4(255)] ^ t[2][(x >> _U4(16)) & _U4(255)] ^ t[3][x >> _U4(24)]
    large = [small[64]]
    for _ in range(30):
        large.append(apply(large[-1], large[-1]))
    return np.array(small[:64]), np.array(large)


_SMALL, _LARGE = _shift_tables()


def shift(register: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The register after so many zero bytes."""

    def apply(t: np.ndarray, n: np.ndarray, x: np.ndarray) -> np.ndarray:
        return t[n, 0, x & _U4(255)] ^ t[n, 1, (x >> _U4(8)) & _U4(255)] ^ t[n, 2, (x >> _U4(16)) & _U4(255)] ^ t[n, 3, x >> _U4(24)]

    out = apply(_SMALL, zeros & 63, register)
    rest = zeros >> 6
    at = np.flatnonzero(rest)
    power = 0
    while at.size:
        odd = at[rest[at] & 1 == 1]
        out[odd] = apply(_LARGE, np.full(odd.size, power), out[odd])
        rest[at] >>= 1
        at = at[rest[at] > 0]
        power += 1
    return out


def registers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 32) -> np.ndarray:
    """The crc register of every word, from a register of 0."""
    if not starts.size:
        return np.zeros(0, _U4)
    size = ends - starts
    n = -(-size // block)
    first = np.cumsum(n) - n
    at = np.repeat(starts, n) + block * (np.arange(int(n.sum())) - np.repeat(first, n))
    length = np.minimum(np.repeat(ends, n) - at, block)
    order = np.argsort(-length, kind="stable")
    place, left = at[order], length[order]
    live = np.searchsorted(-left, -np.arange(block), side="left")  # blocks longer than j bytes
    reg = np.zeros(place.size, _U4)
    for j in range(block):
        if not live[j]:
            break
        reg[: live[j]] = _step(reg[: live[j]], data[place[: live[j]] + j])
    out = np.empty_like(reg)
    out[order] = reg
    return np.bitwise_xor.reduceat(shift(out, np.repeat(ends, n) - at - length), first)


def _full(register: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The register of the same bytes from a register of ones, where a crc starts."""
    return register ^ shift(np.full(register.size, _ONES), size)


# ---------------------------------------------------------------- the head


def _spread(x: np.ndarray, bits: int) -> np.ndarray:
    return (_text.mix(x) >> _U(64 - bits)).astype(np.int64)


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """One entry per slot, the first (most frequent) one that comes there; -1 for none.  Those that find theirs taken are tail."""
    out = np.full(1 << bits, -1, np.int32)
    slot = _spread(keys, bits)
    out[slot[::-1]] = np.arange(keys.size - 1, -1, -1, dtype=np.int32)
    return out


@dataclass
class Head:
    """Frequent words (two 8-byte numbers each) with register and size; frequent pairs (codes of two words) with their buckets."""

    words: np.ndarray
    register: np.ndarray
    size: np.ndarray
    word_slots: np.ndarray
    pairs: np.ndarray
    pair_bucket: np.ndarray
    pair_slots: np.ndarray

    def find_words(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of every word in the head, -1 for the tail."""
        if not self.words.size:
            return np.full(low.size, -1, np.int32)
        at = self.word_slots[_spread(_joined(low, high), 18)]
        same = (self.words[at, 0] == low) & (self.words[at, 1] == high) & (at >= 0)
        return np.where(same, at, -1)

    def find_pairs(self, code: np.ndarray) -> np.ndarray:
        """Bucket of every pair in the head, -1 for the tail."""
        if not self.pairs.size:
            return np.full(code.size, -1, np.int64)
        at = self.pair_slots[_spread(code.astype(_U), 20)]
        return np.where((self.pairs[at] == code) & (at >= 0), self.pair_bucket[at], -1)


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low ^ _text.mix(high + _U(0x9E3779B97F4A7C15))


def _key_columns(w: _text.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two numbers of every word of up to 16 bytes, and which those are."""
    value, at, begin = w.lanes()
    short = (w.ends - w.starts) <= 16
    low = value[begin] if value.size else np.zeros(0, _U)
    high = np.zeros(low.size, _U)
    second = short & ((w.ends - w.starts) > 8)
    high[second] = value[begin[second] + 1]
    return low, high, short


def _pair_code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 20 | b.astype(np.int64)


def _tally(parts: Iterator[pa.Array], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Counts of values, handed on whenever HELD of them are distinct."""
    held: list[pa.Table] = []
    waiting = 0
    for values in parts:
        c = pc.value_counts(values)
        held.append(pa.table({"value": c.field("values").cast(kind), "n": c.field("counts")}))
        waiting += len(c)
        if waiting > HELD:
            held = [pa.concat_tables(held).group_by("value").aggregate([("n", "sum")]).rename_columns({"value": "value", "n_sum": "n"})]
            waiting = held[0].num_rows
            if waiting > HELD // 2:
                yield from held.pop().to_batches()
                waiting = 0
    if held:
        yield from pa.concat_tables(held).group_by("value").aggregate([("n", "sum")]).rename_columns({"value": "value", "n_sum": "n"}).to_batches()


_TABLE = _text.alphanumeric_table()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("binary").alias("text"))


def _empty_head() -> Head:
    none = np.zeros(0, np.int64)
    return Head(np.zeros((0, 2), _U), np.zeros(0, _U4), none, np.zeros(0, np.int32), none, none, np.zeros(0, np.int32))


def head_of(docs: DataFrame, buckets: int = BUCKETS, head_words: int = HEAD_WORDS, head_pairs: int = HEAD_PAIRS) -> Head:
    """The head of all texts, from counts over all of them."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for b in _text.chunks(batches):
                low, high, short = _key_columns(_text.split_words(b.column("text"), _TABLE))
                both = np.ascontiguousarray(np.stack([low[short], high[short]], 1))
                if len(both):
                    yield pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(both), [None, pa.py_buffer(both)])

        yield from _tally(parts(), pa.binary())

    most = lambda df, n: df.groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(n).select("value").toArrow().column("value").to_pylist()
    head = _empty_head()
    found = most(_texts(docs).mapInArrow(words, "value binary, n long"), head_words)
    if not found:
        return head
    head.words = np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)
    head.word_slots = _slots(_joined(head.words[:, 0], head.words[:, 1]), 18)
    head.size = np.count_nonzero(head.words.view(np.uint8).reshape(-1, 16), axis=1).astype(np.int64)
    data = head.words.view(np.uint8).ravel()
    begin = 16 * np.arange(len(head.words))
    head.register = registers(data, begin, begin + head.size)
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for b in _text.chunks(batches):
                w = _text.split_words(b.column("text"), _TABLE)
                low, high, short = _key_columns(w)
                at = np.where(short, shared.value.find_words(low, high), -1)
                at[at >= PAIR_WORDS] = -1
                both = (at[:-1] >= 0) & (at[1:] >= 0) & (w.doc[:-1] == w.doc[1:])
                if both.any():
                    yield pa.array(_pair_code(at[:-1][both], at[1:][both]))

        yield from _tally(parts(), pa.int64())

    head.pairs = np.array(most(_texts(docs).mapInArrow(pairs, "value long, n long"), head_pairs), np.int64)
    shared.unpersist()
    a, b = head.pairs >> 20, head.pairs & (1 << 20) - 1
    spaced = _step(_full(head.register, head.size), 0x20)
    head.pair_bucket = ((shift(spaced[a], head.size[b]) ^ head.register[b] ^ _ONES) % _U4(buckets)).astype(np.int64)
    head.pair_slots = _slots(head.pairs.astype(_U), 20)
    return head


def features(w: _text.Words, head: Head, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and of all pairs of the texts, and the text of each pair and of each word."""
    low, high, short = _key_columns(w)
    size, doc = w.ends - w.starts, w.doc
    at = np.where(short, head.find_words(low, high), -1)
    register = np.empty(size.size, _U4)
    known = at >= 0
    register[known] = head.register[at[known]]
    register[~known] = registers(w.data, w.starts[~known], w.ends[~known])
    full = _full(register, size)
    of_words = ((full ^ _ONES) % _U4(buckets)).astype(np.int64)
    left = np.flatnonzero(doc[:-1] == doc[1:])
    code = np.where(known[left] & known[left + 1], _pair_code(at[left], at[left + 1]), -1)
    of_pairs = head.find_pairs(code)
    tail = np.flatnonzero(of_pairs < 0)
    a, b = left[tail], left[tail] + 1
    of_pairs[tail] = (shift(_step(full[a], 0x20), size[b]) ^ register[b] ^ _ONES) % _U4(buckets)
    return of_words, of_pairs, doc[left], doc


# ---------------------------------------------------------------- totals, weights, draws


def totals(docs: DataFrame, head, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in _text.chunks(batches):
            of_words, of_pairs, _, _ = features(_text.split_words(b.column("text"), _TABLE), head.value, buckets)
            n += np.bincount(of_words, minlength=buckets) + np.bincount(of_pairs, minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in _texts(docs).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of smoothed target share over smoothed source share, floored."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), source.size
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    sc = docs.sparkSession.sparkContext
    head = sc.broadcast(head_of(docs, buckets))
    gain = sc.broadcast(gains(totals(docs, head, buckets), totals(target, head, buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.chunks(batches):
            w = _text.split_words(b.column("text"), _TABLE)
            of_words, of_pairs, pair_doc, word_doc = features(w, head.value, buckets)
            sums = np.zeros(b.num_rows, np.int64)
            np.add.at(sums, word_doc, gain.value[of_words])
            np.add.at(sums, pair_doc, gain.value[of_pairs])
            n = w.count + np.maximum(w.count - 1, 0)
            yield pa.record_batch([b.column("doc_id"), pa.array(w.count.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(sums // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row; rank is null for rows that aren't drawn."""
    spark = docs.sparkSession
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = staged(weights(docs, target, buckets).withColumn("score", F.col("weight") + noise), "scored")
    may = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    counts = sorted(((r.score, r["count"]) for r in scored.where(may).groupBy("score").count().collect()), reverse=True)
    wanted = percent * sum(n for _, n in counts) // 100
    ahead, before = 0, []
    for score, n in counts:
        if ahead >= wanted:
            break
        before.append((score, ahead))
        ahead += n
    cut = before[-1][0] if before else None
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    in_ = may & (F.col("score") >= cut)
    some = scored.where(in_).join(F.broadcast(spark.createDataFrame(before, "score long, before long")), "score")
    # the noise spreads documents over scores, so none has many; rows that share an id are told apart by what else they have
    rank = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_features", "weight"))
    ranked = some.withColumn("rank", rank.cast("long")).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).select(*scored.columns, "rank")
    return ranked.unionByName(scored.where(~F.coalesce(in_, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn documents with all their columns.  Rows that share a doc_id are drawn together if one of them is."""
    chosen = draw(docs, target, **how).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(chosen, docs["doc_id"] == chosen["_drawn"], "left_semi").select(*named(docs))


def query(spark, sf_dir: str) -> DataFrame:
    return draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


_FEATURES = r"""
  SELECT {id}, n_words, unnest(w || list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS f
  FROM (SELECT {id}, len(w) AS n_words, w FROM (SELECT {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}))"""

SQL = (
    r"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT i, c AS v FROM bits WHERE k = 8),
d AS ("""
    + _FEATURES.format(id="doc_id", table="documents")
    + r"""),
b AS ("""
    + _FEATURES.format(id="item_id", table="benchmark")
    + r"""),
f AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM d UNION SELECT f FROM b)),
reg(f, h, k, c) AS (
  SELECT f, h, 0, CAST(4294967295 AS BIGINT) FROM f
  UNION ALL
  SELECT f, h, k + 1, xor(crc.v, c >> 8) FROM reg JOIN crc ON crc.i = xor(c & 255, 16 * (strpos('0123456789ABCDEF', h[2 * k + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * k + 2]) - 1)
  WHERE 2 * k < len(h)),
bucket AS (SELECT f, xor(c, 4294967295) % 10000 AS bucket FROM reg WHERE 2 * k = len(h)),
s AS (SELECT bucket, count(*) AS s FROM d JOIN bucket USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN bucket USING (f) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, max(n_words) AS n_words, count(*) AS n, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM d JOIN bucket USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN w USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
)
