"""String and sequence functions: windows, k-mers, complements, hashes, translation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators._stage import checked

#: Characters of the parts that long texts are dealt out in, and of the blocks that k-mers are cut from.
PART, BLOCK = 16_384, 64
#: Characters of a task that has all k-mers of its keys or minimizers, about; of a key that one task takes at most.
SHARE, LONG = 2**21, 2**20
#: Characters that are cut into stretches in one pass, and that are hashed in one; strings that a round of a hash takes at once.
PASS, HASHED, LANES = 2**20, 2**18, 2**15


def windows(df: DataFrame, text: str, size: int, overlap: int, *keep: str) -> DataFrame:
    """One row per window of ``size`` characters, ``overlap`` of them shared with the next: chunk, start (from 0) and window.

    The last window may be shorter; a text no longer than the overlap has none but itself.
    """
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step).cast("int"))
    return (
        df.where(F.length(text) > 0)
        .select(*keep, text, F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
        .select(*keep, "chunk", (F.col("chunk") * step).alias("start"), F.substring(text, F.col("chunk") * step + 1, F.lit(size)).alias("window"))
    )


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out over all cores where the scan makes fewer splits than there are cores; a large input and a stream stay as they are."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    split = int(df._jdf.sparkSession().sessionState().conf().filesMaxPartitionBytes())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < cores * split else df


def pieces(df: DataFrame, text: str, size: int, overlap: int, *keep: str) -> DataFrame:
    """Kept columns, start and piece: every ``size`` characters with the ``overlap`` (at most ``size``) that follow, in one pass over the text."""
    # the cells are a column of their own, so that the lambda doesn't cut the text again for every cell
    cut = df.select(*keep, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("_cells"))
    ahead = lambda i: F.coalesce(F.left(F.get("_cells", i + 1), F.lit(overlap)), F.lit(""))
    return cut.select(*keep, F.inline(F.transform("_cells", lambda c, i: F.struct((i * size).alias("start"), F.concat(c, ahead(i)).alias("piece")))))


def shares(df: DataFrame, text: str) -> int:
    """Tasks for the k-mers of a table, so that each has about ``SHARE`` of them however large it is."""
    n = df.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-n // SHARE))


def kmers(df: DataFrame, text: str, k: int, *keep: str, both_strands: bool = False, dealt: bool = False) -> DataFrame:
    """One row per k-mer: the kept columns, pos (from 0) and kmer.

    Texts shorter than k have none.  Parts that overlap by k - 1 characters let Spark
    deal out long texts, and blocks within them keep positions cheap to reach.  With
    ``both_strands`` a k-mer stands for its reverse complement too: the smaller of
    the two is given.  Rows that the caller has ``dealt`` out stay where they are.
    """
    part, block = max(PART, k), max(BLOCK, k)
    parts = pieces(df.where(F.length(text) >= k), text, part, k - 1, *keep)
    parts = (parts if dealt else spread(parts)).withColumnsRenamed({"start": "_part", "piece": "_text"})
    blocks = pieces(parts, "_text", block, k - 1, *keep, "_part").where(F.length("piece") >= k)
    if both_strands:
        blocks = blocks.withColumn("_back", reverse_complement(F.col("piece")))
    # a part's last characters are its overlap, whose blocks are shorter than k: none is cut twice
    at = blocks.select("*", F.explode(F.sequence(F.lit(0), F.length("piece") - k)).alias("_i"))
    kmer = F.substring("piece", F.col("_i") + 1, F.lit(k))
    if both_strands:
        kmer = F.least(kmer, F.substring("_back", F.length("piece") - F.col("_i") - k + 1, F.lit(k)))
    return at.select(*keep, (F.col("_part") + F.col("start") + F.col("_i")).alias("pos"), kmer.alias("kmer"))


def stretches(df: DataFrame, text: str, k: int, *keep: str) -> DataFrame:
    """Kept columns, deal and stretch: the texts cut where the minimizer of their k-mers changes, so every k-mer is in one stretch.

    A k-mer's minimizer is the least hash of the strings of about k / 3 characters in
    it, over both strands, so equal k-mers and reverse complements have the same
    ``deal`` (its lower 16 bits).  Dealt out by it, a stretch of several k-mers travels as one short string
    instead of a row for each k-mer.
    """
    m = max(k // 3, min(k, 7))
    span = k - m + 1
    parts = _parts(df, text, k, *keep).select(*keep, "piece")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lo, texts in _passes(batches, PASS):
            row, deal, found = _stretches(texts, k, m, span)
            at = pa.array(row + lo)
            yield pa.record_batch([*(b.column(c).take(at) for c in keep), pa.array(deal.astype(np.int32)), pa.array(found, pa.string())], [*keep, "deal", "stretch"])

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in parts.select(*keep).schema)
    return parts.mapInArrow(cut, f"{types}deal int, stretch string")


def packed_stretches(df: DataFrame, text: str, k: int, deals: int, *keep: str) -> DataFrame:
    """deal, texts, sizes and an array of every kept column: ``stretches`` with those of a pass and one of ``deals`` deals in a row, their texts as one."""
    m = max(k // 3, min(k, 7))
    parts = _parts(df, text, k, *keep).select(*keep, "piece")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lo, texts in _passes(batches, PASS):
            row, deal, found = _stretches(texts, k, m, k - m + 1)
            deal = deal.astype(np.int64) % deals
            order = np.argsort(deal, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(deal[order])) + 1, len(order))
            at = np.concatenate([[0], ends])
            found, size = [found[i] for i in order.tolist()], _sizes(found)[order]
            whole = ["".join(found[i:j]) for i, j in zip(at[:-1].tolist(), ends.tolist())]
            lists = lambda x: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), x)  # noqa: B023, E731
            kept = [lists(b.column(c).take(pa.array(row[order] + lo))) for c in keep]
            yield pa.record_batch([pa.array(deal[order][at[:-1]].astype(np.int32)), pa.array(whole, pa.string()), lists(pa.array(size.astype(np.int16))), *kept], ["deal", "texts", "sizes", *keep])

    types = "".join(f", `{f.name}` array<{f.dataType.simpleString()}>" for f in parts.select(*keep).schema)
    return parts.mapInArrow(cut, f"deal int, texts string, sizes array<smallint>{types}")


def _parts(df: DataFrame, text: str, k: int, *keep: str) -> DataFrame:
    """Kept columns, start and piece: the texts in parts that hold every k-mer once, dealt out over the cores."""
    return spread(pieces(df.where(F.length(text) >= k), text, max(PART, k), k - 1, *keep)).where(F.length("piece") >= k)


def _passes(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, int, list[str]]]:
    """Each batch with the first row and the texts (piece) of one pass after the other, of about ``most`` characters."""
    for b in batches:
        texts = b.column("piece").to_pylist()
        ends = np.cumsum([len(t) for t in texts])
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
            yield b, lo, texts[lo:hi]
            lo = hi


def _both_strands(whole: str) -> tuple[np.ndarray, np.ndarray]:
    """The characters, and those that they are exchanged for on the other strand."""
    c = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    turned = c.copy()
    for a, z in ("AT", "TA", "CG", "GC"):
        turned[c == ord(a)] = ord(z)
    return c, turned


def _sizes(texts: list[str]) -> np.ndarray:
    return np.array([len(t) for t in texts])


def _places(size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every k-mer its text (of texts of these sizes), where it begins in the texts as one, and in its own."""
    first = np.cumsum(size) - size
    count = size - k + 1
    row = np.repeat(np.arange(len(size)), count)
    own = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, own + first[row], own


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0x9E3779B97F4A7C15)
    return h ^ (h >> _U(29))


def _stretches(texts: list[str], k: int, m: int, span: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Row, minimizer and text of every stretch of at most ``BLOCK`` k-mers."""
    whole = "".join(texts)
    c, turned = (x.astype(_U) for x in _both_strands(whole))
    n = len(c) - m + 1
    one, two = np.zeros(n, _U), np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for j in range(m):
            one = one * _U(0x100000001B3) + c[j : j + n]
            two = two * _U(0x100000001B3) + turned[m - 1 - j : m - 1 - j + n]
        least = np.minimum(_mixed(one), _mixed(two))
    wide = 1
    while wide < span:  # the least of ``span`` neighbours by doubling
        step = min(wide, span - wide)
        least = np.minimum(least[: len(least) - step], least[step:])
        wide += step
    row, at, _ = _places(_sizes(texts), k)
    key = least[at] & _U(0xFFFF)
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    place = np.arange(len(at))
    new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % BLOCK == 0
    begin = np.flatnonzero(new)
    until = np.append(begin[1:], len(at))
    found = [whole[i:j] for i, j in zip(at[begin].tolist(), (at[until - 1] + k).tolist())]
    return row[begin], key[begin], found


def stretch_keys(rows: DataFrame, k: int, *keep: str) -> DataFrame:
    """Kept columns and one row per k-mer of ``stretch``, as the two parts h and c of the hash that ``kmer_keys`` gives."""
    back = rows.select(*keep, "stretch", reverse_complement(F.col("stretch")).alias("_back"), F.length("stretch").alias("_n"))
    at = back.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - k)).alias("_i"))
    kmer = F.least(F.substring("stretch", F.col("_i") + 1, F.lit(k)), F.substring("_back", F.col("_n") - F.col("_i") - k + 1, F.lit(k)))
    return at.select(*keep, kmer.alias("_kmer")).select(*keep, F.xxhash64("_kmer").alias("h"), F.hash("_kmer").alias("c"))


def distinct_kmers(df: DataFrame, text: str, k: int, key: str, both_strands: bool = False) -> DataFrame:
    """key, n: the distinct k-mers of each key that has any.

    Texts are dealt out by key, so what is shuffled is the texts; the k-mers of keys of
    more than ``LONG`` characters are shuffled, so no task has all of such a key.
    """
    some = df.where(F.length(text) >= k).select(F.struct(key).alias("_key"), F.col(text).alias("_whole"))  # null is a key too
    long_ = checked(some.groupBy("_key").agg(F.sum(F.length("_whole").cast("long")).alias("_n")).where(F.col("_n") > LONG).select("_key"))
    # short k-mers are few and known by themselves, others by 96 bits
    parts = [F.col("kmer")] if k <= 8 else [F.xxhash64("kmer").alias("h"), F.hash("kmer").alias("c")]
    counted = lambda rows, dealt: kmers(rows, "_whole", k, "_key", both_strands=both_strands, dealt=dealt).select("_key", *parts).distinct().groupBy("_key").agg(F.count("*").alias("n"))
    short = some.join(long_, "_key", "left_anti").repartition(shares(some, "_whole"), "_key")
    return counted(short, True).union(counted(some.join(long_, "_key", "left_semi"), False)).select(f"_key.{key}", "n")


def kmer_keys(df: DataFrame, text: str, k: int, *keep: str) -> DataFrame:
    """``kmers`` of both strands as 96-bit hashes (kmer: struct of a long and an int), which shuffles and joins carry instead of strings.

    They are Spark's two hashes of the smaller strand, by columns.
    """
    found = _hashed(df, text, k, keep, "pos int, h long, c int", lambda *at: (xxhash64(*at).view(np.int64), murmur32(*at).view(np.int32)))
    return found.select(*keep, "pos", F.struct("h", "c").alias("kmer"))


def kmer_h60(df: DataFrame, text: str, k: int, *keep: str, most: int = 2**60 - 1) -> DataFrame:
    """Kept columns and hash: ``h60`` of every k-mer's smaller strand, where it is at most ``most``."""
    return _hashed(df, text, k, keep, "pos int, hash long", lambda *at: (md5_60(*at),), most).select(*keep, "hash")


def _hashed(df: DataFrame, text: str, k: int, keep: tuple[str, ...], types: str, hashes_of: Callable, most: int | None = None) -> DataFrame:
    """Kept columns, pos and hashes of every k-mer; with ``most``, of those whose first hash is no more."""
    parts = _parts(df, text, k, *keep)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lo, texts in _passes(batches, HASHED):
            row, pos, *at = _smaller("".join(texts), _sizes(texts), k)
            found = hashes_of(*at)
            if most is not None:
                some = np.flatnonzero(found[0] <= most)
                row, pos, found = row[some], pos[some], [h[some] for h in found]
            rows = pa.array(row + lo)
            starts = np.asarray(b.column("start"))[row + lo]
            columns = [*(b.column(c).take(rows) for c in keep), pa.array((pos + starts).astype(np.int32)), *map(pa.array, found)]
            yield pa.record_batch(columns, [*keep, *(t.split()[0] for t in types.split(", "))])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in parts.select(*keep).schema)
    return parts.mapInArrow(hashed, kept + types)


def _smaller(whole: str, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every k-mer its text (the texts as one, and their sizes), its place there, and the smaller of its strands: the bytes of all, where it begins in them, and its size."""
    c, turned = _both_strands(whole)
    row, at, own = _places(size, k)
    flip, open_ = np.zeros(len(at), bool), np.arange(len(at))
    for j in range(k):  # few are alike for long
        mine, other = c[at[open_] + j], turned[at[open_] + (k - 1 - j)]
        flip[open_[other < mine]] = True
        open_ = open_[other == mine]
        if not open_.size:
            break
    raw = [x.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass") for x in (c, turned[::-1])]
    ends = np.concatenate([[0], np.cumsum(1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))])
    begin, until = ends[at], ends[at + k]
    data = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
    return row, own, data, np.where(flip, 2 * ends[-1] - until, begin), until - begin


def string_keys(whole: str, size: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Number, h and c (the hash that ``kmer_keys`` gives) of every k-mer of texts of ``k`` characters or more (the texts as one, and their sizes), in passes of about ``HASHED`` characters."""
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        start = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, start + HASHED, "right")))
        row, _, *at = _smaller(whole[start : int(ends[hi - 1])], size[lo:hi], k)
        yield row + lo, xxhash64(*at).view(np.int64), murmur32(*at).view(np.int32)
        lo = hi


def _by_size(data: np.ndarray, begin: np.ndarray, size: np.ndarray, kind: type, hash_of: Callable) -> np.ndarray:
    """Hashes of strings in ``data``: those of one size at once, by the word of four bytes that begins at every place."""
    word = sum(data[i : len(data) - 3 + i].astype(np.uint32) << np.uint32(8 * i) for i in range(4))
    out = np.zeros(len(begin), kind)
    for n in np.flatnonzero(np.bincount(size)) if len(size) else ():
        of = np.flatnonzero(size == n)
        for lo in range(0, of.size, LANES):
            some = of[lo : lo + LANES]
            out[some] = hash_of(lambda i, first=begin[some]: word[first + i], some.size, int(n))
    return out


_MD5_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_MD5_S = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_MD5_G = [(1, 0), (5, 1), (3, 5), (7, 0)]


def md5_60(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first 60 bits of the md5 sums of strings in ``data`` (the published algorithm, by columns)."""

    def padded(at, n: int, i: int):
        """The i-th word of the padded message: an array, or a number that all have."""
        whole, rest, last = n // 4, n % 4, 16 * ((n + 8) // 64 + 1)
        if i < whole:
            return at(4 * i)
        if i == whole:
            return at(4 * i) & np.uint32(2 ** (8 * rest) - 1) | np.uint32(0x80 << 8 * rest) if rest else 0x80
        return 8 * n & 0xFFFFFFFF if i == last - 2 else 8 * n >> 32 if i == last - 1 else 0

    def sums(at, lanes: int, n: int) -> np.ndarray:
        state = [np.full(lanes, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        f = np.empty(lanes, np.uint32)
        for block in range((n + 8) // 64 + 1):
            words = [padded(at, n, 16 * block + i) for i in range(16)]
            a, b, c, d = (x.copy() for x in state)
            for i in range(64):
                kind, s = i // 16, _MD5_S[i // 16][i % 4]
                if kind == 0:
                    np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
                elif kind == 1:
                    np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
                elif kind == 2:
                    np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
                else:
                    np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
                step, first = _MD5_G[kind]
                word, plus = words[(step * i + first) % 16], _MD5_K[i]
                np.add(a, f, out=a)
                if isinstance(word, int):
                    plus = (plus + word) & 0xFFFFFFFF
                else:
                    np.add(a, word, out=a)
                np.add(a, np.uint32(plus), out=a)
                np.left_shift(a, np.uint32(s), out=f), np.right_shift(a, np.uint32(32 - s), out=a)
                np.bitwise_or(a, f, out=a), np.add(a, b, out=a)
                a, b, c, d = d, a, b, c
            state = [x + y for x, y in zip(state, (a, b, c, d), strict=True)]
        high, low = (x.byteswap().astype(np.int64) for x in state[:2])
        return high << 28 | low >> 4

    return _by_size(data, begin, size, np.int64, sums)


def xxhash64(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of strings in ``data``, by columns."""
    p1, p2, p3, p4, p5 = map(_U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def sums(at, lanes: int, n: int) -> np.ndarray:
        four = lambda i: at(i).astype(_U)
        eight = lambda i: four(i) | four(i + 4) << _U(32)
        mixed = lambda v, x: _rotl(v + x * p2, 31) * p1
        with np.errstate(over="ignore"):
            i, h = 0, np.full(lanes, 42, _U) + p5
            if n >= 32:
                v = [np.full(lanes, 42, _U) + x for x in (p1 + p2, p2, _U(0), _U(0) - p1)]
                while i + 32 <= n:
                    v, i = [mixed(x, eight(i + 8 * j)) for j, x in enumerate(v)], i + 32
                h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
                for x in v:
                    h = (h ^ mixed(_U(0), x)) * p1 + p4
            h = h + _U(n)
            while i + 8 <= n:
                h, i = _rotl(h ^ mixed(_U(0), eight(i)), 27) * p1 + p4, i + 8
            if i + 4 <= n:
                h, i = _rotl(h ^ four(i) * p1, 23) * p2 + p3, i + 4
            for j in range(i, n):
                h = _rotl(h ^ (four(j) & _U(0xFF)) * p5, 11) * p1
            h = (h ^ (h >> _U(33))) * p2
            h = (h ^ (h >> _U(29))) * p3
            return h ^ (h >> _U(32))

    return _by_size(data, begin, size, _U, sums)


def murmur32(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Spark's hash of strings in ``data``, by columns: bytes after the last word are mixed in one by one, with their sign."""
    u = np.uint32
    turn = lambda h, r: h << u(r) | h >> u(32 - r)

    def sums(at, lanes: int, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = np.full(lanes, 42, u)
            whole = n - n % 4
            for i in [*range(0, whole, 4), *range(whole, n)]:
                x = at(i) if i < whole else (at(i) & u(0xFF)).astype(np.uint8).view(np.int8).astype(np.int32).view(u)
                h = turn(h ^ turn(x * u(0xCC9E2D51), 15) * u(0x1B873593), 13) * u(5) + u(0xE6546B64)
            h = h ^ u(n)
            h = (h ^ h >> u(16)) * u(0x85EBCA6B)
            h = (h ^ h >> u(13)) * u(0xC2B2AE35)
            return h ^ h >> u(16)

    return _by_size(data, begin, size, u, sums)


def reverse_complement(seq: Column) -> Column:
    """Reverse of the string with A<->T and C<->G exchanged; other characters stay."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(seq: Column) -> Column:
    return F.least(seq, reverse_complement(seq))


def h60_digits(value: Column) -> Column:
    """The first 15 hexadecimal digits of the md5 sum."""
    return F.substring(F.md5(value), 1, 15)


def from_digits(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def h60(value: Column) -> Column:
    """A non-negative 60-bit hash that any SQL engine with md5 can repeat."""
    return from_digits(h60_digits(value))


def end_match(s: Column, t: Column, k: int, direction: str) -> Column:
    """Whether the k - 1 characters at an end of s ('p'refix or 's'uffix) meet those of t, as it is or reverse-complemented.

    ``direction`` names the ends of s and t, such as 'sp'.  The result has ``match`` and ``rc``.
    """
    end = {"p": lambda x: F.left(x, F.lit(k - 1)), "s": lambda x: F.right(x, F.lit(k - 1))}
    mine, plain, turned = end[direction[0]](s), end[direction[1]](t), end[direction[1]](reverse_complement(t))
    return F.struct(((mine == plain) | (mine == turned)).alias("match"), ((mine != plain) & (mine == turned)).alias("rc"))


def virtual_offset(block: Column, within: Column) -> Column:
    """Block start in the upper 48 bits, place within the block in the lower 16."""
    return F.shiftleft(block.cast("long"), 16).bitwiseOR(within.cast("long"))


def split_virtual_offset(offset: Column) -> Column:
    return F.struct(F.shiftrightunsigned(offset, 16).alias("block"), offset.bitwiseAND(F.lit(65535)).alias("within"))


def is_pair(first: Column, second: Column) -> Column:
    """Names of mates: one stem with /1 and /2, or equal and not empty."""
    stem = lambda c: F.substring(c, F.lit(1), F.length(c) - 2)
    mates = F.endswith(first, F.lit("/1")) & F.endswith(second, F.lit("/2")) & (F.length(first) > 2) & (stem(first) == stem(second))
    return F.coalesce(mates | ((first == second) & (first != "")), F.lit(False))


# ---------------------------------------------------------------- murmur hashes (not built into Spark)

_U = np.uint64


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _fmix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def murmur64(data: np.ndarray, seed: int) -> np.ndarray:
    """First 64 bits of the 128-bit x64 murmur3 hash of equally long byte rows (the published algorithm, by columns)."""
    rows, n = data.shape
    c1, c2 = _U(0x87C37B91114253D5), _U(0x4CF5AD432745937F)
    with np.errstate(over="ignore"):
        h1 = np.full(rows, seed, _U)
        h2 = h1.copy()
        padded = np.zeros((rows, -(-max(n, 1) // 16) * 16), np.uint8)
        padded[:, :n] = data
        lanes = padded.view("<u8").reshape(rows, -1)
        for i in range(n // 16):
            k1, k2 = lanes[:, 2 * i], lanes[:, 2 * i + 1]
            h1 = (_rotl(h1 ^ (_rotl(k1 * c1, 31) * c2), 27) + h2) * _U(5) + _U(0x52DCE729)
            h2 = (_rotl(h2 ^ (_rotl(k2 * c2, 33) * c1), 31) + h1) * _U(5) + _U(0x38495AB5)
        if n % 16:
            k1, k2 = lanes[:, -2], lanes[:, -1]
            if n % 16 > 8:
                h2 = h2 ^ (_rotl(k2 * c2, 33) * c1)
            h1 = h1 ^ (_rotl(k1 * c1, 31) * c2)
        h1, h2 = h1 ^ _U(n), h2 ^ _U(n)
        h1 = h1 + h2
        h2 = h2 + h1
        h1, h2 = _fmix(h1), _fmix(h2)
        return h1 + h2


def murmur_strings(values: pd.Series, seed: int) -> np.ndarray:
    """murmur64 of strings, grouped by length; nulls hash as 0."""
    raw = [v.encode() if v is not None else b"" for v in values]
    size = np.array([len(b) for b in raw])
    out = np.zeros(len(raw), _U)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        out[at] = murmur64(np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(at.size, int(n)), seed)
    return out


def murmur(value: Column, seed: int = 42) -> Column:
    """64-bit murmur as a bit pattern in a long."""

    @F.pandas_udf("long")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(murmur_strings(v, seed).view(np.int64))

    return run(value)


def index_hash(kmer: Column) -> Column:
    """Strand-symmetric k-mer hash: murmur (seed 0) of both strands joined by XOR; a palindrome keeps its single hash."""
    rc = reverse_complement(kmer)
    return F.when(kmer == rc, murmur(kmer, 0)).otherwise(murmur(kmer, 0).bitwiseXOR(murmur(rc, 0)))


def sketch_hash(kmer: Column) -> Column:
    """Sketch hash: murmur (seed 42) of the smaller strand."""
    return murmur(canonical(kmer), 42)


def unsigned(value: Column) -> Column:
    """A long's bit pattern as an unsigned decimal."""
    return F.when(value >= 0, value.cast("decimal(20,0)")).otherwise(value.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)"))


def under_scaled(value: Column, scaled: int) -> Column:
    """Whether an unsigned hash is at most 2**64 / scaled; for scaled of 2 or more those are non-negative longs."""
    return value.between(0, 2**64 // scaled) if scaled > 1 else F.lit(True)


# ---------------------------------------------------------------- translation


def codon_table() -> dict[str, str]:
    """The standard genetic code, in the order T, C, A, G of each codon position (fixed values)."""
    amino = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
    return {a + b + c: amino[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def translate_frames(seq: Column) -> Column:
    """Proteins of the six reading frames: offsets 0 to 2 of both strands; an unknown codon is X."""
    codons = F.create_map(*(F.lit(x) for pair in codon_table().items() for x in pair))

    def frame(s: Column, offset: int) -> Column:
        count = F.floor((F.length(s) - offset) / 3).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.coalesce(F.try_element_at(codons, F.substring(s, i * 3 + 1 + offset, F.lit(3))), F.lit("X")))
        return F.when(count > 0, F.array_join(parts, "")).otherwise(F.lit(""))

    return F.array(*(frame(s, o) for s in (seq, reverse_complement(seq)) for o in range(3)))
