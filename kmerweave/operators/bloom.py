"""Approximate membership: a Bloom filter built by aggregation and asked within codegen.

It stands before an exact join and never instead of it: rows that it lets through by
mistake fall away there, and it drops no row that the join would keep.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits per key, and hashes: about 3 % of other keys pass, at half the work of the best filter of that size.
BITS_PER_KEY, HASHES = 8, 3
#: Bits of a filter at most (32 MB); more keys are not worth a broadcast.
MOST_BITS = 2**28


def expected_rate(bits_per_key: int = BITS_PER_KEY, hashes: int = HASHES) -> float:
    """Share of foreign keys that pass."""
    return (1 - math.exp(-hashes / bits_per_key)) ** hashes


def _positions(key: Column, bits: int, hashes: int) -> list[Column]:
    # two halves of one hash, so nothing overflows
    h = F.xxhash64(key, F.lit(1))
    one, two = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    return [(one + i * two) % bits for i in range(hashes)]


def build(keys: DataFrame, key: str, n: int, bits_per_key: int = BITS_PER_KEY, hashes: int = HASHES) -> DataFrame | None:
    """One row (bits, words): the filter of n keys (counted by the caller); None where it would be over ``MOST_BITS``.

    Every task ors the bits of its own keys into 64-bit words first, so no more than the
    filter's words are shuffled from each.
    """
    size = -(-max(n * bits_per_key, 64) // 64)
    if 64 * size > MOST_BITS:
        return None
    at = keys.select(F.explode(F.array(*_positions(F.col(key), 64 * size, hashes))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("word"))
    every = keys.sparkSession.range(size).select(F.col("id").alias("i")).join(words, "i", "left").select("i", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    # the words of one filter, at most MOST_BITS
    row = every.groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
    return row.select(F.lit(64 * size).cast("long").alias("bits"), F.col("w.word").alias("words"))


def sift(df: DataFrame, key: str, filter_: DataFrame, hashes: int = HASHES) -> DataFrame:
    """The rows whose key may be in the filter: all of those that are, and few others."""
    size = filter_.select("bits").first().bits
    held = df.crossJoin(F.broadcast(filter_.select(F.col("words").alias("_words"))))  # one row of a size bound
    for at in _positions(F.col(key), size, hashes):
        held = held.where(F.getbit(F.get("_words", F.shiftright(at, 6).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)
    return held.drop("_words")
