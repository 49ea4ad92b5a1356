import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kmerweave.functions import sequence as seq


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_kmers_over_blocks(spark):
    rng = np.random.default_rng(1)
    texts = ["", None, "ab", "abc", "".join(rng.choice(list("acgté"), 2503)), "x" * (seq.BLOCK + 2)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, seq string")
    got = sorted(map(tuple, seq.kmers(d, "seq", 3, "id").collect()))
    assert got == sorted((i, p, t[p : p + 3]) for i, t in enumerate(texts) if t for p in range(len(t) - 2))


def test_kmers_of_both_strands_in_parts(spark, monkeypatch):
    text = "ACGTT\nü🙂漢AC" + "GATTACA" * 9
    d = spark.createDataFrame([(1, text)], "id int, seq string")
    turned = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for part, block in ((7, 3), (5, 5), (20, 4), (1000, 64)):
        monkeypatch.setattr(seq, "PART", part)
        monkeypatch.setattr(seq, "BLOCK", block)
        got = sorted(map(tuple, seq.kmers(d, "seq", 4, "id", both_strands=True).collect()))
        assert got == [(1, p, min(text[p : p + 4], turned(text[p : p + 4]))) for p in range(len(text) - 3)]
    back = d.select("id", seq.reverse_complement(F.col("seq")).alias("seq"))
    keys = lambda x: sorted((r.kmer.h, r.kmer.c) for r in seq.kmer_keys(x, "seq", 4).collect())
    assert keys(d) == keys(back)


def test_windows(spark):
    d = spark.createDataFrame([(1, "abcdefghij"), (2, "abc"), (3, "")], "id int, t string")
    got = sorted(map(tuple, seq.windows(d, "t", 4, 1, "id").collect()))
    assert got == [(1, 0, 0, "abcd"), (1, 1, 3, "defg"), (1, 2, 6, "ghij"), (2, 0, 0, "abc")]


def test_complement_and_ends(spark):
    lit = F.lit
    assert one(spark, seq.reverse_complement(lit("AACGN"))) == "NCGTT"
    assert one(spark, seq.canonical(lit("TTT"))) == "AAA"
    for s, t, d, want in (("AACG", "CGTT", "sp", (True, False)), ("AACG", "AACC", "sp", (False, False)), ("AACG", "GGCG", "sp", (True, True)), ("CGAA", "CGTT", "pp", (True, False))):
        got = one(spark, seq.end_match(lit(s), lit(t), 3, d))
        assert (got.match, got.rc) == want, (s, t, d)


def test_murmur_published_values(spark):
    """Known values of the x64 128-bit variant (first half)."""
    got = seq.murmur_strings(pd.Series(["", "foo"]), 0)
    assert got.tolist() == [0, int.from_bytes(bytes.fromhex("6145f501578671e2"), "little")]
    # every tail length agrees with a plain scalar version
    m = 2**64 - 1

    def plain(b, seed):
        rot = lambda x, r: ((x << r) | (x >> (64 - r))) & m
        c1, c2, h1, h2 = 0x87C37B91114253D5, 0x4CF5AD432745937F, seed, seed
        n = len(b)
        for i in range(0, n - n % 16, 16):
            k1, k2 = int.from_bytes(b[i : i + 8], "little"), int.from_bytes(b[i + 8 : i + 16], "little")
            h1 = (((rot(h1 ^ (rot(k1 * c1 & m, 31) * c2 & m), 27) + h2) & m) * 5 + 0x52DCE729) & m
            h2 = (((rot(h2 ^ (rot(k2 * c2 & m, 33) * c1 & m), 31) + h1) & m) * 5 + 0x38495AB5) & m
        t = b[n - n % 16 :]
        if len(t) > 8:
            h2 ^= rot(int.from_bytes(t[8:], "little") * c2 & m, 33) * c1 & m
        if t:
            h1 ^= rot(int.from_bytes(t[:8], "little") * c1 & m, 31) * c2 & m
        h1, h2 = h1 ^ n, h2 ^ n
        h1 = (h1 + h2) & m
        h2 = (h2 + h1) & m

        def mix(h):
            h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD & m
            h = (h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53 & m
            return h ^ (h >> 33)

        return (mix(h1) + mix(h2)) & m

    words = ["ACGTN"[i % 5] * 1 + "GATTACA" * 9 for i in range(5)]
    words = [w[:n] for w in words for n in range(0, 60, 7)]
    for seed in (0, 42):
        assert seq.murmur_strings(pd.Series(words), seed).tolist() == [plain(w.encode(), seed) for w in words]


def test_strand_symmetric_hashes(spark):
    d = spark.createDataFrame([("ACGGT",), ("ACCGT",), ("ACGT",)], "k string")
    rows = d.select(seq.index_hash(F.col("k")).alias("i"), seq.sketch_hash(F.col("k")).alias("s"), seq.murmur(F.col("k"), 0).alias("m")).collect()
    assert rows[0].i == rows[1].i and rows[0].s == rows[1].s
    assert rows[2].i == rows[2].m  # a palindrome keeps its own hash
    assert one(spark, seq.unsigned(F.lit(-1).cast("long"))) == 2**64 - 1


def test_offsets_and_pairs(spark):
    v = seq.virtual_offset(F.lit(123456), F.lit(789))
    assert one(spark, v) == (123456 << 16) | 789
    assert tuple(one(spark, seq.split_virtual_offset(v))) == (123456, 789)
    for a, b, want in (("r/1", "r/2", True), ("r/2", "r/1", False), ("/1", "/2", False), ("r", "r", True), ("", "", False), ("a/1", "b/2", False)):
        assert one(spark, seq.is_pair(F.lit(a), F.lit(b))) == want, (a, b)


def test_translation(spark):
    got = one(spark, seq.translate_frames(F.lit("ATGGCCTAA")))
    assert got[0] == "MA*" and got[3] == "LGH" and len(got) == 6
    assert one(spark, seq.translate_frames(F.lit("AT"))) == [""] * 6
    assert one(spark, seq.translate_frames(F.lit("ATGNNN")))[0] == "MX"


def test_hashes_by_columns_are_those_of_every_kmer(spark):
    """Hashes of a pass are Spark's own of the smaller strands, whatever the k-mers' bytes; texts over several parts keep places; no k-mer is cut in the plan."""
    rng = random.Random(8)
    word = lambda n, letters="ACGTxy é€\U0001f600": "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, word(rng.randint(0, 300))) for i in range(30)] + [(50, word(40_000)), (51, "A" * 200), (52, "ACGT" * 50), (None, word(90)), (53, None), (54, "é" * 150)]
    d = spark.createDataFrame(rows, "id long, seq string")
    for k in (3, 31, 70, 130):
        plain = seq.kmers(d, "seq", k, "id", both_strands=True)
        keys = seq.kmer_keys(d, "seq", k, "id").select("id", "pos", "kmer.h", "kmer.c")
        assert keys.exceptAll(plain.select("id", "pos", F.xxhash64("kmer"), F.hash("kmer"))).isEmpty() and keys.count() == plain.count()
        for most in (2**60 - 1, 2**57):
            want = plain.select("id", seq.h60(F.col("kmer")).alias("hash")).where(F.col("hash") <= most)
            got = seq.kmer_h60(d, "seq", k, "id", most=most)
            assert got.exceptAll(want).isEmpty() and got.count() == want.count()
    assert "Generate explode" not in got._jdf.queryExecution().executedPlan().toString()
