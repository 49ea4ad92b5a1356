import random

import numpy as np
import pyarrow as pa
import pytest

from kmerweave.llm import _text, decontaminate, jaccard, lm_score


def thue_morse(n):
    """A word of two letters and its letter-swapped twin, which collide under any polynomial modulo 2**64 from 1,024 letters on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


LENGTHS = [1024, 2048, 8192, 65536]


@pytest.mark.parametrize("n", LENGTHS)
def test_swapped_words_differ(n):
    a, b = thue_morse(n)
    h = _text.split_words(pa.array([f"{a} {b}  x{a}", f"{b} {a}"], pa.string()).cast(pa.binary()), _text.whitespace_table()).hashes()
    assert h[0] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_equal_hash_is_equal_word():
    rng = random.Random(1)
    words = ["".join(rng.choice("ab\0é") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 40]))) for _ in range(4000)]
    texts = [" ".join(words[i : i + 7]) for i in range(0, 4000, 7)] + ["", None, " \n"]
    w = _text.split_words(pa.array(texts, pa.string()).cast(pa.binary()), _text.whitespace_table())
    assert w.starts.size == 4000
    assert len(set(words)) == np.unique(w.hashes()).size
    assert len({(x, h) for x, h in zip(words, w.hashes().tolist(), strict=True)}) == len(set(words))


@pytest.mark.parametrize("n", LENGTHS)
def test_operators_tell_swapped_words_apart(spark, n):
    a, b = thue_morse(n)
    d = spark.createDataFrame([(5, a), (10, b), (15, a)], "doc_id long, text string")
    linked = {r.doc_id: r.component_id for r in jaccard.similar(d).collect()}
    assert linked == {5: 5, 10: 10, 15: 5}
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    for most in (decontaminate.MAX_BROADCAST, 0):
        assert {r.doc_id: r.n_hit for r in decontaminate.contamination(d, bench, max_broadcast=most).collect()} == {5: 1, 10: 0, 15: 1}


def test_language_model_tells_swapped_words_apart(spark):
    a, b = thue_morse(1024)
    from kmerweave.llm._shared import fold
    from pyspark.sql import functions as F

    ids = spark.range(200).select(F.col("id").alias("doc_id"), fold(F.col("id"), 5).alias("f"))
    train = [r.doc_id for r in ids.where("f <> 1").limit(3).collect()]
    held = ids.where("f = 1").first().doc_id
    d = spark.createDataFrame([(train[0], a), (train[1], "one two"), (held, b)], "doc_id long, text string")
    known = {r.doc_id: r.n_known for r in lm_score.scores(d, fold(F.col("doc_id"), 5) != 1).collect()}
    assert known[train[0]] == 2 and known[held] == 1
