"""Gather without a bound on its references."""

import random

import pytest

from kmerweave import queries as library
from kmerweave.operators import sketch
from kmerweave.operators._stage import staged


def brute(query, refs, least=0.0):
    left, out = set(query), []
    while left:
        n, key = min((-len(h & left), k) for k, h in refs.items())
        if n == 0 or -n / len(query) < least:
            break
        out.append((len(out) + 1, key, -n, -n / len(query)))
        left -= refs[key]
    return out


def rows(df):
    return [tuple(r) for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize("seed", [1])
def test_gather_goes_on_until_nothing_matches(spark, seed):
    rng = random.Random(seed)
    query = set(range(300))
    refs = {k: {rng.randrange(400) for _ in range(rng.randint(1, 25))} for k in range(60)}
    q = spark.createDataFrame([(h,) for h in query], "hash long")
    r = spark.createDataFrame([(k, h) for k, hs in refs.items() for h in hs], "id long, hash long")
    want = brute(query, refs)
    assert len(want) > 12
    assert rows(sketch.gather(q, r, "id")) == want
    assert rows(sketch.gather(q, r, "id", least=0.03)) == brute(query, refs, 0.03)
    assert rows(sketch.gather(q, r, "id", rounds=5)) == want[:5]
    assert rows(sketch.gather(q.limit(0), r, "id")) == []


def test_registered_gather_goes_past_twelve(spark, tmp_path):
    """Each of twenty items is held by one document, so twenty references are needed."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(1500)) for _ in range(20)]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(100 + i, t, "en", "web") for i, t in enumerate(texts)] + [(200, texts[0] + texts[1][:400], "en", "web")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    items = staged(sketch.scaled_sketch(library._records(spark, str(tmp_path)), library.K, library.SCALED, "query"), "items")
    refs = {}
    for d in library._doc_sketch(spark, str(tmp_path)).collect():
        refs.setdefault(d.id, set()).add(d.hash)
    want = brute({r.hash for r in items.collect()}, refs)
    assert len(want) > 12
    assert rows(library.QUERIES["greedy_gather"](spark, str(tmp_path))) == want
