import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kmerweave.llm import _text, importance


def words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())


def grams(t):
    w = words(t)
    return w + [a + b" " + b for a, b in zip(w, w[1:], strict=False)]


def texts():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(60)] + ["École", "ÉCOLE", "Big", "x" * 200, "ab" * 16, "c" * 17, "d" * 16, "e" * 33, "漢字" * 40, "0"]
    some = [" ".join(rng.choices(vocab, [1 / (1 + i) for i in range(len(vocab))], k=rng.choice([0, 1, 5, 19, 20, 60]))) for _ in range(120)]
    return some + [None, "", " -- !!", "a\0b", some[3].upper(), some[3], "z" * 5000, "q-" * 3000]


def test_crc_of_words():
    rng = random.Random(2)
    raw = [bytes(rng.choice(b"abc019\xc3\xa9") for _ in range(rng.choice([1, 2, 8, 9, 31, 32, 33, 64, 65, 100, 4000, 100_000 if i == 7 else 3]))) for i in range(300)]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(x) for x in raw])
    starts = ends - [len(x) for x in raw]
    reg = importance.registers(data, starts, ends)
    full = importance._full(reg, ends - starts)
    assert [int(x) for x in full ^ importance._ONES] == [zlib.crc32(x) for x in raw]
    pair = importance.shift(importance._step(full[:-1], 0x20), (ends - starts)[1:]) ^ reg[1:] ^ importance._ONES
    assert [int(x) for x in pair] == [zlib.crc32(a + b" " + b) for a, b in zip(raw, raw[1:], strict=False)]


@pytest.mark.parametrize("head", [(0, 0), (5, 3), (65_536, 262_144)])
def test_head_and_tail_agree(spark, head):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string").repartition(3)
    h = importance.head_of(docs, 10_000, *head) if head[0] else importance._empty_head()
    if head[0]:
        top = Counter(w for t in texts() for w in words(t) if len(w) <= 16).most_common()
        found = [bytes(x).rstrip(b"\0") for x in h.words.view(np.uint8).reshape(-1, 16)]
        assert [dict(top)[w] for w in found] == [n for _, n in top[: head[0]]]
        pairs = Counter(g for t in texts() for g in grams(t) if b" " in g and all(w in set(found) for w in g.split(b" ")))
        assert sorted((pairs[found[p >> 20] + b" " + found[p & (1 << 20) - 1]] for p in h.pairs.tolist()), reverse=True) == sorted(pairs.values(), reverse=True)[: head[1]]
    w = _text.split_words(pa.array(texts(), pa.string()).cast(pa.binary()), _text.alphanumeric_table())
    of_words, of_pairs, _, _ = importance.features(w, h)
    assert of_words.tolist() == [zlib.crc32(x) % 10_000 for t in texts() for x in words(t)]
    assert of_pairs.tolist() == [zlib.crc32(x) % 10_000 for t in texts() for x in grams(t)[len(words(t)) :]]


def literal(docs, bench):
    n = lambda ts: Counter(zlib.crc32(g) % 10_000 for t in ts for g in grams(t))
    s, t = n([x for _, x in docs]), n(bench)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    rows = []
    for d, x in docs:
        g = grams(x)
        weight = sum(gain(zlib.crc32(f) % 10_000) for f in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(words(x)), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) if d is not None else None))
    may = sorted((r for r in rows if r[1] >= 20 and r[4] is not None), key=lambda r: (-r[4], r[0]))
    drawn = may[: 25 * len(may) // 100]
    return sorted([(*r, drawn.index(r) + 1 if r in drawn else None) for r in rows], key=repr)


def test_like_the_definition(spark):
    docs = [(3 * i, t) for i, t in enumerate(texts())]
    bench = [t for t in texts()[40:60]] + [None, "new words here"]
    d = spark.createDataFrame([(a, b, "s", 1.0) for a, b in [*docs, (None, texts()[5])]], "doc_id long, text string, score string, weight double").repartition(4)
    b = spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id long, text string")
    got = importance.draw(d, b)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr) == literal([*docs, (None, texts()[5])], bench)
    kept = importance.resample(d, b)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got.where("rank is not null").collect()}


def test_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(i // 3, text) for i in range(30)], "doc_id long, text string")
    b = spark.createDataFrame([(1, text)], "item_id long, text string")
    ranks = sorted(r.rank for r in importance.draw(d, b).collect() if r.rank)
    assert ranks == list(range(1, 8))
    assert importance.draw(d.limit(0), b).count() == 0
    assert {r.weight for r in importance.draw(d, b.limit(0)).collect()} == {r.weight for r in importance.draw(d, b.where("text is null")).collect()}
    assert [r.rank for r in importance.draw(d.where("doc_id = 1"), b.limit(0)).collect()] == [None] * 3
