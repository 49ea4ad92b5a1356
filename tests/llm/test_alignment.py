import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from kmerweave.llm import alignment
from kmerweave.llm.packing import _byte_letters


def literal(docs):
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = _byte_letters()

    def of_b(i):
        x = two.id_to_piece(i)
        return bytes([int(x[3:-1], 16)]) if two.is_byte(i) else x.replace("▁", " ").encode()

    rows, holders = [], Counter()
    for d, text in docs:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
        bytes_b = [of_b(i) for i in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
            rows.append((d, [], [], [], ""))
            continue
        spans = lambda parts: [(sum(map(len, parts[:i])), sum(map(len, parts[: i + 1]))) for i in range(len(parts))]
        sa, sb = spans(bytes_a), spans(bytes_b)
        links = [(a[i], b[j]) for i, (s, e) in enumerate(sa) for j, (t, f) in enumerate(sb) if s < f and t < e]
        groups, i, j = [], 0, 0
        for end in sorted({e for _, e in sa} & {e for _, e in sb}):
            p, q = next(k for k, s in enumerate(sa) if s[1] == end) + 1, next(k for k, s in enumerate(sb) if s[1] == end) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        rows.append((d, a, b, links, ";".join(groups)))
        holders.update(set(links))
    top = defaultdict(int)
    for (x, _), n in holders.items():
        top[x] = max(top[x], n)
    out = [(d, len(a), len(b), g.count(";") + 1 if g else 0, len(k), g, sum(holders[x] == top[x[0]] for x in k), sum(holders[x] for x in k)) for d, a, b, k, g in rows]
    return sorted(out, key=repr)


def cases():
    rng = random.Random(4)
    vocab = ["the", "The", "naïve", "日本語", "don't", "  ", "\n", "\t\t", "12345", "x" * 20, "<s>", "<|endoftext|>", "<0x41>", "emoji 😀😀", "a\0b", "Überraschung", "(a+b)", "ﬁ", " ", "é" * 9]
    docs = [(3 * i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 9, 40])))) for i in range(60)]
    return docs + [(900, None), (901, ""), (902, "a ▁ b"), (903, " "), (904, "\n"), docs[3], (905, docs[3][1]), (906, "lead   trail   ")]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 1, "g") for d, t in docs], "doc_id long, text string, n_a int, row string").repartition(3)


@pytest.mark.parametrize("head", [alignment.HEAD, 20])
def test_like_the_definition(spark, head):
    docs = cases()
    want = literal(docs)
    got = alignment.align(frame(spark, docs), head=head)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert any(w[0] == 902 and w[1:] == (0, 0, 0, 0, "", 0, 0) for w in want)


def test_query_digests(spark, tmp_path):
    docs = cases()
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.groups_sha256, r.n_best) for r in alignment.query(spark, str(tmp_path)).collect()}
    assert got == {(w[0], hashlib.sha256(w[5].encode()).hexdigest() if w[5] else "", w[6]) for w in literal(docs)}


def test_fast_ids_are_the_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    texts = [t for _, t in cases() if t] + ["z" * 250_000, " " * 3000 + "x", "ab\r\n" * 500]
    for t, ids in zip(texts, alignment.byte_level(path).encode(texts), strict=True):
        assert ids.tolist() == whole.encode(" " + t, add_special_tokens=False).ids


def test_gallop():
    rng = random.Random(1)
    for _ in range(200):
        hay = np.array(sorted(rng.sample(range(500), rng.randint(1, 90))))
        low = rng.randrange(hay.size)
        high = rng.randint(low + 1, hay.size)
        keys = np.array([rng.randint(0, int(hay[high - 1])) for _ in range(50)])
        n = np.full(keys.size, 1)
        guess = np.array([rng.randrange(low, high) for _ in keys])
        got = alignment.gallop(keys, hay, guess, n * low, n * high)
        assert got.tolist() == [bisect_left(hay.tolist(), int(k), low, high) for k in keys]


def test_empty_and_long(spark):
    assert alignment.align(frame(spark, cases()).limit(0)).count() == 0
    only = alignment.align(frame(spark, [(1, None), (2, ""), (None, None)])).collect()
    assert len(only) == 3 and all(r.n_links == r.n_best == r.count_sum == 0 and r.groups == "" for r in only)
    long_ = "word pieces, naïve 日本 " * 12_000  # over LONG letters
    got = alignment.align(frame(spark, [(1, long_), (2, long_[: len(long_) // 2])])).collect()
    assert all(r.n_a > 0 and r.n_links >= max(r.n_a, r.n_b) for r in got)
