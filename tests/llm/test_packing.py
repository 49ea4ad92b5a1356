import random
import zlib
from collections import Counter

import numpy as np
import pytest

from kmerweave.llm import packing as pk


def bins_of(patterns):
    return sum(n for _, n in patterns)


def check(counts, capacity):
    found = pk.bin_completion(counts, capacity)
    used = Counter()
    for p, n in found:
        assert sum(s * k for s, k in p) <= capacity
        for s, k in p:
            used[s] += k * n
    assert used == Counter({s: n for s, n in counts.items() if n})
    return bins_of(found)


def exact(items, capacity):
    """Fewest bins by exhaustive search."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in {r for r in rooms if r >= items[i]}:
            k = rooms.index(r)
            go(i + 1, rooms[:k] + [r - items[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def test_optimal_on_small_cases():
    rng = random.Random(5)
    for _ in range(120):
        cap = rng.choice([10, 20, 50])
        items = [rng.randint(1, cap) for _ in range(rng.randint(1, 11))]
        got = check(Counter(items), cap)
        assert got == exact(items, cap), (items, cap)
        assert pk.lower_bound(Counter(items), cap) <= got


def test_large_histogram_reaches_the_bound():
    rng = random.Random(6)
    counts = Counter(min(1023, int(rng.lognormvariate(5.5, 1))) + 1 for _ in range(20000))
    got = check(counts, 1024)
    assert got - pk.lower_bound(counts, 1024) <= 1
    assert check({}, 1024) == 0


def test_encoder_is_the_tokenizers_one():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(pk.tokenizer_path())
    fast = pk.encoder(pk.tokenizer_path())
    for t in ["", "a", "Hello  world\n\n x", "don't <|endoftext|> stop", "École ñandú 漢字 🙂 \u0000", "  lead", "tail \n", "x" * 3000, " " * 300_000, "½²Ⅷ 12½", "a b c"]:
        assert fast(t).tolist() == whole.encode(t, add_special_tokens=False).ids, t[:20]


@pytest.mark.parametrize("texts", [[None, "", "one", "word " * 5000, "x y z " * 700, "same", "same", "same"], []])
def test_pack(spark, texts):
    rows = [(i % 7, t, "k") for i, t in enumerate(texts)]
    got = pk.pack(spark.createDataFrame(rows, "doc_id long, text string, length string"), buckets=3).collect()
    encode = pk.encoder(pk.tokenizer_path())
    want = Counter()
    for d, t, _ in rows:
        ids = [*encode(t or "").tolist(), 2]
        first = len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)] if len(ids) > 1024 else [0]
        for k, s in enumerate(starts):
            part = np.array(ids[s : [*starts, len(ids)][k + 1]], "<u4")
            want[d, k, s, part.size, zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    at = {}
    for r in got:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in at.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= 1024
