"""The size of the learnt sample, and its bags against a plain reading."""

import inspect

from kmerweave.llm import toxicity as tx


def test_sample_is_whole():
    assert inspect.signature(tx.fit).parameters["sample"].default >= 1200


def test_bags_like_plain_reading():
    texts = [b"You i d i o t, idiooot! The water.", b"", b"water (water) a b c d", b"The stone"]
    bags = tx._bags(texts)
    want = [tx.bare(w) for w in bags.words.words()]
    for a, b in bags.runs:
        want[a] = b"".join(want[a:b])
    assert bags.runs and [bags.names[i] for i in bags.ids] == want
    assert list(bags.names) == sorted(set(want))
    assert len(tx._bags([b"", b""]).ids) == 0
