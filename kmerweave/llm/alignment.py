"""Alignment of two tokenizers over the same texts.

Both tokenizers cut the bytes of a text, so their tokens end at byte offsets.  The
list with fewer ends drives an exponential and then binary search (galloping) into
the longer one; offsets where both end cut the tokens into groups, and the ranks of
an end and of the one before it bound the tokens that overlap.  A batch of texts
lies end to end and is searched in a few numpy passes: every end starts from the
place that its rank suggests, doubles its step until it has passed its value, and
halves the bracket.

Links are pairs of tokens whose byte ranges overlap.  Per text only distinct pairs
with their numbers are kept; how many texts hold a pair is a DataFrame aggregation
over all of them.  The most frequent pairs (``HEAD`` at most) are broadcast to the
texts' links, the rest are joined by a shuffle; as they are rare, none is hot there.

Defined cases: null and empty texts, and those whose tokens don't give their bytes
back (the second tokenizer reads U+2581 as a space, for one), have no tokens, and
zeros; strings of special tokens are ordinary text; repeated rows are texts each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _text
from ._shared import staged, table
from .packing import _byte_letters

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs that are broadcast at most.
HEAD = 400_000
#: Bytes of text held at once.
HELD_BYTES = 500_000
#: Longer texts are encoded by the library of the vocabulary file, as a fast one's pattern engine may give up on very long runs.
LONG = 200_000


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---------------------------------------------------------------- tokens


@dataclass
class Tokenizer:
    """Ids of texts, and the bytes of every id."""

    encode: Callable[[list[str]], list[np.ndarray]]
    tokens: list[bytes]


def byte_level(path: str) -> Tokenizer:
    """A byte-level BPE file; a space goes before the text, special tokens' strings are plain text."""
    from tokenizers import Tokenizer as File

    whole = File.from_file(path)
    whole.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    vocab = model["vocab"]
    letters = _byte_letters()
    tokens = [b""] * whole.get_vocab_size()
    for x, i in whole.get_vocab().items():
        tokens[i] = bytes(letters[c] for c in x) if all(c in letters for c in x) else x.encode()
    pairs = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    fast = None
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and all(vocab.get(x) == 256 + i for i, x in enumerate(pairs)):
        import public_tokenizers
        import tiktoken

        special = {a["content"] for a in spec.get("added_tokens", [])}
        fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks={tokens[i]: i for x, i in vocab.items() if x not in special}, special_tokens={})

    def one(text: str) -> np.ndarray:
        if fast is None or len(text) > LONG:
            return np.array(whole.encode(" " + text, add_special_tokens=False).ids, np.int64)
        return np.array(fast.encode_ordinary(" " + text), np.int64)

    return Tokenizer(lambda texts: [one(t) for t in texts], tokens)


def pieces(path: str) -> Tokenizer:
    """A sentence-piece file, which adds the space itself."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(sp.vocab_size()):
        x = sp.id_to_piece(i)
        tokens.append(bytes([int(x[3:5], 16)]) if sp.is_byte(i) else x.replace("▁", " ").encode())
    return Tokenizer(lambda texts: [np.array(x, np.int64) for x in sp.encode(texts, num_threads=1)], tokens)


# ---------------------------------------------------------------- galloping intersection


def gallop(keys: np.ndarray, hay: np.ndarray, guess: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For every key the first place in its range [low, high) of the sorted ``hay`` whose value is not smaller; each range holds such a place.

    The step away from the guess doubles until the key is passed, then the bracket is halved.
    """
    left, right = guess.copy(), guess.copy()  # hay[left] < key <= hay[right] in the end
    up = hay[guess] < keys
    at, step = np.flatnonzero(up), 1
    while at.size:
        right[at] = np.minimum(left[at] + step, high[at] - 1)
        at = at[hay[right[at]] < keys[at]]
        left[at] = right[at]
        step *= 2
    at, step = np.flatnonzero(~up), 1
    while at.size:
        left[at] = np.maximum(right[at] - step, low[at] - 1)
        at = at[left[at] >= low[at]]
        at = at[hay[left[at]] >= keys[at]]
        right[at] = left[at]
        step *= 2
    at = np.flatnonzero(right - left > 1)
    while at.size:
        middle = (left[at] + right[at]) >> 1
        below = hay[middle] < keys[at]
        left[at[below]], right[at[~below]] = middle[below], middle[~below]
        at = at[right[at] - left[at] > 1]
    return right


@dataclass
class Overlap:
    """For the tokens of one side (those that drive): the first and last token of the other side that each overlaps, and whether it ends with the last."""

    driver: np.ndarray
    first: np.ndarray
    last: np.ndarray
    cut: np.ndarray


def intersect(ends: np.ndarray, other: np.ndarray, begin: np.ndarray, count: np.ndarray, other_begin: np.ndarray, other_count: np.ndarray) -> Overlap:
    """Overlaps of the tokens of some texts, whose ends lie in ``ends`` from ``begin`` on, with those in ``other``."""
    text = np.repeat(np.arange(count.size), count)
    rank = np.arange(text.size) - np.repeat(np.cumsum(count) - count, count)
    driver = begin[text] + rank
    low = other_begin[text]
    high = low + other_count[text]
    guess = low + rank * other_count[text] // np.maximum(count[text], 1)
    last = gallop(ends[driver], other, guess, low, high)
    cut = other[last] == ends[driver]
    first = low.copy()
    inner = np.flatnonzero(rank > 0)
    first[inner] = last[inner - 1] + cut[inner - 1]
    return Overlap(driver, first, last, cut)


def _written(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` of every text: the groups between common ends."""
    total = a.size + b.size
    if not total:
        return pa.array([""] * n_a.size, pa.large_string())
    # the tokens of both sides in the order they are written
    ends_a, ends_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    at_a = np.arange(a.size) + np.append(0, ends_b + 1)[group_a]
    at_b = np.arange(b.size) + ends_a[group_b] + 1
    ids, mark = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    mark[at_a[cut_a]], mark[at_b[cut_b]] = ord("|"), ord(";")
    digits = np.ones(total, np.int64)
    for power in range(1, len(str(int(ids.max())))):
        digits += ids >= 10**power
    width = digits + 1
    upto = np.cumsum(n_a + n_b)
    have = (n_a + n_b) > 0
    width[upto[have] - 1] -= 1  # nothing behind a text's last group
    end = np.cumsum(width)
    start = end - width
    out = np.empty(int(end[-1]), np.uint8)
    marked = width > digits
    out[end[marked] - 1] = mark[marked]
    for d in range(int(digits.max())):
        some = np.flatnonzero(digits > d)
        out[start[some] + digits[some] - 1 - d] = 48 + ids[some] // 10**d % 10
    offsets = np.append(0, end)[np.append(0, upto)]
    return pa.LargeStringArray.from_buffers(n_a.size, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))


def _flat(ids: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *ids])


def aligned(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;...``) and links (a, b, how often) of every row."""
    paths = (byte_path or _path(BYTE_VOCABULARY), piece_path or _path(PIECE_VOCABULARY))
    kept: dict[tuple[str, str], tuple] = _tokenizers

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        (one, two), (size_a, size_b) = kept[paths]
        texts = b.column("text").to_pylist()
        some = [i for i, t in enumerate(texts) if t]
        ids_a, ids_b = one.encode([texts[i] for i in some]), two.encode([texts[i] for i in some])
        n_a, n_b = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        use_a, use_b = [], []
        for i, x, y in zip(some, ids_a, ids_b, strict=True):
            whole = b" " + texts[i].encode()
            if b"".join([one.tokens[t] for t in x.tolist()]) == whole == b"".join([two.tokens[t] for t in y.tolist()]):
                n_a[i], n_b[i] = x.size, y.size
                use_a.append(x)
                use_b.append(y)
        a, z = _flat(use_a), _flat(use_b)
        # both sides have the same bytes, so the ends of all texts are on one scale
        end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[z])
        begin_a, begin_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        cut_a, cut_b = np.zeros(a.size, bool), np.zeros(z.size, bool)
        link_a, link_b, doc = [], [], []
        for by_a in (True, False):
            t = np.flatnonzero((n_a <= n_b) if by_a else (n_a > n_b))
            if by_a:
                o = intersect(end_a, end_b, begin_a[t], n_a[t], begin_b[t], n_b[t])
                cut_a[o.driver], cut_b[o.last] = o.cut, cut_b[o.last] | o.cut
            else:
                o = intersect(end_b, end_a, begin_b[t], n_b[t], begin_a[t], n_a[t])
                cut_b[o.driver], cut_a[o.last] = o.cut, cut_a[o.last] | o.cut
            n = o.last - o.first + 1
            near = np.repeat(o.driver, n)
            far = np.repeat(o.first, n) + np.arange(near.size) - np.repeat(np.cumsum(n) - n, n)
            link_a.append(near if by_a else far)
            link_b.append(far if by_a else near)
        at_a, at_b = np.concatenate(link_a), np.concatenate(link_b)
        doc = np.repeat(np.arange(n_a.size), n_a)[at_a]
        code, times = np.unique((doc * size_a.size + a[at_a]) * size_b.size + z[at_b], return_counts=True)
        rest, right = np.divmod(code, size_b.size)
        of, left = np.divmod(rest, size_a.size)
        struct = pa.StructArray.from_arrays([pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(times, pa.int32())], ["a", "b", "n"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n_a.size + 1)), pa.int32()), struct)
        n_groups = np.bincount(np.repeat(np.arange(n_a.size), n_a)[cut_a], minlength=n_a.size)
        n_links = np.bincount(doc, minlength=n_a.size)
        groups = _written(a, z, cut_a, cut_b, n_a, n_b).cast(pa.string())
        return pa.record_batch([b.column("doc_id"), pa.array(n_a), pa.array(n_b), pa.array(n_groups, pa.int64()), pa.array(n_links, pa.int64()), groups, lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in kept:  # read once per worker
            one, two = byte_level(paths[0]), pieces(paths[1])
            kept[paths] = ((one, two), tuple(np.array([len(x) for x in t.tokens], np.int64) for t in (one, two)))
        for b in _text.chunks(batches, size=HELD_BYTES):
            yield batch(b)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<a:int,b:int,n:int>>")


_tokenizers: dict[tuple[str, str], tuple] = {}


# ---------------------------------------------------------------- counts over the corpus


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, count (texts that hold the pair), best (whether no other pair of a has more)."""
    counts = staged(rows.select(F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.count("*").alias("count")), "pair-counts")
    # no more rows than the second vocabulary has for one id of the first
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def with_counts(rows: DataFrame, head: int = HEAD) -> DataFrame:
    """The rows with n_best and count_sum instead of links; ``rows`` is a written table with a unique ``row``."""
    counts = staged(pair_counts(rows), "pairs")
    frequent = counts
    more = counts.count() > head
    if more:
        frequent = staged(counts.orderBy(F.desc("count"), "a", "b").limit(head), "frequent-pairs")
    each = rows.select("row", F.inline("links"))
    sums = lambda df: df.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    found = sums(each.join(F.broadcast(frequent), ["a", "b"]))
    if more:
        bound = F.broadcast(frequent.select("a", "b"))
        rare = sums(each.join(bound, ["a", "b"], "left_anti").join(counts.join(bound, ["a", "b"], "left_anti").hint("merge"), ["a", "b"]))
        found = found.union(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.drop("links").join(found, "row", "left").select(*(c for c in rows.columns if c not in ("links", "row")), zero("n_best"), zero("count_sum"))


def align(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum of every row."""
    rows = staged(aligned(docs, byte_path, piece_path).withColumn("row", F.monotonically_increasing_id()), "aligned")
    return with_counts(rows, head)


def query(spark, sf_dir: str) -> DataFrame:
    rows = aligned(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    kept = rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "links", F.monotonically_increasing_id().alias("row"))
    return with_counts(staged(kept, "aligned"))
