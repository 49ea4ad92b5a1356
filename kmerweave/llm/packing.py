"""Best-fit packing of tokenised documents by bin completion.

Documents become token ids plus an end id; longer ones are cut into full pieces
behind a first shorter one.  Only the histogram of piece lengths (at most
``capacity`` counts, whatever the corpus) decides the packing, so the search is
the same size for any input:

* the incumbent is best-fit decreasing over the histogram;
* bin completion takes the largest length left, enumerates undominated fillings
  of the room beside it in order of waste (bounded subset sums as bit sets, so no
  enumeration runs into a dead end), uses each filling as often as counts allow,
  and branches over alternatives until the waste bound proves the incumbent
  optimal or the node limit is reached.

The result is a list of patterns with multiplicities.  Spark numbers the pieces
of each length (length and hash bucket, so a length that holds most pieces is
spread) and looks their place up in the patterns.

Defined cases: a null text is an empty one, an empty text is one piece of one
token; repeated rows are packed each; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _text
from ._shared import staged, table

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: Hash buckets within a length, for numbering its pieces.
BUCKETS = 256
#: Search nodes after the first descent.
NODES = 400

Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first


# ---------------------------------------------------------------- tokens


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable letter: the printable ones as themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    for i, b in enumerate(b for b in range(256) if b not in set(shown)):
        letters[chr(256 + i)] = b
    return letters


def encoder(path: str):
    """Text to a numpy array of ids, as ``tokenizers`` gives without special tokens added.

    A plain byte-level BPE file whose ids follow its merges is run by tiktoken,
    which gives the same ids in less time; any other file by tokenizers itself.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)

    def by_tokenizers(text: str) -> np.ndarray:
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
    vocab, merges = model.get("vocab", {}), model.get("merges", [])
    pairs = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
    plain = (
        model.get("type") == "BPE"
        and not model.get("dropout")
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and not spec.get("normalizer")
        and all(vocab.get(x) == 256 + i for i, x in enumerate(pairs))
        and not any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added)
    )
    if not plain:
        return by_tokenizers
    import tiktoken

    letters, special = _byte_letters(), {a["content"]: a["id"] for a in added}
    ranks = {bytes(letters[c] for c in x): i for x, i in vocab.items() if x not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def by_tiktoken(text: str) -> np.ndarray:
        if len(text) > 200_000:  # its pattern engine may give up on very long runs
            return by_tokenizers(text)
        return fast.encode_to_numpy(text, allowed_special="all")

    return by_tiktoken


_encoders: dict[str, object] = {}


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    path = path or tokenizer_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:  # kept by the worker between tasks
            _encoders[path] = encoder(path)
        encode = _encoders[path]
        for b in _text.chunks(batches):
            row, at, begin, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = np.append(encode(text or ""), end_id).astype("<u4")
                cuts = [0, *range(ids.size % capacity or capacity, ids.size + 1, capacity)] if ids.size > capacity else [0, ids.size]
                raw = memoryview(ids.tobytes())
                for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row.append(i)
                    at.append(k)
                    begin.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(raw[4 * s : 4 * e]))
            yield pa.record_batch([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(at, pa.int32()), pa.array(begin, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- the search over the histogram


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: the volume bound, and for each k the items over capacity - k alone, those over half, and what of the rest doesn't fit beside them."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    for k in range(capacity // 2 + 1):
        big = sum(n for s, n in counts.items() if s > capacity - k)
        mid = sum(n for s, n in counts.items() if capacity - k >= s > capacity // 2)
        mid_room = sum((capacity - s) * n for s, n in counts.items() if capacity - k >= s > capacity // 2)
        small = sum(s * n for s, n in counts.items() if capacity // 2 >= s >= k)
        best = max(best, big + mid + max(0, -(-(small - mid_room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing; equal bins are handled together."""
    rooms: dict[int, Counter] = {}  # room -> patterns
    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            room = min((r for r in rooms if r >= s), default=None)
            if room is None:
                q = capacity // s
                full, rest = divmod(left, q)
                for n, times in ((q, full), (rest, 1)):
                    if n and times:
                        rooms.setdefault(capacity - n * s, Counter())[((s, n),)] += times
                left = 0
                continue
            for pattern in list(rooms[room]):
                if not left:
                    break
                n = min(rooms[room][pattern], left)
                rooms[room][pattern] -= n
                if not rooms[room][pattern]:
                    del rooms[room][pattern]
                grown = (*pattern[:-1], (s, pattern[-1][1] + 1)) if pattern[-1][0] == s else (*pattern, (s, 1))
                rooms.setdefault(room - s, Counter())[grown] += n
                left -= n
            if not rooms[room]:
                del rooms[room]
    out: Counter = Counter()
    for patterns in rooms.values():
        out.update(patterns)
    return out


def _dominates(a: Pattern, b: Pattern) -> bool:
    """Whether the items of b can be laid into those of a (largest first into the tightest)."""
    rooms = sorted(s for s, n in a for _ in range(n))
    for s in (s for s, n in b for _ in range(n)):
        fit = next((i for i, r in enumerate(rooms) if r >= s), None)
        if fit is None:
            return False
        rooms[fit] -= s
        rooms.sort()
    return True


def fillings(counts: dict[int, int], room: int, width: int) -> list[Pattern]:
    """Up to ``width`` undominated fillings of the room, least waste first, then larger items first."""
    sizes = sorted(s for s, n in counts.items() if n and s <= room)
    mask, reach = (1 << (room + 1)) - 1, [1]  # reach[i]: sums of the i smallest sizes
    for s in sizes:
        bits, n, step = reach[-1], min(counts[s], room // s), 1
        while n > 0:
            take = min(step, n)
            bits |= (bits << (s * take)) & mask
            n -= take
            step *= 2
        reach.append(bits)
    out: list[Pattern] = []

    def walk(i: int, target: int, chosen: Pattern) -> Iterator[Pattern]:
        if not target:
            yield chosen
            return
        if not i:
            return
        s = sizes[i - 1]
        for n in range(min(counts[s], target // s), -1, -1):
            if reach[i - 1] >> (target - n * s) & 1:
                yield from walk(i - 1, target - n * s, (*chosen, (s, n)) if n else chosen)

    looked = 0
    for target in range(room, -1, -1):
        if not reach[-1] >> target & 1:
            continue
        for f in walk(len(sizes), target, ()):
            looked += 1
            if not any(_dominates(g, f) for g in out):
                out.append(f)
            if len(out) >= width or looked >= 4 * width:
                return out
    return out


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, width: int = 3) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used; as few bins in all as the search finds."""
    counts = {s: n for s, n in counts.items() if n}
    least = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    best_bins = sum(best.values())
    total = sum(s * n for s, n in counts.items())

    def apply(left: dict[int, int], top: int, f: Pattern) -> tuple[Pattern, int]:
        whole = Counter({top: 1})
        for s, n in f:
            whole[s] += n
        times = min(left[s] // n for s, n in whole.items())
        for s, n in whole.items():
            left[s] -= n * times
        return tuple(sorted(whole.items(), reverse=True)), times

    # each entry: what is left, bins so far, volume left, patterns so far (linked), next choices
    def expand(left: dict[int, int]) -> tuple[int, list[Pattern]]:
        top = max(s for s, n in left.items() if n)
        beside = dict(left)
        beside[top] -= 1
        return top, fillings(beside, capacity - top, width)

    spent, stack = 0, [(counts, 0, total, None)]
    pending: list = []
    while best_bins > least and (stack or pending) and spent <= nodes:
        left, bins, volume, path = stack.pop() if stack else pending.pop()
        first_descent = spent == 0
        while True:
            if not volume:
                if bins < best_bins:
                    best_bins, best = bins, Counter()
                    while path:
                        best[path[0]] += path[1]
                        path = path[2]
                break
            if bins + -(-volume // capacity) >= best_bins:  # the waste so far can't be made good
                break
            top, choices = expand(left)
            for f in choices[:0:-1]:
                other = dict(left)
                pattern, times = apply(other, top, f)
                pending.append(({s: n for s, n in other.items() if n}, bins + times, volume - times * sum(s * n for s, n in pattern), (pattern, times, path)))
            left = dict(left)
            pattern, times = apply(left, top, choices[0])
            left = {s: n for s, n in left.items() if n}
            bins += times
            volume -= times * sum(s * n for s, n in pattern)
            path = (pattern, times, path)
            if not first_descent:
                spent += 1
                if spent > nodes:
                    break
        spent += 1
    return sorted(best.items(), reverse=True)


# ---------------------------------------------------------------- placing


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """One row per piece with its sequence_id and offset."""
    spark = docs.sparkSession
    cut = staged(pieces(docs, capacity, end_id, path), "pieces")
    columns = cut.columns
    # a full piece is a sequence of its own; its number is negative, so no other has it
    full = cut.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = cut.where(F.col("length") < capacity).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    # at most capacity * buckets rows, whatever the input
    cells = sorted((r.length, r.bucket, r["count"]) for r in part.groupBy("length", "bucket").count().collect())
    counts: Counter = Counter()
    before: dict[tuple[int, int], int] = {}
    for length, bucket, n in cells:
        before[length, bucket] = counts[length]
        counts[length] += n
    slots, at, used, sequence = [], [], Counter(), 0
    for pattern, times in bin_completion(counts, capacity):
        offset = 0
        for s, n in pattern:
            at.append((s << 44) + used[s])
            slots.append((n, sequence, offset))
            used[s] += n * times
            offset += n * s
        sequence += times
    order = np.argsort(np.array(at, np.int64), kind="stable")
    shared = spark.sparkContext.broadcast((np.array(at, np.int64)[order], np.array(slots, np.int64).reshape(-1, 3)[order], before))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, slot, ahead = shared.value
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            number = b.column("number").to_numpy(zero_copy_only=False).astype(np.int64)
            number = number + np.array([ahead[x] for x in zip(length.tolist(), b.column("bucket").to_pylist(), strict=True)], np.int64)
            key = (length.astype(np.int64) << 44) + number
            i = np.searchsorted(begins, key, side="right") - 1
            n, first, offset = slot[i].T
            bin_, copy = np.divmod(key - begins[i], n)
            yield pa.record_batch([*(b.column(c) for c in columns), pa.array(first + bin_), pa.array(offset + copy * length)], [*columns, "sequence_id", "offset"])

    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    placed = part.withColumn("number", F.row_number().over(own) - 1).mapInArrow(place, full.schema)
    return placed.unionByName(full)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
