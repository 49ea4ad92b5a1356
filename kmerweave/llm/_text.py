"""Vectorised words of Arrow text columns.

Texts arrive as Arrow binary columns (UTF-8).  A 256-entry table maps every byte
to itself, to its lower-case letter, or to 0 for a separator, so words of a whole
batch, their 64-bit hashes and the hashes of word windows come from a few numpy
passes without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text is handled alone.
CHUNK_BYTES = 2_000_000

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_LANE_SEED, _LENGTH_KEY = _RNG.integers(1, 2**63, 2, dtype=np.uint64) | _U(1)
_POS_KEYS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | _U(1)
#: Masks of the first 0 to 8 bytes of a lane.
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], _U)


def whitespace_table() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``, A-Z lowered."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    # byte 0 is an ordinary word byte here: it moves to a value that UTF-8 never uses
    t[0] = 0xFF
    t[[0x20, *range(0x09, 0x0E)]] = 0
    return t


def alphanumeric_table() -> np.ndarray:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, A-Z lowered."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    keep = np.zeros(256, bool)
    keep[48:58] = keep[97:123] = keep[65:91] = keep[128:] = True
    t[~keep] = 0
    return t


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@dataclass
class Words:
    """Words of some texts: byte spans, and for each text its first word and count."""

    data: np.ndarray  # mapped bytes, separators are 0
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    count: np.ndarray
    size: np.ndarray  # bytes of each text

    @property
    def byte_doc(self) -> np.ndarray:
        """The text of every byte."""
        return np.repeat(np.arange(self.size.size, dtype=np.int32), self.size)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.count.size), self.count)

    def lanes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every word as 8-byte numbers, the last one filled with zeros: the numbers of all words in a row, the place of each within its word, and where each word's begin."""
        size = self.ends - self.starts
        n = (size + 7) >> 3
        begin = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(begin, n)
        # a view of 8 bytes from every byte on
        padded = np.append(self.data, np.zeros(8, np.uint8))
        every = np.ndarray(self.data.size + 1, "<u8", padded, strides=(1,))
        left = np.repeat(size, n) - 8 * at
        return every[np.repeat(self.starts, n) + 8 * at] & _FIRST_BYTES[np.minimum(left, 8)], at, begin

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word: its lanes are mixed each with its place before they are summed, so no pattern of letters cancels out."""
        if not self.starts.size:
            return np.zeros(0, _U)
        value, at, begin = self.lanes()
        h = mix(value ^ mix((at + 1).astype(_U) * _LANE_SEED))
        return mix(np.add.reduceat(h, begin) + (self.ends - self.starts).astype(_U) * _LENGTH_KEY)

    def words(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (of the whole batch: the caller drops those over a text's end)."""
    n = max(0, h.size - k + 1)
    out = np.zeros(n, _U)
    for j in range(k):
        out += h[j : j + n] * _POS_KEYS[j]
    return mix(out ^ _U(k))


def sequence_hash(h: np.ndarray) -> int:
    """Hash of one word sequence of any length under 64, equal to window_hashes of that length."""
    return int(window_hashes(h, h.size)[0])


def split_words(arr: pa.Array, table: np.ndarray) -> Words:
    """The words of a binary column; a null has none."""
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    data = table[raw]
    n = data.size
    if not n:
        zero = np.zeros(len(arr), np.int64)
        return Words(data, zero[:0], zero[:0], zero, zero.copy(), zero.copy())
    word = data != 0
    # a word starts where a word byte follows a separator or begins a text
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    edge = off[:-1][off[:-1] < off[1:]]
    begin[edge] = word[edge]
    end = word.copy()
    end[:-1] &= ~word[1:]
    last = off[1:][off[:-1] < off[1:]] - 1
    end[last] = word[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, off[:-1])
    count = np.searchsorted(starts, off[1:]) - first
    return Words(data, starts, ends, first, count, np.diff(off))


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have about ``size`` bytes at most; none is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        arr = batch.column(column).cast(pa.large_binary())
        off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + size, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def case_table() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+`` with their case."""
    t = np.arange(256, dtype=np.uint8)
    t[0] = 0xFF
    t[[0x20, *range(0x09, 0x0E)]] = 0
    return t


def byte_grams(data: np.ndarray, doc: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and bucket of every run of n bytes within one text whose inner bytes are no separators."""
    size = max(0, data.size - n + 1)
    h = np.zeros(size, np.uint32)
    ok = doc[:size] == doc[n - 1 :] if size else np.zeros(0, bool)
    for j in range(n):
        part = data[j : j + size]
        h = h * np.uint32(0x01000193) + part
        if 0 < j < n - 1:
            ok = ok & (part != 0)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
    at = np.flatnonzero(ok)
    return at, (h[at] >> np.uint32(32 - bits)).astype(np.int64)
